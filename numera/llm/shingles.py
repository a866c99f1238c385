"""Near-duplicates by the Jaccard similarity of five-word shingles, over whole texts.

Every text is its set of hashed shingles.  Equal sets form one class.  The
SimHash fingerprints of the classes are indexed as in ``simhash``: posted under
pairs of their positional bytes, members tally the bytes they share, those that
reach the count compare their bits, and those within ``simhash.MAX_BITS`` are
candidates.  Pairs of similarity 0.8 are mostly further apart, where no such
index can promise anything.  For these a class is posted, too, under ``BANDS`` keys of ``ROWS`` minimum hashes each: two sets of
similarity 0.8 share none of them with probability (1 - 0.8**4)**20 < 3e-5.
Classes that share one of these pass a size filter and, where both have ``SMALL``
shingles or more, the ``RADIUS`` of two 64-bit SimHash fingerprints of the set;
sets of similarity 0.8 differ in 19.4 of the 128 bits on average, with a
deviation of 4.1, so the radius is five deviations away.  What is left is
verified on the whole sets.  A first round verifies, for every member of a
posting, its first and its closest earlier candidate; only pairs that these
links leave apart are verified in a second.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.llm import simhash
from numera.llm.common import components, cut, drop_cut, run_bounds, whole_runs

SHINGLE = 5
SEED = 42
BANDS, ROWS = 20, 4
RADIUS, SMALL = 40, 32
#: Members of a posting that a task compares with each other, about.
TILE = 4096
_R = np.random.default_rng(17)
_XOR = _R.integers(0, (1 << 64) - 1, BANDS * ROWS, np.uint64)
_ODD = _R.integers(0, (1 << 64) - 1, SHINGLE, np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    w = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), np.uint64, len(words))
    h = np.zeros(len(w) - shingle + 1, np.uint64)
    for k in range(shingle):
        h += w[k : k + len(h)] * _ODD[k]
    return np.unique(_mix(h))


def sketch(s: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Two SimHash fingerprints of a set and its posting keys, all of whole sets."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    ones = np.zeros(128, np.int64)
    for at in range(0, len(s), 2048):
        part = s[at : at + 2048]
        x = (part[None, :] ^ _XOR[:, None]) * _M1
        x ^= x >> np.uint64(32)
        x *= _M2
        np.minimum(low, x.min(axis=1), out=low)
        both = np.stack([part, _mix(part ^ _XOR[0])], axis=1)
        ones += np.unpackbits(both.view(np.uint8).reshape(len(part), 16), axis=1).sum(axis=0, dtype=np.int64)
    f = np.packbits(ones * 2 > len(s)).view(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix(keys * _M2 ^ low.reshape(BANDS, ROWS)[:, r])
    return int(f[0]), int(f[1]), keys


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, node, n, f1, f2, ks) of every row: hash of the text, class (hash of its set), size, fingerprints, keys."""

    def run(batches):
        for b in batches:
            node, n, fp, ks = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text)
                f1, f2, k = sketch(s)
                node.append(xxhash.xxh3_64_intdigest(s.tobytes(), SEED))
                n.append(len(s))
                fp.append((f1, f2))
                ks.append(k)
            f = np.array(fp, np.uint64).reshape(-1, 2)
            flat = np.concatenate(ks).view(np.int64) if ks else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            cols = [np.array(node, np.uint64).view(np.int64), np.array(n, np.int32), np.ascontiguousarray(f[:, 0]).view(np.int64), np.ascontiguousarray(f[:, 1]).view(np.int64)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, cols), lists], ["doc_id", "t", "node", "n", "f1", "f2", "ks"])

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    return src.mapInArrow(run, "doc_id long, t long, node long, n int, f1 long, f2 long, ks array<long>")


def postings(classes: DataFrame) -> DataFrame:
    """(k, node, root, n, f1, f2): the classes under their minimum-hash keys, which are odd, and under the keys of the first fingerprint's index, which are even."""
    low = F.transform("ks", lambda k: k.bitwiseOR(F.lit(1)))
    index = F.transform(simhash.index_keys("f1"), lambda k: F.shiftleft(k, 1))
    return classes.where("n > 0").select(F.explode(F.concat(low, index)).alias("k"), "node", F.col("node").alias("root"), "n", "f1", "f2")


def _near(f: np.ndarray, n: np.ndarray, i: int, below: int | None, indexed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Members before ``i`` (before ``below``, if given) that the filters leave, and their distances; in a posting of the index, tally and bits of the fingerprint."""
    k = i if below is None else below
    least, most = np.minimum(n[:k], n[i]), np.maximum(n[:k], n[i])
    if indexed:
        hit = simhash.near(f[i, 0], np.ascontiguousarray(f[:k, 0]), simhash.MAX_BITS)
        hit = hit[5 * least[hit] >= 4 * most[hit]]
        return hit, np.bitwise_count(f[hit, 0] ^ f[i, 0])
    d = np.bitwise_count(f[:k] ^ f[i]).sum(axis=1)
    hit = np.flatnonzero((5 * least >= 4 * most) & ((d <= RADIUS) | (least < SMALL)))
    return hit, d[hit]


def _tiled(postings: DataFrame) -> DataFrame:
    """Rows of postings with the pair of tiles (ta, tb) they meet in, and their own tile ``tile``.

    A posting of about ``TILE`` members or fewer is one tile.  Larger ones, seen
    by a 64th of the members, are cut into tiles by the hash of the node; each
    pair of tiles is a unit of its own, so every pair of members meets in just
    one, and no task holds or compares more than two tiles at once.
    """
    part = postings.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(64)) == 0)
    large = part.groupBy("k").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") * 64 > TILE)
    large = cut(large.select("k", F.ceil(F.col("seen") * 64 / TILE).cast("int").alias("tiles")), "large")
    zero = F.lit(0)
    if large.isEmpty():
        drop_cut(large)
        return postings.withColumns({"ta": zero, "tb": zero, "tile": zero})
    tiles = F.coalesce("tiles", F.lit(1))
    placed = postings.join(large, "k", "left").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(9)), tiles).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(zero, tiles - 1)))
    return met.select(*postings.columns, F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile")


def _candidates(postings: DataFrame, every: bool) -> DataFrame:
    """(src, dst, open): pairs within postings, of different ``root``; unless ``every``, two a member and tile and the keys with further ones (open, in src)."""

    def run(batches):
        for t in whole_runs(batches, ["k", "ta", "tb"]):
            k, ta, tb, tile, node, root, n = (t.column(c).to_numpy() for c in ("k", "ta", "tb", "tile", "node", "root", "n"))
            f = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("f1", "f2")], axis=1)
            at = run_bounds(k, ta, tb)
            src, dst, open_ = [], [], []
            for b in np.flatnonzero(np.diff(at) > 1):
                s, e = at[b], at[b + 1]
                # within a tile each member meets those before it, else those of the first tile
                first = None if ta[s] == tb[s] else int(np.searchsorted(tile[s:e], tb[s]))
                more = False
                for i in range(1 if first is None else first, e - s):
                    hit, d = _near(f[s:e], n[s:e], i, first, k[s] % 2 == 0)
                    hit, d = (x[root[s + hit] != root[s + i]] for x in (hit, d))
                    if not len(hit):
                        continue
                    if not every:
                        more |= len(hit) > 2
                        hit = np.unique([hit[0], hit[np.argmin(d)]]) if len(hit) > 2 else hit
                    src.append(np.full(len(hit), node[s + i]))
                    dst.append(node[s + hit])
                    open_.append(np.zeros(len(hit), bool))
                    if len(src) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst, open_)], ["src", "dst", "open"])
                        src, dst, open_ = [], [], []
                if more:
                    src.append(k[s : s + 1])
                    dst.append(k[s : s + 1])
                    open_.append(np.ones(1, bool))
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst, open_)], ["src", "dst", "open"])

    keys = ["k", "ta", "tb"]
    return _tiled(postings).repartition(*keys).sortWithinPartitions(*keys, "tile", "node").mapInArrow(run, "src long, dst long, open boolean").distinct()


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) of Jaccard similarity 0.8 or more, by their whole sets; ``texts`` has (node, text) of their ends."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(x).view(np.int64) for x in b.column(1).to_pylist()]
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["node", "s"])

    sets = cut(texts.mapInArrow(run, "node long, s array<long>"), "sets")
    a, b = (sets.select(F.col("node").alias(x), F.col("s").alias(s)) for x, s in (("src", "s1"), ("dst", "s2")))
    shared = F.size(F.array_intersect("s1", "s2"))
    out = cut(pairs.join(a, "src").join(b, "dst").where(9 * shared >= 4 * (F.size("s1") + F.size("s2"))).select("src", "dst"), "links")
    drop_cut(sets)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, component_id) of every row; ``t`` is Spark's xxhash64 of its text.

    Texts link at a Jaccard similarity of 0.8 or more of their shingle sets; the
    component is named by its smallest id.  Texts without words are equal.  Rows
    repeated under one id keep their rows, each in the component of its own
    text.  A null id takes part in no component (null).  An empty table gives an
    empty one.
    """
    every = cut(sketches(docs, id_col, text_col), "sketches")
    named = every.where("doc_id is not null")
    first = lambda c: F.first(c).alias(c)
    classes = cut(named.groupBy("node").agg(F.min("doc_id").alias("rep"), *map(first, ("n", "f1", "f2", "ks"))), "classes")
    # one row of each class gives its text
    one = named.groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("x")).select("node", F.col("x.doc_id").alias("i"), F.col("x.t").alias("h"))
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("h"), text.alias("text"))

    def texts(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
        return own.join(one.join(ends, "node"), ["i", "h"]).dropDuplicates(["node"]).select("node", "text")

    posted = postings(classes)
    found = cut(_candidates(posted, False), "candidates")
    pairs = found.where("not open").select("src", "dst")
    links = _verified(texts(pairs), pairs)
    roots = components(links)
    open_ = found.where("open").select(F.col("src").alias("k"))
    if not open_.isEmpty():
        again = posted.drop("root").join(open_, "k", "left_semi").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rest = cut(_candidates(again, True).select("src", "dst").join(pairs, ["src", "dst"], "left_anti"), "candidates")
        more = _verified(texts(rest), rest)
        if not more.isEmpty():
            roots = components(links.union(more))
        drop_cut(rest)
    drop_cut(found)
    grouped = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    out = every.select("doc_id", "t", "node").join(grouped.join(least, "root").select("node", "component_id"), "node", "left")
    return out.select("doc_id", "t", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of the component of their text, and those without an id; all columns stay."""
    near = near_duplicates(docs, id_col, text_col)
    gone = near.where("doc_id != component_id").select(F.col("doc_id").alias("__gone"), F.col("t").alias("__t")).distinct()
    return docs.join(gone, (F.col(id_col).cast("long") == F.col("__gone")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__t")), "left_anti")

"""Removal of repeated byte strings by a sparse suffix array.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts anywhere
else as well.  Sorting every suffix would move each byte ``LENGTH`` times, so
only suffixes at anchors are sorted.  The anchor of a window of ``WINDOW``
k-grams is its leftmost k-gram of smallest hash: it depends on the window's
bytes alone, so equal strings have anchors at equal places, and every string of
``LENGTH`` bytes has one within its first ``WINDOW`` positions.

Around an anchor only its context matters: ``WINDOW - 1`` bytes to the left and
``LENGTH`` to the right.  First the anchors are grouped by the bytes that any
two equal strings share behind the anchor (the *head*), which leaves those of
repeated passages.  Anchors whose whole contexts are equal are repeats
throughout and are done.  The contexts of the others, which stand at the edges
of repeated passages, are range-partitioned by sampled splitters on their
leading bytes; every bucket sorts its suffixes by multikey quicksort (partition
by the next eight bytes, then within equal parts by the following eight), and
the lengths of common prefixes of neighbours, with the same for the reversed
left contexts, tell which strings occur twice.  Suffixes with equal heads never
part at a splitter, so no repeat spans a boundary.

A head with more than ``HOT`` different contexts (a passage that very many
documents share, each in its own surroundings) is not held in one task: its
contexts are taken apart into their strings, whose 128-bit hashes are counted
and joined, which splits and combines wherever the rows are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numera.llm.common import cut

LENGTH = 200
GRAM = 24
SEED = 99
#: Bytes of text whose anchors are found at once.
CHUNK = 1 << 20
#: Suffixes of a bucket that are compared at once, at least; a head is never parted.
FLUSH = 20_000
#: Different contexts of a head that one task compares.
HOT = 1 << 16


def _table() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_TABLE = _table()


def _gram_hash(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each position, by doubling."""
    mul = np.uint64(0x9E3779B97F4A7C15)
    pieces, size, h, done, acc = gram, 1, _TABLE[data], 0, None
    n = len(data) - gram + 1
    with np.errstate(over="ignore"):
        while True:
            if pieces & 1:
                part = h[done : done + n]
                acc = part.copy() if acc is None else (acc ^ (acc >> np.uint64(29))) * mul + part
                done += size
            pieces >>= 1
            if not pieces:
                break
            h = (h[:-size] ^ (h[:-size] >> np.uint64(31))) * mul + h[size:]
            size *= 2
        acc = (acc ^ (acc >> np.uint64(32))) * mul
    return acc


def anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, gram: int, length: int) -> np.ndarray:
    """Positions of the anchors of all strings of ``length`` bytes inside the documents [first, last) of ``data``."""
    n = len(data) - gram + 1
    if n < window:
        return np.zeros(0, np.int64)
    key = (_gram_hash(data, gram) & ~np.uint64(CHUNK * 4 - 1)) | np.arange(n, dtype=np.uint64)
    low, size = key, 1
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[: len(low) - (window - size)], low[window - size :])
    ok = np.zeros(len(low) + 1, np.int32)
    full = (last - first) >= length
    np.add.at(ok, first[full], 1)
    np.add.at(ok, np.minimum(last[full] - length + 1, len(low)), -1)
    low = low[np.cumsum(ok[:-1]) > 0]
    if not len(low):
        return np.zeros(0, np.int64)
    flag = np.zeros(n, bool)
    flag[(low & np.uint64(CHUNK * 4 - 1)).astype(np.int64)] = True
    return np.flatnonzero(flag)


def _chunks(docs: list[bytes], length: int):
    """Groups of (document, offset, bytes) of about CHUNK bytes; longer documents come in overlapping parts."""
    group, size = [], 0
    for i, d in enumerate(docs):
        if len(d) < length:
            continue
        for at in range(0, max(1, len(d) - length + 1), CHUNK):
            part = d[at : at + CHUNK + length - 1]
            if size and size + len(part) > 2 * CHUNK:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def find_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(head, full, doc, pos, rest, ready): anchors of every document, by hashes of head and whole context.

    ``docs`` has (doc, text).  Contexts that a batch holds several times are
    repeats already: they come as ``ready``, and only one of them keeps its
    head, so a passage that many documents share is one row per batch.
    """
    window = length - gram - 16
    share = length - window + 1  # bytes behind an anchor that any two equal strings have in common

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [(t or "").encode("utf-8") for t in b.column(1).to_pylist()]
            found = [np.zeros(0, np.int64)]
            for group in _chunks(texts, length):
                sizes = np.array([len(p) for _, _, p in group])
                last = np.cumsum(sizes)
                pos = anchors(np.frombuffer(b"".join(p for _, _, p in group), np.uint8), last - sizes, last, window, gram, length)
                part = np.searchsorted(last, pos, side="right")
                doc, start = (np.array([g[k] for g in group], np.int64) for k in (0, 1))
                found.append(doc[part] << 36 | pos - (last - sizes)[part] + start[part])
            # overlapping parts of one document may name an anchor twice
            every = np.unique(np.concatenate(found))
            rows: list[tuple] = []
            met: dict[bytes, int] = {}
            for i, p in zip((every >> 36).tolist(), (every & (1 << 36) - 1).tolist()):
                d = texts[i]
                left, right = min(p, window - 1), min(len(d) - p, length)
                full = xxhash.xxh3_128_digest(d[p - left : p + right], left << 16 | right)
                k = met.setdefault(full, len(rows))
                if k < len(rows):
                    rows[k] = (*rows[k][:5], True)
                    rows.append((xxhash.xxh3_64_intdigest(f"{ids[i]} {p}".encode()) - (1 << 63), b"", ids[i], p, right, True))
                else:
                    rows.append((xxhash.xxh3_64_intdigest(d[p : p + share]) - (1 << 63), full, ids[i], p, right, False))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["head", "full", "doc", "pos", "rest", "ready"])

    return docs.mapInArrow(run, "head long, full binary, doc long, pos int, rest int, ready boolean")


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` (n x w, big-endian eight-byte keys), and the words each shares with the row before.

    Multikey quicksort by levels: rows are parted by one word, and the parts
    that tie go on with the next word.
    """
    n, w = words.shape
    order, same = np.arange(n), np.zeros(n, np.int64)
    part = np.zeros(n, np.int64)  # part of each place in ``order``
    open_ = np.arange(n)  # places whose part has several rows
    for k in range(w):
        if len(open_) < 2:
            break
        rows = order[open_]
        by = np.lexsort((words[rows, k], part[open_]))
        order[open_] = rows[by]
        v, p = words[order[open_], k], part[open_]
        new = np.ones(len(open_), bool)
        new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
        same[open_[~new]] = k + 1
        part[open_] = np.cumsum(new) + k * (n + 1)
        stay = ~new
        stay[:-1] |= ~new[1:]
        open_ = open_[stay]
    return order, same


def _common(rows: np.ndarray, order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Bytes that each row in ``order`` has in common with the one before."""
    out = np.zeros(len(order), np.int64)
    for s in range(1, len(order), 1 << 16):
        t = np.arange(s, min(len(order), s + (1 << 16)))
        diff = rows[order[t]] != rows[order[t - 1]]
        out[t] = np.where(diff.any(axis=1), diff.argmax(axis=1), rows.shape[1])
    return out


def repeated_starts(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, length: int) -> np.ndarray:
    """For contexts (left reversed): n x (w + 1) flags, whether the string that starts o bytes before the anchor repeats."""
    n, w = left.shape

    def keys(x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % 8
        return np.ascontiguousarray(np.pad(x, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)

    order_r, same_r = multikey_order(keys(right))
    order_l, same_l = multikey_order(keys(left))
    lcp_r, lcp_l = _common(right, order_r, same_r), _common(left, order_l, same_l)
    out = np.zeros((n, w + 1), bool)
    group_r, group_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(w + 1):
        valid = (n_left >= o) & (n_right >= length - o)
        if valid.sum() < 2:
            continue
        group_r[order_r] = np.cumsum(lcp_r < length - o)
        group_l[order_l] = np.cumsum(lcp_l < o)
        own = np.flatnonzero(valid)
        key = group_r[own] * (n + 1) + group_l[own]
        by = np.argsort(key, kind="stable")
        eq = key[by][1:] == key[by][:-1]
        out[own[by[1:][eq]], o] = True
        out[own[by[:-1][eq]], o] = True
    return out


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, s, e): of ``contexts`` (doc, pos, l, r, whole, ...), the ranges of their strings that occur in several, by hash."""

    def strings(batches):
        for b in batches:
            for row in range(0, b.num_rows, 512):
                doc, pos, l, r, whole = (c.to_pylist() for c in b.slice(row, 512).columns[:5])
                out: list[tuple] = []
                for d, p, a, z, w in zip(doc, pos, l, r, whole):
                    both, n = a + z, len(a)
                    for o in range(max(0, length - len(z)), n + 1):
                        h = xxhash.xxh3_128_intdigest(both[n - o : n - o + length], o)
                        out.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), d, p, o, w))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["h1", "h2", "doc", "pos", "o", "whole"])

    every = contexts.select("doc", "pos", "l", "r", "whole").mapInArrow(strings, "h1 long, h2 long, doc long, pos int, o int, whole boolean")
    twice = every.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    found = every.where("not whole").join(twice, ["h1", "h2"]).groupBy("doc", "pos").agg(F.min("o").alias("low"), F.max("o").alias("high"))
    return found.select("doc", (F.col("pos") - F.col("high")).alias("s"), (F.col("pos") - F.col("low") + length).alias("e"))


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, s, e): byte ranges to remove, which may overlap; ``docs`` has (doc, text, ...)."""
    window = length - gram - 16
    share = length - window + 1
    by_head = Window.partitionBy("head")
    in_head = by_head.orderBy("full", "doc", "pos")
    same = lambda c: (F.col("full") == F.col(c)) & (F.col("full") != F.lit(b""))
    marked = (
        find_anchors(docs.select("doc", "text"), length, gram)
        .withColumn("prev", F.lag("full").over(in_head))
        .withColumn("next", F.lead("full").over(in_head))
        .withColumn("mixed", F.min("full").over(by_head) != F.max("full").over(by_head))
        .select(
            "doc", "pos", "rest", "head",
            (F.col("ready") | F.coalesce(same("prev"), F.lit(False)) | F.coalesce(same("next"), F.lit(False))).alias("whole"),
            (F.col("mixed") & (F.col("full") != F.lit(b"")) & ~F.coalesce(same("prev"), F.lit(False))).alias("compare"),
        )
        .where("whole or compare")
    )
    marked = cut(marked, "anchors")
    # contexts are read from the texts of the documents that have anchors to compare
    hot = marked.where("compare").groupBy("head").count().where(F.col("count") > HOT).select("head", F.lit(True).alias("hot"))
    asked = marked.where("compare").join(hot, "head", "left").withColumn("hot", F.col("hot").isNotNull())
    wanted = asked.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("pos", "whole", "hot"))).alias("at"))
    texts = docs.join(wanted, "doc")

    def contexts(batches):
        for b in batches:
            doc, pos, left, right, done, many = [], [], [], [], [], []
            col = {n: b.column(k).to_pylist() for k, n in enumerate(b.schema.names) if n in ("doc", "text", "at")}
            for d, t, at in zip(col["doc"], col["text"], col["at"]):
                t = t.encode("utf-8")
                for x in at:
                    p = x["pos"]
                    doc.append(d)
                    pos.append(p)
                    left.append(t[max(0, p - window + 1) : p])
                    right.append(t[p : p + length])
                    done.append(x["whole"])
                    many.append(x["hot"])
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((doc, pos, left, right, done, many), kinds)], ["doc", "pos", "l", "r", "whole", "hot"])

    suffixes = texts.mapInArrow(contexts, "doc long, pos int, l binary, r binary, whole boolean, hot boolean").withColumn("lead", F.substring("r", 1, share))
    buckets = suffixes.where("not hot").drop("hot").repartitionByRange("lead").sortWithinPartitions("lead")

    def compare(batches):
        held: list[tuple] = []
        last = None

        def flush():
            n = len(held)
            l, r = np.zeros((n, window - 1), np.uint8), np.zeros((n, length), np.uint8)
            for k, (_, _, a, z, _, _) in enumerate(held):
                l[k, : len(a)] = np.frombuffer(a, np.uint8)[::-1]
                r[k, : len(z)] = np.frombuffer(z, np.uint8)
            nl, nr = (np.array([len(h[c]) for h in held]) for c in (2, 3))
            flags = repeated_starts(l, r, nl, nr, length)
            hit = flags.any(axis=1) & ~np.array([h[4] for h in held])
            # strings that start less than their length apart overlap, so each anchor covers one range
            doc, pos = (np.array([h[c] for h in held], np.int64) for c in (0, 1))
            s, e = pos - (flags.shape[1] - 1 - flags[:, ::-1].argmax(axis=1)), pos - flags.argmax(axis=1) + length
            return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(s[hit].astype(np.int32)), pa.array(e[hit].astype(np.int32))], ["doc", "s", "e"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if len(held) >= FLUSH and row[5] != last:  # buckets are sorted, so their parts are compared in turn
                    yield flush()
                    held = []
                last = row[5]
                held.append(row)
        if held:
            yield flush()

    edges = buckets.mapInArrow(compare, "doc long, s int, e int")
    if not hot.isEmpty():
        edges = edges.union(_counted(cut(suffixes.where("hot"), "contexts"), length))
    start = F.col("pos") - F.least("pos", F.lit(window - 1))
    whole = marked.where("whole").select("doc", start.alias("s"), (F.col("pos") + F.col("rest")).alias("e")).where(f"e - s >= {length}")
    return edges.union(whole)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row: ``kept`` is the bytes that remain.

    Strings are compared as UTF-8 bytes within documents and across them, never
    over a document's end; a string that repeats inside one document counts.
    Texts shorter than ``length`` keep all; a null text is empty.  Each of two
    equal rows repeats the other.  Extra columns are not read, and an empty table
    gives an empty one.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # an id names its row if it is the only one; else a hash does, and equal rows, which have equal ranges, share it
    named = src.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    src = src.withColumn("doc", F.col("doc_id") if named else F.xxhash64("doc_id", "text"))
    ranges = repeated(src, length, gram).groupBy("doc").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))

    def apply(batches):
        for b in batches:
            col = {n: b.column(k).to_pylist() for k, n in enumerate(b.schema.names) if n != "doc"}
            n_bytes, removed, spans, kept = [], [], [], []
            for t, ranges in zip(col["text"], col["ranges"]):
                t = t.encode("utf-8")
                out, at, cut_, runs, end = [], 0, 0, 0, -1
                for s, e in sorted((x["s"], x["e"]) for x in ranges or ()):
                    if s > end:
                        runs += 1
                        out.append(t[at:s])
                        cut_ += e - s
                        at = end = e
                    elif e > end:
                        cut_ += e - end
                        at = end = e
                out.append(t[at:])
                n_bytes.append(len(t))
                removed.append(cut_)
                spans.append(runs)
                kept.append(b"".join(out))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), *(pa.array(c, k) for c, k in zip((n_bytes, removed, spans, kept), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return src.join(ranges, "doc", "left").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

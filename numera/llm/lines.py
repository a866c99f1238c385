"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity; two sets of
Jaccard similarity ``t`` share a word among their first
``n - ceil(t * n) + 1`` ones, so those words index the line.  Under each word
the positional filter (what can still be shared behind it), the length filter,
and a filter on folded bit sets (differing bits cannot exceed the words not
shared) discard pairs; the rest are verified on the whole sets.  A line is
removed if any earlier line, by (document, position), matches it.

Rarity is a count per hashed word over all documents, kept in a table of fixed
size; any common order of words gives the same result, so collisions there only
cost time.  A word whose counter is one occurs once and indexes nothing.  Equal
sets are found by 128 bits of hash and their size, and of equal lines that one
task meets only the first is indexed.

Words are parted and hashed on the bytes of many texts at once.  Postings move
between tasks as packed arrays, a row for each bucket of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.llm.common import cut, drop_cut, release, run_bounds, small_batches

THRESHOLD = 0.8
#: Counters of words, and those of one slice of the table.
COUNTERS, SLICE = 1 << 20, 1 << 15
#: Neighbours by size that a line is compared with under a word; of longer lists, lines that stay unmatched go on to ``_further``.
WINDOW = 1024
#: Earlier lines that a line names under a word: so many of the likeliest; a line that all of them fail goes on, too.
NAMED = 8
BITS = 64
#: Bytes of text whose words are handled at once, bytes hashed at once, and postings packed at once.
PART, CHUNK, PACK = 1 << 18, 1 << 16, 1 << 19
#: Longer words, in bytes, are hashed one by one.
LONG = 48
#: Sets that a task remembers as indexed.
SEEN = 1 << 17
#: Postings of a bucket compared at once, and so many pairs held; words of the corpus for each bucket.
HELD, BUCKET = 1 << 21, 1 << 21
#: Postings of a bucket that a task takes at once; what meets across such parts is left to joins that Spark can split.
MOST = 1 << 22

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(11).integers(0, (1 << 64) - 1, 256, _U)
_TABLE[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C17
_LOW = _U((1 << 56) - 1)
_SHAPE = 32
#: Shapes of rows that stand for a whole set, and for a line known to repeat an earlier one.
_SET, _GONE = -1, -2
_FIELDS = {"k": np.uint32, "s": np.uint32, "doc": np.int64, "at": np.int32, "shape": np.int64, "b1": np.uint64, "b2": np.uint64}


def _powers(base: int, n: int) -> np.ndarray:
    """The powers of ``base`` from 0 to ``n - 1``, modulo 2**64."""
    out = np.ones(n, _U)
    done = 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * _U(pow(base, done, 1 << 64))
        done += m
    return out


_UP, _DOWN = _powers(_BASE, CHUNK + LONG), _powers(pow(_BASE, -1, 1 << 64), CHUNK)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``data[start:stop]``, A-Z in lower case: differences of running polynomial sums, long words by XXH3."""
    out = np.empty(len(start), _U)
    edges = np.searchsorted(start, np.arange(0, len(data) + CHUNK, CHUNK))
    for c in range(len(edges) - 1):
        a, b = edges[c], edges[c + 1]
        if a < b:
            x = data[c * CHUNK : (c + 1) * CHUNK + LONG]
            total = np.zeros(len(x) + 1, _U)
            np.cumsum(_TABLE[x] * _UP[: len(x)], out=total[1:])
            s, e = start[a:b] - c * CHUNK, np.minimum(stop[a:b] - c * CHUNK, len(x))
            out[a:b] = (total[e] - total[s]) * _DOWN[s]
    for i in np.flatnonzero(stop - start > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : stop[i]].tobytes().lower())
    return _mix(out)


def _parts(texts: pa.Array, part: int) -> Iterator[tuple]:
    """(first text, bytes, word starts, word stops, line of each word, line starts, text starts) of parts of about ``part`` bytes."""
    texts = texts.cast(pa.string())
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + part, side="right")) - 1)
        x, own = data[at[i] : at[j]], at[i:j] - at[i]
        if len(x):
            word = ~_SPACE[x]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            # texts follow each other without a gap
            inner = own[(own > 0) & (own < len(x))]
            first[inner], last[inner - 1] = word[inner], word[inner - 1]
            start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
            lines = np.union1d(np.flatnonzero(x == 10) + 1, own)
            yield i, x, start, stop, np.searchsorted(lines, start, side="right") - 1, lines, own
        i = j


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _U(COUNTERS - 1)).astype(np.int64)


def _sets(line: np.ndarray, hashes: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (line, word) once each, by line, then the rarest word first, then by hash; a word is its rarity above 56 bits of hash."""
    word = hashes & _LOW
    if count is not None:
        word |= count[_counter(hashes)].astype(_U) << _U(56)
    order = np.argsort(word)
    by = line[order]
    order = order[np.argsort(by.astype(np.uint16) if len(by) and line[-1] < 1 << 16 else by, kind="stable")]
    line, word = line[order], word[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (line[1:] != line[:-1])
    return line[new], word[new]


def rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How often words occur, added up by hashed word: ``COUNTERS`` bytes on a log scale, whatever the input, 1 standing for once; and all words.

    A task sends its table in slices.  Those of 64 tasks are added up first, then
    their sums; counts over 2**24 are rounded.
    """
    n = COUNTERS // SLICE

    def run(batches):
        total = np.zeros(COUNTERS, np.float32)
        for b in batches:
            for _, x, start, stop, *_ in _parts(b.column(0), PART):
                np.add.at(total, _counter(_hashes(x, start, stop)), np.float32(1))
        at = np.arange(0, 4 * COUNTERS + 1, 4 * SLICE, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(total)])], ["slice", "c"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1)):
                sums.setdefault(s, np.zeros(SLICE, np.float32))[:] += np.frombuffer(c.as_buffer(), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "c"])

    kind = "slice int, c binary"
    each = docs.select("text").mapInArrow(run, kind).withColumn("tasks", F.floor(F.spark_partition_id() / 64))
    some = each.repartition("slice", "tasks").select("slice", "c").mapInArrow(add, kind)
    rows = some.repartition("slice").mapInArrow(add, kind).toArrow()
    out = np.zeros(COUNTERS, np.float32)
    for s, c in zip(rows.column(0).to_pylist(), rows.column(1)):
        out[s * SLICE : (s + 1) * SLICE] = np.frombuffer(c.as_buffer(), np.float32)
    return np.where(out <= 1, out, np.clip(8 * np.log2(out + 1), 2, 255)).astype(np.uint8), int(out.sum(dtype=np.float64))


def _index(ids: np.ndarray, texts: pa.Array, threshold: float, count: np.ndarray, seen: dict, part: int, most: int) -> Iterator[tuple]:
    """(bucket hash, fields) of the rows of ``texts``: a row of shape _SET for every line with words, or _GONE, and a posting for every word of a prefix.

    Of equal sets only lines before those in ``seen``, which holds at ``most`` so many, are posted; a later one is _GONE.
    """
    for base, x, start, stop, line, lines, own_texts in _parts(texts, part):
        line, word = _sets(line, _hashes(x, start, stop), count)
        if not len(line):
            continue
        at = run_bounds(line)
        own, n, at = line[at[:-1]], np.diff(at), at[:-1]
        mixed = _mix(word)
        s1, s2 = np.add.reduceat(mixed, at), np.add.reduceat(_mix(mixed + _U(77)), at)
        one = _U(1) << (word & _U(BITS - 1))
        high = (word >> _U(6)) & _U(1) != 0
        b1, b2 = (np.bitwise_xor.reduceat(np.where(h, one, _U(0)), at) for h in (~high, high))
        small = n <= BITS
        b1, b2 = np.where(small, b1 ^ b2, b1), np.where(small, _U(0), b2)
        text = np.searchsorted(own_texts, lines[own], side="right") - 1
        doc, num = ids[base + text], own - np.searchsorted(lines, own_texts)[text]
        gone = np.zeros(len(own), bool)
        for i, (key, place) in enumerate(zip(zip(s1.tolist(), s2.tolist()), zip(doc.tolist(), num.tolist()))):
            before = seen.get(key)
            if before is not None and before < place:
                gone[i] = True
            else:
                if len(seen) >= most:
                    seen.clear()
                seen[key] = place
        # of fewer words than this, one more or less is already too many: they only match equal sets
        prefix = np.where(~gone & (n >= threshold / (1 - threshold) - 1e-9), n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0)
        of = np.repeat(np.arange(len(own)), prefix)
        pos = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        k = word[at[of] + pos]
        often = k >> _U(56) > 1
        k, of, pos = _mix(k[often]), of[often], pos[often]
        two = lambda a, b: np.concatenate([a, b])
        # the bucket is dealt by the high half of a hash, of which the low half is the key within the bucket
        yield two(s1, k) >> _U(32), (
            two(s1, k).astype(np.uint32), two(s2 >> _U(32), s1[of]).astype(np.uint32), two(doc, doc[of]), two(num, num[of]).astype(np.int32),
            two(np.where(gone, _GONE, _SET), n[of] << _SHAPE | pos), two(s1, b1[of]), two(s2, b2[of]),
        )


def _planes(x: np.ndarray) -> bytes:
    """All lowest bytes, then the next ones, and so on: small numbers leave planes of zeros, which shuffles compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _values(planes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def postings(docs: DataFrame, threshold: float, counts, buckets: int) -> DataFrame:
    """The rows of ``_index`` of ``docs`` (doc, text), packed: (bucket, and every field as the bytes of an array); ``counts`` is the broadcast of ``rarity``."""

    def run(batches):
        count, seen = counts.value, {}
        held: list[tuple] = []

        def pack():
            high = np.concatenate([h for h, _ in held])
            bucket = (high % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            edges = run_bounds(bucket[order])
            cols = []
            for k, kind in enumerate(_FIELDS.values()):
                flat = np.concatenate([c[k] for _, c in held]).astype(kind)[order]
                cols.append(pa.array([_planes(flat[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][edges[:-1]]), *cols], ["bucket", *_FIELDS])

        size = 0
        for b in batches:
            for high, cols in _index(b.column(0).to_numpy(), b.column(1), threshold, count, seen, PART, SEEN):
                held.append((high, cols))
                size += len(high)
                if size >= PACK:
                    yield pack()
                    size = 0
        if held:
            yield pack()

    return docs.select("doc", "text").mapInArrow(run, "bucket int, " + ", ".join(f"{f} binary" for f in _FIELDS))


def _chunks(batches, most: int) -> Iterator[tuple[int, list[np.ndarray], bool]]:
    """(bucket, fields, whether the bucket comes in several parts) from packed rows sorted by bucket."""

    def fields():
        return [np.concatenate([_values(b.column(f)[r].as_buffer(), kind) for b, r in held]) for f, kind in _FIELDS.items()]

    held: list[tuple[pa.RecordBatch, int]] = []
    size, bucket, parted = 0, -1, False
    for b in batches:
        for r, (k, n) in enumerate(zip(b.column("bucket").to_pylist(), pc.binary_length(b.column("k")).to_pylist())):
            if held and (k != bucket or size + n // 4 > most):
                parted |= k == bucket
                yield bucket, fields(), parted
                parted &= k == bucket
                held, size = [], 0
            bucket, size = k, size + n // 4
            held.append((b, r))
    if held:
        yield bucket, fields(), parted


def _passes(n, pos, b1, b2, i, j, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs i, j: whether the length, positional and bit filters leave them, and the bits that differ."""
    a, b = n[i], n[j]
    need = np.ceil(t / (1 + t) * (a + b) - 1e-9)
    ok = (np.minimum(a, b) >= t * np.maximum(a, b) - 1e-9) & (np.minimum(a - pos[i], b - pos[j]) >= need)
    x, y = b1[i] ^ b1[j], b2[i] ^ b2[j]
    wide = np.minimum(a, b) > BITS
    differ = np.where(wide, np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y), np.bitwise_count(x ^ y))
    return ok & (differ <= a + b - 2 * need), differ


def _likeliest(named: int, later: np.ndarray, earlier: np.ndarray, differ: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every ``later``, the ``named`` pairs that differ least, and whether it has had others."""
    order = np.lexsort((earlier, differ, later))
    later, earlier, differ, more = later[order], earlier[order], differ[order], more[order]
    edges = run_bounds(later)
    size = np.diff(edges)
    more = np.repeat(np.logical_or.reduceat(more, edges[:-1]) | (size > named), size)
    keep = np.arange(len(later)) - np.repeat(edges[:-1], size) < named
    return later[keep], earlier[keep], differ[keep], more[keep]


def _named(k, doc, at, n, pos, b1, b2, t: float, window: int, named: int, held: int) -> tuple[np.ndarray, ...]:
    """(later, earlier, differing bits, open): for every line the ``named`` likeliest pairs under a word, and the lines that may have further ones.

    Rows come sorted by (k, n); pairs are rows at most ``window`` apart, of which
    about ``held`` are held at once.
    """
    x = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    act = np.arange(1, len(k))
    found: list[tuple] = []
    size = 0
    for d in range(1, window + 1):
        act = act[act >= d]
        act = act[(k[act - d] == k[act]) & (n[act - d] >= t * n[act] - 1e-9)]
        if not len(act):
            break
        ok, differ = _passes(n, pos, b1, b2, act, act - d, t)
        i, differ = act[ok], differ[ok]
        j = i - d
        swap = (doc[j] > doc[i]) | ((doc[j] == doc[i]) & (at[j] > at[i]))
        found.append((np.where(swap, j, i), np.where(swap, i, j), differ.astype(np.int64), np.zeros(len(i), bool)))
        size += len(i)
        if size > held:
            x = list(_likeliest(named, *(np.concatenate([a, *b]) for a, b in zip(x, zip(*found)))))
            found, size = [], 0
    if found:
        x = list(_likeliest(named, *(np.concatenate([a, *b]) for a, b in zip(x, zip(*found)))))
    later, earlier, differ, more = x
    # of lists with rows further apart, all lines may have further ones
    rest = act[act > window]
    far = np.unique(k[rest[(k[rest - window - 1] == k[rest]) & (n[rest - window - 1] >= t * n[rest] - 1e-9)]])
    return later, earlier, differ, np.union1d(later[more], np.flatnonzero(np.isin(k, far)))


def candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """(kind, doc, at, ...) from packed postings, by kind.

    Line (doc, at) repeats an earlier line (0); it may match the earlier line
    (doc2, at2), their bits differing by ``differ`` (1); it may match further
    ones (2).  Every posting (k, shape, b1, b2) under a word where some line may
    (3), and in a bucket of several parts the first line of every set (b1, b2) of
    a part (4).
    """
    columns = {"doc2": pa.int64(), "at2": pa.int32(), "differ": pa.int32(), "k": pa.int64(), "shape": pa.int64(), "b1": pa.int64(), "b2": pa.int64()}

    def batch(kind, doc, at, **more):
        cols = [pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc), pa.array(at)]
        for c, t in columns.items():
            cols.append(pa.array(more[c].astype(t.to_pandas_dtype())) if c in more else pa.nulls(len(doc), t))
        return pa.RecordBatch.from_arrays(cols, ["kind", "doc", "at", *columns])

    def run(batches):
        for bucket, (k, s, doc, at, shape, b1, b2), parted in _chunks(batches, MOST):
            x = np.flatnonzero(shape == _GONE)
            yield batch(0, doc[x], at[x])
            x = np.flatnonzero(shape == _SET)
            x = x[np.lexsort((at[x], doc[x], b2[x], b1[x]))]
            again = np.zeros(len(x), bool)
            again[1:] = (b1[x[1:]] == b1[x[:-1]]) & (b2[x[1:]] == b2[x[:-1]])
            yield batch(0, doc[x[again]], at[x[again]])
            if parted:
                y = x[~again]
                yield batch(4, doc[y], at[y], b1=b1[y].view(np.int64), b2=b2[y].view(np.int64))
            x = np.flatnonzero(shape >= 0)
            x = x[np.argsort(k[x].astype(_U) << _U(32) | np.minimum(shape[x] >> _SHAPE, 4095).astype(_U) << _U(20) | (s[x] & np.uint32(0xFFFFF)))]
            # one row for each set under a word, its first line
            new = np.ones(len(x), bool)
            for c in (k, s, shape, b1, b2):
                new[1:] &= c[x[1:]] == c[x[:-1]]
            new[1:] = ~new[1:]
            group = np.cumsum(new) - 1
            several = np.flatnonzero(np.bincount(group)[group] > 1) if len(x) else group
            x[several] = x[several][np.lexsort((at[x[several]], doc[x[several]], group[several]))]
            x = x[new]
            if parted:
                yield batch(2, doc[x], at[x])
                yield batch(3, doc[x], at[x], k=k[x] | np.int64(bucket) << 32, shape=shape[x], b1=b1[x].view(np.int64), b2=b2[x].view(np.int64))
            size = np.diff(run_bounds(k[x]))
            x = x[np.repeat(size > 1, size)]
            # rows of over 4095 words are not yet in order
            if len(x) and (shape[x] >> _SHAPE).max() >= 4095:
                x = x[np.lexsort((shape[x] >> _SHAPE, k[x]))]
            edges = run_bounds(k[x])
            i = 0
            while i < len(edges) - 1:  # whole lists, HELD postings at once
                j = max(i + 1, int(np.searchsorted(edges, edges[i] + HELD, side="right")) - 1)
                y = x[edges[i] : edges[j]]
                later, earlier, differ, more = _named(k[y], doc[y], at[y], shape[y] >> _SHAPE, shape[y] & 0xFFFFFFFF, b1[y], b2[y], threshold, WINDOW, NAMED, HELD)
                yield batch(1, doc[y[later]], at[y[later]], doc2=doc[y[earlier]], at2=at[y[earlier]], differ=differ)
                i = j
                if parted:  # all of them have gone there
                    continue
                yield batch(2, doc[y[more]], at[y[more]])
                z = y[np.isin(k[y], k[y[more]])]
                yield batch(3, doc[z], at[z], k=k[z] | np.int64(bucket) << 32, shape=shape[z], b1=b1[z].view(np.int64), b2=b2[z].view(np.int64))

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "kind int, doc long, at int, doc2 long, at2 int, differ int, k long, shape long, b1 long, b2 long")


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, at, words): the hashed word sets of the lines ``wanted`` (doc, ats)."""

    def run(batches):
        for b in small_batches(batches, 1):
            ids = b.column(0).to_pylist()
            out_doc, out_at, texts = [], [], []
            for d, t, ats in zip(ids, b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = t.split("\n")
                for a in ats:
                    out_doc.append(d)
                    out_at.append(a)
                    texts.append(lines[a])
            size, words = np.zeros(len(texts), np.int64), [np.zeros(0, _U)]
            for base, x, start, stop, line, starts, own in _parts(pa.array(texts, pa.string()), PART):
                line, word = _sets(np.searchsorted(own, starts, side="right")[line] - 1, _hashes(x, start, stop))
                size[base : base + len(own)] += np.bincount(line, minlength=len(own))
                words.append(word)
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(words).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_at, pa.int32()), lists], ["doc", "at", "words"])

    return docs.join(wanted, "doc").select("doc", "text", "ats").mapInArrow(run, "doc long, at int, words array<long>")


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, at): lines with an earlier match; ``docs`` has (doc, text), doc unique and ordering the documents."""
    if not 0.5 < threshold < 1:
        raise ValueError("the threshold lies between 0.5 and 1")
    spark = docs.sparkSession
    count, words = rarity(docs)
    counts = spark.sparkContext.broadcast(count)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // BUCKET)
    found = cut(candidates(postings(docs, threshold, counts, buckets), threshold), "lines")
    release(spark)
    exact = found.where("kind = 0").select("doc", "at")
    parted = found.where("kind = 4").select("doc", "at", "b1", "b2")
    if not parted.isEmpty():
        first = parted.groupBy("b1", "b2").agg(F.min(F.struct("doc", "at")).alias("x"))
        exact = exact.union(parted.join(first, ["b1", "b2"]).where(F.struct("doc", "at") != F.col("x")).select("doc", "at"))
    asked = found.where("kind = 1")
    ends = asked.select("doc", "at").union(asked.select("doc2", "at2")).union(found.where("kind = 3").select("doc", "at"))
    sets = cut(line_sets(docs, ends.groupBy("doc").agg(F.collect_set("at").alias("ats"))), "sets")
    # the likeliest earlier line of each first, then all others of the lines that it fails
    first = asked.groupBy("doc", "at").agg(F.min(F.struct("differ", "doc2", "at2")).alias("x")).select("doc", "at", "x.doc2", "x.at2")
    matched = cut(_matched(sets, first, threshold).union(exact).distinct(), "removed")
    release(spark)
    others = asked.join(matched, ["doc", "at"], "left_anti").select("doc", "at", "doc2", "at2").distinct()
    matched = matched.union(cut(_matched(sets, others, threshold).distinct(), "removed"))
    # lines whose named lines all failed, and that had further ones
    open_ = found.where("kind = 2").select("doc", "at").distinct().join(matched, ["doc", "at"], "left_anti")
    if not open_.isEmpty():
        matched = matched.union(cut(_matched(sets, _further(found.where("kind = 3"), open_, threshold), threshold).distinct(), "removed"))
    for done in (sets, found):
        drop_cut(done)
    release(spark)
    counts.unpersist()
    return matched.distinct()


def _matched(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(doc, at) of the ``pairs`` (doc, at, doc2, at2) whose whole ``sets`` match."""
    # the set of the earlier line first, then that of the later one
    shared = F.size(F.array_intersect("words", "words2"))
    return (
        pairs.join(sets.select(F.col("doc").alias("doc2"), F.col("at").alias("at2"), F.col("words").alias("words2")), ["doc2", "at2"])
        .join(sets, ["doc", "at"])
        .where(shared >= threshold * (F.size("words") + F.size("words2") - shared) - 1e-9)
        .select("doc", "at")
    )


def _further(rows: DataFrame, open_: DataFrame, threshold: float) -> DataFrame:
    """(doc, at, doc2, at2): all pairs of the lines ``open_`` with earlier ones that the filters leave under the words of the postings ``rows``."""
    n, p = (lambda c: F.shiftright(c, _SHAPE)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    side = lambda d, e: d.select("k", *(F.col(c).alias(c + e) for c in ("doc", "at", "b1", "b2")), n("shape").alias("n" + e), p("shape").alias("p" + e))
    x, y = side(rows.join(open_, ["doc", "at"], "left_semi"), ""), side(rows, "2")
    need = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("n2")) - 1e-9)
    d1, d2 = F.col("b1").bitwiseXOR(F.col("b12")), F.col("b2").bitwiseXOR(F.col("b22"))
    differ = F.when(F.least("n", "n2") > BITS, F.bit_count(d1) + F.bit_count(d2)).otherwise(F.bit_count(d1.bitwiseXOR(d2)))
    return (
        x.join(y, "k")
        .where((F.col("doc2") < F.col("doc")) | ((F.col("doc2") == F.col("doc")) & (F.col("at2") < F.col("at"))))
        .where(F.least("n", "n2") >= threshold * F.greatest("n", "n2") - 1e-9)
        .where(F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")) >= need)
        .where(differ <= F.col("n") + F.col("n2") - 2 * need)
        .select("doc", "at", "doc2", "at2")
        .distinct()
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, every_row: bool = False) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): every document without the lines an earlier line matches.

    Lines are parted by newline and ordered by document id, then position; an
    earlier line counts whether or not it is itself removed.  Words are parted
    at ASCII white space, A-Z in lower case; a line without words matches
    nothing and stays.  A null text stays null and has no lines.  With
    ``every_row``, rows repeated under one id are documents of their own, ordered
    by a hash of their texts, and rows without an id come last; otherwise ids
    must be unique, and of such rows none is touched.  Extra columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    src, unique = _rows(src.select("doc", "text", F.col("doc").alias("id")), every_row)
    out = _without(src, _gone(src.select("doc", "text"), threshold, unique), "n_lines long, n_removed long")
    return out.select(F.col("id").alias("doc_id"), "text", "n_lines", "n_removed")


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, every_row: bool = False) -> DataFrame:
    """``docs`` with ``text_col`` as ``dedup`` leaves it; all columns and rows stay."""
    others = F.struct(*(F.col(c) for c in docs.columns if c != text_col))
    whole = docs.select(others.alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    whole, unique = _rows(whole, every_row)
    out = _without(whole, _gone(whole.select("doc", "text"), threshold, unique), "n_lines long, n_removed long")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def _rows(src: DataFrame, every_row: bool) -> tuple[DataFrame, bool]:
    """``src``, and whether ``doc`` is known to name each row.

    For ``every_row``, where ids repeat or are missing, ``doc`` becomes a written
    row number over id (nulls last), text hash and occurrence.
    """
    if not every_row:
        return src, False
    if src.groupBy("doc").count().where("count > 1 or doc is null").isEmpty():
        return src, True
    order = [F.col("doc").asc_nulls_last(), F.col("__h").asc(), F.col("__i").asc()]
    spread = src.withColumns({"__h": F.xxhash64("text"), "__i": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    # partitions are in order, and so are the numbers: partition, then place in it
    return cut(spread.withColumn("doc", F.monotonically_increasing_id()).drop("__h", "__i"), "rows"), True


def _gone(src: DataFrame, threshold: float, unique: bool = False) -> DataFrame:
    """(doc, ats): the line numbers to remove of each document that has some."""
    usable = src.where("doc is not null and text is not null")
    if not unique:
        twice = src.groupBy("doc").count().where("count > 1 and doc is not null").select(F.col("doc").alias("d"))
        if not twice.isEmpty():
            usable = usable.join(twice, F.col("doc") == F.col("d"), "left_anti")
    return removed_lines(usable, threshold).groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias("ats"))


def _without(src: DataFrame, gone: DataFrame, more: str) -> DataFrame:
    """``src`` (doc, text, ...) with the lines of ``gone`` taken out of text, and (n_lines, n_removed) appended."""
    names = src.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)

    def run(batches):
        for b in small_batches(batches, names.index("text")):
            text, n, cut_ = [], [], []
            for t, ats in zip(b.column(names.index("text")).to_pylist(), b.column(len(names)).to_pylist()):
                drop = frozenset(ats or ())
                text.append(t if not drop else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop))
                n.append(0 if t is None else t.count("\n") + 1)
                cut_.append(len(drop))
            cols = [pa.array(text, pa.string()) if c == "text" else b.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(cut_, pa.int64())], [*names, "n_lines", "n_removed"])

    joined = src.join(gone, "doc", "left").select(*names, "ats")
    return joined.mapInArrow(run, f"{kinds}, {more}")

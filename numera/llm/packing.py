"""Best-fit packing of token sequences by exact-complement hashing.

Packing depends on lengths alone, and there are at most ``capacity`` of them.
The driver packs the histogram of lengths, the longest first: an index by sum
gives a single length, a pair or a triple that fills the gap exactly, which is
consumed as often as the counts allow; where no combination is left, the
longest length that fits goes in and the smaller gap is looked up again.  A
step handles all sequences of one pattern at once, so the plan has at most a
few thousand patterns however many documents there are.  Executors number the
pieces of each length and look their places up in the plan.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numera.llm.bpe import units
from numera.llm.common import cut, small_batches

CAPACITY = 2048
END = 0
#: Units remembered, and units encoded at once.
MEMO, MANY = 200_000, 1000
#: Units that are empty or end in white space.
_ENDS = r"^$|[\s\x0b\x1c-\x1f\x{85}\p{Z}]$"
#: Texts in which a space follows white space.
_RUNS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] |^ "


@dataclass
class Plan:
    """Patterns of lengths and how many sequences follow each."""

    capacity: int
    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(m for _, m in self.patterns)

    def runs(self) -> np.ndarray:
        """Rows (length, first ordinal, first sequence, offset), sorted; ordinals follow on within a length."""
        at: dict[int, int] = {}
        out, base = [], 0
        for lengths, m in self.patterns:
            offset = 0
            for n in lengths:
                s = at.get(n, 0)
                out.append((n, s, base, offset))
                at[n] = s + m
                offset += n
            base += m
        out.sort()
        return np.array(out, np.int64).reshape(-1, 4)


class Sums:
    """Index of lengths, pairs and triples by their sum, under the counts ``avail``, which only go down.

    An entry holds the combination last found for a sum, of lengths as even as
    they come, so that short ones are left for small gaps; it is sought anew once
    a part has run out, and a sum without any never has one again.
    """

    def __init__(self, avail: np.ndarray):
        self.avail = avail
        self.held: dict[tuple[int, int], tuple[int, ...] | None] = {}

    def most(self, parts: tuple[int, ...]) -> int:
        """How often the counts allow ``parts``."""
        return min(int(self.avail[n]) // parts.count(n) for n in parts)

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """Up to three lengths of sum ``gap``, the fewest first."""
        for size, seek in ((1, self._single), (2, self._pair), (3, self._triple)):
            parts = self.held.get((size, gap), ())
            if parts == () or parts and not self.most(parts):
                parts = self.held[size, gap] = seek(gap)
            if parts:
                return parts
        return None

    def _single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.avail[gap] else None

    def _pair(self, gap: int, most: int | None = None) -> tuple[int, ...] | None:
        """Lengths a >= b of sum ``gap``, a at most ``most``."""
        a = np.arange((gap + 1) // 2, min(gap - 1, most or gap) + 1)
        ok = (self.avail[a] > 0) & (self.avail[gap - a] > (2 * a == gap))
        return (x := int(a[ok.argmax()]), gap - x) if ok.any() else None

    def _triple(self, gap: int) -> tuple[int, ...] | None:
        for a in range(-(-gap // 3), gap - 1):
            if self.avail[a]:
                self.avail[a] -= 1
                pair = self._pair(gap - a, a)
                self.avail[a] += 1
                if pair:
                    return (a, *pair)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``counts`` pieces of each length into sequences of ``capacity``."""
    avail = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} is not within 1 and {capacity}")
        avail[n] += c
    out, sums = Plan(capacity), Sums(avail)
    for n in range(capacity, 0, -1):
        while avail[n]:
            # of lengths that go several to a sequence, some are left to fill up the others
            m = int(avail[n]) if 2 * n > capacity else -(-int(avail[n]) // (capacity // n))
            avail[n] -= m
            states = [((n,), m)]
            while states:
                lengths, m = states.pop()
                gap = capacity - sum(lengths)
                parts = sums.filling(gap) if gap else None
                if gap and not parts:
                    fits = np.flatnonzero(avail[: gap + 1])
                    parts = (int(fits[-1]),) if len(fits) else None
                if not parts:
                    out.patterns.append((lengths, m))
                    continue
                some = min(m, sums.most(parts))
                for x in parts:
                    avail[x] -= some
                if some < m:
                    states.append((lengths, m - some))
                states.append((lengths + parts, some))
    return out


@dataclass
class Units:
    """Distinct units and their ids: those of unit i are ``ids[start[i] : start[i] + size[i]]``."""

    units: pa.Array
    ids: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def joined(parts: list[Units]) -> Units:
        size = np.concatenate([p.size for p in parts])
        first = np.cumsum([0, *(len(p.ids) for p in parts[:-1])])
        start = np.concatenate([p.start + at for p, at in zip(parts, first)])
        return Units(pa.concat_arrays([p.units for p in parts]), np.concatenate([p.ids for p in parts]), start, size)

    def take(self, rows: np.ndarray) -> Units:
        size = self.size[rows]
        return Units(self.units.take(pa.array(rows)), self.ids[_spread(self.start[rows], size)], np.cumsum(size) - size, size)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every range, one after another."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


class Encoder:
    """The ids of texts by a byte-level BPE of the ``tokenizers`` library.

    Texts are cut into units (``bpe.units``), each distinct one is encoded once,
    and those that come again are remembered.  New ones are encoded many at
    once, in one string, whose ids are parted again by the bytes they stand for.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # the library finds added tokens before it cuts a text: texts that hold one go to it whole, the others are encoded in parts
        self.whole = Tokenizer.from_str(vocabulary)
        self.added = sorted(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.tok = Tokenizer.from_str(vocabulary)
        self.tok.encode_special_tokens = True
        names = self.tok.get_vocab()
        self.size = np.zeros(max(names.values()) + 1, np.int64)
        self.size[list(names.values())] = [len(x) for x in names]  # a character stands for a byte
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.known = Units(pa.array([], pa.string()), np.zeros(0, "<u4"), none, none)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _each(self, every: pa.Array, space: str) -> Units:
        """Units with ``space`` before them, one by one."""
        ids = [self._ids(space + u) for u in every.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return Units(every, np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum(size) - size, size)

    def _together(self, some: pa.Array) -> Units:
        """Units with a space before them, none of which ends in white space."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")
        ids = self._ids(" " + joined[0].as_py())
        want = np.cumsum(pc.binary_length(some).to_numpy() + 1)
        ends = np.cumsum(self.size[ids])
        at = np.minimum(np.searchsorted(ends, want), len(ends) - 1) + 1
        if (ends[at - 1] != want).any() or at[-1] != len(ids):  # not parted as expected
            return self._each(some, " ")
        size = np.diff(at, prepend=0)
        return Units(some, ids, at - size, size)

    def spaced(self, every: pa.Array, count: np.ndarray) -> tuple[Units, np.ndarray]:
        """A table of units with a space before them, and the rows of the distinct ``every`` in it, which occur ``count`` times."""
        row = pc.index_in(every, value_set=self.known.units).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(row < 0)
        odd = pc.match_substring_regex(every.take(pa.array(new)), _ENDS).to_numpy(zero_copy_only=False)
        plain, rest = (every.take(pa.array(x)) for x in (new[~odd], new[odd]))
        parts = [self.known, *(self._together(plain.slice(i, MANY)) for i in range(0, len(plain), MANY)), self._each(rest, " ")]
        row[new[~odd]] = len(self.known.units) + np.arange(len(plain))
        row[new[odd]] = len(self.known.units) + len(plain) + np.arange(len(rest))
        table = Units.joined(parts)
        often = np.flatnonzero((count > 1) & (pc.binary_length(every).to_numpy() < 64))
        keep = np.union1d(np.arange(len(self.known.units)), row[often])
        if len(keep) > MEMO:  # those of these texts, the frequent ones first
            keep = row[often[np.argsort(-count[often], kind="stable")[:MEMO]]]
        self.known = table.take(keep)
        return table, row

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, END behind each; where those of each begin, and the end of all); a null text is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        holds = np.zeros(len(texts), bool)
        for name in self.added:
            holds |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        ids, at = self._plain(texts.filter(pa.array(~holds)))
        if not holds.any():
            return ids, at
        parts, k = [], 0
        for i in range(len(texts)):
            if holds[i]:
                found = self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids
                parts.append(np.array([*found, END], "<u4"))
            else:
                parts.append(ids[at[k] : at[k + 1]])
                k += 1
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts, none null, without strings of added tokens."""
        if pc.any(pc.match_substring_regex(texts, _RUNS)).as_py():
            lists = pa.array([units(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(texts, " ")
        n = lists.value_lengths().to_numpy()
        at = np.concatenate([[0], np.cumsum(n)])
        flat = lists.flatten()
        first = np.zeros(len(flat), bool)
        first[at[:-1]] = True
        coded = flat.filter(pa.array(~first)).dictionary_encode()
        code = coded.indices.to_numpy()
        table, row = self.spaced(coded.dictionary, np.bincount(code, minlength=len(coded.dictionary)))
        end = Units(pa.array([""]), np.array([END], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64))
        heads = self._each(flat.filter(pa.array(first)), "")  # no space before them
        table = Units.joined([table, heads, end])
        # the units of a text: the first, the others, the end
        every = np.full(len(flat) + len(n), len(table.units) - 1)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)
        every[place[first]] = len(table.units) - 1 - len(n) + np.arange(len(n))
        every[place[~first]] = row[code]
        size = table.size[every]
        stop = np.cumsum(size)
        return table.ids[_spread(table.start[every], size)], np.concatenate([[0], stop[at[1:] + np.arange(len(n))]])


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    """One encoder per Python worker."""
    key = zlib.crc32(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary.decode("utf-8"))
    return _encoders[key]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): token pieces of at most ``capacity``, the end id included."""
    with open(vocabulary, "rb") as f:
        # a fixed vocabulary file, under 2 MB: the broadcast doesn't grow with the documents
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = _encoder(data.value)
        for b in small_batches(batches, 1, 16 << 20):
            out: list[tuple] = []
            ids, at = encoder.encode(b.column(1))
            every = memoryview(ids.tobytes())
            for doc, a, z in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                ids, n = every[4 * a : 4 * z], z - a
                first = (n - 1) % capacity + 1
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    out.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, bucket: int = 20_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    A document is its ids and the end id 0; a null text is empty, so a document
    has one piece at least.  Longer documents are cut into pieces of
    ``capacity``, the first of which may be shorter.  Repeated ids keep all
    their rows; an empty table gives an empty result.  Extra columns are not read.
    """
    # rows are spread by a number of their own: one id or one text may hold any part of them
    cutted = cut(pieces(docs, vocabulary, id_col, text_col, capacity).withColumn("spread", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    # at most ``capacity`` rows
    counts = {r[0]: r[1] for r in cutted.groupBy("length").count().collect()}
    runs = plan(counts, capacity).runs()
    total = sum(counts.values())
    b = F.pmod("spread", F.lit(max(1, -(-total // bucket)))).alias("b")
    sized = cutted.groupBy("length", b).agg(F.count(F.lit(1)).alias("c"))
    before = sized.select("length", "b", (F.sum("c").over(Window.partitionBy("length").orderBy("b")) - F.col("c")).alias("before"))
    numbered = (
        cutted.withColumn("b", b)
        .withColumn("k", F.row_number().over(Window.partitionBy("length", "b").orderBy("spread")) - 1)
        .join(before, ["length", "b"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("ordinal"))
    )
    key = runs[:, 0] << 44 | runs[:, 1] if len(runs) else np.zeros(0, np.int64)
    # rows bounded by the patterns of the plan, a function of the capacity
    shared = docs.sparkSession.sparkContext.broadcast((key, runs))

    def place(batches):
        key, runs = shared.value
        for x in batches:
            n = x.column(3).to_numpy()
            o = x.column(5).to_numpy()
            at = np.searchsorted(key, n << 44 | o, side="right") - 1
            seq = runs[at, 2] + o - runs[at, 1]
            yield pa.RecordBatch.from_arrays([*x.columns[:5], pa.array(seq), pa.array(runs[at, 3])], [*x.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

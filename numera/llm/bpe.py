"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 400_000


class PerfectHash:
    """A minimal perfect hash over byte strings by hash and displace.

    Keys fall into buckets by a first hash; buckets, the largest first, look for
    a displacement that sends all their keys to free slots.  A lookup hashes the
    key once, adds its bucket's displacement, and compares the key in the slot.
    """

    def __init__(self, keys: list[bytes], seed: int = 7):
        n = max(1, len(keys))
        self.n, self.buckets = n, max(1, n // 3)
        while True:
            try:
                self._build(keys, seed)
                return
            except OverflowError:
                seed += 1

    def _build(self, keys: list[bytes], seed: int) -> None:
        n, nb = self.n, self.buckets
        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, seed) for k in keys) or b"", np.uint64).reshape(-1, 2)
        bucket = (h[:, 0] % np.uint64(nb)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        start = np.searchsorted(bucket[order], np.arange(nb + 1))
        taken, disp, slot_of = np.zeros(n, bool), np.zeros(nb, np.uint32), np.zeros(len(keys), np.int64)
        base, step = h[:, 0] >> np.uint64(20), h[:, 1] | np.uint64(1)
        for b in np.argsort(-(start[1:] - start[:-1]), kind="stable"):
            own = order[start[b] : start[b + 1]]
            if not len(own):
                break
            a, c = base[own], step[own] % np.uint64(n)
            d0 = 0
            while True:
                d = np.arange(d0, d0 + 256, dtype=np.uint64)[:, None]
                slots = (a[None, :] + d * c[None, :] + d // np.uint64(n)) % np.uint64(n)
                good = ~taken[slots].any(axis=1)
                if len(own) > 1:
                    srt = np.sort(slots, axis=1)
                    good &= (srt[:, 1:] != srt[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if len(hit):
                    disp[b] = d0 + hit[0]
                    slot_of[own] = slots[hit[0]]
                    taken[slot_of[own]] = True
                    break
                d0 += 256
                if d0 > 64 * n + 65536:
                    raise OverflowError("no displacement; another seed is tried")
        self.seed, self.disp = seed, disp.tolist()
        self.key: list[bytes | None] = [None] * n
        self.value = [0] * n
        for i, s in enumerate(slot_of.tolist()):
            self.key[s], self.value[s] = keys[i], i

    def get(self, key: bytes) -> int:
        """The index of ``key`` in the list given, or -1."""
        h = int.from_bytes(xxhash.xxh3_128_digest(key, self.seed), "little")
        low, high = h & 0xFFFFFFFFFFFFFFFF, h >> 64
        n = self.n
        d = self.disp[low % self.buckets]
        s = ((low >> 20) + d * ((high | 1) % n) + d // n) % n
        return self.value[s] if self.key[s] == key else -1


class Memo(dict):
    """Ids of " " + word for words met before.

    Holds the words met since it was last full, and behind them those of the
    round before, from which a word met again comes back.  So its memory is
    bounded and frequent words stay.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.encode(" " + word)
        if len(word) < 64:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


#: The pattern whose matches hold white space only in front or throughout; a fixed value.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that follows white space: there the pattern may take it into a run.
_RUN = re.compile(r"\s ")


def units(text: str) -> list[str]:
    """``text`` cut at spaces that start a match of ``SPACED``, these spaces left out.

    A space that follows anything but white space always does, as matches hold
    white space only in front or throughout.  So a text is encoded as its units,
    each but the first with its space.
    """
    words = text.split(" ")
    if _RUN.search(text) or text[:1] == " ":
        joined, run = [], []
        for w in words:
            run.append(w)
            if w and not w[-1].isspace():
                joined.append(" ".join(run))
                run = []
        words = joined + ([" ".join(run)] if run else [])
    return words


def encode_by_words(text: str, memo: Memo) -> bytes:
    """Encode ``text`` unit by unit through ``memo``."""
    words = units(text)
    first = memo.encode(words[0])  # no space before it
    return b"".join([first, *map(memo.__getitem__, words[1:])])


class Tokenizer:
    """Encodes and decodes by the ranks of a vocabulary; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ids = list(ranks.values())
        self.hash = PerfectHash(list(ranks))
        self.token = {i: t for t, i in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.ranks = ranks
        self.memo = Memo(lambda p: array("I", self.pieces(p)).tobytes())

    def whole(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        i = self.hash.get(piece)
        return [self.ids[i]] if i >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest ranks first, the leftmost of equals, over linked symbols."""
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # where the symbol that starts here ends; 0 once it is part of another
        prv = list(range(-1, n - 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = end[i]
            if not j or j >= n:
                continue
            e = end[j]
            if get(piece[i:e]) != top >> 40:
                continue  # a neighbour has changed since
            end[i], end[j] = e, 0
            if e < n:
                prv[e] = i
                if (r := get(piece[i : end[e]])) is not None:
                    heappush(heap, r << 40 | i)
            h = prv[i]
            if h >= 0 and (r := get(piece[h:e])) is not None:
                heappush(heap, r << 40 | h)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def pieces(self, text: str) -> list[int]:
        """Ids of a text, every match of the pattern by itself."""
        if self.pattern.pattern == SPACED and text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.whole(text.encode())  # letters are one match
        return [i for p in self.pattern.findall(text) for i in self.whole(p.encode("utf-8"))]

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as native unsigned 32-bit integers; no special tokens."""
        return encode_by_words(text, self.memo) if self.pattern.pattern == SPACED else self.memo.encode(text)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_made: dict[str, Tokenizer] = {}


def shared_tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    """One tokenizer per Python worker and vocabulary; ``ranks`` is the file's content."""
    key = hashlib.sha256(ranks).hexdigest() + pattern
    if key not in _made:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _made[key] = Tokenizer(table, pattern)
    return _made[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text; a null text is empty and has none.

    Repeated rows and ids keep their rows, equal texts give equal results, extra
    columns are not read whatever their names, and an empty table gives an empty one.
    """
    return _apply(docs, vocabulary, pattern, id_col, text_col, False)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode`` and ``decode`` without moving the ids.

    A null text is empty.
    Repeated rows and ids keep their rows, equal texts give equal results, extra
    columns are not read whatever their names, and an empty table gives an empty one.
    """
    return _apply(docs, vocabulary, pattern, id_col, text_col, True)


def decode(ids: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes of each id list; a null list is empty.

    Repeated rows and ids keep their rows, extra columns are not read, and an
    empty table gives an empty one.
    """
    spark = ids.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches):
        tok = shared_tokenizer(ranks.value, pattern)
        for b in batches:
            out = pa.array([tok.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["doc_id", "bytes"])

    return ids.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def _apply(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    with open(vocabulary, "rb") as f:
        # a fixed vocabulary file, under 2 MB: the broadcast doesn't grow with the documents
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        tok = shared_tokenizer(ranks.value, pattern)
        name = [str(i) for i in range(max(tok.ids) + 1)]
        for b in batches:
            every = (tok.encode(t or "") for t in b.column(1).to_pylist())
            if not digests:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(every), pa.list_(pa.int32()))], ["doc_id", "ids"])
                continue
            rows = [
                (len(ids), hashlib.sha256(" ".join(map(name.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids)).hexdigest())
                for ids in every
            ]
            n, enc, dec = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>")

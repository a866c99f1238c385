"""Spelling variants: words one edit apart, and for each rare form the common form it leads to.

Of every word of the vocabulary the whole neighbourhood is generated: all
distinct strings with one code point deleted, replaced or inserted over the
alphabet that the vocabulary uses.  A neighbour that is itself a word joins the
vocabulary by equality, so no distance is ever computed.  A word has about
twice its length times the alphabet's size of neighbours, nearly none of them
words; before strings are built and shuffled, their rolling hashes, which need
one multiplication each, are held against a table of ``BITS`` bits in which the
hashes of all words are set.  The table only spares rows: what passes it is
still joined by equality, and nothing that is a word fails it.

Joins are hinted: files of words are far smaller than their rows in memory, so by
their size Spark would send the vocabulary to the driver and broadcast it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numera.llm.common import cut, drop_cut, location

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word may follow a neighbour that is this many times as frequent.
RATIO = 2
#: Letters of a run, as a Java pattern: at most 116 different ones, so the alphabet is bounded.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Bits of the table of word hashes, of fixed size whatever the vocabulary: 16 MB, kept in the shared folder.
BITS = 27
#: Neighbours hashed at once in a task.
CHUNK = 1 << 21
#: Blocks of 64 bits in a row of the written table, as a power of two.
PAGE = 12
_held: dict = {}
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def runs(docs: DataFrame, id_col: str, text_col: str, least: int = 1) -> DataFrame:
    """(id, run): every maximal run of letters of ``least`` code points or more, A-Z lower-cased, once per occurrence."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"([{LETTERS}]+)"), F.lit(0))).alias("run"))
    return found.where(F.length("run") >= least).select("id", F.translate("run", upper, lower).alias("run"))


def damaged(doc_id: Column, run: Column) -> Column:
    """The contract's words: of one run in 97, by the CRC-32 of ``<doc_id>:<run>`` (a null id is empty), one code point is deleted."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    k = (h % F.length(run)).cast("int")
    cut_one = F.concat(F.substr(run, F.lit(1), k), F.substr(run, k + 2))
    return F.when(h % 97 == 0, cut_one).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, rewrite=None) -> DataFrame:
    """(word, n): the distinct words of that length and number of occurrences over all texts; ``rewrite(id, run)`` may change a run first.

    A null or empty text has none; rows of repeated ids count each.
    """
    found = runs(docs, id_col, text_col, least_length)
    word = rewrite(F.col("id"), F.col("run")) if rewrite else F.col("run")
    words = found.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) * _MIX) >> np.uint64(64 - bits)


def _by_length(words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Words of one length at a time, few enough for their code points to be held: (words, codes, hashes of prefixes, powers of the base)."""
    with np.errstate(over="ignore"):
        words = sorted(words, key=len)
        at = 0
        while at < len(words):
            n = len(words[at])
            end = at
            while end < len(words) and len(words[end]) == n and (end - at) * (n + 1) < CHUNK // 4:
                end += 1
            part = words[at : max(end, at + 1)]
            at += len(part)
            codes = np.frombuffer("".join(part).encode("utf-32-le"), "<u4").reshape(len(part), n).astype(np.uint64)
            prefix = np.zeros((n + 1, len(part)), np.uint64)
            for t in range(n):
                prefix[t + 1] = prefix[t] * _BASE + codes[:, t]
            yield part, codes, prefix, np.cumprod(np.r_[np.uint64(1), np.full(n + 1, _BASE)], dtype=np.uint64)


def neighbours(words: list[str], alphabet: list[str], is_set: np.ndarray | None = None) -> Iterator[tuple[str, str]]:
    """(neighbour, word): all distinct strings one edit over ``alphabet`` from each word; with ``is_set``, those whose bit is set.

    Of equal letters in a row only the first is deleted, and a letter is not
    inserted after itself, so each string comes up once.
    """

    def passed(h: np.ndarray) -> np.ndarray:
        if is_set is None:
            return np.ones(h.shape, bool)
        p = _places(h, (8 * len(is_set)).bit_length() - 1)
        return (is_set[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0

    letters = np.array([ord(c) for c in alphabet], np.uint64)
    with np.errstate(over="ignore"):
        for part, codes, prefix, power in _by_length(words):
            n = codes.shape[1]
            step = max(1, CHUNK // (max(1, len(letters)) * len(part)))
            for lo in range(0, n + 1, step):
                at = np.arange(lo, min(lo + step, n + 1))
                before = prefix[at]
                tail = prefix[n] - before * power[n - at][:, None]  # hash of what follows the place
                old = np.r_[np.zeros((1, len(part)), np.uint64), codes.T][at]  # the letter before the place
                if len(letters):  # insertion: place, word, letter
                    h = (before[..., None] * _BASE + letters) * power[n - at][:, None, None] + tail[..., None]
                    for i, r, c in zip(*np.nonzero((old[..., None] != letters) & passed(h))):
                        w, k = part[r], int(at[i])
                        yield w[:k] + alphabet[c] + w[k:], w
                at = at[at < n]
                if not len(at):
                    continue
                before, own, old = before[: len(at)], codes.T[at], old[: len(at)]
                tail = prefix[n] - prefix[at + 1] * power[n - 1 - at][:, None]
                if len(letters):
                    h = (before[..., None] * _BASE + letters) * power[n - 1 - at][:, None, None] + tail[..., None]
                    for i, r, c in zip(*np.nonzero((own[..., None] != letters) & passed(h))):
                        w, k = part[r], int(at[i])
                        yield w[:k] + alphabet[c] + w[k + 1 :], w
                first = (own != old) | (at == 0)[:, None]
                for i, r in zip(*np.nonzero(first & passed(before * power[n - 1 - at][:, None] + tail))):
                    w, k = part[r], int(at[i])
                    yield w[:k] + w[k + 1 :], w


def _table(where: str, bits: int) -> np.ndarray:
    """The table of bits that tasks have written below ``where``; a Python worker keeps the last one it read."""
    if _held.get("where") != where:
        fs, base = pafs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (pafs.LocalFileSystem(), where)
        table = np.zeros(1 << (bits - 6), np.int64)
        for f in fs.get_file_info(pafs.FileSelector(base)):
            if f.path.endswith(".parquet"):
                with fs.open_input_file(f.path) as src:
                    for b in pq.ParquetFile(src).iter_batches(64):
                        own = b.column(1)
                        at = np.repeat(b.column(0).to_numpy() << PAGE, own.value_lengths().to_numpy())
                        flat = own.flatten()
                        table[at + flat.field(0).to_numpy()] = flat.field(1).to_numpy()
        _held.update(where=where, table=table.view(np.uint8))
    return _held["table"]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of different words of ``words`` (word, n; words unique) one edit apart, in both directions.

    The alphabet is that of the words.  An empty table has none.
    """
    bits = BITS
    alphabet = sorted(r.c for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().where("c != ''").collect())

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, prefix, _ in _by_length(b.column(0).to_pylist()):
                p = _places(prefix[-1], bits)
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["block", "bit"])

    # the table is put together by tasks, 64 KB a row at most, and read by tasks from the shared folder: the driver holds none of it
    blocks = words.select("word").mapInArrow(hashed, "block long, bit long").groupBy("block").agg(F.bit_or("bit").alias("bits"))
    pages = blocks.groupBy(F.shiftright("block", PAGE).alias("page")).agg(F.collect_list(F.struct(F.col("block").bitwiseAND(F.lit((1 << PAGE) - 1)).alias("block"), "bits")).alias("own"))
    where = location(cut(pages, "bits"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set = _table(where, bits)
        out: tuple[list, list] = ([], [])
        for b in batches:
            for near, word in neighbours(b.column(0).to_pylist(), alphabet, is_set):
                out[0].append(near)
                out[1].append(word)
                if len(out[0]) == 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["near", "word"])
                    out = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["near", "word"])

    # one edit from the word lies the other: equality of strings is all that is left to ask
    made = words.select("word").mapInArrow(work, "near string, word string")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the pointers of ``forms`` (word, form; words unique, no cycles) end, by pointer doubling."""
    at = cut(forms.select("word", F.col("form").alias("p"), F.lit(True).alias("open")), "roots")
    while not at.where("open").isEmpty():
        on = at.select(F.col("word").alias("p"), F.col("p").alias("q"), F.col("open").alias("more"))
        moved = at.where("open").join(on.hint("merge"), "p", "left").select("word", F.coalesce("q", "p").alias("p"), F.coalesce("more", F.lit(False)).alias("open"))
        new = cut(at.where("not open").unionByName(moved), "roots")
        drop_cut(at)
        at = new
    return at.select("word", F.col("p").alias("root"))


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=None, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of the vocabulary, the neighbour it is a variant of, and the last form of that chain.

    A word's form is its near word of most occurrences (ties: smallest in code
    point order) if that has ``ratio`` times the word's occurrences or more,
    else null; ``root`` is the word itself where there is no form.  Occurrences
    at least double along a chain, so chains are short and end.  Null and empty
    texts have no words; repeated rows and ids count each; other columns are not
    read; an empty table gives an empty one.
    """
    words = cut(vocabulary(docs, id_col, text_col, rewrite=rewrite), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("near"), (-F.col("best.m")).alias("near_n"))
    follows = F.col("near_n") >= ratio * F.col("n")
    found = cut(found.select("word", F.when(follows, F.col("near")).alias("form"), "n", "n_near", F.when(follows, F.col("near_n")).alias("form_n")), "forms")
    drop_cut(words)
    last = roots(found.where("form is not null"))
    return found.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

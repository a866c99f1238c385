"""Runs of repeated words: maximal periodic stretches of a text, and the text with each run's repeats taken out.

A run is a stretch of consecutive words with smallest period ``p`` that no
neighbouring word extends with that period.  Every such run of three periods
has, under one of the two orders of the words (any order and its reverse), a
longest Lyndon word of length ``p`` that starts in its first period.  So the text is
scanned from right to left once for each order; the Lyndon words ahead form a
stack, and the word at hand takes in those on top that are greater.  What begins
with equal words is compared by the length of the common extension: first word
by word, then by binary search over rolling hashes, and what the hashes say is
checked word by word.  Each candidate (place, period) that repeats is extended in
both directions in the same way.  Time is O(n log n) for n words, memory O(n).

Texts are independent, so Spark deals rows over tasks and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.llm.common import small_batches

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words compared one by one before hashes are asked.
DIRECT = 8
_MOD, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681 % ((1 << 61) - 1)


class Extensions:
    """Common extensions of pairs of places of one sequence of word numbers >= 0 that ends with -1."""

    def __init__(self, w: list[int]):
        self.w, self.n = w, len(w) - 1
        self.hashes: list[int] = []
        self.powers: list[int] = []
        self.known: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, k: int) -> bool:
        """The hashes of the ``k`` words from ``i`` and from ``j`` are equal."""
        if not self.hashes:
            self.hashes = list(accumulate(self.w[:-1], lambda h, x: (h * _BASE + x + 1) % _MOD, initial=0))
            self.powers = list(accumulate(range(self.n), lambda p, _: p * _BASE % _MOD, initial=1))
        h, p = self.hashes, self.powers[k]
        return (h[i + k] - h[i] * p - h[j + k] + h[j] * p) % _MOD == 0

    def _search(self, least: int, most: int, same: Callable[[int], bool]) -> int:
        """The greatest length in ``least .. most`` whose parts have equal hashes: doubling steps, then halves."""
        step = DIRECT
        while least + step <= most and same(least + step):
            least += step
            step *= 2
        above = min(most, least + step)
        while least < above:
            mid = (least + above + 1) // 2
            if same(mid):
                least = mid
            else:
                above = mid - 1
        return least

    def forward(self, i: int, j: int) -> int:
        """How many words from ``i`` equal those from ``j`` > ``i``."""
        w, k = self.w, 0
        while w[i + k] == w[j + k]:
            k += 1
            if k == DIRECT:
                break
        else:
            return k
        d = j - i
        low, high = self.known.get(d, (-1, -1))
        if low <= i + k <= high:  # at this distance the words from here to ``high`` are known to be equal
            self.known[d] = (min(low, i), high)
            return high - i
        found = self._search(k, self.n - j, lambda m: self._same(i, j, m))
        if w[i + k : i + found] != w[j + k : j + found] or w[i + found] == w[j + found]:  # hashes have collided
            found = k
            while w[i + found] == w[j + found]:
                found += 1
        self.known[d] = (i, i + found)
        return found

    def backward(self, i: int, j: int) -> int:
        """How many words before ``i`` equal those before ``j`` > ``i``."""
        w, k = self.w, 0
        while k < i and k < DIRECT and w[i - k - 1] == w[j - k - 1]:
            k += 1
        if k < DIRECT or k == i:
            return k
        found = self._search(k, i, lambda m: self._same(i - m, j - m, m))
        if w[i - found : i - k] != w[j - found : j - k] or (found < i and w[i - found - 1] == w[j - found - 1]):
            found = k
            while found < i and w[i - found - 1] == w[j - found - 1]:
                found += 1
        return found


def lyndon_ends(w: list[int], forward: Callable[[int, int], int]) -> list[int]:
    """For each place the end of the longest Lyndon word that starts there; the last item of ``w`` is smaller than all others."""
    n = len(w) - 1
    ends = [n] * n
    for i in range(n - 2, -1, -1):
        a, j = w[i], i + 1
        while True:
            b = w[j]
            if a < b:
                j = ends[j]
            elif a > b:
                break
            else:
                x, y = w[i + 1], w[j + 1]
                if x == y:
                    k = forward(i, j)
                    x, y = w[i + k], w[j + k]
                if x > y:
                    break
                j = ends[j]
        ends[i] = j
    return ends


def find_runs(words: list, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words`` with that many words and periods (three at least), by start, then period."""
    if least_periods < 3:
        raise ValueError("a run has three periods at least")
    n = len(words)
    if n < max(least_words, least_periods):
        return []
    number: dict = {}
    w = [number.setdefault(x, len(number)) for x in words]
    if len(number) == n:
        return []
    up, down = [*w, -1], [*(-x for x in w), -n - 1]
    ext = Extensions(up)
    at, codes = np.arange(n), np.array(up)
    found = np.concatenate([np.stack([at, np.array(lyndon_ends(x, ext.forward)) - at], 1) for x in (up, down)])
    for k in range(DIRECT):  # of three periods, two copies of the Lyndon word are left from here on
        i, p = found[:, 0], found[:, 1]
        here = np.minimum(i + k, n)
        found = found[(p <= k) | (codes[here] == codes[np.minimum(here + p, n)]) & (i + 2 * p <= n)]
    found = found[found[:, 0] + 2 * found[:, 1] <= n]
    runs, last, start, end = set(), 0, 0, 0
    for i, p in found[np.lexsort(found.T)].tolist():
        if p == last and start <= i and i + 2 * p <= end:
            continue  # within the run found last
        last, start, end = p, i - ext.backward(i, i + p), i + p + ext.forward(i, i + p)
        if end - start >= max(least_words, least_periods * p):
            runs.add((start, end - start, p))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        gone[s + p] += 1
        gone[s + length] -= 1
    return [x for x, g in zip(words, np.cumsum(gone).tolist()) if not g] if runs else words


def planted(words: list, doc_id: int | None) -> list:
    """The words of the contract's texts: in a tenth of the documents (by the CRC-32 of the id) the words from a place on repeat; a null id plants nothing."""
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def runs_and_rest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[list, int | None], list] | None = None) -> DataFrame:
    """Per row: the id, ``runs`` (array of start, length, period in words, by start, then period) and ``collapsed``, the words kept, joined by one space.

    Words are stretches without ASCII white space.  ``rewrite(words, id)`` may
    change them before they are searched.  A null, empty or blank text has no
    words, no runs and an empty ``collapsed``; rows of repeated or missing ids
    are searched each by itself, equal texts give equal results, other columns
    are left out whatever their names, and an empty table gives an empty one.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            runs, texts = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = (t or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone
                if rewrite:
                    words = rewrite(words, i)
                found = find_runs(words)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(b" ".join(kept_words(words, found)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)

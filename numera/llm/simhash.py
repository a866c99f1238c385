"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints within two bits agree in at least six of their eight positional
bytes.  The index keeps, for each fingerprint, posting entries under pairs of
two-byte groups (six keys of 32 bits): two differing bytes touch at most two of
the four groups, so linked fingerprints share a posting.  Within a posting the
shared positional bytes of each pair are tallied, pairs reaching the guaranteed
minimum are kept, and the bits are counted.  A posting answers with a star per
connected group instead of its pairs, so the links stay linear in its length.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numera.llm.common import components, cut, run_bounds, whole_runs

SHINGLE = 3
SEED = 42
MAX_BITS = 2
LARGE_RUN = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, unsigned; zero without words."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[: n - shingle] + 1])
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    total = bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(total * 2 > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every whole text; null text is empty."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


def near(x: np.uint64, rest: np.ndarray, max_bits: int) -> np.ndarray:
    """Positions in ``rest`` within ``max_bits`` of ``x``: byte tally first, then the bits."""
    d = rest ^ x
    tally = (d.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    cand = np.flatnonzero(tally >= 8 - max_bits)
    return cand[np.bitwise_count(d[cand]) <= max_bits]


def _stars(fp: np.ndarray, rep: np.ndarray, max_bits: int, out: list) -> None:
    """Stars (rep, smallest rep) of the groups that the links within one posting connect."""
    if len(fp) > LARGE_RUN:
        # the remaining bytes are indexed by pairs in turn: of those that are not the
        # posting's own, at most max_bits differ, so some pair of bytes agrees
        by = fp.view(np.uint8).reshape(-1, 8)
        varying = [p for p in range(8) if (by[:, p] != by[0, p]).any()]
        if len(varying) >= max_bits + 2:
            for p, q in combinations(varying, 2):
                key = by[:, p].astype(np.int32) << 8 | by[:, q]
                order = np.argsort(key, kind="stable")
                at = run_bounds(key[order])
                for s, e in zip(at[:-1], at[1:]):
                    if e - s > 1:
                        own = order[s:e]
                        _bfs(fp[own], rep[own], max_bits, out)
            return
    _bfs(fp, rep, max_bits, out)


def _bfs(fp: np.ndarray, rep: np.ndarray, max_bits: int, out: list) -> None:
    order = np.argsort(rep, kind="stable")
    fp, rep = fp[order], rep[order]
    left = np.arange(len(fp))
    while len(left) > 1:
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            hit = near(fp[todo.pop()], fp[left], max_bits)
            if len(hit):
                got = left[hit]
                left = np.delete(left, hit)
                todo.extend(got)
                out.append((np.full(len(got), rep[root]), rep[got]))


def index_keys(fp: str) -> Column:
    """The postings of a fingerprint: one key of 32 bits, and which it is, for each pair of its two-byte groups."""
    part = [F.shiftrightunsigned(fp, 48 - 16 * g).bitwiseAND(F.lit(0xFFFF)) for g in range(4)]
    return F.array(*(F.lit(n).cast("long") * (1 << 32) + part[a] * (1 << 16) + part[b] for n, (a, b) in enumerate(combinations(range(4), 2))))


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (src, dst) joining the representatives of fingerprints within ``max_bits`` <= 2."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the index guarantees a shared posting for at most 2 differing bits")
    postings = classes.select(F.explode(index_keys("fp")).alias("k"), "fp", "rep")

    def run(batches):
        for t in whole_runs(batches, ["k"]):
            k, fp, rep = (t.column(c).to_numpy() for c in ("k", "fp", "rep"))
            fp = np.ascontiguousarray(fp).view(np.uint64)
            at = run_bounds(k)
            out: list = []
            for i in np.flatnonzero(np.diff(at) > 1):
                _stars(fp[at[i] : at[i + 1]], rep[at[i] : at[i + 1]], max_bits, out)
            if out:
                src, dst = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return postings.repartition("k").sortWithinPartitions("k").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    Documents with equal fingerprints form one class, represented by its
    smallest id; classes link at ``max_bits`` or fewer differing bits.  Null and
    empty texts have fingerprint zero and link like any other.  Rows repeated
    under one id keep their rows.  A null id takes part in no component (null).
    Extra columns of ``docs`` are not read, and an empty table gives an empty one.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comp = components(links(classes, max_bits))
    named = classes.join(comp, classes.rep == comp.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex16(c: str):
    """A signed long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, and those without an id; all columns stay."""
    near = near_duplicates(docs, id_col, text_col, max_bits, shingle)
    gone = near.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")

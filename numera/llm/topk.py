"""Exact top-k inner products by distributed histogram selection.

Queries and candidates are dealt into tiles of bounded size; every pair of
tiles scores all its pairs.  A round adds up, over all tiles, a histogram of
each query's scores inside the interval that still holds its kth value, and
narrows the interval to the bucket where the count from above reaches k.  When
buckets are single integers the kth value is known; a last pass keeps the
scores at or above it and breaks ties by the smaller id.  A tile needs to count
only its own k highest scores of a query, as no lower one can be among the k
highest of all.
"""

from __future__ import annotations

import math
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numera.llm.common import cut, drop_cut, finite_vector, list_matrix, run_bounds, whole_runs

TILE = 8192
BUCKETS = 4096
BLOCK = 128
#: Inner products from here on are not compared: they would not fit a long safely.
LIMIT, LOST = 2**62, -(2**63)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64; ``LOST`` for those of 2**62 or more in size."""
    d = q.shape[1]
    most = [np.abs(x).max(axis=1, initial=0) for x in (q, c)]
    if d * most[0].max(initial=0) * most[1].max(initial=0) < 2**53:
        return (q @ c.T).astype(np.int64)
    # rows of large components one by one in whole numbers, the others as they come
    small = [m < math.sqrt(2**53 / d) for m in most]
    out = np.empty((len(q), len(c)), np.int64)
    out[np.ix_(*small)] = (q[small[0]] @ c[small[1]].T).astype(np.int64)

    def whole(rows: np.ndarray, cols: np.ndarray) -> None:
        left, right = ([[int(v) for v in r] for r in x] for x in (q[rows], c[cols]))
        for i, a in zip(np.flatnonzero(rows), left):
            every = (sum(map(mul, a, b)) for b in right)
            out[i, cols] = [v if abs(v) < LIMIT else LOST for v in every]

    whole(~small[0], np.ones(len(c), bool))
    whole(small[0], ~small[1])
    return out


def _tiles(batches, k: int, each):
    """Call ``each(ids_q, lo, hi, ids_c, scores)`` for blocks of queries of every tile pair."""
    for t in whole_runs(batches, ["tile"]):
        tile, side = t.column("tile").to_numpy(), t.column("side").to_numpy()
        ids, lo, hi = (t.column(c).to_numpy() for c in ("vec_id", "lo", "hi"))
        rows = list_matrix(t.column("v"))
        at = run_bounds(tile)
        for s, e in zip(at[:-1], at[1:]):
            dims = np.array([len(r) for r in rows[s:e]])
            for d in np.unique(dims):
                own = s + np.flatnonzero(dims == d)
                qi, ci = own[side[own] == 0], own[side[own] == 1]
                if not len(qi) or not len(ci):
                    continue
                c = np.floor(256.0 * np.stack([rows[i] for i in ci]))
                order = np.argsort(ids[ci], kind="stable")
                ci, c = ci[order], c[order]
                for b in range(0, len(qi), BLOCK):
                    own_q = qi[b : b + BLOCK]
                    q = np.floor(256.0 * np.stack([rows[i] for i in own_q]))
                    yield from each(ids[own_q], lo[own_q], hi[own_q], ids[ci], _scores(q, c))


def top_k(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query.

    ``queries`` is a condition on the id column ``vec_id`` that names the query
    rows; every row is a candidate, but not for the query of its own id.
    Components become ``floor(256 * x)``.  Rows whose id or vector is null,
    empty, or holds null or non-finite components take no part; vectors of
    different length are not compared.  Ties go to the smaller id; a query with
    fewer candidates returns them all, one without any returns no row.  Among rows
    repeated under one query id the smallest vector asks; as candidates all stay.
    Pairs whose product is 2**62 or more in size take no part.  An empty table
    gives an empty result; extra columns are not read.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(finite_vector("v") & F.col("vec_id").isNotNull())
    q = v.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, top, dim = v.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double") * 256) + 1))), F.max(F.size("v"))).first()
    nq = q.count()
    ct, qt = max(1, math.ceil((n or 0) / TILE)), max(1, math.ceil(nq / TILE))
    reach = min(int(dim or 0) * int(min(top or 0, 2**62)) ** 2, LIMIT - 1)
    cand = v.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(qt - 1)))).select(
        (F.col("t") * ct + F.pmod(F.xxhash64("vec_id"), F.lit(ct))).cast("long").alias("tile"),
        F.lit(1).alias("side"), "vec_id", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "v",
    )

    def scored(bounds: DataFrame, each, schema: str) -> DataFrame:
        asked = q.join(bounds, "vec_id").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(ct - 1)))).select(
            (F.pmod(F.xxhash64("vec_id"), F.lit(qt)) * ct + F.col("t")).cast("long").alias("tile"),
            F.lit(0).alias("side"), "vec_id", "lo", "hi", "v",
        )
        both = asked.unionByName(cand).repartition("tile").sortWithinPartitions("tile")
        return both.mapInArrow(lambda batches: _tiles(batches, k, each), schema)

    def histogram(width: int):
        def each(qid, lo, hi, cid, s):
            kept_q, kept_b = [], []
            for r in range(len(qid)):
                x = s[r][(cid != qid[r]) & (s[r] != LOST)]
                x = x[x <= hi[r]]
                if len(x) > k:
                    x = np.partition(x, len(x) - k)[-k:]
                # values under lo are counted in the last bucket: they only matter where fewer than k exist
                b = np.maximum(x - lo[r], -1) // width
                kept_q.append(np.full(len(b), qid[r]))
                kept_b.append(b)
            u, c = np.unique(np.stack([np.concatenate(kept_q), np.concatenate(kept_b)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1]), pa.array(c.astype(np.int64))], ["vec_id", "bucket", "c"])

        return each

    # need: how many of the k are still looked for at or under hi
    state = q.select("vec_id", F.lit(-reach).cast("long").alias("lo"), F.lit(reach).cast("long").alias("hi"), F.lit(k).cast("long").alias("need")).distinct()
    width = 2 * reach + 1
    made: list[DataFrame] = []
    while width > 1:
        width = math.ceil(width / BUCKETS)
        hist = scored(state.select("vec_id", "lo", "hi"), histogram(width), "vec_id long, bucket long, c long")
        hist = hist.groupBy("vec_id", "bucket").agg(F.sum("c").alias("c"))
        down = Window.partitionBy("vec_id").orderBy(F.desc("bucket"))
        found = (
            hist.join(state, "vec_id")
            .withColumn("above", F.sum("c").over(down) - F.col("c"))
            # the bucket that holds the value looked for, or the lowest one if there are fewer
            .where("above < need")
            .groupBy("vec_id")
            .agg(F.min(F.struct("bucket", "above", "lo", "hi", "need")).alias("x"))
            .select("vec_id", F.col("x.lo").alias("l"), F.col("x.hi").alias("h"), F.col("x.bucket").alias("b"), (F.col("x.need") - F.col("x.above")).alias("need"))
            .select("vec_id", (F.col("l") + F.col("b") * width).alias("lo"), F.least(F.col("h"), F.col("l") + (F.col("b") + 1) * width - 1).alias("hi"), "need")
        )
        state = cut(found, "topk")
        made.append(state)
    for old in made[:-1]:
        drop_cut(old)

    def final(qid, lo, hi, cid, s):
        a, b, c = [], [], []
        for r in range(len(qid)):
            own = np.flatnonzero((s[r] >= lo[r]) & (cid != qid[r]) & (s[r] != LOST))
            own = own[np.argsort(-s[r][own], kind="stable")[:k]]
            a.append(np.full(len(own), qid[r]))
            b.append(cid[own])
            c.append(s[r][own])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, c)], ["query_id", "vec_id", "score"])

    kept = scored(state.select("vec_id", "lo", "hi"), final, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

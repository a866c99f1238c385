"""Graph algorithms over edge DataFrames (src, dst[, w])."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` that all executors share; a local one only where none is set on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="numera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/numera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """``checkpoint``, and aggregates of the rows, taken by the job that writes them."""
    seen = Observation()
    names = list(sums)
    out = checkpoint(df.observe(seen, *(sums[n].alias(n) for n in names)))
    return out, dict(seen.get)


def drop(df: DataFrame) -> None:
    """Remove the files of a ``checkpoint`` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, *tables: DataFrame | None) -> None:
    """``drop`` each of ``tables``, and let Spark remove the shuffle files of jobs that are over."""
    for t in tables:
        if t is not None:
            drop(t)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def grown(seen: DataFrame, front: DataFrame, rounds: int) -> DataFrame:
    """``seen`` and what a round found, which stays where it is written; every 16th round all is written anew, so plans stay short."""
    both = seen.unionByName(front)
    return both if rounds % 16 else checkpoint(both)


def undirected(edges: DataFrame) -> DataFrame:
    """Both orientations of every edge."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).union(edges.select("dst", "src", *rest))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest vertex reachable.

    Large-star and small-star steps in turn: a vertex links its larger, then its
    smaller neighbours to the smallest one it knows, until the edges are stars.
    A step is a grouped minimum, combined before it is shuffled, and an
    equi-join; a round is one job, which also counts its edges, and rounds grow
    with the logarithm of the longest path.
    """
    sums = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    e, seen = observed(edges.where("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), **sums)
    while seen["n"]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(low, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = e
        e, now = observed(small.union(low.select("a", F.col("m").alias("b"))).distinct(), **sums)
        drop(old)
        if now == seen:
            break
        seen = now
    return vertices.join(e, vertices.id == e.a, "left").select("id", F.coalesce("b", "id").alias("component"))


def shortest_paths(edges: DataFrame, source: int, limit: float | None = None) -> DataFrame:
    """(id, dist, pred): distances from ``source`` over non-negative weights (src, dst, w), by relaxation to a fixpoint.

    Only vertices whose distance changed are relaxed again.  ``pred`` is the
    smallest predecessor on a shortest path, null for the source.
    """
    spark = edges.sparkSession
    dist = spark.createDataFrame([(source, 0.0)], "id long, dist double")
    front = dist
    while True:
        step = front.join(edges, front.id == edges.src).select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("d"))
        if limit is not None:
            step = step.where(F.col("d") <= limit)
        step = step.groupBy("id").agg(F.min("d").alias("d"))
        new = checkpoint(dist.join(step, "id", "full_outer").select("id", F.least("dist", "d").alias("dist"), (F.col("dist").isNull() | (F.col("d") < F.col("dist"))).alias("changed")))
        dist, front = new.select("id", "dist"), new.where("changed").select("id", "dist")
        if front.isEmpty():
            break
    into = edges.join(dist.select(F.col("id").alias("src"), F.col("dist").alias("ds")), "src")
    pred = into.join(dist.select(F.col("id").alias("dst"), F.col("dist").alias("dd")), "dst").where("ds + w = dd").groupBy("dst").agg(F.min("src").alias("pred"))
    return dist.join(pred, dist.id == pred.dst, "left").select("id", "dist", F.when(F.col("id") != source, F.col("pred")).alias("pred"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id): everything reachable from ``start`` (id), itself included; one semi-naive step per round."""
    seen = front = checkpoint(start.select("id").distinct())
    for k in count(1):
        step = front.join(edges, front.id == edges.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = checkpoint(step)
        release(front.sparkSession)
        if front.isEmpty():
            return seen
        seen = grown(seen, front, k)


def grid_neighbours(points: DataFrame, queries: DataFrame, radius: float, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(q, id, dist): points within ``radius`` of each query, by an equi-join on neighbouring grid cells."""
    cell = lambda c: F.floor(F.col(c) / radius)
    p = points.select("id", *dims, *(cell(d).alias(f"g{d}") for d in dims))
    q = queries.select(F.col("id").alias("q"), *(F.col(d).alias(f"q{d}") for d in dims))
    for d in dims:
        own = F.floor(F.col(f"q{d}") / radius)
        q = q.withColumn(f"g{d}", F.explode(F.array(own - 1, own, own + 1)))
    j = p.join(q, [f"g{d}" for d in dims])
    dist = F.sqrt(sum(((F.col(d) - F.col(f"q{d}")) ** 2 for d in dims), F.lit(0.0)))
    return j.withColumn("dist", dist).where(F.col("dist") <= radius).select("q", "id", "dist")


def nearest(points: DataFrame, queries: DataFrame, k: int, radius: float, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(q, id, dist, rank): the k nearest points of each query.

    Queries with fewer than k points in ``radius`` look again in twice the
    radius, so the answer is exact while far cells are not visited for all.
    ``radius`` is halved first, until its cells hold few points each, so what is
    compared grows with the points.  Points and queries without a place have no
    neighbours.
    """
    from pyspark.sql import Window

    here = lambda df: df.where(reduce(lambda a, b: a & b, (F.col(d).isNotNull() for d in dims)))
    # of points at one place only the k of smallest id can be among the nearest
    same = F.row_number().over(Window.partitionBy(*dims).orderBy("id"))
    points = checkpoint(here(points).select("id", *dims, same.alias("place")).where(F.col("place") <= k).drop("place"))
    n, left, out = points.count(), checkpoint(here(queries)), None
    for _ in range(64):
        crowd = points.groupBy(*(F.floor(F.col(d) / radius) for d in dims)).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        if crowd <= max(16, 4 * k) * n:
            break
        radius /= 2
    w = Window.partitionBy("q").orderBy("dist", "id")
    while True:
        near = grid_neighbours(points, left, radius, dims)
        full = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        found = F.count(F.lit(1)).over(Window.partitionBy("q"))
        got = checkpoint(full.withColumn("c", found).where(F.col("c") >= min(k, n)).drop("c"))
        out = got if out is None else out.union(got)
        if n == 0:
            return out
        old, left = left, checkpoint(left.join(got.select(F.col("q").alias("id")).distinct(), "id", "left_anti"))
        drop(old)
        if left.isEmpty():
            return out
        radius *= 2


def within(points: DataFrame, radius: float, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(id, cluster): clusters of points linked at ``radius`` or less, named by their smallest id.

    Points of a cell whose diagonal is under the radius are one group by
    themselves, so pairs only tell which cells are linked, once for two cells
    however many points they hold.  A point without a place is alone.
    """
    side = radius / (int(len(dims) ** 0.5) + 1)
    placed = points.where(reduce(lambda a, b: a & b, (F.col(d).isNotNull() for d in dims))).select("id", *dims, *(F.floor(F.col(d) / side).alias(f"h{d}") for d in dims))
    cell = [f"h{d}" for d in dims]
    placed = checkpoint(placed.join(placed.groupBy(*cell).agg(F.min("id").alias("root")), cell))
    ends = placed.select(F.col("root").alias("id"), *dims)
    linked = grid_neighbours(ends, ends, radius, dims).where("q < id").select(F.col("q").alias("src"), F.col("id").alias("dst")).distinct()
    named = components(placed.select(F.col("root").alias("id")).distinct(), linked).withColumnRenamed("id", "root")
    found = placed.select("id", "root").distinct().join(named, "root").select("id", F.col("component").alias("cluster"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))

"""Shared helpers: tables in the shared folder, sorted runs, graph components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the input folder, by whatever file system holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table as read, over all cores where its files make fewer tasks than there are; larger tables are left alone."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session leaves it unset and runs on one machine (tests) a
    temporary folder is made and recorded in the session.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="numera-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Paths of the tables ``cut`` has written, until they are removed.
_made: list[str] = []


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a table any executor can read again, so a lost
    executor costs at most the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/numera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def location(df: DataFrame) -> str:
    """The folder of a table made by ``cut``, for tasks that read it themselves."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def mark() -> int:
    """How many tables ``cut`` has written so far."""
    return len(_made)


def sweep(spark: SparkSession, since: int) -> None:
    """Remove all that ``cut`` has written since ``mark`` gave ``since``, but the table it wrote last."""
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for where in _made[since:-1]:
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(hconf).delete(path, True)
    del _made[since:-1]


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of stages that no live DataFrame refers to.

    Executors keep them until the driver's garbage collector notices; after a
    stage as large as its input that is worth asking for.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a table made by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(hconf).delete(path, True)


def small_batches(batches: Iterable[pa.RecordBatch], text: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that column ``text`` holds about ``size`` bytes, or one row, in each.

    What is made of a batch in Python takes several times its bytes.
    """
    for b in batches:
        total = np.cumsum(pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + size, side="right")))
            yield b.slice(i, j - i)
            i = j


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``keys`` so that no run of equal keys is split."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        tail = tuple(c[-1] for c in cols)
        same = np.ones(b.num_rows, bool)
        for c, v in zip(cols, tail):
            same &= c == v
        other = np.flatnonzero(~same)
        start = int(other[-1]) + 1 if len(other) else 0
        if start or (held and tuple(c[0] for c in cols) != last):
            done = held + ([b.slice(0, start)] if start else [])
            if done:
                yield pa.Table.from_batches(done)
            held = [b.slice(start)]
        else:
            held.append(b)
        last = tail
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(*cols: np.ndarray) -> np.ndarray:
    """Offsets of runs of equal values, with the length appended."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def list_matrix(col: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """A list column of numbers as one double array per row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths().fill_null(0)))])
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def finite_vector(c: str):
    """Condition: an array column is not null, not empty, and every component is finite."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(c).isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(False))


def link_labels(n: int, lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the groups of ``lab`` (labels 0..n-1, minimum wins) by the links i-j."""
    while len(i):
        a, b = lab[i], lab[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(lab, np.maximum(a, b), low)
        while True:
            nxt = lab[lab]
            if (nxt == lab).all():
                break
            lab[:] = nxt
    return lab


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (src, dst: long) as (node, root), root the smallest node.

    Alternates large-star and small-star steps until the edges are stars.  Each
    step is a grouped minimum (combined on the map side) and an equi-join that
    the adaptive planner may split, and its edges are written to the shared
    folder.  Roots themselves are not returned; nodes without edges neither.
    """
    spark = edges.sparkSession

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.where("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    e = cut(e, "edges")
    seen = mark(e)
    while seen[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(low, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(small.union(low2.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = mark(new)
        drop_cut(e)
        e = new
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))

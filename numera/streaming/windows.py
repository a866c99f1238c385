"""Event-time windows over a stream of events, and the same over a batch.

The functions take a DataFrame that may stream; a watermark bounds the state
and decides which late rows still count.  ``drain`` runs a stream over what is
there and ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numera.operators.graph import shared_dir


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of windows that follow one another."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(start, n) of windows that overlap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of stretches without a pause of ``gap``."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once; repeats within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run ``stream`` over the rows there are now and return its result, a Parquet table in the shared folder.

    With ``complete`` output every batch writes the whole result to a folder of
    its own, of which the last holds; with ``append`` all batches count.  The
    checkpoint lies beside them, so a query that is stopped goes on from there.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/numera-stream-{uuid.uuid4().hex}"
    schema = stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(schema).parquet(f"{folder}/rows")
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        last[:] = [number]

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/batch-{last[0]}") if last else spark.createDataFrame([], schema)

"""Continuous ingest: deduplicated documents, event-time windows and sessions, and logs that are appended to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def source(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, so many in a micro-batch at most."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (stream if files is None else stream.option("maxFilesPerTrigger", files)).parquet(path)


def table_source(spark: SparkSession, sf_dir: str, name: str, schema) -> DataFrame:
    """A stream of a given table, be it a file or a folder of files."""
    return source(spark, table_path(sf_dir, name), schema, "*")


def table_path(sf_dir: str, name: str) -> str:
    """The path of a given table as a pattern that only it meets: a stream takes a plain path to be a folder."""
    return f"{sf_dir}/{name}.[p]arquet"


def timed(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Events with a watermark; times without a zone are taken as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def first_of_each(docs: DataFrame, time_col: str | None = None) -> DataFrame:
    """The first document of each fingerprint; with a watermark on time_col the state is bounded by it."""
    marked = docs.withColumn("sha256", T.fingerprint(F.col("text")))
    return marked.dropDuplicatesWithinWatermark(["sha256"]) if time_col else marked.dropDuplicates(["sha256"])


def windows(events: DataFrame, length: str = "1 day") -> DataFrame:
    w = events.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    s = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to ``each``; restarts go on where the checkpoint says."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a folder of Parquet files."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

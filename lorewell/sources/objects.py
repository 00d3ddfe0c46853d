"""The object store: an append-only log of writes, and snapshots that fold it up to a batch.

Logs lie in folders by batch, so that a batch that is written again replaces itself; reading folds the last
snapshot and the batches after it. Both are plain Parquet of explicit paths.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITES = "id string, seq long, title string, object_type string, aliases array<string>, doc_ids array<string>, controlled boolean"
FOLDED = f"{WRITES}, any_controlled boolean, writes long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append(writes: DataFrame, path: str, batch: int) -> None:
    """Appends a batch of object writes (WRITES; seq rises from batch to batch)."""
    rows = writes.selectExpr("id", "cast(seq AS long) AS seq", "title", "object_type", "aliases", "doc_ids", "controlled").withColumn("batch", F.lit(batch).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/log")


def fold(rows: DataFrame) -> DataFrame:
    """Rows of FOLDED, of which an id may have several, as one for each: a fold of folds is that of all writes.

    The first write names the object; aliases and documents add up, aliases in order."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "aliases")))
    g = rows.groupBy("id").agg(
        F.min("seq").alias("seq"), F.min_by("title", "seq").alias("title"), F.min_by("object_type", "seq").alias("object_type"),
        F.array_distinct(F.flatten(F.transform(listed, lambda x: x["aliases"]))).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("doc_ids")))).alias("doc_ids"),
        F.min_by("controlled", "seq").alias("controlled"), F.bool_or("any_controlled").alias("any_controlled"), F.sum("writes").alias("writes"),
    )
    return g.select("id", "seq", "title", "object_type", "aliases", "doc_ids", "controlled", "any_controlled", "writes")


def state(spark: SparkSession, path: str) -> DataFrame:
    """The objects as all batches have made them: the last snapshot and the log after it."""
    snapshots = _read(spark, f"{path}/snapshots", f"{FOLDED}, upto long")
    # one number
    upto = snapshots.agg(F.max("upto")).first()[0]
    log = _read(spark, f"{path}/log", f"{WRITES}, batch long").where(F.col("batch") > (-1 if upto is None else upto))
    new = log.drop("batch").withColumn("any_controlled", F.col("controlled")).withColumn("writes", F.lit(1).cast("long"))
    return fold(snapshots.where(F.col("upto") == (-1 if upto is None else upto)).drop("upto").unionByName(new))


def compact(spark: SparkSession, path: str) -> None:
    """Writes a snapshot of all batches up to the last one; earlier snapshots and the log stay."""
    last = _read(spark, f"{path}/log", f"{WRITES}, batch long").agg(F.max("batch")).first()[0]
    if last is not None:
        rows = state(spark, path).withColumn("upto", F.lit(last).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upto").parquet(f"{path}/snapshots")

"""Running sums within keys of any size, dealt to many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpoint


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of its key up to each row, in the given order.

    Rows are sorted over all tasks, so that a key of any size is cut into ranges; each range is summed
    alone, and what comes before it is one row for each range of a key."""
    laid = checkpoint(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy(key, "_part").agg(F.sum(value).alias("_sum")).select(key, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    summed = laid.withColumn(name, F.sum(value).over(own)).join(parts, [key, "_part"])
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")

"""Hooks for models: embedders, extractors and judges run batch by batch where they are given; without
them, the engine's own expressions take their place. Controlled text never leaves for a remote model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import security, vectors


def check_egress(rows: DataFrame, url: str, allowed: tuple[str, ...] = ()) -> None:
    """Raises EgressViolation if rows (controlled) meet an endpoint that isn't local."""
    local = rows.sparkSession.range(1).select(security.is_local(F.lit(url), allowed)).first()[0]
    if not local and rows.where("controlled").limit(1).count():
        raise security.EgressViolation(url)


def embed(rows: DataFrame, id_col: str, text_col: str, model: Callable[[list[str]], list] | None = None) -> tuple[DataFrame, str]:
    """((id, embedding), backend): the model's vectors, or hashed features as dense vectors."""
    if model is None:
        sparse = vectors.hashed_features(rows, id_col, text_col)
        held = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("value") / F.col("norm")))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
        return held.select(F.col("id").alias(id_col), dense.alias("embedding")), "hash"

    @F.pandas_udf("array<double>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(model(texts.tolist())))

    return rows.select(id_col, embedded(F.col(text_col)).alias("embedding")), "model"


def ask_model(rows: DataFrame, prompt_col: str, model: Callable[[str], str], retries: int = 2) -> DataFrame:
    """rows with reply: the model's first reply that isn't an error, else null; violations aren't retried."""

    @F.pandas_udf("string")
    def replies(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            reply = None
            for _ in range(retries + 1):
                try:
                    reply = model(p)
                    break
                except security.EgressViolation:
                    raise
                except Exception:  # a model may fail in any way; the row then has no reply
                    continue
            out.append(reply)
        return pd.Series(out, dtype=object)

    return rows.withColumn("reply", replies(F.col(prompt_col)))

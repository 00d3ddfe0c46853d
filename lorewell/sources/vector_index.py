"""An inverted-file index of vectors: lists around centroids, 8-bit codes of what a centroid leaves, several lists a search.

The centroids are fitted on a bounded sample; every vector is filed. Codes lie by department and, within
its files, by list; whole vectors lie beside them for the few candidates that are scored again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators.resolution import met
from ..operators.retrieval import ranked
from .store import opened

#: Vectors that centroids are fitted on at most, and lists.
SAMPLE, LISTS_MOST = 50_000, 4096
#: Candidates by code for each vector wanted, which are then scored by their whole vectors.
AGAIN = 4


@dataclass(frozen=True)
class VectorIndex:
    codes: DataFrame
    vectors: DataFrame
    centroids: DataFrame


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def centre_matrix(centroids: DataFrame) -> np.ndarray:
    """The centroids, LISTS_MOST at most, in the order of their lists."""
    rows = centroids.orderBy("list").collect()
    return np.array([r["v"] for r in rows], dtype=np.float64)


def write_vectors(rows: DataFrame, path: str, seed: int = 17) -> None:
    """Writes the index of rows (id, department, v) under ``path``; null and zero vectors are left out.

    There is a list for each root of the number of vectors. The sample is those whose ids hash lowest."""
    spark = rows.sparkSession
    fine = rows.where("size(v) > 0 AND exists(v, x -> x != 0)").select("id", F.col("department").cast("string").alias("department"), F.col("v").cast("array<double>").alias("v"))
    fine.write.mode("overwrite").partitionBy("department").parquet(f"{path}/vectors")
    held = opened(spark, f"{path}/vectors")
    n = held.count()
    sample = held.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("v").alias("v"))
    lists = min(max(1, math.isqrt(n)), LISTS_MOST)
    model = KMeans(featuresCol="v", k=lists, distanceMeasure="cosine", seed=seed, maxIter=10).fit(sample)
    centres = unit(np.array(model.clusterCenters()))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, v array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    shared = spark.sparkContext.broadcast(centres)

    def filed(batches):
        for pdf in batches:
            v = unit(np.stack([np.asarray(x, dtype=np.float64) for x in pdf["v"]]))
            at = (v @ shared.value.T).argmax(axis=1)
            rest = v - shared.value[at]
            scale = np.maximum(np.abs(rest).max(axis=1, keepdims=True), 1e-12) / 127
            codes = np.rint(rest / scale).astype(np.int8)
            yield pd.DataFrame({"id": pdf["id"], "department": pdf["department"], "list": at, "scale": scale[:, 0], "code": [c.tobytes() for c in codes]})

    kind = held.schema["id"].dataType.simpleString()
    codes = held.mapInPandas(filed, f"id {kind}, department string, list int, scale double, code binary")
    codes.repartitionByRange("department", "list", "id").sortWithinPartitions("list").write.mode("overwrite").partitionBy("department").parquet(f"{path}/codes")


def open_vectors(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(*(opened(spark, f"{path}/{t}") for t in ("codes", "vectors", "centroids")))


def search_vectors(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score, rank), (query_id, seen)): the k best of the vectors in the ``probes`` lists nearest
    to each query (query_id, q, and department where only one is searched), and how many were scored.

    Codes choose AGAIN * k candidates, whose whole vectors give the score."""
    spark = queries.sparkSession
    centres = spark.sparkContext.broadcast(centre_matrix(index.centroids))
    kind, of = (d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (index.codes, "id")))
    within = "department" in queries.columns

    def probed(batches):
        for pdf in batches:
            q = unit(np.stack([np.asarray(x, dtype=np.float64) for x in pdf["q"]]))
            near = np.argsort(-(q @ centres.value.T), axis=1, kind="stable")[:, :probes]
            for i in range(len(q)):
                yield pd.DataFrame(
                    {
                        "id": pdf["query_id"].iloc[i], "list": near[i], "scale": 0.0, "code": [q[i].tobytes()] * near.shape[1],
                        **({"department": pdf["department"].iloc[i]} if within else {})
                    }
                )

    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), *(["department"] if within else []))
    lists = asked.mapInPandas(probed, f"id {kind}, list int, scale double, code binary" + (", department string" if within else ""))
    keys = ["list", "department"] if within else ["list"]

    def scored(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        q = np.stack([np.frombuffer(c, np.float64) for c in one["code"]])
        codes = np.stack([np.frombuffer(c, np.int8) for c in two["code"]]) * two["scale"].to_numpy()[:, None]
        s = q @ (codes + centres.value[two["list"].to_numpy()]).T
        out = []
        for i, name in enumerate(one["id"]):
            best = np.argsort(-s[i], kind="stable")[: AGAIN * k]
            out.append(pd.DataFrame({"query_id": name, "id": two["id"].to_numpy()[best], "near": s[i, best], "seen": [len(two), *[0] * (len(best) - 1)]}))
        return pd.concat(out)

    found = met(lists, index.codes, keys, ["id", "list", "scale", "code"], scored, f"query_id {kind}, id {of}, near double, seen long")
    seen = found.groupBy("query_id").agg(F.sum("seen").alias("seen"))
    few = ranked(found.select("query_id", "id", "near"), ["query_id"], [F.col("near").desc(), "id"], AGAIN * k).select("query_id", "id")
    both = few.join(index.vectors.select("id", "v"), "id").join(asked.select("query_id", "q"), "query_id")
    exact = both.select("query_id", "id", F.round(vectors.cosine(F.col("v"), F.col("q")) + 1e-9, 6).alias("score"))
    return ranked(exact, ["query_id"], [F.col("score").desc(), "id"], k), seen

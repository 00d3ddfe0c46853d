"""What the vector operators share: rows of valid vectors, and blocks of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows whose vector isn't null or empty and holds finite numbers only."""
    fine = f"size(`{vec_col}`) > 0 AND forall(`{vec_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return rows.where(fine).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))


def matrix(vectors, kind=np.float64) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=kind) for v in vectors])


def by_length(vectors) -> dict[int, np.ndarray]:
    """Positions of the vectors of each length."""
    lengths = np.array([len(v) for v in vectors])
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}

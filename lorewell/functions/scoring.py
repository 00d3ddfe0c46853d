"""The parts of a BM25 score, and how terms are dealt to the folders of a stored index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: Folders that terms are dealt to.
BUCKETS = 16


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, length: Column, avg_len: Column) -> Column:
    """The part of a score that doesn't depend on how many chunks hold the term."""
    return tf * (vocab.BM25_K1 + 1) / (tf + vocab.BM25_K1 * (1 - vocab.BM25_B + vocab.BM25_B * length / avg_len))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")

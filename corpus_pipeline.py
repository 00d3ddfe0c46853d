"""The training-data pipeline: five stages, each a corpus operator on all that the last one kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import jaccard, line_dedup, packing, passages, quality
from lorewell.llm.common import checkpoint
from lorewell.llm.queries import packing_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars as long as the text is now."""
    return changed.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the others stay as they are.

    A null text is scored as an empty one. Rows that repeat an id are scored each by its own text.
    Without labelled documents of both kinds there is no model, and all stay. Empty tables stay empty."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(*[f"`{c}`" for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; documents of which nothing is left go with them.

    Null, empty and blank texts, from which nothing is taken, stay as they are, and so do null ids.
    Rows of one id and text are one document, changed alike."""
    done = line_dedup.dedup_lines(docs).where("n_lines_removed = 0 OR text RLIKE '\\\\S'")
    return _documents(done, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null and empty texts have no copies and stay; so do rows with a null id. Rows that repeat an id
    stay or go together."""
    groups = jaccard.jaccard_groups(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; documents of which nothing is left go with them.

    Null, empty and blank texts stay as they are, and so do rows with a null id. Rows that repeat an
    id are one document: not compared with each other, each cut where its own words agree."""
    done = passages.dedup_passages(docs).where("n_words_removed = 0 OR text RLIKE '\\\\S'")
    return _documents(done, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens; a null or empty text is its end token alone."""
    pieces = packing.pack_documents(docs, packing_tokenizer())
    return pieces.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", classify),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("packing", pack),
]

#: The classifier, the aligner and the tokenizer can't be written in SQL; tests hold the second to the
#: fourth stage against plain versions, the first against its model's scores and the last against the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; between them, rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            if folder:
                docs.write.parquet(path := f"{folder}/pipeline-{uuid.uuid4().hex}")
                docs = spark.read.parquet(path)
            else:
                docs = checkpoint(docs)
    return docs

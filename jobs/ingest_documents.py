"""Takes new files of documents into the knowledge store: python -m jobs.ingest_documents --config jobs/ingest_documents.json

A file stream with a checkpoint takes each file of the source folder once and ends when all are taken.
A document whose text an earlier one has is left out, wherever that one came from. Of the others,
documents, chunks, pages and marks that wait for compliance are written, each micro-batch into
folders of its own, which a batch that runs again writes over. A second run over the same files
changes nothing; one over more files adds what is new.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import log, main
from lorewell.operators import ingest, knowledge
from lorewell.sources import bindings
from lorewell.streaming import ingest as streaming

SETTINGS = {
    "source": "folder of Parquet files (doc_id, text, lang, source, n_chars), to which files are added",
    "labels": "path of the labels: Parquet (doc_id, toxic), read anew for each batch",
    "output": "folder of the store",
    "checkpoint": "folder of the stream's checkpoint",
    "pattern": "names of the source's files (*.parquet where it is left out)",
    "files_per_batch": "files of a micro-batch at most (64 where it is left out)",
}
SOURCE = "doc_id long, text string, lang string, source string, n_chars long"
DOCUMENTS = "id string, name string, text string, source_tier string, controlled boolean, seq long, sha256 string, tier string, batch long, department string"
TABLES = ("documents", "chunks", "pages", "pending")


def stored(spark: SparkSession, output: str, name: str, schema: str | None = None) -> DataFrame | None:
    """A table of the store; None before anything was written."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(f"{output}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def put(rows: DataFrame, output: str, name: str, batch: int) -> None:
    """Writes a batch's rows of a table, over those of an earlier try of the same batch."""
    rows = rows.withColumn("batch", F.lit(batch).cast("long"))
    by = ["batch", "department"] if "department" in rows.columns else ["batch"]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{output}/{name}")


def take(rows: DataFrame, batch: int, labels: str, output: str) -> dict:
    """Writes what a batch of rows brings that no other batch has brought."""
    spark = rows.sparkSession
    docs = bindings.as_documents(rows, spark.read.parquet(labels))
    before = stored(spark, output, "documents", DOCUMENTS)
    seen = None if before is None else before.where(F.col("batch") != batch)
    put(ingest.classify(ingest.dedup(docs, seen)), output, "documents", batch)
    # all else follows from what was written
    new = stored(spark, output, "documents", DOCUMENTS)
    new = docs.withColumn("tier", F.lit("")).limit(0) if new is None else new.where(F.col("batch") == batch).drop("batch")
    put(ingest.chunks(new), output, "chunks", batch)
    put(ingest.pages(new).join(new.select(F.col("id").alias("doc_id"), "department"), "doc_id"), output, "pages", batch)
    put(knowledge.pending_marks(new), output, "pending", batch)
    return {"read": rows.count(), "kept": new.count()}


def run(spark: SparkSession, source: str, labels: str, output: str, checkpoint: str, pattern: str = "*.parquet", files_per_batch: int | str = 64) -> dict:
    """Takes all files that are new; gives the batches, the rows read and kept in this run, and the rows of the store."""
    told = {"batches": 0, "read": 0, "kept": 0}

    def each(rows: DataFrame, batch: int) -> None:
        got = take(rows, batch, labels, output)
        log.info("batch %d: read %d documents of %s, kept %d in %s", batch, got["read"], source, got["kept"], output)
        told["batches"] += 1
        told["read"] += got["read"]
        told["kept"] += got["kept"]

    files = streaming.source(spark, source, SOURCE, pattern, int(files_per_batch))
    streaming.run_batches(files, each, checkpoint).awaitTermination()
    for name in TABLES:
        rows = stored(spark, output, name)
        told[name] = 0 if rows is None else rows.count()
    log.info("the store in %s holds %s", output, {n: told[n] for n in TABLES})
    return told


def output_of(spark: SparkSession, output: str) -> DataFrame:
    """The documents of a store with how many chunks and pages each gave."""
    docs = stored(spark, output, "documents", DOCUMENTS)
    counted = ingest.contents(docs, chunks=stored(spark, output, "chunks"), pages=stored(spark, output, "pages"))
    return docs.select("id", "department", "tier", "controlled", "sha256").join(counted, "id")


if __name__ == "__main__":
    main(run, __doc__, SETTINGS)

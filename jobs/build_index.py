"""Builds the index that questions are asked of, from all documents: python -m jobs.build_index --config jobs/build_index.json

Writes, under the output folder, chunks, pages, vectors by department, postings with block maxima by a
hash of the term, and the runs of chunks of one department (kinds). A run replaces what the last one wrote, table by table, so that a run
that broke off is mended by the next and a second run changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.command import log, main
from lorewell.sources import bindings
from lorewell.sources.store import TABLES, open_store, write_store

SETTINGS = {
    "documents": "path of the documents: Parquet (doc_id, text, lang, source)",
    "labels": "path of the labels: Parquet (doc_id, toxic); toxic documents are controlled",
    "output": "folder of the index",
    "departments": "only these departments, with commas between; all where it is left out",
}


def run(spark: SparkSession, documents: str, labels: str, output: str, departments: str = "") -> dict:
    """Writes the index; gives the rows read and the rows of each table written."""
    docs = bindings.as_documents(spark.read.parquet(documents), spark.read.parquet(labels), sent=True)
    if departments:
        docs = docs.where(F.col("department").isin(*[d.strip() for d in departments.split(",")]))
    told = {"read": docs.count()}
    log.info("read %d documents of %s", told["read"], documents)
    write_store(docs, output)
    held = open_store(spark, output)
    for name in TABLES:
        told[name] = getattr(held, name).count()
        log.info("wrote %d rows of %s to %s", told[name], name, output)
    return told


def output_of(spark: SparkSession, output: str) -> DataFrame:
    """The postings of an index, as they lie in the folder."""
    return open_store(spark, output).named()


if __name__ == "__main__":
    main(run, __doc__, SETTINGS)

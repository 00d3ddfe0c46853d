"""The stored index: what asking needs of the documents, as Parquet tables of one folder.

Vectors lie by department, postings by a hash of the term. Chunks are numbered as they are written; runs
of numbers are segments, and postings hold, for each term and segment, the list of its chunks. A segment
is made within one task, so that postings aren't shuffled. Kinds tell which numbers of a segment are of
one department and mark of control. Lists also hold the highest weight that the term has in each block
of chunks, so that a search can leave out the blocks that can't reach its best chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import scoring, vectors
from ..operators import ingest
from ..operators.graph import release

#: Chunks of a block, and of a segment, as powers of two.
BLOCK_BITS, SEGMENT_BITS = 7, 14
BLOCK, SEGMENT = 1 << BLOCK_BITS, 1 << SEGMENT_BITS
TABLES = ("chunks", "kinds", "pages", "stats", "postings", "vectors")
#: A list's places in its segment, counts and lengths fit 16 bits: chunks have 500 characters at most.
LISTS = "term string, segment long, n int, place array<smallint>, tf array<smallint>, len array<smallint>, block array<smallint>, most array<double>"


@dataclass(frozen=True)
class Store:
    chunks: DataFrame
    kinds: DataFrame
    pages: DataFrame
    stats: DataFrame
    lists: DataFrame
    vectors: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(bucket, term, no, block, tf, len): a row for each chunk of each term."""
        no = F.col("segment") * SEGMENT + F.col("place")
        rows = self.lists.select("bucket", "term", "segment", F.inline(F.arrays_zip("place", "tf", "len")))
        return rows.select("bucket", "term", no.alias("no"), F.shiftright(no, BLOCK_BITS).alias("block"), "tf", "len")

    def kept(self, rows: DataFrame) -> DataFrame:
        """Rows with the department and the mark of control (department, controlled) of the chunks that they number (no)."""
        kinds = self.kinds.select(F.col("segment").alias("_segment"), "department", "controlled", "first", "last")
        own = (F.shiftright("no", SEGMENT_BITS) == F.col("_segment")) & F.col("no").between(F.col("first"), F.col("last"))
        return rows.join(kinds, own).drop("_segment", "first", "last")

    @property
    def terms(self) -> DataFrame:
        """(bucket, term, df)"""
        return self.lists.groupBy("bucket", "term").agg(F.sum("n").alias("df"))

    @property
    def blocks(self) -> DataFrame:
        """(bucket, term, block, most): the highest weight of a term in the chunks of a block."""
        rows = self.lists.select("bucket", "term", "segment", F.inline(F.arrays_zip("block", "most")))
        return rows.select("bucket", "term", (F.col("segment") * (SEGMENT // BLOCK) + F.col("block")).alias("block"), "most")

    def named(self) -> DataFrame:
        """(term, chunk_id, department, controlled, len, tf): postings with the ids of their chunks, which meet segment by segment."""

        def flat(lists: pa.Table, ids: pa.Table) -> pa.Table:
            at = np.zeros(SEGMENT, dtype=np.int64)
            at[ids["place"].to_numpy()] = np.arange(len(ids))
            rows = pa.array(np.repeat(np.arange(len(lists)), lists["n"].to_numpy()))
            every = {c: pa.concat_arrays([x.flatten() for x in lists[c].chunks]).to_numpy() for c in ("place", "tf", "len")}
            own = ids.select(["chunk_id", "department", "controlled"]).take(pa.array(at[every["place"]]))
            return pa.table({"term": lists["term"].take(rows), "chunk_id": own["chunk_id"], "department": own["department"], "controlled": own["controlled"], "len": every["len"].astype(np.int32), "tf": every["tf"].astype(np.int64)})

        ids = self.chunks.select(F.shiftright("no", SEGMENT_BITS).alias("segment"), (F.col("no") % SEGMENT).cast("int").alias("place"), "chunk_id", "department", "controlled")
        lists = self.lists.select("segment", "term", "n", "place", "tf", "len")
        return lists.groupBy("segment").cogroup(ids.groupBy("segment")).applyInArrow(flat, "term string, chunk_id string, department string, controlled boolean, len int, tf long")


def hashed_vectors(chunks: DataFrame) -> DataFrame:
    """(chunk_id, controlled, department, len, v): numbers of tokens and hashed embeddings.

    v holds twice each sum, which is whole, in 16 bits: a sum is at most as large as its chunk is long."""

    def made(batches):
        hashed = vectors.Hashed()
        for b in batches:
            v, sizes = hashed.matrix(b["text"].to_pylist())
            codes = [c.tobytes() for c in (2 * v).astype("<i2")]
            yield pa.RecordBatch.from_arrays(
                [b["chunk_id"], b["controlled"], b["department"], pa.array(sizes.astype(np.int32)), pa.array(codes, pa.binary())], ["chunk_id", "controlled", "department", "len", "v"]
            )

    rows = chunks.where("text IS NOT NULL").select("chunk_id", "text", "controlled", "department")
    return rows.mapInArrow(made, "chunk_id string, controlled boolean, department string, len int, v binary")


def inverted(avg_len: float) -> Callable:
    """Rows (no, text) as the lists of each run of rows in one segment."""
    token = re.compile("[A-Za-z0-9]+|[一-鿿]")

    def listed(segment: int, places: np.ndarray, texts: list) -> pa.RecordBatch:
        words = [token.findall(t or "") for t in texts]
        length = np.fromiter(map(len, words), np.int64, len(words))
        known: dict[str, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(words)), np.int64, int(length.sum()))
        chunk = np.repeat(np.arange(len(texts)), length)
        # in the order of term and chunk
        key, tf = np.unique(ids * len(texts) + chunk, return_counts=True)
        lists, chunk = np.divmod(key, max(1, len(texts)))
        new = np.diff(lists, prepend=-1) != 0
        starts = np.flatnonzero(new)
        place, size = places[chunk], length[chunk]
        block = place // BLOCK
        first = np.flatnonzero(new | (np.diff(block, prepend=-1) != 0))
        # a little more than the sums of a search can come to, so that rounding leaves no block out
        weights = scoring.weight(tf, size, avg_len) * (1 + 1e-9)
        most = np.maximum.reduceat(weights, first) if len(first) else weights
        offsets = pa.array(np.append(starts, len(key)).astype(np.int32))
        bounds = pa.array(np.append(np.searchsorted(first, starts), len(first)).astype(np.int32))
        of = lambda at, values: pa.ListArray.from_arrays(at, pa.array(values.astype(np.int16)))
        made = {
            "term": pa.array(list(known), pa.string()).take(pa.array(lists[starts])),
            "segment": pa.array(np.full(len(starts), segment, dtype=np.int64)), "n": pa.array(np.diff(np.append(starts, len(key))).astype(np.int32)),
            "place": of(offsets, place), "tf": of(offsets, tf), "len": of(offsets, size), "block": of(bounds, block[first]), "most": pa.ListArray.from_arrays(bounds, pa.array(most))
        }
        return pa.RecordBatch.from_pydict(made)

    def made(batches):
        segment, places, texts = -1, [], []
        for b in batches:
            at, place = np.divmod(b["no"].to_numpy(), SEGMENT)
            text = b["text"].to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if at[i] != segment and texts:
                    yield listed(segment, np.concatenate(places), texts)
                    places, texts = [], []
                segment = int(at[i])
                places.append(place[i:j])
                texts += text[i:j]
        if texts:
            yield listed(segment, np.concatenate(places), texts)

    return made


def write_store(docs: DataFrame, path: str) -> None:
    """Writes the tables for docs (id, name, text, source_tier, controlled, department, seq) under ``path``.

    Each table replaces the one before; a run after one that broke off, or a second run, gives the same.
    Nothing but the number of chunks and their mean length reaches the driver."""
    spark = docs.sparkSession

    def put(name: str, rows: DataFrame, *by: str) -> DataFrame:
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{path}/{name}")
        return opened(spark, f"{path}/{name}")

    # chunks of a kind are neighbours, so that few rows tell the kinds of a segment
    laid = ingest.chunks(docs.sortWithinPartitions("department", "controlled"))
    chunks = put("chunks", laid.withColumn("no", F.monotonically_increasing_id()))
    runs = chunks.groupBy(F.shiftright("no", SEGMENT_BITS).alias("segment"), "department", "controlled")
    kinds = put("kinds", runs.agg(F.min("no").alias("first"), F.max("no").alias("last"), F.count(F.lit(1)).alias("n")))
    if kinds.where("last - first + 1 != n").limit(1).count():
        raise RuntimeError("chunks weren't numbered in the order of their departments")
    put("pages", ingest.pages(ingest.classify(docs)))
    # what joins of the documents have shuffled goes from the disk
    release(spark)
    held = put("vectors", hashed_vectors(chunks), "department")
    _, avg_len = put("stats", held.agg(F.count(F.lit(1)).alias("n"), (F.sum("len") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_len"))).first()
    lists = chunks.select("no", F.lower("text").alias("text")).mapInArrow(inverted(avg_len or 1.0), LISTS)
    put("postings", lists.withColumn("bucket", scoring.bucket_of(F.col("term"))).sortWithinPartitions("bucket", "term", "segment"), "bucket")


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A table whose department is a string, whatever its values look like in the names of folders."""
    schema = spark.read.parquet(path).schema
    if "department" in schema.names:
        schema["department"].dataType = StringType()
    return spark.read.schema(schema).parquet(path)


def open_store(spark: SparkSession, path: str) -> Store:
    held = {t: opened(spark, f"{path}/{t}") for t in TABLES}
    return Store(lists=held.pop("postings"), **held)

"""The facade: one object over the stores that ingests, asks, runs actions and reads as of a time."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governed, ingest, knowledge, retrieval
from ..operators.graph import checkpoint, merge_components, shared_folder
from ..sources import objects
from ..sources.store import Store, open_store, write_store

#: What a batch of documents gives; each is written once and read from there.
MADE = ("docs", "chunks", "pages", "entities", "relations")


@dataclass
class Engine:
    """Every write is a batch of Parquet folders under ``path`` and makes a new version, under which answers are
    cached. ``path`` is new for each engine if none is given. Objects are a log that is folded on reading."""

    spark: SparkSession
    path: str = ""
    observations: DataFrame | None = None
    made: dict[str, DataFrame] = field(default_factory=dict)
    labels: DataFrame | None = None
    log: list[DataFrame] = field(default_factory=list)
    appended: dict[str, list[DataFrame]] = field(default_factory=dict)
    version: int = 0
    cache: dict = field(default_factory=dict)
    index: tuple[int, Store] | None = None

    def __post_init__(self):
        self.path = self.path or f"{shared_folder(self.spark)}/engine-{uuid.uuid4().hex}"

    docs = property(lambda self: self.made.get("docs"))
    chunks = property(lambda self: self.made.get("chunks"))
    pages = property(lambda self: self.made.get("pages"))
    entities = property(lambda self: self.made.get("entities"))
    relations = property(lambda self: self.made.get("relations"))

    def _written(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows of this version, read back from where they were written; with those of earlier versions in ``made``."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/version={self.version}")
        own = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/version={self.version}")
        self.made[name] = own if name not in self.made else self.made[name].unionByName(own)
        return own

    def _changed(self) -> None:
        self.version += 1
        self.cache.clear()

    def ingest(self, docs: DataFrame) -> dict[str, DataFrame]:
        """Adds the documents that are new; returns what this batch gave, with objects, links, pending
        marks, what it created and merged, and the communities that it touched."""
        seen = self.docs.select("sha256") if self.docs is not None else None
        existing = checkpoint(self.objects().select("id"))
        new = self._written("docs", ingest.classify(ingest.dedup(docs, seen)))
        parts = {"chunks": ingest.chunks, "pages": ingest.pages, "entities": ingest.entities, "relations": ingest.relations}
        made = {"docs": new} | {name: self._written(name, make(new)) for name, make in parts.items()}
        writes, links, pending = knowledge.governed_writes(made["entities"], made["relations"], new)
        objects.append(writes, self.path, self.version)
        named = writes.withColumn("doc_id", F.get("doc_ids", F.lit(0)))
        counts = checkpoint(governed.ingest_counts(new, named, links, existing))
        edges = made["relations"].select(F.col("src").alias("a"), F.col("dst").alias("b"))
        self.labels, touched = merge_components(self.labels if self.labels is not None else self.spark.createDataFrame([], "node string, component string"), edges)
        self._changed()
        return made | {"objects": writes, "links": links, "pending": pending, "stats": ingest.stats(docs, new), "counts": counts, "touched": touched}

    def store(self) -> Store:
        """The stored index of this version, written when it is first asked for."""
        if self.index is None or self.index[0] != self.version:
            write_store(self.docs.drop("tier", "sha256"), at := f"{self.path}/index-{self.version}")
            self.index = self.version, open_store(self.spark, at)
        return self.index[1]

    def ask(self, questions: DataFrame, scorer=None, generate=None) -> DataFrame:
        """Answers to questions (query_id, query, role); global ones from communities of entities."""
        held = self.store()
        if self.labels is None:
            return retrieval.ask(questions, held.chunks, held.pages, store=held, scorer=scorer, generate=generate)
        summaries = knowledge.community_summaries(self.communities(), self.entities.select(F.col("name").alias("node"), "type").dropDuplicates(["node"]))

        def contexts(asked: DataFrame) -> DataFrame:
            found = knowledge.global_communities(asked, knowledge.community_postings(self.communities(), summaries), summaries)
            return found.select("query_id", "rank", F.col("summary").alias("text"))

        return retrieval.ask(questions, held.chunks, held.pages, store=held, global_contexts=contexts, scorer=scorer, generate=generate)

    def ask_one(self, query: str, role: str = "analyst", department: str | None = None) -> dict:
        """One question, in one department or all, cached until the next write."""
        key = (role, department, query, self.version)
        if key not in self.cache:
            asked = self.spark.createDataFrame([(1, query, role, department)], "query_id int, query string, role string, department string")
            self.cache[key] = self.ask(asked).first().asDict()
        return self.cache[key]

    def run_actions(self, log: DataFrame) -> DataFrame:
        """Decisions of a log of actions; what was executed is appended to the stores and audited."""
        decided = checkpoint(knowledge.decide(log))
        for name, rows in governed.appended(decided).items():
            if name == "objects":
                objects.append(rows, self.path, self.version)
            else:
                self.appended.setdefault(name, []).append(rows)
        self.log.append(knowledge.audit(decided))
        self._changed()
        return decided

    def objects(self) -> DataFrame:
        """The objects that ingests and actions have made, those controlled that were marked."""
        held = objects.state(self.spark, self.path)
        marks = self.appended.get("marks", [])
        for rows in marks:
            marked = rows.select(F.col("entity_id").alias("id"), F.lit(True).alias("_marked")).distinct()
            held = held.join(marked, "id", "left").withColumn("controlled", F.col("controlled") | F.coalesce("_marked", F.lit(False))).drop("_marked")
        return held

    def compact(self) -> None:
        """Folds the log of objects into a snapshot."""
        objects.compact(self.spark, self.path)

    def asof(self, year: int) -> tuple[DataFrame, DataFrame]:
        return knowledge.as_of(self.observations, year), knowledge.truth(self.observations)

    def communities(self) -> DataFrame:
        """(node, community) of all entities: as relations link them, others alone."""
        names = self.entities.select(F.col("name").alias("node")).distinct()
        return names.join(self.labels, "node", "full").select("node", F.coalesce("component", "node").alias("community"))

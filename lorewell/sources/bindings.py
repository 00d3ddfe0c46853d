"""The given tables as the engine's: documents, sectioned pages, observations, actions, status events, objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many ids of controlled documents are sent to all tasks.
SENT = 1 << 20


def as_documents(documents: DataFrame, labels: DataFrame, sent: bool = False) -> DataFrame:
    """(id, name, text, source_tier, controlled, department, seq) of rows (doc_id, text, lang, source) and labels (doc_id, toxic).

    With ``sent`` the labels are read first, and the ids of controlled documents are sent to the documents
    if there are few, so that texts aren't shuffled to meet them."""
    toxic = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if sent and (marked := toxic.where("toxic = 1")).limit(SENT + 1).count() <= SENT:
        toxic = F.broadcast(marked)
    tier = F.element_at(F.array(F.lit("official"), F.lit("analyst"), F.lit("rumor")), F.substring("source", 4, 10).cast("int") % 3 + 1)
    name = F.concat("source", F.lit("_"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.join(toxic, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        name.alias("name"),
        "text",
        tier.alias("source_tier"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("controlled"),
        F.col("source").alias("department"),
        F.col("doc_id").alias("seq"),
    )


def documents(spark: SparkSession, sf_dir: str, sent: bool = False) -> DataFrame:
    return as_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sent)


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of HTML as documents whose headings are marked: (id, name, text, source_tier, controlled, department, seq)."""
    marked = F.regexp_replace(F.regexp_replace("html", r"(?i)<h[1-3][^>]*>", "\n# "), r"<[^>]*>", "\n")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.col("url").alias("name"), marked.alias("text"), F.lit("analyst").alias("source_tier"),
        F.lit(False).alias("controlled"), F.lit("web").alias("department"), F.col("page_id").alias("seq")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("obj_id"), F.date_format("ts", "yyyy-MM-dd").alias("valid_time"), F.col("event_id").alias("seq"), "value")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda d, c: F.element_at(F.create_map(*[F.lit(x) for p in d.items() for x in p]), c)
    kinds = {"click": "review", "view": "create_link", "purchase": "revise-capacity", "signup": "mark", "error": "drop-all"}
    role = F.element_at(F.array(*[F.lit(r) for r in ("viewer", "analyst", "strategy", "compliance")]), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), of(kinds, F.col("event_type")).alias("action"), role.alias("role"), (F.col("event_id") % 2 == 0).alias("confirmed"),
        F.when(F.col("event_id") % 5 == 0, "rumor").otherwise("official").alias("source_tier"), F.lit(None).cast("string").alias("current_status"), F.lit(None).cast("string").alias("new_status"), F.lit(False).alias("correction"),
        F.col("user_id").cast("string").alias("actor"), F.create_map(F.lit("id"), F.col("user_id").cast("string"), F.lit("value"), F.col("value").cast("string")).alias("params"),
    )


def order_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log of the actions that events don't name: objects made and merged, roadmaps advanced, pages corrected and promoted."""
    kinds = ("create_object", "advance-roadmap", "correct", "merge", "promote")
    states = F.array(*map(F.lit, ("development", "risk", "HVM", "EOL")))
    at = lambda values, n: F.get(values, n.cast("int"))
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    params = F.create_map(F.lit("id"), text(who % 500), F.lit("title"), F.concat(F.lit("object "), text(key)), F.lit("objectType"), F.col("o_orderstatus"), F.lit("aliases"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"),
        at(F.array(*map(F.lit, kinds)), F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("action"),
        at(F.array(*map(F.lit, ("viewer", "analyst", "strategy", "compliance"))), who % 4).alias("role"),
        (key % 2 == 0).alias("confirmed"),
        F.lit("official").alias("source_tier"),
        at(states, key % 4).alias("current_status"),
        at(states, F.floor(key / 4) % 4).alias("new_status"),
        (who % 7 == 0).alias("correction"),
        text(who).alias("actor"),
        params.alias("params"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a history of states O -> F -> P."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("node"), F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("seq"),
        F.lit(False).alias("correction"), "o_orderkey"
    )

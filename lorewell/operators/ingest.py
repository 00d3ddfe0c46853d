"""From documents to chunks, pages, entities and relations; each step is one plan over all documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def dedup(docs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The first document (by seq) of each fingerprint, without those whose fingerprint is in ``seen``."""
    marked = docs.withColumn("sha256", T.fingerprint(F.col("text")))
    first = marked.groupBy("sha256").agg(F.min("seq").alias("seq"))
    kept = marked.join(first, ["sha256", "seq"], "left_semi")
    return kept.join(seen.select("sha256").distinct(), "sha256", "left_anti") if seen is not None else kept


def classify(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tier", T.tier(F.col("name"), F.col("text"), F.col("source_tier")))


def sectioned(docs: DataFrame) -> DataFrame:
    """docs with (ord, section, body): a row for each section."""
    keep = [c for c in docs.columns if c != "text"]
    return docs.select(*keep, F.posexplode(T.sections(F.col("text"))).alias("ord", "s")).select(*keep, "ord", F.col("s.title").alias("section"), F.col("s.body").alias("body"))


def overwritten(docs: DataFrame) -> DataFrame:
    """sectioned() with ``later``: the length of the longest later section of the same title in the
    document, null if there is none. Sections are compared within their row, without a shuffle, and
    only where a title repeats."""
    keep = [c for c in docs.columns if c != "text"]
    held = docs.select(*keep, T.sections(F.col("text")).alias("all"))
    held = held.withColumn("titles", F.transform("all", lambda s: s["title"])).withColumn("again", F.size(F.array_distinct("titles")) < F.size("titles"))
    longest = lambda s, i: F.array_max(F.transform(F.filter("all", lambda t, j: (j > i) & (t["title"] == s["title"])), lambda t: F.length(t["body"])))
    parts = F.transform("all", lambda s, i: F.struct(s["title"].alias("section"), s["body"].alias("body"), F.when(F.col("again"), longest(s, i)).alias("later")))
    return held.select(*keep, F.posexplode(parts).alias("ord", "s")).select(*keep, "ord", "s.section", "s.body", "s.later")


def chunks(docs: DataFrame, size: int = 500, overlap: int = 80) -> DataFrame:
    """(chunk_id, doc_id, parent_id, section, pos, text, ...): windows over sections; of equal ids (a
    title and place that repeat in a document) the last stays. Ids of documents are unique."""
    keep = [c for c in ("source_tier", "controlled", "department", "seq", "name") if c in docs.columns]
    starts = F.filter(T.windows(F.col("body"), size, overlap), lambda at: F.col("later").isNull() | (at > T.last_window(F.col("later"), size, overlap)))
    cut = overwritten(docs).select(F.col("id").alias("doc_id"), *keep, "section", "body", F.explode(starts).alias("pos"))
    return cut.select(
        T.stable_id(F.col("doc_id"), F.col("section"), F.col("pos")).alias("chunk_id"), "doc_id",
        T.stable_id(F.col("doc_id"), F.col("section")).alias("parent_id"), "section", "pos", F.substring("body", F.col("pos") + 1, F.lit(size)).alias("text"),
        *keep
    )


def pages(classified: DataFrame) -> DataFrame:
    """(page_id, doc_id, title, summary, body, section) of the documents of tiers A and B; of sections with one title the last stays."""
    rows = overwritten(classified.where("tier != 'C'")).where("later IS NULL")
    return rows.select(
        T.stable_id(F.col("id"), F.col("section")).alias("page_id"), F.col("id").alias("doc_id"),
        F.when(F.col("section") == "", F.col("name")).otherwise(F.col("section")).alias("title"), F.substring("body", 1, 160).alias("summary"), "body",
        "section"
    )


def page_entities(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """(page_id, entity_id): the entities of a page's document whose name its body contains."""
    both = pages.select("page_id", "doc_id", "body").join(entities.select("doc_id", "entity_id", "name"), "doc_id")
    return both.where(F.contains("body", F.col("name"))).select("page_id", "entity_id").distinct()


def contents(docs: DataFrame, **parts: DataFrame) -> DataFrame:
    """docs (id) with n_<part>: how many rows of each of ``parts`` (doc_id) a document gave, 0 if none."""
    out = docs.select("id")
    for name, rows in parts.items():
        own = rows.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(own, "id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the highest order: last write wins."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


#: Ranks of a pattern or name; a rank tells its type.
RANKS = 10_000_000


def occurrences(rows: DataFrame, patterns: tuple = vocab.ENTITY_PATTERNS, names: tuple = vocab.COMPANIES, body: str = "body") -> DataFrame:
    """rows with (rank, name): patterns in order, matches in order, then listed names."""
    def matches(k: int, pattern: str):
        one = lambda m, i: F.struct((F.lit(k).cast("long") * RANKS + i).alias("rank"), m.alias("name"))
        return F.transform(F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(0)), one)

    found = [matches(k, p) for k, (p, _) in enumerate(patterns)]
    found += [
        F.when(
            F.contains(F.col(body), F.lit(n)),
            F.array(F.struct((F.lit(len(patterns) + k).cast("long") * RANKS).alias("rank"), F.lit(n).alias("name")))
        ).otherwise(F.array().cast("array<struct<rank:bigint,name:string>>")) for k, n in enumerate(names)
    ]
    base = [c for c in rows.columns if c != body]
    return rows.select(*base, F.explode(reduce(F.concat, found)).alias("m")).select(*base, "m.rank", "m.name")


def type_of(rank: Column, patterns: tuple = vocab.ENTITY_PATTERNS, names: tuple = vocab.COMPANIES) -> Column:
    kinds = F.array(*[F.lit(t) for _, t in patterns], *[F.lit("Company") for _ in names])
    return F.get(kinds, F.floor(rank / RANKS).cast("int"))


def mentions(rows: DataFrame, patterns: tuple = vocab.ENTITY_PATTERNS, names: tuple = vocab.COMPANIES, body: str = "body") -> DataFrame:
    """rows with (rank, name, type): the first of occurrences() of each name. A rank alone is aggregated, which takes no sort."""
    out = occurrences(rows, patterns, names, body)
    base = [c for c in out.columns if c not in ("rank", "name")]
    return out.groupBy(*base, "name").agg(F.min("rank").alias("rank")).select(*base, "rank", "name", type_of(F.col("rank"), patterns, names).alias("type"))


def entities(classified: DataFrame, **vocabulary) -> DataFrame:
    """(doc_id, entity_id, name, type): each name once for each document of tiers A and B, the first type kept."""
    m = occurrences(sectioned(classified.where("tier != 'C'")).select(F.col("id").alias("doc_id"), "ord", "body"), **vocabulary)
    # section and rank as one number, which is aggregated without a sort
    place = F.col("ord").cast("long") * 10**12 + F.col("rank")
    first = m.groupBy("doc_id", "name").agg(F.min(place).alias("place"))
    kinds = {k: v for k, v in vocabulary.items() if k in ("patterns", "names")}
    return first.select("doc_id", T.stable_id(F.lit("ent"), F.col("name")).alias("entity_id"), "name", type_of(F.col("place") % 10**12, **kinds).alias("type"))


def relations(classified: DataFrame, **vocabulary) -> DataFrame:
    """(src, dst, lt, doc_id): pairs of entities of one section, in the order of their ranks."""
    m = mentions(sectioned(classified.where("tier != 'C'")).select(F.col("id").alias("doc_id"), "ord", "body"), **vocabulary)
    listed = m.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b["rank"] > a["rank"]), lambda b: F.struct(a["name"].alias("src"), b["name"].alias("dst")))))
    return listed.select("doc_id", F.explode(pairs).alias("p")).select("p.src", "p.dst", F.lit("co_occurs").alias("lt"), "doc_id")


def stats(all_docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(tier, n) of what is kept, with the number of deduplicated documents as tier 'deduped'."""
    by_tier = kept.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    gone = all_docs.agg(F.count(F.lit(1)).alias("a")).crossJoin(kept.agg(F.count(F.lit(1)).alias("b"))).select(F.lit("deduped").alias("tier"), (F.col("a") - F.col("b")).alias("n"))
    return by_tier.unionByName(gone)

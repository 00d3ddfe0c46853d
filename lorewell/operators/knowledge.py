"""The governed side: stores as folds over logs, bitemporal reads, actions, verdicts, graph and resolution."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import security, vocab
from ..functions import text as T
from .graph import connected_components
from .retrieval import ranked
from .scans import running_sum

# --- stores ---------------------------------------------------------------------------------


def fold_objects(writes: DataFrame, escalate: bool = False) -> DataFrame:
    """Objects from a log (id, seq, title, object_type, aliases, doc_ids, controlled): the first write
    makes the object, later ones add aliases in order and documents; ``escalate`` also takes over controlled."""
    g = writes.groupBy("id").agg(
        F.min_by("title", "seq").alias("title"), F.min_by("object_type", "seq").alias("object_type"), F.min_by("controlled", "seq").alias("first_controlled"),
        F.bool_or("controlled").alias("any_controlled"), F.array_sort(F.collect_list(F.struct("seq", "aliases"))).alias("a"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("doc_ids")))).alias("doc_ids"), F.count(F.lit(1)).alias("writes")
    )
    return g.select(
        "id", "title", "object_type", F.array_distinct(F.flatten(F.transform("a", lambda x: x["aliases"]))).alias("aliases"), "doc_ids",
        F.col("any_controlled" if escalate else "first_controlled").alias("controlled"), "writes"
    )


def link_view(links: DataFrame) -> DataFrame:
    """Links once each, with how often they were written."""
    return links.groupBy("src", "dst", "lt").agg(F.count(F.lit(1)).alias("times"))


def object_with_links(objects: DataFrame, links: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Objects with their out-links, and facts, as sorted arrays (empty if none)."""
    out = objects.join(links.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct("lt", "dst"))).alias("links")), "id", "left")
    if facts is not None:
        out = out.join(facts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "value", "controlled"))).alias("facts")), "id", "left")
    return out


def versions(writes: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key, with version = number of writes."""
    w = Window.partitionBy(key)
    return writes.withColumn("version", F.count(F.lit(1)).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.col(order).desc()))).where("_rn = 1").drop("_rn")


def tail(log: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The newest n entries of a log."""
    return log.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness: the check behind a unique constraint."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def mark_controlled(objects: DataFrame, pages: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects with a marked id, and pages with a marked id or document, become controlled."""
    m = marked.select(F.col("entity_id").alias("_m")).distinct()
    o = objects.join(m, F.col("id") == F.col("_m"), "left").withColumn("controlled", F.col("controlled") | F.col("_m").isNotNull()).drop("_m")
    # the two equalities are two joins rather than one with OR, which would be a nested loop
    p = pages.join(m, F.col("page_id") == F.col("_m"), "left").withColumnRenamed("_m", "_a").join(m, F.col("doc_id") == F.col("_m"), "left")
    return o, p.withColumn("controlled", F.col("controlled") | F.col("_a").isNotNull() | F.col("_m").isNotNull()).drop("_a", "_m")


def bumped_confidence(facts: DataFrame, bumps: DataFrame) -> DataFrame:
    """Confidence after all bumps (id, delta > 0): the sum, at most 1."""
    total = bumps.groupBy("id").agg(F.sum("delta").alias("d"))
    return facts.join(total, "id", "left").withColumn("confidence", F.least(F.lit(1.0), F.coalesce("confidence", F.lit(vocab.FACT_CONFIDENCE)) + F.coalesce("d", F.lit(0.0)))).drop("d")


# --- bitemporal reads -------------------------------------------------------------------------


def superseded(observations: DataFrame) -> DataFrame:
    """Adds superseded_by: the next observation of the same object and valid time."""
    return observations.withColumn("superseded_by", F.lead("seq").over(Window.partitionBy("obj_id", "valid_time").orderBy("seq")))


def as_of(observations: DataFrame, year: int) -> DataFrame:
    """The latest observation of each object valid in or before the year (superseded ones count)."""
    return observations.where(F.try_to_number(F.substring("valid_time", 1, 4), F.lit("9999")) <= year).groupBy("obj_id").agg(F.max(F.struct("valid_time", "seq", "value")).alias("o")).select(
        "obj_id", "o.valid_time", "o.seq", "o.value"
    )


def as_of_at(observations: DataFrame, times: DataFrame) -> DataFrame:
    """As-of join: for every (obj_id, at) the latest observation with valid_time <= at, else nulls."""
    both = observations.select(
        "obj_id", F.col("valid_time").alias("at"), "seq", "value", F.lit(0).alias("k")
    ).unionByName(times.select("obj_id", "at", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("k")))
    w = Window.partitionBy("obj_id").orderBy("at", "k", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(
        "o", F.last(F.when(F.col("k") == 0, F.struct("at", "seq", "value")), ignorenulls=True).over(w)
    ).where("k = 1").select("obj_id", "at", F.col("o.at").alias("valid_time"), F.col("o.value").alias("value"))


def truth(observations: DataFrame) -> DataFrame:
    """The latest observation of each object that nothing supersedes."""
    return superseded(observations).where("superseded_by IS NULL").groupBy("obj_id").agg(F.max(F.struct("valid_time", "seq", "value")).alias("o")).select("obj_id", "o.valid_time", "o.seq", "o.value")


def status_latest(events: DataFrame) -> DataFrame:
    return events.groupBy("node").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def fsm_violations(events: DataFrame, edges: dict[str, str]) -> DataFrame:
    """Events whose status doesn't follow from the node's last one, corrections aside."""
    allowed = F.create_map(*[F.lit(x) for pair in edges.items() for x in pair])
    before = events.withColumn("before", F.lag("status").over(Window.partitionBy("node").orderBy("seq")))
    return before.where(F.col("before").isNotNull() & ~F.coalesce(F.col("correction"), F.lit(False)) & ~(F.coalesce(F.try_element_at(allowed, F.col("before")), F.lit("")) == F.col("status")))


# --- actions ----------------------------------------------------------------------------------


def decide(log: DataFrame) -> DataFrame:
    """Adds decision to rows (action, role, confirmed, source_tier, current_status, new_status, correction)."""
    known = F.col("action").isin(*vocab.ACTIONS)
    permitted, sandboxed = F.lit(False), F.lit(False)
    for action, (roles, sandbox) in vocab.ACTIONS.items():
        permitted = permitted | ((F.col("action") == action) & F.col("role").isin(*roles))
        sandboxed = sandboxed | ((F.col("action") == action) & F.lit(sandbox))
    nxt = F.create_map(*[F.lit(x) for pair in vocab.NEXT_STATUS.items() for x in pair])
    skips = (F.col("action") == "advance-roadmap") & ~F.coalesce(F.col("correction"), F.lit(False)) & ~F.try_element_at(nxt, F.col("current_status")).eqNullSafe(F.col("new_status"))
    rumor = (F.col("action") == "revise-capacity") & (F.col("source_tier") == "rumor")
    decision = F.when(~known, "unknown_action").when(~permitted, "permission_denied").when(skips, "invalid_transition").when(rumor, "rumor_rejected").when(
        sandboxed & ~F.col("confirmed"), "pending_review"
    ).otherwise("executed")
    return log.withColumn("decision", decision)


def audit(decided: DataFrame) -> DataFrame:
    """An audit record for each executed action, with the hash of its parameters."""
    params = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params"))))
    return decided.where("decision = 'executed'").select("seq", "action", "role", "actor", F.lit(1).alias("schema_version"), params.alias("params"), F.sha2(params, 256).alias("params_hash"))


def applied(decided: DataFrame) -> DataFrame:
    """(id, controlled, confidence, capacity, links): what executed actions make of the object that their
    parameters name: marks control it, each review raises its confidence, the last revision sets its
    capacity, links are counted. Actions that weren't executed change nothing."""
    done = decided.where("decision = 'executed'").withColumn("id", F.try_element_at("params", F.lit("id"))).where("id IS NOT NULL")
    of = lambda action: F.col("action") == action
    value = F.try_element_at("params", F.lit("value")).try_cast("double")
    return done.groupBy("id").agg(
        F.bool_or(of("mark")).alias("controlled"),
        F.least(F.lit(1.0), vocab.FACT_CONFIDENCE + 0.03 * F.count_if(of("review"))).alias("confidence"),
        F.max_by(F.when(of("revise-capacity"), value), F.when(of("revise-capacity"), F.col("seq"))).alias("capacity"),
        F.count_if(of("create_link")).alias("links"),
    )


def governed_writes(entities: DataFrame, relations: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an ingest commits: object candidates, link candidates and pending marks of controlled documents."""
    objects = entities.join(docs.select(F.col("id").alias("doc_id"), "source_tier", "controlled", "seq"), "doc_id").select(
        F.col("entity_id").alias("id"), "seq", F.col("name").alias("title"), F.col("type").alias("object_type"),
        F.array().cast("array<string>").alias("aliases"), F.array("doc_id").alias("doc_ids"), "controlled", "source_tier"
    )
    return objects, relations, pending_marks(docs)


def pending_marks(docs: DataFrame) -> DataFrame:
    """(entity_id, doc, reason): controlled documents, whose mark waits for compliance."""
    return docs.where("controlled").select(F.col("id").alias("entity_id"), F.col("name").alias("doc"), F.lit("controlled document ingested").alias("reason"))


# --- verdicts ---------------------------------------------------------------------------------


def apply_verdicts(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Facts (object_id, key, confidence) with the judge's verdicts (object_id, key, drop, valid_type,
    supported, delta, and seq where one key may have several: the last counts) applied: adds confidence
    and band (object_dropped, dropped, pending, keep)."""
    objects = verdicts.groupBy("object_id").agg(F.bool_or(F.col("drop") | ~F.col("valid_type")).alias("gone"))
    order = F.col("seq") if "seq" in verdicts.columns else F.lit(0)
    last = verdicts.where("key IS NOT NULL").groupBy("object_id", "key").agg(F.max(F.struct(order.alias("seq"), "supported", "delta")).alias("l"))
    v = last.select("object_id", "key", "l.supported", "l.delta")
    joined = facts.join(v, ["object_id", "key"], "left").join(objects, "object_id", "left")
    base = F.coalesce("confidence", F.lit(vocab.FACT_CONFIDENCE))
    moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + F.coalesce("delta", F.lit(0.0))))
    c = F.when(F.col("supported").isNull(), base).when(F.col("supported"), moved).otherwise(F.least(moved, F.lit(vocab.UNSUPPORTED_MOST)))
    band = F.when(F.coalesce("gone", F.lit(False)), "object_dropped").when(c < vocab.DROP_BELOW, "dropped").when(c < vocab.KEEP_FROM, "pending").otherwise("keep")
    return joined.select("object_id", "key", band.alias("band"), F.bround(c, 3).alias("confidence"))


def review_counts(applied: DataFrame) -> DataFrame:
    """(objects_in, objects_kept, objects_dropped, facts_dropped, facts_pending)."""
    one = applied.groupBy("object_id").agg(
        F.max(F.col("band").isin("keep", "pending").cast("int")).alias("kept"), F.sum((F.col("band") == "dropped").cast("int")).alias("d"),
        F.sum((F.col("band") == "pending").cast("int")).alias("p")
    )
    return one.agg(
        F.count(F.lit(1)).alias("objects_in"), F.sum("kept").alias("objects_kept"), (F.count(F.lit(1)) - F.sum("kept")).alias("objects_dropped"),
        F.sum("d").alias("facts_dropped"), F.sum("p").alias("facts_pending")
    )


def parse_reply(reply: Column) -> Column:
    """The outermost {...} of a model's reply as struct(objects, links); null if there are no objects."""
    schema = "objects array<struct<id:string,type:string>>, links array<struct<lt:string,`from`:string,`to`:string>>"
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), schema)
    return F.when(F.size(parsed["objects"]) >= 0, parsed)


# --- graph ------------------------------------------------------------------------------------


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def khop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node): what the start nodes reach in at most so many hops, themselves left out."""
    both, seen = symmetric(edges), start.select("node").distinct()
    frontier = seen
    for _ in range(hops):
        frontier = frontier.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.union(frontier)
    return seen.join(start.select("node"), "node", "left_anti")


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community): the smallest node that edges reach; isolated nodes are their own."""
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    ends = nodes.select("node").union(edges.select("src")).union(edges.select("dst")).where("node IS NOT NULL").distinct()
    return ends.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


#: Members that a model is told to summarise a community.
TOLD = 64


def community_summaries(labels: DataFrame, types: DataFrame | None = None, only: DataFrame | None = None, summariser: Callable[[list[str], int], str] | None = None) -> DataFrame:
    """(community, members, types, summary): counts, sorted types and the first eight members; of the
    communities in ``only`` (community), as after merge_components(), where it is given. A
    ``summariser`` is told the first TOLD members and how many there are."""
    if only is not None:
        labels = labels.join(only.select("community").distinct(), "community", "left_semi")
    rows = labels.join(types, "node", "left") if types is not None else labels.withColumn("type", F.lit(None).cast("string"))
    g = rows.groupBy("community").agg(
        F.countDistinct("node").alias("members"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
        F.slice(F.array_sort(F.collect_set("node")), 1, TOLD).alias("told")
    ).withColumn("first", F.slice("told", 1, 8))
    if summariser is not None:
        model = F.pandas_udf(lambda m, n: pd.Series([summariser([str(x) for x in a], int(b)) for a, b in zip(m, n)], dtype=object), "string")
        return g.select("community", "members", "types", model(F.transform("told", lambda x: x.cast("string")), "members").alias("summary"))
    text = F.concat(
        F.lit("社区"), F.col("community").cast("string"), F.lit("："), F.col("members").cast("string"), F.lit(" 实体，类型 "), F.col("types"), F.lit("。成员："),
        F.array_join(F.transform("first", lambda x: x.cast("string")), ", ")
    )
    return g.select("community", "members", "types", text.alias("summary"))


def top_communities(questions: DataFrame, summaries: DataFrame, k: int = vocab.COMMUNITIES) -> DataFrame:
    """(query_id, community, confidence, rank): the summaries that score best for each global question."""
    scored = summaries.crossJoin(F.broadcast(questions.select("query_id", "query"))).withColumn("score", F.round(T.rerank_score(T.rerank_parts(F.col("query"), F.col("summary"))) + 1e-9, 6))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "community")
    best = scored.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}").withColumn("rank", F.col("rank") - 1)
    return best.select("query_id", "community", F.bround(F.least(F.lit(1.0), "score"), 3).alias("confidence"), "rank")


def community_postings(labels: DataFrame, summaries: DataFrame) -> DataFrame:
    """(community, term, tf, first, last): how often, and where first and last, a term occurs in a community's
    summary followed by the names of all its members in order.

    Members are numbered over ranges, so that a community may have any number of them; its text is
    never put together."""
    told = summaries.select("community", T.tokens(F.col("summary")).alias("t"))
    head = told.select("community", F.posexplode("t").alias("place", "term"))
    named = labels.select("community", "node", T.tokens(F.col("node").cast("string")).alias("t")).withColumn("n", F.size("t"))
    placed = running_sum(named, "community", ["node"], "n", "upto").join(told.select("community", F.size("t").alias("start")), "community")
    tail = placed.select(
        "community", (F.col("start") + F.col("upto") - F.col("n")).alias("at"), F.posexplode("t").alias("i", "term")
    ).select("community", (F.col("at") + F.col("i")).alias("place"), "term")
    every = head.unionByName(tail)
    return every.groupBy("community", "term").agg(F.count(F.lit(1)).alias("tf"), F.min("place").alias("first"), F.max("place").alias("last"))


def global_communities(questions: DataFrame, postings: DataFrame, summaries: DataFrame, k: int = vocab.COMMUNITIES) -> DataFrame:
    """(query_id, community, summary, score, confidence, rank): the k communities whose summaries and members
    score best for each question.

    Questions meet only communities that hold one of their terms; those that hold none score 0 and
    follow by their number, so that some of the smallest are enough."""
    asked = questions.select("query_id", T.tokens(F.col("query")).alias("q"))
    terms = asked.select("query_id", F.size("q").alias("terms"), F.explode("q").alias("term"))
    rare = (F.col("term").rlike(r"^[a-z]?\d") | (F.length("term") <= 2)).cast("int")
    terms = terms.groupBy("query_id", "terms", "term").agg(F.count(F.lit(1)).alias("times")).withColumn("rare", rare * F.col("times"))
    rares = terms.groupBy("query_id").agg(F.sum("rare").alias("rare"))
    met = terms.withColumnRenamed("rare", "r").join(postings, "term").groupBy("query_id", "terms", "community").agg(
        F.sum("times").alias("covered"), F.sum("r").alias("rare_hits"), F.sum("tf").alias("hits"), (F.max("last") - F.min("first") + 1).alias("span")
    )
    parts = met.join(rares, "query_id").withColumn("span", F.when(F.col("hits") >= 2, F.col("span")).otherwise(0)).withColumn("length", F.lit(1))
    score = F.round(T.rerank_score({c: F.col(c) for c in ("covered", "terms", "rare_hits", "rare", "hits", "span", "length")}) + 1e-9, 6)
    best = ranked(parts.select("query_id", "community", score.alias("score")), ["query_id"], [F.col("score").desc(), "community"], k).drop("rank")
    # at most k communities of the 2 k smallest have been met already
    rest = questions.select("query_id").crossJoin(F.broadcast(summaries.select("community").orderBy("community").limit(2 * k)))
    rest = rest.join(best.select("query_id", "community"), ["query_id", "community"], "left_anti").withColumn("score", F.lit(0.0))
    top = ranked(best.unionByName(rest), ["query_id"], [F.col("score").desc(), "community"], k)
    return top.join(summaries.select("community", "summary"), "community").select("query_id", "community", "summary", "score", F.bround(F.least(F.lit(1.0), "score"), 3).alias("confidence"), "rank")


# --- resolution -------------------------------------------------------------------------------


def resolve_aliases(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(entity_id, canonical_id): the first entity (by seq) of each lower-case name, or what a manual
    alias (alias, canonical_id) names; types are ignored."""
    keyed = entities.withColumn("key", F.lower("name"))
    first = keyed.groupBy("key").agg(F.min_by("entity_id", "seq").alias("canonical_id"))
    if aliases is not None:
        manual = aliases.select(F.lower("alias").alias("key"), F.col("canonical_id").alias("manual"))
        first = first.join(manual, "key", "left").select("key", F.coalesce("manual", "canonical_id").alias("canonical_id"))
    return keyed.join(first, "key").select("entity_id", "canonical_id")


def field_security(facts: DataFrame, roles: DataFrame) -> DataFrame:
    """Every fact as every role sees it: (…, role, display, masked)."""
    both = facts.crossJoin(F.broadcast(roles.select("role")))
    return both.withColumn("m", security.masked(F.col("role"), F.col("value"), F.col("controlled"))).withColumn("display", F.col("m.display")).withColumn("masked", F.col("m.masked")).drop("m")

"""The governed write side: outcomes of writes, what executed actions append, and objects as roles may see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

ROLES = ("viewer", "analyst", "strategy", "compliance")


def write_outcomes(writes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``writes`` (id, seq, ...) with outcome: the first write of an id that ``existing`` (id) doesn't hold
    creates the object, all others merge into it.

    The first of each id is found by aggregation, so that an id that many writes name is combined
    before it moves; it is joined back on (id, seq), by which rows are spread."""
    firsts = writes.groupBy("id").agg(F.min("seq").alias("seq"))
    if existing is not None:
        firsts = firsts.join(existing.select("id").distinct(), "id", "left_anti")
    return writes.join(firsts.withColumn("outcome", F.lit("created")), ["id", "seq"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("merged")))


def ingest_counts(docs: DataFrame, objects: DataFrame, links: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(id, objects_created, objects_merged, links_committed) of each document (id): what its object writes
    (id, seq, doc_id) and links (doc_id) come to."""
    done = write_outcomes(objects, existing).groupBy(F.col("doc_id").alias("id")).agg(
        F.count_if(F.col("outcome") == "created").alias("objects_created"), F.count_if(F.col("outcome") == "merged").alias("objects_merged")
    )
    linked = links.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("links_committed"))
    return docs.select("id").join(done, "id", "left").join(linked, "id", "left").fillna(0)


def param(name: str) -> Column:
    return F.try_element_at("params", F.lit(name))


def executed(decided: DataFrame, action: str) -> DataFrame:
    return decided.where((F.col("decision") == "executed") & (F.col("action") == action))


def appended(decided: DataFrame) -> dict[str, DataFrame]:
    """What the executed actions of a log (seq, action, params, decision) append, by table.

    Nothing is overwritten: objects, links, marks, statuses, capacities and reviews are logs whose
    folds are the state. correct, merge and promote are audited and append nothing."""
    none = F.array().cast("array<string>")
    new = executed(decided, "create_object")
    title = F.coalesce(param("title"), param("id"))
    return {
        "objects": new.select(
            param("id").alias("id"), "seq", title.alias("title"), param("objectType").alias("object_type"),
            F.coalesce(F.split(param("aliases"), ","), none).alias("aliases"), none.alias("doc_ids"), F.lit(False).alias("controlled")
        ),
        "links": executed(decided, "create_link").select("seq", param("src").alias("src"), param("dst").alias("dst"), F.coalesce(param("lt"), F.lit("related")).alias("lt")),
        "marks": executed(decided, "mark").select("seq", param("id").alias("entity_id")),
        "statuses": executed(decided, "advance-roadmap").select("seq", param("id").alias("node"), F.col("new_status").alias("status")),
        "capacities": executed(decided, "revise-capacity").select("seq", param("id").alias("obj_id"), param("value").try_cast("double").alias("value"), "source_tier"),
        "reviews": executed(decided, "review").select("seq", param("id").alias("id"), F.lit(0.03).alias("delta")),
    }


def results(decided: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(seq, action, result) of the executed actions, as they are told to the caller and the audit log."""
    done = decided.where("decision = 'executed'")
    made = write_outcomes(appended(decided)["objects"].select("id", "seq"), existing).select("seq", "outcome")
    told = {
        "create_object": F.concat_ws(" ", "outcome", param("id")),
        "create_link": F.concat(F.lit("linked "), param("src"), F.lit("->"), param("dst")),
        "mark": F.concat(F.lit("marked "), param("id")),
        "advance-roadmap": F.concat(F.lit("advanced "), param("id"), F.lit(" to "), F.col("new_status")),
        "revise-capacity": F.concat(F.lit("revised "), param("id")),
        "review": F.concat(F.lit("reviewed "), param("id")),
    }
    result = F.concat(F.lit("noop "), F.col("action"))
    for action, text in told.items():
        result = F.when(F.col("action") == action, text).otherwise(result)
    return done.join(made, "seq", "left").select("seq", "action", result.alias("result"))


# --- objects as roles see them ------------------------------------------------------------------

#: Rules that a policy table may hold; each becomes a branch of one expression.
RULES_MOST = 1000


def policy(rules: DataFrame) -> Column:
    """How a role sees a field ('clear', 'summary', 'masked', 'hidden'), by rules (role, key, controlled, see).

    A null in a rule matches anything; of the rules that match the most specific counts, then the
    strictest, and what no rule names is hidden. The few rules are compiled to one expression over
    the columns role, key and controlled, so that no row is joined with them."""
    held = rules.select("role", "key", "controlled", "see").limit(RULES_MOST + 1).collect()
    if len(held) > RULES_MOST:
        raise ValueError(f"a policy has {RULES_MOST} rules at most")
    strict = ["hidden", "masked", "summary", "clear"]
    held.sort(key=lambda r: (-sum(r[c] is not None for c in ("role", "key", "controlled")), strict.index(r["see"])))
    see = None
    for r in held:
        fits = F.lit(True)
        for c in ("role", "key", "controlled"):
            if r[c] is not None:
                fits = fits & (F.col(c) == F.lit(r[c]))
        see = F.when(fits, r["see"]) if see is None else see.when(fits, r["see"])
    return F.lit("hidden") if see is None else see.otherwise("hidden")


def object_view(facts: DataFrame, roles: DataFrame, see: Column, actions: dict = vocab.ACTIONS) -> DataFrame:
    """(id, role, facts, n_masked, n_hidden, filtered, actions): every object as every role sees it.

    ``facts`` are rows (id, key, value, controlled). Facts are 'key=display', by key; hidden ones go
    and are counted, masked and summarised ones are counted, filtered says whether either is there;
    actions are those that the role may run. Facts are combined by object and role where they lie."""
    seen = facts.crossJoin(F.broadcast(roles.select("role"))).withColumn("see", see)
    display = F.when(F.col("see") == "clear", F.col("value")).when(
        F.col("see") == "summary", F.concat(F.lit(vocab.SUMMARY_PREFIX), F.substring("value", 1, 8), F.lit(vocab.ELLIPSIS))
    ).when(F.col("see") == "masked", F.lit(vocab.MASKED))
    shown = seen.withColumn("told", F.concat_ws("=", "key", display))
    out = shown.groupBy("id", "role").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("see") != "hidden", F.col("told")))), "; ").alias("facts"),
        F.count_if(F.col("see").isin("masked", "summary")).alias("n_masked"),
        F.count_if(F.col("see") == "hidden").alias("n_hidden"),
    )
    may = F.lit("")
    for role in ROLES:
        may = F.when(F.col("role") == role, ",".join(a for a, (who, _) in actions.items() if role in who)).otherwise(may)
    return out.select("*", ((F.col("n_masked") > 0) | (F.col("n_hidden") > 0)).alias("filtered"), may.alias("actions"))

"""Personal data by bootstrapped contextual extraction (operator 11), in SQL functions throughout.

Base rules find e-mail and IP addresses, card and phone numbers. They are the seeds: the words around
them are lexical patterns, and the identifiers in these contexts, known or not, are the patterns'
instances. Rounds over the graph of patterns and instances score a pattern by the share of its
instances that are known or believed to be of its kind, and an instance by the patterns that hold it.
Instances that reach the threshold are personal data wherever they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bound
from .common import checkpoint, fresh, spread_join, without

KINDS = ("email", "ip", "card", "phone")
#: A character without which a kind can't occur, and its pattern. Runs are possessive and begin where no
#: match ends or no run is cut, so that long texts take linear time and no stack; matches are those of SQL_RULES.
RULES = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SQL_RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|\z)){4}\z"
#: What may be an identifier: a word with a digit or @, and words after it that begin with a digit.
SPACE = r"\x20\x09-\x0D"
CANDIDATE = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+(?:\x20[().+-]*+[0-9][^{SPACE}]*+)*+"
SQL_CANDIDATE = rf"[^{SPACE}0-9@]*[0-9@][^{SPACE}]*(?:\x20[().+-]*[0-9][^{SPACE}]*)*"
#: Characters of a candidate at most, with what it has around it, characters of a value, digits of one without @, characters of context.
RAW_MOST, VALUE_LEAST, VALUE_MOST, DIGITS_LEAST, CONTEXT = 128, 6, 64, 4, 64
#: Different seeds that a pattern needs, its confidence and an instance's in thousandths, the most that an instance reaches, what each further pattern adds, rounds.
SEEDS, PATTERN_FROM, INSTANCE_FROM, BELIEF_MOST, BONUS, ROUNDS = 5, 700, 750, 950, 25, 3
STEP = 256


def running_sums(numbers: Column) -> Column:
    """Running sums of an array in two levels, so that none of them goes over all that is before it."""
    def whole(n: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(n) - 1, F.lit(0)), F.lit(STEP)), lambda b: F.aggregate(F.slice(n, b + 1, F.lit(STEP)), F.lit(0), lambda s, x: s + x))
        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("before"))
        before = F.aggregate(parts, start, lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["before"], a["s"]).alias("before")), lambda a: a["before"])
        own = lambda i: F.aggregate(F.slice(n, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP + 1), F.lit(0), lambda s, x: s + x)
        return bound(before, lambda b: F.transform(n, lambda _, i: F.get(b, F.floor(i / STEP).cast("int")) + own(i)))

    return bound(numbers, whole)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, start>, ...> and what lies between: struct(m, gaps, starts) of the matches from left to right; starts count code points from 0."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    moved = lambda b: F.transform(b["m"], lambda _, i: F.when(i == 0, 0).otherwise(F.length(F.get(b["m"], i - 1))) + F.length(F.get(b["gaps"], i)))
    return bound(both, lambda b: F.struct(b["m"].alias("m"), b["gaps"].alias("gaps"), running_sums(moved(b)).alias("starts")))


def holds(kind: str, m: Column) -> Column:
    """Whether a match of a kind's pattern is one of the kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(BYTE_PARTS)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    value = lambda c, i: F.when(i % 2 == 1, F.translate(c, "0123456789", "0246813579")).otherwise(c).cast("int")
    luhn = lambda d: F.aggregate(F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), value), F.lit(0), lambda s, x: s + x) % 10 == 0
    return bound(digits, lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


SPANS = "array<struct<k:int,start:int,end:int>>"


def spans_of(k: int, text: Column) -> Column:
    """array<struct<k, start, end>> of one kind, from left to right."""
    sign, pattern = RULES[KINDS[k]]
    span = lambda m, start: F.struct(F.lit(k).alias("k"), start.alias("start"), (start + F.length(m)).alias("end"))
    kept = lambda b: F.array_compact(F.zip_with(b["m"], b["starts"], lambda m, s: F.when(holds(KINDS[k], m), span(m, s))))
    return F.when(F.contains(text, F.lit(sign)), bound(matches(text, pattern), kept)).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """All that the base rules find, by kind and start."""
    return F.concat(*[spans_of(k, text) for k in range(len(KINDS))])


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def kind_of(value: Column) -> Column:
    """The kind of a value that the base rules know, -1 if there are several, null if none."""
    has = lambda kind: F.exists(F.regexp_extract_all(value, F.lit(RULES[kind][1]), F.lit(0)), lambda m: holds(kind, m))
    return bound(F.array_compact(F.array(*[F.when(has(kind), F.lit(k)) for k, kind in enumerate(KINDS)])), lambda a: F.when(F.size(a) > 1, -1).otherwise(F.get(a, F.lit(0))))


def candidates(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, start, end, value, kind, w1, w2, r1): values that may be identifiers, with two words before and one after."""
    cut = docs.where(text.rlike("[0-9@]")).select(*keep, matches(text, CANDIDATE).alias("b"))
    around = lambda b, m, i: F.struct(
        m.alias("m"), F.get(b["starts"], i).alias("at"),
        F.right(F.concat(F.coalesce(F.right(F.get(b["m"], i - 1), F.lit(CONTEXT)), F.lit("")), F.get(b["gaps"], i)), F.lit(CONTEXT)).alias("before"),
        F.left(F.concat(F.left(F.get(b["gaps"], i + 1), F.lit(CONTEXT)), F.coalesce(F.left(F.get(b["m"], i + 1), F.lit(CONTEXT)), F.lit(""))), F.lit(CONTEXT)).alias("after"),
    )
    rows = cut.select(*keep, F.explode(F.transform("b.m", lambda m, i: F.when(F.length(m) <= RAW_MOST, around(F.col("b"), m, i)))).alias("c")).where("c IS NOT NULL").select(*keep, "c.*")
    lead = rows.withColumn("own", F.regexp_replace("m", r"^[^A-Za-z0-9+]++", ""))
    cores = lead.withColumn("start", F.col("at") + F.length("m") - F.length("own")).withColumn("value", F.regexp_replace("own", r"(?<=[A-Za-z0-9])[^A-Za-z0-9]++\z", ""))
    enough = F.contains("value", F.lit("@")) | (F.length(F.regexp_replace("value", "[^0-9]", "")) >= DIGITS_LEAST)
    cores = cores.where(F.length("value").between(VALUE_LEAST, VALUE_MOST) & enough)
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[0-9]", "0"), rf"[{SPACE}]+"), lambda w: w != "")
    cores = cores.withColumn("lw", words(F.col("before"))).withColumn("rw", words(F.col("after")))
    return cores.select(
        *keep, "start", (F.col("start") + F.length("value")).alias("end"), F.lower("value").alias("value"), kind_of(F.col("value")).alias("kind"),
        F.try_element_at("lw", F.lit(-1)).alias("w1"), F.try_element_at("lw", F.lit(-2)).alias("w2"), F.get("rw", F.lit(0)).alias("r1")
    )


def discovered(seen: DataFrame) -> DataFrame:
    """(value, k) of the unknown values among candidates (value, kind, w1, w2, r1) that patterns make personal data.

    A pattern is the word before a value, the two before, or the one before and the one after. Edges
    and scores are aggregations with map-side combining; frequent patterns and values are spread."""
    patterns = F.array(F.concat(F.lit("1 "), "w1"), F.concat(F.lit("2 "), "w2", F.lit(" "), "w1"), F.concat(F.lit("3 "), "w1", F.lit(" _ "), "r1"))
    edges = seen.select(F.explode(F.array_compact(patterns)).alias("pattern"), "value", F.coalesce("kind", F.lit(-2)).alias("kind")).distinct()
    counts = edges.groupBy("pattern").agg(*[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(len(KINDS))], F.count_if(F.col("kind") > -2).alias("known"), F.count(F.lit(1)).alias("count"))
    best = F.array_max(F.array(*[F.struct(F.col(f"n{k}").alias("seeds"), F.lit(-k).alias("k")) for k in range(len(KINDS))])).alias("b")
    held = counts.select("pattern", best, "known", (F.col("count") - F.col("known")).alias("unknown")).select("pattern", "b.seeds", (-F.col("b.k")).alias("k"), "known", "unknown")
    # the share of the kind among what is known has to do by itself
    held = checkpoint(held.where(f"seeds >= {SEEDS} AND 1000 * seeds >= {PATTERN_FROM} * known AND unknown > 0"))
    open_edges = checkpoint(spread_join(edges.where("kind = -2").select("pattern", "value"), held.select("pattern", "k"), "pattern", counts=held.select("pattern", F.col("unknown").alias("count"))))
    beliefs = None
    for _ in range(ROUNDS):
        if beliefs is None:
            scored = held.withColumn("more", F.lit(0))
        else:
            found = spread_join(open_edges, beliefs.select("value", F.col("k").alias("kb"), "belief"), "value").where("k = kb")
            scored = held.join(found.groupBy("pattern").agg(F.sum("belief").alias("more")), "pattern", "left").fillna(0, ["more"])
        score = F.expr("(2 * (1000 * seeds + more)) div (2 * known + unknown + 2)")
        sure = checkpoint(scored.select("pattern", score.alias("score")).where(f"score >= {PATTERN_FROM}"))
        each = spread_join(open_edges, sure, "pattern").groupBy("value", "k").agg(F.max("score").alias("most"), F.count(F.lit(1)).alias("n"))
        belief = F.least(F.lit(BELIEF_MOST), F.col("most") + BONUS * (F.col("n") - 1)).cast("long")
        best = F.max(F.struct(belief.alias("belief"), (-F.col("k")).alias("k")))
        beliefs = checkpoint(each.groupBy("value").agg(best.alias("b")).select("value", "b.belief", (-F.col("b.k")).alias("k")))
    return beliefs.where(f"belief >= {INSTANCE_FROM}").select("value", "k")


def find_personal_data(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the text, with n_email, n_ip, n_card and n_phone (base spans of each kind), n_found
    (spans that the method adds), base_sha256 and spans.

    Spans are kind:start:end, by kind and start, comma-joined; places are code points. A null or
    empty text has none. Rows that repeat an id or a text stay rows of their own; ids may be null.
    A value that occurs anywhere in a sure context counts at each of its places, unless the base
    rules find something in it. Long values (over VALUE_MOST characters) aren't identifiers. An
    empty table gives an empty one. Columns with the names that are added are replaced."""
    added = [*[f"n_{k}" for k in KINDS], "n_found", "base_sha256", "spans"]
    base = without(docs, *added)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key, spans, more = fresh(base, "_key", "_spans", "_more")
    keyed = base.withColumn(key, F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.lit(" "), text)))
    seen = checkpoint(candidates(keyed, text, key))
    values = discovered(seen)
    places = spread_join(seen.where("kind IS NULL").select(key, "start", "end", "value"), values, "value")
    found = places.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("k", "start", "end"))).alias(more), F.count(F.lit(1)).alias("count"))
    found = checkpoint(found)
    # texts stay where they are: only keys and spans cross the shuffle
    own = keyed.select(*[f"`{c}`" for c in base.columns if c != text_col], key, base_spans(text).alias(spans))
    out = spread_join(own, found.drop("count"), key, "left", counts=found.select(key, "count"))
    of = lambda k: F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    extra = F.coalesce(F.col(more), F.array().cast(SPANS))
    return out.select(
        *[f"`{c}`" for c in base.columns if c != text_col], *map(of, range(len(KINDS))), F.size(extra).cast("long").alias("n_found"),
        F.sha2(written(F.col(spans)), 256).alias("base_sha256"), written(F.array_sort(F.concat(spans, extra))).alias("spans")
    )


def _sql_matches(source: str, name: str, pattern: str) -> str:
    """Rows (doc_id, i, m, gap, start) of the matches in the texts of ``source``."""
    return rf"""{name}_l AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM {source}),
{name}_r AS (SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(m) AS m, m AS l, g FROM {name}_l),
{name} AS (SELECT *, sum(length(g[i]) + CASE WHEN i = 1 THEN 0 ELSE length(l[i - 1]) END) OVER (PARTITION BY doc_id ORDER BY i) AS start FROM {name}_r)"""


_DIGITS = "regexp_replace(%s, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: (CASE WHEN i % 2 = 0 THEN translate(c, '0123456789', '0246813579') ELSE c END)::INT)) % 10 = 0".replace("% 2", "%% 2").replace("% 10", "%% 10")
_HOLDS = {"email": "true OR %s IS NULL", "ip": f"regexp_matches(%s, '{BYTE_PARTS}')", "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", "phone": f"length({_DIGITS}) BETWEEN 9 AND 15"}


def _valid(kind: str, m: str) -> str:
    return "(" + _HOLDS[kind].replace("%s", m).replace("%%", "%") + ")"


_KIND = ", ".join(f"CASE WHEN len(list_filter(regexp_extract_all(value, '{SQL_RULES[k]}'), lambda x: {_valid(k, 'x')})) > 0 THEN {i} END" for i, k in enumerate(KINDS))
_WORDS = rf"list_filter(string_split_regex(regexp_replace(lower(%s), '[0-9]', '0', 'g'), '[{SPACE}]+'), lambda w: w != '')"
_BEST = "CASE " + " ".join(f"WHEN n{i} = greatest(n0, n1, n2, n3) THEN {i}" for i in range(len(KINDS))) + " END"


def _sql_round(r: int) -> str:
    more = f"(SELECT coalesce(sum(b.belief), 0) FROM free o JOIN beliefs{r - 1} b ON b.value = o.value AND b.k = o.k WHERE o.pattern = h.pattern)" if r else "0"
    return f"""sure{r} AS (SELECT pattern, (2 * (1000 * seeds + {more})) // (2 * known + unknown + 2) AS score FROM held h),
beliefs{r} AS (SELECT value, k, belief FROM (SELECT o.value, o.k, least({BELIEF_MOST}, max(s.score) + {BONUS} * (count(*) - 1))::BIGINT AS belief FROM free o JOIN sure{r} s ON s.pattern = o.pattern WHERE s.score >= {PATTERN_FROM} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY value ORDER BY belief DESC, k) = 1)"""


#: ids are unique in documents
PERSONAL_DATA_SQL = rf"""
WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(_sql_matches("src", k, SQL_RULES[k]) for k in KINDS)},
base AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS k, '{k}' AS kind, start, start + length(m) AS stop FROM {k} WHERE {_valid(k, 'm')}" for i, k in enumerate(KINDS))}),
{_sql_matches("src", "cand", SQL_CANDIDATE)},
around AS (
  SELECT doc_id, m, start, right(coalesce(right(l[i - 1], {CONTEXT}), '') || g[i], {CONTEXT}) AS before, left(left(g[i + 1], {CONTEXT}) || coalesce(left(l[i + 1], {CONTEXT}), ''), {CONTEXT}) AS after
  FROM cand WHERE length(m) <= {RAW_MOST}),
cores AS (SELECT *, start + length(m) - length(own) AS pos, regexp_replace(own, '[^A-Za-z0-9]+\z', '') AS value FROM (SELECT *, regexp_replace(m, '^[^A-Za-z0-9+]+', '') AS own FROM around)),
typed AS (
  SELECT doc_id, pos, pos + length(value) AS stop, lower(value) AS value, list_filter([{_KIND}], lambda x: x IS NOT NULL) AS ks, {_WORDS % 'before'} AS lw, {_WORDS % 'after'} AS rw FROM cores
  WHERE length(value) BETWEEN {VALUE_LEAST} AND {VALUE_MOST} AND (contains(value, '@') OR length({_DIGITS % 'value'}) >= {DIGITS_LEAST})),
seen AS (SELECT *, CASE WHEN len(ks) > 1 THEN -1 WHEN len(ks) = 1 THEN ks[1] ELSE -2 END AS kind FROM typed),
edges AS (
  SELECT DISTINCT pattern, value, kind FROM (
    SELECT unnest(['1 ' || lw[-1], '2 ' || lw[-2] || ' ' || lw[-1], '3 ' || lw[-1] || ' _ ' || rw[1]]) AS pattern, value, kind FROM seen) WHERE pattern IS NOT NULL),
counts AS (SELECT pattern, {", ".join(f"count(*) FILTER (kind = {i}) AS n{i}" for i in range(len(KINDS)))}, count(*) FILTER (kind > -2) AS known, count(*) FILTER (kind = -2) AS unknown FROM edges GROUP BY pattern),
held AS (SELECT pattern, greatest(n0, n1, n2, n3) AS seeds, {_BEST} AS k, known, unknown FROM counts WHERE greatest(n0, n1, n2, n3) >= {SEEDS} AND 1000 * greatest(n0, n1, n2, n3) >= {PATTERN_FROM} * known AND unknown > 0),
free AS (SELECT e.pattern, e.value, h.k FROM edges e JOIN held h USING (pattern) WHERE e.kind = -2),
{", ".join(_sql_round(r) for r in range(ROUNDS))},
more AS (SELECT DISTINCT s.doc_id, b.k, (['email', 'ip', 'card', 'phone'])[b.k + 1] AS kind, s.pos AS start, s.stop FROM seen s JOIN beliefs{ROUNDS - 1} b USING (value) WHERE s.kind = -2 AND b.belief >= {INSTANCE_FROM}),
b AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {i}) AS n_{k}" for i, k in enumerate(KINDS))}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS told FROM base GROUP BY doc_id),
a AS (SELECT doc_id, count(*) FILTER (new) AS n_found, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS told FROM (SELECT *, false AS new FROM base UNION ALL SELECT *, true FROM more) GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, coalesce(n_found, 0) AS n_found, sha256(coalesce(b.told, '')) AS base_sha256, coalesce(a.told, '') AS spans
FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""

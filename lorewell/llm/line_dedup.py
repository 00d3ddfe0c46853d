"""Line dedup by content-defined chunks of lines (operator 6), in SQL functions throughout.

A rolling hash over the hashes of the last lines decides where a chunk ends, so that an insertion
moves only the boundaries near it. Chunks of two or more lines that occur again anywhere are
removed but for their first occurrence, once all texts under one hash have been found equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, spread_join, without

#: Lines in the rolling window; one of DIVISOR hashes is a boundary, which makes chunks of some four lines.
WINDOW, DIVISOR = 3, 2


def _chunks(docs: DataFrame, text_col: str) -> DataFrame:
    """(id, mark, k, first, n, chunk) of every chunk; k counts from 0, first from 1."""
    rolled = lambda back: " + ".join(f"coalesce(get(h, i - {j + 1 + back}), 0) * {31**j}" for j in range(WINDOW))
    # no boundary follows another at once, nor the first line, so that chunks have two lines at least
    bound = f"({rolled(0)}) % {DIVISOR} = 0 AND ({rolled(1)}) % {DIVISOR} != 0"
    lines = docs.selectExpr("doc_id AS id", f"md5(`{text_col}`) AS mark", f"split(`{text_col}`, '\\n', -1) AS lines").where("mark IS NOT NULL")
    ends = lines.selectExpr("*", "transform(lines, l -> cast(conv(substr(md5(l), 1, 8), 16, 10) AS bigint)) AS h").selectExpr(
        "id", "mark", "lines", f"filter(sequence(1, size(lines)), i -> i = size(lines) OR ({bound})) AS ends"
    )
    cut = ends.selectExpr("id", "mark", "lines", "posexplode(transform(ends, (e, j) -> struct(coalesce(get(ends, j - 1), 0) + 1 AS first, e AS last))) AS (k, c)")
    return cut.selectExpr("id", "mark", "k", "c.first AS first", "c.last - c.first + 1 AS n", "array_join(slice(lines, c.first, c.last - c.first + 1), '\\n') AS chunk")


def dedup_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with repeated multi-line chunks taken out of the text, and n_lines_removed.

    The first occurrence, by (doc_id, md5 of the text, place), stays. Chunks of a single line and of
    white space only stay too. A null text stays null, an empty one empty; a text of which nothing
    is left becomes empty. Rows with equal doc_id and text are one document: all stay, changed
    alike. doc_id may be null. Other columns are kept, whatever their names; one named
    n_lines_removed is replaced. An empty table gives an empty one. All steps are aggregations and
    equi-joins on hashes or documents: a chunk that is everywhere is counted before the shuffle, and
    its rows are dealt to many tasks in the join on it."""
    base = without(docs, "n_lines_removed")
    chunks = _chunks(base, text_col).where("n > 1 AND chunk RLIKE '\\\\S'").withColumn("hash", F.expr("unhex(md5(chunk))"))
    place = F.struct("id", "mark", "k")
    # equal smallest and largest text: all texts under the hash are the same bytes
    keepers = chunks.groupBy("hash").agg(F.min(place).alias("keep"), F.max(place).alias("last"), F.min("chunk").alias("low"), F.max("chunk").alias("high"), F.count(F.lit(1)).alias("count"))
    keepers = checkpoint(keepers.where("keep != last AND low = high").select("hash", "keep", "count"))
    again = spread_join(chunks.select("hash", "id", "mark", "k", "first", "n"), keepers.select("hash", "keep"), "hash", counts=keepers)
    i, mark, spans, own = fresh(base, "_id", "_marked", "_spans", "_mark")
    gone = again.where(~place.eqNullSafe(F.col("keep"))).groupBy(F.col("id").alias(i), F.col("mark").alias(mark)).agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias(spans))
    joined = base.withColumn(own, F.md5(F.col(f"`{text_col}`"))).join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(mark)), "left")
    # the lines before, between and after the spans, which are in order and apart; the text is split once
    after, start = f"get({spans}, j - 1)", f"get({spans}, j).first"
    from_, to = f"coalesce({after}.first + {after}.n, 1)", f"coalesce({start}, size(ls) + 1)"
    pieces = f"transform(sequence(0, size({spans})), j -> slice(ls, {from_}, {to} - {from_}))"
    left = F.expr(f"transform(array(split(`{text_col}`, '\\n', -1)), ls -> array_join(flatten({pieces}), '\\n'))[0]")
    return joined.select(
        *[F.when(F.col(spans).isNull(), F.col(f"`{c}`")).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in base.columns],
        F.coalesce(F.expr(f"aggregate({spans}, 0L, (a, s) -> a + s.n)"), F.lit(0)).cast("long").alias("n_lines_removed"),
    )


_ROLLED = " + ".join(f"coalesce(lag(h, {j}) OVER (PARTITION BY doc_id ORDER BY i), 0) * {31**j}" if j else "h" for j in range(WINDOW))
#: ids are unique in documents, so that here a place is (doc_id, chunk)
DEDUP_LINES_SQL = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
b AS (SELECT *, ({_ROLLED}) % {DIVISOR} = 0 AS hit FROM h),
r AS (SELECT *, CASE WHEN hit AND NOT lag(hit, 1, true) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS e FROM b),
c AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
chunks AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) AS rn FROM chunks WHERE n > 1 AND regexp_matches(chunk, '\S')),
gone AS (SELECT doc_id, k, n FROM ranked WHERE rn > 1),
left_over AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM c
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = c.doc_id AND g.k = c.k) GROUP BY doc_id),
counted AS (SELECT doc_id, sum(n)::BIGINT AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, coalesce(g.n, 0)::BIGINT AS n_lines_removed
FROM documents d LEFT JOIN left_over o USING (doc_id) LEFT JOIN counted g USING (doc_id)
"""

"""Chat formatting with collapse of cumulative snapshots (operator 2), in DataFrame functions.

Logs often hold a conversation again each time it has grown. A rolling hash over its turns gives
every conversation the hashes of its prefixes; one whose hash is that of a proper prefix of another
is dropped by an anti-join, equal ones keep the smallest id, and what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations among rows (conv_id, turn, role, text).

    Turns sort by (turn, role, text), nulls first; repeated rows count once. A null role is
    rendered as "user", a null text as empty. Rows without conv_id are left out. Other columns are
    ignored. An empty table gives an empty one. Equality of turns is that of 128-bit hashes over
    places and contents, which roll: the hash of a prefix is that of the one before it, xor the
    hash of its last turn at its place. So a conversation of any length is sorted and read once;
    only kept ones are gathered in a row each, as their rendering has to be. Prefixes are made
    distinct before they are joined, so a first turn that many share is one row there."""
    said = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    row = F.struct("turn", "role", "text")
    once = said.withColumn("n", F.dense_rank().over(in_order)).withColumn("again", F.lag(row).over(in_order).eqNullSafe(row)).where("NOT again")
    own = [F.xxhash64(F.lit(seed), "n", F.length("role"), "role", "text") for seed in (1, 2)]
    rolled = once.select(
        "conv_id", "n", "role", "text",
        *[F.bit_xor(h).over(Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)).alias(f"p{k}") for k, h in enumerate(own)]
    )
    placed = rolled.withColumn("last", F.lead("n").over(Window.partitionBy("conv_id").orderBy("n")).isNull())
    proper = placed.where("NOT last").select("p0", "p1", "n").distinct()
    first = placed.where("last").groupBy("p0", "p1", "n").agg(F.min("conv_id").alias("conv_id"))
    kept = first.join(proper, ["p0", "p1", "n"], "left_anti").select("conv_id")
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    told = once.join(kept, "conv_id", "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("t"))
    return told.select("conv_id", "n_turns", F.array_join(F.transform("t", lambda x: x["line"]), "").alias("rendered"))


FORMAT_CHATS_SQL = r"""
WITH RECURSIVE said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         count(*) OVER (PARTITION BY conv_id) AS n_turns,
         md5(concat_ws(chr(10), length(role)::VARCHAR, role, text)) AS h
  FROM said),
rolled AS (
  SELECT conv_id, n, n_turns, md5(h) AS p FROM numbered WHERE n = 1
  UNION ALL
  SELECT b.conv_id, b.n, b.n_turns, md5(a.p || b.h) FROM rolled a JOIN numbered b ON b.conv_id = a.conv_id AND b.n = a.n + 1),
kept AS (
  SELECT min(conv_id) AS conv_id FROM rolled
  WHERE n = n_turns AND p NOT IN (SELECT p FROM rolled WHERE n < n_turns) GROUP BY p)
SELECT conv_id, max(n_turns) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY n) AS rendered
FROM numbered WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id
"""

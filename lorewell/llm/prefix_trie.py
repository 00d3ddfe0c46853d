"""The trie of conversation prefixes, from mergeable partial tries (operator 12).

Turns are sorted once over all tasks, so that a long conversation lies in many of them. What a prefix
needs (its length, its hash) is carried from part to part as one small row each. Every task then makes a
table of the nodes that its own rows reach, and tables are merged by the hash of the node: members
add up, the smallest member and the end lists stay. The rollup from the leaves goes along the path
of each node's smallest member, on which the node is one row, and is merged by node again.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, ship, spread_join, tidied

#: Parts that one node's rows are dealt to in each merge, and ids in a part of an end list.
MERGES, END_IDS = (64, 1), 1 << 16
#: Conversations that share a beginning, and turns of it at most.
GROUP, TURNS = 20, 4
WORDS = "size(filter(split(`text`, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != ''))"


def running(rows: DataFrame, order: list[Column], **columns: tuple[str, Column]) -> DataFrame:
    """``rows`` (conv_id, part, ...) with running aggregates ('sum' or 'xor') over each conversation.

    Parts of a conversation are in order and sorted alone; what earlier parts come to is one row for
    each part, and is added to theirs. A conversation of any length is so dealt to many tasks."""
    kinds = {"sum": F.sum, "xor": F.bit_xor}
    keys = ["conv_id", "part"]
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(*[kinds[k](c).alias(n) for n, (k, c) in columns.items()])
    carried = totals.select(*keys, *[F.coalesce(kinds[k](n).over(before), F.lit(0)).alias(f"_{n}") for n, (k, _) in columns.items()])
    local = rows.select("*", *[kinds[k](c).over(own).alias(n) for n, (k, c) in columns.items()])
    both = {n: F.col(n) + F.col(f"_{n}") if k == "sum" else F.col(n).bitwiseXOR(F.col(f"_{n}")) for n, (k, _) in columns.items()}
    return local.join(carried, keys).select(*rows.columns, *[c.alias(n) for n, c in both.items()])


def merged(tables: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Node tables merged by hash: tasks combine their own rows, then the parts of a node, then all of it.
    Aggregates have to give what they take."""
    for salts in MERGES:
        part = F.pmod(F.col("conv_id"), F.lit(salts)).alias("_part") if salts > 1 else F.lit(0).alias("_part")
        tables = tables.groupBy(*keys, part).agg(*aggregates).drop("_part")
    return tables


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, part, d, t0, t1, words): the turns of every rebuilt conversation, with a row of depth 0 for each."""
    said = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")
    )
    # a stable sort over all tasks; equal rows are alike in all that follows
    laid = said.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "text").withColumn("part", F.spark_partition_id())
    hashes = [F.xxhash64(F.lit(seed), F.length("role"), "role", "text").alias(f"t{seed}") for seed in (0, 1)]
    laid = checkpoint(laid.select("conv_id", "part", "turn", "role", "text", *hashes, F.expr(WORDS).alias("words")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = checkpoint(running(laid, order, n=("sum", F.lit(1))).select("conv_id", "part", "n", "t0", "t1", "words"))
    # what a conversation takes from the first of its group; a group has few conversations
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(TURNS)).cast("int")
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")).select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    sizes = convs.where("conv_id = base").select("base", F.col("size").alias("has"))
    shifts = checkpoint(convs.join(sizes, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken")))
    first = placed.where(f"n < {TURNS} AND conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base"), "n", "t0", "t1", "words")
    begun = shifts.where("taken > 0").join(first, "base").where("n <= taken").select("conv_id", F.lit(-1).alias("part"), F.col("n").alias("d"), "t0", "t1", "words")
    own = spread_join(placed, shifts.select("conv_id", "h", "taken"), "conv_id").where("n > h")
    own = own.select("conv_id", "part", (F.col("n") - F.col("h") + F.col("taken")).alias("d"), "t0", "t1", "words")
    tops = shifts.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("t0"), F.lit(0).cast("long").alias("t1"), F.lit(0).alias("words"))
    return own.unionByName(begun).unionByName(tops)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(p0, p1, d, ends_sha256) of rows (p0, p1, d, conv_id).

    Lists are gathered in parts of neighbouring ids, each of END_IDS at most, and hashed part after
    part in order, so that a task holds a part however many conversations end at one node."""
    part = F.floor(F.col("conv_id") / END_IDS).cast("long").alias("part")
    parts = ends.groupBy("p0", "p1", "d", part).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))

    @tidied
    def hashed(batches):
        at, state = None, None
        for pdf in batches:
            out = []
            for p0, p1, d, ids in zip(pdf["p0"], pdf["p1"], pdf["d"], pdf["ids"]):
                text = ",".join(map(str, ids.tolist()))
                if (p0, p1, d) == at:
                    state.update(f",{text}".encode())
                    continue
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (p0, p1, d), hashlib.sha256(text.encode())
            yield pd.DataFrame(out, columns=["p0", "p1", "d", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["p0", "p1", "d", "ends_sha256"])

    return parts.repartition("p0", "p1", "d").sortWithinPartitions("p0", "p1", "d", "part").mapInPandas(hashed, "p0 long, p1 long, d long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``turns`` are rows (conv_id, turn, role, text); other columns are ignored. Turns sort by (turn,
    role, text), nulls of turn first; a null role or text is empty; rows that repeat are turns of
    their own; rows without conv_id are left out. Conversation c is rebuilt from the first h turns of
    c - c % 20 and its own turns after its first h, h being crc32 of its decimal id modulo 4; one that
    is left without turns ends at the root. An empty table gives no node, not even the root. Prefixes
    are compared by 128 bits of hashes over the places and contents of their turns."""
    ship(turns.sparkSession)
    # kept, since hashes, lengths and the rollup read it
    rows = checkpoint(rebuilt(turns))
    own = [F.when(F.col("d") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "d", "t0", "t1")) for seed in (2, 3)]
    paths = running(rows.select("conv_id", "part", "d", "words", own[0].alias("g0"), own[1].alias("g1")), [F.col("d")], p0=("xor", F.col("g0")), p1=("xor", F.col("g1")))
    up = [F.when(F.col("d") > 0, F.col(f"p{i}").bitwiseXOR(F.col(f"g{i}"))).alias(f"u{i}") for i in (0, 1)]
    paths = checkpoint(paths.select("conv_id", "part", "d", "words", "p0", "p1", *up))
    node = ["p0", "p1", "d"]
    tables = paths.select(*node, "conv_id", F.lit(1).cast("long").alias("n_convs"), "u0", "u1", "words")
    nodes = checkpoint(merged(tables, node, F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("u0").alias("u0"), F.max("u1").alias("u1"), F.max("words").alias("words")))
    children = nodes.where("d > 0").select(F.col("u0").alias("p0"), F.col("u1").alias("p1"), (F.col("d") - 1).alias("d"), "conv_id", F.lit(1).cast("long").alias("n_children"))
    children = merged(children, node, F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children")).drop("conv_id")
    known = checkpoint(nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # on the path of its smallest member a node is one row, from which its worth goes up to the root
    worth = known.select("conv_id", "d", ((F.col("n_convs") - 1) * F.col("words")).alias("saves"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"))
    lying = paths.select("conv_id", (-F.col("part")).alias("part"), "d", "p0", "p1").join(worth, ["conv_id", "d"], "left")
    below = running(checkpoint(lying.fillna(0, ["saves", "leaf"])), [F.col("d").desc()], saved_tokens=("sum", F.col("saves")), n_leaves=("sum", F.col("leaf")))
    rolled = merged(
        below.select(*node, "conv_id", "saved_tokens", "n_leaves"), node, F.min("conv_id").alias("conv_id"), F.sum("saved_tokens").alias("saved_tokens"),
        F.sum("n_leaves").alias("n_leaves")
    ).drop("conv_id")
    lengths = paths.groupBy("conv_id").agg(F.max("d").alias("d"))
    ended = end_hashes(paths.join(lengths, ["conv_id", "d"], "left_semi").select(*node, "conv_id"))
    own_id = F.concat_ws(" ", "u0", "u1", F.col("d") - 1)
    upper = nodes.select(F.concat_ws(" ", *node).alias("up"), F.col("conv_id").alias("parent_conv_id"))
    out = known.join(rolled, node).join(ended, node, "left").withColumn("up", F.when(F.col("d") > 0, own_id))
    out = spread_join(out.select("up", *node, "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), upper, "up", "left")
    return out.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


_STEP = "list_reduce([a, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
_CRC = f"list_reduce(list_concat([4294967295]::UBIGINT[], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda s, b: {_STEP.replace('[a,', '[xor(s, b),')})"
PREFIX_TRIE_SQL = rf"""
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, (xor({_CRC}, 4294967295::UBIGINT) % {TURNS})::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM said)),
moved AS (SELECT c.conv_id, c.h, c.base, count(s.n) AS taken FROM convs c LEFT JOIN said s ON s.conv_id = c.base AND s.n <= c.h GROUP BY ALL),
built AS (
  SELECT m.conv_id, s.n AS d, s.role, s.text FROM moved m JOIN said s ON s.conv_id = m.base AND s.n <= m.h
  UNION ALL SELECT m.conv_id, s.n - m.h + m.taken, s.role, s.text FROM moved m JOIN said s ON s.conv_id = m.conv_id AND s.n > m.h),
hashed AS (SELECT conv_id, d, md5(length(role) || ' ' || role || text) AS t, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w != '')) AS words FROM built),
paths AS (
  SELECT conv_id, d, words, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY d) AS p FROM hashed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY p, d),
linked AS (SELECT n.*, u.conv_id AS parent_conv_id, u.p AS up FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = substr(n.p, 1, 32 * (n.d - 1)::BIGINT)),
counted AS (SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN (SELECT up, count(*) AS n FROM linked WHERE d > 0 GROUP BY up) k ON k.up = l.p),
rolled AS (
  SELECT a.p, sum((c.n_convs - 1) * c.words) AS saved_tokens, count(*) FILTER (c.n_children = 0) AS n_leaves
  FROM counted c JOIN paths a ON a.conv_id = c.conv_id AND a.d <= c.d GROUP BY a.p),
ended AS (SELECT p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1) GROUP BY p)
SELECT c.conv_id, c.d AS depth, c.parent_conv_id, c.n_convs, c.n_children, r.n_leaves, r.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM counted c JOIN rolled r USING (p) LEFT JOIN ended e USING (p)
"""

"""Entities resolved to canonical ones by vectors, as if one after the other, in blocks and few rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpoint
from .scans import running_sum

#: Vectors of a block, and entities of each type that the first round settles (each later one twice as many).
BLOCK, FIRST = 512, 1024


def in_blocks(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, block, parts, rows): the rows of each key dealt to blocks of some BLOCK by the hash of their id."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = rows.join(parts, keys).withColumn("block", F.pmod(F.xxhash64("id"), "parts"))
    return dealt.groupBy(*keys, "block", "parts").agg(F.collect_list(F.struct(*columns)).alias("rows"))


def met(one: DataFrame, two: DataFrame, keys: list[str], columns: list[str], kernel: Callable, schema: str) -> DataFrame:
    """What ``kernel`` (rows, rows) makes of each block of ``one`` with each block of ``two`` of the same key.

    A task holds two blocks at a time; a key of any size is spread by its blocks."""
    left = in_blocks(one, keys, columns).select(*keys, F.col("rows").alias("one"))
    right = in_blocks(two, keys, columns).select(*keys, "block", "parts", F.col("rows").alias("two"))
    places = right.select(*keys, "parts").distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("block"))
    pairs = left.join(places, keys).join(right.drop("parts"), [*keys, "block"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in zip(pdf["one"], pdf["two"]):
                out = kernel(pd.DataFrame(list(a)), pd.DataFrame(list(b)))
                if len(out):
                    yield out

    return pairs.select("one", "two").mapInPandas(run, schema)


def cosines(one: pd.DataFrame, two: pd.DataFrame) -> np.ndarray:
    sides = []
    for rows in (one, two):
        v = np.stack([np.asarray(x, dtype=np.float64) for x in rows["v"]])
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        sides.append(v / np.where(n == 0, 1, n))
    return sides[0] @ sides[1].T


def neighbour_counts(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, near): for rows (id, type, v) how many of the same type with a larger id have a cosine above the
    threshold; ids without any are left out. Only counts leave a block."""

    def counted(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        ids = one["id"].to_numpy()
        near = ((cosines(one, two) > threshold) & (ids[:, None] < two["id"].to_numpy()[None, :])).sum(axis=1)
        return pd.DataFrame({"id": ids[near > 0], "near": near[near > 0]})

    kind = rows.schema["id"].dataType.simpleString()
    held = rows.withColumn("dim", F.size("v")).where("dim > 0")
    return met(held, held, ["type", "dim"], ["id", "v"], counted, f"id {kind}, near long").groupBy("id").agg(F.sum("near").alias("near"))


def first_in_order(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id): the nodes that none of the chosen nodes before them is paired with, for pairs (id, other), other
    before id. A node is chosen once all nodes before it that it is paired with are out; each round
    settles all that can be."""
    chosen, left = [], nodes.select("id")
    while not left.isEmpty():
        heads = checkpoint(left.join(pairs.select("id").distinct(), "id", "left_anti"))
        chosen.append(heads)
        out = heads.union(pairs.join(heads.withColumnRenamed("id", "other"), "other", "left_semi").select("id")).distinct()
        left = checkpoint(left.join(out, "id", "left_anti"))
        kept = pairs.join(out, "id", "left_anti")
        pairs = checkpoint(kept.join(out.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "other"))
    every = nodes.select("id").limit(0)
    for heads in chosen:
        every = every.unionByName(heads)
    return every


def resolve_vectors(entities: DataFrame, threshold: float = 0.86, existing: DataFrame | None = None) -> DataFrame:
    """(entity_id, canonical_id) for rows (entity_id, seq, type, v): in the order of seq, each joins the
    canonical entity of its type with the highest cosine above the threshold (of equal ones the first),
    or becomes one itself. ``existing`` (entity_id, type, v) are canonical entities from before.

    The result is that of one pass in order. Rounds take twice as many entities each: what a canonical
    entity of an earlier round is near to is settled at once, and of the rest those are canonical
    that come first among their neighbours. Vectors meet in blocks, so that no type has to fit a
    task. Ids are unique; a null or empty vector is near to nothing."""
    kind = entities.schema["entity_id"].dataType.simpleString()
    columns, keys = ["id", "rank", "v"], ["type", "dim"]
    rows = entities.select(
        F.col("entity_id").alias("id"), "seq", "type", F.col("v").cast("array<double>").alias("v"), F.coalesce(F.size("v"), F.lit(0)).alias("dim"),
        F.lit(1).cast("long").alias("one")
    )
    ranked = checkpoint(running_sum(rows, "type", ["seq", "id"], "one", "rank").select("id", "rank", *keys, "v"))
    able = ranked.where("dim > 0")
    canon = None
    if existing is not None:
        canon = checkpoint(
            existing.select(
                F.col("entity_id").alias("id"), F.lit(0).cast("long").alias("rank"), "type", F.size("v").alias("dim"),
                F.col("v").cast("array<double>").alias("v")
            ).where("dim > 0")
        )

    def near(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": one["id"][(cosines(one, two) > threshold).any(axis=1)]})

    def before(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        i, j = np.nonzero((cosines(one, two) > threshold) & (one["rank"].to_numpy()[:, None] > two["rank"].to_numpy()[None, :]))
        return pd.DataFrame({"id": one["id"].to_numpy()[i], "other": two["id"].to_numpy()[j]})

    def best(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        c, ranks = cosines(one, two), two["rank"].to_numpy()
        c[(one["rank"].to_numpy()[:, None] <= ranks[None, :]) | (c <= threshold)] = -2
        # of equal cosines the first in order
        order = np.argsort(ranks, kind="stable")
        at = order[c[:, order].argmax(axis=1)]
        most = c[np.arange(len(c)), at]
        kept = most > -2
        return pd.DataFrame({"id": one["id"].to_numpy()[kept], "cosine": most[kept], "rank": ranks[at[kept]], "to": two["id"].to_numpy()[at[kept]]})

    # one number
    total = ranked.agg(F.max("rank")).first()[0] or 0
    low, high = 0, FIRST
    while low < total:
        batch = able.where(f"rank > {low} AND rank <= {high}")
        if canon is not None:
            batch = checkpoint(batch.join(met(batch, canon, keys, columns, near, f"id {kind}").distinct(), "id", "left_anti"))
        pairs = checkpoint(met(batch, batch, keys, columns, before, f"id {kind}, other {kind}"))
        new = batch.join(first_in_order(batch, pairs), "id", "left_semi")
        canon = checkpoint(new if canon is None else canon.unionByName(new.select(*canon.columns)))
        low, high = high, 2 * high
    if canon is None:
        return entities.select("entity_id", F.col("entity_id").alias("canonical_id"))
    rest = able.join(canon.select("id"), "id", "left_anti")
    found = met(rest, canon, keys, columns, best, f"id {kind}, cosine double, rank long, to {kind}")
    to = found.groupBy("id").agg(F.max_by("to", F.struct("cosine", -F.col("rank"))).alias("to"))
    return ranked.select("id").join(to, "id", "left").select(F.col("id").alias("entity_id"), F.coalesce("to", "id").alias("canonical_id"))

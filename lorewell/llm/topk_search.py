"""Exact top-k search in three phases with a uniform threshold (operator 8).

The dimensions are dealt to SLICES nodes that only see their own part of rows and queries; a score is
the sum of the nodes' partial scores. Phase 1 gathers of each node the k best entries of a query by
its partial score, and resolves whole scores for these few: the k-th best is a safe cutoff, as no
worse row can be in the result. Phase 2 sends every query its cutoff: an entry whose partial scores
all stay under an even share of it can't reach it, so each node collects those that reach the share.
Phase 3 resolves, for collected entries only, the partial scores of the nodes that did not collect
them, and adds up. Queries meet rows in blocks; entries travel packed, a row for a pair of blocks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, ship, tidied
from .vectors import by_length, valid_vectors

SLICES, ROWS, QUERIES = 2, 2048, 256
#: Up to here sums of products are exact in doubles.
EXACT = 2.0**53
NONE = -(2**62)


def _blocks(rows: DataFrame, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, v, ...extra: a long, or an array with one for each slice) as blocks of at most ``size``
    rows, a row for each slice: (dim, slice, block, ids, m, ...extra). block names the block by its task and turn."""

    def block(dim: int, own: pd.DataFrame, name: int):
        ids, m = own["id"].to_numpy(np.int64), np.stack([np.asarray(v, dtype=np.int64) for v in own["v"]])
        most = np.abs(m).max()
        kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or most < 2 ** (8 * int(k[2]) - 1))
        for s, (a, b) in enumerate(cuts(dim)):
            more = {e: [np.array([x if np.isscalar(x) else x[s] for x in own[e]], dtype=np.float64 if e == "least" else np.int64).tobytes()] for e in extra}
            yield pd.DataFrame({"dim": [dim], "slice": [s], "block": [name], "ids": [ids.tobytes()], "kind": [kind], "m": [m[:, a:b].astype(kind).tobytes()]} | more)

    @tidied
    def packed(batches):
        held: dict[int, list[pd.DataFrame]] = {}
        names = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)
        for pdf in batches:
            for dim, at in by_length(pdf["v"]).items():
                held.setdefault(dim, []).append(pdf.iloc[at])
                if sum(map(len, held[dim])) >= size:
                    rest = pd.concat(held[dim])
                    while len(rest) >= size:
                        yield from block(dim, rest.iloc[:size], next(names))
                        rest = rest.iloc[size:]
                    held[dim] = [rest]
        for dim, parts in held.items():
            if len(rest := pd.concat(parts)):
                yield from block(dim, rest, next(names))

    return rows.mapInPandas(packed, "dim int, slice int, block long, ids binary, kind string, m binary" + "".join(f", {e} binary" for e in extra))


def cuts(dim: int) -> list[tuple[int, int]]:
    """The dimensions (from, to) of each slice."""
    at = np.linspace(0, dim, min(SLICES, dim) + 1).astype(int).tolist()
    return list(zip(at, at[1:]))


def _sides(row) -> tuple[np.ndarray, np.ndarray]:
    """The slice's part of the rows and of the queries of a pair of blocks, for exact products."""
    r, q = np.frombuffer(row.m, row.kind), np.frombuffer(row.q_m, row.q_kind)
    width = len(q) * 8 // len(row.q_ids)
    r, q = r.reshape(-1, width).astype(np.int64), q.reshape(-1, width).astype(np.int64)
    if float(np.abs(r).max()) * float(np.abs(q).max()) * width < EXACT:
        r, q = r.astype(np.float64), q.astype(np.float64)
    return r, q


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search(rows: DataFrame, is_query: str, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every row where ``is_query`` holds.

    Components become floor(scale * x); the score is the integer inner product; ties go to smaller
    ids, and a query isn't its own candidate. Null vectors, empty ones and those with null or
    non-finite components take no part, nor do null ids; only vectors of equal length meet. Rows
    that repeat an id are one candidate each, except for a query with that id. Fewer than k
    candidates are all returned; an empty table gives an empty result. Other columns are ignored."""
    spark = rows.sparkSession
    ship(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def whole_numbers(some: DataFrame) -> DataFrame:
        return valid_vectors(some, id_col, vec_col).where("id IS NOT NULL").withColumn("v", F.expr(f"transform(v, x -> cast(floor({scale} * cast(x AS double)) AS bigint))"))

    every, asked = whole_numbers(rows), whole_numbers(rows.where(is_query))
    data = checkpoint(_blocks(every, ROWS).withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards))))

    def meet(queries: DataFrame) -> DataFrame:
        names = [F.col(c).alias(f"q_{c}") for c in queries.columns if c not in ("dim", "slice")]
        spread = queries.select("dim", "slice", *names).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        return data.join(spread, ["shard", "dim", "slice"])

    @tidied
    def lists(batches):
        """Phase 1: of each query the k best entries of a node's block, and the block's least partial score."""
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, own = np.frombuffer(row.ids, np.int64), np.frombuffer(row.q_ids, np.int64)
                r, q = _sides(row)
                out = []
                for query, partial in zip(own.tolist(), (q @ r.T).astype(np.int64)):
                    at = np.flatnonzero(ids != query)
                    best = at[_best(partial[at], ids[at], k)] if len(at) else at
                    out += [(query, row.slice, i, p, int(partial.min())) for i, p in zip(ids[best].tolist(), partial[best].tolist())]
                if out:
                    yield pd.DataFrame(out, columns=["query_id", "slice", "vec_id", "partial", "low"])

    listed = checkpoint(meet(_blocks(asked, QUERIES)).mapInPandas(lists, "query_id long, slice int, vec_id long, partial long, low long"))
    first = Window.partitionBy("query_id", "slice").orderBy(F.col("partial").desc(), "vec_id")
    few = listed.withColumn("n", F.row_number().over(first)).where(f"n <= {k}").select("query_id", "vec_id").distinct()
    scores = few.join(every.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scores = scores.where("size(v) = size(q)").select("query_id", F.expr("aggregate(zip_with(v, q, (x, y) -> x * y), 0L, (s, x) -> s + x)").alias("score"))
    kth = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    # with fewer than k entries nothing is safe to leave out
    cutoffs = scores.withColumn("n", F.row_number().over(kth)).where(f"n <= {k}").groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).otherwise(F.lit(NONE)).alias("cutoff"))
    lows = listed.groupBy("query_id", "slice").agg(F.min("low").alias("low")).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("slice", "low"))).alias("lows"))
    known = checkpoint(cutoffs.join(lows, "query_id"))
    # a row that reaches the cutoff has a slice with p_s - low_s >= (cutoff - sum of low) / slices, whatever the low are
    share = "(cutoff - aggregate(map_values(lows), 0D, (s, x) -> s + x)) / least({0}, size(v))".format(SLICES)
    least = F.expr(f"transform(sequence(0, {SLICES - 1}), s -> coalesce(try_element_at(lows, s), 0) + {share})")
    sent = asked.join(known.withColumnRenamed("query_id", "id"), "id").select("id", "v", least.alias("least"), "cutoff")
    second = checkpoint(_blocks(sent, QUERIES, ("least", "cutoff")))

    pair = "shard long, dim int, block long, q_block long"

    @tidied
    def collect(batches):
        """Phase 2: the entries (place in the product, id, partial score) that reach the share in a node."""
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, own = np.frombuffer(row.ids, np.int64), np.frombuffer(row.q_ids, np.int64)
                r, q = _sides(row)
                partial = (q @ r.T).astype(np.int64)
                i, j = np.nonzero((partial >= np.floor(np.frombuffer(row.q_least, np.float64))[:, None]) & (ids[None, :] != own[:, None]))
                if len(i):
                    yield pd.DataFrame(
                        {
                            "shard": row.shard, "dim": row.dim, "block": row.block, "q_block": row.q_block, "slice": row.slice,
                            "at": [(i * len(ids) + j).astype("<u4").tobytes()], "p": [partial[i, j].astype("<i8").tobytes()]
                        }
                    )

    collected = meet(second).mapInPandas(collect, f"{pair}, slice int, at binary, p binary")

    @tidied
    def unite(batches):
        """The entries that any node has collected with what is known of their scores (slice -1), and those that each node misses."""
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found = {x["slice"]: (np.frombuffer(x["at"], "<u4"), np.frombuffer(x["p"], "<i8")) for x in row.nodes}
                at = np.unique(np.concatenate([a for a, _ in found.values()]))
                p = np.zeros(len(at), dtype=np.int64)
                out = []
                for s in range(len(cuts(row.dim))):
                    a, own = found.get(s, (at[:0], p[:0]))
                    p[np.searchsorted(at, a)] += own
                    if len(missing := np.setdiff1d(at, a, assume_unique=True)):
                        out.append((s, missing.tobytes(), None))
                out.append((-1, at.tobytes(), p.tobytes()))
                yield pd.DataFrame(out, columns=["slice", "at", "p"]).assign(shard=row.shard, dim=row.dim, block=row.block, q_block=row.q_block)

    nodes = collected.groupBy("shard", "dim", "block", "q_block").agg(F.collect_list(F.struct("slice", "at", "p")).alias("nodes"))
    united = checkpoint(nodes.mapInPandas(unite, f"slice int, at binary, p binary, {pair}"))

    @tidied
    def resolve(batches):
        """Phase 3: the partial scores of the entries that a node misses."""
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                r, q = _sides(row)
                at = np.frombuffer(row.at, "<u4").astype(np.int64)
                i, j = at // len(r), at % len(r)
                p = np.concatenate([(q[i[x : x + 65536]] * r[j[x : x + 65536]]).sum(axis=1) for x in range(0, len(at), 65536)])
                yield pd.DataFrame({"shard": row.shard, "dim": row.dim, "block": row.block, "q_block": row.q_block, "at": [row.at], "p": [p.astype("<i8").tobytes()]})

    asking = second.select("dim", "slice", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("m").alias("q_m"))
    missing = united.where("slice >= 0").drop("p").join(data, ["shard", "dim", "block", "slice"]).join(asking, ["dim", "q_block", "slice"])
    resolved = missing.mapInPandas(resolve, f"{pair}, at binary, p binary")
    parts = united.where("slice < 0").select(*[x.split()[0] for x in pair.split(", ")], "at", "p").unionByName(resolved)
    summed = parts.groupBy("shard", "dim", "block", "q_block").agg(F.collect_list(F.struct("at", "p")).alias("parts"))
    names = data.where("slice = 0").select("shard", "dim", "block", "ids")
    wanted = second.where("slice = 0").select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("cutoff").alias("q_cutoff"))

    @tidied
    def scored(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, own, cutoff = (np.frombuffer(x, np.int64) for x in (row.ids, row.q_ids, row.q_cutoff))
                sides = [(np.frombuffer(x["at"], "<u4"), np.frombuffer(x["p"], "<i8")) for x in row.parts]
                at = np.unique(np.concatenate([a for a, _ in sides])).astype(np.int64)
                total = np.zeros(len(at), dtype=np.int64)
                for a, p in sides:
                    total[np.searchsorted(at, a)] += p
                fine = total >= cutoff[at // len(ids)]
                at, total, out = at[fine], total[fine], []
                for i in np.unique(at // len(ids)).tolist():
                    mine = np.flatnonzero(at // len(ids) == i)
                    names = ids[at[mine] % len(ids)]
                    best = _best(total[mine], names, k)
                    out += zip([int(own[i])] * len(best), names[best].tolist(), total[mine][best].tolist())
                if out:
                    yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = summed.join(names, ["shard", "dim", "block"]).join(wanted, ["dim", "q_block"]).mapInPandas(scored, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")

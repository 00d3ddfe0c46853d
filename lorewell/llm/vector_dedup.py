"""Embedding near-dedup by spherical-cap filters of structured random product codes (operator 10).

A filter direction is a pair of random codewords, one for each half of the dimensions of a rotated
copy of the space; TABLES rotations have as many directions as make near vectors share some. Every
vector is list-decoded to all directions whose inner product with it exceeds a threshold, the same for
all vectors, so that some PER_FILTER vectors exceed one direction at any size of the table. Vectors
meet on filters: first with 8-bit codes whose error is bound, then, for the few that may have a link,
in doubles. A pair counts in the least filter that both exceed.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, ship, spread_join, tidied
from .jaccard import forest
from .vectors import by_length, matrix, valid_vectors

#: Vectors that exceed a filter, rotations, filters that vectors at the cosine sought share, vectors in a block.
PER_FILTER, TABLES, SHARED, BLOCK = 64, 6, 12, 512
#: Filters with more vectors than a block that are split (so many rows are broadcast), and dimensions at least.
SPLIT_FILTERS, LEAST_DIM = 1 << 16, 8


@functools.lru_cache(64)
def plan(dim: int, n: int, cosine: float) -> tuple[float, int]:
    """(threshold, codewords of a half) for ``n`` vectors.

    The inner product of two random unit vectors has a density of (1 - x^2)^((dim - 3) / 2). The
    threshold leaves PER_FILTER of n; the number of directions follows from the chance that a vector
    at that cosine exceeds one that the other exceeds."""
    x = np.linspace(-1, 1, 20001)
    w = np.clip(1 - x * x, 0, None) ** ((dim - 3) / 2)
    above = np.cumsum(w[::-1])[::-1] / w.sum()
    share = min(0.25, PER_FILTER / max(n, 1))
    at = min(int(np.searchsorted(-above, -share)), len(x) - 2)
    alpha = float(x[at])
    y = np.linspace(-1, 1, 4001)
    v = np.clip(1 - y * y, 0, None) ** ((dim - 4) / 2)
    beyond = np.append(np.cumsum(v[::-1])[::-1], 0) / v.sum()
    need = (alpha - cosine * x[at:]) / np.maximum(math.sqrt(max(1 - cosine**2, 0)) * np.sqrt(np.clip(1 - x[at:] ** 2, 0, None)), 1e-12)
    both = float((beyond[np.clip(np.searchsorted(y, need), 0, len(y))] * w[at:]).sum() / max(w[at:].sum(), 1e-300))
    return alpha, max(2, math.ceil(math.sqrt(SHARED / TABLES / max(above[at] * both, 1e-14))))


@functools.lru_cache(64)
def code(dim: int, size: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation and the codewords of both halves, scaled so that two of them make a unit vector."""
    r = np.random.default_rng([20, dim, size, table])
    turn = np.linalg.qr(r.normal(size=(dim, dim)))[0]
    halves = [r.normal(size=(size, n)) for n in (dim // 2, dim - dim // 2)]
    return turn, *[c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(2) for c in halves]


def decode(unit: np.ndarray, n: int, cosine: float) -> list[np.ndarray]:
    """For every row the filters that it exceeds, in ascending order."""
    if unit.shape[1] < LEAST_DIM:
        unit = np.pad(unit, ((0, 0), (0, LEAST_DIM - unit.shape[1])))
    dim = unit.shape[1]
    alpha, size = plan(dim, n, cosine)
    lists: list[list[np.ndarray]] = [[] for _ in unit]
    for table in range(TABLES):
        turn, low, high = code(dim, size, table)
        own = unit @ turn
        one, two = own[:, : dim // 2] @ low.T, own[:, dim // 2 :] @ high.T
        most = two.max(axis=1)
        for r in range(len(unit)):
            first = np.flatnonzero(one[r] >= alpha - most[r])
            i, j = np.nonzero(one[r, first][:, None] + two[r][None, :] >= alpha)
            lists[r].append((table * size + first[i]) * size + j)
    return [np.concatenate(x) for x in lists]


def coded(unit: np.ndarray) -> list[bytes]:
    """8-bit codes of the rows, after their scale and the length of what they leave out (as float32)."""
    scale = np.maximum(np.abs(unit).max(axis=1, keepdims=True), 1e-30).astype(np.float32) / np.float32(127)
    codes = np.clip(np.rint(unit / scale), -127, 127).astype(np.int8)
    rest = np.nextafter(np.linalg.norm(unit - codes * scale.astype(np.float64), axis=1).astype(np.float32), np.float32(2))
    return [np.array([s, e], np.float32).tobytes() + c.tobytes() for s, e, c in zip(scale[:, 0], rest, codes)]


def decoded(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, lengths of what they leave out) of coded() rows."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return raw[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1]


def shared_before(a: list[np.ndarray], b: list[np.ndarray], at: int) -> np.ndarray:
    """Whether rows of a and b share a filter before ``at``."""
    sides = [[x[: np.searchsorted(x, at)] for x in rows] for rows in (a, b)]
    columns = np.intersect1d(np.concatenate(sides[0]), np.concatenate(sides[1]))
    parts = []
    for rows in sides:
        m, every = np.zeros((len(rows), len(columns)), dtype=np.float32), np.concatenate(rows)
        spot = np.searchsorted(columns, every)
        hit = np.flatnonzero(columns[np.minimum(spot, len(columns) - 1)] == every) if len(columns) else []
        m[np.repeat(np.arange(len(rows)), [len(x) for x in rows])[hit], spot[hit]] = 1
        parts.append(m)
    return parts[0] @ parts[1].T > 0


def _meetings(rows: DataFrame, split: DataFrame, columns: list[str], kernel, schema: str) -> DataFrame:
    """What ``kernel`` (dim, filter, rows, other rows or None) makes of the vectors of each filter.

    Those of a filter with more than a block are cut into blocks by hash, and each block also meets
    each other one."""
    row = F.struct(*columns).alias("row")
    dealt = rows.join(F.broadcast(split), ["dim", "filter"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))

    def run(batches):
        for pdf in batches:
            for dim, at, one, two in zip(pdf["dim"], pdf["filter"], pdf["one"], pdf["two"]):
                if len(one) > 1 or (two is not None and len(two)):
                    yield from kernel(dim, at, list(one), list(two) if two is not None else None)

    own = dealt.groupBy("dim", "filter", "part").agg(F.collect_list(row).alias("one")).select(
        "dim", "filter", "one", F.lit(None).cast(f"array<{rows.select(row).schema[0].dataType.simpleString()}>").alias("two")
    )
    pairs = dealt.where("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part != other")
    pairs = pairs.groupBy("dim", "filter", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    pairs = pairs.agg(F.collect_list(F.when(F.col("part") < F.col("other"), row)).alias("one"), F.collect_list(F.when(F.col("part") > F.col("other"), row)).alias("two"))
    return own.unionByName(pairs.select("dim", "filter", "one", "two")).mapInPandas(tidied(run), schema)


def near_vectors(rows: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links are pairs with that cosine or more.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, nor
    do vectors of unlike length. Equal vectors are one class until the end: copies are linked to
    each other and to all that their class is linked to, without being paired. kept marks the
    smallest id of a component. Rows that repeat an id stay rows of their own; a null id has a null
    component. An empty table gives an empty one; other columns are ignored. A filter with many
    vectors is split into blocks of BLOCK, so that a task only holds two blocks at a time. Every
    row is indexed, and a link counts for both of its ends or for none; filters miss a few links
    (see the measured recall in the tests)."""
    spark = rows.sparkSession
    ship(spark)
    fine = valid_vectors(rows, id_col, vec_col).where("id IS NOT NULL AND exists(v, x -> x != 0)")
    # ids may repeat with other vectors, so that classes have numbers of their own
    classes = checkpoint(fine.groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    total = classes.count()

    @tidied
    def filed(batches):
        for pdf in batches:
            for dim, at in by_length(pdf["v"]).items():
                for i in range(0, len(at), 1024):
                    own = pdf.iloc[at[i : i + 1024]]
                    v = matrix(own["v"])
                    v /= np.abs(v).max(axis=1, keepdims=True)
                    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                    yield pd.DataFrame(
                        {
                            "dim": dim, "rep": own["rep"].to_numpy(), "n": own["n"].to_numpy(), "u": [x.tobytes() for x in unit], "code": coded(unit),
                            "filters": decode(unit, total, cosine)
                        }
                    )

    filed_rows = checkpoint(classes.mapInPandas(filed, "dim int, rep long, n long, u binary, code binary, filters array<long>"))
    probing = filed_rows.select("dim", "rep", "code", F.explode("filters").alias("filter"))
    full = probing.groupBy("dim", "filter").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("parts > 1")
    split = checkpoint(full.orderBy(F.col("parts").desc(), "dim", "filter").limit(SPLIT_FILTERS))

    def maybe(dim, at, one, two):
        """Those vectors of a filter that the codes let have a link."""
        (a, e), (b, f) = decoded([x["code"] for x in one]), decoded([x["code"] for x in two or one])
        like = a @ b.T >= cosine - 1e-5 - (e[:, None] + f[None, :] + e[:, None] * f[None, :])
        if two is None:
            np.fill_diagonal(like, False)
        found = [x["rep"] for x, y in zip(one, like.any(axis=1)) if y]
        found += [x["rep"] for x, y in zip(two or [], like.any(axis=0)) if y]
        if found:
            yield pd.DataFrame({"dim": dim, "filter": at, "rep": found})

    alive = checkpoint(_meetings(probing, split, ["rep", "code"], maybe, "dim int, filter long, rep long").distinct())

    def linked(dim, at, one, two):
        """Links counted for both ends where ``at`` is the first filter they share; pairs that join components."""
        (u, f, n, a), (w, g, m, b) = (
            (np.stack([np.frombuffer(x["u"], np.float64) for x in side]), [np.asarray(x["filters"], np.int64) for x in side], np.array([x["n"] for x in side]), np.array([x["rep"] for x in side]))
            for side in (one, two or one)
        )
        near = u @ w.T >= cosine
        if two is None:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        x, y = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        near, a, n, b, m = near[np.ix_(x, y)], a[x], n[x], b[y], m[y]
        near &= ~shared_before([f[i] for i in x], [g[i] for i in y], at)
        out = [(r, None, c) for r, c in zip(a.tolist(), (near @ m).tolist()) if c]
        if two is not None:
            out += [(r, None, c) for r, c in zip(b.tolist(), (n @ near).tolist()) if c]
        i, j = np.nonzero(near)
        pairs = np.stack([a[i], b[j]], axis=1)
        out += [(p, q, 0) for p, q in pairs[forest(pairs)].tolist()]
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "w"]).astype({"b": "Int64"})

    again = alive.join(filed_rows.select("rep", "n", "u", "filters"), "rep")
    met = checkpoint(_meetings(again, split, ["rep", "n", "u", "filters"], linked, "a long, b long, w long"))
    links = met.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    components = connected_components(met.where("b IS NOT NULL")).withColumnRenamed("node", "rep")
    known = checkpoint(
        classes.join(links, "rep", "left").join(components, "rep", "left").select(
            "v", "low", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")
        )
    )
    known = spread_join(known, known.groupBy("c").agg(F.min("low").alias("component")), "c").select("v", "n_links", "component")
    every = rows.select(F.col(id_col).alias("id"), F.when(F.col(id_col).isNotNull(), F.col(vec_col)).alias("v"))
    return (
        spread_join(every, known, "v", "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.col(id_col) == F.col("component_id"))
    )

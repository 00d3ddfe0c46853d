"""N-gram Jaccard join as a blocked sparse product of document by shingle incidence (operator 7).

With all shingles in one global order, two sets at the threshold share a shingle among the first
|x| - ceil(t |x|) + 1 of each. These prefixes make the sparse incidence matrix whose product with its
transpose is accumulated: overlap counts of pairs in the prefixes, which the sizes of the sets turn
into an upper bound on the whole overlap. Pairs under the bound that the threshold needs are
discarded, the others are verified over their whole sets. The order puts shingles that many
documents share last (by a sketch over all documents that grows with them), so that common passages
hardly occur in prefixes.

Groups of alike documents are contracted, so that pairs of one component are not made: equal sets
first, then links to the smallest document of each shingle's list, then, where lists that still hold
several components are not short, links to neighbours in orders by likeness (a few passes over
minimum hashes, whose pairs are in proportion to the documents). What is left of short lists is
multiplied by itself; documents of longer ones are dealt to blocks, and pairs of blocks are multiplied
in one task each, over all the shingles of those documents that share a list with the other block.
Only links that join components leave it. Nothing is left out but pairs of one component, so that
components are exact.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import checkpoint, compact, connected_components, counted, folded, fresh, parts_of, release, rolled, ship, tidied, word_hashes

#: Cells of the sketch, one for so many bytes of the input; a cell is heavy when it holds that many deviations over the median cell.
CELLS, CELLS_MOST, CELL_BYTES = 1 << 16, 1 << 20, 1 << 14
DEVIATIONS, SLACK = 8, 64
#: Bits of a bitmap, and cells of the sketch's pieces, of which there is a row each.
FILTER_BITS, FILTER_MOST, CELLS_PIECE = 1 << 16, 1 << 24, 1 << 11
#: Documents from which on a list takes part in passes, and from which on in blocks.
LONG, BLOCKS_FROM = 16, 1024
#: Minimum hashes of a document, orders in a pass, passes, equal hashes that neighbours need to be looked at, and documents of which a pass has to link one for another.
BINS, ORDERS, PASSES, AGREE, WORTH = 16, 8, 3, 8, 50
#: Documents and shingles of a block, columns of a dense product at a time, cells of a column up to which it is sparse, cells at a time.
BLOCK_DOCS, BLOCK_SHINGLES, COLUMNS, SPARSE, CELLS_AT_ONCE = 1024, 1 << 21, 4096, 4096, 1 << 22


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of k words (or of all words, if fewer) of a text."""
    words = word_hashes(folded(text))
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(rolled(words, min(k, len(words))))


def sketch_cells(docs: DataFrame) -> int:
    """Cells of the sketch: a power of two that follows the size that Spark knows of ``docs``."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(CELLS, 1 << (size // CELL_BYTES).bit_length()), CELLS_MOST)


def cell_of(found: np.ndarray, cells: int) -> np.ndarray:
    return (found & np.uint64(cells - 1)).astype(np.int64)


def ranked(found: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The places of shingles in the global order, sorted: heavy cells last, hashes within."""
    return np.sort((found >> np.uint64(1)) | (heavy[cell_of(found, len(heavy))].astype(np.uint64) << np.uint64(63)))


def prefix_length(n, percent: int):
    return n - (n * percent + 99) // 100 + 1


def signature(found: np.ndarray) -> np.ndarray:
    """32 bits of the least shingle of each of BINS ranges of hashes (the next one's where a range is empty)."""
    bounds = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    return found[np.minimum(np.searchsorted(found, bounds), len(found) - 1)].astype(np.uint32).view(np.int32)


def heavy_cells(counts: np.ndarray) -> np.ndarray:
    middle = float(np.median(counts))
    return counts > middle + DEVIATIONS * np.sqrt(middle) + SLACK


class Sets(OrderedDict):
    """The shingle sets of the documents seen last."""

    def of(self, key, text: str | None, k: int) -> np.ndarray:
        if key not in self:
            if len(self) >= 8:
                self.popitem(last=False)
            self[key] = shingles(text, k)
        return self[key]


def gathered(pieces: DataFrame, size: int, kind) -> np.ndarray:
    """An array of ``size`` numbers from rows (piece, b): few rows of bytes reach the driver, all of one length; what is left out is zero."""
    out, got = np.zeros(size, dtype=kind), pieces.toPandas()
    for piece, b in zip(got["piece"], got["b"]):
        own = np.frombuffer(b, dtype=kind)
        out[piece * len(own) : (piece + 1) * len(own)] = own
    return out


def among(rows: DataFrame, keys: DataFrame, key: str, others: bool = False) -> DataFrame:
    """The rows whose ``key`` may be among ``keys`` (key), or with ``others`` those whose key surely isn't.

    It is a bitmap of 16 bits for each key, FILTER_MOST at most, in FILTER_MOST / 64 rows at most that are
    broadcast; beyond some million keys more and more others pass. Joins with the keys decide; the
    bitmap keeps rows out of their shuffle."""
    bits = min(max(FILTER_BITS, 1 << (16 * keys.count()).bit_length()), FILTER_MOST)
    cell, word, held = fresh(rows, "_cell", "_word", "_held")
    of = F.pmod(F.xxhash64(key), F.lit(bits)).cast("int")
    words = keys.select(of.alias("c")).groupBy((F.col("c") / 64).cast("int").alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, c % 64)")).alias(held))
    joined = rows.withColumn(cell, of).withColumn(word, F.expr(f"{cell} div 64").cast("int")).join(F.broadcast(words.coalesce(parts_of(bits // 64))), word, "left" if others else "inner")
    bit = F.expr(f"shiftright({held}, {cell} % 64) & 1")
    return joined.where(F.coalesce(bit, F.lit(0)) == (0 if others else 1)).select(*[f"`{c}`" for c in rows.columns])


def wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (id, text) that may be among ``ids`` (id)."""
    return among(docs, ids, "id")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of those pairs whose whole sets reach the threshold."""
    ends = compact(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = wanted(docs, ends)
    # the side that repeats (a) joins last, so that its text is only repeated on the way to Python
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    @tidied
    def overlaps(batches):
        sets = Sets()
        for pdf in batches:
            keep = []
            for a, text_a, text_b in zip(pdf["a"], pdf["text_a"], pdf["text_b"]):
                x, y = sets.of((a, xxh3_128_digest(text_a)), text_a, k), shingles(text_b, k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            if any(keep):
                yield pdf.loc[keep, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(overlaps, "a long, b long")


def _bounded(met: DataFrame, percent: int, *more: str) -> DataFrame:
    """(a, b, ...) of the rows (id, n, end of each side, one for each common shingle) that their overlap in the prefixes doesn't rule out.

    Texts under one id are told apart by size and end, so that each pair of them has its own bound."""
    sides = [F.col(f"{c}_{s}") for s in "ab" for c in ("id", "n", "end")]
    counted = met.groupBy(*sides).agg(F.count(F.lit(1)).alias("common"), *[F.max(c).alias(c) for c in more])
    rest = {s: f"(n_{s} - (n_{s} - (n_{s} * {percent} + 99) div 100 + 1))" for s in "ab"}
    bound = f"common + CASE WHEN end_a < end_b THEN {rest['a']} WHEN end_a > end_b THEN {rest['b']} ELSE greatest({rest['a']}, {rest['b']}) END"
    return counted.where(f"{100 + percent} * ({bound}) >= {percent} * (n_a + n_b)").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), *more).distinct()


def sizes_fit(percent: int, a: str = "n_a", b: str = "n_b") -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _square(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs of different components in the product of lists (h, id, n, end, c) with themselves."""
    side = lambda s: lists.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "end", "c")])
    return _bounded(side("a").join(side("b"), "h").where(f"c_a < c_b AND {sizes_fit(percent)}"), percent)


def _still_open(lists: DataFrame) -> DataFrame:
    """The rows (h, ..., c) of lists that hold several components, with their length as size."""
    mixed = lists.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("size")).where("low != high")
    return lists.join(mixed.select("h", "size"), "h")


def _alike(docs: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b, c_a, c_b): documents (id, n, c, sig) of different components that are neighbours in orders by likeness.

    An order sorts by the minimum hashes, each order by others first, so that the most alike lie side
    by side. It is cut into ranges, whatever the size of a group; the last of one range doesn't meet
    the first of the next. There are at most ORDERS pairs for each document."""
    ways = [np.random.default_rng([7, turn, r]).permutation(BINS).tolist() for r in range(ORDERS)]
    keys = F.array(*[F.array(*[F.get("sig", F.lit(i)) for i in way]) for way in ways])
    laid = docs.select("id", "n", "c", F.posexplode(keys).alias("r", "key")).repartitionByRange("r", "key", "id").withColumn("part", F.spark_partition_id())
    follows = F.lead(F.struct("id", "n", "c", "key")).over(Window.partitionBy("r", "part").orderBy("key", "id"))
    agree = F.size(F.filter(F.zip_with("key", "o.key", lambda x, y: x == y), lambda x: x)) >= AGREE
    near = laid.withColumn("o", follows).where(f"c != o.c AND {sizes_fit(percent, 'n', 'o.n')}").where(agree)
    swap = F.col("id") > F.col("o.id")
    ends = [F.when(swap, F.col(f"{x}{c}")).otherwise(F.col(f"{y}{c}")).alias(f"{to}{s}") for c, to in (("id", ""), ("c", "c_")) for x, y, s in (("o.", "", "a"), ("", "o.", "b"))]
    return near.select(*ends).distinct()


def overlaps_of(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sorted sets of ``one`` with those of ``two``: a product of the
    incidence matrices over the shingles that occur on both sides. Columns with few cells are added
    cell by cell, the others as dense matrices, COLUMNS of them at a time."""
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    columns = np.intersect1d(np.concatenate(one), np.concatenate(two))
    if not len(columns):
        return out
    sides, sizes = [], []
    for sets in (one, two):
        rows, every = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.searchsorted(columns, every)
        at[at == len(columns)] = 0
        hit = columns[at] == every
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], rows[hit][order]))
        sizes.append(np.bincount(at[hit], minlength=len(columns)))
    cells = sizes[0] * sizes[1]
    # sparse columns: every row of the one side with all of the other
    light = cells[sides[0][0]] <= SPARSE
    at, rows = (x[light] for x in sides[0])
    first = np.concatenate([[0], np.cumsum(sizes[1])[:-1]])
    ends = np.cumsum(sizes[1][at])
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS_AT_ONCE, "right")))
        reps = sizes[1][at[low:high]]
        inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        other = sides[1][1][np.repeat(first[at[low:high]], reps) + inside]
        out += np.bincount(np.repeat(rows[low:high], reps) * len(two) + other, minlength=out.size).reshape(out.shape)
        low = high
    heavy = np.flatnonzero(cells > SPARSE)
    for low in range(0, len(heavy), COLUMNS):
        own, parts = heavy[low : low + COLUMNS], []
        for (at, rows), n in zip(sides, out.shape):
            spot = np.minimum(np.searchsorted(own, at), len(own) - 1)
            hit = own[spot] == at
            m = np.zeros((n, len(own)), dtype=np.float32)
            m[rows[hit], spot[hit]] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def forest(pairs: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) span the components that all of them make."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def _block_links(lists: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) links that join components among the documents of long lists (h, id, n, c).

    Documents lie in bands of sizes, so that only neighbouring bands can hold a link, and in a band
    those with the same least shingle lie together, in blocks of some BLOCK_DOCS documents or
    BLOCK_SHINGLES shingles, which take turns by hash where one shingle has more. Pairs of blocks that
    share a list and hold several components are multiplied whole."""
    # a little wider than the largest ratio of sizes that a link allows, so that rounding can't part two of them by two bands
    band = F.floor(F.log("n") / (max(math.log(100 / percent), 1e-3) * (1 + 1e-9)))
    own = compact(lists.groupBy("id", "n", "c").agg(F.min("h").alias("lead")).withColumn("band", band))
    parts = lambda docs: F.greatest(F.ceil(F.count(F.lit(1)) / (docs * BLOCK_DOCS)), F.ceil(F.sum("n") / (docs * BLOCK_SHINGLES)))
    groups = own.groupBy("band", "lead").agg(parts(1).alias("parts"))
    bands = own.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("few"))
    cell, part = F.pmod(F.xxhash64("lead"), F.col("few")), F.pmod(F.xxhash64("id"), F.col("parts"))
    # one large group of the same least shingle has blocks of its own
    block = F.when(F.col("parts") > 1, F.xxhash64("band", "lead", part)).otherwise(F.xxhash64("band", cell))
    placed = own.join(groups, ["band", "lead"]).join(bands, "band").select("id", "n", "c", "band", block.alias("block"))
    cut = placed.groupBy("block").agg(parts(2).alias("more"))
    placed = compact(placed.join(cut, "block").select("id", "c", "band", F.xxhash64("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("more"))).alias("block")))
    rows = compact(lists.select("h", "id").join(placed.select("id", "c", "band", "block"), "id"))
    held = rows.groupBy("h", "band", "block").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    side = lambda s: held.select("h", *[F.col(x).alias(f"{x}_{s}") for x in ("band", "block", "low", "high")])
    mixed = "block_a <= block_b AND abs(band_a - band_b) <= 1 AND NOT (low_a = high_a AND low_b = high_b AND low_a = low_b)"
    meets = compact(side("a").join(side("b"), "h").where(mixed).select("h", "block_a", "block_b").distinct())
    # of a block only those documents go to a meeting that are in a list of the other block
    ends = meets.select("h", "block_a", "block_b", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    sent = ends.join(rows.select("h", "block", "id", "c"), ["h", "block"]).select("block_a", "block_b", "block", "id", "c").distinct()

    @tidied
    def made(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "words": [shingles(t, k).tobytes() for t in pdf["text"]]})

    both = sent.join(checkpoint(wanted(docs, placed.select("id").distinct()).mapInPandas(made, "id long, words binary")), "id")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["block_a"].iloc[0]), int(pdf["block_b"].iloc[0])
        sides = []
        for x in (a, b)[: 1 + (a != b)]:
            rows = pdf[pdf["block"] == x]
            sets = [np.frombuffer(w, np.uint64) for w in rows["words"]]
            sides.append((rows["id"].to_numpy(np.int64), rows["c"].to_numpy(np.int64), sets, np.array([len(y) for y in sets], dtype=np.float64)))
        (i, c, one, n), (j, d, two, m) = sides[0], sides[-1]
        if not len(i) or not len(j):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        common = overlaps_of(one, two).astype(np.float64)
        linked = (100 * common >= percent * (n[:, None] + m[None, :] - common)) & (c[:, None] != d[None, :])
        x, y = np.nonzero(linked)
        kept = forest(np.stack([c[x], d[y]], axis=1))
        return pd.DataFrame({"a": i[x[kept]], "b": j[y[kept]]})

    return both.groupBy("block_a", "block_b").applyInPandas(product, "a long, b long")


def _passes(lists: DataFrame, signed: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[list[DataFrame], DataFrame]:
    """Links (a, b) that join components of longer lists, and the lists (h, ..., c, size) that are open after them.

    There are PASSES passes at most, each with a few pairs for each document, and none after one that
    linked few of them."""
    found, signs = [], None
    for turn in range(PASSES):
        long = lists.where(f"size > {LONG}").select("id", "n", "end", "c").distinct()
        if signs is None:
            signs, size = counted(signed.join(long.select("id", "n", "end"), ["id", "n", "end"], "left_semi"))
        pairs = compact(_alike(long.join(signs, ["id", "n", "end"]), turn, percent))
        new = compact(_verified(pairs.select("a", "b"), docs, k, percent).distinct().join(pairs, ["a", "b"]))
        found.append(new.select("a", "b"))
        del pairs, long
        release(docs.sparkSession)
        if new.count() * WORTH < size:
            break
        moved = connected_components(new.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))).select(F.col("node").alias("c"), "component")
        lists = compact(_still_open(lists.drop("size").join(moved, "c", "left").select("h", "id", "n", "end", F.coalesce("component", "c").alias("c"))))
    return found, lists


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Links join documents with 100 * |intersection| >= percent * |union| of their sets of k-word
    shingles (ASCII letters in lower case, words split at ASCII white space; fewer than k words are
    one shingle). component_id is the smallest id that links reach. Texts that are null, empty or
    without words have no shingle and stay alone. Rows that repeat an id are one document: what any
    of them links to, all do. A null id is alone with a null component. An empty table gives an
    empty one; other columns are ignored. Ids are longs."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cells = sketch_cells(source)

    @tidied
    def signed(batches):
        counts = np.zeros(cells, dtype=np.int64)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                found = shingles(text, k)
                if len(found) > 4096:
                    counts += np.bincount(cell_of(found, cells), minlength=cells)
                else:
                    np.add.at(counts, cell_of(found, cells), 1)
                out.append((xxh3_128_digest(found.tobytes()), len(found)))
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "mark": [x[0] for x in out], "n": [x[1] for x in out]})
        pieces = counts.reshape(-1, CELLS_PIECE)
        some = np.flatnonzero(pieces.any(axis=1))
        yield pd.DataFrame({"id": pd.array(some, dtype="Int64"), "mark": [pieces[i].tobytes() for i in some], "n": -1})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(b, dtype=np.int64) for b in pdf["mark"])
        return pd.DataFrame({"piece": [int(pdf["id"].iloc[0])], "b": [whole.tobytes()]})

    first = checkpoint(source.mapInPandas(signed, "id long, mark binary, n long"))
    counts = gathered(first.where("n < 0").groupBy("id").applyInPandas(added, "piece int, b binary"), cells, np.int64)
    heavy = heavy_cells(counts)
    rows = first.where("n >= 0").select("id", "mark", "n")
    named = rows.where("n > 0 AND id IS NOT NULL")
    classes = compact(named.groupBy("mark").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep != last").select("mark", "rep"))
    copies = compact(named.join(classes, "mark").where("id != rep").select("id", "mark", "rep").distinct())

    @tidied
    def prefixes(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"]):
                found = shingles(text, k)
                if n := len(found):
                    own = (ranked(found, heavy)[: prefix_length(n, percent)] ^ np.uint64(1 << 63)).view(np.int64)
                    out.append((i, xxh3_128_digest(found.tobytes()), n, int(own[-1]), own, signature(found)))
            if out:
                yield pd.DataFrame(out, columns=["id", "mark", "n", "end", "hs", "sig"])

    # texts whose id no copy has aren't joined with the copies; kept, since both the count of each shingle and the join with it read them
    own, schema = source.where("id IS NOT NULL"), "id long, mark binary, n int, end long, hs array<long>, sig array<int>"
    twice = among(own, copies, "id").mapInPandas(prefixes, schema).join(copies.select("id", "mark"), ["id", "mark"], "left_anti")
    made = checkpoint(among(own, copies, "id", others=True).mapInPandas(prefixes, schema).unionByName(twice).drop("mark"))
    postings = made.select(F.explode("hs").alias("h"), "id", "n", "end")
    shared = compact(made.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h"))
    common = among(postings, shared, "h").join(shared, "h")
    # one exchange by h serves both the least of each list and the join with it
    least = common.groupBy("h").agg(F.min(F.struct("id", "n", "end")).alias("l"), F.max("id").alias("high")).where("l.id != high").select("h", "l")
    listed = compact(common.join(least, "h"))
    del postings, shared, common, least
    release(docs.sparkSession)
    leading = listed.where(f"id != l.id AND {sizes_fit(percent, 'n', 'l.n')}").select(
        *[F.col(f"l.{c}").alias(f"{c}_a") for c in ("id", "n", "end")], *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "end")]
    )
    links = compact(_verified(compact(_bounded(leading, percent)), source, k, percent))
    near = connected_components(links)
    members = listed.drop("l").join(near.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    lists = compact(_still_open(members))
    edges = links.unionByName(copies.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    found, lists = _passes(lists, made.select("id", "n", "end", "sig"), source, k, percent)
    for more in found:
        edges = edges.unionByName(more)
    # a pair that shares one of the longest lists is met in blocks, whatever the other lists make of it
    longest = lists.where(f"size > {BLOCKS_FROM}").drop("end")
    if not longest.isEmpty():
        edges = edges.unionByName(compact(_block_links(longest, source, k, percent)))
    edges = edges.unionByName(_verified(compact(_square(lists.where(f"size <= {BLOCKS_FROM}"), percent)), source, k, percent))
    components = connected_components(edges).select(F.col("node").alias("id"), "component")
    return rows.join(components, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))

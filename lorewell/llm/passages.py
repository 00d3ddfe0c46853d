"""Substring dedup by collinear chaining (operator 4).

All k-mers of words that several documents share are seeds, at every place; each leads to the first
place in the first document that holds it, so that a passage in n documents makes n - 1 matches for
each k-mer. Hashes are dealt to parts in packed blocks and met by array operations. The matches of
two documents are chained in order with gap costs, by a Fenwick tree of prefix maxima; what a chain
spans, and some words around, is aligned over all its k-mers, and stretches of MIN_WORDS or more of
which four fifths agree are cut from the later document. Windows of MIN_WORDS words whose k-mers lead
to different places (pieced together, or a phrase over and over) meet the first document that holds
the whole window, so that each run of MIN_WORDS words that an earlier document has is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, folded, fresh, mix64, release, rolled, ship, spread_join, tidied, without, word_hashes, word_starts
from .jaccard import wanted

K, MARGIN = 5, 60
#: Cost of a word in a gap; gap over which chains of seeds may be split; agreeing words that make two texts be aligned.
GAP_COST, SEED_GAP, EVIDENCE = 0.1, 60, 10
#: Parts into which k-mers and then documents are dealt, and k-mers that a task holds before it deals them.
PARTS, BUFFER = 2048, 1 << 19
#: With larger inputs there are more parts: one for so many bytes, up to a limit, beyond which parts grow; and k-mers that a task then holds at most.
PART_BYTES, PARTS_MOST, BUFFER_MOST = 4 << 20, 1 << 22, 1 << 22
#: Words of a document that are cut up at a time, and words that a document is aligned with at a time.
PIECE, WORDS_AT_ONCE = 4096, 1 << 17
#: Bytes of the columns of packed k-mers, windows (hash, id, place) and matches (id, place, other, place).
KMERS, WINDOWS, MATCHES = (4, 8, 4), (6, 8, 4), (8, 4, 8, 4)
SPACE = r"\x20\x09-\x0D"


def chains(y: np.ndarray, x: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Disjoint chains of the anchors (y, x, size), each in ascending y and x, best first.

    An anchor's score is its size plus that of the best chain that ends before it in y and in x,
    less GAP_COST for each word between, if that is positive. A Fenwick tree over x holds the prefix
    maxima of (score + GAP_COST * end), so that a chain takes n log n steps."""
    if len(y) == 1:
        return [np.zeros(1, dtype=np.int64)]
    order = np.lexsort((x, y)).tolist()
    ranks = (np.searchsorted(np.unique(x), x) + 1).tolist()
    top = max(ranks, default=0)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (top + 1)
    # plain numbers, as reading single ones of an array is slow
    y, x, size = y.tolist(), x.tolist(), size.tolist()
    score, before = [0.0] * len(y), [-1] * len(y)
    waiting: list[int] = []
    at = None
    for i in order:
        if y[i] != at:
            for j in waiting:
                entry, r = (score[j] + GAP_COST * (y[j] + x[j] + 2 * size[j]), j), ranks[j]
                while r <= top:
                    if entry > tree[r]:
                        tree[r] = entry
                    r += r & -r
            waiting, at = [], y[i]
        best, r = (-1e18, -1), ranks[i] - 1
        while r:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        gain = best[0] - GAP_COST * (y[i] + x[i])
        score[i] = size[i] + max(gain, 0)
        if gain > 0:
            before[i] = best[1]
        waiting.append(i)
    out, used = [], [False] * len(y)
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = before[i]
        if own:
            out.append(np.array(own[::-1]))
    return out


def regions(rows: np.ndarray, percent: int) -> list[tuple[int, int, int, int, int, int]]:
    """(id, other, y from, y to, x from, x to) in words of the chains of shared k-mers of two documents.

    Rows are (id, y, other, x). Neighbours on one diagonal are one anchor. A chain counts from
    EVIDENCE agreeing words on, as k-mers of a passage may lead to other documents. It is split at
    gaps over SEED_GAP that are more than the percentage leaves to all of it."""
    rows = rows[rows[:, 2] != rows[:, 0]]
    if not len(rows):
        return []
    rows = rows[np.lexsort((rows[:, 1], rows[:, 1] - rows[:, 3], rows[:, 2], rows[:, 0]))]
    step = np.diff(rows, axis=0)
    starts = np.flatnonzero(np.concatenate([[True], (step != (0, 1, 0, 1)).any(axis=1)]))
    sizes = np.diff(np.append(starts, len(rows))) + K - 1
    anchors = rows[starts]
    pairs = np.flatnonzero(np.concatenate([[True], (np.diff(anchors[:, [0, 2]], axis=0) != 0).any(axis=1)]))
    ends = np.append(pairs[1:], len(anchors))
    enough = np.add.reduceat(sizes, pairs) >= EVIDENCE
    # one anchor or two, as most pairs have, need no tree
    single, two = pairs[enough & (ends - pairs == 1)], pairs[enough & (ends - pairs == 2)]
    one = np.where(anchors[two, 1] <= anchors[two + 1, 1], two, two + 1)
    next_ = 2 * two + 1 - one
    a, b, n, m = anchors[one], anchors[next_], sizes[one], sizes[next_]
    dy, dx = b[:, 1] - a[:, 1], b[:, 3] - a[:, 3]
    joined = (dy > 0) & (dx > 0) & (n > GAP_COST * (dy + dx - 2 * n)) & (np.maximum(dy, dx) - n <= np.maximum(SEED_GAP, (n + m) * (100 - percent) // percent))
    a, b, n, m = a[joined], b[joined], n[joined], m[joined]
    alone = np.concatenate([single, one[~joined], next_[~joined]])
    alone = alone[sizes[alone] >= EVIDENCE]
    i, y, other, x = anchors[alone].T
    out = list(zip(*(c.tolist() for c in (i, other, y, y + sizes[alone], x, x + sizes[alone]))))
    out += zip(*(c.tolist() for c in (a[:, 0], a[:, 2], a[:, 1], np.maximum(a[:, 1] + n, b[:, 1] + m), a[:, 3], np.maximum(a[:, 3] + n, b[:, 3] + m))))
    several = enough & (ends - pairs > 2)
    for start, end in zip(pairs[several].tolist(), ends[several].tolist()):
        i, y, other, x = anchors[start:end].T
        size = sizes[start:end]
        for chain in chains(y, x, size):
            n = size[chain]
            if n.sum() < EVIDENCE:
                continue
            a, b = y[chain], x[chain]
            if len(n) == 1:
                out.append((int(i[0]), int(other[0]), int(a[0]), int(a[0] + n[0]), int(b[0]), int(b[0] + n[0])))
                continue
            most = max(SEED_GAP, int(n.sum()) * (100 - percent) // percent)
            split = np.flatnonzero((a[1:] - a[:-1] - n[:-1] > most) | (b[1:] - b[:-1] - n[:-1] > most)) + 1
            for p, q, r in zip(np.split(a, split), np.split(b, split), np.split(n, split)):
                if r.sum() >= EVIDENCE:
                    out.append((int(i[0]), int(other[0]), int(p[0]), int((p + r).max()), int(q[0]), int((q + r).max())))
    return out


def mixed_windows(rows: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(hash, id, place) of the windows of ``least`` words whose k-mers lead to several places.

    Rows are (id, y, other, x) in order. Each shared k-mer is named by its first document and place,
    the same in all documents, so that the names' hash is one of the window's words. Where all names
    are neighbours in one document, that document holds the whole window, and the chain of its
    k-mers finds it."""
    n, none = least - K + 1, (np.zeros(0, dtype=np.int64),) * 3
    if n < 1 or not len(rows):
        return none
    # of rows that repeat an id, one k-mer at each place
    rows = rows[np.concatenate([[True], (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)])]
    if len(rows) < n:
        return none
    i, y, other, x = np.ascontiguousarray(rows.T)
    names = windows(mix64(mix64(other.view(np.uint64)) ^ x.view(np.uint64)), n)
    jumps = np.concatenate([[0], np.cumsum((np.diff(other) != 0) | (np.diff(x) != 1))])
    low, high = slice(0, len(rows) - n + 1), slice(n - 1, len(rows))
    at = np.flatnonzero((i[high] == i[low]) & (y[high] - y[low] == n - 1) & (jumps[high] != jumps[low]))
    return (names[at] >> np.uint64(5)).view(np.int64), i[at], y[at]


def boxes(rows: np.ndarray, least: int) -> list[tuple[int, int, int, int, int, int]]:
    """Windows (id, y, other, x) as regions like those of regions(), overlapping ones together."""
    rows = rows[rows[:, 2] != rows[:, 0]]
    if not len(rows):
        return []
    rows = rows[np.lexsort((rows[:, 1], rows[:, 1] - rows[:, 3], rows[:, 2], rows[:, 0]))]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(rows, axis=0) != (0, 1, 0, 1)).any(axis=1)]))
    low, high = rows[starts], rows[np.append(starts[1:], len(rows)) - 1] + least
    runs = np.stack([low[:, 0], low[:, 2], low[:, 1], high[:, 1], low[:, 3], high[:, 3]], axis=1)
    out: list[tuple] = []
    near: list[list[int]] = []
    for i, other, a, b, c, d in sorted(map(tuple, runs.tolist())):
        out += [tuple(r) for r in near if r[:2] != [i, other] or r[3] < a]
        near = [r for r in near if r[:2] == [i, other] and r[3] >= a]
        for r in near:
            if r[4] <= d and c <= r[5] and (abs((a - c) - (r[2] - r[4])) <= least or abs((b - d) - (r[3] - r[5])) <= least):
                r[3], r[4], r[5] = max(r[3], b), min(r[4], c), max(r[5], d)
                break
        else:
            near.append([i, other, a, b, c, d])
    return out + [tuple(r) for r in near]


def stepped(sizes: tuple[int, ...]) -> list[bool]:
    """Which columns are kept as differences: ids, and the places of matches, which are in order."""
    return [k == 8 or sizes[0] == 8 for k in sizes]


def packed(columns: list[np.ndarray], sizes: tuple[int, ...], cuts: list[int] | None = None) -> list[bytes]:
    """Integer columns from each cut to the next (or whole) as the planes of their low bytes, compressed (most planes have few values).

    Differences of neighbours begin anew at each cut; their sign is in the lowest bit."""
    cuts = [0, len(columns[0])] if cuts is None else cuts
    planes = []
    for c, k, d in zip(columns, sizes, stepped(sizes)):
        c = c.astype("<i8")
        if d:
            step = c.copy()
            step[1:] -= c[:-1]
            step[cuts[:-1]] = c[cuts[:-1]]
            c = (step << 1) ^ (step >> 63)
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :k].T))
    compress = zstandard.ZstdCompressor(level=1).compress
    return [compress(b"".join([p[:, a:b].tobytes() for p in planes])) for a, b in zip(cuts, cuts[1:])]


def unpacked(data: bytes, sizes: tuple[int, ...]) -> list[np.ndarray]:
    n, at, out = len(data) // sum(sizes), 0, []
    for k, d in zip(sizes, stepped(sizes)):
        c = np.frombuffer(data, dtype=np.uint8, count=n * k, offset=at).reshape(k, n).T
        if k in (4, 8):
            c = np.ascontiguousarray(c).view(f"<u{k}")[:, 0].astype(np.uint64, copy=False)
        else:
            whole = np.zeros((n, 8), dtype=np.uint8)
            whole[:, :k] = c
            c = whole.view("<u8")[:, 0]
        signed = c.view(np.int64)
        out.append(np.cumsum((c >> np.uint64(1)).view(np.int64) ^ -(signed & 1)) if d else signed)
        at += n * k
    return out


def parts_for(docs: DataFrame) -> int:
    """A power of two that follows the size that Spark knows of ``docs``; PARTS where it knows none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return PARTS if size >> 60 else min(max(PARTS, 1 << (size // PART_BYTES).bit_length()), PARTS_MOST)


def dealt(rows: Iterator[tuple[np.ndarray, ...]], part, sizes: tuple[int, ...], parts: int = PARTS) -> Iterator[pd.DataFrame]:
    """Rows of columns, packed for each part; matches in the order of their first two columns."""
    waiting, n = [], 0
    # enough k-mers that a part gets several of them at a time; few parts are sorted faster
    most, kind = max(BUFFER, min(64 * parts, BUFFER_MOST)), np.int16 if parts <= 1 << 15 else np.int32

    def full():
        columns = [np.concatenate(c) for c in zip(*waiting)]
        to = part(*columns)
        order = np.argsort(to.astype(kind), kind="stable") if sizes[0] != 8 else np.lexsort((columns[1], columns[0], to))
        to, columns = to[order], [c[order] for c in columns]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to)).tolist()
        data = packed(columns, sizes, cuts)
        for i in range(0, len(data), 256):
            yield pd.DataFrame({"part": to[cuts[i : min(i + 256, len(data))]], "data": data[i : i + 256]})

    for columns in rows:
        if len(columns[0]):
            waiting.append(columns)
            n += len(columns[0])
        if n >= most:
            yield from full()
            waiting, n = [], 0
    if n:
        yield from full()


def gathered(batches, sizes: tuple[int, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The parts that dealt() has packed, from rows in the order of the part."""
    at, waiting, decompress = None, [], zstandard.ZstdDecompressor().decompress
    for pdf in batches:
        for part, data in zip(pdf["part"], pdf["data"]):
            if part != at and waiting:
                yield at, [np.concatenate(c) for c in zip(*waiting)]
                waiting = []
            at = part
            waiting.append(unpacked(decompress(data), sizes))
    if waiting:
        yield at, [np.concatenate(c) for c in zip(*waiting)]


def firsts(h: np.ndarray, i: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, y, other, x) of every place of the k-mers that several documents hold: x is the first place
    in the first of these documents, which is the row's own in that document."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    twice = np.concatenate([[False], h[1:] == h[:-1]])
    twice[:-1] |= twice[1:]
    h, i, y = h[twice], i[order[twice]], y[order[twice]]
    order = np.lexsort((y, i, h))
    h, i, y = h[order], i[order], y[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(h)))
    several = np.repeat(i[starts] != i[starts + sizes - 1], sizes)
    return i[several], y[several], np.repeat(i[starts], sizes)[several], np.repeat(y[starts], sizes)[several]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` neighbours, made from two overlapping halves."""
    size, out = 1, hashes
    while size < n:
        step = min(size, n - size)
        size, out = size + step, mix64(out[:-step] * np.uint64(0x9E3779B97F4A7C15) ^ out[step:])
    return out


def together(parts: list[list[int]], percent: int) -> list[list[int]]:
    """Parts (from, to, other from, other to, words) in order, those together whose words are ``percent``
    of what they span on either side, however long a single gap is.

    A part goes with as many before it as the percentage allows, until nothing more goes together."""
    while True:
        out: list[list[int]] = []
        for f, t, g, u, n in parts:
            words, best = n, None
            for k in range(len(out) - 1, -1, -1):
                words += out[k][4]
                if 100 * words >= percent * max(t - out[k][0], u - out[k][2]):
                    best = (k, words)
            if best:
                k, words = best
                f, g, n = out[k][0], out[k][2], words
                del out[k:]
            out.append([f, t, g, u, n])
        if len(out) == len(parts):
            return out
        parts = out


def aligned(one: np.ndarray, two: np.ndarray, shift: int, least: int, percent: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of word hashes ``one`` that ``two`` holds almost alike.

    Each k-mer of ``one`` is anchored at its occurrence in ``two`` next to the diagonal ``shift``
    (place in two less place in one); runs of anchors are chained, and runs stay
    together where ``percent`` of the words on either side agree."""
    a, b = rolled(one, min(K, len(one))), rolled(two, min(K, len(two)))
    if not len(a) or not len(b) or len(one) < K or len(two) < K:
        return []
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    low = ordered.searchsorted(a)
    hit = np.flatnonzero(ordered[np.minimum(low, len(b) - 1)] == a)
    if not len(hit):
        return []
    low = low[hit]
    at, after = order[low], np.minimum(low + 1, len(b) - 1)
    for n in np.flatnonzero((after > low) & (ordered[after] == a[hit])).tolist():
        i = hit[n]
        own = order[low[n] : ordered.searchsorted(a[i], "right")]
        j = int(own.searchsorted(i + shift))
        at[n] = own[j - 1] if j == len(own) or (j and i + shift - own[j - 1] <= own[j] - i - shift) else own[j]
    runs = np.concatenate([[0], np.flatnonzero((hit[1:] - hit[:-1] != 1) | (at[1:] - at[:-1] != 1)) + 1, [len(hit)]])
    starts = runs[:-1]
    sizes = runs[1:] - starts + K - 1
    y, x = hit[starts], at[starts]
    found = []
    for chain in chains(y, x, sizes):
        parts: list[list[int]] = []
        for i in chain.tolist():
            f, g, n = int(y[i]), int(x[i]), int(sizes[i])
            # runs that overlap on either side count their common words once
            over = max(0, parts[-1][1] - f, parts[-1][3] - g) if parts else 0
            if n > over:
                parts.append([f + over, f + n, g + over, g + n, n - over])
        parts = together(parts, percent)
        found += [(p[0], p[1]) for p in parts if p[4] >= least]
    # a chain takes each word of ``two`` once; a run repeated more often in ``one``, whose k-mers then
    # come back there, is found by whole windows: only those of which ``two`` has every k-mer are made
    if len(one) >= least and len(two) >= least and len(a) - len(np.unique(a)) > least - K:
        n = least - K + 1
        whole = np.arange(len(one) - least + 1) if n < 1 else hit[: max(len(hit) - n + 1, 0)]
        if n > 1:
            whole = whole[hit[n - 1 :] - whole == n - 1]
        if len(whole):
            held, own = np.sort(windows(two, least)), windows(one[whole[0] : whole[-1] + least], least)[whole - whole[0]]
            whole = whole[held[np.minimum(held.searchsorted(own), len(held) - 1)] == own]
        found += [(int(g[0]), int(g[-1]) + least) for g in np.split(whole, np.flatnonzero(np.diff(whole) != 1) + 1) if len(g)]
    return found


def merged_spans(found: Column) -> Column:
    """array<struct<lo, hi>> of sorted spans (first, last), those that touch as one."""
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    span = lambda lo, hi: F.array(F.struct(lo.alias("lo"), hi.alias("hi")))

    def add(a: Column, s: Column) -> Column:
        last, hi = F.element_at(a, -1), s["last"] + 1
        grown = F.concat(F.slice(a, 1, F.size(a) - 1), span(last["lo"], F.greatest(last["hi"], hi)))
        return F.when((F.size(a) > 0) & (s["first"] <= F.try_element_at(a, F.lit(-1))["hi"]), grown).otherwise(F.concat(a, span(s["first"], hi)))

    return F.aggregate(found, none, add)


def without_words(text: Column, spans: Column) -> Column:
    """``text`` without the words of the spans (lo, hi), nor the white space after them."""
    words = F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]++[{SPACE}]*+"), F.lit(0))
    kept = F.filter(words, lambda w, i: ~F.exists(spans, lambda s: (i >= s["lo"]) & (i < s["hi"])))
    return F.concat(F.regexp_extract(text, rf"^[{SPACE}]*+", 0), F.array_join(kept, ""))


def dedup_passages(docs: DataFrame, min_words: int = 50, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with passages cut that an earlier document (one with a smaller id) holds as well.

    A passage has min_words or more words that agree in order with the other document's, and
    ``percent`` of the words of either side in it agree. Added: n_words_removed (0 for untouched
    rows, whose text stays as it is, null included) and removed (array of struct(first, last, other):
    word places and the document that keeps the passage). Words ignore the case of ASCII letters and
    split at ASCII white space. Rows that repeat an id are one document: they are not compared
    with each other, and each is cut where its own words agree. Rows with a null id stay as they
    are. Input columns of the added names are replaced; an empty table gives an empty one."""
    ship(docs.sparkSession)
    base = without(docs, "n_words_removed", "removed")
    source = base.where(f"`{id_col}` IS NOT NULL").select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    # there are fewer matches than k-mers, and they are dealt to a quarter of the parts
    many = parts_for(source)
    bits = many.bit_length() - 1

    @tidied
    def seeded(batches):
        # 32 bits of a hash and those of the part: a k-mer that meets another one's place only makes
        # windows go to several places, which are then compared whole
        def held():
            for pdf in batches:
                for i, text in zip(pdf["id"], pdf["text"]):
                    words = word_hashes(folded(text))
                    if len(words) >= max(min_words, K):
                        grams = rolled(words, K)
                        yield (grams >> np.uint64(32 - bits)).view(np.int64), np.full(len(grams), i, dtype=np.int64), np.arange(len(grams))

        yield from dealt(held(), lambda h, i, y: h >> 32, KMERS, many)

    def shared(sizes):
        def met(batches):
            yield from dealt((firsts(h, i, y) for _, (h, i, y) in gathered(batches, sizes)), lambda i, y, other, x: mix64(i.view(np.uint64)).view(np.int64) & (many // 4 - 1), MATCHES, many)

        return tidied(met)

    names = ["id", "other", "y0", "y1", "x0", "x1"]
    regions_of = lambda out: pd.DataFrame({c: pd.array(list(v), dtype="Int64") for c, v in zip(names, zip(*out))})

    @tidied
    def chained(batches):
        mixed = []
        for _, columns in gathered(batches, MATCHES):
            rows = np.stack(columns, axis=1)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            if out := regions(rows, percent):
                yield regions_of(out).assign(part=pd.array([None] * len(out), dtype="Int64"), data=None)
            mixed.append(mixed_windows(rows, min_words))
        for pdf in dealt(iter(mixed), lambda h, i, y: h >> 48, WINDOWS):
            yield pd.DataFrame({c: pd.array([None] * len(pdf), dtype="Int64") for c in names}).assign(part=pdf["part"], data=pdf["data"])

    @tidied
    def boxed(batches):
        for _, columns in gathered(batches, MATCHES):
            if out := boxes(np.stack(columns, axis=1), min_words):
                yield regions_of(out)

    parts = lambda df: df.repartition("part").sortWithinPartitions("part")
    blobs = parts(source.mapInPandas(seeded, "part long, data binary"))
    seeds = parts(blobs.mapInPandas(shared(KMERS), "part long, data binary"))
    spanned = "id long, other long, y0 int, y1 int, x0 int, x1 int"
    met = checkpoint(seeds.mapInPandas(chained, f"{spanned}, part long, data binary"))
    # whole windows whose k-mers lead to several places meet the first document that holds them
    again = parts(parts(met.where("data IS NOT NULL").select("part", "data")).mapInPandas(shared(WINDOWS), "part long, data binary"))
    spans = checkpoint(met.where("data IS NULL").select(*names).unionByName(again.mapInPandas(boxed, spanned)))
    del blobs, seeds, met, again
    release(base.sparkSession)
    # what spans need of the documents they lead to is cut out before it meets them, each piece once
    places = spans.select(F.col("other").alias("id"), "x0", "x1").distinct()
    pieces = places.groupBy("id", F.floor(F.col("x0") / PIECE).alias("piece")).agg(F.collect_list(F.struct("x0", "x1")).alias("at"))

    @tidied
    def sliced(batches):
        for pdf in batches:
            for other, text, at in zip(pdf["id"], pdf["text"], pdf["at"]):
                data = folded(text)
                starts = np.append(word_starts(data), len(data))
                words = [data[starts[max(0, p["x0"] - MARGIN)] : starts[min(p["x1"] + MARGIN, len(starts) - 1)]] if p["x0"] < len(starts) else b"" for p in at]
                yield pd.DataFrame({"other": other, "x0": [p["x0"] for p in at], "x1": [p["x1"] for p in at], "words": words})

    cutouts = wanted(source, places.select("id").distinct()).join(pieces.select("id", "at"), "id").select("id", "text", "at").mapInPandas(sliced, "other long, x0 int, x1 int, words binary")
    key = F.concat_ws(" ", "other", "x0", "x1").alias("place")
    held = spread_join(spans.select("id", "other", "y0", "y1", "x0", key), cutouts.select(key, "words"), "place")
    # a document that much leads to is aligned with a part of it at a time
    load = spans.groupBy("id").agg(F.ceil(F.sum(F.col("x1") - F.col("x0") + 2 * MARGIN) / WORDS_AT_ONCE).alias("turns"))
    turn = F.pmod(F.xxhash64("other", "x0", "y0"), "turns").alias("turn")
    asked = held.join(load, "id").groupBy("id", turn).agg(F.collect_list(F.struct("other", "y0", "y1", "x0", "words")).alias("wants"))
    own = wanted(source, spans.select("id").distinct()).withColumn("mark", F.md5("text"))

    @tidied
    def matched(batches):
        for pdf in batches:
            out = []
            for i, mark, text, wants in zip(pdf["id"], pdf["mark"], pdf["text"], pdf["wants"]):
                words = word_hashes(folded(text))
                for w in wants:
                    lo, hi = max(0, w["y0"] - MARGIN), min(len(words), w["y1"] + MARGIN)
                    shift = (w["x0"] - max(0, w["x0"] - MARGIN)) - (w["y0"] - lo)
                    out += [(i, mark, lo + p, lo + q - 1, w["other"]) for p, q in aligned(words[lo:hi], word_hashes(w["words"]), shift, min_words, percent)]
            if out:
                yield pd.DataFrame(out, columns=["id", "mark", "first", "last", "other"])

    found = own.join(asked, "id").select("id", "mark", "text", "wants").mapInPandas(matched, "id long, mark string, first int, last int, other long")
    i, mark, gone, done = fresh(base, "_id", "_mark", "_gone", "_cut")
    removed = found.groupBy(F.col("id").alias(i), F.col("mark").alias(mark)).agg(F.array_sort(F.collect_set(F.struct("first", "last", "other"))).alias(gone))
    removed = checkpoint(removed)
    # texts that nothing is taken from stay as they are and where they are
    text, spans = F.col(f"`{text_col}`"), F.col(done)
    joined = base.join(removed, (F.col(f"`{id_col}`").cast("long") == F.col(i)) & (F.md5(text) == F.col(mark)), "left").withColumn(done, merged_spans(F.col(gone)))
    none = F.array().cast("array<struct<first:int,last:int,other:bigint>>")
    n = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return joined.select(
        *[F.when(spans.isNull(), text).otherwise(without_words(text, spans)).alias(c) if c == text_col else F.col(f"`{c}`") for c in base.columns],
        F.coalesce(n, F.lit(0)).cast("long").alias("n_words_removed"),
        F.coalesce(gone, none).alias("removed"),
    )

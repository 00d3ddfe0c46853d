"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 3).

Encodings of neighbouring byte strings form a monoid: a long match is halved down to leaves, leaves
are merged by rank, and two encodings are joined by re-encoding a window around the boundary. The
tokens outside the window are right as soon as the token on either side of it encodes to itself
together with its new neighbour, since a sequence is the BPE encoding if and only if all its
neighbouring pairs are; else the window doubles. Decoding concatenates what the leaves stand for.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, without

#: White space as the Unicode property has it; regex's own class also holds U+001C to U+001F.
SPACE = r"\p{White_Space}"


class ByteBPE:
    """Encoder and decoder for a rank file."""

    LEAF, WORDS = 48, 250_000

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\s", SPACE).replace(r"\S", r"\P{White_Space}"))
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def leaf(self, piece: bytes) -> list[int]:
        """Merges by rank, leftmost first among equals; quadratic, for short strings."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(ranks)
        cost = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while cost and (best := min(cost)) < none:
            i = cost.index(best)
            parts[i] += parts[i + 1]
            del parts[i + 1], cost[i]
            if i < len(cost):
                cost[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                cost[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def window(self, piece: bytes) -> list[int]:
        """As leaf(), by a heap, for long strings."""
        if len(piece) <= 4 * self.LEAF:
            return self.leaf(piece)
        n = len(piece)
        start, end, after, before = list(range(n)), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := self.ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if start[i] >= 0 else n
            if j >= n or end[j] != stop:
                continue
            end[i], after[i], start[j] = stop, after[j], -1
            if after[j] < n:
                before[after[j]] = i
            offer(i, after[i])
            offer(before[i], i)
        return [self.ranks[piece[i : end[i]]] for i in range(n) if start[i] >= 0]

    def fits(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.leaf_pairwise(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def leaf_pairwise(self, piece: bytes) -> list[int]:
        """leaf() of two tokens inside a longer string, where the whole isn't looked up first."""
        whole = self.ranks.get(piece)
        if whole is None:
            return self.leaf(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 40:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two neighbours from their encodings."""
        w = 1
        while True:
            left, right = a[-w:], b[:w]
            new = self.window(b"".join(map(self.bytes_of.__getitem__, left + right)))
            if (w >= len(a) or self.fits(a[-w - 1], new[0])) and (w >= len(b) or self.fits(new[-1], b[w])):
                return a[:-w] + new + b[w:]
            w *= 2

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= self.LEAF:
            return self.leaf(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def word(self, match: str) -> tuple[int, ...]:
        if len(self.words) >= self.WORDS:
            self.words.clear()
        piece = match.encode()
        ids = tuple(self.tree(piece) if piece not in self.ranks else (self.ranks[piece],))
        if len(match) <= self.LEAF:
            self.words[match] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out: list[int] = []
        known, parts = self.words.get, []
        text = text or ""
        # a list of all matches is faster, but too large for the longest texts
        for match in self.pattern.findall(text) if len(text) < 1 << 20 else (m.group() for m in self.pattern.finditer(text)):
            out += known(match) or self.word(match)
            if len(out) > 1_000_000:
                parts.append(np.array(out, dtype="<u4"))
                out = []
        return np.concatenate([*parts, np.array(out, dtype="<u4")])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, concatenated up a tree over blocks of ids."""
        blocks = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + 65536].tolist())) for i in range(0, len(ids), 65536)]
        while len(blocks) > 1:
            blocks = [b"".join(blocks[i : i + 2]) for i in range(0, len(blocks), 2)]
        return blocks[0] if blocks else b""


_loaded: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids (binary, little-endian unsigned 32-bit) of each whole text.

    A null text is taken as empty: no ids. Rows are independent; an empty table gives an empty one;
    an input column named ids is replaced. Special tokens aren't recognised."""
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        b = loaded(ranks_path, pattern)
        return pd.Series([b.encode(x).tobytes() for x in texts], dtype=object)

    return without(docs, "ids").withColumn("ids", encoded(F.col(text_col)))


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with decoded (binary): the bytes that the ids stand for; null ids give no bytes."""
    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        b = loaded(ranks_path, pattern)
        return pd.Series([b.decode(np.frombuffer(x or b"", dtype="<u4")) for x in ids], dtype=object)

    return without(rows, "decoded").withColumn("decoded", decoded(F.col(ids_col)))




def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """encode_texts() and decode_ids() at once: ``docs`` with ids and decoded, each text encoded once."""
    ship(docs.sparkSession)

    @F.pandas_udf("ids binary, decoded binary")
    def both(texts: pd.Series) -> pd.DataFrame:
        b = loaded(ranks_path, pattern)
        ids = [b.encode(x) for x in texts]
        return pd.DataFrame({"ids": [x.tobytes() for x in ids], "decoded": [b.decode(x) for x in ids]})

    base = without(docs, "ids", "decoded")
    (name,) = fresh(base, "_both")
    rows = base.select("*", both(F.col(f"`{text_col}`")).alias(name))
    return rows.select(*[F.col(f"`{c}`") for c in base.columns], f"{name}.ids", f"{name}.decoded")

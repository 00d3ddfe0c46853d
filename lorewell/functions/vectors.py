"""Vector expressions over array<double>: norms, cosine, int8 codes, truncation; hashed embeddings."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound, tokens


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    over = lambda s: F.transform(s["v"], lambda x: x / F.when(s["n"] == 0, F.lit(1.0)).otherwise(s["n"]))
    return bound(v, lambda w: bound(F.struct(w.alias("v"), F.sqrt(dot(w, w)).alias("n")), over))


def cosine(a: Column, b: Column) -> Column:
    return dot(normalised(a), normalised(b))


def int8_scale(v: Column) -> Column:
    most = F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0))
    return F.when(most == 0, F.lit(1e-9)).otherwise(most) / 127


def int8_codes(v: Column) -> Column:
    code = lambda x, s: F.least(F.greatest(F.rint(x / s), F.lit(-127.0)), F.lit(127.0)).cast("tinyint")
    return bound(F.struct(v.alias("v"), int8_scale(v).alias("s")), lambda b: F.transform(b["v"], lambda x: code(x, b["s"])))


def int8_decoded(codes: Column, scale: Column) -> Column:
    return bound(F.struct(codes.alias("c"), scale.alias("s")), lambda b: F.transform(b["c"], lambda c: c * b["s"]))


def truncated(v: Column, dims: int) -> Column:
    return normalised(F.slice(v, 1, dims))


def hashed_features(rows: DataFrame, id_col: str, text_col: str, dims: int = 256) -> DataFrame:
    """(id, bucket, value, norm): signed token hashes plus half of every character trigram's."""
    if dims != 256:
        raise ValueError("buckets are the last byte of a hash")
    digit = lambda h, at: F.position(F.substring(h, at, 1), F.lit("0123456789abcdef")) - 1
    text = F.col(text_col)
    grams = F.when(
        F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    ).otherwise(F.array().cast("array<string>"))
    # buckets are summed before they are shuffled
    of = lambda values, weight: rows.select(F.col(id_col).alias("id"), F.explode(values).alias("f")).select("id", F.md5("f").alias("h")).select("id", (digit(F.col("h"), 31) * 16 + digit(F.col("h"), 32)).alias("bucket"), weight.alias("value"))
    sign = F.when(digit(F.col("h"), 30) % 2 == 1, 1.0).otherwise(-1.0)
    every = of(tokens(text), sign).unionByName(of(grams, F.lit(0.5)))
    summed = every.groupBy("id", "bucket").agg(F.sum("value").alias("value")).where("value != 0")
    norms = summed.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return summed.join(norms, "id")


class Codes(dict):
    """Features as twice their bucket, and one more where a token's sign is positive; kept up to a limit."""

    LIMIT = 200_000

    def __missing__(self, feature: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = hashlib.md5(feature.encode()).digest()
        found = self[feature] = 2 * h[15] + (h[14] & 1)
        return found


class Hashed:
    """hashed_features() of texts as dense vectors, for Arrow batches."""

    TOKEN = re.compile("[A-Za-z0-9]+|[一-鿿]")
    #: Trigrams of so few letters are looked up in a table, and characters that are taken at once.
    TABLE, ROOM = 1 << 24, 1 << 21

    def __init__(self):
        self.known = Codes()

    def of(self, features: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, features), np.int64, len(features))

    def buckets(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The buckets of the trigrams at ``starts`` of a run of code points; each different one is hashed once."""
        seen = np.zeros(int(points.max(initial=0)) + 1, dtype=bool)
        seen[points] = True
        letters, code = np.flatnonzero(seen).astype(np.uint32), (np.cumsum(seen) - 1)[points]
        n = len(letters)
        grams = (code[starts] * n + code[starts + 1]) * n + code[starts + 2]
        if n**3 <= self.TABLE:
            held = np.zeros(n**3, dtype=bool)
            held[grams] = True
            distinct, place = np.flatnonzero(held), None
        else:
            distinct, place = np.unique(grams, return_inverse=True)
        texts = letters[np.stack([distinct // n**2, distinct // n % n, distinct % n], axis=1)].tobytes().decode("utf-32-le", "surrogatepass")
        of = self.of([texts[i : i + 3] for i in range(0, len(texts), 3)]) >> 1
        if place is not None:
            return of[place]
        table = np.zeros(n**3, dtype=np.uint8)
        table[distinct] = of
        return table[grams]

    def matrix(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of texts as rows, and how many tokens each has."""
        v, sizes = np.zeros((len(texts), 256)), np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(texts):
            # some 2 million characters at a time, one text at least
            to, room = at + 1, self.ROOM - len(texts[at])
            while to < len(texts) and len(texts[to]) <= room:
                room -= len(texts[to])
                to += 1
            some = texts[at:to]
            points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            owner = np.repeat(np.arange(len(some)), [len(t) for t in some])
            starts = np.flatnonzero(owner[:-2] == owner[2:]) if len(owner) > 2 else np.zeros(0, dtype=np.int64)
            tokens = [self.TOKEN.findall(t.lower()) for t in some]
            sizes[at:to] = [len(t) for t in tokens]
            sums = 0.5 * np.bincount(owner[starts] * 256 + self.buckets(points, starts), minlength=len(some) * 256) if len(starts) else np.zeros(len(some) * 256)
            codes = self.of(list(chain.from_iterable(tokens)))
            places = np.repeat(np.arange(len(some)), sizes[at:to]) * 256 + (codes >> 1)
            sums += np.bincount(places, weights=2.0 * (codes & 1) - 1, minlength=len(some) * 256)
            v[at:to] = sums.reshape(len(some), 256)
            at = to
        return v, sizes

    def vector(self, text: str) -> np.ndarray:
        return self.matrix([text])[0][0]

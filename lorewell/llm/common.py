"""Helpers shared by the corpus operators: shipping of code, joins on frequent keys, words."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import shutil
import sys
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpoint, compact, connected_components, counted, parts_of, release  # noqa: F401

#: ASCII white space, at which the word operators split; bytes.split() uses the same set.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


#: Bytes in an Arrow batch at most: some rows hold long texts or whole blocks.
BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors that don't have it on their path, and keeps the bytes
    of the session's Arrow batches (not their rows) small enough for long texts."""
    sc = spark.sparkContext
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().rstrip("b")
    if not most.lstrip("-").isdigit() or not 0 < int(most) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_lorewell_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lorewell-code-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "lorewell_code"), "zip", root, "lorewell"))
    sc._lorewell_shipped = True


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (names compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Keys that spread_join() spreads at most, the parts of each, and the rows from which on it does.
HOT, SALTS, HOT_ROWS = 256, 64, 1024


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key, so that no key fills a task.

    The HOT most frequent keys (so many rows are broadcast) are dealt to SALTS parts by the hash of
    the row, and their row of ``keyed`` goes to each; no row is left out. ``counts`` (key, count) is
    known, or ``rows`` is read twice."""
    n, hot, salt = fresh(rows.join(keyed.limit(0), key), "_n", "_hot", "_salt")
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias(n)) if counts is None else counts.select(key, F.col("count").alias(n))
    often = often.where(f"{n} >= {HOT_ROWS}").orderBy(F.col(n).desc(), key).limit(HOT)
    often = F.broadcast(often.select(key, F.lit(True).alias(hot)))
    own = F.when(F.col(hot), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(often, key, "left").withColumn(salt, own).drop(hot)
    right = keyed.join(often, key, "left").withColumn(salt, F.explode(every)).drop(hot)
    return left.join(right, [key, salt], how).drop(salt)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (xor-shift and multiply)."""
    x = x.astype(np.uint64)
    y = x >> np.uint64(33)
    x ^= y
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= np.right_shift(x, np.uint64(33), out=y)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= np.right_shift(x, np.uint64(33), out=y)
    return x


#: A value for each byte, 0 for white space, and which bytes are white space.
_byte_values = mix64(np.arange(1, 257, dtype=np.uint64) << np.uint64(32))
_is_space = np.zeros(256, dtype=bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
_byte_values[_is_space] = 0
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = 1 << 20


def _place_factors(n: int) -> np.ndarray:
    """Odd factors for the first n places of a word."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


_first_places = _place_factors(256)


def folded(text: str | None) -> bytes:
    """The UTF-8 bytes of a text with ASCII letters in lower case; none for null."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def word_starts(data: bytes) -> np.ndarray:
    """The places at which the words of ``data`` begin."""
    space = _is_space[np.frombuffer(data, dtype=np.uint8)]
    first = ~space
    first[1:] &= space[:-1]
    return np.flatnonzero(first)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of folded() texts, in order.

    A word's hash is the scrambled sum of a value of each byte times a factor of its place, so that
    a block of text is hashed by array operations without splitting it."""
    if len(data) > BLOCK:
        out, at = [], 0
        while at < len(data):
            gap = _SPACE.search(data, at + BLOCK)
            end = gap.end() if gap else len(data)
            out.append(_block_hashes(data[at:end]))
            at = end
        return np.concatenate(out)
    return _block_hashes(data)


def _block_hashes(data: bytes) -> np.ndarray:
    starts = word_starts(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = np.empty_like(starts)
    sizes[:-1], sizes[-1] = starts[1:] - starts[:-1], len(data) - starts[-1]
    factors = _first_places if (most := int(sizes.max())) <= len(_first_places) else _place_factors(most)
    own = np.frombuffer(data, dtype=np.uint8)[starts[0] :]
    starts = starts - starts[0]
    places = np.arange(len(own)) - np.repeat(starts, sizes)
    return mix64(np.add.reduceat(_byte_values[own] * factors[places], starts))


#: What to empty after each task.
forget: list[Callable[[], None]] = []


def tidied(rows):
    """A generator function over the batches of a task that gives its memory back when the task ends.

    Workers live on, and several operators of a job meet in one; so caches and freed blocks of one
    stage would take room from the next."""

    @functools.wraps(rows)
    def wrapper(batches):
        try:
            yield from rows(batches)
        finally:
            import pyarrow

            for empty in forget:
                empty()
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return wrapper


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` neighbours in ``hashes``."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    high = out.copy()
    for i in range(k if n > 0 else 0):
        out ^= hashes[i : i + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= np.right_shift(out, np.uint64(29), out=high)
    return mix64(out)

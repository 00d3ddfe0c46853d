"""Packing along a space-filling curve (operator 5).

Each document becomes a hashed vector of its tokens, projected to four dimensions; the Hilbert key
of that point orders the corpus so that neighbours on the curve hold alike texts. The range sort on
(key, salt) splits groups of copies over partitions, and each partition cuts its stream of tokens
into full sequences, its rest into sequences whose lengths are powers of two: no padding at all.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mix64, ship, tidied

DIMS, BITS, BUCKETS = 4, 12, 2048
#: Between a letter and a space with a letter the pre-tokenizer always splits.
SAFE_CUT = regex.compile(r"(?<=\p{L})(?= \p{L})")
SEGMENT = 200_000

_encodings: dict = {}


def _encoding(path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """The encoder of a rank file; special strings inside texts become their ids."""
    if (key := (path, pattern, special)) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    return _encodings[key]


def segments(text: str) -> list[str]:
    """``text`` in parts of some SEGMENT characters, cut only where tokens never cross."""
    out, at = [], 0
    while len(text) - at > 2 * SEGMENT and (m := SAFE_CUT.search(text, at + SEGMENT)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def token_ids(text: str | None, tokenizer: tuple) -> np.ndarray:
    """The ids of a whole text, then 0, as unsigned 32-bit integers; a null text is empty."""
    e = _encoding(*tokenizer)
    parts = [e.encode_to_numpy(p, allowed_special="all").astype("<u4") for p in segments(text or "")]
    return np.concatenate([*parts, np.zeros(1, dtype="<u4")])


def projection() -> np.ndarray:
    """The fixed matrix from hashed token buckets to DIMS dimensions (signs from a hash)."""
    bits = mix64(np.arange(BUCKETS * DIMS, dtype=np.uint64) + np.uint64(12345)) & np.uint64(1)
    return (bits.astype(np.float64) * 2 - 1).reshape(BUCKETS, DIMS)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows) below 2**bits, by turning the
    coordinates into the transposed index bit by bit and interleaving its bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document's hashed, projected and normalised token counts."""
    matrix = projection()
    points = np.zeros((len(ids), DIMS))
    for r, one in enumerate(ids):
        counts = np.bincount((mix64(one) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        points[r] = counts @ matrix / np.sqrt((counts.astype(np.float64) ** 2).sum())
    steps = np.clip((np.clip(points, -4, 4) + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(steps, BITS)


def cut_lengths(room: int, size: int) -> list[int]:
    """How a rest of ``room`` < size tokens is cut: lengths that are powers of two."""
    return [1 << b for b in range(size.bit_length(), -1, -1) if room >> b & 1]


def _pack(rows: Iterator, size: int) -> Iterator[tuple]:
    """Pieces (doc_id, start, ids, doc_tokens, sequence, offset) of a partition's sorted rows."""
    sequence, held, filled = 0, [], 0
    for doc_id, ids in rows:
        at = 0
        while at < len(ids):
            n = min(size - filled, len(ids) - at)
            held.append((doc_id, at, ids[at : at + n], len(ids)))
            at, filled = at + n, filled + n
            if filled == size:
                offset = 0
                for d, s, part, total in held:
                    yield d, s, part, total, sequence, offset
                    offset += len(part)
                sequence, held, filled = sequence + 1, [], 0
    lengths = cut_lengths(filled, size)
    offset = 0
    for d, s, part, total in held:
        at = 0
        while at < len(part):
            n = min(lengths[0] - offset, len(part) - at)
            yield d, s + at, part[at : at + n], total, sequence, offset
            at, offset = at + n, offset + n
            if offset == lengths[0]:
                lengths, offset, sequence = lengths[1:], 0, sequence + 1


def pack_documents(docs: DataFrame, tokenizer: tuple, size: int = 1024, text_col: str = "text") -> DataFrame:
    """Packs whole texts, tokenised by (rank file, pattern, ((special string, id), ...)).

    One row for each piece of a document: doc_id, start, length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are one token (the closing 0). Repeated rows are packed once each; null
    ids stay null; an empty table gives an empty one; other columns are dropped, so that names
    can't clash. Tokens are computed once and kept in the checkpoint folder, since the range sort
    reads its input twice. Groups of equal keys are split by a salt made of the document's id."""
    ship(docs.sparkSession)
    if size & (size - 1):
        raise ValueError("size must be a power of two")

    @tidied
    def keyed(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                part = pdf.iloc[i : i + 512]
                ids = [token_ids(x, tokenizer) for x in part["text"]]
                salt = [zlib.crc32(str(x).encode()) for x in part["key"]]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"], "curve": curve_keys(ids), "salt": salt,
                        "ids": [(x.astype("<u2") if x.max() < 65536 else x).tobytes() for x in ids], "wide": [bool(x.max() >= 65536) for x in ids]
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col(text_col).alias("text"))
    tokens = checkpoint(source.mapInPandas(keyed, f"doc_id {kind}, curve long, salt long, ids binary, wide boolean"))
    order = ["curve", "salt", "doc_id", "ids"]
    ranged = tokens.repartitionByRange("curve", "salt", "doc_id").sortWithinPartitions(*order)

    @tidied
    def packed(batches):
        def rows():
            for pdf in batches:
                for doc_id, ids, wide in zip(pdf["doc_id"], pdf["ids"], pdf["wide"]):
                    yield doc_id, np.frombuffer(ids, dtype="<u4" if wide else "<u2").astype("<u4")

        first = TaskContext.get().partitionId() << 40
        block: list[tuple] = []
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for d, s, part, total, sequence, offset in _pack(rows(), size):
            block.append((d, s, len(part), part.tobytes(), total, first + sequence, offset))
            if len(block) == 4096:
                yield pd.DataFrame(block, columns=names)
                block = []
        if block:
            yield pd.DataFrame(block, columns=names)

    return ranged.select("doc_id", "ids", "wide").mapInPandas(packed, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

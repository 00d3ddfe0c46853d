"""Quality classifier by attention-based multiple-instance learning (operator 9).

A document is a bag of passages. Every passage is encoded as the mean of hashed word vectors (the
word and its shape) and a few measures of form; a dense layer and gated attention, learned from
labels of whole documents, weigh the passages, and the weighted mean is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import forget, mix64, ship, tidied, without

PASSAGE, HASHED, FORMS = 64, 48, 9
WIDTH = 2 * HASHED + FORMS + 3
HIDDEN, ATTENTION = 32, 16
#: Passages that go through the model together.
BAGS = 2048


def _signs(keys: np.ndarray) -> np.ndarray:
    """HASHED fixed signs for each of the 64-bit keys."""
    bits = mix64(keys).astype("<u8").view(np.uint8).reshape(len(keys), 8)
    return (np.unpackbits(bits, axis=1)[:, :HASHED].astype(np.float32) * 2) - 1


WORD_ROWS = 1 << 14
_word_table = _signs(np.arange(WORD_ROWS, dtype=np.uint64) + np.uint64(1 << 40))


class Shapes(dict):
    """Rows of features of word shapes: hashed signs, then measures of form."""

    LIMIT = 50_000

    def __init__(self):
        self.rows = np.zeros((512, HASHED + FORMS), dtype=np.float32)

    def __missing__(self, shape: tuple) -> int:
        upper, title, alpha, digit, alnum, first, last, n = shape
        i = len(self)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        signs = _signs(np.array([xxh3_64_intdigest(repr(shape).encode())], dtype=np.uint64))[0]
        self.rows[i] = np.concatenate([signs, [upper, title, alpha, digit, alnum, first != "", last != "", n / 10, n == 1]])
        self[shape] = i
        return i


class Words(dict):
    """Of words seen: row of the word table, and row of the shapes times WORD_ROWS."""

    LIMIT = 150_000

    def __init__(self):
        self.shapes = Shapes()

    def __missing__(self, word: str) -> int:
        first, last = word[0], word[-1]
        shape = (word.isupper(), word.istitle(), word.isalpha(), word.isdigit(), word.isalnum(), "" if first.isalnum() else first, "" if last.isalnum() else last, min(len(word), 24))
        value = self[word] = self.shapes[shape] * WORD_ROWS + xxh3_64_intdigest(word.lower().encode()) % WORD_ROWS
        return value


_words = Words()


def _renew() -> None:
    global _words
    _words = Words()


forget.append(_renew)


def encode_passages(text: str | None) -> np.ndarray:
    """A row for each passage of PASSAGE words (at least one row)."""
    words = (text or "").split()
    starts = np.arange(0, max(len(words), 1), PASSAGE)
    out = np.zeros((len(starts), WIDTH), dtype=np.float32)
    if words:
        if len(_words) >= Words.LIMIT or len(_words.shapes) >= Shapes.LIMIT:
            _renew()
        index = np.fromiter(map(_words.__getitem__, words), dtype=np.int64, count=len(words))
        for b in range(0, len(starts), 256):
            own = starts[b : b + 256]
            part = index[own[0] : own[-1] + PASSAGE]
            n = np.diff(np.append(own, min(own[-1] + PASSAGE, len(words))))[:, None]
            at = own - own[0]
            out[b : b + 256, :HASHED] = np.add.reduceat(_word_table[part % WORD_ROWS], at, axis=0) / n
            out[b : b + 256, HASHED:-3] = np.add.reduceat(_words.shapes.rows[part // WORD_ROWS], at, axis=0) / n
            out[b : b + 256, -1] = n[:, 0] / PASSAGE
        for r, s in enumerate(starts):
            own = words[s : s + PASSAGE]
            out[r, -2] = len(set(own)) / len(own)
            again = index[s + 1 : s + PASSAGE] == index[s : s + len(own) - 1]
            out[r, -3] = again.sum() / len(own)
    return out


def forward(p: dict, x: np.ndarray, starts: np.ndarray):
    """Scores of the bags that begin at ``starts`` in the passages x, and what backward() needs."""
    z = (x - p["mean"]) / p["scale"]
    h = np.tanh(z @ p["W"] + p["b"])
    u, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (u * g) @ p["w"]
    sizes = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), sizes)
    a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    m = np.add.reduceat(a[:, None] * h, starts, axis=0)
    s = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))
    return s, (z, h, u, g, a, bag, m)


def gradients(p: dict, y: np.ndarray, starts: np.ndarray, s: np.ndarray, kept, weight: np.ndarray) -> dict:
    z, h, u, g, a, bag, m = kept
    ds = (s - y) * weight
    dm = ds[:, None] * p["c"]
    da = (dm[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    du, dg = de[:, None] * p["w"] * g * (1 - u**2), de[:, None] * p["w"] * u * g * (1 - g)
    dh = (a[:, None] * dm[bag] + du @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
    return {"W": z.T @ dh, "b": dh.sum(0), "V": h.T @ du, "U": h.T @ dg, "w": (u * g).T @ de, "c": m.T @ ds, "d": ds.sum()}


def train(bags: list[np.ndarray], labels: list[int], epochs: int = 30, seed: int = 7) -> dict | None:
    """Parameters fitted with Adam on class-balanced cross-entropy; None unless both labels occur."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags).astype(np.float64)
    p = {"mean": every.mean(0), "scale": every.std(0) + 0.05}
    shapes = {"W": (WIDTH, HIDDEN), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION)}
    p |= {k: rng.normal(0, 1 / np.sqrt(v[0]), v) for k, v in shapes.items()}
    p |= {"b": np.zeros(HIDDEN), "w": rng.normal(0, 0.25, ATTENTION), "c": rng.normal(0, 0.2, HIDDEN), "d": 0.0}
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    names = ["W", "b", "V", "U", "w", "c", "d"]
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            own = order[i : i + 64]
            x = np.concatenate([bags[j] for j in own]).astype(np.float64)
            starts = np.cumsum([0] + [len(bags[j]) for j in own[:-1]])
            s, kept = forward(p, x, starts)
            grad = gradients(p, y[own], starts, s, kept, balance[own] / len(own))
            step += 1
            for k in names:
                d = grad[k] + (1e-4 * p[k] if k in ("W", "V", "U") else 0)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                p[k] = p[k] - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1"


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000, max_chars: int = 48_000_000, text_col: str = "text") -> dict | None:
    """A model from a bounded sample of the labelled rows that aren't held out.

    Ids are taken in the order of their hash, at most ``max_train``, as long as their texts have at
    most ``max_chars`` characters together (some 8 M words); a text that doesn't fit any more is left
    out of the sample as a whole. Of a sampled document every passage is encoded. These two bound
    what reaches the driver; scoring has no such bound. Null labels and ids with contrary labels
    teach nothing; rows that repeat an id each count."""
    ship(docs.sparkSession)
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high AND low IN (0, 1)")
    # ids and lengths alone are joined and ordered; the texts meet the few that are picked, whose number is bound
    sizes = docs.groupBy("doc_id").agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).alias("chars"))
    known = sizes.join(one.where(f"NOT ({HELD_OUT})"), "doc_id")
    few = known.where(f"chars <= {max_chars}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    so_far = F.sum("chars").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    picked = few.withColumn("so_far", so_far).where(f"so_far <= {max_chars}").select("doc_id", "low")
    picked = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")

    @tidied
    def encoded(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": [encode_passages(t).tobytes() for t in pdf["text"]], "y": pdf["low"]})

    rows = picked.select("text", "low").mapInPandas(encoded, "x binary, y int").collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["y"]))
    return train([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH) for r in rows], [r["y"] for r in rows])


def scores(p: dict, texts) -> list[float]:
    """The scores of texts; bags of up to BAGS passages go through the model together."""
    out, waiting, n = [], [], 0
    for i, text in enumerate(texts):
        waiting.append(encode_passages(text))
        n += len(waiting[-1])
        if n >= BAGS or i == len(texts) - 1:
            starts = np.cumsum([0] + [len(x) for x in waiting[:-1]])
            # rounded, since sums in a product may depend on the rows beside
            out += np.round(forward(p, np.concatenate(waiting), starts)[0], 9).tolist()
            waiting, n = [], 0
    return out


def score(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """``docs`` with score (likelihood of label 1) and predicted (1 if score >= 0.5, else 0).

    Every passage of every text counts; null and empty texts are one empty passage. Without a
    model (no usable labels) every score is 0.5. Repeated rows are scored alike; an empty table
    gives an empty one; columns of these names are replaced. Only the text is looked at."""
    ship(docs.sparkSession)
    packed = pickle.dumps(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = pickle.loads(packed)
        yield from tidied(lambda many: (pd.Series([0.5] * len(own) if p is None else scores(p, own.tolist()), dtype="float64") for own in many))(batches)

    base = without(docs, "score", "predicted")
    return base.withColumn("score", scored(F.col(text_col))).withColumn("predicted", F.expr("int(score >= 0.5)"))

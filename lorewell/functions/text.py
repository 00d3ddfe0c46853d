"""Text expressions: tokens, sections, sentences, windows, ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, and single CJK characters; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9]+|[一-鿿]"), F.lit(0)), F.array().cast("array<string>"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: inside a lambda it would be for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counted(words: Column) -> Column:
    """array<struct<term, tf>>: each of the words once, with how often it occurs; within its row, without a shuffle."""
    # of the words in order, the last of each run
    ends = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: ~F.get(w, i - 1).eqNullSafe(F.get(w, i)))
    one = lambda s: F.transform(s["e"], lambda i, j: F.struct(F.get(s["w"], i - 1).alias("term"), (i - F.coalesce(F.get(s["e"], j - 1), F.lit(0))).cast("long").alias("tf")))
    return bound(F.sort_array(words), lambda w: bound(F.struct(w.alias("w"), ends(w).alias("e")), one))


def stable_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


#: Characters of white space in the Unicode sense.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends; a pattern would try each space inside."""
    return F.btrim(text, F.lit(SPACE))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def count_of(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in the text."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def sections(text: Column) -> Column:
    """array<struct<title, body>>: split before headings of one to three #; empty bodies go, and a
    text without any body is one section without a title."""
    part = lambda p: F.struct(
        F.when(p.rlike(r"(?d)^#{1,3}\s*."), strip(F.regexp_extract(p, r"(?d)^#{1,3}\s*(.+)", 1))).otherwise(F.lit("")).alias("title"),
        strip(F.when(p.rlike(r"(?d)^#{1,3}\s*."), F.regexp_replace(p, r"(?d)^#{1,3}\s*.+", "")).otherwise(p)).alias("body"),
    )
    split = F.filter(F.transform(F.split(strip(text), "\n(?=#{1,3}\\s)", -1), part), lambda s: s["body"] != "")
    return bound(split, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit("").alias("title"), strip(text).alias("body")))))


def windows(body: Column, size: int = 500, overlap: int = 80) -> Column:
    """Start positions of the sliding windows over a text; none for an empty one."""
    n = F.length(body)
    steps = F.sequence(F.lit(0).cast("bigint"), last_window(n, size, overlap), F.lit(size - overlap).cast("bigint"))
    return F.when(n > 0, steps).otherwise(F.array().cast("array<bigint>"))


def last_window(n: Column, size: int = 500, overlap: int = 80) -> Column:
    """Where the last window over n characters starts."""
    step = size - overlap
    return (F.greatest(F.lit(0), F.ceil((n - size) / step)) * step).cast("bigint")


def sentences(text: Column) -> Column:
    """Sentences with their terminators, stripped; blank ones go."""
    return F.filter(F.transform(F.split(text, "(?<=[。.!?！？\n])", -1), strip), lambda s: s != "")


def compress(text: Column, query: Column, most: int = 3) -> Column:
    """The (at most three) sentences that share most tokens with the query, else the first 200 characters."""
    wanted = F.array_distinct(tokens(query))
    scored = F.transform(sentences(text), lambda s, i: F.struct((-F.size(F.array_intersect(wanted, tokens(s)))).alias("o"), i.alias("i"), s.alias("s")))
    best = F.filter(F.slice(F.array_sort(scored), 1, most), lambda x: x["o"] < 0)
    return F.when(F.size(best) > 0, F.array_join(F.transform(best, lambda x: x["s"]), " ")).otherwise(F.substring(text, 1, 200))


def rerank_parts(query: Column, text: Column) -> Column:
    """struct of the integer parts of the lexical score: covered, terms, rare hits, rare, hits, span."""
    q, t = tokens(query), tokens(text)
    inside = lambda w: F.array_contains(t, w)
    rare = F.filter(q, lambda w: w.rlike(r"^[a-z]?\d") | (F.length(w) <= 2))
    at = F.filter(F.transform(t, lambda w, i: F.when(F.array_contains(q, w), i)), lambda i: i.isNotNull())
    return F.struct(
        F.size(F.filter(q, inside)).alias("covered"), F.size(q).alias("terms"), F.size(F.filter(rare, inside)).alias("rare_hits"), F.size(rare).alias("rare"),
        F.size(at).alias("hits"), F.when(F.size(at) >= 2, F.element_at(at, -1) - F.element_at(at, 1) + 1).otherwise(F.lit(0)).alias("span"), F.size(t).alias("length"),
    )


def rerank_score(p: Column) -> Column:
    """0.6 coverage + 0.25 rare hits + 0.15 proximity, 0 if either side has no token."""
    prox = F.when((p["hits"] >= 2) & (p["span"] > 0), p["hits"] / p["span"]).otherwise(F.lit(0.0))
    whole = 0.6 * p["covered"] / p["terms"] + 0.25 * p["rare_hits"] / F.greatest(p["rare"], F.lit(1)) + 0.15 * prox
    return F.when((p["terms"] == 0) | (p["length"] == 0), F.lit(0.0)).otherwise(whole)


def confidence(score: Column) -> Column:
    return 1 / (1 + F.exp(-6 * (score - 0.4)))


def tier(name: Column, text: Column, source_tier: Column) -> Column:
    """The extraction tier: the first rule that applies."""
    t = F.lower(F.concat(name, F.lit(" "), F.substring(text, 1, 2000)))
    high, low = contains_any(t, vocab.HIGH_VALUE), contains_any(t, vocab.LOW_VALUE)
    return (
        F.when((source_tier == "official") & high, "A").when(low, "C").when((source_tier == "rumor") & ~high, "C")
        .when((source_tier == "official") | high, "A").when((F.length(text) < 200) & ~contains_any(t, vocab.ENTITY_HINTS), "C").otherwise("B")
    )

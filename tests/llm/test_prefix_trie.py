"""The trie of conversation prefixes against a plain version, on nulls, ties, repeats and long conversations."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorewell.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(t)] for c, t in said.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(said.get(c - c % 20, [])[:h] + said[c][h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in children[p])
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == p)))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture
def whole_partitions(spark):
    """Small partitions stay apart, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def found(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=repr)


def mixed():
    rows = []
    for c in [*range(0, 45), 60, 61, 79, 127, 133, 1000]:
        for t in range(c % 6):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {t} {'x' if c % 3 else 'y'}  more\twords" if t < 3 else f"own {c // 7}"))
    # base 100 is absent, turn and role and text are null, turns tie, a row is there twice
    rows += [(101, 0, "user", "a"), (102, None, None, None), (102, 0, "user", None), (103, 1, "b", "z"), (103, 1, "a", "z"), (103, 1, "a", "y"), (103, 1, "a", "y")]
    rows += [(None, 0, "user", "lost"), (-5, 0, "user", "say 0 x  more\twords"), (-5, 1, "assistant", "é ß")]
    return rows


def test_equals_the_plain_version(spark):
    assert found(spark, mixed()) == plain(mixed())


def test_one_conversation_in_many_parts(spark, whole_partitions):
    rows = [(7, t, "user", f"turn {t % 5}") for t in range(3000)] + [(20, 0, "user", "turn 0"), (27, 0, "user", "turn 0")]
    laid = spark.createDataFrame(rows, SCHEMA).repartitionByRange("conv_id", "turn").withColumn("p", F.spark_partition_id())
    assert laid.where("conv_id = 7").select("p").distinct().count() > 1
    assert found(spark, rows) == plain(rows)


def test_end_lists_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "END_IDS", 8)
    rows = [(c, 0, "user", "hello all") for c in range(0, 400)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_nothing_gives_no_node(spark, rows):
    assert found(spark, rows) == []


def test_other_columns_are_ignored(spark):
    rows = [(1, 0, "user", "a b", 5, "q", 9), (21, 0, "user", "a b", 6, "r", 8)]
    assert found(spark, rows, SCHEMA + ", part int, d string, p0 long") == plain([r[:4] for r in rows])

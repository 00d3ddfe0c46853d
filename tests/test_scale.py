"""Steps that grow with the input, against plain versions and by their plans."""

import hashlib
import os
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorewell import catalogue
from lorewell.functions import text as T
from lorewell.functions import vectors as V
from lorewell.operators import graph, ingest, retrieval
from lorewell.sources import bindings
from lorewell.sources import store as stored
from lorewell.sources.store import open_store, write_store

SF = "/root/testdata/sf0.001"


def test_terms_are_counted_within_their_row(spark):
    texts = ["", "a b a c b a", "x", "der die der 的 的", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    post = retrieval.postings(df)
    got = sorted((r["chunk_id"], r["len"], r["term"], r["tf"]) for r in post.collect())
    want = [(str(i), len((t or "").split()), w, n) for i, t in enumerate(texts) for w, n in Counter((t or "").split()).items()]
    assert got == sorted(want)
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([([],), (None,)], "t array<string>").select(T.counted(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in empty] == [[], None]


def test_few_questions_shuffle_no_table(spark, tmp_path):
    """Postings meet few terms, and chunks few candidates, without a shuffle of their own; more of them are joined, with equal results."""
    write_store(bindings.documents(spark, SF), str(tmp_path))
    held = open_store(spark, str(tmp_path))
    q = spark.createDataFrame([(1, "of the in"), (2, "la le und")], "query_id int, query string")
    found = retrieval.bm25_stored(held, q)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "IN (" in plan
    small = sorted(map(tuple, found.collect()))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(retrieval, "CARRIED_TERMS", 1)
        assert sorted(map(tuple, retrieval.bm25_stored(held, q).collect())) == small and small


def test_exact_vector_search_over_blocks(spark, monkeypatch):
    """Ties go to smaller ids, vectors without values take no part, lengths don't meet, and block sizes change nothing."""
    rng = np.random.default_rng(3)
    vs = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)] + [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [1.0, 2.0]), (63, [0.0] * 4)]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    asked = [v for v in vs if v[0] % 7 == 0 or v[0] > 59]
    q = spark.createDataFrame(asked, "query_id long, q array<double>")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = set()
    for i, a in asked:
        if a is not None and None not in a:
            scores = [(-np.floor((float(unit(a) @ unit(b)) + 1e-9) * 1e6 + 0.5) / 1e6, j) for j, b in vs if b is not None and None not in b and len(b) == len(a)]
            want |= {(i, j, round(-s, 6), rank) for rank, (s, j) in enumerate(sorted(scores)[:5])}
    for sizes in ((1024, 4096), (3, 7)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", sizes[0])
        monkeypatch.setattr(retrieval, "ROW_BLOCK", sizes[1])
        got = retrieval.vector_topk(df, q, 5)
        assert {(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in got.collect()} == want
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[0]


def test_entities_are_found_without_sorting(spark):
    docs = spark.createDataFrame([("d", "# one\nN7 and N5 of TSMC\n# two\nN7 HBM3 TSMC", "A")], "id string, text string, tier string")
    found = ingest.entities(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r["name"], r["type"]) for r in found.collect()) == [("HBM3", "Standard"), ("N5", "ProcessNode"), ("N7", "ProcessNode"), ("TSMC", "Company")]


def test_shared_lines_are_met_without_their_text(spark, tmp_path):
    long = lambda c: c * 40
    docs = [(1, f"{long('a')}\n{long('a')}\nshort"), (2, f"{long('b')}\nshort"), (2, f"x\n{long('b')}\n{long('a')}"), (3, long("b")), (4, long("c")), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue._shared_lines(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(2, 1), (3, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(line" in plan and "hashpartitioning(doc_id" not in plan


def test_finished_rounds_are_given_back(spark):
    """The driver doesn't keep the shuffles of rounds that are over."""
    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    graph.release(spark)
    time.sleep(2)
    before = held.size()
    assert {r["component"] for r in graph.connected_components(edges).collect()} == {0}
    deadline = time.time() + 20
    while held.size() > before + 12 and time.time() < deadline:
        time.sleep(0.5)
    assert held.size() <= before + 12


def test_an_index_takes_little_disk(spark, tmp_path):
    """Its files are at most four times those of its documents, and nothing is shuffled for its postings."""
    sf = "/root/testdata/sf0.01"
    write_store(bindings.documents(spark, sf), str(tmp_path))
    size = sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet"))
    assert size < 4 * os.path.getsize(f"{sf}/documents.parquet")
    chunks = open_store(spark, str(tmp_path)).chunks
    lists = chunks.select("no", "text").mapInArrow(stored.inverted(75.0), stored.LISTS).sortWithinPartitions("term")
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()


def test_lists_hold_every_posting(monkeypatch):
    """Over segments and batches of any cut; a block's weight is the highest of its chunks."""
    monkeypatch.setattr(stored, "SEGMENT", 8)
    monkeypatch.setattr(stored, "BLOCK", 2)
    rng = np.random.default_rng(5)
    no = [*range(3, 30), *range(1 << 33, (1 << 33) + 9)]
    texts = [" ".join(rng.choice(["a", "b", "的", "n5", "zz"], rng.integers(0, 9))) for _ in no]
    rows = list(zip(no, texts))
    cut = lambda some: pa.RecordBatch.from_pydict({"no": pa.array([r[0] for r in some], pa.int64()), "text": pa.array([r[1] for r in some], pa.string())})
    words = [t.split() for t in texts]
    want = [(w, n, c, len(t)) for n, t in zip(no, words) for w, c in Counter(t).items()]
    weight = lambda c, size: c * 2.5 / (c + 1.5 * (0.25 + 0.75 * size / 4.0))
    for cuts in ([0, len(rows)], [0, 0, 1, 7, 20, 29, len(rows)]):
        made = [r for b in stored.inverted(4.0)(cut(rows[i:j]) for i, j in zip(cuts, cuts[1:])) for r in b.to_pylist()]
        got = [(r["term"], r["segment"] * 8 + p, c, n) for r in made for p, c, n in zip(r["place"], r["tf"], r["len"])]
        assert sorted(got) == sorted(want) and all(r["n"] == len(r["place"]) for r in made)
        for r in made:
            for b, most in zip(r["block"], r["most"], strict=True):
                assert most == pytest.approx(max(weight(c, n) for p, c, n in zip(r["place"], r["tf"], r["len"]) if p // 2 == b), rel=1e-8)
    assert [b.num_rows for b in stored.inverted(1.0)([cut([(1, "")])])] == [0] and not list(stored.inverted(1.0)([]))


def test_ties_of_a_stored_search_go_by_id(spark, tmp_path):
    docs = [(str(i), f"d{i}", "alpha beta" if i % 3 else "alpha beta gamma", "analyst", False, f"src{i % 4}", i) for i in range(60)]
    docs = spark.createDataFrame(docs, "id string, name string, text string, source_tier string, controlled boolean, department string, seq long")
    write_store(docs, str(tmp_path))
    q = spark.createDataFrame([(1, "alpha"), (2, "gamma beta")], "query_id int, query string")
    got = retrieval.bm25_stored(open_store(spark, str(tmp_path)), q, k=7)
    names = ["query_id", "chunk_id", "score", "rank"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, retrieval.bm25(ingest.chunks(docs), q, k=7).select(names).collect()))


def test_strip_takes_white_space_alone(spark):
    every = [chr(c) for c in (*range(1, 0x250), 0x1680, 0x180E, *range(0x1FF0, 0x2070), 0x3000, 0xFEFF)]
    texts = [*(f"{c}a {c} b{c}\n" for c in every), "", " \n ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a, b = zip(*df.select(T.strip(F.col("t")), F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).collect())
    assert a == b


def test_hashed_vectors_of_many_texts(monkeypatch):
    def plain(text):
        v = np.zeros(256)
        for weight, features in ((1.0, re.findall("[A-Za-z0-9]+|[一-鿿]", text.lower())), (0.5, [text[i : i + 3] for i in range(len(text) - 2)])):
            for f in features:
                h = hashlib.md5(f.encode()).digest()
                v[h[15]] += weight * (1 if weight < 1 or h[14] & 1 else -1)
        return v

    texts = ["", "a", "ab", "abc", "的N3产能 é", "\U0001f600a\U0001f600b", "x" * 40, "", "of the the"]
    for table, room in ((1 << 24, 1 << 21), (0, 5)):
        monkeypatch.setattr(V.Hashed, "TABLE", table)
        monkeypatch.setattr(V.Hashed, "ROOM", room)
        v, sizes = V.Hashed().matrix(texts)
        assert np.array_equal(v, [plain(t) for t in texts]) and sizes.tolist() == [0, 1, 1, 1, 4, 2, 1, 0, 3]


def test_documents_meet_few_labels_without_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"src{i % 3}") for i in range(9)] + [(None, "x", "en", "src1")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 2), (3, 1), (4, None), (5, 1), (None, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(bindings, "SENT", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, few = (bindings.as_documents(docs, labels, sent) for sent in (False, True))
        assert "SortMergeJoin" in plain._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(bindings, "SENT", 2)
        many = bindings.as_documents(docs, labels, True)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        rows = [sorted(map(tuple, d.collect()), key=repr) for d in (plain, few, many)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows[0] == rows[1] == rows[2] and {r[0] for r in rows[0] if r[4]} == {"1", "5"}

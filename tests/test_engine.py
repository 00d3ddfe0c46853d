"""The engine on a small corpus of its own, against values worked out by hand and plain Python versions."""

import hashlib
import hmac
import json
import math
import random
import re
from base64 import urlsafe_b64encode

import pytest
from pyspark.sql import functions as F

from lorewell.functions import security, vectors, vocab
from lorewell.functions import text as T
from lorewell.operators import ingest, knowledge, resolution, retrieval
from lorewell.plans.engine import Engine
from lorewell.sources import config, models

DOC = "id string, name string, text string, source_tier string, controlled boolean, department string, seq long"
CORPUS = [
    ("d1", "Q3 earnings.md", "# Results\n代工厂 revenue rose on N3 volume.\n## Capacity\nN3 and N5 lines were full this quarter.\n### Outlook\nN2 ramps next year.", "official", False, "fin", 1),
    ("d2", "analyst report.md", "# View\nN3 demand looks strong through the year, and customers keep asking for more wafers. " + "Margins follow volume. " * 8, "analyst", False, "fin", 2),
    ("d3", "techbrief.md", "# Tool\nEUV exposes N3 and N5 layers with fewer masks.", "official", True, "tech", 3),
    ("d4", "news.md", "# Story\nThe 代工厂 buys EUV tools for N3. " + "Deliveries start in spring. " * 8, "analyst", False, "tech", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, DOC)


@pytest.fixture(scope="module")
def engine(spark, docs):
    e = Engine(spark)
    e.made = e.ingest(docs)
    return e


def test_tiers_chunks_pages_relations(engine):
    tiers = {r["id"]: r["tier"] for r in engine.docs.collect()}
    assert tiers == {"d1": "A", "d2": "B", "d3": "A", "d4": "B"}
    assert engine.chunks.count() == 6 and engine.pages.count() == 6
    by_doc = {r["doc_id"]: r["n"] for r in engine.relations.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert by_doc == {"d1": 2, "d3": 3, "d4": 3} and {r["name"] for r in engine.entities.collect()} == {"代工厂", "N3", "N5", "N2", "EUV"}
    assert engine.made["pending"].count() == 1 and engine.made["stats"].where("tier = 'deduped'").first()["n"] == 0


def test_communities(engine):
    got = {}
    for r in engine.communities().collect():
        got.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(len, got.values())) == [1, 4] and {"N2"} in got.values()


def test_second_ingest_is_deduplicated(spark, docs):
    e = Engine(spark)
    e.ingest(docs)
    again = e.ingest(spark.createDataFrame([("d9", "copy", CORPUS[0][2], "official", False, "x", 9), ("d10", "new", "fresh text", "analyst", False, "x", 10)], DOC))
    assert [r["id"] for r in again["docs"].collect()] == ["d10"] and e.docs.count() == 5


def test_writes_of_ingests_and_actions_make_objects(spark, docs):
    e = Engine(spark)
    first = e.ingest(docs.where("seq <= 2"))
    counts = {r["id"]: (r["objects_created"], r["objects_merged"], r["links_committed"]) for r in first["counts"].collect()}
    assert counts["d1"] == (4, 0, 2) and counts["d2"] == (0, 1, 0)
    second = e.ingest(docs.where("seq > 2"))
    counts = {r["id"]: (r["objects_created"], r["objects_merged"]) for r in second["counts"].collect()}
    assert counts == {"d3": (1, 2), "d4": (0, 3)} and second["touched"].count() == 1
    ids = {r["title"]: r["id"] for r in e.objects().collect()}
    assert set(ids) == {"代工厂", "N3", "N5", "N2", "EUV"}
    log = "seq long, action string, role string, confirmed boolean, source_tier string, current_status string, new_status string, correction boolean, actor string, params map<string,string>"
    actions = [
        (100, "create_object", "analyst", False, "official", None, None, False, "x", {"id": ids["N3"], "title": "other", "aliases": "three"}),
        (101, "create_object", "analyst", False, "official", None, None, False, "x", {"id": "own", "title": "Own"}),
        (102, "mark", "compliance", True, "official", None, None, False, "x", {"id": "own"}),
        (103, "mark", "analyst", True, "official", None, None, False, "x", {"id": ids["N5"]}),
    ]
    e.run_actions(spark.createDataFrame(actions, log))
    e.compact()
    got = {r["id"]: r for r in e.objects().collect()}
    assert got[ids["N3"]]["title"] == "N3" and got[ids["N3"]]["aliases"] == ["three"] and got[ids["N3"]]["doc_ids"] == ["d1", "d2", "d3", "d4"]
    assert got["own"]["controlled"] and not got[ids["N5"]]["controlled"] and len(got) == 6


def test_global_questions_are_answered_from_communities(spark, engine):
    q = spark.createDataFrame([(1, "overall trend across euv", "viewer"), (2, "what is N3", "viewer")], "query_id int, query string, role string")
    got = {r["query_id"]: r for r in engine.ask(q).collect()}
    assert got[1]["mode"] == "global" and "社区" in got[1]["answer"] and got[1]["n_contexts"] == 2
    assert got[2]["mode"] == "local" and "社区" not in got[2]["answer"]


def test_ask_masks_by_role(spark, engine):
    q = [(i, "EUV N3 N5 layers", r) for i, r in enumerate(("viewer", "analyst", "strategy", "compliance"))]
    got = {r["query_id"]: r for r in engine.ask(spark.createDataFrame(q, "query_id int, query string, role string")).collect()}
    assert got[0]["grounded"] and got[0]["n_masked"] == 0 and "fewer masks" not in got[0]["answer"]
    assert vocab.MASKED in got[1]["answer"] and "fewer masks" not in got[1]["answer"]
    assert vocab.SUMMARY_PREFIX in got[2]["answer"] and "fewer masks" in got[3]["answer"]
    assert engine.ask_one("EUV N3 N5 layers") is engine.ask_one("EUV N3 N5 layers")
    assert engine.ask_one("EUV N3 N5 layers", "compliance", "fin")["answer"] != engine.ask_one("EUV N3 N5 layers", "compliance")["answer"]
    none = engine.ask(spark.createDataFrame([(1, "zzz", "analyst")], "query_id int, query string, role string")).first()
    assert none["answer"] == vocab.NO_CONTENT and not none["grounded"]


def plain_score(query, text):
    tok = lambda s: re.findall(r"[A-Za-z0-9]+|[一-鿿]", s.lower())
    q, t = tok(query), tok(text)
    if not q or not t:
        return 0.0
    rare = [w for w in q if re.match(r"^[a-z]?\d", w) or len(w) <= 2]
    at = [i for i, w in enumerate(t) if w in q]
    prox = len(at) / (at[-1] - at[0] + 1) if len(at) > 1 else 0
    return 0.6 * sum(w in t for w in q) / len(q) + 0.25 * sum(w in t for w in rare) / max(1, len(rare)) + 0.15 * prox


def test_scores_equal_plain_python(spark):
    r = random.Random(1)
    words = ["n3", "EUV", "the", "of", "产", "能", "line", "2024", "é"]
    pairs = [(" ".join(r.choices(words, k=r.randint(0, 5))), " ".join(r.choices(words, k=r.randint(0, 12)))) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "q string, t string").withColumn("s", T.rerank_score(T.rerank_parts(F.col("q"), F.col("t")))).collect()
    assert all(math.isclose(x["s"], plain_score(x["q"], x["t"]), abs_tol=1e-12) for x in rows)
    c = spark.range(1).select(T.confidence(F.lit(1.0)).alias("a"), T.confidence(F.lit(0.0)).alias("b"), T.confidence(F.lit(0.4)).alias("c")).first()
    assert (round(c["a"], 5), round(c["b"], 5), c["c"]) == (0.9734, 0.08317, 0.5)


def test_hashed_embedding_equals_plain_python(spark):
    text = "The N3 产能 line é"
    v = [0.0] * 256
    for tok in re.findall(r"[A-Za-z0-9]+|[一-鿿]", text.lower()):
        h = int(hashlib.md5(tok.encode()).hexdigest(), 16)
        v[h % 256] += 1 if h >> 8 & 1 else -1
    for i in range(len(text) - 2):
        v[int(hashlib.md5(text[i : i + 3].encode()).hexdigest(), 16) % 256] += 0.5
    n = math.sqrt(sum(x * x for x in v))
    got, backend = models.embed(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    assert backend == "hash" and got.first()["embedding"] == pytest.approx([x / n for x in v])
    own, backend = models.embed(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", lambda texts: [[float(len(t))] for t in texts])
    assert backend == "model" and own.first()["embedding"] == [float(len(text))]


@pytest.mark.parametrize("n, starts", [(0, []), (1, [0]), (500, [0]), (501, [0, 420]), (920, [0, 420]), (921, [0, 420, 840])])
def test_windows(spark, n, starts):
    assert spark.range(1).select(T.windows(F.lit("x" * n)).alias("w")).first()["w"] == starts


def test_sections_edge_cases(spark):
    of = lambda t: [(s["title"], s["body"]) for s in spark.createDataFrame([(t,)], "t string").select(T.sections(F.col("t")).alias("s")).first()["s"]]
    assert of("") == [("", "")] and of(" \n ") == [("", "")] and of("#x\nbody") == [("x", "body")]
    assert of("intro\n# A\none\n#### deep\n# B\n\n# A\ntwo") == [("", "intro"), ("A", "one\n#### deep"), ("A", "two")]


def test_tokens_and_sentences(spark):
    row = spark.createDataFrame([("的N3产能 café İ", "One. Two!\n\n三。 four")], "a string, b string").select(T.tokens(F.col("a")).alias("t"), T.sentences(F.col("b")).alias("s")).first()
    assert row["t"][:5] == ["的", "n3", "产", "能", "caf"] and row["s"] == ["One.", "Two!", "三。", "four"]


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(
        vectors.normalised(F.col("a")).alias("n"), vectors.normalised(F.col("z")).alias("zero"), vectors.cosine(F.col("a"), F.col("a")).alias("c"), vectors.int8_codes(F.col("a")).alias("i"), vectors.int8_codes(F.col("z")).alias("iz"), vectors.truncated(F.col("a"), 1).alias("t")
    ).first()
    assert row["n"] == [0.6, 0.8] and row["zero"] == [0.0, 0.0] and row["c"] == pytest.approx(1) and row["i"] == [95, 127] and row["iz"] == [0, 0] and row["t"] == [1.0]


def test_rrf_and_gate(spark):
    one = spark.createDataFrame([(1, "a", 0, 1.0), (1, "b", 1, 0.5)], "query_id int, chunk_id string, rank int, score double")
    two = spark.createDataFrame([(1, "a", 0, 9.0), (1, "c", 1, 8.0)], "query_id int, chunk_id string, rank int, score double")
    got = {r["chunk_id"]: (r["rrf"], r["rank"]) for r in retrieval.rrf(one, two).collect()}
    assert got["a"] == (round(2 / 60, 9), 0) and got["b"][0] == got["c"][0] and (got["b"][1], got["c"][1]) == (1, 2)
    rows = spark.createDataFrame([(0.39,), (0.4,), (0.41,)], "score double")
    assert [r["score"] for r in retrieval.gate(rows).collect()] == [0.4, 0.41] and retrieval.gate(rows, 0.9).count() == 0


def test_routes(spark):
    q = [(1, "overall trend", "global"), (2, "what is the trend", "local"), (3, "overall trend of N3", "local"), (4, "总体格局", "global"), (5, "hello", "local")]
    got = {r["query_id"]: r["mode"] for r in retrieval.route(spark.createDataFrame([x[:2] for x in q], "query_id int, query string")).collect()}
    assert got == {i: m for i, _, m in q}


def test_bitemporal(spark):
    o = spark.createDataFrame([("fab1", "2023", 1, 78000.0), ("fab1", "2024", 2, 95000.0), ("fab1", "2024", 3, 120000.0), ("fab1", "2023", 4, 80000.0)], "obj_id string, valid_time string, seq long, value double")
    chain = {r["seq"]: r["superseded_by"] for r in knowledge.superseded(o).collect()}
    assert chain == {1: 4, 2: 3, 3: None, 4: None}
    assert knowledge.as_of(o.where("seq < 4"), 2023).first()["value"] == 78000 and knowledge.as_of(o, 2024).first()["value"] == 120000 and knowledge.truth(o).first()["value"] == 120000
    assert knowledge.as_of(o, 2020).count() == 0


def test_actions_and_audit(spark):
    schema = "seq long, action string, role string, confirmed boolean, source_tier string, current_status string, new_status string, correction boolean, actor string, params map<string,string>"
    rows = [("mark", "analyst", True, None, None, None), ("mark", "compliance", False, None, None, None), ("mark", "compliance", True, None, None, None), ("revise-capacity", "analyst", False, "rumor", None, None), ("advance-roadmap", "analyst", False, None, "development", "HVM"), ("advance-roadmap", "analyst", False, None, "risk", "HVM"), ("nothing", "analyst", False, None, None, None), ("advance-roadmap", "analyst", False, None, None, None)]
    log = spark.createDataFrame([(i, a, r, c, s, x, y, None, "me", {"b": "2", "a": "1"}) for i, (a, r, c, s, x, y) in enumerate(rows)], schema)
    decided = knowledge.decide(log)
    assert [r["decision"] for r in decided.orderBy("seq").collect()] == ["permission_denied", "pending_review", "executed", "rumor_rejected", "invalid_transition", "executed", "unknown_action", "executed"]
    record = knowledge.audit(decided).first()
    assert record["params"] == '{"a":"1","b":"2"}' and record["params_hash"] == hashlib.sha256(record["params"].encode()).hexdigest()


def test_objects_fold_and_marks(spark):
    w = spark.createDataFrame([("x", 1, "X", "T", ["a"], ["d1"], False), ("x", 2, "Y", "U", ["b", "a"], ["d2"], True)], "id string, seq long, title string, object_type string, aliases array<string>, doc_ids array<string>, controlled boolean")
    a, b = knowledge.fold_objects(w).first(), knowledge.fold_objects(w, escalate=True).first()
    assert (a["title"], a["object_type"], a["aliases"], a["doc_ids"], a["controlled"], a["writes"]) == ("X", "T", ["a", "b"], ["d1", "d2"], False, 2) and b["controlled"]
    o = spark.createDataFrame([("x", False), ("y", False)], "id string, controlled boolean")
    p = spark.createDataFrame([("p1", "x", False), ("x", "z", False), ("p3", "z", False)], "page_id string, doc_id string, controlled boolean")
    om, pm = knowledge.mark_controlled(o, p, spark.createDataFrame([("x",), ("x",)], "entity_id string"))
    assert {r["id"]: r["controlled"] for r in om.collect()} == {"x": True, "y": False} and {r["page_id"]: r["controlled"] for r in pm.collect()} == {"p1": True, "x": True, "p3": False}


def test_resolution(spark):
    e = spark.createDataFrame([("e1", 1, "N3"), ("e2", 2, "n3"), ("e3", 3, "Other")], "entity_id string, seq long, name string")
    manual = spark.createDataFrame([("OTHER", "e1")], "alias string, canonical_id string")
    assert {r["entity_id"]: r["canonical_id"] for r in knowledge.resolve_aliases(e, manual).collect()} == {"e1": "e1", "e2": "e1", "e3": "e1"}
    v = spark.createDataFrame([(1, 1, "t", [1.0, 0.0]), (2, 2, "t", [0.95, 0.3]), (3, 3, "t", [0.75, 0.66]), (4, 4, "u", [1.0, 0.0])], "entity_id long, seq long, type string, v array<double>")
    assert {r["entity_id"]: r["canonical_id"] for r in resolution.resolve_vectors(v).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_uploads_config_tokens_and_egress(spark):
    raw = spark.createDataFrame([("1", "n", "t"), ("", "n", "t"), ("2", "n", None)], "id string, name string, text string")
    good, bad = config.uploads(raw)
    assert good.first()["source_tier"] == "analyst" and good.count() == 1 and bad.count() == 2
    config.validate(config.load({}))
    strict = {"ENV": "prod", "AUTH_MODE": "jwt", "ALLOW_ROLE_HEADER": "0", "JWT_SECRET": "x" * 20, "STORE_BACKEND": "files", "STORE_SECRET": "y" * 20, "CORS_ORIGINS": "https://kb.example.org"}
    load = lambda more: config.load({"KB_" + k: v for k, v in (strict | more).items()}, prefix="KB_")
    config.validate(load({}))
    for key, value in (("AUTH_MODE", "dev"), ("ALLOW_ROLE_HEADER", "1"), ("JWT_SECRET", "short"), ("STORE_BACKEND", "memory"), ("STORE_SECRET", "password"), ("CORS_ORIGINS", "*"), ("CORS_ORIGINS", "http://localhost:1"), ("CORS_ORIGINS", ","), ("AUTH_MODE", "none"), ("STORE_BACKEND", "disk")):
        with pytest.raises(config.ConfigError):
            config.validate(load({key: value}))
    assert config.role_of({"role": "analyst", "roles": ["compliance"]}) == "analyst" and config.role_of({"role": "boss", "groups": "strategy"}) == "strategy" and config.role_of({"roles": [["x"], 3]}) == "viewer"
    part = lambda d: urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    head = part({"alg": "HS256"}) + "." + part({"sub": "u", "roles": ["viewer", "strategy"], "exp": 100})
    token = head + "." + urlsafe_b64encode(hmac.new(b"k" * 16, head.encode(), hashlib.sha256).digest()).decode().rstrip("=")
    assert config.role_of(config.verify_token(token, "k" * 16, now=50)) == "strategy"
    for bad_token, now in ((token, 200), (token[:-3] + "abc", 50), ("a.b", 50), ("!.!.!", 50)):
        with pytest.raises(config.AuthError):
            config.verify_token(bad_token, "k" * 16, now=now)
    rows = spark.createDataFrame([("secret", True)], "t string, controlled boolean")
    models.check_egress(rows, "http://localhost/v1")
    with pytest.raises(security.EgressViolation):
        models.check_egress(rows, "https://api.example.com")
    assert models.ask_model(rows, "t", lambda p: p.upper()).first()["reply"] == "SECRET" and models.ask_model(rows, "t", lambda p: 1 / 0).first()["reply"] is None


def test_masks_never_show_plain_text(spark):
    roles = spark.createDataFrame([(r,) for r in ("viewer", "analyst", "strategy", "compliance", "stranger")], "role string")
    facts = spark.createDataFrame([("plain text of a secret", True), ("open", False)], "value string, controlled boolean")
    for r in knowledge.field_security(facts, roles).collect():
        clear = not r["controlled"] or r["role"] == "compliance"
        assert (r["display"] == r["value"]) == clear and r["masked"] != clear


def test_khop(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert sorted(r["node"] for r in knowledge.khop(e, start, 2).collect()) == ["b", "c"]


def test_latest_and_chunks_of_equal_titles(spark):
    d = spark.createDataFrame([("d", "n", "# A\none\n# A\ntwo", "analyst", False, "x", 1)], DOC)
    assert [r["text"] for r in ingest.chunks(d).collect()] == ["two"]

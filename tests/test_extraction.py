"""Extractor, judge and model hooks with fake models."""

import json

import pytest
from pyspark.errors import PythonException

from lorewell.operators import extraction as X
from lorewell.operators import ingest, knowledge, retrieval

DOC = "id string, name string, text string, source_tier string, controlled boolean, department string, seq long"
LOCAL, FAR = "http://127.0.0.1:8000/v1", "https://api.example.com/v1"


class Fake:
    """Answers with objects; fails as the text says."""

    def __init__(self, name):
        self.name = name

    def __call__(self, prompt):
        if "BROKEN" in prompt:
            raise ConnectionError("down")
        if "PROSE" in prompt and "could not be read" not in prompt:
            return "I would rather talk."
        if "SHAPE" in prompt:
            return '{"objects": [{"id": "no type"}]}'
        fact = {"key": "by", "value": self.name, "confidence": 0.9}
        return "Sure:\n```json\n" + json.dumps({"objects": [{"id": "n3", "type": "Node", "facts": [fact, {"key": "plain", "value": 1}]}, {"id": "n3", "type": "Again"}], "links": [{"from": "n3", "to": "n5"}]}) + "\n```"


class Judge:
    def __call__(self, prompt):
        if "NOJUDGE" in prompt:
            raise TimeoutError
        return json.dumps({"objects": [{"object_id": "n3", "valid_type": True, "drop": "DROPIT" in prompt, "facts": [{"key": "by", "supported": "DOUBT" not in prompt, "confidence_delta": -0.1}]}]})


def endpoints(chat=Fake, far=FAR):
    return {n: X.Endpoint(n, url, chat(n) if chat is Fake else chat()) for n, url in (("strong", far), ("light", far), ("local", LOCAL))}


@pytest.fixture(scope="module")
def sections(spark):
    texts = ["earnings and contract N3", "# One\nsome longer text " + "of many words " * 20 + "\n# Two\nPROSE here", "BROKEN earnings contract", "SHAPE earnings contract", "earnings with a secret contract", "draft note re:"]
    docs = [(f"d{i}", f"doc{i}", t, "official" if i in (0, 2, 3, 4) else "analyst", i == 4, "fin", i) for i, t in enumerate(texts)]
    return X.sections_to_ask(ingest.classify(spark.createDataFrame(docs, DOC)), "strong", "light", "local")


def test_sections_go_to_endpoints_by_tier(sections):
    got = {(r["doc_id"], r["ord"]): r["endpoint"] for r in sections.collect()}
    assert got == {("d0", 0): "strong", ("d1", 0): "light", ("d1", 1): "light", ("d2", 0): "strong", ("d3", 0): "strong", ("d4", 0): "local"}


def test_replies_are_asked_for_again(sections):
    got = {(r["doc_id"], r["ord"]): r for r in X.extract(sections, endpoints(), retries=2).collect()}
    assert {k: r["attempts"] for k, r in got.items()} == {("d0", 0): 1, ("d1", 0): 1, ("d1", 1): 2, ("d2", 0): 3, ("d3", 0): 3, ("d4", 0): 1}
    assert got["d2", 0]["error"] == "ConnectionError: down" and got["d2", 0]["objects"] == [] and "ValueError" in got["d3", 0]["error"]
    assert got["d0", 0]["objects"][0]["facts"][0]["value"] == "strong" and got["d4", 0]["objects"][0]["facts"][0]["value"] == "local"
    assert got["d1", 1]["links"][0].asDict() == {"lt": "related", "src": "n3", "dst": "n5"}


def test_controlled_text_stays_here(spark, sections):
    away = endpoints() | {"local": X.Endpoint("local", FAR, Fake("local"))}
    with pytest.raises(PythonException, match="EgressViolation"):
        X.extract(sections, away).collect()
    # text that isn't controlled may leave
    assert X.extract(sections.where("NOT controlled"), away).count() == 5


def test_entities_and_relations(sections):
    entities, relations = X.entities_of(X.extract(sections, endpoints()))
    assert sorted(map(tuple, entities.collect())) == [("d0", "n3", "Node"), ("d1", "n3", "Node"), ("d4", "n3", "Node")]
    assert sorted(r["doc_id"] for r in relations.collect()) == ["d0", "d1", "d1", "d4"]


def test_a_judge_bands_facts_and_all_wait_where_it_fails(spark):
    texts = ["earnings contract plain", "earnings contract DOUBT", "earnings contract DROPIT", "earnings contract NOJUDGE"]
    docs = [(f"d{i}", f"doc{i}", t, "official", False, "fin", i) for i, t in enumerate(texts)]
    sections = X.sections_to_ask(ingest.classify(spark.createDataFrame(docs, DOC)), "strong", "light", "local")
    facts, errors = X.judged(X.extract(sections, endpoints()), endpoints(Judge))
    got = {(r["doc_id"], r["key"]): (r["band"], r["confidence"]) for r in facts.collect()}
    assert got == {
        ("d0", "by"): ("pending", 0.8), ("d0", "plain"): ("pending", 0.78), ("d1", "by"): ("dropped", 0.55), ("d1", "plain"): ("pending", 0.78),
        ("d2", "by"): ("object_dropped", 0.8), ("d2", "plain"): ("object_dropped", 0.78), ("d3", "by"): ("pending", 0.9), ("d3", "plain"): ("pending", 0.78),
    }
    assert [(r["doc_id"], r["error"]) for r in errors.collect()] == [("d3", "TimeoutError: ")]


def test_hooks_take_the_place_of_rules(spark):
    c = spark.createDataFrame([(1, "q", f"c{i}", "x" * i) for i in range(1, 5)], "query_id int, query string, chunk_id string, text string")
    best = retrieval.rerank(c, 2, lambda qs, ts: [len(t) / 10 for t in ts])
    assert [(r["chunk_id"], r["score"]) for r in best.orderBy("rank").collect()] == [("c4", 0.4), ("c3", 0.3)]
    q = spark.createDataFrame([(1, "why", "local"), (2, "what", "local")], "query_id int, query string, mode string")
    contexts = spark.createDataFrame([(1, 0, "one", False), (1, 1, "two", True)], "query_id int, rank int, text string, masked boolean")
    told = {r["query_id"]: r["answer"] for r in retrieval.answers(q, contexts, lambda query, texts: f"{query}: {'+'.join(texts)}").collect()}
    assert told[1] == "why: one+two" and told[2] != "why" and "未找到" in told[2]
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, community long")
    only = spark.createDataFrame([(1,)], "community long")
    got = knowledge.community_summaries(labels, only=only, summariser=lambda members, n: f"{n}: {' '.join(members)}").collect()
    assert [(r["community"], r["summary"]) for r in got] == [(1, "2: a b")]


def test_answers_go_on_before_their_batch_ends(spark, monkeypatch):
    """A task holds the answers of some characters of text, not those of a whole batch."""
    rows = spark.createDataFrame([(str(i), 0, "Memory" * (i % 4), False, "strong" if i % 5 else None) for i in range(60)], "doc_id string, ord int, body string, controlled boolean, endpoint string")
    caught, own = [], type(rows).mapInPandas
    monkeypatch.setattr(X, "CHARS_AT_ONCE", 60)
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, f, schema: caught.append((self, f)) or own(self, f, schema))
    found = X.extract(rows, endpoints())
    asked, run = caught[0]
    pieces = list(run(iter([asked.toPandas()])))
    assert len(pieces) > 5 and all(p["body"].str.len().sum() < 60 + 18 for p in pieces)
    every = [r for p in pieces for r in p.itertuples()]
    assert [r.doc_id for r in every] == [str(i) for i in range(60)] and all((r.got is None) == (r.endpoint is None) for r in every)
    assert {r["doc_id"]: r["attempts"] for r in found.collect()} == {r.doc_id: r.got and r.got["attempts"] for r in every}

"""The pipeline end to end on the smallest tables, and its stages against plain versions and on odd rows."""

import random

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import public_tokenizers
import tokenizers

from lorewell.llm import jaccard, line_dedup, quality
from tests.llm.test_operators import brute_groups
from tests.llm.test_passages import brute, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        counts.append(len(rows))
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces["doc_id"]) == {r["doc_id"] for r in docs.collect()}


def test_no_near_copies_stay(spark):
    left = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    again = jaccard.jaccard_groups(left)
    assert again.where("doc_id != component_id").count() == 0


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


# --- stages against plain versions ------------------------------------------------------------------


def mixed():
    """Texts with shared lines, near copies and shared passages; one word or more between blanks, so that words tell a text."""
    r = random.Random(21)
    passage, lines = words(900, 70), [" ".join(words(910 + i, 6)) for i in range(5)]
    out = {}
    for i in range(14):
        own = words(i, 60)
        if i % 3 == 0:
            own = own[:30] + passage + own[30:]
        text = " ".join(own)
        if i % 4 == 1:
            text = "\n".join([text, *lines, " ".join(words(1000 + i, 8))])
        out[10 * i] = text
        if i % 5 == 0:
            for k in range(1, 3):
                w = text.split(" ")
                w[r.randrange(len(w))] = f"edit{k}"
                out[10 * i + k] = " ".join(w)
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts.items()], SCHEMA)


def told(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_classifier_keeps_what_its_model_accepts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    want = {r["doc_id"] for r in scored.where("score >= 0.5").collect()}
    assert set(told(corpus_pipeline.classify(spark, docs, SF))) == want and 0 < len(want) < docs.count()


def test_lines_equal_the_sql(spark):
    texts = mixed()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(texts.items()))
    want = {i: t for i, t, n in con.execute(line_dedup.DEDUP_LINES_SQL).fetchall() if n == 0 or t.strip()}
    got = told(corpus_pipeline.lines(spark, frame(spark, texts), SF))
    assert got == want and any(got.get(i) != t for i, t in texts.items())


def test_near_duplicates_equal_brute_force(spark):
    texts = mixed()
    want = {i for i, (_, c) in brute_groups(texts).items() if i == c}
    assert set(told(corpus_pipeline.near_duplicates(spark, frame(spark, texts), SF))) == want < set(texts)


def test_substrings_equal_brute_force(spark):
    texts = mixed()
    want = {i: w for i, w in brute({i: t.split() for i, t in texts.items()}).items() if w}
    got = {i: t.split() for i, t in told(corpus_pipeline.substrings(spark, frame(spark, texts), SF)).items()}
    assert got == want and sum(map(len, got.values())) < sum(len(t.split()) for t in texts.values())


def test_packing_holds_every_token_once(spark):
    texts = mixed() | {7001: "", 7002: None, 7003: "long " * 3000}
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    places = {}
    for r in corpus_pipeline.pack(spark, frame(spark, texts), SF).collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"]
        got.setdefault(r["doc_id"], {})[r["start"]] = ids
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in texts.items():
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert [x for _, ids in sorted(got[i].items()) for x in ids] == want
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


# --- odd rows -----------------------------------------------------------------------------------------


def test_odd_rows_have_a_result_in_every_stage(spark):
    """Null ids and texts, blank texts, rows that repeat an id, and columns beyond those of documents."""
    p = " ".join(words(50, 60))
    rows = [(None, p, "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 3), (4, p, "en", "s", 1), (4, " ".join(words(51, 30)), "en", "s", 1), (5, p, "en", "s", 1), (6, p + " more", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA + ", id long, _key string")
    kept = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    texts = sorted(((r[0], r[1]) for r in rows), key=repr)
    for stage in (corpus_pipeline.lines, corpus_pipeline.near_duplicates, corpus_pipeline.substrings):
        assert stage(spark, docs, SF).columns == docs.columns
    assert kept(corpus_pipeline.lines(spark, docs, SF)) == texts
    assert kept(corpus_pipeline.near_duplicates(spark, docs, SF)) == [x for x in texts if x[0] not in (5, 6)]
    assert kept(corpus_pipeline.substrings(spark, docs, SF)) == sorted([x for x in texts if x[0] not in (5, 6)] + [(6, "more")], key=repr)
    classified = corpus_pipeline.classify(spark, docs, SF)
    assert classified.columns == docs.columns and set(kept(classified)) <= set(texts)
    assert corpus_pipeline.pack(spark, docs, SF).where("doc_id IN (1, 2)").count() == 2


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty_tables(spark, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0

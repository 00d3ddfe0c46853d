"""The jobs: two runs over growing input, runs that repeat, command lines, and the index against a search without one."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import build_index, ingest_documents
from jobs.command import settings
from lorewell.operators import ingest, retrieval
from lorewell.sources import bindings
from lorewell.sources.store import open_store

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    told = build_index.run(spark, f"{SF}/documents.parquet", f"{SF}/labels.parquet", path)
    return path, told


def test_index_is_the_same_after_a_second_run(spark, index):
    path, told = index
    before = rows(build_index.output_of(spark, path))
    assert told["read"] == 200 and told["postings"] == len(before) > 0
    assert build_index.run(spark, f"{SF}/documents.parquet", f"{SF}/labels.parquet", path) == told
    assert rows(build_index.output_of(spark, path)) == before


def test_index_of_some_departments(spark, index, tmp_path):
    told = build_index.run(spark, f"{SF}/documents.parquet", f"{SF}/labels.parquet", str(tmp_path), "src1, src3")
    chunks = open_store(spark, str(tmp_path)).chunks
    assert {r[0] for r in chunks.select("department").distinct().collect()} == {"src1", "src3"}
    assert 0 < told["chunks"] < index[1]["chunks"]


def test_stored_search_equals_search_over_chunks(spark, index):
    store, docs = open_store(spark, index[0]), bindings.documents(spark, SF)
    chunks = ingest.chunks(docs)
    asked = [(1, "of the in and", "viewer", None), (2, "la le the of mentation", "analyst", "src1"), (3, "nothing-that-occurs", "analyst", None), (4, "", "viewer", None)]
    q = spark.createDataFrame(asked, "query_id int, query string, role string, department string")
    for own, other in ((retrieval.bm25_stored, retrieval.bm25), (retrieval.dense_stored, retrieval.dense_hashed)):
        names = ["query_id", "chunk_id", "score", "rank"]
        assert rows(own(store, q, k=7, secure=True).select(names)) == rows(other(chunks, q, k=7, secure=True).select(names))


def test_stored_search_skips_blocks(spark, index, monkeypatch):
    """Fewer postings are scored than the terms have, and the best chunks are the same for any number of first blocks."""
    store = open_store(spark, index[0])
    q = spark.createDataFrame([(1, "the license version general"), (2, "of the")], "query_id int, query string")
    found = []
    for first in (1, 2, 1000):
        monkeypatch.setattr(retrieval, "FIRST_BLOCKS", first)
        found.append(rows(retrieval.bm25_stored(store, q, k=3)))
    assert found[0] == found[1] == found[2] and len(found[0]) == 6


def test_plan_of_a_stored_search_reads_no_documents(spark, index):
    store = open_store(spark, index[0])
    q = spark.createDataFrame([(1, "the of")], "query_id int, query string")
    plan = retrieval.bm25_stored(store, q)._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and "WindowGroupLimit" in plan


def pieces(spark, folder, name, where):
    """A file of documents added to a folder, as something outside would add it."""
    made = f"{folder}-{name}"
    spark.read.parquet(f"{SF}/documents.parquet").where(where).coalesce(1).write.parquet(made)
    part = next(f for f in os.listdir(made) if f.startswith("part-"))
    os.makedirs(folder, exist_ok=True)
    shutil.copy(f"{made}/{part}", f"{folder}/{name}.parquet")


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    run = lambda: ingest_documents.run(spark, source, f"{SF}/labels.parquet", store, state)
    pieces(spark, source, "a", "doc_id < 90")
    one = run()
    first = rows(ingest_documents.output_of(spark, store))
    assert one["read"] == 90 and one["kept"] == one["documents"] == len(first)
    # nothing new
    again = run()
    assert (again["batches"], again["read"]) == (0, 0) and rows(ingest_documents.output_of(spark, store)) == first
    # a file more, part of which is there already
    pieces(spark, source, "b", "doc_id >= 60")
    two = run()
    assert two["read"] == 140 and two["documents"] == one["documents"] + two["kept"]
    both = rows(ingest_documents.output_of(spark, store))
    assert set(first) < set(both)
    texts = spark.read.parquet(f"{SF}/documents.parquet").agg(F.countDistinct("text")).first()[0]
    assert len(both) == len({r[4] for r in both}) == texts


def test_a_batch_that_runs_again_writes_over_itself(spark, tmp_path):
    store = str(tmp_path / "store")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = [ingest_documents.take(docs.where("doc_id < 50"), 0, f"{SF}/labels.parquet", store) for _ in range(2)]
    assert told[0] == told[1] and told[0]["kept"] == ingest_documents.output_of(spark, store).count()


def test_documents_without_text(spark, tmp_path):
    store = str(tmp_path / "store")
    docs = spark.createDataFrame([(1, None, "en", "src1", 0), (2, "", "en", "src1", 0), (3, "some words", "en", None, 10), (4, "some words", "en", "src2", 10)], ingest_documents.SOURCE)
    ingest_documents.take(docs, 0, f"{SF}/labels.parquet", store)
    ingest_documents.take(docs, 1, f"{SF}/labels.parquet", store)
    assert sorted(r["id"] for r in ingest_documents.output_of(spark, store).collect()) == ["2", "3"]


def test_settings_come_from_file_and_arguments(tmp_path):
    path = tmp_path / "job.json"
    path.write_text(json.dumps({"documents": "d", "output": "o"}))
    assert settings("", build_index.SETTINGS, ["--config", str(path), "--output", "p"]) == {"documents": "d", "output": "p"}
    path.write_text(json.dumps({"other": 1}))
    with pytest.raises(SystemExit):
        settings("", build_index.SETTINGS, ["--config", str(path)])


@pytest.mark.parametrize("job", ["build_index", "ingest_documents"])
def test_command_lines(spark, tmp_path, job):
    with open(f"{ROOT}/jobs/{job}.json", encoding="utf-8") as f:
        held = json.load(f)
    held |= {"output": str(tmp_path / "out"), "labels": f"{SF}/labels.parquet"}
    if job == "build_index":
        held |= {"documents": f"{SF}/documents.parquet", "departments": "src1"}
    else:
        held |= {"source": SF, "checkpoint": str(tmp_path / "state")}
    (tmp_path / "job.json").write_text(json.dumps(held))
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--config", str(tmp_path / "job.json")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and "done: {" in done.stderr
    output = build_index.output_of if job == "build_index" else ingest_documents.output_of
    assert output(spark, str(tmp_path / "out")).count() > 0


def test_jobs_need_no_corpus_operators():
    for name in os.listdir(f"{ROOT}/jobs"):
        if name.endswith(".py"):
            with open(f"{ROOT}/jobs/{name}", encoding="utf-8") as f:
                text = f.read()
            assert "llm" not in text and "corpus_pipeline" not in text, name


def test_tables_may_be_folders_of_files(spark, tmp_path):
    """The registered queries over streams read a table that is a folder as they read one that is a file."""
    from jobs.queries import job2_ingest_documents
    from lorewell import catalogue

    sf = str(tmp_path / "sf")
    for name in ("documents", "labels", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{sf}/{name}.parquet")
    for query in (job2_ingest_documents, catalogue.QUERIES["stream_dedup"], catalogue.QUERIES["stream_event_windows"]):
        found = rows(query(spark, sf))
        assert found and found == rows(query(spark, SF))

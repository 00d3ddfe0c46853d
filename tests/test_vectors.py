"""The inverted-file index on clustered vectors, and plans of vector searches."""

import numpy as np
import pytest

from lorewell import catalogue
from lorewell.sources.vector_index import open_vectors, search_vectors, write_vectors

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """600 vectors around 40 centres in two departments, as topics of documents make them."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 32))
    v = centres[np.arange(600) % 40] + 0.25 * r.normal(size=(600, 32))
    rows = [(i, "ab"[i % 2], v[i].tolist()) for i in range(600)] + [(900, "a", None), (901, "a", [0.0] * 32)]
    path = str(tmp_path_factory.mktemp("vectors"))
    write_vectors(spark.createDataFrame(rows, "id long, department string, v array<double>"), path)
    return open_vectors(spark, path), v / np.linalg.norm(v, axis=1, keepdims=True)


def best(v, at, k, of=None):
    s = v @ v[at]
    ids = [i for i in np.argsort(-s, kind="stable") if of is None or i % 2 == of]
    return set(ids[:k])


def test_few_lists_find_nearly_all(spark, clustered):
    index, v = clustered
    asked = list(range(0, 600, 15))
    q = spark.createDataFrame([(i, v[i].tolist()) for i in asked], "query_id long, q array<double>")
    found, seen = search_vectors(index, q, 10, probes=3)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    recall = sum(len(got[i] & best(v, i, 10)) for i in asked) / (10 * len(asked))
    share = sum(r["seen"] for r in seen.collect()) / len(asked) / 600
    assert recall >= 0.95 and share < 0.3, (recall, share)
    # every list: exact
    whole, _ = search_vectors(index, q, 10, probes=10**6)
    got = {}
    for r in whole.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert all({x[1] for x in got[i]} == best(v, i, 10) for i in asked)
    assert all(sorted(got[i])[0][1:] == (i, 1.0) for i in asked)


def test_a_search_stays_in_its_department(spark, clustered):
    index, v = clustered
    q = spark.createDataFrame([(1, v[0].tolist(), "a"), (2, v[1].tolist(), "b"), (3, v[0].tolist(), "none")], "query_id long, q array<double>, department string")
    found, _ = search_vectors(index, q, 5, probes=10**6)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got == {1: best(v, 0, 5, 0), 2: best(v, 1, 5, 1)}


def test_plans_cut_before_the_shuffle_and_filter_no_decoded_vectors(spark):
    for name in ("vector_topk_exact", "vector_int8_topk"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution()
        assert "WindowGroupLimit" in plan.optimizedPlan().toString(), name
        filters = [line for line in plan.executedPlan().toString().splitlines() if "PushedFilters" in line or line.strip().startswith("+- Filter") or "DataFilters" in line]
        assert filters and not any("transform(" in f.split("PushedFilters")[0].split("DataFilters")[-1] for f in filters), name

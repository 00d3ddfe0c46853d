"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import math

import duckdb
import pytest

from lorewell import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalogue.ORACLE_SQL:
        found = duck.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_nothing_outside_imports_the_corpus_operators():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent
    for p in [*root.glob("lorewell/*.py"), *root.glob("lorewell/[!l]*/*.py")]:
        assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p

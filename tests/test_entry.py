"""The driver's contract, and queries against their SQL on the smallest tables."""

import importlib
import os

import __spark_entry__
import duckdb
import pytest
from docloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "benchmark documents embeddings pages labels conversations events".split()


def rows(values, columns):
    by = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(f"{v[k]:.9g}" if isinstance(v[k], float) else str(v[k]) for k in by) for v in values)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    want = sql.execute(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), [c[0] for c in want.description])


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "citation" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_without_training_data_operators(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("docloom.llm") else real(name, *a))
    assert set(__spark_entry__.queries()) == set(QUERIES)

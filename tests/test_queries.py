"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from evidra.plans import agreement, audit, baselines, contracts, controls, experiments, selection, vectors

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = (baselines, agreement, audit, experiments, vectors, controls, selection, contracts)
QUERIES = {k: f for p in PLANS for k, f in p.QUERIES.items()}
SQL = {k: q for p in PLANS for k, q in p.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.6g}"
    return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 1


def test_near_duplicates_of_equal_parity_are_found(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    rows = [(2, " ".join(words), "x"), (4, " ".join(words[:-1]), "y"), (7, " ".join(words[:-4]), "y"), (9, "other text that stands alone", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = {(r["a"], r["b"]) for r in QUERIES["c15_near_duplicate_join_all"](spark, str(tmp_path)).collect()}
    assert pairs == {(2, 4), (2, 7), (4, 7)}
    best = {r["doc_id"]: r["other"] for r in QUERIES["c17_cross_domain_max_all"](spark, str(tmp_path)).collect()}
    assert best == {2: 4, 4: 2, 7: 2}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every SQL-checkable query equals its DuckDB oracle (small scale)."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from settings import SF_SMALL


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in sorted(f.removesuffix(".parquet") for f in os.listdir(SF_SMALL) if f.endswith(".parquet")):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


SPARK_TO_DUCK = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
                 "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in sdf.dtypes} == duck_types
    cur = con.execute(E.oracle_sql()[name])
    c1, r1 = _bag(sdf.columns, [tuple(r) for r in sdf.collect()])
    c2, r2 = _bag([d[0] for d in cur.description], cur.fetchall())
    assert c1 == c2
    assert r1 == r2


def test_every_query_registered_has_oracle_or_is_model():
    rows_only = {"anomaly_scores", "trust_scores", "trust_metrics", "shap_local", "shap_global", "reviewed"} | set(E._LLM_QUERIES) - set(E._LLM_SQL)
    assert set(E.queries()) - set(E.oracle_sql()) == rows_only


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "raw_dq_score" in df.columns

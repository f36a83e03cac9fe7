"""Every named query against its SQL in an independent engine, at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from tracegrove.plans import audit_queries, registry, retrieval_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6))
    return str(v)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = oracle.execute(registry.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in got.collect())
    at = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted(tuple(cell(r[k]) for k in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reservoir_is_bounded_and_agrees(spark, sf_dir):
    once, again = (sorted(registry.QUERIES["reservoir_sample"](spark, sf_dir).collect()) for _ in range(2))
    assert once == again
    counts = {}
    for r in once:
        counts[r["tool"]] = counts.get(r["tool"], 0) + 1
    assert counts and max(counts.values()) <= 1000


def test_missing_stages_of_whole_traces(spark, tmp_path):
    rows = [(1, "2024-01-02", 1, "click"), (2, "2024-01-02", 1, "signup"), (3, "2024-01-20", 1, "purchase"), (4, "2024-01-03", 2, "click"), (5, "2024-01-25", 2, "signup"), (6, "2024-01-28", 3, "view"), (7, "2024-01-02", 0, "view")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
    events.selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    want = [("1", "refund"), ("2", "purchase"), ("2", "refund"), ("3", "click"), ("3", "purchase"), ("3", "refund"), ("3", "signup")]
    got = registry.QUERIES["missing_stages"](spark, str(tmp_path)).select("trace_id", "event")
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(con.execute(registry.SQL["missing_stages"]).fetchall()) == want


def test_sigmoid_normalize_without_a_positive_value(spark, tmp_path):
    events = spark.createDataFrame([(1, 0.0), (2, -3.5), (3, None), (4, 10.0), (5, 250.0)], "event_id long, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(registry.SQL["sigmoid_normalize"]).fetchall())
    assert want == [(1, None), (2, None), (3, None), (4, 0.5), (5, 1.0)]
    assert sorted(map(tuple, registry.QUERIES["sigmoid_normalize"](spark, str(tmp_path)).collect())) == want

"""Named queries on the stored tables, each with SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Views of the oracle, as tracegrove.sources.tables has them.
FILES = """code_files AS (SELECT doc_id, source AS repo, lang, 'main' AS branch, lang || '/doc_' || doc_id ||
  CASE lang WHEN 'en' THEN '.java' WHEN 'de' THEN '.cpp' WHEN 'fr' THEN '.py' ELSE '.txt' END AS path, text AS content FROM documents)"""
EVENTS = """audit_events AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN user_id = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS trace_id,
  event_type AS event, value AS duration_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CAST(value > 100 AS INTEGER) AS slow,
  event_type AS tool, CAST(NULL AS VARCHAR) AS stage, 'api' AS interface, props AS payload_json FROM events)"""
JOBS = """index_repos AS (SELECT c_custkey AS id, c_name AS repo_path FROM customer),
index_jobs AS (SELECT o_orderkey AS id, o_custkey AS repo_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'lexical' WHEN o_orderpriority = '3-MEDIUM' THEN 'dense' ELSE 'graph' END AS backend,
  epoch_ms(o_orderdate) AS started_at, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'success' ELSE 'fail' END AS status FROM orders)"""
EDGES = """graph_edges AS (SELECT DISTINCT 'part:' || l_partkey AS a, 'supplier:' || l_suppkey AS b, 'CALLS' AS type FROM lineitem
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'DEFINED_IN' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'MEMBER_OF' FROM nation)"""
VECTORS = "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, CAST(label AS VARCHAR) AS repo FROM embeddings)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put

"""Queries of the audit side: statistics, pages, traces, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.operators import events as E
from tracegrove.operators import jobs as J
from tracegrove.operators import stats as T
from tracegrove.plans.registry import EVENTS, JOBS, query
from tracegrove.sources import tables as S

#: The time that windows look back from, in epoch milliseconds (2024-01-15).
NOW = 1_705_276_800_000
#: The time that jobs are looked at (1998-06-01).
JOBS_NOW = 896_659_200_000

WINDOW = f"WITH {EVENTS}, w AS (SELECT * FROM audit_events WHERE ts_ms >= {NOW} - 3600000)"


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return S.audit_events(spark, sf)


@query(WINDOW + " SELECT count(*) AS n, round(coalesce(avg(duration_ms), 0), 6) AS mean_ms, CAST(coalesce(sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END), 0) AS BIGINT) AS errors, CAST(coalesce(sum(slow), 0) AS BIGINT) AS slow, round(count(*) / 3600, 6) AS qps, round(CASE WHEN count(*) > 0 THEN sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) / count(*) ELSE 0 END, 6) AS error_rate, round(CASE WHEN count(*) > 0 THEN sum(slow) / count(*) ELSE 0 END, 6) AS slow_ratio FROM w")
def stats_totals(spark: SparkSession, sf: str) -> DataFrame:
    return T.totals(T.in_window(ev(spark, sf), NOW), 3600)


def _pick(value: str, index: str) -> str:
    return f"list({value} ORDER BY {value})[CAST({index} AS BIGINT) + 1]"


@query(f"WITH {EVENTS}, b AS (SELECT *, (ts_ms // 900000) * 900000 AS bucket FROM audit_events WHERE ts_ms >= {NOW} - 86400000) SELECT bucket, count(*) AS n, CAST(sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(count(*) / 900, 6) AS qps, {_pick('duration_ms', 'round_even(0.5 * (count(*) - 1), 0)')} AS p50, {_pick('duration_ms', 'round_even(0.95 * (count(*) - 1), 0)')} AS p95 FROM b GROUP BY bucket")
def stats_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return T.buckets(T.in_window(ev(spark, sf), NOW, "24h"), 900)


@query(WINDOW + f" SELECT count(*) AS n, {_pick('duration_ms', 'round_even(0.5 * (count(*) - 1), 0)')} AS p50, {_pick('duration_ms', 'round_even(0.95 * (count(*) - 1), 0)')} AS p95, {_pick('duration_ms', 'round_even(0.99 * (count(*) - 1), 0)')} AS p99 FROM w")
def stats_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return T.percentiles(T.in_window(ev(spark, sf), NOW))


@query(f"WITH {EVENTS} SELECT tool AS name, count(*) AS calls, round(sum(duration_ms), 4) AS total_ms, CAST(sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) / count(*), 4) AS error_rate, round(avg(duration_ms), 1) AS mean_ms, " + ", ".join(f"round({_pick('duration_ms', f'least(floor(count(*) * {p} / 100), count(*) - 1)')}, 1) AS p{p}" for p in (50, 95, 99)) + " FROM audit_events GROUP BY tool")
def tool_stats(spark: SparkSession, sf: str) -> DataFrame:
    return T.tool_stats(ev(spark, sf))


@query(f"WITH {EVENTS} SELECT trace_id, count(*) AS n, {_pick('duration_ms', 'round_even(0.9 * (count(*) - 1), 0)')} AS p90 FROM audit_events GROUP BY trace_id")
def percentile_p_idx(spark: SparkSession, sf: str) -> DataFrame:
    return T.at_indexes(ev(spark, sf), ["trace_id"], "duration_ms", {"p90": (T.nearest_index, 0.9)})


@query(f"WITH {EVENTS} SELECT event AS stage, count(*) AS n, {_pick('duration_ms', 'count(*) // 2')} AS p50, {_pick('duration_ms', 'least(floor(count(*) * 0.95::DOUBLE), count(*) - 1)')} AS p95, max(duration_ms) AS max_ms FROM audit_events WHERE event IN ('click', 'view', 'purchase') GROUP BY event")
def latency_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return T.lane_latencies(ev(spark, sf).where(F.col("event").isin("click", "view", "purchase")).select(F.col("event").alias("stage"), "duration_ms"))


@query(f"WITH {EVENTS} SELECT id, ts_ms, trace_id, event, duration_ms, status, slow, tool, stage, interface, payload_json FROM audit_events WHERE tool = 'error' AND slow = 1 AND ts_ms >= {NOW} - 864000000 AND ts_ms < {NOW} ORDER BY ts_ms DESC, id DESC LIMIT 50 OFFSET 20")
def events_filter_page(spark: SparkSession, sf: str) -> DataFrame:
    return E.page(E.event_filter(ev(spark, sf), tool="error", slow=True, from_ms=NOW - 864_000_000, to_ms=NOW), 50, 20)


@query(f"WITH {EVENTS} SELECT count(*) AS n, coalesce(max(ts_ms), 0) AS last_ms FROM audit_events WHERE status = 'error'")
def events_total(spark: SparkSession, sf: str) -> DataFrame:
    return E.health(E.event_filter(ev(spark, sf), status="error"))


@query(f"WITH {EVENTS} SELECT trace_id, round(min(ts_ms - duration_ms), 4) AS started_ms, max(ts_ms) AS ended_ms, CAST(trunc(max(ts_ms) - min(ts_ms - duration_ms)) AS BIGINT) AS total_ms, count(*) AS n, bool_or(status <> 'ok') AS failed FROM audit_events WHERE trace_id <> '' GROUP BY trace_id")
def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.trace_summary(ev(spark, sf))


@query(f"WITH {EVENTS}, s AS (SELECT trace_id, min(ts_ms - duration_ms) AS b, max(ts_ms) - min(ts_ms - duration_ms) AS t FROM audit_events WHERE trace_id <> '' GROUP BY 1) SELECT id, a.trace_id, tool AS label, round(CASE WHEN t > 0 THEN (ts_ms - duration_ms - b) / t * 100 ELSE 0 END, 4) AS offset_pct, round(greatest(0.5, CASE WHEN t > 0 THEN duration_ms / t * 100 ELSE 0 END), 4) AS width_pct FROM audit_events a JOIN s USING (trace_id)")
def trace_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return E.waterfall(ev(spark, sf))


@query(f"WITH {EVENTS} SELECT trace_id, max(ts_ms) AS last_ms, count(*) AS n FROM audit_events WHERE contains(lower(payload_json), '\"k\": 1') AND trace_id <> '' GROUP BY trace_id ORDER BY last_ms DESC, trace_id LIMIT 50")
def payload_search(spark: SparkSession, sf: str) -> DataFrame:
    return E.payload_search(ev(spark, sf), '"K": 1')


@query(f"WITH {EVENTS} SELECT id, event, ts_ms FROM audit_events WHERE ts_ms >= {NOW} - 10 * 86400000")
def retention_keep(spark: SparkSession, sf: str) -> DataFrame:
    return E.retention_keep(ev(spark, sf), NOW, 10).select("id", "event", "ts_ms")


@query(f"WITH {EVENTS} SELECT CAST(json_extract_string(payload_json, '$.k') AS BIGINT) AS k, count(*) AS n FROM audit_events GROUP BY 1")
def json_extract_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).groupBy(F.get_json_object("payload_json", "$.k").try_cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS} SELECT count(DISTINCT trace_id) AS traces, count(DISTINCT event) AS kinds FROM audit_events WHERE trace_id <> ''")
def distinct_traces(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).where("trace_id <> ''").agg(F.countDistinct("trace_id").alias("traces"), F.countDistinct("event").alias("kinds"))


#: The last one is a stage that no trace of the stored table has.
REQUIRED = ["click", "signup", "purchase", "refund"]


@query(f"WITH {EVENTS}, r(event) AS (VALUES ('click'), ('signup'), ('purchase'), ('refund')) SELECT trace_id, r.event FROM (SELECT DISTINCT trace_id FROM audit_events WHERE trace_id <> '') t, r WHERE NOT EXISTS (SELECT 1 FROM audit_events e WHERE e.trace_id = t.trace_id AND e.event = r.event)")
def missing_stages(spark: SparkSession, sf: str) -> DataFrame:
    return E.missing_stages(ev(spark, sf), REQUIRED)


@query(f"WITH {EVENTS} SELECT (ts_ms // 300000) * 300000 AS window_ms, tool AS name, count(*) AS calls, CAST(sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(avg(duration_ms), 6) AS mean_ms FROM audit_events GROUP BY 1, 2")
def summary_5min(spark: SparkSession, sf: str) -> DataFrame:
    return T.summary(ev(spark, sf))


@query(f"WITH {EVENTS}, s AS (SELECT (ts_ms // 300000) * 300000 AS window_ms, tool AS name, count(*) AS calls FROM audit_events GROUP BY 1, 2) SELECT window_ms, name, calls, CAST(slot AS INTEGER) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY window_ms DESC) AS slot FROM s) WHERE slot <= 12")
def summary_trend(spark: SparkSession, sf: str) -> DataFrame:
    return T.trend(T.summary(ev(spark, sf))).select("window_ms", "name", "calls", "slot")


@query(f"WITH {EVENTS} SELECT tool, id, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY md5('1:' || id), id) AS slot FROM audit_events) WHERE slot <= 1000")
def reservoir_sample(spark: SparkSession, sf: str) -> DataFrame:
    return T.reservoir(ev(spark, sf))


# ---- jobs -------------------------------------------------------------------------------


@query(f"WITH {JOBS}, l AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, id DESC) AS n FROM index_jobs WHERE backend = 'dense') SELECT r.id, repo_path, l.id AS job_id, backend, status, started_at FROM index_repos r LEFT JOIN (SELECT * FROM l WHERE n = 1) l ON l.repo_id = r.id")
def latest_job_per_repo(spark: SparkSession, sf: str) -> DataFrame:
    return J.latest_job_per_repo(S.index_repos(spark, sf), S.index_jobs(spark, sf), backend="dense")


@query(f"WITH {JOBS} SELECT r.id AS repo_id, repo_path, j.id AS job_id, backend, status, started_at FROM index_repos r LEFT JOIN index_jobs j ON j.repo_id = r.id WHERE r.id = 7 ORDER BY started_at DESC, job_id DESC LIMIT 50")
def repo_detail(spark: SparkSession, sf: str) -> DataFrame:
    return J.repo_detail(S.index_repos(spark, sf), S.index_jobs(spark, sf), 7)


@query(f"WITH {JOBS} SELECT id, CASE WHEN status = 'running' AND started_at < {JOBS_NOW} - 7200000 THEN 'warn' ELSE status END AS status FROM index_jobs")
def reap_stale(spark: SparkSession, sf: str) -> DataFrame:
    return J.reap_stale(S.index_jobs(spark, sf), JOBS_NOW).select("id", "status")


@query(f"WITH {JOBS} SELECT id, repo_path, CASE WHEN id NOT IN (SELECT repo_id FROM index_jobs WHERE backend <> 'lexical') THEN {JOBS_NOW} END AS archived_at FROM index_repos")
def archive_when_empty(spark: SparkSession, sf: str) -> DataFrame:
    return J.archive_when_empty(S.index_repos(spark, sf), S.index_jobs(spark, sf).where("backend <> 'lexical'"), JOBS_NOW)


@query(f"WITH {JOBS} SELECT id, repo_id, backend FROM index_jobs WHERE NOT (repo_id = 7 AND backend = 'graph')")
def delete_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return J.delete_jobs(S.index_jobs(spark, sf), 7, "graph").select("id", "repo_id", "backend")


@query(f"WITH {JOBS}, n AS (SELECT DISTINCT s_name AS repo_path FROM supplier) SELECT id, repo_path FROM index_repos UNION ALL SELECT (SELECT max(id) FROM index_repos) + row_number() OVER (ORDER BY repo_path), repo_path FROM n")
def upsert_repo(spark: SparkSession, sf: str) -> DataFrame:
    repos = S.index_repos(spark, sf)
    paths = S.load(spark, sf, "supplier").select(F.col("s_name").alias("repo_path")).union(repos.select("repo_path"))
    return J.upsert_repos(repos, paths)


@query(f"WITH {JOBS} SELECT r.id AS repo_id, 'dense' AS backend, min(j.id) AS existing_job_id FROM index_repos r JOIN index_jobs j ON j.repo_id = r.id AND j.backend = 'dense' AND j.status = 'running' GROUP BY r.id")
def running_lock(spark: SparkSession, sf: str) -> DataFrame:
    requests = S.index_repos(spark, sf).select(F.col("id").alias("repo_id"), F.lit("dense").alias("backend"))
    return J.locked(S.index_jobs(spark, sf), requests)


@query(f"WITH {JOBS}, f AS (SELECT repo_id, max(started_at) + 1000 AS last_finished FROM index_jobs WHERE status <> 'running' GROUP BY 1) SELECT r.id, repo_path, coalesce(last_finished, 0) AS last_finished FROM index_repos r LEFT JOIN f ON f.repo_id = r.id")
def repos_by_last_finish(spark: SparkSession, sf: str) -> DataFrame:
    ended = S.index_jobs(spark, sf).where("status <> 'running'").withColumn("finished_at", F.col("started_at") + 1000)
    return J.by_last_finish(S.index_repos(spark, sf), ended)

"""Filtered pages, traces and payload search over audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrove.config import DEFAULT
from tracegrove.functions.text import ascii_lower

COLUMNS = ("id", "ts_ms", "trace_id", "event", "duration_ms", "status", "slow", "tool", "stage", "interface", "payload_json")


def event_filter(events: DataFrame, tool: str | None = None, status: str | None = None, slow: bool | None = None, event: str | None = None, from_ms: int | None = None, to_ms: int | None = None, trace_id: str | None = None) -> DataFrame:
    """Events that meet all conditions given; times are half open."""
    for name, value in (("tool", tool), ("status", status), ("event", event), ("trace_id", trace_id)):
        if value is not None:
            events = events.where(F.col(name) == value)
    if slow is not None:
        events = events.where(F.col("slow") == int(slow))
    if from_ms is not None:
        events = events.where(F.col("ts_ms") >= from_ms)
    if to_ms is not None:
        events = events.where(F.col("ts_ms") < to_ms)
    return events


def page(events: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page, latest first."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset 0 or more")
    return events.select(*COLUMNS).orderBy(F.col("ts_ms").desc(), F.col("id").desc()).offset(offset).limit(limit)


def trace_summary(events: DataFrame) -> DataFrame:
    """Start, end, whole duration, events and success of each trace; events without a trace are left out."""
    rows = events.where("trace_id <> ''").withColumn("begin", F.col("ts_ms") - F.col("duration_ms"))
    out = rows.groupBy("trace_id").agg(F.min("begin").alias("b"), F.max("ts_ms").alias("ended_ms"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status") != "ok").alias("failed"))
    return out.select("trace_id", F.round("b", 4).alias("started_ms"), "ended_ms", (F.col("ended_ms") - F.col("b")).cast("long").alias("total_ms"), "n", "failed")


def waterfall(events: DataFrame) -> DataFrame:
    """Each event's label, offset and width in per cent of its trace; bars are half a per cent wide at least."""
    rows = events.where("trace_id <> ''")
    spans = rows.groupBy("trace_id").agg(F.min(F.col("ts_ms") - F.col("duration_ms")).alias("b"), F.max("ts_ms").alias("e"))
    rows = rows.join(spans, "trace_id").withColumn("total", F.col("e") - F.col("b"))
    share = lambda x: F.when(F.col("total") > 0, x / F.col("total") * 100).otherwise(0.0)
    return rows.select("id", "trace_id", F.coalesce("tool", "stage", "event").alias("label"), F.round(share(F.col("ts_ms") - F.col("duration_ms") - F.col("b")), 4).alias("offset_pct"), F.round(F.greatest(F.lit(0.5), share(F.col("duration_ms"))), 4).alias("width_pct"))


def holds(payload: Column, text: str) -> Column:
    """Whether the text occurs, ASCII letters in either case."""
    return F.contains(ascii_lower(payload), ascii_lower(F.lit(text)))


def payload_search(events: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Traces with the text in a payload, latest first."""
    if not 1 <= len(text) <= 200:
        raise ValueError("a search text has 1 to 200 characters")
    found = events.where(holds(F.col("payload_json"), text) & (F.col("trace_id") != ""))
    return found.groupBy("trace_id").agg(F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n")).orderBy(F.col("last_ms").desc(), "trace_id").limit(limit)


def health(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("ts_ms"), F.lit(0)).alias("last_ms"))


def retention_keep(events: DataFrame, now_ms: int, days: int = DEFAULT.retention_days) -> DataFrame:
    """Events that are not older than the retention."""
    return events.where(F.col("ts_ms") >= now_ms - days * 86_400_000)


def missing_stages(events: DataFrame, required: list[str]) -> DataFrame:
    """Which of the required events each trace lacks."""
    spark = events.sparkSession
    traces = events.where("trace_id <> ''").select("trace_id").distinct()
    wanted = spark.createDataFrame([(r,) for r in required], "event string")
    return traces.crossJoin(F.broadcast(wanted)).join(events.select("trace_id", "event").distinct(), ["trace_id", "event"], "left_anti")

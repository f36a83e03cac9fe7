"""Statistics of the audit event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrove.config import DEFAULT, WINDOWS


def failed() -> Column:
    return F.when(F.col("status") != "ok", 1).otherwise(0)


def ratio(a: Column, n: Column, places: int = 6) -> Column:
    return F.round(F.when(n > 0, a / n).otherwise(0.0), places)


def in_window(events: DataFrame, now_ms: int, window: str = "1h") -> DataFrame:
    return events.where(F.col("ts_ms") >= now_ms - WINDOWS[window][0] * 1000)


def totals(events: DataFrame, span_s: int) -> DataFrame:
    """n, mean_ms, errors, slow, qps, error_rate, slow_ratio."""
    out = events.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("mean_ms"), F.coalesce(F.sum(failed()), F.lit(0)).alias("errors"), F.coalesce(F.sum("slow"), F.lit(0)).alias("slow"))
    n = F.col("n")
    return out.select("n", F.round("mean_ms", 6).alias("mean_ms"), "errors", "slow", F.round(n / span_s, 6).alias("qps"), ratio(F.col("errors"), n).alias("error_rate"), ratio(F.col("slow"), n).alias("slow_ratio"))


# index of the p-th percentile in n sorted values, from 0
def nearest_index(n: Column, p: float) -> Column:
    """Half-even rounding of p (n - 1)."""
    return F.rint(p * (n - 1)).cast("long")


def floor_index(n: Column, p: int) -> Column:
    """n p / 100 rounded down, n - 1 at most."""
    return F.least(F.floor(n * p / 100), n - 1).cast("long")


def at_indexes(rows: DataFrame, by: list[str], value: str, indexes: dict[str, tuple]) -> DataFrame:
    """For each group, the values at given places of its sorted values; ``indexes`` maps names to (function, p).

    Equal values are counted first, so that what is sorted in a group is its distinct values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    counted = counted.withColumns({"_n": F.sum("_c").over(group), "_to": F.sum("_c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})
    picks = [F.max(F.when((f(F.col("_n"), p) >= F.col("_to") - F.col("_c")) & (f(F.col("_n"), p) < F.col("_to")), F.col(value))).alias(name) for name, (f, p) in indexes.items()]
    return counted.groupBy(*by).agg(F.max("_n").alias("n"), *picks)


def buckets(events: DataFrame, bucket_s: int) -> DataFrame:
    """bucket (epoch ms), n, errors, qps, p50, p95 of each bucket that has events."""
    width = bucket_s * 1000
    rows = events.withColumn("bucket", F.expr(f"(ts_ms div {width}) * {width}"))
    base = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(failed()).alias("errors"))
    pct = at_indexes(rows, ["bucket"], "duration_ms", {"p50": (nearest_index, 0.5), "p95": (nearest_index, 0.95)}).drop("n")
    return base.join(pct, "bucket", "left").select("bucket", "n", "errors", F.round(F.col("n") / bucket_s, 6).alias("qps"), F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"))


def percentiles(events: DataFrame) -> DataFrame:
    return at_indexes(events.withColumn("_g", F.lit(0)), ["_g"], "duration_ms", {"p50": (nearest_index, 0.5), "p95": (nearest_index, 0.95), "p99": (nearest_index, 0.99)}).drop("_g")


def exact_quantiles(rows: DataFrame, value: str, indexes: dict[str, int], total: int) -> dict[str, float]:
    """Values at given places of all rows sorted, for large inputs: an approximate bracket narrows what is sorted to a thin slice.

    Two passes for each place; only brackets and the results come to the driver.
    """
    out = {}
    for name, k in indexes.items():
        lo, hi = rows.approxQuantile(value, [max(0.0, k / total - 0.002), min(1.0, (k + 1) / total + 0.002)], 0.001)
        below = rows.where(F.col(value) < lo).count()
        part = rows.where((F.col(value) >= lo) & (F.col(value) <= hi))
        got = at_indexes(part.withColumn("_g", F.lit(0)), ["_g"], value, {"v": (lambda n, p: F.lit(p), k - below)}).first()
        out[name] = got["v"]
    return out


def tool_stats(events: DataFrame) -> DataFrame:
    """Each tool's (or stage's) calls, total, errors, error_rate, mean and percentiles to one place."""
    rows = events.withColumn("name", F.coalesce("tool", "stage"))
    base = rows.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("duration_ms"), 4).alias("total_ms"), F.sum(failed()).alias("errors"), F.round(F.avg("duration_ms"), 1).alias("mean_ms"))
    pct = at_indexes(rows, ["name"], "duration_ms", {f"p{p}": (floor_index, p) for p in (50, 95, 99)}).drop("n")
    return base.join(pct, "name").select("name", "calls", "total_ms", "errors", F.round(F.col("errors") / F.col("calls"), 4).alias("error_rate"), "mean_ms", *(F.round(f"p{p}", 1).alias(f"p{p}") for p in (50, 95, 99)))


def lane_latencies(rows: DataFrame) -> DataFrame:
    """count, p50, p95 and max of each stage; p50 at n // 2, p95 at floor(0.95 n), the last at most."""
    half = lambda n, p: F.floor(n / 2).cast("long")
    high = lambda n, p: F.least(F.floor(n * p).cast("long"), n - 1)
    pct = at_indexes(rows, ["stage"], "duration_ms", {"p50": (half, 0.5), "p95": (high, 0.95)})
    return pct.join(rows.groupBy("stage").agg(F.max("duration_ms").alias("max_ms")), "stage")


def summary(events: DataFrame, window: str = DEFAULT.summary_window) -> DataFrame:
    """Calls, errors and mean of each tool in tumbling event-time windows; works on streams, too."""
    ts = F.timestamp_millis("ts_ms")
    rows = events.withColumn("ts", ts)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", "10 minutes")
    out = rows.groupBy(F.window("ts", window).alias("w"), F.coalesce("tool", "stage").alias("name")).agg(F.count(F.lit(1)).alias("calls"), F.sum(failed()).alias("errors"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))
    return out.select(F.unix_millis("w.start").alias("window_ms"), "name", "calls", "errors", "mean_ms")


def trend(summaries: DataFrame, slots: int = DEFAULT.trend_slots) -> DataFrame:
    """The latest windows of each name."""
    order = Window.partitionBy("name").orderBy(F.col("window_ms").desc())
    return summaries.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= slots)


def reservoir(events: DataFrame, size: int = 1000, seed: int = 1) -> DataFrame:
    """A uniform sample of each tool's durations: the least hashes of their ids, so that reruns agree."""
    order = Window.partitionBy("tool").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), "id")
    return events.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= size).select("tool", "id", "duration_ms")

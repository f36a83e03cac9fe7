"""Audit ingestion: JSON lines to event rows, and the streaming queries around them."""

from __future__ import annotations

from contextlib import suppress
from threading import Event, Thread

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracegrove.config import DEFAULT
from tracegrove.operators.events import retention_keep
from tracegrove.operators.stats import summary
from tracegrove.streaming.tail import TailSource


def parse_lines(lines: DataFrame) -> DataFrame:
    """Event rows of JSON lines (value). Lines without valid JSON or a valid timestamp are left out; see ``rejected``."""
    return _parsed(lines).where("ts_ms IS NOT NULL").drop("value")


def rejected(lines: DataFrame) -> DataFrame:
    return _parsed(lines).where("ts_ms IS NULL").select("value")


def utc(time: Column) -> Column:
    """An ISO time with a zone: UTC where it has none, whatever the session's zone is."""
    day, zoned = time.rlike(r"^\d{4}-\d\d-\d\d$"), time.rlike(r"\d\d:\d\d.*([Zz]|[+-]\d\d(:?\d\d)?)$")
    return F.when(day, F.concat(time, F.lit("T00:00:00Z"))).when(zoned, time).otherwise(F.concat(time, F.lit("Z")))


def _parsed(lines: DataFrame) -> DataFrame:
    get = lambda k: F.get_json_object("value", f"$.{k}")
    event = F.coalesce(F.nullif(get("event"), F.lit("")), F.lit("unknown"))
    slow = F.lower(get("slow"))
    return lines.select(
        "value",
        F.unix_millis(F.try_to_timestamp(utc(get("timestamp")))).alias("ts_ms"),
        F.coalesce(get("trace_id"), F.lit("")).alias("trace_id"),
        event.alias("event"),
        F.coalesce(get("duration_ms").try_cast("double"), F.lit(0.0)).alias("duration_ms"),
        F.coalesce(F.nullif(get("status"), F.lit("")), F.lit("ok")).alias("status"),
        F.when(slow.isNull() | slow.isin("false", "0", "", "null"), 0).otherwise(1).alias("slow"),
        F.when(event == "tool_call", get("tool")).alias("tool"),
        F.when(event == "pipeline_stage", get("stage")).alias("stage"),
        get("interface").alias("interface"),
        F.col("value").alias("payload_json"),
    )


def tail(spark: SparkSession, path: str, rotations: int = 5) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", path).option("rotations", rotations).load()


def start_ingest(spark: SparkSession, log: str, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends events to a Parquet table, by date; offsets and files are committed together, so each line counts once."""
    rows = parse_lines(tail(spark, log)).withColumn("event_date", F.to_date(F.timestamp_millis("ts_ms")))
    writer = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).partitionBy("event_date").outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def start_summary(events: DataFrame, name: str, checkpoint: str, window: str = "5 minutes") -> StreamingQuery:
    """Keeps the windows' summary of a stream of events in a table of memory."""
    return summary(events, window).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("complete").start()


def drain(query: StreamingQuery, grace_s: float = 2.0) -> bool:
    """Takes what the log still holds, for ``grace_s`` at most, and stops; whether all of it came in."""
    done = Event()

    def take() -> None:
        with suppress(Exception):  # a stopped query ends the wait
            query.processAllAvailable()
            done.set()

    Thread(target=take, daemon=True).start()
    whole = done.wait(grace_s)
    query.stop()
    return whole


class Retention:
    """Once an hour, a snapshot of an event table without the events beyond their days, in place of the snapshot before.

    The ingested table itself keeps its files, as its log of committed batches names them.
    """

    def __init__(self, table: str, snapshots: str, days: int = DEFAULT.retention_days, every_s: float = 3600.0):
        self.table, self.snapshots, self.days, self.every_ms = table, snapshots, days, int(every_s * 1000)
        self.last_ms: int | None = None

    def due(self, now_ms: int) -> bool:
        return self.last_ms is None or now_ms - self.last_ms >= self.every_ms

    def run_once(self, spark: SparkSession, now_ms: int) -> DataFrame:
        """The events that stay, as written."""
        at, before, self.last_ms = f"{self.snapshots}/as_of={now_ms}", self.last_ms, now_ms
        rows = spark.read.parquet(self.table)
        retention_keep(rows, now_ms, self.days).write.mode("overwrite").partitionBy("event_date").parquet(at)
        if before is not None and before != now_ms:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.snapshots}/as_of={before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return spark.read.schema(rows.schema).option("basePath", at).parquet(at)

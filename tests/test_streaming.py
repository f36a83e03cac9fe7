"""Tailing a log: appends, partial lines, rotation, restart, bad rows."""

from __future__ import annotations

import json
import os
import threading

import pytest

from tracegrove.streaming import ingest, tail, writer


def line(k, **more):
    return json.dumps({"timestamp": f"2024-01-01T00:0{k}:00.123", "trace_id": f"t{k}", "event": "tool_call", "tool": "search", "duration_ms": 1.5 * k, "status": "ok", "slow": k > 2, **more}) + "\n"


def test_parse(spark):
    rows = [line(1), line(3, event="pipeline_stage", stage="rerank"), "not json", json.dumps({"event": "x"}), json.dumps({"timestamp": "2024-01-01T02:00:00+02:00", "duration_ms": "bad"}), line(2, timestamp="nonsense")]
    lines = spark.createDataFrame([(r.strip(),) for r in rows], "value string")
    got = {r["ts_ms"]: r for r in ingest.parse_lines(lines).collect()}
    assert sorted(got) == [1704067200000, 1704067260123, 1704067380123]
    assert got[1704067260123]["tool"] == "search" and got[1704067260123]["slow"] == 0
    assert got[1704067380123]["stage"] == "rerank" and got[1704067380123]["tool"] is None and got[1704067380123]["slow"] == 1
    bare = got[1704067200000]
    assert (bare["event"], bare["trace_id"], bare["duration_ms"], bare["status"]) == ("unknown", "", 0.0, "ok")
    assert ingest.rejected(lines).count() == 3


def test_reader_offsets(tmp_path):
    log = tmp_path / "a.log"
    r = tail.TailReader(str(log), 3)
    assert r.read(r.initialOffset())[1] == r.initialOffset()
    log.write_text("one\ntwo\npart")
    rows, at = r.read(r.initialOffset())
    assert [x[0] for x in rows] == ["one", "two"] and at["pos"] == 8
    with log.open("a") as f:
        f.write("ial x\n")
    os.rename(log, tmp_path / "a.log.1")
    log.write_text("new\n")
    rows, at = r.read(at)
    assert [x[0] for x in rows] == ["partial x", "new"] and at["pos"] == 4
    os.rename(tmp_path / "a.log.1", tmp_path / "a.log.2")
    os.rename(log, tmp_path / "a.log.1")
    log.write_text("")
    with (tmp_path / "a.log.1").open("a") as f:
        f.write("late\n")
    assert [x[0] for x in r.read(at)[0]] == ["late"]


def test_replay_reads_what_was_planned(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("a\nb\n")
    r = tail.TailReader(str(log), 3)
    rows, end = r.read(r.initialOffset())
    assert [x[0] for x in rows] == ["a", "b"]
    with log.open("a") as f:
        f.write("c\nd\n")
    again = tail.TailReader(str(log), 3)  # a restart between plan and commit
    assert [x[0] for x in again.readBetweenOffsets(r.initialOffset(), end)] == ["a", "b"]
    assert [x[0] for x in again.read(end)[0]] == ["c", "d"]
    os.rename(log, tmp_path / "a.log.1")
    log.write_text("e\n")
    rows, later = again.read(end)
    assert [x[0] for x in rows] == ["c", "d", "e"]
    os.rename(tmp_path / "a.log.1", tmp_path / "a.log.2")
    os.rename(log, tmp_path / "a.log.1")
    log.write_text("f\n")
    assert [x[0] for x in again.readBetweenOffsets(end, later)] == ["c", "d", "e"]
    assert [x[0] for x in again.read(later)[0]] == ["f"]
    os.remove(tmp_path / "a.log.2")
    with pytest.raises(FileNotFoundError):
        list(again.readBetweenOffsets(end, later))


def test_batches_are_bounded(tmp_path):
    log = tmp_path / "a.log"
    lines = [f"line {k} " + "x" * 200 for k in range(3000)] + ["y" * 200_000, "last"]
    (tmp_path / "a.log.1").write_text("\n".join(lines[:1000]) + "\n")
    log.write_text("\n".join(lines[1000:]) + "\n")
    r = tail.TailReader(str(log), 3, batch=100_000)
    at, got, batches = r.initialOffset(), [], 0
    while True:
        rows, to = r.read(at)
        rows = [x[0] for x in rows]
        if to == at:
            break
        assert rows == [x[0] for x in r.readBetweenOffsets(at, to)]
        got, at, batches = got + rows, to, batches + 1
    assert got == lines and batches >= 6


def test_times_without_a_zone_are_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = {"2024-01-01T00:00:00": 0, "2024-01-01T00:00:00Z": 0, "2024-01-01T02:00:00+02:00": 0, "2024-01-01T02:00:00.5+0200": 500, "2024-01-01 00:00:01": 1000, "2024-01-01": 0}
        rows = [json.dumps({"timestamp": t, "event": "", "trace_id": t}) for t in times]
        got = {r["trace_id"]: (r["ts_ms"] - 1704067200000, r["event"]) for r in ingest.parse_lines(spark.createDataFrame([(r,) for r in rows], "value string")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {t: (ms, "unknown") for t, ms in times.items()}


def test_drain_and_retention(spark, tmp_path):
    log, table = tmp_path / "audit.log", str(tmp_path / "events")
    log.write_text("".join(line(k) for k in range(1, 5)))
    q = ingest.start_ingest(spark, str(log), table, str(tmp_path / "check"))
    assert ingest.drain(q, 60.0) and not q.isActive
    assert spark.read.parquet(table).count() == 4
    keep = ingest.Retention(table, str(tmp_path / "kept"), days=30)
    now = 1704067260123 + 30 * 86_400_000 + 1  # the first event is beyond by a millisecond
    assert keep.due(now) and sorted(r["trace_id"] for r in keep.run_once(spark, now).collect()) == ["t2", "t3", "t4"]
    assert not keep.due(now + 1000) and keep.due(now + 3_600_000)
    assert keep.run_once(spark, now + 90 * 86_400_000).count() == 0 and len(list((tmp_path / "kept").iterdir())) == 1


def test_queued_log_sheds_load(tmp_path, capsys):
    class Slow(writer.RotatingLog):
        def write(self, record):
            gate.wait(10)
            super().write(record)

    gate = threading.Event()
    q = writer.QueuedLog(Slow(str(tmp_path / "q.log")), size=5)
    for k in range(20):
        q.write({"k": k})
    assert q.dropped in (14, 15) and not q.close(0.05)
    gate.set()
    assert q.close(5) or not q._thread.is_alive()
    assert len((tmp_path / "q.log").read_text().splitlines()) == 20 - q.dropped
    writer.RotatingLog(None).write({"a": 1})
    assert json.loads(capsys.readouterr().err) == {"a": 1}
    assert writer.result_count("search", "找到 12 个") == 12 and writer.result_count("get_file_content", "x") == 1 and writer.result_count("search", "") is None


def test_ingest_resumes_without_loss_or_doubles(spark, tmp_path):
    log, table, check = tmp_path / "audit.log", str(tmp_path / "events"), str(tmp_path / "check")
    log.write_text(line(1) + line(2) + "broken\n" + line(3)[:20])

    def run():
        q = ingest.start_ingest(spark, str(log), table, check)
        q.processAllAvailable()
        q.stop()
        return sorted(r["trace_id"] for r in spark.read.parquet(table).collect())

    assert run() == ["t1", "t2"]
    with log.open("a") as f:
        f.write(line(3)[20:] + line(4))
    assert run() == ["t1", "t2", "t3", "t4"]
    os.rename(log, str(log) + ".1")
    log.write_text(line(5))
    assert run() == ["t1", "t2", "t3", "t4", "t5"]


def test_summary_stream(spark, tmp_path):
    log = tmp_path / "s.log"
    log.write_text("".join(line(k) for k in range(1, 8)))
    events = ingest.parse_lines(ingest.tail(spark, str(log)))
    q = ingest.start_summary(events, "summary_out", str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    got = {r["window_ms"]: (r["name"], r["calls"]) for r in spark.table("summary_out").collect()}
    assert got == {1704067200000: ("search", 4), 1704067500000: ("search", 3)}

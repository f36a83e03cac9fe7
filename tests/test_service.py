"""The service layer, caches, dispatch, evaluation and the audit writer."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from tracegrove.plans import cache, dispatch, evaluate, service
from tracegrove.plans.search import Searcher
from tracegrove.streaming import ingest, writer


@pytest.fixture(scope="module")
def searcher(spark):
    files = [(1, "r1", "java", "main", "a.java", "Foo bar\nsecond"), (2, "r2", "java", "main", "b.java", "foo Foo")]
    return Searcher(spark.createDataFrame(files, "doc_id long, repo string, lang string, branch string, path string, content string"))


def test_search_service(searcher):
    s = service.SearchService(searcher)
    assert s.health()["backends"] == {"lexical": True}
    assert [r["path"] for r in s.search("Foo")] == ["b.java", "a.java"]
    for call in (s.search, s.search_symbol, s.search_file, s.search_regex):
        with pytest.raises(service.ApiError) as e:
            call()
        assert e.value.status == 400
    with pytest.raises(service.ApiError) as e:
        s.get_file_content("r1", "none")
    assert e.value.status == 404
    assert s.call_tool("get_file_content", {"repo": "r1", "filepath": "a.java", "start_line": 2}) == "L2: second"
    assert s.call_tool("list_repos", {}) == "r1\nr2"
    assert s.call_tool("nothing", {}).startswith("error") and s.call_tool("search_regex", {"pattern": "(?=x)"}).startswith("error")
    assert "r2/b.java" in s.call_tool("search", {"query": "Foo"})


def test_audit_service(spark):
    ev = [(k, 1000 * k, f"t{k % 2}", "tool_call", float(k), "ok" if k % 3 else "error", k % 2, "search") for k in range(1, 11)]
    table = spark.createDataFrame(ev, "id long, ts_ms long, trace_id string, event string, duration_ms double, status string, slow int, tool string").selectExpr("*", "CAST(NULL AS STRING) stage", "'api' interface", "'{}' payload_json")
    a = service.AuditService(table)
    got = a.stats(10_000)
    assert (got["n"], got["errors"], got["p50"], len(got["buckets"])) == (10, 3, 5.0, 1)
    assert a.stats(10**12)["p95"] == 0.0
    page = a.events(limit=2, status="error")
    assert page["total"] == 3 and [e["id"] for e in page["events"]] == [9, 6]
    assert len(a.trace("t1")["events"]) == 5 and len(a.search("{")) == 2 and a.health()["n"] == 10
    for bad in (lambda: a.trace("none"), lambda: a.stats(0, "2h")):
        with pytest.raises(service.ApiError):
            bad()


def test_index_service(spark):
    s = service.IndexService(spark.createDataFrame([(1, "a")], "id long, repo_path string"), spark.createDataFrame([], "id long, repo_id long, backend string, started_at long, status string"), token="x", now_ms=5)
    job = s.start("b", "dense")
    with pytest.raises(service.ApiError) as e:
        s.start("b", "dense")
    assert e.value.status == 409 and e.value.detail == {"existing_job_id": job}
    with pytest.raises(service.ApiError):
        s.finish(job, 0)
    s.finish(job, 0, "x")
    assert [(r["repo_path"], r["status"]) for r in s.list_repos()] == [("b", "success"), ("a", None)]
    s.delete(2)
    assert {r["id"]: r["archived_at"] for r in s.repos.collect()} == {1: None, 2: 5}


def test_cache():
    now = [0.0]
    c = cache.RewriteCache(ttl_s=10, size=2, clock=lambda: now[0])
    c.put("  Foo ", ["a"])
    assert c.get("foo") == ["a"]
    c.put("b", [])
    c.get("foo")
    c.put("c", ["z"])
    assert c.get("foo") is None and len(c) == 2  # reads don't refresh
    now[0] = 11
    assert c.get("c") is None


def test_dispatch(spark):
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    lanes = {"good": lambda: spark.range(3), "bad": lambda: 1 / 0, "late": lambda: spark.range(1).select(slow("id").alias("id"))}
    got = {a.lane: a for a in dispatch.dispatch(spark, lanes, {"good": 30, "bad": 30, "late": 1.5})}
    assert (got["good"].status, len(got["good"].rows)) == ("ok", 3)
    assert got["bad"].status == "error" and "zero" in got["bad"].detail
    assert got["late"].status == "timeout"


def test_evaluation(spark, searcher):
    items = [("1", "Foo", ["b.java"]), ("2", "second", ["zzz"])]
    got = evaluate.evaluate(spark, {"lexical": searcher.exact, "none": lambda q: searcher.exact("nothing at all")}, items).collect()
    assert {r["config"]: (r["recall"], r["mrr"]) for r in got} == {"lexical": (0.5, 0.5), "none": (0.0, 0.0)}
    diff = evaluate.compare(searcher.exact, lambda q: searcher.exact("second"), ["Foo"]).collect()
    assert [(r["title"], r["only_in"]) for r in diff] == [("r2/b.java", "a")]


def test_writer(spark, tmp_path):
    log = writer.RotatingLog(str(tmp_path / "a.log"), size=400, keep=2)
    for k in range(4):
        log.write(writer.event("tool_call", f"t{k}", 3000.04 + k, tool="x", arguments={"q": "é" * 3}))
    with pytest.raises(ValueError, match="no"), log.measured("pipeline_stage", "e", stage="s"):
        raise ValueError("no")
    files = sorted(p.name for p in tmp_path.iterdir())
    assert files == ["a.log", "a.log.1", "a.log.2"]
    last = json.loads((tmp_path / "a.log").read_text().splitlines()[-1])
    assert (last["status"], last["stage"], last["error_message"]) == ("error", "s", "no")
    big = writer.event("tool_call", "t", 1.0, arguments="é" * 600)
    assert big["arguments_truncated"] and big["arguments"] == "é" * 600 + "..." and not big["slow"]
    assert ingest.parse_lines(spark.read.text(str(tmp_path))).count() >= 3

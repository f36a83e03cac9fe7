"""Job brackets, batches, retries, adapters, graph builds and small functions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracegrove import config
from tracegrove.functions import text as X
from tracegrove.operators import dense, fusion, graph, jobs
from tracegrove.plans import lanes
from tracegrove.plans import lifecycle as L
from tracegrove.plans.service import ApiError, IndexService


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def service(spark):
    repos = spark.createDataFrame([(1, "a/b")], "id long, repo_path string")
    none = spark.createDataFrame([], "id long, repo_id long, backend string, started_at long, status string, exit_code long, finished_at long")
    return IndexService(repos, none, token="t", now_ms=5)


def test_bracket_reports_how_a_build_ended(spark, tmp_path):
    s, fallback = service(spark), str(tmp_path / "left")
    with L.bracket(s, "a/b", "graph", fallback, "t", sleep=lambda _: None) as first:
        pass
    with pytest.raises(ValueError), L.bracket(s, "c/d", "graph", fallback, "t", sleep=lambda _: None) as second:
        raise ValueError
    assert {r["id"]: (r["status"], r["exit_code"]) for r in s.jobs.collect()} == {first: ("success", 0), second: ("fail", 1)}
    with L.bracket(s, "a/b", "dense", fallback, "wrong", sleep=lambda _: None) as third:  # the report is refused
        pass
    assert json.loads((tmp_path / "left" / f"job_{third}.json").read_text())["exit_code"] == 0


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert L.with_retry(flaky, sleep=waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        L.with_retry(lambda: (_ for _ in ()).throw(OSError()), sleep=waits.append)
    refused = []
    with pytest.raises(ApiError):
        L.with_retry(lambda: refused.append(1) or (_ for _ in ()).throw(ApiError(409, "no")), sleep=waits.append)
    assert len(refused) == 1


def test_batch_goes_on_after_a_failure():
    got = L.run_batch(["a", "b", "c", "d"], lambda r: 1 // (r != "b"), skip=lambda r: r == "d")
    assert (got.succeeded, list(got.failed), got.skipped) == (["a", "c"], ["b"], ["d"])


def test_repositories_without_a_prefix(tmp_path):
    for f in ("frameworks/base/A.java", "frameworks/empty/notes.txt", "packages/apps/Mail/x/y/z/B.kt", "packages/apps/Deep/1/2/3/4/5/C.py", "other/D.py"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    assert L.discover_repos(str(tmp_path)) == ["frameworks/base", "packages/apps/Mail"]


def test_graph_backend_and_shards(spark, tmp_path):
    table = str(tmp_path / "nodes")
    b = L.graph_backend(spark, table, lambda repo: spark.range(3).selectExpr("id AS nid", f"'{repo}' AS name"))
    s = service(spark)
    b.trigger(s, "frameworks/base", str(tmp_path / "left"), "t", sleep=lambda _: None)
    b.build("packages/x")
    assert b.count("frameworks/base") == 3 and b.count("missing") == 0
    assert b.drop("frameworks/base") == ["repo=frameworks_base"] and b.count("frameworks/base") == 0 and b.count("packages/x") == 3
    L.write_baseline(str(tmp_path / "base.json"), {"b": 2.0, "a": 1.0})
    assert json.loads((tmp_path / "base.json").read_text()) == {"a": 1.0, "b": 2.0}


def test_tokens():
    assert L.authorised(None, "") and L.authorised("Bearer x", "x") and L.authorised("bearer x", "x")
    assert not L.authorised(None, "x") and not L.authorised("Bearer y", "x") and not L.authorised("Basic x", "x")


def test_job_states(spark):
    rows = [(1, 7, "graph", 10, "pending"), (2, 7, "graph", 20, "success"), (3, 8, "dense", 30, "running"), (4, 8, "dense", 40, "pending")]
    table = spark.createDataFrame(rows, "id long, repo_id long, backend string, started_at long, status string")
    state = lambda t: {r["id"]: (r["status"], r["started_at"]) for r in t.collect()}
    assert state(jobs.start_job(table, 1, 99))[1] == ("running", 99) and state(jobs.start_job(table, 2, 99))[2] == ("success", 20)
    with pytest.raises(RuntimeError):
        jobs.start_job(table, 4, 99)
    assert state(jobs.create_job(table, 8, "dense", 50, status="pending"))[5] == ("pending", 50)
    assert jobs.checked(table).count() == 4
    with pytest.raises(Exception, match="no such backend or status"):
        jobs.checked(table.union(spark.createDataFrame([(9, 9, "x", 9, "running")], table.schema))).collect()
    ended = table.withColumn("finished_at", F.when(F.col("status") == "success", F.lit(21)))
    repos = spark.createDataFrame([(7, "a"), (8, "b"), (9, "c")], "id long, repo_path string")
    assert [tuple(r) for r in jobs.by_last_finish(repos, ended).collect()] == [(7, "a", 21), (8, "b", 0), (9, "c", 0)]
    assert [r["id"] for r in jobs.by_last_finish(repos, ended, descending=False).collect()] == [8, 9, 7]


def test_edges_by_kind(spark):
    nodes = spark.createDataFrame(
        [(1, "Class", "A", "a.java"), (2, "Class", "A", "b.java"), (3, "Method", "A", "a.java"), (4, "Method", "run", "a.java"), (5, "File", "a.java", "src/a.java")], "nid long, kind string, name string, path string"
    )
    rel = spark.createDataFrame([("MEMBER_OF", "run", "A", "p"), ("DEFINED_IN", "A", "src/a.java", "p"), ("CALLS", "run", "A", "p"), ("INHERITS", "A", "gone", "p")], "type string, src string, dst string, path string")
    got = {tuple(r) for r in graph.resolve_by_kind(rel, nodes).collect()}
    assert got == {(4, 1, "MEMBER_OF"), (4, 2, "MEMBER_OF"), (1, 5, "DEFINED_IN"), (2, 5, "DEFINED_IN"), (3, 5, "DEFINED_IN"), (4, 3, "CALLS")}
    assert graph.build_report(10, 2, nodes, rel) == {"files": 10, "parse_failures": 2, "failure_rate": 0.2, "nodes": 5, "edges": 4}
    with pytest.raises(RuntimeError):
        graph.build_report(10, 3, nodes, rel)


def test_concepts_of_the_most_commented_files_first(spark):
    comment = "/* a comment of more than twenty characters */"
    files = spark.createDataFrame([("low", comment + "x" * 500), ("high", comment), ("none", "int x;"), ("many", comment * 25)], "path string, content string")
    asked = []

    def extract(text):
        asked.append(text)
        if len(asked) == 1:
            raise OSError
        return [{"name": f"e{len(asked)}"}, {"name": ""}, "junk"]

    got = graph.concept_entities(files, extract)
    assert [len(t.split("\n---\n")) for t in asked] == [1, 10, 10, 5, 1]  # high, many, low
    assert [(e["name"], e["source_path"]) for e in got] == [("e2", "many"), ("e3", "many"), ("e4", "many"), ("e5", "low")]
    asked.clear()
    assert len(graph.concept_entities(files, extract, most=2)) == 2 and len(asked) == 3


def test_graph_lane_repositories_and_adapter(spark, tmp_path):
    rows = [(1, "fw/base", "a.java", "class WindowManager {\n  void show() {\n  }\n}\n"), (2, "pkg/mail", "b.java", "class WindowManager {\n  void hide() {\n  }\n}\n")]
    files = spark.createDataFrame(rows, "doc_id long, repo string, path string, content string")
    lanes.build_graph(files, f"{tmp_path}/graph")
    repos = lambda which: {r["repo"] for r in lanes.graph_lane(spark, f"{tmp_path}/graph", which)("WindowManager", 10).collect()}
    assert repos(None) == {"fw/base", "pkg/mail"} and repos(["fw/base"]) == {"fw/base"} and repos("mail") == {"pkg/mail"} and repos(["mail"]) == set()
    adapter = L.GraphAdapter(files, f"{tmp_path}/graph")
    found = adapter.search("WindowManager", 10).collect()
    assert {r["metadata"]["repo"] for r in found} == {"fw/base", "pkg/mail"} and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    assert adapter.content("fw/base", "a.java")["content"].startswith("class") and adapter.health()
    with pytest.raises(ApiError):
        adapter.content("fw/base", "none")
    assert not L.NoBackend().health()
    with pytest.raises(NotImplementedError):
        L.NoBackend().search("x")


def test_small_functions(spark):
    assert value(spark, X.result_title(F.lit("r"), F.lit("p"), F.lit(3), F.lit(9))) == "r/p:3-9"
    assert value(spark, X.result_title(F.lit(""), F.lit("p"), F.lit(None).cast("int"), F.lit(9))) == "p"
    assert value(spark, X.safe_name(F.lit("a/b/c"))) == "a_b_c"
    assert [value(spark, X.token_count(F.lit(t))) for t in (" a  b\n\tc ", "", " ", "x")] == [3, 0, 0, 1]
    html = "&lt;a&gt; &amp;lt; &#65;&#x42;&#x1F600; &eacute;&nbsp;&copy; &#38;amp; & &unknown;"
    assert value(spark, X.unescape(F.lit(html))) == "<a> &lt; AB\U0001f600 é\u00a0© &amp; & &unknown;"
    assert config.from_env({"TRACEGROVE_TOP_K": "7", "TRACEGROVE_SLOW_MS": "1.5", "OTHER": "x"}) == config.replace(config.DEFAULT, top_k=7, slow_ms=1.5)
    with pytest.raises(ValueError):
        config.from_env({"TRACEGROVE_TOP_K": "many"})


def test_embedding_waits_and_order(spark):
    assert dense.by_index([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]).tolist() == [[1.0], [2.0]]
    chunks = spark.createDataFrame([(f"text {k}" if k != 3 else "bad",) for k in range(70)], "content string").coalesce(1)

    def call(texts):
        if (texts == "bad").any():
            raise OSError
        return dense.hash_embedder()(texts)

    got = dense.embed(chunks, call, batch=10, back_off_s=0.0).collect()
    assert [r["content"] for r in got] == [r["content"] for r in chunks.collect()]
    assert [r["vector"] is None for r in got] == [k < 10 for k in range(70)]


def test_lane_totals(spark):
    rows = [(0, 0, "r", "a", "r/a"), (0, 1, "r", "b", "r/b"), (2, 0, "r", "a", "r/a")]
    got = fusion.lane_totals(spark.createDataFrame(rows, "lane_idx int, rank int, repo string, path string, title string"), 4).first()
    assert tuple(got) == (2, 2, 1)

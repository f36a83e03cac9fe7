"""Golden values of single operators on small literal inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracegrove.functions import text as X
from tracegrove.operators import dense, evalm, events, fusion, graph, jobs, lexical, stats
from tracegrove.plans.search import Searcher, entities, evaluated, render
from tracegrove.sources import tables as S


def value(spark, column):
    return evaluated(spark, column)


@pytest.mark.parametrize(
    ("query", "kind"),
    [
        ("sym:Foo", "exact"), ("file:a/b.java", "exact"), ('r"ab.*"', "exact"), ("SystemServer", "exact"), ("show", "natural_language"), ("how does it start", "natural_language"), ("启动流程", "natural_language"),
        ("ro.build.tags有引用", "natural_language"), ("  Binder  ", "exact"), ("a b", "exact"), ("several words without any", "natural_language"), ("android.os.Binder", "exact"), ("branch:main x", "exact"),
    ],
)
def test_classify(spark, query, kind):
    assert value(spark, X.classify_query(F.lit(query))) == kind


def test_fallback_rewrite(spark):
    got = value(spark, X.fallback_rewrite(F.lit("check.example.com captive portal")))
    assert got == ["check.example.com", "captive", "portal", "check.example.com captive portal", "check.example.com captive"]
    assert value(spark, X.fallback_rewrite(F.lit("怎么"))) == ["怎么"]
    assert entities(spark, "ActivityManager calls get_window now") == ["activitymanager", "get_window", "calls", "get", "window", "now"]


def test_scores(spark):
    assert value(spark, X.sigmoid_score(F.lit(25.5), F.lit(0), F.lit(2))) == 0.8249
    assert value(spark, X.sigmoid_score(F.lit(0.0), F.lit(1), F.lit(2))) == 0.75
    score = lambda q, title, content="", s=0.0, dense_=False: value(spark, X.rerank_score(X.rerank_tokens(F.lit(q)), F.lit(title), F.lit(content), F.lit(s), F.lit(dense_)))
    assert score("systemserver", "systemserver.java") == 0.2
    assert score("SystemServer", "systemserver.java") == 0.5
    assert score("aa bb cc dd ee ff", "", "aa bb cc dd ee ff") == 0.15
    assert score("zz", "x.hpp") == 0.03 and score("zz", "x.py") == 0.02 and score("zz", "frameworks/base system/core") == 0.03
    assert score("zz", "t", "c", 0.1, True) == 0.15


def test_text_functions(spark):
    lines = F.array(*map(F.lit, ["a", "b", "c"]))
    assert value(spark, X.numbered_lines(lines, F.lit(2), F.lit(0))) == "L2: b\nL3: c"
    assert value(spark, X.numbered_lines(lines, F.lit(0), F.lit(1))) == "L1: a"
    assert value(spark, X.numbered_lines(lines, F.lit(9), F.lit(None).cast("int"))) == ""
    html = '<pre><span class="noselect">1</span>int <b>x</b> &lt; 2 &amp;&amp; y;</pre>\n<pre></pre>'
    assert value(spark, X.html_lines(F.lit(html))) == ["int x < 2 && y;", ""]
    assert value(spark, X.json_in_markdown(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert value(spark, X.truncated(F.lit("é" * 600))) == "é" * 600 + "..."
    assert value(spark, X.cache_key(F.lit("  Ab "))) == value(spark, F.md5(F.lit("ab")))
    assert value(spark, X.parse_uri(F.lit("code://repo/a/b.java"))).asDict() == {"scheme": "code", "repo": "repo", "path": "a/b.java"}
    assert value(spark, X.infer_language(F.lit("a/b.hpp"))) == "cpp" and value(spark, X.infer_language(F.lit("b.txt"))) == "unknown"
    m = F.array(F.struct(F.lit(7).alias("line_num"), F.array(F.struct(F.lit(" a").alias("pre"), F.lit("b").alias("match"), F.lit("c ").alias("post"))).alias("fragments")))
    assert value(spark, X.snippet(m)) == "L7: abc"


def test_rrf(spark):
    rows = [(0, 0, "r", "p", "A", "first", None), (0, 1, "r", "q", "B", "b", None), (1, 0, "r", "q", "B", "other", "dense"), (1, 1, "r", "z", "C", "c", "dense"), (1, 2, "r", "z", "C", "again", "dense")]
    lanes = spark.createDataFrame(rows, "lane_idx int, rank int, repo string, path string, title string, content string, source string").withColumn("score", F.lit(0.0))
    got = {r["title"]: r for r in fusion.rrf_merge(lanes).collect()}
    assert got["A"]["score"] == round(1 / 61, 4)
    assert got["B"]["score"] == round(1 / 62 + 1 / 61, 4) and got["B"]["content"] == "b" and got["B"]["source"] is None
    assert got["C"]["score"] == round(1 / 62 + 1 / 63, 4)  # doubles within a lane count twice
    order = [r["title"] for r in fusion.feature_rerank("nothing", fusion.rrf_merge(lanes), 10).collect()]
    assert order == ["C", "B", "A"]


def test_query_language(spark):
    q = lexical.parse('case:yes r:base lang:java file:x.java content:/a b/ "two words" term')
    assert (q.case, q.repo, q.lang, q.file, q.pattern, q.terms) == ("yes", "base", "java", "x.java", "a b", ("two words", "term"))
    assert lexical.compose("q", repos="a", lang="b", branch="c", case="no") == "case:no branch:c lang:b r:a q"
    with pytest.raises(ValueError, match="look-around"):
        lexical.check_pattern("a(?=b)")
    files = spark.createDataFrame([(1, "r1", "java", "main", "a.java", "Foo bar"), (2, "r2", "java", "main", "b.java", "foo Foo"), (3, "r1", "py", "dev", "c.py", "food")], "doc_id long, repo string, lang string, branch string, path string, content string")
    ids = lambda text: [r["doc_id"] for r in lexical.search(files, text).orderBy("rank").collect()]
    assert ids("foo") == [2, 1, 3] and ids("Foo") == [2, 1] and ids("case:no Foo") == [2, 1, 3] and ids("r:r1 foo") == [1, 3]
    assert ids("branch:dev foo") == [3] and ids("content:/^Foo/") == [1] and ids("foo nothing") == []
    s = Searcher(files)
    assert [r["path"] for r in s.symbol("food").collect()] == ["c.py"]
    assert [r["path"] for r in s.symbol("oo b").collect()] == ["a.java"]  # no such symbol, but the term
    assert [r["path"] for r in s.file("b.java", "foo").collect()] == ["b.java"]
    assert s.content("r1", "a.java").first()["content"] == "L1: Foo bar" and s.content("r1", "none").count() == 0
    assert [s.content("r1", "a.java", *x).first()["end_line"] for x in ((), (1, 1), (1, 9), (5, 0), (0, 1))] == [1, 1, 1, 4, 1]
    assert [r["repo"] for r in s.repos("r").collect()] == ["r1", "r2"]
    assert [(r["rank"], r["title"], r["content"]) for r in s.exact("type:repo r:r[12]").collect()] == [(0, "r1", None), (1, "r2", None)]
    assert "Foo bar" in render(s.search("foo")).first()["text"]
    assert s.regex("fo+d").count() == 1
    hit = Searcher(spark.createDataFrame([(1, "r", "java", "main", "a.java", "\n  x\n Foo one\n\nfoo two\n"), (2, "r", "java", "main", "b.java", "none")], files.schema)).hits
    row = hit("foo").first()
    assert (row["title"], row["snippet"], row["start_line"], row["end_line"]) == ("r/a.java", "L3: Foo one\nL5: foo two", 1, 23)
    assert hit("content:/o{2} t/").first()["snippet"] == "L5: foo two" and hit("Foo").first()["snippet"] == "L3: Foo one"
    odd = hit("file:b").first()
    assert odd["snippet"] == "(no content preview available)" and odd["start_line"] is None
    broken = Searcher(files, lanes={"dense": lambda q, n: 1 / 0}, rewriter=lambda q: 1 / 0, concepts={"boot": ["foo"]})
    assert broken.rewrite("how to boot") == ["foo"]
    assert broken.search("how does boot work", threshold=0.0).count() == 3


def test_percentiles(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0)], "v double").withColumn("g", F.lit(1))
    got = stats.at_indexes(df, ["g"], "v", {"near": (stats.nearest_index, 0.5), "floor": (stats.floor_index, 50), "top": (stats.floor_index, 99)}).first()
    assert (got["near"], got["floor"], got["top"]) == (3.0, 3.0, 4.0)
    many = spark.range(10_000).select((F.col("id") * 7 % 10_000).cast("double").alias("v"))
    assert stats.exact_quantiles(many, "v", {"p50": 5000, "p99": 9900, "lo": 0}, 10_000) == {"p50": 5000.0, "p99": 9900.0, "lo": 0.0}
    empty = stats.totals(S_events(spark).limit(0), 60).first()
    assert (empty["n"], empty["mean_ms"], empty["error_rate"]) == (0, 0.0, 0.0)


def S_events(spark):  # noqa: N802
    rows = [(1, 1000, "t1", "tool_call", 5.0, "ok", 0, "search"), (2, 2000, "t1", "pipeline_stage", 7.5, "error", 1, None), (3, 3000, "", "audit_summary", 0.0, "ok", 0, None)]
    return spark.createDataFrame(rows, "id long, ts_ms long, trace_id string, event string, duration_ms double, status string, slow int, tool string").selectExpr("*", "CAST(NULL AS STRING) AS stage", "'api' AS interface", "'{\"q\": \"50%_É\"}' AS payload_json")


def test_events(spark):
    ev = S_events(spark)
    assert [r["id"] for r in events.page(ev, 2).collect()] == [3, 2]
    assert [r["id"] for r in events.event_filter(ev, from_ms=1000, to_ms=2000).collect()] == [1]
    assert events.event_filter(ev, slow=True, status="error").count() == 1
    t = events.trace_summary(ev).collect()
    assert len(t) == 1 and (t[0]["started_ms"], t[0]["total_ms"], t[0]["n"], t[0]["failed"]) == (995.0, 1005, 2, True)
    assert events.payload_search(ev, "50%_").count() == 1 and events.payload_search(ev, "5_%").count() == 0 and events.payload_search(ev, "é").count() == 0
    day = 86_400_000
    old = spark.createDataFrame([(i, d * day) for i, d in enumerate((0, 0, 2, 31))], "id long, ts_ms long")
    assert sorted(r["id"] for r in events.retention_keep(old, 31 * day).collect()) == [2, 3]
    with pytest.raises(ValueError, match="limit"):
        events.page(ev, 0)


def test_jobs(spark):
    repos = spark.createDataFrame([(1, "a"), (2, "b")], "id long, repo_path string")
    js = spark.createDataFrame([(1, 1, "dense", 100, "success"), (2, 1, "graph", 100, "running"), (3, 1, "dense", 50, "fail")], "id long, repo_id long, backend string, started_at long, status string")
    last = {r["id"]: r["job_id"] for r in jobs.latest_job_per_repo(repos, js).collect()}
    assert last == {1: 2, 2: None}
    with pytest.raises(RuntimeError, match="2"):
        jobs.create_job(js, 1, "graph", 200)
    new = jobs.create_job(js, 2, "graph", 200)
    assert new.count() == 4
    done = jobs.finish_job(new, 4, 0, 300).where("id = 4").first()
    assert (done["status"], done["exit_code"], done["finished_at"]) == ("success", 0, 300)
    assert jobs.reap_stale(js, 100 + 3 * 3_600_000).where("status = 'warn'").count() == 1
    left = jobs.delete_jobs(js, 1, "dense")
    assert [r["id"] for r in left.collect()] == [2]
    assert {r["id"]: r["archived_at"] for r in jobs.archive_when_empty(repos, left, 9).collect()} == {1: None, 2: 9}
    up = {r["repo_path"]: r["id"] for r in jobs.upsert_repos(repos, spark.createDataFrame([("b",), ("d",), ("c",)], "repo_path string")).collect()}
    assert up == {"a": 1, "b": 2, "c": 3, "d": 4}
    meta = jobs.put_meta(jobs.put_meta(spark.createDataFrame([], "key string, value string"), "k", "1"), "k", "2")
    assert [tuple(r) for r in meta.collect()] == [("k", "2")]


def test_chunks_and_vectors(spark):
    content = "\n".join(f"line {k}" for k in range(75))
    files = spark.createDataFrame([("r", "a.java", content), ("r", "b.py", " \n"), ("r", "c.py", "one")], "repo string, path string, content string")
    got = sorted((r["path"], r["start_line"], r["end_line"]) for r in dense.chunk_windows(files).collect())
    assert got == [("a.java", 1, 30), ("a.java", 21, 50), ("a.java", 41, 70), ("a.java", 61, 75), ("c.py", 1, 1)]
    whole = dense.embed(dense.chunk_windows(files))
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-5 for r in whole.collect())

    def failing(texts):
        raise OSError("down")

    assert dense.storable(dense.embed(dense.chunk_windows(files), failing)).count() == 0
    assert dense.storable(whole.union(whole)).count() == 5


def test_graph(spark):
    java = "package a;\npublic class Foo extends Bar {\n  public void run(int x) {\n    helper(x);\n    obj.call();\n  }\n  private int helper(int y) {\n    return y;\n  }\n}\n"
    py = "class Cat(Animal):\n    def speak(self):\n        return noise()\n"
    files = spark.createDataFrame([("Foo.java", java), ("cat.py", py)], "path string, content string")
    symbols = {(r["kind"], r["name"], r["start_line"], r["end_line"]) for r in graph.extract_symbols(files).collect()}
    assert {("Class", "Foo", 2, 10), ("Method", "run", 3, 6), ("Method", "helper", 7, 9), ("Class", "Cat", 1, 3), ("Method", "speak", 2, 3)} <= symbols
    rel = {(r["type"], r["src"], r["dst"]) for r in graph.extract_relations(files).collect()}
    assert {("INHERITS", "Foo", "Bar"), ("MEMBER_OF", "run", "Foo"), ("CALLS", "run", "helper"), ("CALLS", "run", "call"), ("INHERITS", "Cat", "Animal"), ("MEMBER_OF", "speak", "Cat"), ("CALLS", "speak", "noise"), ("DEFINED_IN", "Foo", "Foo.java")} <= rel
    assert value(spark, graph.graph_score(F.lit(1), F.lit(2), F.lit(4))) == pytest.approx(0.8)
    edges = spark.createDataFrame([("s", "x", "t"), ("x", "file:1", "t"), ("s", "file:2", "t"), ("y", "file:2", "t")], "a string, b string, type string")
    paths = graph.expand(edges, spark.createDataFrame([("s",)], "nid string"))
    assert sorted(map(tuple, paths.collect())) == [("s", "file:1", 2), ("s", "file:2", 1), ("s", "x", 1), ("s", "y", 2)]
    reached = graph.expand_counts(edges, spark.createDataFrame([("s",)], "nid string"))
    assert sorted(map(tuple, reached.collect())) == [("s", "file:1", 2, 1), ("s", "file:2", 1, 1), ("s", "x", 1, 1), ("s", "y", 2, 1)]
    best = graph.rank_targets(reached, "file").orderBy("length").collect()
    assert [(r["node"], r["score"]) for r in best] == [("file:2", 1.0), ("file:1", 0.7)]


def test_counted_paths_equal_listed_paths(spark):
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", f"t{rng.randrange(3)}") for _ in range(60)]  # parallel edges of several types, and loops
    edges = spark.createDataFrame(sorted(set(rows)), "a string, b string, type string")
    start = spark.createDataFrame([(f"n{k}",) for k in (0, 3, 5)] + [("none",)], "nid string")
    for hops in (1, 2):
        listed = graph.expand(edges, start, hops).groupBy("seed", "node", "length").agg(F.count(F.lit(1)).alias("n"))
        assert sorted(map(tuple, graph.expand_counts(edges, start, hops).collect())) == sorted(map(tuple, listed.collect()))
    with pytest.raises(ValueError, match="3 edges"):
        graph.expand_counts(edges, start, 3)


def test_quality(spark):
    items = spark.createDataFrame([(1, ["a/b"]), (2, ["zz"]), (3, [""])], "qid int, expected array<string>")
    found = spark.createDataFrame([(1, 0, "x"), (1, 2, "r/a/b.java"), (2, 0, "q"), (3, 0, "")], "qid int, rank int, path string")
    got = {r["qid"]: (r["recall"], r["rr"]) for r in evalm.quality(found, items).collect()}
    assert got == {1: (1, round(1 / 3, 6)), 2: (0, 0.0), 3: (0, 0.0)}


def test_file_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/A.java").write_bytes(b"class A {}\xff\n")
    (tmp_path / "d/x.txt").write_text("no")
    rows = S.scan_source_files(spark, str(tmp_path)).collect()
    assert [(r["path"], r["content"].startswith("class A {}")) for r in rows] == [("d/A.java", True)]
    (tmp_path / "g/sub").mkdir(parents=True)
    for name in ("B.JAVA", "a.java", "sub/c.py", "sub/d.hpp", "e.kt", "f.c"):
        (tmp_path / "g" / name).write_text("x")
    seen = lambda *x: [(r["path"], r["language"], r["content"]) for r in S.scan_graph_files(spark, f"{tmp_path}/g", *x).orderBy("path").collect()]
    assert seen() == [("B.JAVA", "java", "x"), ("a.java", "java", "x"), ("sub/c.py", "python", "x"), ("sub/d.hpp", "cpp", "x")]
    assert [x[0] for x in seen(["java", "cpp"])] == ["B.JAVA", "a.java", "sub/d.hpp"] and [x[0] for x in seen(["java", "cpp"], 2)] == ["B.JAVA", "a.java"] and seen(["go"], 5) == []
    (tmp_path / "e.jsonl").write_text('{"_meta": "x"}\n\n{"id": "1", "query": "q", "expected_paths": ["a"], "category": "symbol"}\n')
    assert [r["id"] for r in S.read_eval_set(spark, str(tmp_path / "e.jsonl")).collect()] == ["1"]
    (tmp_path / "l.jsonl").write_text('{"stage": "dense", "duration_ms": 5}\nbroken\n{"stage": "dense", "duration_ms": "x"}\n{"stage": "other", "duration_ms": 1}\n')
    assert S.read_latencies(spark, str(tmp_path / "l.jsonl"), ("dense",)).count() == 1
    page = S.log_page(spark, str(tmp_path / "e.jsonl"), 2, 5).first()
    assert (page["content"], page["next_offset"], page["at_end"]) == ("_meta"[:5], 7, False)


def test_dense_and_graph_lanes(spark, sf_dir, tmp_path):
    from tracegrove.operators.chunkstore import ChunkStore
    from tracegrove.plans import retrieval_queries
    from tracegrove.plans.lanes import build_graph, dense_lane, graph_lane

    base = "class Engine {\n  public void ignite(int x) {\n    spark(x);\n  }\n}\n"
    sub = "class Diesel extends Engine {\n  public void hum(int x) {\n    ping(x);\n  }\n}\n"
    rows = [(1, "r", "java", "main", "Engine.java", base), (2, "r", "java", "main", "Diesel.java", sub), (3, "", "py", "main", "note.py", "how does ignition start and work"), (4, "r", "py", "main", "x.py", None)]
    files = spark.createDataFrame(rows, "doc_id long, repo string, lang string, branch string, path string, content string")
    question = "how does ignition start with engine"
    own = ChunkStore(spark, f"{tmp_path}/chunks", dense.hash_embedder())
    own.update(files)
    build_graph(files, f"{tmp_path}/graph")
    near_chunks, near_files = dense_lane(own), graph_lane(spark, f"{tmp_path}/graph")
    found = near_chunks(question, 2).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [0, 1]
    assert (found[0]["title"], found[0]["content"], found[0]["source"]) == ("note.py", rows[2][5], "dense")
    # the corpus isn't embedded by a query: its plan has the query's Arrow stages over stored rows, and no pandas one
    assert "MapInPandas" not in near_chunks(question, 2)._jdf.queryExecution().toString()
    near = {r["path"]: (r["rank"], r["title"], r["score"], r["source"]) for r in near_files(question, 5).collect()}
    # two paths to Engine.java, by the class and by its method; one of two edges to Diesel.java
    assert near == {"Engine.java": (0, "r/Engine.java", 1.0, "graph"), "Diesel.java": (1, "r/Diesel.java", 0.5, "graph")}
    assert near_files("nothing", 5).count() == 0
    s = Searcher(files, lanes={"dense": near_chunks, "graph": near_files}, rewriter=lambda q: ["ignite"])
    lanes = s.lane_plan(question)
    assert {(r["lane_idx"], r["source"]) for r in lanes.select("lane_idx", "source").collect()} == {(0, None), (1, "dense"), (2, "graph")}
    fused = {r["title"]: r for r in s.search(question).collect()}
    assert {"note.py", "r/Engine.java", "r/Diesel.java"} == set(fused) and fused["note.py"]["source"] == "dense"
    plain = {r["title"] for r in Searcher(files, rewriter=lambda q: ["ignite"]).search(question).collect()}
    assert plain == {"r/Engine.java"}
    assert {r["source"] for r in retrieval_queries.hybrid_lane_rows(spark, sf_dir).collect()} == {None, "dense", "graph"}


def test_a_lane_that_fails_is_an_error_of_the_queries(spark, sf_dir, monkeypatch):
    from tracegrove.plans import retrieval_queries

    broken = {"lanes": {"dense": lambda q, n: 1 / 0}, "rewriter": lambda q: 1 / 0}
    files = spark.createDataFrame([(1, "r1", "java", "main", "a.java", "how does boot work")], "doc_id long, repo string, lang string, branch string, path string, content string")
    with pytest.raises(ZeroDivisionError):
        Searcher(files, rewriter=broken["rewriter"], strict=True).search("how does boot work")
    lenient = Searcher(files, **broken)
    with pytest.warns(RuntimeWarning, match="search without dense"):
        assert lenient.search("how does boot work").count() == 1
    assert set(lenient.failed) == {"dense", "rewriter"} and "ZeroDivisionError" in lenient.failed["dense"]
    monkeypatch.setattr(retrieval_queries, "graph_lane", lambda *a: broken["lanes"]["dense"])
    for name in ("hybrid_lane_rows", "hybrid_search_lanes"):
        with pytest.raises(ZeroDivisionError):
            getattr(retrieval_queries, name)(spark, sf_dir)

from __future__ import annotations

import itertools
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracegrove.llm import _tables as B
from tracegrove.llm import line_dedup, substring_dedup
from tracegrove.llm._groups import in_blocks


@pytest.fixture
def few_buckets(spark):
    key = "spark.sql.sources.bucketing.maxBuckets"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")  # fewer than there are shuffle partitions
    yield
    spark.conf.set(key, before)


def test_buckets_keep_to_what_spark_allows(spark, few_buckets, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 100)
    line = "a line that stands in every document of this small test"
    docs = spark.createDataFrame([(k, f"{line}\nown words of number {k} " + "xyz" * k) for k in range(20)], "doc_id long, text string")
    assert B.bucket_count(spark, 10**15) == 3
    lines = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[0] == 0 and sum(lines.values()) >= 19 and len(lines) == 20
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_substrings(docs).collect()}
    assert removed[0] == 0 and all(removed[k] >= len(line) for k in range(1, 20))


def test_bucket_count_by_size(spark):
    assert B.bucket_count(spark, 0) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert B.bucket_count(spark, 1000, 10) == 100
    assert B.bucket_count(spark, 10**15) == int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))


def test_clear_removes_what_was_written(spark, tmp_path):
    B.clear(spark)
    df = spark.range(10).selectExpr("id AS doc_id", "concat('a line of twenty and more ', id % 3) AS text")
    with B.scratch(spark):
        kept = B.cut(df)
        at = kept.inputFiles()[0].removeprefix("file:").removeprefix("//")
        line_dedup.dedup_lines(df).write.parquet(str(tmp_path / "out"))
        tables = {t.name for t in spark.catalog.listTables() if t.name.startswith("tracegrove_")}
        assert Path(at).exists() and tables
    assert not Path(at).exists() and not tables & {t.name for t in spark.catalog.listTables()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    B.cut(df)
    assert B.clear(spark) == 1 and B.clear(spark) == 0


def test_unused_names():
    assert B.unused(["doc_id", "Words", "_words"], "words", "x", "x") == ["__words", "x", "_x"]


def test_groups_meet_in_blocks(spark):
    rows = [(k % 7 if k % 11 else 3, k) for k in range(300)] + [(None, 1), (100, 5)]
    df = spark.createDataFrame(rows, "g long, v long")
    cells = in_blocks(df, [F.col("g")], F.col("v"), 16).select("cell", "lo", "hi", "part", "g", "v").collect()
    met = Counter()
    for a, b in itertools.combinations(sorted(cells, key=lambda r: r["cell"]), 2):
        if a["cell"] == b["cell"] and (a["lo"] == a["hi"] or a["part"] != b["part"]):
            met[frozenset([(a["g"], a["v"]), (b["g"], b["v"])])] += 1
    assert met == Counter({frozenset([a, b]): 1 for a, b in itertools.combinations([r for r in rows if r[0] is not None], 2) if a[0] == b[0]})

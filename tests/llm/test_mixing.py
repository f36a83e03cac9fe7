from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tracegrove.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Water filling round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        rest = {s: w for s, w in weight.items() if s not in full}
        got = {s: left * w / sum(rest.values()) for s, w in rest.items()} if rest else {}
        over = [s for s, t in got.items() if t > 2 * sizes[s]]
        if not over:
            return full | got
        full |= {s: 2.0 * sizes[s] for s in over}


def check(rows, docs):
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(sizes), defaultdict(int)
    assert len(rows) == len(docs)
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((d, len(WORD.findall(t or ""))) for d, t, _ in docs)
    source = {d: s for d, _, s in docs}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], abs=1e-5)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    return {s: (taken[s], want[s]) for s in sizes}


def test_targets_are_met(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = M.op4_sainte_lague(spark, sf_dir).collect()
    for got, want in check(rows, docs).values():
        assert abs(got - want) <= 2 * M.BLOCK + 0.005 * want
    assert sorted(rows) == sorted(M.op4_sainte_lague(spark, sf_dir).collect())


def test_edges(spark):
    docs = [(1, "a b c " * 200, "x"), (2, None, "x"), (3, "", None), (4, "w " * 300, None), (5, "w " * 3000, "é"), (6, "tab\tsep\x0bvt", "z"), (6, "tab\tsep\x0bvt", "z"), (7, "", "empty")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS taken", "3 AS place")
    check(M.mix(df).collect(), docs)
    check(M.mix(df, block=1, shard=100).collect(), docs)
    assert M.mix(df.limit(0)).count() == 0
    assert all(r["taken"] == 0 and r["target"] == 0 for r in M.mix(df.where("size(split(coalesce(text, ''), ' ')) = 1 AND source = 'empty'")).collect())


def test_quotas_are_the_highest_quotients(spark):
    random.seed(3)
    rows, want = [], {}
    for g in range(60):
        seats = random.choice((0, 1, 7, 50, 120, 134, 150, 333, 5000))
        parties = [(k, random.choice((0, 1, 10, 1000, random.randint(0, 10**9))), random.choice((0, 1, 3, random.randint(0, 60)))) for k in range(random.choice((1, 2, 12, 40)))]
        rows += [(g, k, w, m, seats) for k, w, m in parties]
        q = sorted(((-w / (2 * i + 1), k) for k, w, m in parties for i in range(m) if w > 0))[:seats]
        won = Counter(k for _, k in q)
        want |= {(g, k): won[k] for k, _, _ in parties}
    df = spark.createDataFrame(rows, "g int, k int, w long, most long, seats long")
    assert {(r["g"], r["k"]): r["quota"] for r in M.apportion(df, ["g"], "w", "seats", "most", "k").collect()} == want


def test_several_shards_equal_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in M.mix(docs, shard=700).select("doc_id", "size", "source_size", "target", "taken").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.sql(M.sql(700)).fetchall())
    sizes = Counter()
    for r in got:
        sizes[r[2]] += 1
    assert max(s / 700 for s in sizes) > 3  # several shards a source
    other = sorted(tuple(r) for r in M.mix(docs, shard=700, seed="other").select("doc_id", "size", "source_size", "target", "taken").collect())
    assert other != got and [r[:4] for r in other] == [r[:4] for r in got]


def test_long_text(spark):
    docs = [(1, "w " * 200_000, "x"), (2, "v " * 10, "x"), (3, "u " * 1000, "y")]
    check(M.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS shard", "2 AS key", "3 AS quota", "4 AS blocks")).collect(), docs)

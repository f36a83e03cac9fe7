"""Many searches at once: what is dealt out grows with the queries and the texts, not with their product."""

from __future__ import annotations

import random

import pytest

from tracegrove.operators import cells, lexical, streams, textindex
from tracegrove.plans import many

SCHEMA = "doc_id long, repo string, lang string, branch string, path string, content string"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "Sa") for b in ("ban", "dor", "fel", "gu", "nix")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    random.seed(7)
    at = str(tmp_path_factory.mktemp("many")) + "/texts"
    rows = [(k, f"repo{k % 3}", "en", "main", f"p/{k}.java", " ".join(random.choices(WORDS, k=random.randint(2, 30)))) for k in range(600)]
    rows += [(700, "r", "en", "main", "e/1", None), (701, "r", "en", "main", "e/2", "")]
    old, textindex.SHARD_TEXTS = textindex.SHARD_TEXTS, 32
    textindex.build(spark.createDataFrame(rows, SCHEMA).coalesce(2), at)
    textindex.SHARD_TEXTS = old
    return textindex.TextIndex(spark, at)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    random.seed(8)
    at = str(tmp_path_factory.mktemp("many")) + "/cells"
    rows = [(k, "r", [random.gauss(0, 1) for _ in range(8)]) for k in range(602)]
    cells.build(spark.createDataFrame(rows, "id long, repo string, vector array<float>"), at)
    return cells.VectorCells(spark, at)


@pytest.fixture(scope="module")
def queries(spark):
    random.seed(9)
    rows = [(k, " ".join(random.choices(WORDS, k=6)), [random.gauss(0, 1) for _ in range(8)], [".java"]) for k in range(50)]
    return spark.createDataFrame(rows, "qid long, text string, q array<double>, expected array<string>")


@pytest.fixture
def dealt(monkeypatch):
    """Rows that each product's shuffles wrote."""
    out, own = [], streams.kept

    def kept(df):
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().executedPlan().plan().collectLeaves()  # of the adaptive plan, once it has run
        stages = [leaves.apply(k) for k in range(leaves.size())]
        out.append(sum(s.shuffle().metrics().apply("shuffleRecordsWritten").value() for s in stages if s.getClass().getSimpleName() == "ShuffleQueryStageExec"))
        return own(df)

    monkeypatch.setattr(streams, "kept", kept)
    return out


def test_ranked_searches_deal_a_query_out_once_for_any_number_of_blocks(index, queries, dealt, monkeypatch):
    found = {}
    for most in (4_000_000, 500):
        monkeypatch.setattr(many, "POSTINGS", most)
        found[most] = sorted(map(tuple, many.ranked_many(index, queries, 5).collect()))
    assert dealt == [50, 50]
    assert len({b for _, b in many._blocks(index)}) > 10 and found[500] == found[4_000_000]
    for qid, text in queries.select("qid", "text").limit(5).collect():
        want = [tuple(r) for r in lexical.bm25(index.files, sorted(set(text.lower().split())), top_k=5).where("score > 0").collect()]
        assert [r[1:3] for r in sorted((r for r in found[500] if r[0] == qid), key=lambda r: r[3])] == want


def test_blocks_whose_texts_reach_no_query_and_dense_terms(index, queries, monkeypatch):
    want = sorted(map(tuple, many.ranked_many(index, queries, 3).collect()))
    monkeypatch.setattr(many, "POSTINGS", 700)
    for dense in (0, 1, 3):
        monkeypatch.setattr(many, "DENSE", dense)
        assert sorted(map(tuple, many.ranked_many(index, queries, 3).collect())) == want


def test_neighbours_deal_a_query_out_once_for_any_number_of_blocks(vectors, queries, dealt, monkeypatch):
    want = sorted(map(tuple, vectors.nearest(queries, 4).best.collect()))
    monkeypatch.setattr(cells, "BLOCK", 16)
    assert sorted(map(tuple, vectors.nearest(queries, 4).best.collect())) == want and dealt == [50] * 4


def test_rows_of_one_query_have_their_neighbours_together(spark, vectors):
    a, b = [1.0] * 8, [-1.0] * 8
    one = {q: vectors.nearest(spark.createDataFrame([(q, v)], "qid string, q array<double>"), 3).best.collect() for q, v in (("a", a), ("b", b))}
    both = vectors.nearest(spark.createDataFrame([("x", a), ("x", b), ("x", a), (None, b)], "qid string, q array<double>"), 3).best
    want = sorted(((r["score"], r["id"]) for r in one["a"] * 2 + one["b"]), key=lambda r: (-r[0], r[1]))[:3]
    got = {q: [(r["score"], r["id"]) for r in both.orderBy("rank").collect() if r["qid"] == q] for q in ("x", None)}
    assert got == {"x": want, None: [(r["score"], r["id"]) for r in one["b"]]}


def test_contents_are_compared_once_for_both_configurations(spark, index, vectors, queries):
    df = many.evaluate_many(index, queries, vectors)
    assert f"{index.path}/texts" not in df._jdf.queryExecution().toString()
    rows = {r["config"]: r for r in df.collect()}
    assert set(rows) == {"lexical", "dense"} and rows["dense"]["n"] == rows["lexical"]["n"] == 50 and rows["lexical"]["recall"] == 1.0


def test_trigrams_wait_for_a_search_that_needs_them(spark, index, queries):
    from tracegrove.sources import store

    many.ranked_many(index, queries, 2).collect()
    assert not store.exists(spark, f"{index.path}/grams")
    assert lexical.search(index, "kaban").count() > 0 and store.exists(spark, f"{index.path}/grams")

from __future__ import annotations

import corpus_pipeline as P
from tracegrove.llm import decontaminate, ngram_join
from tracegrove.llm._tables import cut


def test_stages_follow_one_another(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = cut(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        rows[name] = (before, docs)
    toxic = rows["toxicity"]
    assert 0 < toxic[0].count() - toxic[1].count() < 0.2 * toxic[0].count()
    lines = rows["line dedup"]
    assert lines[1].where("n_chars <> length(text)").count() == 0
    near = rows["n-gram jaccard join"][1]
    assert ngram_join.jaccard_links(near.select("doc_id", "text")).where("class_id <> doc_id").count() == 0
    left = rows["benchmark decontamination"][1]
    assert decontaminate.verdicts(left.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").count() == 0
    mixed = P.STAGES[-1][1](spark, docs, sf_dir)
    assert mixed.count() == docs.count() and mixed.where("taken > 2 * size").count() == 0


def test_run_agrees_with_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    assert sorted(P.STAGES[-1][1](spark, docs, sf_dir).collect()) == sorted(P.run(spark, sf_dir).collect())


def test_empty_and_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "fine words of some length here", "en", "s", 30)], "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        out = part
        for _, stage in P.STAGES[:-1]:
            out = cut(stage(spark, out, sf_dir))
        assert out.count() == part.count()


def test_clashing_columns_and_repeated_rows(spark, sf_dir):
    names = ["score", "n_lines", "N_Removed", "id", "hashes", "good", "_id", "t", "_t", "n_words", "n_hit", "hits", "items", "contaminated", "key", "shard"]
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", *(f"concat('{n} ', doc_id) AS `{n}`" for n in names))
    docs = own.unionByName(own.where("doc_id < 20"))
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = cut(stage(spark, out, sf_dir))
        assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) > 50 and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names)
    assert P.STAGES[-1][1](spark, out, sf_dir).count() == len(rows)


def test_long_text_goes_through(spark, sf_dir):
    long = " ".join(f"word{k} of a long document" for k in range(40_000))
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, "a short one", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = cut(stage(spark, out, sf_dir))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: long, 3: "a short one"}

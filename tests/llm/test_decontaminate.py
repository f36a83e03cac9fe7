from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from tracegrove.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, which = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    which |= found
        ids = ",".join(sorted(map(str, which)))
        out[doc] = (len(w), len(hit), len(which), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert any(x[4] for x in want.values())
    assert result(D.op7_winnowing(spark, sf_dir)) == want


def test_edges_and_passes(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = [(1, "a " + long + " b"), (2, None), (3, ""), (4, "Short Item!"), (5, "x short, item"), (6, " ".join(f"w{i}" for i in range(12))), (7, "é " * 50), (8, long.upper()), (8, long.upper()), (9, "p q " * 20)]
    items = [(10, long), (11, "short item"), (12, None), (13, ""), (14, "p q " * 10), (15, " ".join(f"w{i}" for i in range(5, 20)))]
    df = spark.createDataFrame([(d, t, "keep", 1) for d, t in docs], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert result(D.verdicts(df.drop("items", "n_words"), bench)) == want
    assert D.verdicts(df, bench).count() == len(docs)  # clashing names are replaced, repeated rows stay
    many = D.contamination(df.select("doc_id", "text"), bench, block_bytes=20)
    whole = D.contamination(df.select("doc_id", "text"), bench)
    key = lambda x: sorted(map(str, x.select("doc_id", "hits", F.array_sort("items").alias("items")).collect()))
    assert key(many) == key(whole)
    none = D.verdicts(df.select("doc_id", "text"), bench.limit(0))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(docs)
    assert D.verdicts(df.select("doc_id", "text").limit(0), bench).count() == 0
    assert D.clean(df, bench).columns == df.columns


def test_items_without_an_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "vw")
    docs = spark.createDataFrame([(1, one), (2, two + " " + one), (3, "short item"), (4, "clean words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, one), (7, two), (None, "short item"), (None, None)], "item_id long, text string")
    for limit in (D.BLOCK_BYTES, 20):
        got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in D.contamination(docs, bench, limit).collect()}
        assert got == {1: (20, []), 2: (40, ["7"]), 3: (2, []), 4: (0, [])}
    assert [r["contaminated"] for r in D.verdicts(docs, bench).orderBy("doc_id").collect()] == [True, True, True, False]
    assert [r["doc_id"] for r in D.clean(docs, bench).collect()] == [4]

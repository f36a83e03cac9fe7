from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracegrove.llm import substring_dedup as B


def brute(docs):
    least = {}
    for d, t in docs:
        x = (t or "").encode()
        for i in range(len(x) - 49):
            if d is not None:
                w = x[i : i + 50]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, t in docs:
        x = (t or "").encode()
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 49):
            if d is not None and least[x[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=120), st.sampled_from([1, 2, 5, 13]))
def test_interval_expansion(symbols, depth):
    text = np.array([*symbols, 0], np.uint16)
    label = B.classes_of(text, depth)
    seen = {}
    for p in range(len(text) - depth):
        assert seen.setdefault(tuple(text[p : p + depth]), label[p]) == label[p]
    assert len(set(seen.values())) == len(seen)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = result(B.op5_interval_expansion(spark, sf_dir))
    assert got == brute(docs) and any(x[2] for x in got)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_edges_and_frequent_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(B, "HOT", hot)
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh é"), 140))
    own = lambda n: "".join(rng.choice(list("ijklmnop"), n))
    docs = [(k, own(30) + passage[k : 140 - k] + own(40)) for k in range(12)]
    docs += [(50, None), (51, ""), (52, "x" * 49), (53, "x" * 50), (54, "x" * 300), (55, "x" * 300), (55, "x" * 300), (56, "ab" * 400), (57, "ba" * 100), (58, passage), (59, passage[:49]), (None, passage), (60, passage + passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rid", "2 AS bucket")
    assert result(B.dedup_substrings(df, digest=True)) == brute(docs)
    kept = {r["doc_id"]: bytes(r["kept"]) for r in B.dedup_substrings(df).collect()}
    assert kept[58] == b"" and kept[52] == b"x" * 49
    assert B.dedup_substrings(df.limit(0), digest=True).count() == 0


def test_long_texts(spark):
    """Texts of many pieces: what they share with a small one, with each other and with themselves."""
    rng = np.random.default_rng(8)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    passage, own = letters(700), letters(10_000_000)
    docs = [(1, passage), (2, own[:600_000] + passage + own[600_000:]), (3, letters(50_000) + own[262_000:262_400] + letters(300_000) + passage[100:400])]
    got = {r["doc_id"]: r for r in B.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), digest=True).collect()}
    assert [got[d]["n_removed"] for d in (1, 2, 3)] == [0, 700, 700] and [got[d]["n_spans"] for d in (1, 2, 3)] == [0, 1, 2]
    assert got[2]["kept_sha256"] == hashlib.sha256(own.encode()).hexdigest() and got[2]["n_bytes"] == 10_000_700


def test_parts_are_even():
    """The least hashes of windows crowd at the low end; the parts that they are dealt to hold about as many each."""
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 123, 20_000, dtype=np.uint8)) for _ in range(10)]
    press = B.zstandard.ZstdCompressor()
    table = B.pa.table({"bucket": [0] * 10, "doc_id": range(10), "text": [press.compress(t) for t in texts], "copy": [False] * 10})
    sizes = [len(B._unpack(x.as_py())) for x in B._first_pass(8)(table).column("anchors")]
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from tracegrove.llm import ngram_join as N

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOW))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute(docs):
    """Links of every pair that shares a shingle, and components."""
    sets = [(d, shingle_set(t)) for d, t in docs]
    inverted, links, parent = {}, Counter(), {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (d, s) in enumerate(sets):
        for j in {j for x in s for j in inverted.get(x, ())}:
            e, o = sets[j]
            both = len(s & o)
            if 5 * both >= 4 * (len(s) + len(o) - both):
                links[k] += 1
                links[j] += 1
                a, b = sorted((find(d), find(e)))
                parent[b] = a
        for x in s:
            inverted.setdefault(x, []).append(k)
    return sorted((d, find(d), links[k]) for k, (d, _) in enumerate(sets))


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "class_id", "n_links").collect())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert any(x[2] > 1 for x in want)
    assert result(N.op2_bayes_join(spark, sf)) == want


@pytest.mark.parametrize("block", [1024, 16])
def test_large_group_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BUCKET_BLOCK", block)
    monkeypatch.setattr(N, "TEXT_BLOCK", block)
    rng = np.random.default_rng(1)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for d in range(90):
        w = list(base)
        for p in rng.integers(0, 120, int(rng.integers(0, 4))):
            w[p] = f"x{d}_{p}"
        docs.append((d, " ".join(w)))
    docs += [(200 + d, " ".join(f"r{d}_{k}" for k in range(50))) for d in range(20)]
    docs += [(300, docs[3][1]), (301, docs[3][1].upper())]
    assert result(N.jaccard_links(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "short text"), (5, "Short, text"), (6, "short"), (7, "a b c d e"), (7, "a b c d e"), (8, "w " * 30000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS class_id")
    assert result(N.jaccard_links(df)) == brute(docs)
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 7, 8]
    assert N.jaccard_links(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in N.jaccard_links(nulls).collect()) == [(0, 0), (1, 1), (2, 1)]


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 256, (400, N.HASHES)).astype(np.uint8)
    for k in range(0, 400, 2):  # neighbours match with probability 0.85
        same = rng.random(N.HASHES) < 0.85
        sig[k + 1, same] = sig[k, same]
    i, j = np.triu_indices(400, 1)
    a, b = N.surviving(i, j, sig, np.full(400, 100))
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    assert {(k, k + 1) for k in range(0, 400, 2)} <= got
    assert len(got) < 210
    assert not len(N.surviving(np.array([0]), np.array([1]), sig, np.array([70, 100]))[0])  # by size alone


def by_row(docs):
    """class_id and links of each row, rows of one id with different texts apart."""
    sets = [shingle_set(t) for _, t in docs]
    near = [[k for k in range(len(docs)) if k != i and 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k]) > 0] for i in range(len(docs))]
    out = []
    for i, (d, _) in enumerate(docs):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := set(near[todo.pop()]) - seen)
            seen |= new
        out.append((d, min(docs[k][0] for k in seen), len(near[i])))
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 2])
def test_one_id_with_several_texts(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BUCKET_BLOCK", block)
    monkeypatch.setattr(N, "TEXT_BLOCK", block)
    text = lambda name, last="": " ".join(f"{name}{k}" for k in range(60)) + last
    a, b, clean = text("a"), text("b"), text("c")
    docs = [(1, a), (5, a + " x"), (5, clean), (5, a + " y z"), (7, a + " x y"), (7, b), (8, b + " u"), (8, b + " v"), (9, b + " u"), (9, b), (9, clean + " w"), (5, a + " x"), (5, clean), (5, a + " x")]
    rng = np.random.default_rng(3)
    for _ in range(3):
        order = [docs[k] for k in rng.permutation(len(docs))]
        df = spark.createDataFrame(order, "doc_id long, text string")
        assert result(N.jaccard_links(df)) == by_row(docs)
    kept = sorted((r["doc_id"], r["text"]) for r in N.one_of_each(df).collect())
    assert kept == sorted([(1, a), (5, clean), (5, clean), (7, b)])

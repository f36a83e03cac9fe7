from __future__ import annotations

import re

import numpy as np
import pytest

from tracegrove.llm import near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOW))
    n = min(4, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute(docs):
    """Every pair of different sets that share a shingle, compared; components by union."""
    sets = [(d, shingle_set(t) if d is not None else frozenset()) for d, t in docs]
    parent = {d: d for d, _ in docs if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(x, y):
        a, b = sorted((find(x), find(y)))
        parent[b] = a

    classes, inverted = {}, {}
    for d, s in sets:
        if not s:
            continue
        if s in classes:
            join(d, classes[s])
            continue
        classes[s] = d
        for j in {j for x in s for j in inverted.get(x, ())}:
            o = j[1]
            both = len(s & o)
            if 5 * both >= 4 * (len(s) + len(o) - both):
                join(d, j[0])
        for x in s:
            inverted.setdefault(x, []).append((d, s))
    return sorted(((d, len(shingle_set(t)), None if d is None else find(d), d is None or find(d) == d) for d, t in docs), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert sum(not r[3] for r in want) > 50
    assert result(N.op13_sequential_bayes(spark, sf)) == want


@pytest.mark.parametrize("block", [1024, 8])
def test_chains_and_groups_in_blocks(spark, monkeypatch, block):
    """Copies with growing changes: the first text isn't linked to the last, but by those between; and groups just below the threshold."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "TEXTS", block)
    monkeypatch.setattr(N, "PLACES", block)
    monkeypatch.setattr(N, "HOT_LEAST", block)
    rng = np.random.default_rng(2)
    docs = []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(150)]
        for _ in range(40):
            at = int(rng.integers(0, 150))
            words = [*words]
            words[at] = f"n{rng.integers(1 << 30)}"
            docs.append((len(docs) * 7 % 1009, " ".join(words)))
    base = [f"b{k}" for k in range(120)]
    for _ in range(120):
        words = [*base]
        for at in rng.choice(120, int(rng.integers(2, 7)), replace=False):
            words[at] = f"m{rng.integers(1 << 30)}"
        docs.append((2000 + len(docs), " ".join(words)))
    want = brute(docs)
    assert len({r[2] for r in want}) > 7
    assert result(N.near_duplicates(frame(spark, docs))) == want


def test_threshold_is_met_exactly(spark):
    a = [f"w{k}" for k in range(21)]  # 18 shingles
    docs = [(1, " ".join(a)), (2, " ".join([*a[:-1], "x", "y"])), (3, " ".join(a[:-2])), (4, " ".join(a[:-4])), (5, "a b c"), (6, "A\tB\u000bC"), (7, "a b c d"), (8, "a b c ")]
    docs = [(d + 10 * k, t.replace("w", f"v{k}")) for k in range(30) for d, t in docs]
    assert result(N.near_duplicates(frame(spark, docs))) == brute(docs)


def test_odd_rows(spark):
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    docs = [(None, "a b c d e"), (None, "a b c d e"), (1, None), (2, ""), (3, " \n\t"), (4, "a b c d e"), (4, "a b c d e"), (5, "A b c d e"), (6, "nul\x00 one two three"), (7, "nul one two three"), (8, long), (9, long + " end"), (10, "short"), (11, "SHORT")]
    rows = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, n int, component_id string")
    assert result(N.near_duplicates(rows)) == brute(docs)
    assert result(N.near_duplicates(rows.limit(0))) == []


def test_one_id_with_different_texts(spark):
    docs = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (3, "x y z")]
    assert result(N.near_duplicates(frame(spark, docs))) == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 1, 3, True)], key=str)

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracegrove.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(docs):
    n = Counter()
    for d, t in docs:
        for run in RUN.findall(t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(docs):
    """Near words by the strings that come of taking out one code point, or putting any mark in place of one."""
    n = words_of(docs)
    near = {w: set() for w in n}
    marked = {}
    for w in n:
        for k in range(len(w)):
            marked.setdefault(w[:k] + "\0" + w[k + 1 :], []).append(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in marked.values():
        for w in group:
            near[w].update(v for v in group if v != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def result(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert sum(r[1] != "" for r in want) > 100 and any(r[1] not in ("", r[2]) for r in want)
    assert result(S.op11_qgram_index(spark, sf)) == want


@pytest.mark.parametrize("hot", [500, 5])
def test_one_edit_at_each_place_and_split_postings(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_LEAST", hot)
    rng = np.random.default_rng(3)
    texts = []
    for word in ("abcde", "straße", "ÀÉîõü", "mississippi", "internationalisation"):
        for _ in range(60):
            k, kind = int(rng.integers(0, len(word) + 1)), int(rng.integers(0, 3))
            c = "abcxyzé"[int(rng.integers(0, 7))]
            v = word[:k] + (c if kind < 2 else "") + word[k + (kind > 0) :]
            texts += [v] * int(rng.integers(2, 6))
        texts += [word.upper()] * 40
    docs = [(k, t) for k, t in enumerate(texts)]
    assert result(S.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_damage_takes_out_the_named_code_point(spark):
    rows = spark.createDataFrame([(str(d), "abcdefgh") for d in range(2000)], "doc_id string, run string")
    from pyspark.sql import functions as F

    got = {r.doc_id: r.w for r in rows.select("doc_id", S.damaged(F.col("doc_id"), F.col("run")).alias("w")).collect()}
    for d, w in got.items():
        h = zlib.crc32(f"{d}:abcdefgh".encode())
        assert w == ("abcdefgh" if h % 97 else "abcdefgh"[: h % 8] + "abcdefgh"[h % 8 + 1 :])
    assert any(len(w) == 7 for w in got.values())


def test_odd_rows(spark):
    long = "x" * 30_000
    docs = [(None, "Words words wORDS"), (1, None), (2, ""), (3, "12 34 _ é"), (4, "wordz wordz wordz words×words÷words"), (4, "wordz wordz wordz"), (5, f"{long} {long} {long}")]
    rows = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, word int, n string")
    assert result(S.variants(rows)) == brute(docs)
    assert result(S.variants(rows.limit(0))) == []


def test_chain_of_forms(spark):
    docs = [(1, "aaaaa " * 40 + "aaaab " * 18 + "aaabb " * 8 + "aabbb " * 3)]
    got = {r[0]: (r[1], r[2]) for r in result(S.variants(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got["aabbb"] == ("aaabb", "aaaaa")
    assert result(S.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)

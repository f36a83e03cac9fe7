from __future__ import annotations

import re

from tracegrove.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    """The base columns, and the labels of every notice by comparing at every word."""
    w = WORD.findall((text or "").translate(LOW))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += own
        if own:
            labels.add(label)
    base, best = ",".join(sorted(labels)), 1.0 if labels else 0.0
    for t in L.NOTICES:
        a, b = t.key
        for i in range(-a, len(w)):
            if tuple(w[max(0, i + a) : i + b]) == t.words[a:b]:
                share = sum(0 <= i + j < len(w) and w[i + j] == x for j, x in enumerate(t.words)) / len(t.words)
                best = max(best, share)
                if share >= L.LEAST:
                    labels.add(t.label)
    return (len(w), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), round(best, 9))


def result(rows):
    return {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in rows}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = result(L.op10_rare_token_index(spark, sf).collect())
    assert got == {d: brute(t) for d, t in docs.items()}
    assert any(x[1] for x in got.values())


def test_edges(spark):
    texts = [
        None, "", "MIT License", "mit  license, MIT-licensed; cc by", "cc by cc by cc by-nc 4.0", "İmit license", "gnu general public licensed", "license gnu general public license",
        "Licensed under the Apache License, Version 2.0", "under the apache license", "is free software", "by cc", "ſ cc by", "permission is hereby granted, free of charge", "word " * 5000 + "mit license",
        "under the \u212a license", "wor\u212a is licensed under the gnu general public license version", "mit license " * 30_000, "cc0 1 0 universal; cc0 1.0", "common creative attribution commons",
    ]
    df = spark.createDataFrame([(i, t, "x", 1, "keep", "me") for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int, words string, _hits string")
    got = L.scan_licenses(df.union(df))
    assert got.count() == 2 * len(texts)
    assert result(got.collect()) == {i: brute(t) for i, t in enumerate(texts)}
    assert L.scan_licenses(df.limit(0)).count() == 0
    assert {(r["words"], r["_hits"]) for r in got.select("words", "_hits").collect()} == {("keep", "me")}


def test_every_notice_is_found(spark):
    df = spark.createDataFrame([(k, "some words " + " ".join(t.words) + " and more") for k, t in enumerate(L.NOTICES)], "doc_id long, text string")
    got = L.scan_licenses(df).collect()
    assert all(L.NOTICES[r["doc_id"]].label in r["labels"].split(",") and r["score"] == 1.0 for r in got)
    assert result(got) == {k: brute("some words " + " ".join(t.words) + " and more") for k, t in enumerate(L.NOTICES)}

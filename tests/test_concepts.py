"""Many concepts at once."""

from __future__ import annotations

import random

import pytest

from tracegrove.operators import concepts as K


@pytest.mark.parametrize("automaton", [200_000, 3000])
def test_ten_thousand_concepts(spark, monkeypatch, automaton):
    monkeypatch.setattr(K, "AUTOMATON", automaton)
    rng = random.Random(2)
    letters = "abcdéß你 "
    table = [(k * 2, "".join(rng.choice(letters) for _ in range(rng.randint(4, 7))), f"s{k}") for k in range(10_000)]
    table += [(30_001, table[5][1], "again"), (30_002, "ABC", "upper"), (30_003, None, "null")]
    texts = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))) for k in range(400)] + [(900, None), (901, ""), (902, "xABCx"), (903, "abc")]
    got = K.first_concept(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(table, "ord long, concept string, symbols string"))
    want = []
    for i, t in texts:
        held = [(o, c, s) for o, c, s in table if c is not None and t is not None and c in t]
        if held:
            want.append((i, *min(held)))
    assert sorted((r["id"], r["ord"], r["concept"], r["symbols"]) for r in got.collect()) == sorted(want)
    assert len(want) > 300


def test_empty_concepts_and_none(spark):
    texts = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id long, text string")
    of = lambda rows: sorted((r["id"], r["concept"]) for r in K.first_concept(texts, spark.createDataFrame(rows, "ord long, concept string")).collect())
    assert of([(1, ""), (0, "a")]) == [(1, "a"), (2, "")] and of([]) == [] and of([(4, None)]) == []

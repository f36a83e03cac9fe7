from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracegrove.llm import line_dedup as L


def distance(x, y):
    """Edit distance; what both begin and end with costs nothing."""
    while x and y and x[0] == y[0]:
        n = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        x, y = x[n:], y[n:]
    n = next((k for k, (a, b) in enumerate(zip(x[::-1], y[::-1], strict=False)) if a != b), min(len(x), len(y)))
    return L._plain(x[: len(x) - n], y[: len(y) - n])


def brute(docs, edits=L.EDITS, least=L.LEAST_CHARS):
    first = {}
    good = lambda x: len(x) >= least and x.strip()
    for d, t in sorted(docs, key=lambda x: x[0]):
        for p, x in enumerate((t or "").split("\n")):
            if good(x):
                first[x] = min(first.get(x, (d, p)), (d, p))
    counts = {x: np.bincount([ord(c) % 61 for c in x], minlength=61) for x in first}  # an edit changes two counts by one at most
    alike = lambda x, y: abs(len(x) - len(y)) <= edits and np.abs(counts[x] - counts[y]).sum() <= 2 * edits
    gone = {x for x in first if any(y != x and first[y] < first[x] and alike(x, y) and distance(x, y) <= edits for y in first)}
    out = []
    for d, t in docs:
        if t is None:
            out.append((d, 0, 0, hashlib.sha256(b"").hexdigest()))
            continue
        own = t.split("\n")
        left = [x for p, x in enumerate(own) if not good(x) or (first[x] == (d, p) and x not in gone)]
        out.append((d, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r["doc_id"], r["n_lines"], r["n_removed"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=30), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.sampled_from("abc")), max_size=4))
def test_distance_and_keys(a, moves):
    b = list(a)
    for kind, p, c in moves:
        p = min(p, len(b))
        if kind == 0:
            b.insert(p, c)
        elif p < len(b):
            b[p : p + 1] = [] if kind == 1 else [c]
    b = "".join(b)
    d = L._plain(a, b)
    for t in (1, 2, 3):
        assert L.within(a, b, t) == L.within(b, a, t) == (d <= t)
        short, long = sorted((a, b), key=len)
        if d <= t and len(short) > t:
            index = {(len(short), k, short[p : p + n]) for k, (p, n) in enumerate(L.segments(len(short), t))}
            assert any((o, k, long[s : s + n]) in index for o, k, s, n in L.probes(len(long), t))


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in L.op3_segment_join(spark, sf_dir).collect())
    assert got == brute(docs) and any(x[2] for x in got)


def test_near_lines_blocks_and_edges(spark, monkeypatch):
    line = "The quick brown fox jumps over the lazy dog number 17"
    near = [line, line.replace("17", "18"), line + "!", line[1:], line.replace("quick", "quikc"), line.replace("fox", "cat"), "é" + line, line.upper()]
    docs = [(k, f"head {k}\n{x}\nshort\n" + " " * 40) for k, x in enumerate(near)]
    docs += [(20, None), (21, ""), (22, line + "\n" + line), (23, "\n" * 5), (24, "z" * 50_000), (25, "z" * 50_001), (26, "own line that stands here twice"), (26, "own line that stands here twice")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS n_lines", "8 AS pos", "9 AS h", "10 AS _id", "11 AS _h", "12 AS id", "13 AS hashes", "14 AS Good")
    want = brute(docs)
    out = L.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "pos", "h", "_id", "_h", "id", "hashes", "Good", "n_lines", "n_removed"]
    assert result(out) == want
    assert out.select("pos", "h", "_id", "_h", "id", "hashes", "Good").distinct().collect() == [(8, 9, 10, 11, 12, 13, 14)]
    monkeypatch.setattr(L, "BLOCK", 2)
    assert result(L.dedup_lines(df)) == want
    assert L.dedup_lines(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, line), (1, line), (1, None), (2, line)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in L.dedup_lines(nulls).collect()) == [(0, 0), (1, 0), (1, 0), (2, 1)]


def test_long_text_of_many_lines(spark):
    long = "\n".join(f"line number {k} of a very long text" if k % 3 else f"a line of its own {k * 7919} {'x' * (k % 50)}" for k in range(4000))
    docs = [(1, "a line of its own 7919 and more\nline number 1 of a very long text"), (2, long), (3, long + "\nlast line of the longest text")]
    got = {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(long) > 100_000 and got[1]["n_removed"] == 0
    assert got[3]["text"] == "last line of the longest text" and got[3]["n_removed"] == 4000

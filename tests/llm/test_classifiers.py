from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tracegrove.llm import quality as Q
from tracegrove.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def held_out_quality(spark, rows, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    own = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return np.array(own).T


def test_toxicity_on_the_held_out_fold(spark):
    rows = X.op6_nnpu_toxicity(spark, SF).collect()
    for r in rows[:50]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    y, s, p = held_out_quality(spark, rows, "toxic")
    assert p[y == 1].mean() >= 0.9 and y[p == 1].mean() >= 0.95
    assert s[y == 1].mean() > s[y == 0].mean()


def test_quality_on_the_held_out_fold(spark):
    rows = Q.op8_quadratic_discriminant(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows[:50])
    y, s, p = held_out_quality(spark, rows, "quality")
    assert (p == y).mean() > 0.98
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None), (3, ""), (4, "é" * 5000), (5, "a " * 20000), (6, "fine words here"), (6, "fine words here")], "doc_id long, text string").selectExpr("*", "'x' AS score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plain = docs.select("doc_id", "text")
    assert X.score(docs, X.train(plain, none)).where("score >= 0.7 OR score IS NULL").count() == 0
    assert Q.score(docs, Q.train(plain, none)).where("score <> 0.5").count() == 0
    some = spark.createDataFrame([(1, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert X.score(docs, X.train(plain, some, None)).where("score BETWEEN 0 AND 1").count() == 7
    assert Q.score(docs, Q.train(plain, some, None)).where("score BETWEEN 0 AND 1").count() == 7
    assert X.score(docs.limit(0), X.train(plain.limit(0), some)).count() == 0
    assert Q.score(docs.limit(0), Q.train(plain.limit(0), some)).count() == 0


def test_risk_is_corrected_by_the_prior():
    rng = np.random.default_rng(0)
    word = lambda n, bad: " ".join([*(f"w{k}" for k in rng.integers(0, 50, n)), *(["bad"] if bad else [])])
    pos = pa.array([word(10, True) for _ in range(200)])
    unl = pa.array([word(10, k < 100) for k in range(1000)])
    model = X.fit(X.features(pos), X.features(unl), 0.1)
    z = model.raw(*X.features(pa.array([word(10, True), word(10, False)])))
    assert z[0] > 0 > z[1]


def brute_features(text):
    """Hashes of words and beginnings, word by word."""
    words = {w for w in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))}
    whole = lambda w: X.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))
    out = {int(whole(w).hash[0]) >> (64 - X.BITS) for w in words}
    for n in X.PREFIXES:
        stems = Counter(w[:n] for w in words if len(w) > n)
        of = {w[:n]: int(whole(w).prefixes(n)[0][0]) for w in words if len(w) > n}
        out |= {h >> (64 - X.BITS) for h in of.values()}
        out |= {int(X.mix(np.array([of[k]], np.uint64) ^ X._PAIR)[0]) >> (64 - X.BITS) for k, c in stems.items() if c > 1}
    return sorted(out)


def test_features_equal_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + [None, "", "stemming stemmed stem Stemming", "é" * 9]
    flat, off = X.features(pa.array(texts, pa.string()))
    got = [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got == [brute_features(t) for t in texts]
    only = np.zeros(1 << X.BITS, bool)
    only[np.unique(flat)[::3]] = True
    flat, off = X.features(pa.array(texts, pa.string()), only)
    assert [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[f for f in x if only[f]] for x in got]


def test_risk_and_its_gradient_by_scalar_loops():
    """The minimised risk, text by text, is no greater at the fitted weights than anywhere around them."""
    rng = np.random.default_rng(4)
    draw = lambda n, p: [np.flatnonzero(rng.random(5) < p).astype(np.int32) for _ in range(n)]
    pos, unl, prior = draw(40, [0.5, 0.4, 0.2, 0.2, 0.1]), draw(200, [0.3, 0.2, 0.2, 0.2, 0.3]), 0.1
    rows = [X.Rows([x.tobytes() for x in part], 5) for part in (pos, unl)]

    def risk(theta):
        z = lambda x: sum(theta[i] for i in x) + theta[5]
        loss = lambda v: math.log1p(math.exp(-v))
        rest = sum(loss(-z(x)) for x in unl) / len(unl) - prior * sum(loss(-z(x)) for x in pos) / len(pos)
        return prior * sum(loss(z(x)) for x in pos) / len(pos) + max(0, rest) + 0.5 * 0.1 / len(pos) * sum(t * t for t in theta[:5])

    assert np.allclose(rows[0].raw(np.arange(6.0)), [sum(x) + 5 for x in dict.fromkeys(tuple(map(float, p)) for p in pos)])
    theta = X.minimise(*rows, len(pos), prior)
    low = risk(theta)
    for _ in range(200):
        assert risk(theta + rng.normal(0, 0.1, 6)) >= low - 1e-4


def test_rare_signs_are_kept():
    """A word that one in a hundred positives has, and hardly any other text, is a feature."""
    d1, d0 = np.zeros(1 << X.BITS, np.int64), np.zeros(1 << X.BITS, np.int64)
    d1[7], d0[7], d1[8], d0[8] = 20, 3, 20, 120
    assert X.select(d1, d0, 2000, 12000, 0.1).tolist() == [7]


def test_log_densities_by_the_plain_formula():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (300, 4)) @ rng.normal(0, 1, (4, 4)), rng.normal(1, 2, (200, 4))])
    y = np.repeat([0, 1], [300, 200])
    model = Q.fit(x, y, 0.4 / 0.6)
    z = np.clip((x - np.median(x, 0)) / x.std(0), -12, 12)
    logs, pooled = [], sum((y == k).mean() * np.cov(z[y == k], rowvar=False, bias=True) for k in (0, 1))
    for k in (0, 1):
        c = (1 - Q.POOLED) * np.cov(z[y == k], rowvar=False, bias=True) + Q.POOLED * pooled
        c = (1 - Q.IDENTITY) * c + Q.IDENTITY * (np.trace(c) / 4 + 1e-6) * np.eye(4)
        m, inverse, det = z[y == k].mean(0), np.linalg.inv(c), np.linalg.det(c)
        logs.append([-0.5 * (v - m) @ inverse @ (v - m) - 0.5 * math.log((2 * math.pi) ** 4 * det) for v in z])
    assert np.allclose(model.log_density_difference(x), np.array(logs[1]) - np.array(logs[0]) + math.log(0.4 / 0.6))


def plain_statistics(text):
    """The statistics, one by one."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, size, sizes = len(words), max(1, len(data)), [len(w) for w in words]
    mean = sum(sizes) / max(1, n)
    counts = Counter(words)
    lines = [re.findall(rb"[^\x20\x09-\x0D]+", x) for x in data.split(b"\n")]
    n_lines = data.count(b"\n") + (len(data) > 0)
    share = lambda own: sum(map(own, data)) / size
    marks = b".,;:!?'\"()-"
    spaces = b" \t\n\x0b\x0c\r"
    letter = lambda b: b >= 0x80 or chr(b).isalpha()
    again = Counter(tuple(x) for x in lines if x)
    return [
        math.log1p(n), math.log1p(mean), math.log1p(math.sqrt(max(0, sum(s * s for s in sizes) / max(1, n) - mean**2))), share(letter),
        math.sqrt(share(lambda b: 0x30 <= b <= 0x39)), math.sqrt(share(lambda b: b in marks)), math.sqrt(share(lambda b: not letter(b) and not 0x30 <= b <= 0x39 and b not in marks and b not in spaces)),
        math.sqrt(share(lambda b: 65 <= b <= 90)), len(counts) / max(math.sqrt(n), 1) / 10, math.sqrt(max(counts.values(), default=0) / max(1, n)), math.log1p(n / max(1, n_lines)),
        math.sqrt(sum(c - 1 for c in again.values()) / max(1, n_lines)), math.sqrt(sum(s <= 3 for s in sizes) / max(1, n)), math.sqrt(sum(c * (c - 1) for c in counts.values()) / max(1, n * (n - 1))),
    ]


def test_statistics_by_plain_loops(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + [None, "", "A\n\nA\nB 12!", "é" * 200_000, "a b " * 50_000]
    got = Q.statistics(pa.array(texts, pa.string()))
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row, plain_statistics(t), atol=1e-6), t and t[:80]


def test_statistics_are_those_of_each_text_alone():
    texts = ["One two, two.\nOne two, two.\nEnd!", "", "###", "a b c " * 100, "é è 12"]
    whole = Q.statistics(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], Q.statistics(pa.array([t]))[0])
    assert whole[0][Q.NAMES.index("log_words")] == np.log1p(7)
    assert np.isclose(whole[0][Q.NAMES.index("repeated_lines")] ** 2, 1 / 3)


def test_rows_without_an_id_are_not_held_out(spark):
    from pyspark.sql import functions as F

    from tracegrove.llm.toxicity import fold_column

    ids = spark.createDataFrame([(None,), (1,), (5,)], "doc_id long")
    for modulus, held in ((3, 1), (4, 2)):
        got = {r["doc_id"]: r["h"] for r in ids.select("doc_id", (fold_column(modulus) == held).alias("h")).collect()}
        assert got == {d: d is not None and zlib.crc32(str(d).encode()) % modulus == held for d in (None, 1, 5)}

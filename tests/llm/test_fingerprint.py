from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tracegrove.llm import fingerprint as P


def expected(docs):
    order = sorted(((d, t or "") for d, t in docs), key=lambda x: (-x[0], x[1]))
    out = []
    for i, (d, t) in enumerate(order):
        nxt, k = order[(i + 1) % len(order)][1], len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
    return sorted(out)


def test_query_edits_and_likeness(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(P, "BUCKET_ROWS", 17)  # many buckets
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = P.op1_imatch(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == expected(docs)
    text = dict(docs)
    prints = {}
    for r in rows:
        assert prints.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.9
    assert np.mean([r["near_edited"] for r in rows]) > 0.3 > 0.1 > np.mean([r["near_next"] for r in rows])


def test_edges(spark):
    docs = [(5, "é" * 9), (5, "é" * 9), (4, None), (3, ""), (2, "ab"), (1, "one two three four five six seven eight nine ten"), (0, "x" * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = P.edits(df, P.lexicon(df)).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == expected(docs)
    one = P.edits(df.where("doc_id = 1"), P.lexicon(df)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert P.edits(df.limit(0), P.lexicon(df.limit(0))).count() == 0
    wide = df.selectExpr("*", "1 AS fingerprint", "2 AS bucket")
    assert P.fingerprint(wide, P.lexicon(df)).columns == ["doc_id", "text", "bucket", "fingerprint"]
    nulls = spark.createDataFrame([(None, "a b"), (None, None), (7, "c d e")], "doc_id long, text string")
    assert P.edits(nulls, P.lexicon(nulls)).count() == 3


def test_lexicon_and_digests_by_brute_force(spark):
    texts = [" ".join(f"w{j}" for j in range(40) if (i * 7 + j * 3) % (j + 2) == 0) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    band = (0.05, 0.5)
    df_of = {}
    for t in texts:
        for w in set(t.split()):
            df_of[w] = df_of.get(w, 0) + 1
    want = [w for w, n in df_of.items() if max(2, band[0] * 60) <= n <= band[1] * 60]
    lex = P.lexicon(df, band)
    word_hash = lambda words: P.Words(*P.buffer_of(pa.array(words))).hash
    assert np.array_equal(lex.terms, np.sort(word_hash(want)))
    over = sorted((n, int(h)) for (w, n), h in zip(df_of.items(), word_hash(list(df_of)), strict=True) if n > band[1] * 60)
    assert lex.common.tolist() == [h for _, h in over]
    texts += ["w0 rare1 rare2", "rare1", "", " ".join(f"w{j} x{j}" for j in range(40))]
    got = P.fingerprints(pa.array(texts), lex)
    want = [brute_print(t, set(lex.terms.tolist()), lex.common.tolist(), word_hash) for t in texts]
    assert got.reshape(len(texts), -1).tolist() == want
    for i in range(0, len(texts), 3):
        for j in range(0, len(texts), 5):
            assert P.likeness(got[i : i + 1], got[j : j + 1])[0] == pytest.approx(brute_likeness(want[i], want[j]))


M = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def brute_print(text, band, common, word_hash):
    """Sets of hashes, term by term."""
    terms = {int(word_hash([w])[0]) for w in text.split()}
    inside = sorted(t for t in terms if t in band)
    others = [t for t in common if t in terms] + sorted(t for t in terms if t not in band and t not in common)
    inside = set(inside + others[: max(0, P.FEW - len(inside))])
    out = []
    for level in range(P.LEVELS):
        for e in range(P.EACH):
            ranked = [r for t in inside if (r := mixed(t ^ mixed((e + 1) * 0xA0761D6478BD642F & M))) < 1 << (63 - level)]
            total = sum(r * 0x9E3779B97F4A7C15 + 1 for r in ranked) & M
            out.append(max(1, mixed(total ^ level) >> 48) if ranked else 0)
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    shares, used_all, same_all = [0.0], 0, 0
    for at in range(0, len(a), P.EACH):
        pairs = list(zip(a[at : at + P.EACH], b[at : at + P.EACH], strict=True))
        used, same = sum(bool(x or y) for x, y in pairs), sum(x == y != 0 for x, y in pairs)
        used_all, same_all = used_all + used, same_all + same
        if used >= P.EACH // 2:
            shares.append(same / used)
    return max(*shares, same_all / used_all if used_all else 1.0)


def test_texts_with_few_terms_in_the_band():
    words = [f"t{k}" for k in range(40)]
    hashes = P.Words(*P.buffer_of(pa.array([" ".join(words)]))).hash
    lex = P.Lexicon(np.sort(hashes[:8]), hashes[8:20])  # t0 to t7 are in the band, t8 to t19 more common
    own = lambda k, more: " ".join([*words[:k], *words[10:18], *more])
    like = lambda a, b: P.likeness(*(P.fingerprints(pa.array([x]), lex) for x in (a, b)))[0]
    assert all(like(own(k, ["t30"]), own(k - 1, ["t30"])) > 0.3 for k in range(1, 9))
    assert like(" ".join(words[20:30]), " ".join(words[21:31])) > 0.3 > like(" ".join(words[20:30]), " ".join(words[30:40]))


def test_long_text(spark):
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    df = spark.createDataFrame([(1, long), (2, "w1 w2"), (3, long)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in P.edits(df, P.lexicon(df)).collect()}
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows.values()) == expected([(1, long), (2, "w1 w2"), (3, long)])
    assert rows[1]["fingerprint"] == rows[3]["fingerprint"]

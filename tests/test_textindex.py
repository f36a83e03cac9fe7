"""The stored index: conditions on trigrams, candidates, rows read, and ranked search by bounds."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracegrove.functions import trigrams as T
from tracegrove.operators import lexical, textindex
from tracegrove.sources import store
from tracegrove.sources import tables as S

LETTERS = "abcAB. _é"


def grams_of(text):
    low = text.lower() + "\0\0"
    return {T.number(low[k : k + 3]) for k in range(len(low) - 2)}


PATTERNS = ("abc", "a.c", "ab+c", "(?:abc|cab)a", "[ab]bc", "a{3}", "(abc)?cab", "ab[^c]a", r"\bab\b", "a|b", "abc*ab", "(ab){2,}c", "x{0,2}abc", "^abc$", r"(?P<n>abc)a", "A[bB]c", "éa.b", "[a-c]ab", "((a|b)(b|c)){1}ca")


@settings(max_examples=300, deadline=None)
@given(st.text(LETTERS, max_size=40), st.sampled_from(PATTERNS))
def test_matches_meet_the_condition_of_a_pattern(text, pattern):
    if re.search(pattern, text):
        assert T.holds(T.of_pattern(pattern), grams_of(text))


@settings(max_examples=300, deadline=None)
@given(st.text(LETTERS, max_size=40), st.text(LETTERS, min_size=1, max_size=6))
def test_texts_with_a_term_meet_its_condition(text, term):
    if term in text:
        assert T.holds(T.of_term(term, exact=True), grams_of(text))
    if term.lower() in text.lower():
        assert T.holds(T.of_term(term), grams_of(text))


def test_conditions_say_something():
    gram = lambda *g: [("gram", T.number(x)) for x in g]
    assert T.of_term("Abcd") == ("and", *gram("abc", "bcd"))
    assert T.of_term("ab") == ("from", T.number("ab\0"), T.number("ab\0") + (1 << 21) - 1)
    assert T.of_pattern("(?:abc|bcd)x") == ("or", ("and", *gram("abc", "bcx")), ("and", *gram("bcd", "cdx")))
    assert T.of_pattern("abc.*xyz") == ("and", *gram("abc", "xyz"))
    assert T.of_pattern("(?i)abc") == T.ANY and T.of_pattern("a(") == T.ANY and T.of_pattern("[0-9]+") == T.ANY
    assert T.of_term("ÄBC", exact=True) == ("from", T.number("bc\0"), T.number("bc\0") + (1 << 21) - 1)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Small shards, so that there are many of them."""
    at = str(tmp_path_factory.mktemp("index")) + "/texts"
    random.seed(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "ré", "Sa") for b in ("ban", "dor", "fel", "gu", "nix")]
    rows = [(k * 3, f"repo{k % 4}", "en", "main", f"p/{k}.java", " ".join(random.choices(words, k=random.randint(3, 40)))) for k in range(1500)]
    rows[700] = (*rows[700][:5], rows[700][5] + " Needle_in_hay")
    rows[41] = (*rows[41][:5], rows[41][5] + " zebra zebra zebra zebra")
    rows += [(4600, "r", "en", "main", "e/1", ""), (4601, "r", "en", "main", "e/2", None), (4602, "r", "en", "main", "e/3", "ab"), (4602, "r", "en", "main", "e/4", "xab")]
    files = spark.createDataFrame(rows, "doc_id long, repo string, lang string, branch string, path string, content string")
    old, textindex.SHARD_TEXTS = textindex.SHARD_TEXTS, 32
    textindex.build(files, at)
    textindex.SHARD_TEXTS = old
    return textindex.TextIndex(spark, at), files


def rows_read(df):
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def test_index_keeps_the_files(index):
    own, files = index
    assert sorted(map(tuple, own.files.select(files.columns).collect()), key=str) == sorted(map(tuple, files.collect()), key=str)
    assert own.count == 1504 and own.texts.select("shard").distinct().count() > 20


@pytest.mark.parametrize("query", ["kaban", "kaban dor", "Saban", "sa", "ré", "é", "content:/k[ab]ban/", "content:/needle|Needle/", "sym:Needle_in_hay Needle_in_hay", "nosuchthing", "ab", "file:p/1 kaban r:repo1", "content:/x?/", "zebra", "NIX"])
def test_search_through_the_index_equals_search_over_all_files(index, query):
    own, files = index
    want, got = (sorted(map(tuple, lexical.search(x, query, 7).collect())) for x in (files, own))
    assert got == want


def test_few_candidates_read_few_rows(index):
    own, _ = index
    (one,) = own.narrowed([lexical.condition(lexical.parse("needle_in_hay"))])
    assert 0 < rows_read(one) <= 2 * textindex.PAGE_ROWS
    none, every = own.narrowed([lexical.condition(lexical.parse("nosuchthing")), T.ANY])
    assert none.count() == 0 and every.count() == 1504
    assert own.candidates([lexical.condition(lexical.parse("needle_in_hay"))]).count() == 1


def test_many_candidates_by_shards(index, monkeypatch):
    own, files = index
    monkeypatch.setattr(textindex, "FEW", 3)
    monkeypatch.setattr(textindex, "INTERVALS", 2)
    got = sorted(map(tuple, lexical.search(own, "kaban", 7).collect()))
    assert got == sorted(map(tuple, lexical.search(files, "kaban", 7).collect()))


@pytest.mark.parametrize("terms", [["zebra"], ["kaban", "zebra"], ["kaban", "lodor", "mifel"], ["nosuch", "zebra"], ["nosuch"], ["kaban", "kaban"]])
@pytest.mark.parametrize("top", [1, 5, 5000])
def test_ranked_equals_scoring_all(index, terms, top):
    own, files = index
    want = [tuple(r) for r in lexical.bm25(files, list(dict.fromkeys(terms)), top_k=top).collect()]
    assert [tuple(r) for r in textindex.ranked(own, terms, top).best.collect()] == want


def test_ranked_search_skips_segments(index):
    found = textindex.ranked(index[0], ["kaban", "zebra"], 1)
    assert found.segments > 30 and found.scored <= textindex.FIRST + 2


def test_stored_form_follows_its_input(spark, tmp_path):
    at, built = str(tmp_path / "t.parquet"), []

    def build(to):
        built.append(to)
        spark.read.parquet(at).write.parquet(to)

    spark.range(3).write.parquet(at)
    first = store.stored(spark, [at], "copy", build)
    assert store.stored(spark, [at], "copy", build) == first and len(built) == 1
    spark.range(9).write.mode("overwrite").parquet(at)
    second = store.stored(spark, [at], "copy", build)
    assert second != first and spark.read.parquet(second).count() == 9


def test_index_of_no_files(spark, tmp_path):
    files = S.code_files(spark, "/root/testdata/sf0.001").limit(0)
    textindex.build(files, str(tmp_path / "none"))
    own = textindex.TextIndex(spark, str(tmp_path / "none"))
    assert lexical.search(own, "a").count() == 0 and textindex.ranked(own, ["a"]).best.count() == 0


def test_many_ranked_searches_equal_single_ones(spark, index):
    from tracegrove.plans.many import ranked_many

    own, _ = index
    asks = {"a": "Kaban zebra", "b": "lodor, mifel. lodor", "c": "nosuch words", "d": "needle_in_hay", "e": None, "f": "tunix kagu samix"}
    queries = spark.createDataFrame(list(asks.items()), "qid string, text string")
    got = {}
    for r in ranked_many(own, queries, 5).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["doc_id"], r["score"]))
    for qid, text in asks.items():
        terms = re.findall("[a-z0-9_]+", (text or "").lower())
        want = [tuple(r) for r in textindex.ranked(own, terms, 5).best.collect()] if terms else []
        assert got.get(qid, []) == want


def test_many_ranked_searches_in_blocks_and_with_parts_of_a_query(spark, index, monkeypatch):
    from tracegrove.plans import many

    own, _ = index
    monkeypatch.setattr(many, "POSTINGS", 2000)
    parts = [("a", "Kaban zebra"), ("a", "kaban lodor"), ("b", "xab ab"), (None, "tunix samix")]
    got = {}
    for r in many.ranked_many(own, spark.createDataFrame(parts, "qid string, text string"), 7).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["doc_id"], r["score"]))
    assert len({block for _, block in many._blocks(own)}) > 5
    # rows of one query are one query, and a word of both counts once
    for qid, terms in (("a", ["kaban", "zebra", "lodor"]), ("b", ["xab", "ab"]), (None, ["tunix", "samix"])):
        assert got[qid] == [tuple(r) for r in textindex.ranked(own, terms, 7).best.collect()]


def test_a_build_deals_nothing_out_and_words_wait_for_ranked_search(spark, tmp_path):
    at = str(tmp_path / "texts")
    rows = [(k * 7 % 300, "r", "en", "main", f"p/{k}", f"kaban {k} lodor") for k in range(300)]
    files = spark.createDataFrame(rows, "doc_id long, repo string, lang string, branch string, path string, content string").repartition(3)
    textindex.build(files, at)
    for kind in ("texts", "grams"):
        assert len([n for n in store.names(spark, f"{at}/{kind}") if n[0] not in "._"]) <= 3  # a file a task, no folder a part
    own = textindex.TextIndex(spark, at)
    assert lexical.search(own, "kaban 29").count() == lexical.search(files, "kaban 29").count() > 0
    assert not store.exists(spark, f"{at}/words")
    want = [tuple(r) for r in lexical.bm25(files, ["kaban", "29"], top_k=5).collect()]
    assert [tuple(r) for r in textindex.ranked(own, ["kaban", "29"], 5).best.collect()] == want and store.exists(spark, f"{at}/words")


@pytest.mark.parametrize("texts", [["abca", None, "", "ré abc", "ab", "x\0y", "\U0001f600\U0001f600a"], ["", None], ["".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x40000)])), "abc", "\U0010ffffab"]])
def test_trigrams_of_a_segment(texts):
    import pyarrow as pa

    ids = [5 + 3 * k for k in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"shard": pa.array([2] * len(ids), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "low": pa.array(texts, pa.string())})
    got, many = [], len(texts[0] or "") > 1000
    for rows in textindex._gram_rows(iter([batch])):
        assert rows.column("gram").to_pylist() == sorted(set(rows.column("gram").to_pylist()))
        got += [(r["gram"], r["lo"] + d) for r in rows.to_pylist() for d in r["at"] if not many or r["lo"] + d != ids[0]]
    want = [(T.number((t + "\0\0")[k : k + 3]), i) for t, i in zip(texts, ids, strict=True) if t and (not many or i != ids[0]) for k in range(len(t))]
    assert sorted(got) == sorted(set(want))

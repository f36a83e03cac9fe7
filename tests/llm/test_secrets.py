from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import string

import pytest

from tracegrove.llm import secrets as S

KINDS = ("assign", "access", "hex")


def brute(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8 and m[1].isascii():
            spans.append(("assign", *m.span()))
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    return (*(sum(s[0] == k for s in spans) for k in KINDS), digest)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = S.op9_zstd_novelty(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert any(r["n_assign"] for r in got)
    for r in got:
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute(docs[r["doc_id"]])


def test_edges(spark):
    texts = [
        None, "", "token='abcdefgh'", "TOKEN : short", "api_key=12345678 apikey=12345678", "AKIAABCDEFGHIJKL AKIA1", "f" * 31, "f" * 32, "0" * 10_000,
        "passwd=passwd=abcdefghi", "secret=token=abcdefgh", "é" * 50 + " paſſword=abcdefghi password=abcdefghi", "password=aaaaaaa password=bbbbbbbb", "AKIA" * 10, "deadbeef" * 4 + "g" + "deadbeef" * 4,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "x")], "doc_id long, text string, secrets string")
    for r in S.scan_secrets(df).collect():
        base = [(s["kind"], s["start"], s["end"]) for s in r["secrets"] if s["kind"] != "novel"]
        got = (*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
        assert got == brute(r["text"]), r["text"]
    assert S.scan_secrets(df.limit(0)).count() == 0


RANDOM = "q7Rk2Zx9LmT4vB8nWc3YpD6sHf1Gj5Ka"


def test_novelty_tells_random_strings_from_known_ones():
    assert S.novel_spans(f"bearer {RANDOM}") == [("novel", 7, 39)]
    assert S.novel_spans(f"{RANDOM} again\n\nbearer {RANDOM}") == []  # explained by the copy that is in no such context
    assert S.novel_spans(f"nothing near {RANDOM}") == []
    assert S.novel_spans("secret abcdefghijklmnopqrstuvwxyz0123456789") == []


def test_context_is_the_line_and_the_next():
    places = lambda text: [text[a:b] for _, a, b in S.novel_spans(text)]
    assert places(f"secret\n{RANDOM}") == places(f"{RANDOM} is the secret") == places(f"token {'plain words ' * 30}{RANDOM}") == [RANDOM]
    assert places(f"secret\n\n{RANDOM}") == places(f"{RANDOM}\nsecret") == []


def test_what_explains_may_stand_anywhere_in_the_text():
    for n in (10, 4000, 4300, 200_000, 3_000_000):
        words = " ".join(f"w{k}" for k in range(n // 6))
        assert S.novel_spans(f"{RANDOM}\n{words}\nbearer {RANDOM}") == S.novel_spans(f"bearer {RANDOM}\n{words}\n{RANDOM}") == []
        assert len(S.novel_spans(f"bearer {RANDOM}\n{words}\nbearer {RANDOM}")) == 2


def test_novelty_of_a_string_in_two_sensitive_contexts():
    places = lambda text: [(a, b) for _, a, b in S.novel_spans(text)]
    twice = f"Authorization: Bearer {RANDOM}\nfiller words\nAuthorization: Bearer {RANDOM}\n"
    assert [twice[a:b] for a, b in places(twice)] == [RANDOM] * 2
    assert len(places(twice * 3)) == 6
    for other in (f"={RANDOM}", f"{RANDOM}/x1"):
        longer = f"bearer {RANDOM} and\nbearer {other}"
        assert [longer[a:b] for a, b in places(longer)] == [RANDOM, other]
    assert places(f"{twice}\n\nsee {RANDOM}") == []  # a copy outside such contexts explains both
    assert places("secret abcdefghijklmnopqrstuvwxyz0123456789\n" * 2) == []
    assert places("") == [] and places("bearer") == []


def planted(n, seed=11):
    """(text, the string, whether it is random): sensitive lines with random strings, or with names, paths, dates and versions."""
    rng = random.Random(seed)
    words = (
        "orange mountain whisper gadget laptop quarterly finance review bluetooth pairing window kernel driver interface enterprise cluster east region migration "
        "feature extractor layer chapter paragraph invoice payment gateway monitor sensor pressure velocity harbor favourite getting pages customer order"
    ).split()
    alphabets = (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/")
    for k in range(n):
        if k % 2:
            what = "".join(rng.choice(alphabets[k // 2 % 4]) for _ in range(rng.choice((20, 24, 32, 40, 48))))
        else:
            a, d = [rng.choice(words) for _ in range(rng.randint(3, 5))], str(rng.choice([rng.randint(0, 9), rng.randint(10, 99), rng.randint(1990, 2030)]))
            day = f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
            what = ("".join(x.capitalize() for x in a) + d, "_".join(a) + "_" + d, "/" + "/".join(a) + d, "-".join(a) + "-" + day, a[0] + d + "".join(x.capitalize() for x in a[1:]), day + "_" + "_".join(a))[k // 2 % 6]
        prose = " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))
        yield f"{prose}\n{rng.choice(('secret', 'the token', 'Authorization: Bearer', 'api key docs at', 'password hashing, see'))} {what} and so on\n{prose[:40]}", what, bool(k % 2)


def test_precision_and_recall_on_planted_strings():
    hit = {True: [], False: []}
    for text, what, is_random in planted(1200):
        found = [text[a:b] for _, a, b in S.novel_spans(text)]
        hit[is_random].append(what in found)
    caught, wrong = sum(hit[True]), sum(hit[False])
    assert caught / len(hit[True]) >= 0.9 and caught / (caught + wrong) >= 0.9
    for known in ("handler is MyFavouriteConfigurationName2", "count uses HTTP2ConnectionPoolManagerV3", "hashing: see sha256withrsaencryption", "docs at /docs/guide2/getting-started/page", "abcabcabc123abcabcabc123", "2024-01-01_report_final_version"):
        assert S.novel_spans(f"secret {known}") == [], known


def plain_bits(what):
    """The bits rule, by hand."""
    humps = re.findall("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]", what)
    letters, digits = sum(c.isalpha() for c in what), sum(c.isdigit() for c in what)
    groups = sum(1 for m in re.finditer("[0-9]+", what) if (m.start() and what[m.start() - 1].isalpha()) or (m.end() < len(what) and what[m.end()].isalpha()))
    words = bool(humps) and all(3 <= len(h) <= 15 for h in humps) and groups <= 1 + any(re.fullmatch("[A-Z][a-z]+", h) for h in humps)
    kinds = 26 * any(c.islower() for c in what) + 26 * any(c.isupper() for c in what) + 10 * (digits > 0) + 5 * (letters + digits < len(what))
    return (3 * letters + 3.3 * digits if words else len(what) * math.log2(kinds)), words


@pytest.mark.parametrize(
    ("alphabet", "least"),
    [
        (string.ascii_letters + string.digits, 12), (string.ascii_lowercase + string.digits, 16), (string.ascii_uppercase + string.digits, 16), (string.ascii_letters + string.digits + "+/", 12),
        (string.ascii_letters, 12), ("0123456789abcdef", 16), (string.ascii_lowercase, 16), (string.ascii_uppercase, 16), (string.digits, 20),
    ],
)
def test_recall_of_each_alphabet_and_length(alphabet, least):
    rng = random.Random(f"{alphabet}")
    for n in (12, 14, 16, 18, 20, 24, 31, 40):
        texts = [(f"some lines before it\nthe secret {w} and more\n", w) for w in ("".join(rng.choice(alphabet) for _ in range(n)) for _ in range(150))]
        caught = sum(w in [t[a:b] for _, a, b in S.novel_spans(t)] for t, w in texts)
        if n >= least:  # small letters alone are the hardest to tell from a word
            assert caught >= (0.8 if alphabet == string.ascii_lowercase else 0.9) * len(texts), (n, caught)


def test_names_of_unknown_words_are_left_alone():
    words = "zurueck rhythm lymph fjord quartz sphinx jazz oxygen zeitgeist xylophone gewicht schluessel wachtturm vielleicht ueberraschung quelle exemple voiture beaucoup crypt glyph".split()
    rng = random.Random(3)
    names = ["".join(w.capitalize() for w in rng.sample(words, 3)) + str(rng.randint(0, 9)) for _ in range(300)]
    assert sum(bool(S.novel_spans(f"the secret {n} is")) for n in names) <= 15


def test_spans_equal_brute_force(spark):
    """Each candidate priced on its own, with the text cut by hand."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text").collect()
    docs = [(r["doc_id"], r["text"]) for r in docs] + [(10**6 + k, t) for k, (t, _, _) in enumerate(planted(60))]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["secrets"] if s["kind"] == "novel"] for r in S.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    some = 0
    for d, t in docs:
        t, lines, want = t or "", (t or "").split("\n"), []
        starts = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))] if len(lines) < 500 else list(itertools.accumulate([0, *(len(x) + 1 for x in lines[:-1])]))
        marks = [k for k, x in enumerate(lines) if S.SENSITIVE.search(x)]
        near = sorted({*marks, *(k + 1 for k in marks if k + 1 < len(lines))})
        spans = [(starts[k] + m.start(), starts[k] + m.end()) for k in near for m in re.finditer("[A-Za-z0-9+/_=-]{12,}", lines[k]) if plain_bits(m[0])[0] >= 60]
        rest, cut = [], 0
        for a, b in spans:
            rest.append(t[cut:a])
            cut = b
        rest.append(t[cut:])
        for a, b in spans:
            price = S.pricer("\n".join(rest).encode())
            cost, what = price(t[a:b]), t[a:b]
            due = sum(S._sign_prices()[0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3] for c in what)
            if cost >= 0.92 * due and (not plain_bits(what)[1] or cost >= 0.81 * len(what)):
                want.append((a, b))
        some += len(want)
        assert got[d] == want, d
    assert some > 10


def test_helper_names_and_long_texts(spark):
    long = "plain words here " * 20_000 + f"\nbearer {RANDOM}\n" + "more words " * 20_000
    df = spark.createDataFrame([(1, long, 1, 2), (2, None, 1, 2)], "doc_id long, text string, kind int, start int")
    rows = {r["doc_id"]: r for r in S.scan_secrets(df).collect()}
    assert [(s["kind"], long[s["start"] : s["end"]]) for s in rows[1]["secrets"]] == [("novel", RANDOM)] and rows[2]["secrets"] == []
    assert rows[1]["kind"] == 1 and rows[1]["start"] == 2

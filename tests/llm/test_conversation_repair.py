from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np

from tracegrove.llm import conversation_repair as C

INK = re.compile(r"[^\x20\x09-\x0D]")
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else x
        h = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def plain(rows):
    """Cheapest edits by whole prefixes: for each place in the order, the least (cost, letters, lines)."""
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(4):
            for (q, r), to in AFTER.items():
                if q in best and r != "s":
                    c, letters, lines = best[q]
                    new = (c + 3, letters + "I", (*lines, f"{'user' if r == 'u' else 'assistant'}:"))
                    best[to] = min(best.get(to, new), new)
        return best

    insert(best)
    for role, text, fault in rows:
        new = {}

        def put(q, to, cost, letter, line, new=new):
            c, letters, lines = best[q]
            got = (c + cost, letters + letter, lines + line)
            new[to] = min(new.get(to, got), got)

        for q in best:
            put(q, q, 4, "D", ())
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if (q, role[:1]) in AFTER:
                put(q, AFTER[q, role[:1]], more, "K", (f"{role}:{text}",))
            for r in ("user", "assistant"):
                if (q, r[0]) in AFTER:
                    put(q, AFTER[q, r[0]], 3 + more, "R", (f"{r}:{text}",))
        best = insert(new)
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows):
    hurt, out = damage(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, judged = set(), []
        for _, _, role, text in own:
            ink = INK.findall(text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {r[1] for r in own} - {None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        cost, letters, lines = plain(judged)
        count = lambda f, judged=judged: sum(j[2] == f for j in judged)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_equals_brute_force(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        want = brute(rows)
        assert {x for w in want for x in w[7]} == set("DIKR")
        assert result(C.op12_tight_arcs(spark, sf)) == want


def test_random_conversations(spark):
    rng = np.random.default_rng(5)
    texts = ["", " \n", "One.", "Two!", "three", "four", "Five? ", "é。", "a", "b."]
    rows = []
    for conv in range(400):
        turns = sorted(rng.choice(30, int(rng.integers(0, 9)), replace=False).tolist())
        rows += [(conv, int(t), ["system", "user", "assistant", "tool", "", "ursula"][int(rng.integers(0, 6))], texts[int(rng.integers(0, len(texts)))]) for t in turns]
    want = brute(rows)
    assert result(C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == want


def test_optimal_arcs_equal_whole_prefixes():
    for n in range(5):
        for rows in itertools.product([("system", ""), ("user", ""), ("assistant", "truncated"), ("user", "truncated"), ("user", "blank"), ("tool", "")], repeat=n):
            kinds = bytes(C.kind(r[:1], f == "truncated", f == "blank") for r, f in rows)
            cost, letters, _ = plain([(r, "x", f) for r, f in rows])
            assert C.cheapest(kinds) == (cost, letters)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hm."), (1, None, "user", "A."), (1, 3, None, "A."), (1, 9, "user", "A."), (2, None, "user", None)]
    rows += [(3, t, "user", "Same.") for t in range(40)] + [(4, t, "user" if t % 2 else "system", "x" * 100_000 + f"{t}.") for t in range(9)]
    frame = spark.createDataFrame([(*r, 1, "u") for r in rows], "conv_id long, turn long, role string, text string, mark int, audit string")
    assert result(C.repair(frame)) == brute(rows)
    assert result(C.repair(frame.limit(0))) == []
    gone = next(t for t in range(99) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(7, gone, "user", "All of it.")], "conv_id long, turn long, role string, text string")
    assert result(C.repair(one)) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation(spark):
    rows = [(1, t, ("user", "assistant", "user")[t % 3], f"Text {t}{'.' if t % 5 else ''}") for t in range(30_000)]
    got = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    kinds, seen = [], set()
    for _, _, role, text in damage(rows):
        gone = not INK.search(text) or (role, text) in seen
        seen.add((role, text))
        kinds.append(C.kind(role[:1], text[-1:] not in (".", "!", "?"), gone))
    assert (got.cost, got.audit) == C.cheapest(bytes(kinds))
    assert sum(x != "I" for x in got.audit) == len(kinds)

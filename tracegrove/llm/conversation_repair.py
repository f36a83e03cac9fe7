"""Repair of conversations' structure: the cheapest edits to an order of roles, by optimal arcs found from both ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.llm._tables import cut, small_batches, table

#: Costs of rerole, delete and insert, and of a truncated row that isn't deleted; keeping costs nothing.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What counts as white space, and the marks that end a whole text.
SPACE, ENDS = " \t\n\x0b\f\r", ".!?"

# Places in the order of roles: nothing yet, after system, after user, after assistant. It may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each place, by the initial of a role.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_FAR = 1 << 60

#: What a row is to the edits: its role's initial (others are one), that with a truncated text, or to be deleted.
INITIALS = "sua"
GONE = 8

Costs = tuple[int, int, int, int]


def kind(initial: str, truncated: bool = False, gone: bool = False) -> int:
    at = INITIALS.find(initial) if initial else -1
    return GONE if gone else (3 if at < 0 else at) + 4 * truncated


@cache
def row_arcs(of: int) -> tuple[tuple[str, int, int, int], ...]:
    """letter, from, to, cost of the edits of a row of a kind."""
    arcs = [("D", q, q, DELETE) for q in range(4)]
    if of < GONE:
        more = TRUNCATED if of >= 4 else 0
        if of % 4 < 3:
            arcs += [("K", q, to, more) for q, to in NEXT[INITIALS[of % 4]].items()]
        arcs += [("R", q, to, REROLE + more) for role in "ua" for q, to in NEXT[role].items()]
    return tuple(arcs)


INSERTS = tuple(("I", q, to, INSERT) for role in "ua" for q, to in NEXT[role].items())


def _level(costs: list[int]) -> tuple[int, Costs]:
    least = min(costs)
    return least, tuple(min(_FAR, c - least) for c in costs)


def _inserted(costs: list[int], back: bool) -> list[int]:
    """Least costs once any rows are inserted at one place in the conversation."""
    for _ in range(3):  # no cheapest way inserts more than this in front of a given place
        for _, q, to, c in INSERTS:
            a, b = (to, q) if back else (q, to)
            costs[b] = min(costs[b], costs[a] + c)
    return costs


FIRST: Costs = _level(_inserted([0, _FAR, _FAR, _FAR], False))[1]
LAST: Costs = _level(_inserted([0, _FAR, _FAR, 0], True))[1]


@cache
def ahead(of: int, costs: Costs) -> Costs:
    """Forward: least costs to each place behind a row, less the least of them, from those before it."""
    out = [_FAR] * 4
    for _, q, to, c in row_arcs(of):
        out[to] = min(out[to], costs[q] + c)
    return _level(_inserted(out, False))[1]


@cache
def behind(of: int, costs: Costs) -> tuple[int, Costs]:
    """Backward: least costs from each place before a row to the end, less the least of them, and that one, from those behind it."""
    out = [_FAR] * 4
    for _, q, to, c in row_arcs(of):
        out[q] = min(out[q], c + costs[to])
    return _level(_inserted(out, True))


@cache
def least_letters(of: int | None, fore: Costs, rest: Costs, at: frozenset[int]) -> tuple[str, frozenset[int]]:
    """The letters from a frontier over one row (None: behind the last row), always the least that an optimal arc has, and the new frontier.

    An arc is optimal if the cost to its tail, its own and that from its head make the whole; ``fore`` are the costs to
    the places before the row, ``rest`` those from the places behind it.
    """
    extra, here = behind(of, rest) if of is not None else (0, rest)
    whole = min(a + b for a, b in zip(fore, here, strict=True))
    letters = ""
    while True:
        tight: dict[str, set[int]] = {}
        for letter, q, to, c in INSERTS:
            if q in at and fore[q] + c + here[to] == whole:
                tight.setdefault(letter, set()).add(to)
        for letter, q, to, c in row_arcs(of) if of is not None else ():
            if q in at and fore[q] + c + rest[to] - extra == whole:
                tight.setdefault(letter, set()).add(to)
        if not tight:
            return letters, at  # the end
        least = min(tight)
        letters, at = letters + least, frozenset(tight[least])
        if least != "I":
            return letters, at


def cheapest(kinds: bytes | bytearray) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of rows of these kinds, ties by the least letters.

    Costs are kept less their least, of which there are few, so each row is a look-up; a row takes a reference and a few bytes.
    """
    rest = [LAST] * (len(kinds) + 1)
    cost = 0
    for i in range(len(kinds) - 1, -1, -1):
        least, rest[i] = behind(kinds[i], rest[i + 1])
        cost += least
    cost += rest[0][START]
    out, fore, at = [], FIRST, frozenset([START])
    for i, of in enumerate(kinds):
        letters, at = least_letters(of, fore, rest[i + 1], at)
        out.append(letters)
        fore = ahead(of, fore)
    out.append(least_letters(None, fore, LAST, at)[0])
    return cost, "".join(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, copies of each row, damaged by crc32(``conv_id:turn``) % 20; a null counts as one space.

    0 drops the row, 1 empties its text, 2 takes .!? out of it, 3 repeats the row, 4 makes the role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return conversations.select(
        "conv_id",
        "turn",
        F.when(h == 4, "user").otherwise(text("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text("text"), ENDS, "")).otherwise(text("text")).alias("text"),
        (h == 0).alias("dropped"),
        F.when(h == 3, 2).otherwise(1).alias("copies"),
    )


#: The order of a conversation's rows: nulls first, rows of one turn by role and a hash of the text.
ORDER = ("turn", "role", "digest")

SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Summary:
    """What is counted of one conversation, row by row in order."""

    def __init__(self) -> None:
        self.kinds = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.initial = self.least = self.turn = None

    def add(self, turn: int | None, initial: str, blank: bool, ended: bool, fresh: bool) -> None:
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.turn = turn
            self.turns += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        gone = blank or not fresh
        self.blank += blank
        self.duplicate += not blank and not fresh
        self.truncated += not gone and not ended
        self.kinds.append(kind(initial, not ended, gone))

    def row(self) -> tuple:
        gaps = 0 if self.turn is None else self.turn - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(self.kinds)


def summaries(rows: DataFrame) -> DataFrame:
    """conv_id and the columns of SUMMARY of each conversation of ``rows`` (damaged); texts stay out of the shuffle.

    A role and text's first row is found by an aggregation that begins on the map side; a mark of it is sorted in front of it.
    """
    whole = F.rtrim("text", F.lit(SPACE))
    slim = rows.select("conv_id", "turn", "role", F.xxhash64("text").alias("digest"), "dropped", "copies", F.substring("role", 1, 1).alias("initial"), (whole == "").alias("blank"), F.contains(F.lit(ENDS), F.substring(whole, -1, 1)).alias("ended"))
    first = slim.where(~F.col("dropped")).groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("first"))
    first = first.select("conv_id", F.col("first.turn").alias("turn"), "role", "digest", F.lit(0).alias("mark"))
    each = slim.withColumn("mark", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies")
    parts = each.unionByName(first, allowMissingColumns=True)
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER, "mark").select("conv_id", "turn", "mark", "dropped", "initial", "blank", "ended")
    fields = [f.split()[0] for f in SUMMARY.split(", ")]
    kind_of_id = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, fresh, id_type = None, None, False, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            types = [id_type, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", *fields])

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            done = []
            for conv, turn, mark, dropped, initial, blank, ended in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv != now:
                    if own is not None:
                        done.append((now, *own.row()))
                    now, own, fresh = conv, _Summary(), False
                if not mark:
                    fresh = True
                elif not dropped:
                    own.add(turn, initial, blank, ended, fresh)
                    fresh = False
            if done:
                yield out(done)
        if own is not None:
            yield out([(now, *own.row())])

    return parts.mapInArrow(run, f"conv_id {kind_of_id.simpleString()}, {SUMMARY}")


class _Repaired:
    """A conversation's repaired rows, hashed as they come by."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place, self.any = audit, 0, START, False
        self.hash = hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True
        self.place = NEXT[role[:1]][self.place]

    def _wanted(self) -> str:
        return "assistant" if self.place == USER else "user"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._put(self._wanted(), "")

    def add(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self._put(role if letter == "K" else self._wanted(), text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations`` (conv_id, turn, role, text), which are damaged first (see ``damaged``).

    gaps, blank, duplicate, truncated, illegal are counted over the damaged rows in order of turn (nulls first; rows of one
    turn by role and hash of the text); cost and audit are those of the cheapest edits to roles ``(s?(ua)+)?``, ties by the
    least letters; repaired_sha256 is of the repaired ``role:text`` rows, joined by newlines. Rows of a null conv_id are one
    conversation; a null role or text is one space; a conversation without rows after the damage has zeros, an empty
    audit and the hash of the empty string; repeated rows are duplicates; texts and conversations of any length are taken whole; other
    columns aren't read; no rows give none. Rows stream by in order, so a task holds a byte and a reference a row of
    one conversation, and of texts a batch. A conversation's rows are one task's: its audit is one value and its hash goes row by row.
    """
    rows = damaged(conversations)
    found = cut(summaries(rows))
    each = rows.where(~F.col("dropped")).select("conv_id", "turn", "role", F.xxhash64("text").alias("digest"), "text", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("mark"))
    both = each.unionByName(found.withColumn("mark", F.lit(0)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "mark", *ORDER)
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, head = None, None

        def out(done: list[tuple[pa.RecordBatch, str]]) -> pa.RecordBatch:
            whole = pa.Table.from_batches([d for d, _ in done]).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*whole.columns, pa.array([h for _, h in done], pa.string())], names=[*names, "repaired_sha256"])

        for batch in batches:
            done = []
            summary = batch.select(names)
            for i, (mark, role, text, audit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("mark", "role", "text", "audit")), strict=True)):
                if mark:
                    own.add(role, text)
                    continue
                if own is not None:
                    done.append((head, own.digest()))
                own, head = _Repaired(audit), summary.slice(i, 1)
            if done:
                yield out(done)
        if own is not None:
            yield out([(head, own.digest())])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return small_batches(both.select(*names, "mark", "role", "text")).mapInArrow(run, f"{schema}, repaired_sha256 string")


def op12_tight_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))

"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrove.llm._groups import bounds, whole_groups
from tracegrove.llm._tables import bucket_count, bucketed, cut, documents, id_and_text, packed, small_batches, text_bytes, unpacked, unused

#: Edits (code points put in, taken out or replaced) up to which two lines count as one.
EDITS = 2
#: Lines of fewer code points are never taken away, and never a reason to take others away.
LEAST_CHARS = 20
#: Lines of a block in large groups of candidates.
BLOCK = 1024

_BAND = 30  # bits of the band's vectors: one digit of a Python integer
_FULL = (1 << _BAND) - 1
_TOP = 1 << (_BAND - 1)


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 near-equal segments; the longer ones come last."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    out, at = [], 0
    for k in range(parts):
        n = short + (k >= parts - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, length) of the substrings to look up for lines that are as long or shorter.

    Within ``edits``, some segment k of the shorter line stands unchanged in the longer one with at most k
    edits before it and edits - k after it, which leaves few starts.
    """
    out = []
    for other in range(max(edits + 1, length - edits), length + 1):
        d = length - other
        for k, (p, n) in enumerate(segments(other, edits)):
            for start in range(max(0, p - k, p + d - (edits - k)), min(length - n, p + k, p + d + (edits - k)) + 1):
                out.append((other, k, start, n))
    return out


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is ``edits`` at most: a bit-parallel column over the band around the diagonal."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    m, n = len(a), len(b)
    lo, hi = 0, min(m, n)  # the common prefix, by bisection
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    m, n = len(a), len(b)
    if min(m, n) <= edits + 1:
        return _plain(a, b) <= edits if max(m, n) <= 2 * edits + 1 else False
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    # the top bit of column j is row j + edits; bits below are the rows before it
    shift = edits + 1 - _BAND
    up, down = _FULL ^ ((1 << (_BAND - edits - 1)) - 1), 0
    score, most, last = edits, 2 * edits + n - m, _TOP >> 1
    for j, c in enumerate(b):
        w = where.get(c, 0)
        hit = (w >> shift if shift >= 0 else w << -shift) & _FULL
        shift += 1
        zero = ((((hit & up) + up) & _FULL) ^ up) | hit | down
        right_up, right_down = down | (_FULL ^ (zero | up)), zero & up
        if j < m - edits:
            if not zero & _TOP:
                score += 1
                if score > most:
                    return False
        else:
            if right_up & last:
                score += 1
            elif right_down & last:
                score -= 1
            last >>= 1
        half = zero >> 1
        up, down = right_down | (_FULL ^ (half | right_up)), half & right_up
    return score <= edits


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def lines_of(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, pos (from 0), line and its 128-bit hash (h, g), of lines long enough, of rows with an id."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where((F.length("line") >= least) & F.col("line").rlike(r"\S")).select("doc_id", "pos", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def _keys(edits: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, tuple] = {}
        seen: set[int] = set()
        for batch in batches:
            key, line, index = [], [], []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if h in seen:  # a line met before in this task
                    continue
                if len(seen) < 1_000_000:
                    seen.add(h)
                n = len(text)
                if n not in plans:
                    plans[n] = ([(n * 16 + k, p, p + w) for k, (p, w) in enumerate(segments(n, edits))], [(o * 16 + k, s, s + w) for o, k, s, w in probes(n, edits)])
                for flag, plan in enumerate(plans[n]):
                    for tag, s, e in plan:
                        key.append((tag, text[s:e]))
                        line.append(h)
                        index.append(flag == 0)
            if key:
                yield pa.RecordBatch.from_pydict({"tag": pa.array([k[0] for k in key], pa.int64()), "part": pa.array([k[1] for k in key], pa.string()), "h": pa.array(line, pa.int64()), "own": pa.array(index)})

    return run


def candidates(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """cell, h, own: lines that share a key with another line; indexed ones are ``own``, the others probe.

    Segments are indexed by line length and number; lines probe the indexes of their own
    and of shorter lengths. Large groups become a grid: a block of indexed lines with a block of probing ones.
    """
    keys = lines.select("h", "line").mapInArrow(_keys(edits), "tag long, part string, h long, own boolean")
    keys = keys.select(F.xxhash64("tag", "part").alias("key"), "h", "own")
    of = Window.partitionBy("key")
    keys = keys.withColumns({"_lo": F.min("h").over(of), "_hi": F.max("h").over(of), "_own": F.max("own").over(of), "_n": F.count(F.lit(1)).over(of)})
    keys = keys.where("_own AND _lo <> _hi")
    n = F.ceil(F.col("_n") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("h", F.lit(5)), n).cast("int")
    keys = keys.withColumn("_x", F.explode(F.sequence(F.lit(0), n - 1)))
    return keys.select(F.when(F.col("own"), F.xxhash64("key", part, "_x")).otherwise(F.xxhash64("key", F.col("_x"), part)).alias("cell"), "h", "own").distinct()


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each document."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("h", "g", "line", "doc_id", "pos")}
        hashes, wanted = batch.column("hashes").to_pylist(), batch.column("wanted").to_pylist()
        for t, hs, want, doc in zip(unpacked(batch.column("text")), hashes, wanted, batch.column("id").to_pylist(), strict=True):
            own = t.decode().split("\n")
            for w in want:
                if w["pos"] < len(hs or ()) and hs[w["pos"]] == w["h"]:
                    for c, v in (("h", w["h"]), ("g", w["g"]), ("line", own[w["pos"]]), ("doc_id", doc), ("pos", w["pos"])):
                        out[c].append(v)
        types = {"h": pa.int64(), "g": pa.int64(), "line": pa.string(), "doc_id": pa.int64(), "pos": pa.int32()}
        yield pa.RecordBatch.from_pydict({c: pa.array(v, types[c]) for c, v in out.items()})


def repeated(whole: DataFrame, lines: DataFrame, firsts: DataFrame, edits: int = EDITS) -> DataFrame:
    """h, g of the distinct lines that have another line within ``edits`` at an earlier first place.

    The candidates' texts are taken at their first places from ``whole``, the packed documents (id, text, hashes) in buckets
    by id, which later lose the lines; so whole texts are shuffled once.
    """
    cells = cut(candidates(lines, edits))
    wanted = cells.select("h").distinct().join(firsts, "h").groupBy(F.col("first.doc_id").alias("id")).agg(F.collect_list(F.struct("first.pos", "h", "g")).alias("wanted"))
    texts = small_batches(whole.join(wanted, "id")).mapInArrow(_fetch, "h long, g long, line string, doc_id long, pos int").dropDuplicates(["h", "g"])
    cells = cells.join(texts, "h").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            h, g = table.column("h").to_numpy(), table.column("g").to_numpy()
            own, text = np.asarray(table.column("own")), table.column("line").to_pylist()
            place = list(zip(table.column("doc_id").to_pylist(), table.column("pos").to_pylist(), strict=True))
            bag = _bags(text)
            gone: set[tuple[int, int]] = set()
            edge = bounds(table.column("cell").to_numpy())
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                left, right = a + np.flatnonzero(own[a:b]), a + np.flatnonzero(~own[a:b])
                for i in left:
                    near = right[np.abs(bag[right] - bag[i]).sum(1) <= 2 * edits]
                    for j in near:
                        if (h[i], g[i]) == (h[j], g[j]) or place[i] == place[j]:
                            continue
                        late = i if place[i] > place[j] else j
                        if (h[late], g[late]) not in gone and within(text[i], text[j], edits):
                            gone.add((h[late], g[late]))
            yield pa.RecordBatch.from_pydict({"h": pa.array([x[0] for x in gone], pa.int64()), "g": pa.array([x[1] for x in gone], pa.int64())})

    return cells.mapInArrow(run, "h long, g long").distinct()


def _bags(texts: list[str]) -> np.ndarray:
    """Counts of code points by their last five bits; an edit moves two of them by one at most."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) & np.uint32(31)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(row * 32 + codes, minlength=32 * len(texts)).reshape(-1, 32).astype(np.int16)


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """Rows of ``docs`` with repeated lines taken out: new ``text``, and ``n_lines``, ``n_removed``.

    Lines are what stands between line feeds. A line of ``least`` code points or more (and not blank) goes if it is
    not the first of its text, or if some line whose first place, by (doc_id, pos), is earlier lies within ``edits``
    of it; all is judged on the input, so that a line that itself goes still counts. Places that tie (repeated
    rows) don't take each other out. A null text stays null and has no lines, an empty one has one line and stays;
    rows without an id stay as they are. Texts of any length are taken whole, and without rows, there are none. Other
    columns stay, whatever their names, but for ones named n_lines or n_removed.
    """
    rest = docs.drop("n_lines", "n_removed")
    row, hashed, good = unused(rest.columns, "id", "hashes", "good")
    ids = rest.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = lines_of(ids, least)
    firsts = lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    # which lines are long enough and what they hash to, as the other side sees it
    flags = F.transform(F.split("text", "\n"), lambda x: F.when((F.length(x) >= least) & x.rlike(r"\S"), F.xxhash64(x)))
    whole = packed(rest.withColumns({row: F.col("doc_id").cast("long"), hashed: F.when(F.col("doc_id").isNotNull(), flags)}))
    whole = bucketed(whole, row, bucket_count(rest.sparkSession, text_bytes(rest)))
    late = repeated(whole.select(F.col(row).alias("id"), "text", F.col(hashed).alias("hashes")), lines, firsts, edits)
    kept = firsts.join(late, ["h", "g"], "left_anti").select(F.col("first.doc_id").alias(row), F.col("first.pos").alias("pos"), "h")
    kept = kept.groupBy(row).agg(F.collect_list(F.struct("pos", "h")).alias(good))
    joined = whole.join(kept, row, "left").drop(row)
    out = T.StructType([*rest.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, total, removed = [], [], []
            hashes, keeps, raw = batch.column(hashed).to_pylist(), batch.column(good).to_pylist(), batch.column("text").is_null().to_pylist()
            for t, null, hs, keep in zip(unpacked(batch.column("text")), raw, hashes, keeps, strict=True):
                if null:
                    text.append(None)
                    total.append(0)
                    removed.append(0)
                    continue
                own = t.decode().split("\n")
                stay = {(k["pos"], k["h"]) for k in keep or ()}
                left = own if hs is None else [x for p, (x, h) in enumerate(zip(own, hs, strict=True)) if h is None or (p, h) in stay]
                text.append("\n".join(left))
                total.append(len(own))
                removed.append(len(own) - len(left))
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols |= {"text": pa.array(text, pa.string()), "n_lines": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_pydict({f.name: cols[f.name] for f in out})

    return small_batches(joined).mapInArrow(run, out)


def op3_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(id_and_text(documents(spark, sf_dir)))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))



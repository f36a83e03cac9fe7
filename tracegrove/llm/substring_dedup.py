"""Suffix-array dedup: repeated byte strings by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.llm._groups import bounds, whole_groups
from tracegrove.llm._tables import bucket_count, bucketed, cut, documents, id_and_text, packed, text_bytes, unpacked
from tracegrove.llm._text import _BASE, _BASE_INV, _power, distinct_per_text, mix

#: Bytes of a repeated string, and of the k-grams whose minima anchor the strings; shorter ones recur by
#: chance the more often the larger the corpus, longer ones are more in number. Results are the same for any.
LENGTH, GRAM = 50, 24
#: Bytes of text of a bucket, which a task holds whole with its contexts, bytes of anchors of a part, occurrences from which an anchor is spread.
BUCKET_BYTES, PART_BYTES, HOT = 4 << 20, 4 << 20, 20_000

_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- the transform ----------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a symbol array (values under 511) in the order of their first ``depth`` symbols or more, by doubling."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven symbols of nine bits
        key = (key << np.uint64(9)) | padded[k : k + n]
    have = 7
    while True:
        order = np.argsort(key)  # suffixes that are equal so far may come in any order
        run = key[order]
        new = np.concatenate([[0], np.cumsum(run[1:] != run[:-1])]) if n else np.zeros(0, np.int64)
        if have >= depth or (n and new[-1] == n - 1):
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = new.astype(np.uint64) + np.uint64(1)
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - have)] = rank[have:]
        key = rank * np.uint64(n + 2) + ahead
        have *= 2


def classes_of(text: np.ndarray, depth: int) -> np.ndarray:
    """For each position of the text, a number that equal strings of ``depth`` symbols from there on share, and no others.

    Intervals of suffixes with a common prefix are extended backward, breadth first, on the
    Burrows-Wheeler transform: those of common prefixes of length l give the ones of l + 1. Where a
    new interval ends, two neighbours have a longest common prefix of l, met in increasing
    order; an interval that ends where one has ended before isn't extended. At ``depth`` the
    expansion stops: neighbours without an end between them share ``depth`` symbols.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    order = suffix_order(text, depth)
    last = text[order - 1]  # the transform; the first suffix is preceded by the text's last symbol, a separator
    by_symbol = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)  # where the suffix that is one symbol longer stands
    sorted_last = last[by_symbol]
    edge = sorted_last[1:] != sorted_last[:-1]
    following, previous = np.full(n, n), np.full(n, -1)
    following[by_symbol[:-1]] = np.where(edge, n, by_symbol[1:])
    previous[by_symbol[1:]] = np.where(edge, -1, by_symbol[:-1])
    ended = np.zeros(n + 1, bool)
    ended[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(depth):
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        begins = at[previous[at] < np.repeat(lo, size)]
        ends = at[following[at] >= np.repeat(hi, size)]
        lo, hi = np.sort(step[begins]), np.sort(step[ends]) + 1  # of each interval and symbol: its first and last
        new = ~ended[hi]
        # the interval that ends with the whole array has its end from the start, yet leads on to others
        new |= (hi == n) & (lo > 0)
        lo, hi = lo[new], hi[new]
        ended[hi] = True
        if not len(lo):
            break
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(ended[:n])
    return out


# ---- anchors ----------------------------------------------------------------------------


def _slide(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    out = np.concatenate([x, np.full(w, _LAST, np.uint64)])
    have = 1
    while have < w:
        add = min(have, w - have)
        out[: len(out) - add] = np.minimum(out[: len(out) - add], out[add:])
        have += add
    return out[:n]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, hash, first and last window (places in ``data``) of each anchor of the texts between ``offsets``.

    A window of LENGTH bytes belongs to the leftmost least GRAM-byte hash in it. So each window has one anchor,
    equal windows have equal ones at equal distances, and an anchor's windows are a run.
    """
    windows = len(data) - LENGTH + 1
    starts = np.flatnonzero(np.diff(offsets) >= LENGTH)
    if windows <= 0 or not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(data) - GRAM + 1
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(run), "up")[:-1], out=run[1:])
    g = mix((run[GRAM:] - run[:-GRAM]) * _power(_BASE_INV, len(run), "down")[:n])
    # the place as the low bits: of equal hashes, the leftmost is the least, and the least tells its place
    low = _slide((g & ~_PLACE) | np.arange(n, dtype=np.uint64), LENGTH - GRAM + 1)[:windows]
    at = (low & _PLACE).astype(np.int64)
    count = np.diff(offsets)[starts] - LENGTH + 1
    place = np.repeat(offsets[:-1][starts], count) + _ranges(count)
    owner = np.repeat(starts, count)
    at = at[place]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    edge = np.flatnonzero(first)
    return owner[edge], g[at[edge]], place[edge], place[np.append(edge[1:], len(at)) - 1]


#: Low bits of a hash that give way to its place; texts are looked at in chunks and pieces of fewer bytes than that.
_PLACE = np.uint64((1 << 23) - 1)
PIECE = 1 << 18


def _pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed differences, byte plane by byte plane."""
    d = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


# ---- the passes -------------------------------------------------------------------------


def _bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents as a written table of buckets, so that later passes meet them without another shuffle of texts.

    Columns bucket, rid, doc_id, text (packed), copy: whether an equal text stands under a smaller id.
    """
    size = text_bytes(docs)
    buckets = bucket_count(docs.sparkSession, size, BUCKET_BYTES)
    ids = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.octet_length("text").alias("n"))
    least = ids.groupBy("h", "g", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    bucket = lambda d: F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    copies = ids.join(least, ["h", "g", "n"]).where("doc_id > least").select("doc_id", "h").distinct().withColumn("bucket", bucket(None))
    rows = packed(docs.select("doc_id", "text", F.xxhash64("text").alias("h"))).withColumn("bucket", bucket(None))

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        known = set(zip(right.column("doc_id").to_pylist(), right.column("h").to_pylist(), strict=True))
        copy = [x in known for x in zip(left.column("doc_id").to_pylist(), left.column("h").to_pylist(), strict=True)]
        return _sliced(left.select(["bucket", "doc_id", "text"]).append_column("rid", pa.array(np.arange(left.num_rows), pa.int32())).append_column("copy", pa.array(copy, pa.bool_())), 500)

    marked = rows.groupBy("bucket").cogroup(copies.groupBy("bucket")).applyInArrow(mark, "bucket int, doc_id long, text binary, rid int, copy boolean")
    return bucketed(marked, "bucket", buckets, dealt=True), max(1, max(buckets * BUCKET_BYTES, size) // (LENGTH - GRAM + 2) * 12 // PART_BYTES)


def _texts(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, bytes and offsets of about PIECE bytes of texts that are no copies; a row without an id is never judged."""
    own = np.flatnonzero(~np.asarray(table.column("copy")) & ~np.asarray(table.column("doc_id").is_null()))
    held: list[bytes] = []
    rows: list[int] = []
    size = 0

    def chunk() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.array(rows), np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in held])])
        held.clear()
        rows.clear()
        return out

    for k, raw in zip(own.tolist(), unpacked(table.column("text").take(pa.array(own))), strict=True):
        held.append(raw)
        rows.append(k)
        size += len(raw)
        if size >= PIECE:
            yield chunk()
            size = 0
    if held:
        yield chunk()


def _anchored(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """row, hash, first and last window in the text, with the bytes and the text's begin in them, chunk by chunk.

    A very long text comes in pieces that overlap by LENGTH - 1 bytes, so that each window is in one of them.
    """
    for rows, data, offsets in _texts(table):
        if len(data) <= 2 * PIECE:
            text, h, a, b = anchors(data, offsets)
            yield rows[text], h, a - offsets[text], b - offsets[text], data.tobytes(), offsets[text]
            continue
        for row, lo, hi in zip(rows, offsets[:-1], offsets[1:], strict=True):
            for at in range(int(lo), max(int(lo) + 1, int(hi) - LENGTH + 1), PIECE):
                part = data[at : min(int(hi), at + PIECE + LENGTH - 1)]
                _, h, a, b = anchors(part, np.array([0, len(part)]))
                yield np.full(len(h), row), h, a + at - lo, b + at - lo, part.tobytes(), np.full(len(h), lo - at)


def _first_pass(parts: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        # anchors are least hashes and so crowd at the low end; mixed once more, they spread evenly over the parts
        held = [mix(distinct_per_text(h, row, table.num_rows)[0]) for row, h, *_ in _anchored(table)]
        values = np.sort(np.concatenate([np.zeros(0, np.uint64), *held]))
        width = (1 << 64) // parts + 1
        cuts = np.searchsorted(values, np.array([k * width for k in range(1, parts)], np.uint64))
        blobs = [(k, _pack(v)) for k, v in enumerate(np.split(values, cuts)) if len(v)]
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        return pa.table({"part": pa.array([b[0] for b in blobs], pa.int32()), "bucket": pa.array([bucket] * len(blobs), pa.int32()), "anchors": pa.array([b[1] for b in blobs], pa.binary())})

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part, to each bucket: its anchors that other documents hold too, and those held by very many."""
    for table in whole_groups(batches, "part", 1):
        part = table.column("part").to_numpy()
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            values = [_unpack(table.column("anchors")[int(k)].as_py()) for k in own]
            v = np.sort(np.concatenate(values))
            edge = bounds(v)
            c = np.diff(edge)
            v = v[edge[:-1]]
            many, hot = v[c > 1], v[c >= HOT]
            bucket = table.column("bucket").to_numpy()[own]
            out, most = [], []
            for x in values:
                x = x[np.diff(x, prepend=x[:1] ^ np.uint64(1)) != 0]
                out.append(_pack(x[_in(x, many)]))
                most.append(_pack(x[_in(x, hot)]))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "anchors": pa.array(out, pa.binary()), "hot": pa.array(most, pa.binary())})


def _in(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _contexts(left: pa.Table, right: pa.Table) -> pa.Table:
    """The bytes of the runs of windows of anchors that other documents hold, too; ``hot`` marks very frequent ones."""
    many, hot = (np.sort(np.concatenate([np.zeros(0, np.uint64), *(_unpack(b) for b in right.column(c).to_pylist())])) for c in ("anchors", "hot"))
    row, starts, sizes, key, often, context = [], [], [], [], [], []
    for r, h, a, b, raw, base in _anchored(left) if len(many) else ():
        keep = np.flatnonzero(_in(mix(h), many))
        r, h, a, begin, end = r[keep], h[keep], a[keep], (a + base)[keep], (b + base + LENGTH)[keep]
        group = _alike(r, h, begin, end, raw)
        order = np.argsort(group, kind="stable")
        edge = bounds(group[order])
        first = order[edge[:-1]]
        starts.append(a[order])
        sizes.append(np.diff(edge))
        row.append(r[first])
        key.append(h[first])
        often.append(_in(mix(h[first]), hot))
        context += [raw[x:y] for x, y in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
    flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    rows = pa.array(flat(row, np.int64))
    bucket = left.column("bucket")[0].as_py() if left.num_rows else 0
    places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(flat(sizes, np.int64))]), pa.int32()), pa.array(flat(starts, np.int32)))
    cols = {"key": pa.array(flat(key, np.uint64).view(np.int64)), "bucket": pa.array(np.full(len(rows), bucket, np.int32)), "rid": left.column("rid").take(rows), "doc_id": left.column("doc_id").take(rows), "starts": places}
    return _sliced(pa.table({**cols, "context": pa.array(context, pa.binary()), "hot": pa.array(flat(often, bool))}))


def _alike(row: np.ndarray, h: np.ndarray, begin: np.ndarray, end: np.ndarray, raw: bytes) -> np.ndarray:
    """A number that equal contexts of one text share, so that what a text repeats many times is one row."""
    order = np.lexsort((h, row))
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    group = np.arange(len(h))
    seen: dict[tuple[int, bytes], int] = {}
    for k in np.flatnonzero(again).tolist():
        group[k] = seen.setdefault((int(row[k]), raw[begin[k] : end[k]]), k)
    return group


RUNS = "bucket int, rid int, starts array<int>, off int, count int"


def _sliced(table: pa.Table, rows: int = 5000) -> pa.Table:
    """The table in small batches, as each is held whole on its way to the JVM."""
    return pa.Table.from_batches(table.to_batches(max_chunksize=rows), table.schema)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that also start in a document with a smaller id."""
    for table in whole_groups(batches, "key", 15_000):
        doc = table.column("doc_id").to_numpy()
        coded = table.column("context").combine_chunks()
        coded = (coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        key = np.zeros(len(distinct), np.int64)
        key[which] = table.column("key").to_numpy()
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        mixed = n[at] > 1  # anchors in more than one context: their windows can be equal in part
        offsets = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1]
        windows = np.diff(offsets) - LENGTH + 1
        first = np.concatenate([[0], np.cumsum(windows)])
        low = np.repeat(least, windows)  # of each window of each distinct context: the least id of a document with it
        own = np.flatnonzero(mixed)
        if len(own):
            raw = np.frombuffer(distinct.buffers()[2], np.uint8)
            size = np.diff(offsets)[own]
            begin = np.concatenate([[0], np.cumsum(size + 1)])
            text = np.zeros(int(begin[-1]), np.uint16)
            take = np.repeat(offsets[:-1][own], size) + _ranges(size)
            text[np.repeat(begin[:-1], size) + _ranges(size)] = raw[take].astype(np.uint16) + 1
            label = classes_of(text, LENGTH)
            place = np.repeat(begin[:-1], windows[own]) + _ranges(windows[own])
            slot = np.repeat(first[:-1][own], windows[own]) + _ranges(windows[own])
            best = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(best, label[place], low[slot])
            low[slot] = best[label[place]]
        count = windows[which]
        flags = low[np.repeat(first[:-1][which], count) + _ranges(count)] < np.repeat(doc, count)
        row = np.repeat(np.arange(len(doc)), count)
        off = _ranges(count)
        yield _runs(table, flags, row, off)


def _runs(table: pa.Table, flags: np.ndarray, row: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    """Flagged windows as runs: bucket, rid, the places of the context in its text, and off, count within it."""
    inner = np.zeros(len(flags), bool)
    inner[1:] = flags[1:] & flags[:-1] & (row[1:] == row[:-1])
    head = np.flatnonzero(flags & ~inner)
    length = np.diff(np.append(np.flatnonzero((flags & ~inner)[flags]), flags.sum()))
    take = lambda c: table.column(c).combine_chunks().take(pa.array(row[head]))
    return pa.RecordBatch.from_pydict({"bucket": take("bucket"), "rid": take("rid"), "starts": take("starts"), "off": pa.array(off[head], pa.int32()), "count": pa.array(length, pa.int32())})


def _judge_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same where the least ids of each context's windows are known."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        doc = table.column("doc_id").to_numpy()
        low = [np.array(x, np.int64) for x in table.column("low").to_pylist()]
        count = np.array([len(x) for x in low], np.int64)
        row = np.repeat(np.arange(len(doc)), count)
        if len(row):
            yield _runs(table, np.concatenate(low) < np.repeat(doc, count), row, _ranges(count))


def _frequent(contexts: DataFrame) -> DataFrame:
    """Runs of windows of anchors of very many texts, by aggregations that each task begins on its own rows.

    Equal contexts become one with its least id; the windows of what is left are grouped by their bytes, and
    their least ids go back to the contexts, and with those to the texts.
    """
    distinct = contexts.groupBy("key", "context").agg(F.min("doc_id").alias("least"))
    windows = distinct.select("key", "context", "least", F.explode(F.sequence(F.lit(1), F.octet_length("context") - LENGTH + 1)).alias("i")).withColumn("window", F.substring("context", F.col("i"), F.lit(LENGTH)))
    least = windows.groupBy("window").agg(F.min("least").alias("low"))
    of = windows.join(least, "window").groupBy("key", "context").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "low"))), lambda x: x["low"]).alias("low"))
    return contexts.join(of, ["key", "context"]).select("bucket", "rid", "doc_id", "starts", "low").mapInArrow(_judge_known, RUNS)


def _ranges(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)


def _take_out(left: pa.Table, right: pa.Table) -> pa.Table:
    places = right.column("starts").combine_chunks()
    n = np.asarray(places.value_lengths(), np.int64)
    rid, off, count = (np.repeat(right.column(c).to_numpy(), n) for c in ("rid", "off", "count"))
    start = np.asarray(places.flatten(), np.int64) + off
    order = np.argsort(rid, kind="stable")
    rid, start, count = rid[order], start[order], count[order]
    cols: dict[str, list] = {k: [] for k in ("doc_id", "kept", "n_bytes", "n_removed", "n_spans")}
    own, copies, ids = left.column("rid").to_numpy(), np.asarray(left.column("copy")), left.column("doc_id").to_pylist()
    begin, end = np.searchsorted(rid, own), np.searchsorted(rid, own + 1)
    for k, raw in enumerate(unpacked(left.column("text"))):
        a, b = begin[k], end[k]
        if a == b and not copies[k]:
            for c, v in zip(cols, (ids[k], raw, len(raw), 0, 0), strict=True):
                cols[c].append(v)
            continue
        gone = np.zeros(len(raw) + 1, np.int32)
        if copies[k] and len(raw) >= LENGTH:
            gone[0], gone[-1] = 1, -1
        np.add.at(gone, start[a:b], 1)
        np.add.at(gone, start[a:b] + count[a:b] - 1 + LENGTH, -1)
        out = np.cumsum(gone)[:-1] > 0
        cols["doc_id"].append(ids[k])
        cols["kept"].append(np.frombuffer(raw, np.uint8)[~out].tobytes() if out.any() else raw)
        cols["n_bytes"].append(len(raw))
        cols["n_removed"].append(int(out.sum()))
        cols["n_spans"].append(int(np.count_nonzero(np.diff(out.view(np.int8), prepend=np.int8(0)) == 1)))
    return _sliced(pa.table({"doc_id": pa.array(cols["doc_id"], pa.int64()), "kept": pa.array(cols["kept"], pa.binary()), **{c: pa.array(cols[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}}), 500)


def _digest(left: pa.Table, right: pa.Table) -> pa.Table:
    out = _take_out(left, right)
    return out.drop_columns(["kept"]).append_column("kept_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in out.column("kept").to_pylist()], pa.string()))


def dedup_substrings(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, kept (bytes; or kept_sha256 if ``digest``), n_bytes, n_removed, n_spans of each row of ``docs`` (doc_id, text).

    A byte goes if it is covered by a LENGTH-byte string that also starts in a row with a smaller doc_id, as the
    input has it; strings never cross texts. Null and empty texts have no bytes; rows of equal ids
    don't judge each other, but are judged alike; a row without an id stays whole and judges no other. Texts of any
    length are taken whole; columns but doc_id and text aren't read; without rows, there are none.

    Windows are met by their anchors, the least k-gram hashes in them: each anchor that two texts share
    brings the windows around it together, exactly equal contexts become one, and the classes of
    equal windows of the others come from interval expansion. The windows of anchors of very many texts
    are spread, and their least ids found by aggregations.
    """
    table, parts = _bucketed(docs.select("doc_id", "text"))
    first = table.groupBy("bucket").applyInArrow(_first_pass(parts), "part int, bucket int, anchors binary")
    again = first.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_repeated, "bucket int, anchors binary, hot binary")
    contexts = cut(table.groupBy("bucket").cogroup(again.groupBy("bucket")).applyInArrow(_contexts, "key long, bucket int, rid int, doc_id long, starts array<int>, context binary, hot boolean"))
    runs = contexts.where("NOT hot").repartition("key").sortWithinPartitions("key").mapInArrow(_judge, RUNS)
    flags = runs.unionByName(_frequent(contexts.where("hot")))
    both = table.groupBy("bucket").cogroup(flags.groupBy("bucket"))
    if digest:
        return both.applyInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return both.applyInArrow(_take_out, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op5_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(id_and_text(documents(spark, sf_dir)), digest=True)

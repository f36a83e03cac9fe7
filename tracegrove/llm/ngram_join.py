"""N-gram Jaccard join with Bayesian pruning of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.llm._groups import bounds, components, in_blocks, pairs_of, roots, whole_groups
from tracegrove.llm._tables import cut, documents, id_and_text, small_batches, unused
from tracegrove.llm._text import Words, buffer_of, chunks, mix, shingles

SHINGLE = 5
#: The least Jaccard similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: A pair at the threshold shares a bucket but for (1 - 0.8 ** ROWS) ** BANDS = 7e-6.
BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 15, 1e-6
#: Documents of a block in large buckets, and in large groups where texts are compared.
BUCKET_BLOCK, TEXT_BLOCK = 1024, 384

_XOR = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
_MUL = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) | np.uint64(1)


@cache
def needed(threshold: float = NUMERATOR / DENOMINATOR, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of compared values, the fewest matches with a posterior probability of ``tolerance`` or more.

    One byte of each value is kept, so values match with p = s + (1 - s) / 256 at
    similarity s; the prior of p is uniform, the posterior is integrated on a grid.
    """
    p = (np.arange(100_000) + 0.5) / 100_000
    least = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[p >= least].sum() / w.sum() >= tolerance:
                out.append(m)
                break
    return tuple(out)


def surviving(i: np.ndarray, j: np.ndarray, sig: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sizes allow the threshold and that no comparison of signature values rules out."""
    keep = DENOMINATOR * np.minimum(n[i], n[j]) >= NUMERATOR * np.maximum(n[i], n[j])
    i, j = i[keep], j[keep]
    same = np.zeros(len(i), np.int32)
    for k, least in enumerate(needed()):
        part = slice(k * STEP, (k + 1) * STEP)
        same += (sig[i, part] == sig[j, part]).sum(1, dtype=np.int32)
        keep = same >= least
        i, j, same = i[keep], j[keep], same[keep]
    return i, j


#: A class: id and text hash of its least row. Ids may repeat with other texts, so the id alone is none.
NODE = "struct<rep: bigint, t: bigint>"


def _nodes(rep: np.ndarray, t: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(rep, pa.int64()), pa.array(t, pa.int64())], ["rep", "t"])


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n (distinct shingles), digest of the set, one byte of each MinHash value, and bucket numbers of the bands.

    Texts without words, and rows without an id, have n = 0 and no sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                v, off = shingles(Words(*buffer_of(batch.column("text"))), SHINGLE)
                count = np.diff(off)
                full = np.flatnonzero(count)
                low = np.zeros((len(full), HASHES), np.uint64)
                at = off[:-1][full]
                if len(full):
                    for k in range(HASHES):
                        low[:, k] = np.minimum.reduceat((v ^ _XOR[k]) * _MUL[k], at)
                sig = (low >> np.uint64(56)).astype(np.uint8)  # of the least products, the high bits hardly vary
                sig ^= mix(low).astype(np.uint8)
                bucket = np.zeros((len(full), BANDS), np.uint64)
                for r in range(ROWS):
                    bucket = mix(bucket + low[:, r::ROWS])
                bucket ^= _XOR[:BANDS]
                digest = np.zeros((len(full), 2), np.uint64)
                if len(full):
                    digest[:, 0], digest[:, 1] = np.add.reduceat(mix(v + np.uint64(1)), at), np.add.reduceat(mix(v ^ _XOR[7]), at)
                place = np.full(batch.num_rows, -1)
                place[full] = np.arange(len(full))
                place[np.asarray(batch.column("doc_id").is_null())] = -1
                pick = lambda x: pa.array([x[p].tobytes() if p >= 0 else None for p in place], pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "t": batch.column("t"), "n": pa.array(np.where(place >= 0, count, 0), pa.int32()), "digest": pick(digest), "sig": pick(sig), "buckets": pa.array([bucket[p].view(np.int64) if p >= 0 else None for p in place], pa.list_(pa.int64()))})

    return small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("t"))).mapInArrow(run, "doc_id long, t long, n int, digest binary, sig binary, buckets array<long>")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)


def likely(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what survives the pruning in each bucket; a row at most for each document and bucket."""
    rows = classes.select(F.explode("buckets").alias("bucket"), "rep", "t")
    cells = in_blocks(rows, [F.col("bucket")], F.struct("rep", "t"), BUCKET_BLOCK).select("cell", "rep", "t")
    cells = cells.join(classes.select("rep", "t", "n", "sig"), ["rep", "t"])
    cells = cells.repartition("cell").sortWithinPartitions("cell", "rep", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            rep, t, n, sig = *(_column(table, c) for c in ("rep", "t", "n")), _signatures(table)
            found = [surviving(i, j, sig, n) for i, j in pairs_of(bounds(_column(table, "cell")))]
            i, j = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            root = roots(len(rep), i, j)
            own = np.flatnonzero(root != np.arange(len(rep)))
            edge = np.unique(np.column_stack([rep[root[own]], t[root[own]], rep[own], t[own]]), axis=0)
            yield pa.RecordBatch.from_pydict({"a": _nodes(edge[:, 0], edge[:, 1]), "b": _nodes(edge[:, 2], edge[:, 3])})

    return cells.mapInArrow(run, f"a {NODE}, b {NODE}").distinct()


def verified(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """node, links (documents linked to it, without its own copies) and low, its least linked neighbour in a block's component.

    Every pair of a group meets in one cell, is pruned by signature and then compared exactly.
    """
    own = groups.select("node.*", "root")
    cells = in_blocks(own, [F.col("root")], F.struct("rep", "t"), TEXT_BLOCK).select("cell", "lo", "hi", "part", "rep", "t")
    cells = cells.join(classes.select("rep", "t", "n", "sig", "digest", "copies"), ["rep", "t"])
    texts = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("t"), "text")
    cells = cells.join(texts, ["rep", "t"]).repartition("cell").sortWithinPartitions("cell", "rep", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 1):
            v, off = shingles(Words(*buffer_of(table.column("text"))), SHINGLE)
            rows = np.flatnonzero(_matching(v, off, table.column("digest").to_pylist()))
            place = np.column_stack([_column(table, c)[rows] for c in ("cell", "rep", "t")])
            rows = rows[np.concatenate([np.ones(min(1, len(rows)), bool), (place[1:] != place[:-1]).any(1)])]  # one of repeated rows
            table = table.take(pa.array(rows))
            cell, rep, t, n, copies, sig = (*(_column(table, c) for c in ("cell", "rep", "t", "n", "copies")), _signatures(table))
            part, cross = _column(table, "part"), _column(table, "lo") != _column(table, "hi")
            links, at_i, at_j = np.zeros(len(rep), np.int64), [], []
            edge = bounds(cell)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                found = [surviving(i, j, sig[a:b], n[a:b]) for i, j in pairs_of(np.array([0, b - a]))]
                i, j = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
                if cross[a]:
                    apart = part[a + i] != part[a + j]
                    i, j = i[apart], j[apart]
                if len(i):
                    sets = [v[off[r] : off[r + 1]] for r in rows[a:b]]
                    both = _common(sets, i, j)
                    near = DENOMINATOR * both >= NUMERATOR * (n[a + i] + n[a + j] - both)
                    i, j = i[near], j[near]
                    np.add.at(links, a + i, copies[a + j])
                    np.add.at(links, a + j, copies[a + i])
                    at_i.append(a + i)
                    at_j.append(a + j)
            root = roots(len(rep), np.concatenate([np.zeros(0, np.int64), *at_i]), np.concatenate([np.zeros(0, np.int64), *at_j]))
            yield pa.RecordBatch.from_pydict({"node": _nodes(rep, t), "links": pa.array(links), "low": _nodes(rep[root], t[root])})

    return small_batches(cells.select("cell", "lo", "hi", "part", "rep", "t", "n", "sig", "digest", "copies", "text")).mapInArrow(run, f"node {NODE}, links long, low {NODE}")


def _matching(v: np.ndarray, off: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Whether each text is the one that the class was made of."""
    at, full = off[:-1], np.diff(off) > 0
    out = np.zeros(len(at), bool)
    if full.any():
        a, b = np.add.reduceat(mix(v + np.uint64(1)), at[full]), np.add.reduceat(mix(v ^ _XOR[7]), at[full])
        out[full] = [np.array(x, np.uint64).tobytes() == d for x, d in zip(zip(a, b, strict=True), (digests[k] for k in np.flatnonzero(full)), strict=True)]
    return out


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets; many pairs go through products of 0/1 matrices, a slice of shingles at a time."""
    if len(i) <= 2 * len(sets):
        return np.array([_met(sets[a], sets[b]) for a, b in zip(i, j, strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    at = np.full(len(sets), -1)
    at[used] = np.arange(len(used))
    flat, owner = np.concatenate([sets[k] for k in used]), np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    values, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[where] > 1
    col, owner = shared[where[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for lo in range(0, int(shared[-1]) + 1 if len(values) else 0, width):
        a, b = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(used), width), np.float32)
        m[owner[a:b], col[a:b] - lo] = 1
        total += m @ m.T
    return np.rint(total[at[i], at[j]]).astype(np.int64)


def _met(a: np.ndarray, b: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def jaccard_links(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links for each row of ``docs`` (doc_id, text).

    Two documents are linked if their sets of five-word shingles (lower-cased words; a shorter
    text is one shingle) have a Jaccard similarity of 0.8 or more. n_links counts the linked rows,
    copies too; class_id is the least doc_id that links lead to. Texts without words and rows without
    an id have no links and are their own class. Repeated rows count as copies; rows of one id with different
    texts are judged each by its own text. Equal sets are
    one class from the start; large buckets and groups are compared block by block, so that
    no task holds a whole group and no pair becomes a row. Texts of any length are taken whole; columns but doc_id
    and text aren't read; without rows, there are none.
    """
    return _links(docs).drop("t")


def _links(docs: DataFrame) -> DataFrame:
    """The rows of ``jaccard_links``, with the hash t of each row's text."""
    docs = docs.select("doc_id", "text")
    rows = cut(sketch(docs))
    worded = rows.where("n > 0")
    classes = worded.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "t")).alias("node"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("buckets").alias("buckets"))
    classes = cut(classes.select("digest", "node.*", "copies", "n", "sig", "buckets"))
    groups = components(likely(classes))
    checked = cut(verified(docs, classes, groups))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(checked.select(F.col("low").alias("a"), F.col("node").alias("b")).where("a < b"))
    of = classes.select("digest", F.struct("rep", "t").alias("node"), "copies").join(links, "node", "left").join(linked, "node", "left")
    of = of.select("digest", F.coalesce("root", "node")["rep"].alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    near = worded.select("doc_id", "t", "digest").join(of, "digest").select("doc_id", "t", "class_id", "n_links")
    return near.unionByName(rows.where("n = 0").select("doc_id", "t", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with each class cut down to its least doc_id, with their own columns.

    Rows without words or without an id stay, and so do all rows of a class' least id if it repeats; of an id with
    different texts, those go whose own class has a lesser id.
    """
    classes = _links(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    (t,) = unused(docs.columns, "t")
    others = classes.where("class_id <> doc_id").select("doc_id", F.col("t").alias(t)).distinct()
    return docs.withColumn(t, F.xxhash64("text")).join(others, ["doc_id", t], "left_anti").select(*docs.columns)


def op2_bayes_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(id_and_text(documents(spark, sf_dir)))

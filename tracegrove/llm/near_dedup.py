"""Near-duplicate groups: banded MinHash candidates, pruned by sequential Bayesian comparison, survivors checked on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.llm._groups import bounds, components, pairs_of, roots, whole_groups
from tracegrove.llm._tables import cut, documents, id_and_text, packed, small_batches, unpacked
from tracegrove.llm._text import Words, buffer_of, chunks, mix, shingles
from tracegrove.llm.ngram_join import BANDS, DENOMINATOR, HASHES, NODE, NUMERATOR, ROWS, _column, _nodes, _signatures, surviving
from tracegrove.llm.ngram_join import _common as common

SHINGLE = 4
#: A first text is compared with its partners in so many places at most; each place goes through them one by one.
PLACES = 1024
#: Rows of a block in a bucket of several components, and where texts are compared.
BLOCK, TEXTS = 1024, 384
#: Groups with more than this part of all rows, so at most as many groups, are met by a broadcast; and the least of such a size.
HOT_PART, HOT_LEAST = 1000, 1000

_XOR = mix(np.arange(5001, HASHES + 5001, dtype=np.uint64))
_MUL = mix(np.arange(7001, HASHES + 7001, dtype=np.uint64)) | np.uint64(1)

#: Lower-cases A-Z; white space is 0, and byte 0 is what no UTF-8 text holds.
PLAIN_BYTES = np.arange(256, dtype=np.uint8)
PLAIN_BYTES[0x41:0x5B] += 32
PLAIN_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
PLAIN_BYTES[0] = 0xFF


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, flat, and offsets."""
    return shingles(Words(*buffer_of(texts), PLAIN_BYTES), SHINGLE)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n (distinct shingles), and of texts with words and an id: digest of the set, a byte of each MinHash value, bands' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                v, off = sets(batch.column("text"))
                count = np.diff(off)
                full = np.flatnonzero(count)
                at = off[:-1][full]
                low = np.zeros((len(full), HASHES), np.uint64)
                digest = np.zeros((len(full), 2), np.uint64)
                if len(full):
                    for k in range(HASHES):
                        low[:, k] = np.minimum.reduceat((v ^ _XOR[k]) * _MUL[k], at)
                    digest[:, 0], digest[:, 1] = np.add.reduceat(mix(v + np.uint64(3)), at), np.add.reduceat(mix(v ^ _XOR[5]), at)
                sig = mix(low).astype(np.uint8)
                bucket = np.tile(_XOR[:BANDS], (len(full), 1))
                for r in range(ROWS):
                    bucket = mix(bucket + low[:, r::ROWS])
                place = np.full(batch.num_rows, -1)
                place[full] = np.arange(len(full))
                place[np.asarray(batch.column("doc_id").is_null())] = -1
                binary = lambda x, place=place: pa.array([x[p].tobytes() if p >= 0 else None for p in place], pa.binary())
                buckets = pa.array([bucket[p].view(np.int64) if p >= 0 else None for p in place], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "t": batch.column("t"), "n": pa.array(count, pa.int64()), "digest": binary(digest), "sig": binary(sig), "buckets": buckets})

    return small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("t"))).mapInArrow(run, "doc_id long, t long, n long, digest binary, sig binary, buckets array<long>")


def beside(rows: DataFrame, groups: DataFrame, key: str, size: Column, total: int) -> DataFrame:
    """Rows with their group's columns; groups of more than a thousandth of ``total`` rows (a thousand groups at most) are broadcast, so none meets its rows in one task."""
    large = size > max(total // HOT_PART, HOT_LEAST)
    hot = groups.where(large)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(~large), key)
    return rows.join(F.broadcast(hot), key).unionByName(others)


def _headed(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Rows of pairs (a, b) with ``column`` of ``table`` (node): that of ``a`` is in front of those of its ``b``, once a place.

    Partners are dealt over PLACES places, whatever their number, so a row that very many pairs have as ``a`` is no task's own.
    """
    dealt = pairs.withColumn("place", F.pmod(F.xxhash64("b", F.lit(3)), F.lit(PLACES)))
    heads = dealt.select("a", "place").distinct().join(table.select(F.col("node").alias("a"), "n", column), "a").select("a", "place", F.col("a").alias("b"), F.lit(True).alias("head"), "n", column)
    rows = dealt.join(table.select(F.col("node").alias("b"), "n", column), "b").select("a", "place", "b", F.lit(False).alias("head"), "n", column)
    both = heads.unionByName(rows).repartition("a", "place").sortWithinPartitions("a", "place", F.desc("head"))
    return both.select("a", "b", "head", "n", column)


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of rows, each with the row number of its head; a run's head is repeated in front where it began in an earlier one."""
    last: pa.Table | None = None
    for whole in batches:
        for lo in range(0, whole.num_rows, size):
            own = pa.Table.from_batches([whole.slice(lo, size)])
            table = (own if last is None else pa.concat_tables([last, own])).combine_chunks()
            head = table.column("head").to_numpy()
            at = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            last = table.slice(int(at[-1]), 1)
            yield table, at


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that the comparison of signatures, some values at a time, leaves a posterior probability of reaching the threshold above the tolerance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _slices(batches, 8192):
            sig = _signatures(table)
            j = np.flatnonzero(~table.column("head").to_numpy())
            _, j = surviving(at[j], j, sig, table.column("n").to_numpy())
            out = table.select(["a", "b"]).take(pa.array(j))
            yield from out.combine_chunks().to_batches()

    return _headed(pairs, classes, "sig").mapInArrow(run, f"a {NODE}, b {NODE}")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _slices(batches, 256):
            raw = list(unpacked(table.column("text").combine_chunks()))
            v, off = sets(pa.array(raw, pa.binary()).cast(pa.string()))
            keep = []
            for j in np.flatnonzero(~table.column("head").to_numpy()):
                a, b = (v[off[k] : off[k + 1]] for k in (at[j], j))
                if DENOMINATOR * min(len(a), len(b)) >= NUMERATOR * max(len(a), len(b)) > 0:
                    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                    if DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both):
                        keep.append(j)
            yield from table.select(["a", "b"]).take(pa.array(np.array(keep, np.int64))).combine_chunks().to_batches()

    return small_batches(_headed(pairs, texts, "text")).mapInArrow(run, f"a {NODE}, b {NODE}")


def apart(members: DataFrame, classes: DataFrame, known: DataFrame, total: int, best: bool) -> DataFrame:
    """Pairs (a, b) of one bucket and different components so far that signatures don't rule out.

    In a bucket, rows outside its largest component meet all others, block by block; so a large group with few rows apart
    takes a row each. If ``best``, there is a pair for each row and block, with its likest partner; else as many as connect all rows
    of a block that such pairs connect. So no more pairs than rows come of a block.
    """
    rows = members.join(known, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    per = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = per.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1")
    mixed = cut(mixed.select("bucket", F.col("top.root").alias("major"), "c", F.ceil(F.col("c") / BLOCK).cast("int").alias("all"), F.ceil((F.col("c") - F.col("top.c")) / BLOCK).cast("int").alias("few")))
    met = beside(rows, mixed, "bucket", F.col("c"), total)
    every = met.withColumns({"i": F.pmod(F.xxhash64("node"), F.col("all")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("few") - 1))}).withColumn("minor", F.lit(False))
    minor = met.where("root <> major").withColumns({"j": F.pmod(F.xxhash64("node", F.lit(1)), F.col("few")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("all") - 1))}).withColumn("minor", F.lit(True))
    cells = every.unionByName(minor, allowMissingColumns=True).select(F.xxhash64("bucket", "i", "j").alias("cell"), "node", "minor", "root")
    cells = cells.join(classes.select("node", "n", "sig"), "node").withColumn("part", F.xxhash64("root"))
    cells = cells.repartition("cell").sortWithinPartitions("cell", "minor", "node").select("cell", "node", "minor", "part", "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            sig, own = _signatures(table), _pairs(table)
            minor, part, n = (_column(table, c) for c in ("minor", "part", "n"))
            edge = bounds(_column(table, "cell"))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                few, rest = lo + np.flatnonzero(minor[lo:hi]), lo + np.flatnonzero(~minor[lo:hi])
                found = []
                for at in range(0, len(few), 256):
                    i, j = np.repeat(few[at : at + 256], len(rest)), np.tile(rest, len(few[at : at + 256]))
                    other = part[i] != part[j]
                    i, j = surviving(i[other], j[other], sig, n)
                    if best and len(i):
                        order = np.lexsort((j, -(sig[i] == sig[j]).sum(1), i))
                        i, j = i[order], j[order]
                        first = np.concatenate([[True], i[1:] != i[:-1]])
                        i, j = i[first], j[first]
                    found.append((i, j))
                i, j = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
                if not len(i):
                    continue
                x, y = (own[i], own[j]) if best else _forest(own[lo:hi], i - lo, j - lo)
                yield pa.RecordBatch.from_pydict({"x": _nodes(x[:, 0], x[:, 1]), "y": _nodes(y[:, 0], y[:, 1])})

    found = cells.mapInArrow(run, f"x {NODE}, y {NODE}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _pairs(table: pa.Table) -> np.ndarray:
    """The nodes of a table's rows, as rows of two numbers."""
    node = table.column("node").combine_chunks()
    return np.column_stack([node.field(k).to_numpy(zero_copy_only=False) for k in ("rep", "t")])


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that connect what the pairs of rows do, one less than there are nodes in each component."""
    own, at = np.unique(nodes, axis=0, return_inverse=True)
    at = at.ravel()
    root = roots(len(own), at[i], at[j])
    k = np.flatnonzero(root != np.arange(len(own)))
    return own[root[k]], own[k]


def settled(near: DataFrame, known: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) within the groups that ``near`` connects, between components so far (``known``); as many as connect what all links connect.

    Each pair of a group meets in one cell of two blocks, is pruned by signature and compared on whole sets.
    """
    own = components(near).select("node", F.col("root").alias("group")).join(known, "node", "left").select("node", "group", F.xxhash64(F.coalesce("root", "node")).alias("root"))
    own = cut(own)
    met = beside(own, own.groupBy("group").agg(F.count(F.lit(1)).alias("c")), "group", F.col("c"), own.count()).withColumn("blocks", F.ceil(F.col("c") / TEXTS).cast("int"))
    met = met.withColumns({"part": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    cells = met.select(F.xxhash64("group", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "root", "node")
    cells = cells.join(classes.select("node", "n", "sig"), "node").join(texts.select("node", "text"), "node").repartition("cell").sortWithinPartitions("cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 1):
            sig, n, nodes = _signatures(table), _column(table, "n"), _pairs(table)
            part, root, cross = _column(table, "part"), _column(table, "root"), _column(table, "lo") != _column(table, "hi")
            edge = bounds(_column(table, "cell"))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                found = []
                for i, j in pairs_of(np.array([0, b - a])):
                    apart = (root[a + i] != root[a + j]) & (not cross[a] or part[a + i] != part[a + j])
                    found.append(surviving(a + i[apart], a + j[apart], sig, n))
                i, j = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
                if not len(i):
                    continue
                v, off = sets(pa.array(list(unpacked(table.column("text").slice(a, b - a).combine_chunks())), pa.binary()).cast(pa.string()))
                own = [v[off[k] : off[k + 1]] for k in range(b - a)]
                both = common(own, i - a, j - a)
                linked = DENOMINATOR * both >= NUMERATOR * (n[i] + n[j] - both)
                x, y = _forest(nodes[a:b], i[linked] - a, j[linked] - a)
                yield pa.RecordBatch.from_pydict({"a": _nodes(x[:, 0], x[:, 1]), "b": _nodes(y[:, 0], y[:, 1])})

    return small_batches(cells).mapInArrow(run, f"a {NODE}, b {NODE}")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text).

    A text's set are its distinct four-word shingles (words between ASCII white space, A-Z in lower case; fewer words are one
    shingle). Texts with a Jaccard similarity of 0.8 or more are linked; component_id is the least doc_id that links lead
    to, kept is whether it is the row's own. Texts without words, null ones too, have no shingle and no link. Rows without an id are
    linked with nothing, have no component and are kept. Repeated rows are kept or not together; rows of one id with different texts are
    judged each by its own. Texts of any length are taken whole; other columns aren't read; no rows give none.

    Equal sets are one class from the start. In each bucket, all rows first meet its least one; what isn't connected then
    meets its likest row of another component, and what still isn't, all rows that signatures don't rule out, block by block. Every
    link between components is found but for what bands and tolerance miss; links within a component needn't be.
    """
    docs = docs.select("doc_id", "text")
    rows = cut(sketch(docs))
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "t")).alias("node"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("buckets").alias("buckets"))
    classes = cut(classes)
    total = rows.count()
    spread = classes.select(F.explode("buckets").alias("bucket"), "node")
    pivots = cut(spread.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    members = cut(beside(spread, pivots, "bucket", F.col("c"), BANDS * total).select("bucket", "node", "pivot"))
    needed = classes.select("node", "n").join(members.select("node").distinct(), "node")
    texts = packed(docs.select(F.struct(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("t")).alias("node"), "text"))
    texts = cut(texts.join(needed, "node").dropDuplicates(["node"]))

    first = likely(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), classes)
    edges = cut(linked(first, texts))
    # rows of one label are connected; the rest is left to the next steps
    label = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    likest = cut(apart(members, classes, label, BANDS * total, True))
    edges = edges.unionByName(linked(likest, texts))
    known = cut(components(edges))
    near = cut(apart(members, classes, known, BANDS * total, False))
    if not near.isEmpty():
        star = known.select(F.col("root").alias("a"), F.col("node").alias("b"))
        known = components(star.unionByName(settled(near, known, classes, texts)))
    of = classes.join(known, "node", "left").select("digest", "copies", F.coalesce("root", "node")["rep"].alias("component_id"))
    sketched = beside(rows.where("digest IS NOT NULL").select("doc_id", "n", "digest"), of, "digest", F.col("copies"), total).select("doc_id", "n", "component_id")
    plain = rows.where("digest IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return sketched.unionByName(plain).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_sequential_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(id_and_text(documents(spark, sf_dir)))

"""Grouped work in Python workers on sorted partitions, and connected components on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrove.llm._tables import cut


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 4000) -> Iterator[pa.Table]:
    """Joins the batches of a partition sorted by ``key`` to tables that hold whole groups, of ``least`` rows or one group at least."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        same = np.flatnonzero(keys != keys[-1])
        upto = int(same[-1]) + 1 if len(same) else 0
        if upto:
            yield table.slice(0, upto).combine_chunks()
            held = table.slice(upto).to_batches()
            rows -= upto
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(keys: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def pairs_of(off: np.ndarray, small: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within each run, as arrays of row numbers of bounded length."""
    size = np.diff(off)
    run = np.repeat(np.arange(len(size)), size)
    little = np.repeat(size <= small, size)
    rows = np.arange(int(off[-1]))
    for d in range(1, int(size[size <= small].max(initial=1))):
        i = rows[:-d][little[:-d] & (run[d:] == run[:-d])]
        if len(i):
            yield i, i + d
    for k in np.flatnonzero(size > small):
        own = np.arange(off[k], off[k + 1])
        for at in range(0, len(own), 256):
            part = own[at : at + 256]
            i, j = np.repeat(part, len(own)), np.tile(own, len(part))
            keep = i < j
            yield i[keep], j[keep]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row number in each row's connected component."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def in_blocks(rows: DataFrame, key: list[Column], member: Column, block: int, name: str = "cell") -> DataFrame:
    """Groups of two or more rows, those beyond ``block`` rows as pairs of blocks, so that no task holds a whole large group.

    Rows whose key is null are left out. Adds ``name``, the group or pair of blocks as a 64-bit number, and ``lo``, ``hi``, ``part``: the
    pair's blocks and the row's own. Any two rows of a group meet in exactly one cell if
    they are of two blocks; two rows of block b also meet in the cell (b, b).
    """
    keys = [f"_k{i}" for i in range(len(key))]
    rows = rows.withColumns(dict(zip(keys, key, strict=True)))
    # counted from the map side on, and joined back: a large group is never in one task
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = rows.join(sizes, keys)
    blocks = F.ceil(F.col("_n") / block).cast("int")
    rows = rows.withColumn("_b", blocks).withColumn("part", F.pmod(F.xxhash64(member, F.lit(17)), F.col("_b")).cast("int"))
    rows = rows.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    rows = rows.withColumns({"lo": F.least("part", "_x"), "hi": F.greatest("part", "_x")})
    return rows.withColumn(name, F.xxhash64(*keys, "lo", "hi")).drop("_n", "_b", "_x", *keys)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for the nodes of ``edges`` (a, b).

    Alternating large-star and small-star steps; the edges never grow in number, each round is
    written to the checkpoint folder, and all that comes to the driver is a count and a checksum.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    seen = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b")
        e = cut(small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct())
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

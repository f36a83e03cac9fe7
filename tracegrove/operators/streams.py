"""Many queries against stored blocks without a shuffle of their product: a task holds a group of queries, and all blocks stream by it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.sources.store import kept

#: Bytes after which Spark ends a batch for a task: blocks are large, and each is taken alone.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
#: Queries of a group at most, and so many at least before there are more groups than one, up to one for each core.
MOST, LEAST = 10_000, 64


class Group(Protocol):
    """What a task keeps of its queries."""

    def take(self, block: pa.RecordBatch) -> None: ...

    def result(self) -> Iterator[pa.RecordBatch]: ...


def as_bytes(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def of_bytes(value: pa.Scalar) -> pa.RecordBatch:
    (batch,) = pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks().to_batches() or [None]
    return batch


def one_row(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """Columns of any lengths as one row of lists."""
    arrays = {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in columns.items()}
    return pa.RecordBatch.from_pydict({c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in arrays.items()})


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list of each array."""
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat).cast(kind))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile hand small batches to tasks."""
    key, most = BATCH
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def groups(queries: DataFrame) -> DataFrame:
    """asks: the queries (qid, ...), stored ones, packed in a row for each group by hash of the qid, a group a partition."""
    count = queries.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(cores, -(-count // LEAST))) * max(1, -(-count // (cores * MOST)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_pydict({"asks": pa.array([as_bytes(pa.Table.from_batches(held).drop_columns("_group").combine_chunks())], pa.binary())})

    return queries.withColumn("_group", F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int")).repartitionById(n, "_group").mapInArrow(run, "asks binary")


def _product(blocks: DataFrame, queries: DataFrame, make: Callable[[pa.RecordBatch], Group], schema: str) -> DataFrame:
    pairs = blocks.coalesce(1).hint("shuffle_replicate_nl").crossJoin(groups(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for batch in batches:
            for block, asks in zip(batch.column("block"), batch.column("asks"), strict=True):
                group = make(of_bytes(asks)) if group is None else group
                group.take(of_bytes(block))
        if group is not None:
            yield from group.result()

    return pairs.mapInArrow(run, schema)


def against(blocks: DataFrame, queries: DataFrame, make: Callable[[pa.RecordBatch], Group], schema: str) -> DataFrame:
    """What each group of queries finds in all stored blocks (``block``, binary), kept.

    The product is a nested loop of partitions: each task has one group and reads the blocks from where they lie, one after the
    other. So blocks are read once a group, and nothing but the queries is dealt out; a task holds a group and a few blocks. Time
    grows with queries times blocks.
    """
    with small_batches(queries.sparkSession):
        return kept(_product(blocks, queries, make, schema))

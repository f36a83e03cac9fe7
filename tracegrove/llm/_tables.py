"""Loading and small helpers shared by the queries of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that most operators read; others keep out of the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that none of the columns has, in either case."""
    have = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with columns of the given names called otherwise, and what turns a result with those names back to the rows' own columns."""
    wanted = {n.lower() for n in names}
    clash = [c for c in docs.columns if c.lower() in wanted]
    new = dict(zip(clash, unused([*docs.columns, *names], *clash), strict=True))
    return docs.withColumnsRenamed(new), lambda out: out.drop(*names).withColumnsRenamed({v: k for k, v in new.items()}).select(*docs.columns)


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on, the session's batches to Python workers hold few of them, as single texts can be long.

    Spark takes the number from the session when a plan runs, which is after the caller gets it; so it stays at 1000 at most.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= 1000:
        df.sparkSession.conf.set(key, "1000")
    return df


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all runs on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tracegrove-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows to the shared checkpoint folder, compressed, and reads them back."""
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/tracegrove/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    _written.setdefault(spark.sparkContext.applicationId, []).append(("", at))
    return spark.read.schema(df.schema).parquet(at)


_written: dict[str, list[tuple[str, str]]] = {}


def clear(spark: SparkSession) -> int:
    """Removes what ``cut`` and ``bucketed`` wrote in this application, once results are written elsewhere; how many tables and folders."""
    gone = _written.pop(spark.sparkContext.applicationId, [])
    for name, at in gone:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, results are made and written; at its end, what was written in between is removed."""
    before = _written.pop(spark.sparkContext.applicationId, [])
    try:
        yield
    finally:
        clear(spark)
        _written[spark.sparkContext.applicationId] = before


def packed(docs: DataFrame, column: str = "text") -> DataFrame:
    """The column as zstandard frames, so that whole texts take less of a shuffle; a null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols[column] = pa.array([None if t is None else press.compress(t) for t in batch.column(column).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_pydict(cols)

    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType) for f in docs.schema])
    return small_batches(docs).mapInArrow(run, schema)


def unpacked(column: pa.Array) -> Iterator[bytes]:
    """The texts' bytes, one by one; a null is an empty text."""
    expand = zstandard.ZstdDecompressor()
    for t in column:
        yield expand.decompress(t.as_buffer()) if t.is_valid else b""


#: Bytes of text of a bucket.
BUCKET_BYTES = 16 << 20


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def bucket_count(spark: SparkSession, size: int, least: int = BUCKET_BYTES) -> int:
    """Buckets of about ``least`` bytes for ``size`` bytes of text, and as many as there are shuffle partitions, so that joins keep to the buckets.

    Spark refuses more than the session's maxBuckets; beyond those, buckets grow with the input.
    """
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // least)))


def bucketed(df: DataFrame, column: str, buckets: int, dealt: bool = False) -> DataFrame:
    """A written table of buckets by ``column``, in the shared checkpoint folder: several joins meet it without another shuffle of its rows."""
    spark = df.sparkSession
    name = f"tracegrove_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, column)
    at = f"{checkpoint_dir(spark)}/{name}"
    rows.write.bucketBy(buckets, column).option("path", at).option("compression", "zstd").saveAsTable(name)
    _written.setdefault(spark.sparkContext.applicationId, []).append((name, at))
    return spark.table(name)

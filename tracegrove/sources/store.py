"""Stored forms of tables, built once for each state of their input."""

from __future__ import annotations

import gc
import hashlib
import inspect
import tempfile
import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all runs on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tracegrove-"))


def _system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def state_of(spark: SparkSession, path: str) -> str:
    """A name for the present state of a table's files: path, bytes, number of files and time of the last change of its folder."""
    fs, at = _system(spark, path)
    whole = fs.getContentSummary(at)
    said = f"{fs.makeQualified(at)}|{whole.getLength()}|{whole.getFileCount()}|{fs.getFileStatus(at).getModificationTime()}"
    return hashlib.md5(said.encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _system(spark, path)
    return fs.exists(at)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder; whether it did (not if the target is there already)."""
    fs, at = _system(spark, source)
    to = _system(spark, target)[1]
    fs.mkdirs(to.getParent())
    return not fs.exists(to) and fs.rename(at, to)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _system(spark, path)
    fs.delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what has been written; it does once the plans are collected as garbage, on the driver, where there may be no need to for long."""
    gc.collect()
    spark._jvm.System.gc()


def stored(spark: SparkSession, inputs: list[str], kind: str, build: Callable[[str], None], by: ModuleType | None = None) -> str:
    """Where the stored form ``kind`` of tables lies; built beside and moved there if it isn't there yet, so a half-built one is never read.

    It goes by the state of the inputs and of the module that builds it.
    """
    states = [inspect.getsource(by) if by else "", *(state_of(spark, p) for p in inputs)]
    name = hashlib.md5("|".join(states).encode()).hexdigest()
    at = f"{shared_dir(spark)}/tracegrove-stores/{kind}-{name}"
    if not exists(spark, at):
        beside = f"{at}.{uuid.uuid4().hex}"
        build(beside)
        release(spark)
        if not move(spark, beside, at):
            remove(spark, beside)
    return at


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back, so that a lost executor costs no more than what is read."""
    at = f"{shared_dir(df.sparkSession)}/tracegrove-work/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    fs, at = _system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def touch(spark: SparkSession, path: str) -> None:
    fs, at = _system(spark, path)
    fs.create(at, True).close()


def unique() -> str:
    return uuid.uuid4().hex

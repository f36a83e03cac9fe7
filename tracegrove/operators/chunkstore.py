"""A store of embedded chunks that is brought up to date: what changed is embedded, what is gone is marked, nothing is stored twice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.operators import cells, dense
from tracegrove.sources import store

#: What tells chunks apart.
KEY = ["repo", "path", "start_line", "content_hash"]
ROWS = "repo string, path string, start_line int, end_line int, content string, content_hash string, language string"
VECTORS = "content_hash string, vector array<float>"
CHUNKS = f"{ROWS}, vector array<float>"
#: Updates after which a store is written anew.
COMPACT = 16


@dataclass
class Update:
    """Chunks that came and went, texts that were embedded, and texts that couldn't be."""

    added: int
    embedded: int
    removed: int
    failed: int = 0


class ChunkStore:
    """A folder of numbered updates: each has the chunks that came (``added``), the keys of those that went (``gone``) and the vectors of new texts.

    A vector lies by the hash of its text, apart from the chunks, so contents meet neither vectors nor each other in a join.
    An update is written beside and renamed, so a reader sees all of it or nothing, and of two at the same time the second fails.
    A whole one (``base``) stands for all before it. There are COMPACT others after it at most, so a look at the store opens few folders.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: Callable[[pd.Series], np.ndarray] | None = None):
        self.spark, self.path, self.embedder = spark, path, embedder

    def versions(self) -> list[int]:
        """Numbers of the updates from the last whole one on."""
        names = store.names(self.spark, self.path)
        done = sorted(int(n.split("-")[1]) for n in names if n.startswith("v-"))
        base = max((v for v in done if f"base-{v}" in names), default=0)
        return [v for v in done if v >= base]

    def _read(self, kind: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, version int")
        for v in self.versions():
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/v-{v}/{kind}").withColumn("version", F.lit(v)))
        return out

    def rows(self) -> DataFrame:
        """The chunks that are there now, without vectors: the last version of each that came and hasn't gone since."""
        rows = self._read("added", ROWS)
        if len(self.versions()) < 2:
            return rows.drop("version")
        gone = self._read("gone", "repo string, path string, start_line int, content_hash string").groupBy(*KEY).agg(F.max("version").alias("gone"))
        same = [rows[k].eqNullSafe(gone[k]) for k in KEY]
        return rows.join(gone, [*same, gone["gone"] >= rows["version"]], "left_anti").drop("version")

    def vectors(self) -> DataFrame:
        """content_hash, vector: one of each text that came, also of those that went."""
        every = self._read("vectors", VECTORS)
        if len(self.versions()) < 2:
            return every.drop("version")
        return every.groupBy("content_hash").agg(F.max_by("vector", "version").alias("vector"))

    def chunks(self) -> DataFrame:
        """The chunks that are there now, with their vectors."""
        columns = [c.split()[0] for c in CHUNKS.split(", ")]
        return self.rows().join(self.vectors(), "content_hash").select(*columns)

    def _write(self, added: DataFrame, gone: DataFrame, vectors: DataFrame | None = None, base: bool = False) -> None:
        at, v = f"{self.path}/tmp-{store.unique()}", max(self.versions(), default=0) + 1
        added.select(*(c.split()[0] for c in ROWS.split(", "))).write.option("compression", "zstd").parquet(f"{at}/added")
        (self.spark.createDataFrame([], VECTORS) if vectors is None else vectors.select("content_hash", "vector")).write.option("compression", "zstd").parquet(f"{at}/vectors")
        gone.select(*KEY).write.parquet(f"{at}/gone")
        if not store.move(self.spark, at, f"{self.path}/v-{v}"):
            store.remove(self.spark, at)
            raise RuntimeError(f"another update of {self.path} came first")
        if base:
            store.touch(self.spark, f"{self.path}/base-{v}")

    def update(self, files: DataFrame) -> Update:
        """Brings the store to the chunks of files (repo, path, content), all there are.

        Chunks are compared by key; only texts whose hash has no vector yet are embedded, each once. What can't be
        embedded isn't stored, is counted as ``failed``, and is tried again by the next update. Chunks of files that are no longer there go.
        """
        new = _once(store.kept(dense.chunk_windows(files).withColumn("content", F.substring("content", 1, dense.CONTENT_LIMIT))))
        if self.versions():
            old = self.rows()
            came = _of(new, store.kept(_of(new.select(*KEY), old, "left_anti")), "left_semi")
            gone = store.kept(_of(old.select(*KEY), new, "left_anti"))
            have = self.vectors().join(old.select("content_hash").distinct(), "content_hash", "left_semi")
        else:
            came, gone, have = new, self.spark.createDataFrame([], ROWS), self.spark.createDataFrame([], VECTORS)
        texts = came.select("content_hash", F.substring("content", 1, dense.EMBED_LIMIT).alias("content")).dropDuplicates(["content_hash"])
        texts = texts.join(have, "content_hash", "left_anti") if self.versions() else texts
        tried = store.kept(dense.embed(texts, self.embedder).select("content_hash", "vector"))
        fresh, failed = tried.where("vector IS NOT NULL"), tried.where("vector IS NULL").select("content_hash")
        embedded = fresh.count()
        missed = tried.count() - embedded
        added = came.join(failed, "content_hash", "left_anti") if missed else came
        counts = Update(added.count(), embedded, gone.count(), missed)
        if counts.added or counts.removed:
            self._write(added, gone, fresh)
            self.compact()
        return counts

    def remove_repo(self, repo: str) -> int:
        """Marks all chunks of a repository as gone; how many."""
        gone = store.kept(self.rows().where(F.col("repo") == repo).select(*KEY))
        n = gone.count()
        if n:
            self._write(self.spark.createDataFrame([], CHUNKS), gone)
        return n

    def compact(self, most: int = COMPACT) -> bool:
        """Writes the store anew once there are more than ``most`` updates; whether it did."""
        if len(self.versions()) <= most:
            return False
        rows = self.rows()
        vectors = self.vectors().join(rows.select("content_hash").distinct(), "content_hash", "left_semi")
        self._write(rows, self.spark.createDataFrame([], ROWS), vectors, base=True)
        return True

    def search_cells(self) -> cells.VectorCells:
        """Cells of the present chunks' vectors, by ``chunk_id``; built once for each state of the store."""
        at = f"{self.path}/cells-{max(self.versions(), default=0)}"
        if not store.exists(self.spark, at):
            beside = f"{at}.{store.unique()}"
            cells.build(store.kept(with_id(self.chunks()).select("id", "repo", "vector")), beside)
            if not store.move(self.spark, beside, at):
                store.remove(self.spark, beside)
        return cells.VectorCells(self.spark, at)


def _of(chunks: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """Chunks by whether their keys are among the others' (``left_semi`` or ``left_anti``); keys may hold nulls."""
    keys = others.select(*(F.col(k).alias(f"_{k}") for k in KEY))
    return chunks.join(keys, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY], how)


def _once(chunks: DataFrame) -> DataFrame:
    """Stored chunks, one of each key. Keys alone are dealt out to find those that are there several times; only chunks with such a key meet."""
    twice = store.kept(chunks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY))
    if not twice.count():
        return chunks
    return _of(chunks, twice, "left_anti").unionByName(_of(chunks, twice, "left_semi").dropDuplicates(KEY))


def with_id(chunks: DataFrame) -> DataFrame:
    """Chunks with ``id``, a hash of their key."""
    return chunks.withColumn("id", F.md5(F.concat_ws("\n", *(F.coalesce(F.col(k).cast("string"), F.lit("\1")) for k in KEY))))

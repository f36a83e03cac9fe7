"""Dense lane: chunks, embeddings, nearest neighbours."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrove.config import DEFAULT
from tracegrove.functions.text import infer_language, strip
from tracegrove.functions.vectors import cosine

#: Longest content of a stored chunk, and of what is embedded, in characters.
CONTENT_LIMIT, EMBED_LIMIT = 65535, 1500


def chunk_windows(files: DataFrame, window: int = DEFAULT.chunk_window, overlap: int = DEFAULT.chunk_overlap) -> DataFrame:
    """Overlapping runs of lines: repo, path, start_line (from 1), end_line, content, content_hash, language.

    Windows begin every ``window - overlap`` lines until one reaches the end; blank ones are left out.
    """
    step = max(window - overlap, 1)
    rows = files.select("repo", "path", F.split("content", "\n").alias("lines"))
    rows = rows.withColumn("n", F.size("lines"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(step))))
    rows = rows.where((F.col("at") == 0) | (F.col("at") - step + window < F.col("n")))
    end = F.least(F.col("at") + window, F.col("n"))
    rows = rows.withColumns({"end_line": end, "content": F.array_join(F.slice("lines", F.col("at") + 1, end - F.col("at")), "\n")})
    rows = rows.where(strip(F.col("content")) != "")
    return rows.select("repo", "path", (F.col("at") + 1).alias("start_line"), "end_line", "content", F.md5(F.col("content")).alias("content_hash"), infer_language(F.col("path")).alias("language"))


def hash_embedder(dim: int = 64) -> Callable[[pd.Series], np.ndarray]:
    """A deterministic offline embedder: signed hashed words, normalised."""

    def embed(texts: pd.Series) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def letter_embedder(letters: str = "abcdefghijklmnopqrstuvwxyz") -> Callable[[pd.Series], np.ndarray]:
    """A plain offline embedder: how often each letter occurs, regardless of case."""

    def embed(texts: pd.Series) -> np.ndarray:
        low = [(t or "").lower() for t in texts]
        return np.array([[t.count(c) for c in letters] for t in low], np.float64).reshape(len(low), len(letters))

    return embed


def by_index(answers: list[dict]) -> np.ndarray:
    """Vectors of a service's answers ({index, embedding}) in the order of the texts."""
    return np.array([a["embedding"] for a in sorted(answers, key=lambda a: a["index"])])


def embed(chunks: DataFrame, embedder: Callable[[pd.Series], np.ndarray] | None = None, batch: int = 32, attempts: int = 3, concurrent: int = 8, back_off_s: float = 1.0) -> DataFrame:
    """Adds ``vector``: batches of texts, ``concurrent`` of them at a time, retried after 1, 2, ... times ``back_off_s``; a batch that keeps failing gets nulls."""
    call = embedder or hash_embedder()

    def of(texts: pd.Series) -> list:
        for k in range(attempts):
            try:
                return [v.astype("float32").tolist() for v in call(texts)]
            except Exception:  # noqa: BLE001  a failing service is the case that this loop is for
                if k + 1 < attempts:
                    time.sleep(back_off_s * 2**k)
        return [None] * len(texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrent) as pool:
            for frame in frames:
                parts = [frame["content"].iloc[at : at + batch].str.slice(0, EMBED_LIMIT) for at in range(0, len(frame), batch)]
                yield frame.assign(vector=[v for got in pool.map(of, parts) for v in got])

    return chunks.mapInPandas(run, T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def storable(chunks: DataFrame) -> DataFrame:
    """Chunks with a vector, contents cut to the store's limit, one of each (repo, path, start_line, content_hash)."""
    return chunks.where(F.col("vector").isNotNull()).withColumn("content", F.substring("content", 1, CONTENT_LIMIT)).dropDuplicates(["repo", "path", "start_line", "content_hash"])


def knn(vectors: DataFrame, query: list[float], top_k: int = DEFAULT.lane_top_k, repo: str | None = None) -> DataFrame:
    """The nearest by cosine: rank, id, repo, score. An exact repository filter comes before the cut."""
    rows = vectors.where(F.col("repo") == repo) if repo is not None else vectors
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = rows.select("id", "repo", F.round(cosine(F.col("vector"), q), 6).alias("score"))
    return rows.orderBy(F.col("score").desc(), "id").limit(top_k)

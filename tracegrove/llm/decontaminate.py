"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrove.llm._tables import aside, cut, documents, id_and_text, small_batches, table
from tracegrove.llm._text import CHUNK_BYTES, Words, buffer_of, chunks

#: Words of a window; of a k-gram; k-grams of a winnowing window, so that every
#: shared run of SPAN words shares a kept k-gram.
SPAN, GRAM = 13, 5
WINDOW = SPAN - GRAM + 1
#: Bytes of benchmark text whose index one pass over the documents carries.
BLOCK_BYTES = 32 << 20

_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill: np.uint64) -> np.ndarray:
    """op over x[i : i + w] for each i, with fill beyond the end."""
    n = len(x)
    out = np.concatenate([x, np.full(w, fill, np.uint64)])
    have = 1
    while have < w:
        step = min(have, w - have)
        out[: len(out) - step] = op(out[: len(out) - step], out[step:])
        have += step
    return out[:n]


def winnow(grams: np.ndarray, ok: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each k-gram is the least of some sliding window (all of equal ones are kept)."""
    g = np.where(ok, grams, _LAST)
    low = _slide(g, window, np.minimum, _LAST)
    # windows that hold position p begin at p - window + 1 .. p; none of them has a larger minimum than g[p]
    held = _slide(low[::-1], window, np.maximum, np.uint64(0))[::-1]
    return ok & (g == held)


class Index:
    """Winnowed k-grams of benchmark items, with the items' word hashes for the extension of hits."""

    def __init__(self, ids: list, texts: list[str]):
        """Texts are taken in chunks, so that what building needs beyond the index is bounded."""
        self.ids = ids
        hashes, sizes, grams_, items, places = [], [], [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        base = 0
        for part in chunks(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())})):
            words = Words(*buffer_of(part.column("text")))
            hashes.append(words.hash)
            sizes.append(words.count)
            grams, ok = words.ngrams(GRAM)
            owner = words.of_word()
            keep = np.flatnonzero(winnow(grams, ok) & np.repeat(words.count >= SPAN, words.count))
            grams_.append(grams[keep])
            items.append((owner[keep] + base).astype(np.int32))
            places.append((keep - words.first[owner[keep]]).astype(np.int32))
            for i in np.flatnonzero((words.count > 0) & (words.count < SPAN)).tolist():
                n = int(words.count[i])
                one = Words(*buffer_of(part.column("text").slice(i, 1)))
                self.short.setdefault(n, {}).setdefault(int(one.ngrams(n)[0][0]), []).append(base + i)
            base += part.num_rows
        none = np.zeros(0, np.int64)
        self.hash = np.concatenate([none.astype(np.uint64), *hashes])
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([none, *sizes]))])
        keys = np.concatenate([none.astype(np.uint64), *grams_])
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], np.concatenate([none.astype(np.int32), *items])[order], np.concatenate([none.astype(np.int32), *places])[order]

    def words_of(self, item: int) -> np.ndarray:
        return self.hash[self.first[item] : self.first[item + 1]]

    def hits(self, words: Words) -> Iterator[tuple[int, np.ndarray, set[int]]]:
        """Texts with hits: number, hit flags of their words, items."""
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # text: (item, begin, end)
        owner = words.of_word()
        grams, ok = words.ngrams(GRAM)
        cand = np.flatnonzero(winnow(grams, ok))
        cand = cand[_member(grams[cand], self.keys)]
        begin, end = np.searchsorted(self.keys, grams[cand], "left"), np.searchsorted(self.keys, grams[cand], "right")
        reached: dict[tuple[int, int, int], int] = {}  # by text, item and diagonal: the end of the last run looked at
        for p, a, z in zip(cand.tolist(), begin.tolist(), end.tolist(), strict=True):
            t = int(owner[p])
            lo, hi = int(words.first[t]), int(words.first[t + 1])
            for item, q in zip(self.item[a:z].tolist(), self.place[a:z].tolist(), strict=True):
                if p < reached.get((t, item, p - q), 0):
                    continue
                b, e = _extend(words.hash, lo, hi, p, self.words_of(item), q)
                reached[t, item, p - q] = e
                if e - b >= SPAN:
                    found[t].append((item, b, e))
        for n, keys in self.short.items():
            grams, ok = words.ngrams(n)
            pos = np.flatnonzero(ok)
            for p in pos[_member(grams[pos], np.sort(np.array(list(keys), np.uint64)))].tolist():
                for item in keys[int(grams[p])]:
                    if np.array_equal(words.hash[p : p + n], self.words_of(item)):
                        found[int(owner[p])].append((item, p, p + n))
        for t, spans in found.items():
            if spans:
                hit = np.zeros(int(words.first[t + 1] - words.first[t]), bool)
                for _, b, e in spans:
                    hit[b - words.first[t] : e - words.first[t]] = True
                yield t, hit, {i for i, _, _ in spans}


def _member(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x


def _extend(h: np.ndarray, lo: int, hi: int, p: int, item: np.ndarray, q: int) -> tuple[int, int]:
    """The longest run of equal words through text position p and item position q."""
    back = min(p - lo, q)
    a, b = h[p - back : p][::-1], item[q - back : q][::-1]
    left = int(np.argmax(a != b)) if back and (a != b).any() else back
    ahead = min(hi - p, len(item) - q)
    a, b = h[p : p + ahead], item[q : q + ahead]
    right = int(np.argmax(a != b)) if (a != b).any() else ahead
    return p - left, p + right


def blocks_of(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of at most ``limit`` bytes (or one item), so that no index outgrows a worker."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    ids: list = []
    texts: list[str] = []
    size = 0
    for row in items.toLocalIterator():
        n = len(row["text"].encode())
        if ids and size + n > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    yield ids, texts


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds to each document ``n_words``, ``n_hit``, ``hits`` (begin, end of hit word runs, words from 0) and ``items``.

    ``docs`` has ``doc_id`` and ``text`` and whatever else, which stays; columns
    named like the new ones are replaced. Null and empty texts have no words and
    no hits; repeated rows are judged one by one; an empty benchmark hits nothing.
    Items without an id hit like others, but have nothing to add to ``items``; items without a text hit nothing.
    Texts of any length are scanned whole; of k-grams that tie for the least of a window, all are kept.
    A benchmark beyond ``block_bytes`` is taken in several passes over the documents, each with an index
    of bounded size (12 bytes for each byte of a block at most), which the driver builds once and sends to the workers.
    """
    spark = docs.sparkSession
    names = ("n_words", "n_hit", "hits", "items")
    out = docs.drop(*names).withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    pending = False
    for ids, texts in blocks_of(benchmark, block_bytes):
        if pending:
            out = cut(out)
        shared = spark.sparkContext.broadcast(Index(ids, texts))
        out = small_batches(out).mapInArrow(_scan(shared), T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema]))
        pending = True
    return out


def _scan(shared):  # noqa: ANN001, ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK_BYTES):
                words = Words(*buffer_of(batch.column("text")))
                runs, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                for t, hit, which in index.hits(words):
                    for b, e in zip(runs[t][::2], runs[t][1::2], strict=True):
                        hit[b:e] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    runs[t] = edge.tolist()
                    items[t] = sorted({*items[t], *(index.ids[i] for i in which if index.ids[i] is not None)})
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                cols |= {"n_words": pa.array(words.count, pa.int64()), "n_hit": pa.array([sum(r[1::2]) - sum(r[::2]) for r in runs], pa.int64()), "hits": pa.array(runs, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(cols)

    return scan


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``contamination``: counts, items and the rule n_hit > 0 and 20 * n_hit >= n_words."""
    found = contamination(docs, benchmark)
    return found.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256),
            "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
        }
    )


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(id_and_text(documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the rule leaves, with their own columns, whatever their names."""
    rows, back = aside(docs, "n_words", "n_hit", "hits", "items", "n_items", "items_sha256", "contaminated")
    return back(verdicts(rows, benchmark).where(~F.col("contaminated")))

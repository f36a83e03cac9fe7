"""A stored index of texts: trigrams for substrings and regular expressions, words with bounds for ranked search."""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrove.config import DEFAULT
from tracegrove.functions.trigrams import ANY, Condition, grams, ranges
from tracegrove.sources.store import exists, move, release, remove, unique

#: Texts of a shard (a run of them in one file), and shards at most, besides one a file; shards grow beyond them.
SHARD_TEXTS, SHARDS = 512, 4096
#: Texts and characters of a segment, the unit of postings, at most (one text at least).
SEGMENT_TEXTS, SEGMENT_CHARS = 512, 4 << 20
#: Rows of a page of the texts: what is read for one text, at least.
PAGE_ROWS = 16
#: Rows of a page of the postings.
PAGE_POSTINGS = 1000
#: Candidates of a condition up to which their own places are read, and intervals of them at most; beyond, shards.
FEW, INTERVALS = 2000, 32
#: Where a text of so many is a candidate, all are read.
EVERY = 8
#: Segments whose scores give the first bound of a ranked search.
FIRST = 8

#: Columns of the postings.
GRAMS = "gram long, shard int, lo long, hi long, at array<long>"
WORDS = "term string, shard int, lo long, df long, max_tf int, min_len int, doc_ids array<long>, tf array<int>, len array<int>"

_WORD = re.compile(r"[a-z0-9_]+")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[str | None]]]:
    """shards, ids and lower-cased texts of runs of rows of one shard."""
    for batch in batches:
        shards, ids, texts = (batch.column(c).to_pylist() for c in ("shard", "doc_id", "low"))
        lo = 0
        while lo < len(ids):
            hi, size = lo, 0
            while hi < len(ids) and shards[hi] == shards[lo] and hi - lo < SEGMENT_TEXTS and (hi == lo or size + len(texts[hi] or "") <= SEGMENT_CHARS):
                size += len(texts[hi] or "")
                hi += 1
            yield shards[lo:hi], ids[lo:hi], texts[lo:hi]
            lo = hi


def _grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray] | None:
    """Each distinct trigram of each text, which ends in two zeros, and the text's place, sorted by both; None if the characters are too many for keys of 63 bits.

    A key is a trigram in numbers of the characters that occur, then the place, so one sort of plain numbers does for all texts.
    """
    ends = np.cumsum([len(t or "") + 2 for t in texts])
    codes = np.frombuffer(("\0\0".join(t or "" for t in texts) + "\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(int(codes.max()) + 1, bool)
    there[codes] = True
    letters = np.flatnonzero(there)
    bits, place = (len(letters) - 1).bit_length(), (len(texts) - 1).bit_length()
    if 3 * bits + place > 63:
        return None
    c = (np.cumsum(there) - 1)[codes]
    key = ((c[:-2] << bits | c[1:-1]) << bits | c[2:]) << place | np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[:-2]
    begins = np.ones(len(codes), bool)
    begins[ends - 1] = begins[ends - 2] = False
    key = np.sort(key[begins[:-2]])
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    gram, mask = key >> place, (1 << bits) - 1
    return letters[gram >> 2 * bits] << 42 | letters[gram >> bits & mask] << 21 | letters[gram & mask], key & (1 << place) - 1


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shards, ids, texts in _segments(batches):
        todo = [(ids, texts)]
        while todo:
            ids, texts = todo.pop()
            found = _grams_of(texts)
            if found is None:
                half = len(ids) // 2
                todo += [(ids[:half], texts[:half]), (ids[half:], texts[half:])]
                continue
            gram, at = found
            at = np.array(ids, np.int64)[at] - min(ids)
            start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.append(start, len(gram)), pa.int32()), pa.array(at))
            n = len(start)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(gram[start]), "shard": pa.array(np.full(n, shards[0], np.int32)), "lo": pa.array(np.full(n, min(ids))), "hi": pa.array(np.full(n, max(ids))), "at": places})


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shards, ids, texts in _segments(batches):
        found: dict[str, list[tuple[int, int]]] = {}
        lengths = []
        for k, t in enumerate(texts):
            words = _WORD.findall(t or "")
            lengths.append(len(words))
            for w, tf in Counter(words).items():
                found.setdefault(w, []).append((k, tf))
        rows = sorted(found.items())
        places = [[k for k, _ in p] for _, p in rows]
        n = len(rows)
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array([w for w, _ in rows], pa.string()),
                "shard": pa.array([shards[0]] * n, pa.int32()),
                "lo": pa.array([min(ids)] * n, pa.int64()),
                "df": pa.array([len(p) for p in places], pa.int64()),
                "max_tf": pa.array([max(tf for _, tf in p) for _, p in rows], pa.int32()),
                "min_len": pa.array([min(lengths[k] for k in p) for p in places], pa.int32()),
                "doc_ids": pa.array([[ids[k] for k in p] for p in places], pa.list_(pa.int64())),
                "tf": pa.array([[tf for _, tf in p] for _, p in rows], pa.list_(pa.int32())),
                "len": pa.array([[lengths[k] for k in p] for p in places], pa.list_(pa.int32())),
            }
        )


def _write(made: DataFrame, key: str, path: str) -> None:
    """Postings, sorted by key within a file, so a search reads a few pages of each."""
    made.sortWithinPartitions(key, "shard", "lo").write.option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_POSTINGS).parquet(path)


def _low(texts: DataFrame) -> DataFrame:
    return texts.select("shard", "doc_id", F.lower("content").alias("low"))


def build(files: DataFrame, path: str) -> None:
    """Writes the index of files (doc_id, repo, lang, branch, path, content) to a folder.

    texts: the files as they are dealt out, each part sorted by doc_id, cut into shards and written in small pages. Postings of
    trigrams and of words are written when they are first asked for (TextIndex.grams, TextIndex.words). Files without a doc_id are
    left out; several files may have one.
    """
    spark = files.sparkSession
    rows = files.where("doc_id IS NOT NULL")
    count = rows.count()
    per = max(SHARD_TEXTS, -(-count // SHARDS))
    # numbers of rows: of the part above 33 bits, within it below
    numbered = rows.sortWithinPartitions("doc_id").withColumn("_row", F.monotonically_increasing_id())
    shard = F.expr(f"CAST(shiftright(_row, 33) * {count // per + 1} + (_row & {(1 << 33) - 1}L) DIV {per} AS INT)")
    placed = numbered.withColumn("shard", shard).drop("_row")
    placed.write.option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/texts")
    spark.range(1).select(F.lit(count).cast("long").alias("texts"), F.lit(placed.schema.json()).alias("schema")).write.parquet(f"{path}/meta")


def build_grams(texts: DataFrame, path: str) -> None:
    """Writes the trigrams of an index' texts to a folder.

    For each trigram of the lower-cased texts and segment (some texts of a shard), the least and greatest doc_id of the segment and
    its texts, as distances from the least. Postings stay in the task that reads the texts and are sorted there: nothing is
    shuffled, so a build grows as the texts do.
    """
    _write(_low(texts).mapInArrow(_gram_rows, GRAMS), "gram", path)


def build_words(texts: DataFrame, path: str) -> None:
    """Writes the words of an index' texts to a folder.

    rows: for each word and segment, its texts with count and length, and the greatest count and least length, which bound any
    score. sizes: how many texts aren't null, and their words.
    """
    _write(_low(texts).mapInArrow(_word_rows, WORDS), "term", f"{path}/rows")
    rows = texts.sparkSession.read.schema(WORDS).parquet(f"{path}/rows")
    words = rows.agg(F.coalesce(F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0)).alias("words"))
    texts.agg(F.count("content").alias("filled")).crossJoin(F.broadcast(words)).write.parquet(f"{path}/sizes")  # one row each


@dataclass
class TextIndex:
    """A written index, opened."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        meta = self.spark.read.parquet(f"{self.path}/meta").first()
        self.texts = self.spark.read.schema(T.StructType.fromJson(json.loads(meta["schema"]))).parquet(f"{self.path}/texts")
        self.count = meta["texts"]

    @property
    def files(self) -> DataFrame:
        return self.texts.drop("shard")

    def form(self, name: str, build: Callable[[str], None]) -> str:
        """Where a further form of the texts lies; written beside and moved there at its first use."""
        at = f"{self.path}/{name}"
        if not exists(self.spark, at):
            beside = f"{at}.{unique()}"
            build(beside)
            release(self.spark)
            if not move(self.spark, beside, at):
                remove(self.spark, beside)
        return at

    @cached_property
    def grams(self) -> DataFrame:
        """Trigrams; only terms and patterns need them."""
        return self.spark.read.schema(GRAMS).parquet(self.form("grams", lambda to: build_grams(self.texts, to)))

    @cached_property
    def _words_at(self) -> str:
        """Words; only ranked search needs them."""
        return self.form("words", lambda to: build_words(self.texts, to))

    @cached_property
    def words(self) -> DataFrame:
        return self.spark.read.schema(WORDS).parquet(f"{self._words_at}/rows")

    @cached_property
    def mean(self) -> float:
        """Words of a text that isn't null, on average."""
        sizes = self.spark.read.parquet(f"{self._words_at}/sizes").first()
        return sizes["words"] / max(sizes["filled"], 1)

    @staticmethod
    def _postings(column: str, keys: list[str]) -> str:
        """A condition on the rows of some keys (SQL literals), which the scan's pages are chosen by."""
        return " OR ".join(f"{column} = {k}" for k in keys) or "false"

    def candidates(self, conditions: list[Condition]) -> DataFrame:
        """q, shard, doc_id: the texts that meet each condition but ANY, by its place in the list; no text is read.

        Postings of all the conditions are read at once; each segment's are joined as sets.
        """
        wanted = sorted(set().union(*(grams(c) for c in conditions)))
        spans = sorted(set().union(*(ranges(c) for c in conditions)))
        keep = [self._postings("gram", [f"{g}L" for g in wanted]), *(f"gram BETWEEN {lo}L AND {hi}L" for lo, hi in spans)]
        held = [f"flatten(collect_list(CASE WHEN gram = {g}L THEN at END)) AS g{k}" for k, g in enumerate(wanted)]
        held += [f"array_distinct(flatten(collect_list(CASE WHEN gram BETWEEN {lo}L AND {hi}L THEN at END))) AS r{k}" for k, (lo, hi) in enumerate(spans)]
        rows = self.grams.where(" OR ".join(keep)).groupBy("shard", "lo").agg(*map(F.expr, held))

        def of(c: Condition) -> str:
            if c[0] == "gram":
                return f"g{wanted.index(c[1])}"
            if c[0] == "from":
                return f"r{spans.index(c[1:])}"
            return reduce(lambda a, b: f"{'array_intersect' if c[0] == 'and' else 'array_union'}({a}, {b})", map(of, c[1:]))

        sets = ", ".join(f"named_struct('q', {q}, 'at', {of(c)})" for q, c in enumerate(conditions) if c != ANY)
        each = rows.select("shard", "lo", F.expr(f"explode(array({sets})) AS s"))
        return each.select("s.q", "shard", "lo", F.explode("s.at").alias("at")).select("q", "shard", (F.col("lo") + F.col("at")).alias("doc_id"))

    def narrowed(self, conditions: list[Condition]) -> list[DataFrame]:
        """For each condition, the files, read only where its candidates lie; an exact check must follow.

        A few candidates become intervals of doc_id, which the scan's pages are chosen by; of more, the shards are read
        between the least and the greatest of each. Either is a bounded number of rows on the driver.
        """
        asked = {q for q, c in enumerate(conditions) if c != ANY}
        if not asked:
            return [self.files] * len(conditions)
        found = self.candidates(conditions)
        few = found.limit(FEW * len(asked) + 1).collect()
        if len(few) <= FEW * len(asked):
            runs = [(r["q"], r["shard"], r["doc_id"], r["doc_id"]) for r in few]
        else:
            per = found.groupBy("q", "shard").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()
            runs = [tuple(r) for r in per]
        return [self._between([r[1:] for r in runs if r[0] == q]) if q in asked else self.files for q in range(len(conditions))]

    def _between(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        """The files of some shards and intervals; where there are more than INTERVALS of these, the ones that lie closest are joined."""
        if not runs:
            return self.files.where("false")
        if len(runs) * EVERY >= self.count:
            return self.files
        runs = sorted(runs, key=lambda r: r[1:])
        gaps = sorted(range(1, len(runs)), key=lambda k: runs[k][1] - runs[k - 1][2])[-INTERVALS + 1 :]
        edge = [0, *sorted(gaps), len(runs)]
        spans = " OR ".join(f"doc_id BETWEEN {runs[a][1]} AND {max(r[2] for r in runs[a:b])}" for a, b in itertools.pairwise(edge))
        shards = ", ".join(map(str, sorted({r[0] for r in runs})))
        return self.texts.where(f"shard IN ({shards}) AND ({spans})").drop("shard")

    def postings(self, terms: list[str]) -> DataFrame:
        return self.words.where(self._postings("term", ["'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms]))


def idf(n: int, df: Column) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))


def term_score(weight: Column, tf: Column, length: Column, mean: float, k1: float = DEFAULT.bm25_k1, b: float = DEFAULT.bm25_b) -> Column:
    """A term's part of a BM25 score: greater for a greater count, less for a greater length."""
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (mean or 1.0)))


@dataclass
class Ranked:
    """A ranked search: its result, and how many segments with a term there were and were scored."""

    best: DataFrame
    segments: int
    scored: int


def ranked(index: TextIndex, terms: list[str], top_k: int = 20, k1: float = DEFAULT.bm25_k1, b: float = DEFAULT.bm25_b) -> Ranked:
    """The best texts by BM25: doc_id and score to six places, ties by doc_id.

    Block-max pruning: a segment's greatest counts and least lengths bound the scores of all its texts. The segments of the
    greatest bounds are scored first; their top_k-th score is one that the rest must reach, so segments with lower bounds
    aren't scored. To the driver come a row a term, top_k scores and two counts.
    """
    terms = list(dict.fromkeys(terms))
    rows = index.postings(terms)
    weights = rows.groupBy("term").agg(F.sum("df").alias("df")).select("term", idf(index.count, F.col("df")).alias("w")).collect()
    if not weights:
        return Ranked(index.spark.createDataFrame([], "doc_id long, score double"), 0, 0)
    weight = F.element_at(F.create_map(*(F.lit(x) for r in weights for x in (r["term"], r["w"]))), F.col("term"))
    part = rows.select("shard", "lo", "term", term_score(weight, F.col("max_tf"), F.col("min_len"), index.mean, k1, b).alias("part"))
    bounds = part.groupBy("shard", "lo", "term").agg(F.max("part").alias("part")).groupBy("shard", "lo").agg(F.sum("part").alias("bound"))

    def scores(keep: DataFrame) -> DataFrame:
        own = rows.join(keep.select("shard", "lo"), ["shard", "lo"], "left_semi").withColumn("w", weight)
        each = own.select("w", F.explode(F.arrays_zip("doc_ids", "tf", "len")).alias("d"))
        total = F.sum(term_score(F.col("w"), F.col("d.tf"), F.col("d.len"), index.mean, k1, b))
        return each.groupBy("d.doc_ids").agg(F.round(total, 6).alias("score")).select(F.col("doc_ids").alias("doc_id"), "score").orderBy(F.col("score").desc(), "doc_id").limit(top_k)

    got = scores(bounds.orderBy(F.col("bound").desc(), "shard", "lo").limit(FIRST)).collect()
    least = got[-1]["score"] - 1e-5 if len(got) == top_k else 0.0
    count = bounds.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bound") >= least, 1)).alias("k")).first()
    return Ranked(scores(bounds.where(F.col("bound") >= least)), count["n"], count["k"])

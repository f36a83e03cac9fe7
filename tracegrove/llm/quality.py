"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrove.llm._tables import documents, id_and_text, small_batches, table
from tracegrove.llm._text import INK_BYTES, Words, buffer_of, chunks
from tracegrove.llm.toxicity import fold_column, marked, sampled

#: Bound of the labelled sample of each class.
PER_CLASS = 8000
THRESHOLD = 0.7
#: Weights of the pooled covariance and of the scaled identity in a class covariance.
POOLED, IDENTITY = 0.5, 0.05

_KIND = np.zeros(256, np.uint8)  # 1 letter or non-ASCII, 2 digit, 3 white space, 4 common punctuation, 5 other symbol
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if _b >= 0x80 or _c.isalpha() else 2 if _c.isdigit() else 3 if _b in (32, 9, 10, 11, 12, 13) else 4 if _c in ".,;:!?'\"()-" else 5
NAMES = ("log_words", "word_length", "word_length_sd", "letters", "digits", "punctuation", "symbols", "upper", "distinct", "top_word", "log_line_words", "repeated_lines", "stops", "spread")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each whole text; finite for any text."""
    data, off = buffer_of(texts)
    n = len(off) - 1
    words = Words(data, off, INK_BYTES_TABLE)
    size = np.diff(off).astype(float)
    count = words.count.astype(float)

    def per(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (run[off[1:]] - run[off[:-1]]).astype(float)

    kind = _KIND[data]
    length = (words.end - words.start).astype(float)
    at = words.first

    def of_words(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(x)])
        return run[at[1:]] - run[at[:-1]]

    mean = of_words(length) / np.maximum(count, 1)
    sd = np.sqrt(np.maximum(of_words(length**2) / np.maximum(count, 1) - mean**2, 0))
    owner = words.of_word()
    order = np.lexsort((words.hash, owner))
    h, o = words.hash[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(h)))
    distinct = np.bincount(o[begin], minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, o[begin], runs.astype(float))
    same = np.bincount(o[begin], weights=runs.astype(float) * (runs - 1), minlength=n)
    lines = per(data == 10) + (size > 0)
    line_of = np.cumsum(data == 10)
    # a line counts as repeated if its hash recurs within its text
    repeated = _repeated_lines(words, line_of, owner, n)
    share = lambda k: per(kind == k) / np.maximum(size, 1)
    root = np.sqrt
    out = np.column_stack(
        [
            np.log1p(count),
            np.log1p(mean),
            np.log1p(sd),
            share(1),
            root(share(2)),
            root(share(4)),
            root(share(5)),
            root(per((data >= 65) & (data <= 90)) / np.maximum(size, 1)),
            distinct / np.maximum(root(count), 1) / 10,
            root(top / np.maximum(count, 1)),
            np.log1p(count / np.maximum(lines, 1)),
            root(repeated / np.maximum(lines, 1)),
            root(of_words((length <= 3).astype(float)) / np.maximum(count, 1)),
            root(same / np.maximum(count * (count - 1), 1)),
        ]
    )
    return np.nan_to_num(out)


INK_BYTES_TABLE = np.where(INK_BYTES > 0, np.arange(256), 0).astype(np.uint8)


def _repeated_lines(words: Words, line_of: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    if not len(words.hash):
        return np.zeros(n)
    line = line_of[words.start]
    edge = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])]))
    sums = np.add.reduceat(words.hash, edge)
    own = owner[edge]
    order = np.lexsort((sums, own))
    s, o = sums[order], own[order]
    again = np.zeros(len(s), bool)
    again[1:] = (s[1:] == s[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[again], minlength=n).astype(float)


class Discriminant:
    """Gaussian class densities with cached Cholesky factors, and the class log-odds."""

    def __init__(self, means: list[np.ndarray], factors: list[np.ndarray], log_odds: float, centre: np.ndarray, scale: np.ndarray, calibration: tuple[float, float] = (1.0, 0.0)):
        self.means, self.log_odds, self.centre, self.scale, self.calibration = means, log_odds, centre, scale, calibration
        self.inverse = [np.linalg.inv(f) for f in factors]  # of the triangular factors, once
        self.log_det = [2 * np.log(np.diag(f)).sum() for f in factors]

    def log_density_difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        d = [((z - m) @ inv.T) for m, inv in zip(self.means, self.inverse, strict=True)]
        maha = [(v * v).sum(1) for v in d]
        return 0.5 * ((maha[0] + self.log_det[0]) - (maha[1] + self.log_det[1])) + self.log_odds

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * self.log_density_difference(x) + b, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, odds: float, pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant | None:
    """Shrinks each class covariance to the pooled one, then to a scaled identity. None without both classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    centre, scale = np.median(x, 0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / scale, -12, 12)
    parts = [z[y == k] for k in (0, 1)]
    means = [p.mean(0) for p in parts]
    cov = [np.atleast_2d(np.cov(p, rowvar=False, bias=True)) for p in parts]
    both = sum(len(p) * c for p, c in zip(parts, cov, strict=True)) / len(z)
    factors = []
    for c in cov:
        c = (1 - pooled) * c + pooled * both
        c = (1 - identity) * c + identity * (np.trace(c) / len(c) + 1e-6) * np.eye(len(c))
        factors.append(np.linalg.cholesky(c))
    return Discriminant(means, factors, float(np.log(odds)), centre, scale)


def calibrate(model: Discriminant, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Logistic calibration of the log-density difference, each class at its share of the labels."""
    d = np.clip(model.log_density_difference(x), -30, 30)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        v = np.column_stack([d, np.ones(len(d))])
        h = (v * (weight * p * (1 - p))[:, None]).T @ v + 1e-3 * np.eye(2)
        move = np.clip(np.linalg.solve(h, v.T @ (weight * (y - p))), -1, 1)
        a, b = a + move[0], b + move[1]
        if np.abs(move).max() < 1e-9:
            break
    model.calibration = (max(a, 1e-3), b)


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (4, 2), per_class: int = PER_CLASS) -> Discriminant | None:
    """Fits on at most ``per_class`` labelled texts of each class; the held-out fold gives none."""
    rows = marked(docs, labels, "quality", held_out)
    share = rows.agg(F.avg("quality")).first()[0]
    if not share or share >= 1:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                x = statistics(batch.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    sample = sampled(docs, rows, {f"q{k}": (f"quality = {k}", per_class) for k in (0, 1)})
    got = small_batches(sample).mapInArrow(run, "doc_id long, quality int, x array<double>").toArrow().sort_by("doc_id")
    x, y = np.array(got.column("x").to_pylist()).reshape(-1, len(NAMES)), np.asarray(got.column("quality"))
    sizes = [(y == k).sum() for k in (0, 1)]
    model = fit(x, y, share / (1 - share))
    if model is not None:
        calibrate(model, x, y.astype(float), np.where(y == 1, share / max(1, sizes[1]), (1 - share) / max(1, sizes[0])) * len(y))
    return model


def score(docs: DataFrame, model: Discriminant | None) -> DataFrame:
    """Adds ``score`` from the whole text, however long; null and empty texts get the score of empty statistics, equal texts
    equal scores, and a score at the threshold counts as above it; without a model it is 0.5. Other columns stay, but for one
    named ``score``; without rows, there are none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                x = statistics(batch.column("text"))
                cols["score"] = pa.array(shared.value.score(x) if shared.value else np.full(len(x), 0.5), pa.float64())
                yield pa.RecordBatch.from_pydict(cols)

    rest = docs.drop("score")
    return small_batches(rest).mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType())]))


def op8_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(documents(spark, sf_dir))
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_column(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

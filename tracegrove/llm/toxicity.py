"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrove.llm._tables import cut, documents, id_and_text, small_batches, table
from tracegrove.llm._text import Words, buffer_of, chunks, distinct_per_text, mix

BITS = 18
#: Bytes of the beginnings of words that are features, too, as inflected words share a stem.
PREFIXES = (4, 5, 6)
#: Bounds of the training sample: confirmed positives, unlabelled texts, and labelled texts for the calibration.
POSITIVES, UNLABELLED, CALIBRATION = 6000, 12000, 6000
#: The most features of a model, and the folds of the calibration.
FEATURES, FOLDS = 4096, 3

_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, flat, and offsets; those in ``only`` if given.

    They are the distinct words, the beginnings of words, and beginnings that two different words of the text share: a stem
    can stand in a word by chance, less often in two.
    """
    words = Words(*buffer_of(texts))
    text = words.of_word()
    flat, owner = [_slots(words.hash)], [text]
    for n in PREFIXES:
        hashes, ok = words.prefixes(n)
        flat.append(_slots(hashes[ok]))
        owner.append(text[ok])
        pair = _slots(mix(hashes ^ _PAIR))
        own = np.flatnonzero(ok if only is None else ok & only[pair])
        own = own[np.lexsort((words.hash[own], hashes[own], text[own]))]
        start, whole, of = hashes[own], words.hash[own], text[own]
        both = own[1:][(start[1:] == start[:-1]) & (of[1:] == of[:-1]) & (whole[1:] != whole[:-1])]
        flat.append(pair[both])
        owner.append(text[both])
    flat, owner = np.concatenate(flat), np.concatenate(owner)
    if only is not None:
        keep = only[flat]
        flat, owner = flat[keep], owner[keep]
    return distinct_per_text(flat, owner, len(texts))


class Model:
    """A linear score of hashed words with a logistic calibration on the raw score."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    def raw(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(self.weights[flat], dtype=np.float64)])
        return run[off[1:]] - run[off[:-1]] + self.bias

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.scale * self.raw(*features(texts, self.weights != 0)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def select(d1: np.ndarray, d0: np.ndarray, n1: int, n0: int, prior: float, z: float = 3.0) -> np.ndarray:
    """Slots whose holders are more likely positive than not; d1 of n1 positives and d0 of n0 unlabelled texts have them.

    By Bayes' rule, the prior times the share of the positives over the share of the unlabelled is 0.5
    or more; weaker signs would add up in long texts. The excess counts if chance would hardly give it (``z``
    standard errors of the unlabelled share) and if it is firm by its own errors, too, as far as few positives allow that.
    Beyond FEATURES of them, the firmest are taken.
    """
    p1, p0 = (d1 + 0.5) / (n1 + 1), (d0 + 0.5) / (n0 + 1)
    off = p1 - p0
    firm = off / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    kept = np.flatnonzero((prior * p1 >= 0.5 * p0) & (firm >= min(z, 0.3 * n1**0.5)) & (off / np.sqrt(p0 * (1 - p0) / n1) >= z))
    return np.sort(kept[np.argsort(-firm[kept], kind="stable")[:FEATURES]])


class Rows:
    """Texts as sets of columns; equal ones are one row with a weight, and weights add up to 1."""

    def __init__(self, sets: list[bytes], columns: int):
        seen = Counter(sets)
        self.columns, self.weight = columns, np.array(list(seen.values()), np.float64) / max(1, len(sets))
        self.flat = np.frombuffer(b"".join(seen), np.int32)
        size = np.array([len(x) // 4 for x in seen], np.int64)
        self.off, self.row = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(len(size)), size)

    def raw(self, theta: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(theta[:-1][self.flat])])
        return run[self.off[1:]] - run[self.off[:-1]] + theta[-1]

    def back(self, d: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.flat, d[self.row], self.columns), d.sum())


def minimise(positive: Rows, unlabelled: Rows, n: int, prior: float, steps: int = 1500, rate: float = 0.05, shrink: float = 0.1) -> np.ndarray:
    """Minimises the non-negative risk with the logistic loss l(z) = log(1 + e^-z), convex in a linear score:

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). When the bracket is negative, the step
    ascends it instead, so that it can't be overfitted below 0. Steps are full passes with
    moment estimates, from zero weights and the prior's log-odds, so that reruns agree. Weights
    shrink by ``shrink`` over the number ``n`` of positives. The last value is the bias.
    """
    theta = np.zeros(positive.columns + 1)
    theta[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        zp, zu = positive.raw(theta), unlabelled.raw(theta)
        rest = unlabelled.weight @ np.logaddexp(0, zu) - prior * (positive.weight @ np.logaddexp(0, zp))
        sp, su = _sigmoid(zp) * positive.weight, _sigmoid(zu) * unlabelled.weight
        grad = positive.back(-prior * positive.weight) + unlabelled.back(su) if rest >= 0 else positive.back(prior * sp) - unlabelled.back(su)
        grad[:-1] += shrink / n * theta[:-1]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        theta -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return theta


def model_of(theta: np.ndarray, kept: np.ndarray) -> Model:
    w = np.zeros(1 << BITS)
    w[kept] = theta[:-1]
    return Model(w, float(theta[-1]))


def columns_of(flat: np.ndarray, off: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Each text's features as 32-bit places in ``kept``."""
    at = np.full(1 << BITS, -1, np.int32)
    at[kept] = np.arange(len(kept))
    own = at[flat]
    return [own[a:b][own[a:b] >= 0].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]


def fit(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float) -> Model:
    """A classifier from the features of positive and of unlabelled texts at hand."""
    n1, n0 = len(positive[1]) - 1, len(unlabelled[1]) - 1
    if not n1 or not n0:
        return Model(np.zeros(1 << BITS), -2.0)
    kept = select(*(np.bincount(x[0], minlength=1 << BITS) for x in (positive, unlabelled)), n1, n0, prior)
    if not len(kept):
        return Model(np.zeros(1 << BITS), -2.0)
    return model_of(minimise(*(Rows(columns_of(*x, kept), len(kept)) for x in (positive, unlabelled)), n1, prior), kept)


def calibrate(model: Model, z: np.ndarray, labels: np.ndarray, steps: int = 200) -> Model:
    """Fits scale and shift of the logistic calibration by Newton steps on raw scores of labelled texts."""
    if len(labels) == 0 or labels.min(initial=1) == labels.max(initial=0):
        return model
    mid, span = float(np.median(z)), float(z.std()) or 1.0
    x = np.column_stack([(z - mid) / span, np.ones(len(z))])
    n1, n0 = labels.sum(), (1 - labels).sum()
    y = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's targets
    theta = np.zeros(2)
    for _ in range(steps):
        p = _sigmoid(x @ theta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (y - p) - 1e-3 * theta)
        theta += np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    scale = max(theta[0], 1e-6) / span
    return Model(model.weights, model.bias, scale, theta[1] - scale * mid)


def fold_column(modulus: int):  # noqa: ANN201
    """The remainder of the id's checksum; a null id counts as an empty text, whose remainder is 0."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def crc_fold(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def sampled(docs: DataFrame, marks: DataFrame, parts: dict[str, tuple[str, int]]) -> DataFrame:
    """doc_id, text, label and a flag for each part of the documents that bounded samples hold.

    A row is in a part, given by its condition and bound, if a hash of its id lies below the
    bound's share of the part's rows, a few standard deviations less, so that reruns agree. Only
    ids and labels are shuffled; the samples' ids, of bounded number, are sent to the documents.
    """
    counts = marks.agg(*(F.count(F.when(F.expr(cond), 1)).alias(k) for k, (cond, _) in parts.items())).first()
    out = marks
    for k, (cond, bound) in parts.items():
        share = max(0.0, bound - 3 * bound**0.5) / max(1, counts[k]) if counts[k] > bound else 1.0
        low = F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(1 << 31)) < int(share * (1 << 31))
        out = out.withColumn(k, F.coalesce(F.expr(cond), F.lit(False)) & low)
    drawn = out.where(" OR ".join(parts)).dropDuplicates(["doc_id"])
    return docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", *(c for c in drawn.columns if c != "doc_id"))


def marked(docs: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int] | None) -> DataFrame:
    """doc_id and the label (null where there is none) of all documents out of the held-out fold."""
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id")
    if held_out:
        ids = ids.where(fold_column(held_out[0]) != held_out[1])
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias(label))
    return ids.join(marks, "doc_id", "left")


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (3, 1), positives: int = POSITIVES, unlabelled: int = UNLABELLED, calibration: int = CALIBRATION) -> Model:
    """Fits the classifier on bounded samples; documents of the held-out fold give no label.

    Positives are confirmed toxic rows; unlabelled texts are drawn from all documents, and
    their labels aren't looked at; the class prior is the share of toxic rows among the
    labelled ones. Without labels of both kinds, the score is a constant below the threshold.
    The calibration sees scores of models that didn't train on the text: one for each of FOLDS folds.
    Executors turn the samples into hashed features, written to the checkpoint folder, and count them; of each
    text only its places in the chosen features, FEATURES at most, come to the driver.
    """
    rows = marked(docs, labels, "toxic", held_out)
    prior = rows.agg(F.avg("toxic")).first()[0]
    none = Model(np.zeros(1 << BITS), -2.0)
    if not prior or prior >= 1:
        return none
    sample = sampled(docs, rows, {"p": ("toxic = 1", positives), "u": ("true", unlabelled), "c": ("toxic IS NOT NULL", calibration)})
    hashed = cut(small_batches(sample).mapInArrow(_hash_features, "doc_id long, slots binary, toxic int, p boolean, u boolean, c boolean"))
    n1, n0 = hashed.agg(F.count(F.when(F.col("p"), 1)), F.count(F.when(F.col("u"), 1))).first()
    if not n1 or not n0:
        return none
    counts = hashed.mapInArrow(_count_features, "slot int, d1 long, d0 long").groupBy("slot").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0")).where("d1 > 0").toArrow()
    d1, d0 = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    d1[counts.column("slot")], d0[counts.column("slot")] = counts.column("d1"), counts.column("d0")
    kept = select(d1, d0, n1, n0, float(prior))
    if not len(kept):
        return none
    got = hashed.mapInArrow(_chosen(kept), "doc_id long, places binary, toxic int, p boolean, u boolean, c boolean").toArrow().sort_by("doc_id")
    sets = got.column("places").to_pylist()
    flag = {k: np.asarray(got.column(k)) for k in "puc"}
    fold = np.array([crc_fold(d, 1 << 16) % FOLDS for d in got.column("doc_id").to_pylist()], np.int64)

    def fitted(rows: np.ndarray) -> np.ndarray:
        part = lambda k: Rows([sets[i] for i in np.flatnonzero(flag[k] & rows)], len(kept))
        return minimise(part("p"), part("u"), int(flag["p"][rows].sum()), float(prior))

    z = np.zeros(len(sets))
    for f in range(FOLDS):
        rest = fold != f
        if flag["p"][rest].any() and flag["u"][rest].any():
            theta = fitted(rest)
            for i in np.flatnonzero(flag["c"] & ~rest):
                z[i] = theta[:-1][np.frombuffer(sets[i], np.int32)].sum() + theta[-1]
    return calibrate(model_of(fitted(np.ones(len(sets), bool)), kept), z[flag["c"]], np.asarray(got.column("toxic").fill_null(0), dtype=np.float64)[flag["c"]])


def _hash_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            flat, off = features(batch.column("text"))
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols["slots"] = pa.array([flat[a:b].astype(np.int32).tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict({c: cols[c] for c in ("doc_id", "slots", "toxic", "p", "u", "c")})


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d1, d0 = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for x, p, u in zip(batch.column("slots").to_pylist(), batch.column("p").to_pylist(), batch.column("u").to_pylist(), strict=True):
            own = np.frombuffer(x, np.int32)  # distinct within a text
            d1[own] += p
            d0[own] += u
    some = np.flatnonzero(d1 + d0)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(some, pa.int32()), "d1": pa.array(d1[some]), "d0": pa.array(d0[some])})


def _chosen(kept: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int32) for x in batch.column("slots").to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols["places"] = pa.array(columns_of(np.concatenate([np.zeros(0, np.int32), *sets]), off, kept), pa.binary())
            yield pa.RecordBatch.from_pydict({c: cols[c] for c in ("doc_id", "places", "toxic", "p", "u", "c")})

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` to each row, from the whole text, however long; null and empty texts get the score of a text without
    words, equal texts have equal scores, and a score at the threshold counts as above it. Other columns stay, but
    for one named ``score``; without rows, there are none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                cols["score"] = pa.array(shared.value.score(batch.column("text")), pa.float64())
                yield pa.RecordBatch.from_pydict(cols)

    rest = docs.drop("score")
    return small_batches(rest).mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType())]))


THRESHOLD = 0.7


def op6_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(documents(spark, sf_dir))
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", (fold_column(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

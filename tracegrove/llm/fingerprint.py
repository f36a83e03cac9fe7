"""Document fingerprints by I-Match over randomised lexicon subsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrove.llm._tables import documents, id_and_text, small_batches
from tracegrove.llm._text import CHUNK_BYTES, Words, buffer_of, chunks, distinct_per_text, mix

#: Shares of the documents between which a term is in the band. The lower one bounds the
#: lexicon by the mean number of distinct words of a document divided by it, at any corpus size.
BAND = (0.0005, 0.2)
#: Subsets keep a half, a quarter, ... of the lexicon; LEVELS such shares with EACH subsets.
LEVELS, EACH = 10, 12
#: A text with fewer terms in the band is filled up to so many with those nearest to it: more common ones, the rarest of
#: them first, then rarer ones, of which the lexicon knows no counts, by their hashes. So texts on either side of the
#: limit that differ in a term differ in few of the terms that count.
FEW = 8
#: Rows of a bucket of neighbours, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 2000, 20_000

_SALTS = mix(np.arange(1, EACH + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_NONE = np.uint16(0)
#: Hashes counted in a worker before they are handed on.
FLUSH = 1 << 21


def word_counts(docs: DataFrame) -> DataFrame:
    """term, n: documents that hold the term, by its hash; each task adds up what it reads first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pydict({"term": pa.array(term.view(np.int64)), "n": pa.array(n, pa.int64())})

        for whole in batches:
            for batch in chunks(whole, "text", CHUNK_BYTES):
                words = Words(*buffer_of(batch.column("text")))
                held.append(distinct_per_text(words.hash, words.of_word(), batch.num_rows)[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return small_batches(docs.select("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Lexicon(NamedTuple):
    """Sorted hashes of the terms in the band, and those of more common terms, the rarest of them first."""

    terms: np.ndarray
    common: np.ndarray


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> Lexicon:
    """The terms from the band's lower bound on; their number is bounded as BAND says."""
    total = docs.count()
    top = max(2, band[1] * total)
    rows = word_counts(docs).where(F.col("n") >= max(2, band[0] * total)).toArrow()
    term, n = np.asarray(rows.column("term"), dtype=np.int64).view(np.uint64), np.asarray(rows.column("n"), dtype=np.int64)
    over = n > top
    return Lexicon(np.sort(term[~over]), term[over][np.lexsort((term[over], n[over]))])


def _in(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def counted(h: np.ndarray, owner: np.ndarray, n: int, lex: Lexicon) -> np.ndarray:
    """Which of the texts' distinct terms count: those in the band, and the nearest others of texts with few of them."""
    inside = _in(h, lex.terms)
    few = np.bincount(owner[inside], minlength=n) < FEW
    own = np.flatnonzero(few[owner])
    if len(own):
        far = np.where(inside[own], 0, len(lex.common) + 1)
        if len(lex.common):
            order = np.argsort(lex.common)
            at = np.minimum(np.searchsorted(lex.common, h[own], sorter=order), len(order) - 1)
            known = (lex.common[order[at]] == h[own]) & ~inside[own]
            far[known] = 1 + order[at[known]]
        rank = np.lexsort((h[own], far, owner[own]))
        of = owner[own][rank]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        inside[own[rank[place < FEW]]] = True
    return inside


def fingerprints(texts: pa.Array, lex: Lexicon) -> np.ndarray:
    """One row of 16-bit digests a text, 0 where a subset keeps none of its terms.

    Each of EACH seeds ranks the terms at random; the subsets of its levels are the first half, quarter, ... of that order.
    """
    words = Words(*buffer_of(texts))
    n = len(texts)
    h, off = distinct_per_text(words.hash, words.of_word(), n)
    owner = np.repeat(np.arange(n), np.diff(off))
    keep = counted(h, owner, n, lex)
    h, owner = h[keep], owner[keep]
    out = np.zeros((n, LEVELS, EACH), np.uint16)
    for e, salt in enumerate(_SALTS):
        own, of = mix(h ^ salt), owner
        for level in range(LEVELS):
            kept = own < np.uint64(1 << (63 - level))
            own, of = own[kept], of[kept]
            # the terms of a text come sorted and distinct, so that the sum stands for the list
            run = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), out=run[1:])
            off = np.searchsorted(of, np.arange(n + 1))
            total = run[off[1:]] - run[off[:-1]]
            out[:, level, e] = np.where(off[1:] == off[:-1], _NONE, np.maximum(mix(total ^ np.uint64(level)) >> np.uint64(48), np.uint64(1)).astype(np.uint16))
    return out.reshape(n, LEVELS * EACH)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the subsets at one level that keep terms of either text, the share that agrees; the best level with half of its subsets in use.

    Equal fingerprints have likeness 1, also where both are empty.
    """
    a, b = a.reshape(-1, LEVELS, EACH), b.reshape(-1, LEVELS, EACH)
    used = ((a != 0) | (b != 0)).sum(2)
    same = ((a == b) & (a != 0)).sum(2)
    share = np.where(used >= EACH // 2, same / np.maximum(used, 1), 0.0)
    every = np.where(used.sum(1) > 0, same.sum(1) / np.maximum(used.sum(1), 1), 1.0)
    out = np.maximum(share.max(1), every)
    return np.where((a == b).all((1, 2)), 1.0, out)


def written(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


_LEAST_ID = -(1 << 63)


def neighbours(docs: DataFrame) -> DataFrame:
    """Deals the rows to buckets of ids; in each, rows come in descending doc_id, then the row that follows them all.

    Columns bucket, ahead (that copy), doc_id, text; sorted within partitions. Equal ids are
    ordered by their texts, null ids come last, and after the last row comes the first again. The
    driver holds one id a bucket, MOST_BUCKETS at most; larger buckets are sorted on disk.
    """
    total, top = docs.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    n = max(1, min(MOST_BUCKETS, total // BUCKET_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    tops = np.array(sorted({*(cuts or []), _LEAST_ID if top is None else top}), np.int64)  # ids that occur

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                ids = np.asarray(batch.column("doc_id").fill_null(_LEAST_ID))
                at = np.searchsorted(tops, ids)
                first = np.flatnonzero(tops[at] == ids)
                rows = batch.take(pa.array(np.concatenate([np.arange(len(ids)), first])))
                bucket = np.concatenate([at, (at[first] + 1) % len(tops)])
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "ahead": pa.array(np.arange(len(bucket)) >= len(ids)), "doc_id": rows.column("doc_id"), "text": rows.column("text")})

    dealt = small_batches(docs).mapInArrow(deal, "bucket int, ahead boolean, doc_id long, text string").repartition(len(tops), "bucket")
    return dealt.sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())


def edits(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last third, of n_chars // 3 code points, replaced by as many first
    ones (or all) of the next document. A null text counts as empty; repeated rows are neighbours; texts of any
    length are taken whole, as one chunk each; without rows, there are none. Columns but doc_id and text aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for whole in batches:
            for part in chunks(whole, "text"):
                rows = pa.Table.from_batches([part] if carry is None else [carry, part]).combine_chunks()
                carry = part.slice(part.num_rows - 1)
                if rows.num_rows < 2:
                    continue
                texts = [t or "" for t in rows.column("text").to_pylist()]
                own = np.flatnonzero(~np.asarray(rows.column("ahead"))[:-1])
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][: len(texts[i]) // 3] for i in own]
                prints = fingerprints(rows.column("text").combine_chunks(), shared.value)
                changed = fingerprints(pa.array(edited, pa.large_string()), shared.value)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id").combine_chunks().take(pa.array(own)),
                        "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                        "fingerprint": pa.array(written(prints[own]), pa.string()),
                        "edited_fingerprint": pa.array(written(changed), pa.string()),
                        "near_edited": pa.array(likeness(prints[own], changed)),
                        "near_next": pa.array(likeness(prints[own], prints[own + 1])),
                    }
                )

    return small_batches(neighbours(docs)).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Adds ``fingerprint`` to each row: hexadecimal digests of the lexicon subsets, 0000 where one keeps no term.

    Equal sets of words have equal fingerprints, whatever the texts' lengths; null and empty texts have none but zeros;
    repeated rows stay. Other columns stay, but for one named ``fingerprint``; without rows, there are none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                cols["fingerprint"] = pa.array(written(fingerprints(batch.column("text"), shared.value)), pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    rest = docs.drop("fingerprint")
    return small_batches(rest).mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("fingerprint", T.StringType())]))


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(documents(spark, sf_dir))
    return edits(docs, lexicon(docs))

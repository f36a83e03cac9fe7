"""Vectorised text kernel shared by the operators that run in Python workers.

A batch of UTF-8 texts is one byte buffer with offsets; words, word hashes and
word n-gram hashes come out as flat numpy arrays, without a Python loop over
words. Hashes depend on the bytes only, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NGRAM = np.uint64(0xD1B54A32D192ED03)

#: Lower-cases A-Z, keeps 0-9, a-z and bytes of non-ASCII characters, maps the rest to 0.
WORD_BYTES = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        WORD_BYTES[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        WORD_BYTES[_b] = _b + 32

#: Bytes that are no ASCII white space.
INK_BYTES = np.ones(256, np.uint8)
INK_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        out[0] = 1
        _powers[name] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text each, one row at least."""
    _, offsets = buffer_of(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a batch of texts.

    hash: 64-bit hash of each word; start, end: its bytes; first: n + 1 offsets
    of the texts' words, so text i has the words first[i] to first[i + 1].
    """

    __slots__ = ("_run", "data", "end", "first", "hash", "offsets", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTES, hashed: bool = True):
        self.data, self.offsets = data, offsets
        low = table[data]
        ink = low != 0
        begins, ends = ink.copy(), ink.copy()
        if len(ink):
            begins[1:] &= ~ink[:-1]
            ends[:-1] &= ~ink[1:]
            edge = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[edge] = ink[edge]
            edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            ends[edge] = ink[edge]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashed:
            n = len(data)
            run = np.zeros(n + 1, np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n + 1, "up")[:n], out=run[1:])
            whole = (run[self.end] - run[self.start]) * _power(_BASE_INV, n + 1, "down")[self.start]
            self.hash = mix(whole + (self.end - self.start).astype(np.uint64))
            self._run = run

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the first n bytes of each word, and whether it is longer than that."""
        long = self.end - self.start > n
        at = np.where(long, self.start + n, self.start)
        part = (self._run[at] - self._run[self.start]) * _power(_BASE_INV, len(self._run), "down")[self.start]
        return mix(part ^ np.uint64(n * 0x9E3779B1)), long

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they stay within the text."""
        h, total = self.hash, len(self.hash)
        out = np.zeros(total, np.uint64)
        if total >= n:
            m = total - n + 1
            acc = h[:m].copy()
            for j in range(1, n):
                acc = acc * _NGRAM + h[j : j + m]
            out[:m] = mix(acc)
        last = np.repeat(self.first[1:], self.count) - n
        return out, np.arange(total) <= last

    def of_word(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words_of(texts: pa.Array, table: np.ndarray = WORD_BYTES, hashed: bool = True) -> Words:
    return Words(*buffer_of(texts), table, hashed)


def distinct_per_text(values: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, flat, and n + 1 offsets."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[keep], t[keep]
    return v, np.searchsorted(t, np.arange(n_texts + 1))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text, sorted, flat, and offsets.

    A text of fewer words than ``size``, but not none, has one shingle: all its words.
    """
    gram, ok = words.ngrams(size)
    text = words.of_word()
    values, owner = gram[ok], text[ok]
    count = words.count
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k, i in enumerate(short):
            acc = np.zeros(1, np.uint64)
            for h in words.hash[words.first[i] : words.first[i + 1]]:
                acc = acc * _NGRAM + h
            extra[k] = mix(acc + np.uint64(int(count[i])))[0]
        values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    return distinct_per_text(values, owner, len(count))

"""Secret scans: patterns, and novelty under dictionary-primed zstandard."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import cache
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrove.llm._tables import documents, id_and_text, small_batches
from tracegrove.llm._text import CHUNK_BYTES, buffer_of, chunks

# The base patterns and their least lengths. ASCII letters only, in either case where so stated.
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: A word that makes its line and the next one a sensitive context.
SENSITIVE = re.compile(r"(?i:passw|passphrase|secret|token|api[_ -]?key|private[_ -]?key|credential|bearer|authorization)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Runs of letters as names have them: a capital and small letters, or letters of one case.
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
#: Numbers that touch a letter.
NUMBER = re.compile(r"(?<=[A-Za-z])[0-9]+|[0-9]+(?=[A-Za-z])")
#: A string all of whose letters stand in humps of so many reads as words.
WORD_LETTERS = range(3, 16)
#: Bits that a candidate must be able to hold: those of its kinds of signs, and of words so many a letter and a digit.
BITS, WORD_BITS, DIGIT_BITS = 60.0, 3.0, 3.3
#: Share of the price of random signs of the same kinds from which a string counts as incompressible.
NOVELTY = 0.92
#: What a string that reads as words must cost besides, in marginal compressed bytes a code point.
WORD_PRICE = 0.81
#: Words common in code, for the identifier dictionary.
WORDS = (
    "password secret token key access private public client credential authorization bearer user name email config configuration setting "
    "environment default example placeholder function return class import export static string integer boolean null true false value index count "
    "size length list array map object type file path folder directory page guide doc docs start started getting end first last next previous "
    "create update delete insert select find load save read write open close send receive request response handler manager service server "
    "controller factory builder provider adapter connection pool database table column record query cache session cookie header body message "
    "event listener queue worker task job thread process http https localhost url host port api version release build test debug error warning "
    "info log report final date time year month day local remote master main primary secondary temp sample algorithm cipher digest hash hashing "
    "encryption signature certificate random sequence number text format convert parse encode decode validate check verify internal external"
).split()
#: Bytes of text of a dictionary; a longer text has several, of which the one that explains a candidate best counts.
DICTIONARY, OVERLAP = 1 << 20, 1 << 10
#: Characters of the filler, and the shares of upper case letters, digits and other signs in it.
FILLER, UPPER, DIGITS, SIGNS = 3000, 0.08, 0.015, 0.08


def _identifiers() -> bytes:
    """Years, days, alphabets and the words in three cases."""
    days = (f"{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 32))
    return " ".join([*map(str, range(1990, 2040)), *days, ascii_lowercase, ascii_uppercase, "01234567890", *(w.upper() for w in WORDS[:30]), *(w.capitalize() for w in WORDS), *WORDS]).encode()


def _filler() -> bytes:
    """Letters, digits and signs as often as identifiers have them, but no words.

    zstandard stores short inputs as they are. Behind the filler, a candidate's characters go into one entropy
    code with those of the filler, so that they cost what their rarity in identifiers tells.
    """
    rng = np.random.default_rng(7)
    letters = np.array(list("etaoinshrdlcumwfgypbvkjxqz"))
    share = 1 / np.arange(2, 28) ** 1.3
    drawn = rng.choice(letters, FILLER, p=share / share.sum())
    kind = rng.random(FILLER)
    drawn = np.where(kind < UPPER, np.char.upper(drawn), drawn)
    drawn = np.where(kind > 1 - DIGITS, rng.choice(list("0123456789"), FILLER), drawn)
    return "".join(np.where((kind > 1 - DIGITS - SIGNS) & (kind <= 1 - DIGITS), rng.choice(list("__--//  ..+="), FILLER), drawn)).encode()


IDENTIFIERS, _FILL = _identifiers(), _filler()

_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
_HINTS = ("passw", "secret", "token", "key")
_MORE_HINTS = ("passphrase", "credential", "bearer", "authorization")


def base_spans(text: str, maybe_hex: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns by start, then kind as listed; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if maybe_hex:
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def pricer(around: bytes) -> Callable[[str], int]:
    """A function that gives the compressed bytes that a candidate adds, with ``around`` and common identifiers as dictionary."""
    body = IDENTIFIERS + b"\n" + around
    size = len(body).bit_length() + 1
    how = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, window_log=size, hash_log=size, chain_log=size, search_log=6, min_match=6, target_length=64,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    primed = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(compression_params=how)
    press = zstandard.ZstdCompressor(dict_data=primed, compression_params=how)
    empty = len(press.compress(_FILL))
    return lambda candidate: len(press.compress(_FILL + candidate.encode())) - empty


def _kinds(candidate: str) -> list[int]:
    """Small letters, capitals, digits and other signs of a string."""
    low, up, digits = (sum(f(c) for c in candidate) for f in (str.islower, str.isupper, str.isdigit))
    return [low, up, digits, len(candidate) - low - up - digits]


def reads_as_words(candidate: str) -> bool:
    """Whether all letters stand in humps as long as words, with one number at most at their ends (two in mixed case); strings without letters don't."""
    humps = HUMP.findall(candidate)
    if not humps or not all(len(h) in WORD_LETTERS for h in humps):
        return False
    mixed = any(h[0].isupper() and h[-1].islower() for h in humps)
    return len(NUMBER.findall(candidate)) <= 1 + mixed


def bits(candidate: str) -> float:
    """What a string can hold at most: by the kinds of signs in it, or, if it reads as words, by its letters and digits."""
    n = _kinds(candidate)
    if reads_as_words(candidate):
        return WORD_BITS * (n[0] + n[1]) + DIGIT_BITS * n[2]
    return len(candidate) * math.log2(sum(size for size, k in zip((26, 26, 10, 5), n, strict=True) if k))


@cache
def _sign_prices() -> tuple[float, ...]:
    """Mean marginal bytes of a random small letter, capital, digit and other sign."""
    rng, price = np.random.default_rng(5), pricer(b"")
    return tuple(float(np.mean([price("".join(rng.choice(list(signs), 64))) / 64 for _ in range(60)])) for signs in (ascii_lowercase, ascii_uppercase, "0123456789", "+/_=-"))


def is_novel(candidate: str, cost: float, novelty: float = NOVELTY) -> bool:
    """Whether a string costs about what random signs of its kinds do; one that reads as words must be dear on the whole, too."""
    due = sum(n * p for n, p in zip(_kinds(candidate), _sign_prices(), strict=True))
    return cost >= novelty * due and (not reads_as_words(candidate) or cost >= WORD_PRICE * len(candidate))


def sensitive_candidates(text: str) -> list[tuple[int, int]]:
    """Places of strings of BITS and more on lines that hold a sensitive word, or whose line before does."""
    out, at, before = [], 0, False
    for line in text.split("\n"):
        own = SENSITIVE.search(line) is not None
        if own or before:
            out += [(at + m.start(), at + m.end()) for m in CANDIDATE.finditer(line) if bits(m[0]) >= BITS]
        before, at = own, at + len(line) + 1
    return out


def novel_spans(text: str, novelty: float = NOVELTY) -> list[tuple[str, int, int]]:
    """Strings in a sensitive context that the rest of the whole text, without any such string, doesn't explain.

    A candidate has 12 signs of letters, digits and +/_=- at least and can hold 60 bits: 12 of small letters and digits,
    11 of letters of both cases, 13 of letters of one case, 19 digits; but if it reads as words, 3 bits a letter count.
    So a secret that stands in two sensitive contexts is no explanation of itself, while any other copy of it is one.
    """
    low = text.lower()
    if not any(h in low for h in _HINTS + _MORE_HINTS):
        return []
    places = sensitive_candidates(text)
    if not places:
        return []
    edge = [0, *(x for p in places for x in p), len(text)]
    rest = "\n".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)).encode("utf-8", "surrogatepass")
    cost: dict[str, int] = {}
    for at in range(0, max(1, len(rest) - OVERLAP), DICTIONARY):
        price = pricer(rest[at : at + DICTIONARY + OVERLAP])
        for own in {text[a:b] for a, b in places}:
            cost[own] = min(price(own), cost.get(own, 1 << 62))
    return [("novel", a, b) for a, b in places if is_novel(text[a:b], cost[text[a:b]], novelty)]


def _has_hex(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text may hold a run of 32 or more hex digits: runs of bytes, texts run together."""
    ink = np.concatenate([[False], _HEX_BYTES[data], [False]])
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= LEAST["hex"]
    out = np.zeros(len(offsets) - 1, bool)
    for b, e in zip(begin[long], end[long], strict=True):  # a run can span texts that touch; each is looked at
        out[np.searchsorted(offsets, b, "right") - 1 : np.searchsorted(offsets, e - 1, "right")] = True
    return out


_SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def scan_secrets(docs: DataFrame, novelty: float = NOVELTY) -> DataFrame:
    """Adds ``secrets``, an array of (kind, start, end) over the whole text, to each row.

    Kinds are assign, access and hex (the base patterns) and novel (the method's); spans of a kind that tie in their start
    come by their end. Null and empty texts have none; texts of any length are scanned whole, and all of a text explains
    a candidate; repeated rows are scanned alike; without rows, there are none; other columns stay, but
    for one named ``secrets``. Rows are independent: no shuffle, and a lost executor repeats its own tasks only.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK_BYTES):
                data, offsets = buffer_of(batch.column("text"))
                found = []
                for text, maybe in zip(batch.column("text"), _has_hex(data, offsets), strict=True):
                    t = text.as_py() or ""
                    base = base_spans(t, bool(maybe))
                    spans = sorted({*base, *novel_spans(t, novelty)}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                    found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                cols["secrets"] = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_pydict(cols)

    rest = docs.drop("secrets")
    return small_batches(rest).mapInArrow(scan, T.StructType([*rest.schema.fields, T.StructField("secrets", T.ArrayType(_SCHEMA))]))


def op9_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(id_and_text(documents(spark, sf_dir)))
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(of(*KINDS[:3])), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )

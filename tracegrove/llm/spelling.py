"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.llm._tables import cut, documents, id_and_text

#: Code points of a word at least, and its occurrences at least.
LEAST_CHARS, LEAST_COUNT = 5, 3
#: A run whose checksum this divides loses a code point.
DAMAGE = 97
#: A form occurs so many times as often as its variant at least.
FORM_RATIO = 2
#: A posting with more than this part of all entries is split, so that at most as many postings are.
HOT_PART = 1000
#: Entries up to which no posting is split.
HOT_LEAST = 500

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """doc_id (as text) and run: each maximal run of letters of ``docs`` (doc_id, text), A-Z in lower case; null texts have none."""
    each = F.explode(F.split(F.translate("text", _UPPER, _LOWER), "[^a-zÀ-ÿ]+"))
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), each.alias("run")).where("run <> ''")


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without the code point at (crc32 of ``doc_id:run``) % its length if DAMAGE divides the checksum."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, 1, at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts, counted from the map side on."""
    found = runs(docs).select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    return found.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def bigrams(word: Column) -> Column:
    """The word's set of bigrams, as a bitmap of 64 hashed places."""
    place = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.substring(word, i, 2)), F.lit(64)).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(word) - 1), F.lit(0).cast("long"), lambda have, i: have.bitwiseOR(place(i)))


def _posting(length: Column, longer: int, at: Column, gram: Column) -> Column:
    """A posting's number; the gram's position and both lengths are part of it. Equal numbers of different postings cost candidates only."""
    return F.xxhash64(length, F.lit(longer), at, gram)


def _entries(longer: int) -> Column:
    """The postings in which a word stands: as long as the word that looks for it, or one longer.

    Grams have half the length of the shorter word, rounded down. One edit cannot touch both its first and its last
    gram, so that these two are all that need postings: the first stays where it is if the edit comes after it, the
    last moves by the difference of the lengths if the edit comes before it.
    """
    length = F.char_length("word") - longer
    q = F.floor(length / 2).cast("int")
    first, last = F.substring("word", F.lit(1), q), F.substring("word", F.char_length("word") - q + 1, q)
    return F.array(_posting(length, longer, F.lit(0), first), _posting(length, longer, F.lit(1), last))


def _lookups(longer: int) -> Column:
    """The postings that a word looks up for words as long as it is, or one longer."""
    length = F.char_length("word")
    q = F.floor(length / 2).cast("int")
    first, last = F.substring("word", F.lit(1), q), F.substring("word", length - q + 1, q)
    return F.array(_posting(length, longer, F.lit(0), first), _posting(length, longer, F.lit(1), last))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb: each pair of ``words`` (word, n) that differ by exactly one inserted, deleted or replaced code point, once.

    Postings of positional q-grams, sorted by their numbers, are merged by a sort-merge join; within it, a pair's
    bigram bitmaps must differ by no more than one edit makes them (two bigrams a side), and a banded edit distance decides.
    A posting beyond a thousandth of all entries is split into blocks that each lookup meets, so none is one task's work.
    """
    rows = words.select("word", "n", bigrams(F.col("word")).alias("bits"))
    index = rows.withColumn("posting", F.explode(F.concat(_entries(0), F.when(F.char_length("word") > 1, _entries(1)).otherwise(F.array().cast("array<bigint>")))))
    total = index.count()
    size = max(total // HOT_PART, HOT_LEAST)
    # at most total / size rows, a thousand
    hot = F.broadcast(index.groupBy("posting").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > size).select("posting", F.ceil(F.col("c") / size).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    index = index.join(hot, "posting", "left").select("posting", F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    look = rows.withColumn("posting", F.explode(F.concat(_lookups(0), _lookups(1)))).join(hot, "posting", "left")
    look = look.select(F.col("posting").alias("wanted"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"), F.col("word").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    order = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    overlap = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= 4
    same = (F.col("wanted") == F.col("posting")) & (F.col("part") == F.col("block"))
    met = look.hint("merge").join(index.hint("merge"), same & order & overlap & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "na", "b", "nb").distinct()


def followed(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): the last that forms lead to.

    A form occurs twice as often as its variant, so paths are short; each step doubles them.
    """
    now = forms.select("word", F.col("form").alias("to"))
    while True:
        ahead = now.select(F.col("word").alias("to"), F.col("to").alias("next"))
        step = cut(now.join(ahead, "to", "left"))
        if step.where("next IS NOT NULL").isEmpty():
            return step.select("word", F.col("to").alias("root"))
        now = step.select("word", F.coalesce("next", "to").alias("to"))


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``docs`` (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case, some damaged (see ``damaged``), of
    ``least_chars`` code points and ``least_count`` occurrences at least. A word's form is its most frequent near word (of
    equal ones the least in code-point order), if that occurs ``ratio`` times as often at least; root is where forms end,
    the word itself without one. Null and empty texts have no words; a null doc_id counts as an empty one; repeated
    rows count each; texts and words of any length are taken whole; other columns aren't read; no rows give none.
    """
    words = cut(counted(docs.select("doc_id", "text"), least_chars, least_count))
    pairs = cut(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), "b")).alias("top"))
    rows = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    found = -F.col("top.m") >= ratio * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(found, F.col("top.b")).alias("form"), F.when(found, -F.col("top.m")).alias("form_n")))
    roots = followed(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_qgram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(id_and_text(documents(spark, sf_dir)))

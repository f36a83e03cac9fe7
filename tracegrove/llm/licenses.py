"""License scans by a positional rare-token index, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.llm._tables import documents, id_and_text, unused

#: What stands between the words of lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words of a licence notice; ``key`` is the part, from word to word, that must be there in full."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool = False


def _t(label: str, text: str, base: bool = False, key: tuple[int, int] | None = None) -> Template:
    words = tuple(text.split())
    return Template(label, words, key or (0, len(words)), base)


# The base phrases with their labels.
BASE = (
    _t("gpl", "gnu general public license", True),
    _t("apache", "apache license", True),
    _t("cc-by", "cc by", True),
    _t("mit", "mit license", True),
)
# Notices of common licences, with the key phrase of each.
NOTICES = (
    _t("gpl", "this work is licensed under the gnu general public license version", key=(6, 10)),
    _t("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", key=(3, 5)),
    _t("lgpl", "gnu lesser general public license"),
    _t("agpl", "gnu affero general public license"),
    _t("apache", "licensed under the apache license version 2 0", key=(3, 5)),
    _t("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", key=(0, 7)),
    _t("mit", "released under the mit license", key=(3, 5)),
    _t("bsd", "redistribution and use in source and binary forms with or without modification are permitted", key=(0, 8)),
    _t("bsd", "bsd license"),
    _t("isc", "permission to use copy modify and or distribute this software for any purpose", key=(0, 5)),
    _t("mpl", "mozilla public license"),
    _t("epl", "eclipse public license"),
    _t("cc-by", "creative commons attribution"),
    _t("cc-by-nc", "cc by nc"),
    _t("cc-by-sa", "cc by sa"),
    _t("cc-by-nd", "cc by nd"),
    _t("cc0", "cc0 1 0 universal", key=(0, 3)),
    _t("unlicense", "this is free and unencumbered software released into the public domain", key=(4, 6)),
    _t("apache", "you may not use this file except in compliance with the license", key=(2, 10)),
    _t("apache", "distributed on an as is basis without warranties or conditions of any kind", key=(3, 11)),
    _t("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", key=(1, 9)),
    _t("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", key=(0, 7)),
    _t("gpl", "either version 3 of the license or at your option any later version", key=(7, 13)),
    _t("lgpl", "gnu library general public license"),
    _t("gfdl", "gnu free documentation license"),
    _t("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", key=(0, 7)),
    _t("bsl", "boost software license"),
    _t("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", key=(4, 13)),
    _t("artistic", "artistic license"),
    _t("cddl", "common development and distribution license"),
    _t("eupl", "european union public licence"),
    _t("ms-pl", "microsoft public license"),
    _t("psf", "python software foundation license"),
    _t("postgresql", "postgresql license"),
    _t("ofl", "sil open font license"),
    _t("odbl", "open database license"),
    _t("wtfpl", "do what the fuck you want to public license", key=(1, 7)),
    _t("cc-by-sa", "creative commons attribution sharealike", key=(0, 4)),
    _t("cc-by-nc", "creative commons attribution noncommercial", key=(0, 4)),
    _t("cc0", "creative commons zero"),
    _t("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", key=(3, 8)),
)
#: Rare words of a template that the index holds; each phrase has as many or more.
RARE = 2
#: Share of a notice's words that must stand in their places.
LEAST = 0.75


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def _words(text: str = "text") -> Column:
    # of the letters beyond A-Z that lower() changes, only the Kelvin sign becomes an ASCII one
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\u212a"), F.lit("\ufffd"))), BETWEEN), "")


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[int, dict[str, int]]:
    """Documents, and for each word of the templates how many hold it: one row a word, whatever the corpus' size."""
    vocab = vocabulary(templates)
    held = docs.select(F.explode(F.array_intersect(_words(), F.array(*map(F.lit, vocab)))).alias("w"))
    found = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return docs.count(), {w: found.get(w, 0) for w in vocab}


def rare_words(t: Template, n: int, df: dict[str, int]) -> list[tuple[int, str]]:
    """Offsets and words of the RARE highest inverse document frequencies in the key phrase; the first of equal ones."""
    at = sorted(range(*t.key), key=lambda i: (-math.log((n + 1) / (df[t.words[i]] + 1)), i))
    return [(i, t.words[i]) for i in sorted(at[:RARE])]


def scan_licenses(docs: DataFrame, notices: tuple[Template, ...] = NOTICES, least: float = LEAST) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score to each row.

    One index tells for each rare word of a template which templates have it, and at which offset. Each occurrence of such a
    word in a text is looked up once and gives places where notices can begin; the places that both rare words of
    a template give, its postings' intersection, stay. There the key phrase is compared word by
    word, and then the whole notice. A base phrase is its own key phrase, so that all its places are
    found, whatever the counts.

    Null and empty texts have no words, no labels and score 0; texts of any length are scanned whole; repeated rows are
    scanned alike; of places that tie, all count; without rows, there are none. Columns named like the new
    ones are replaced, all others stay. ``score`` is the greatest share of a notice found in place, of those with
    their key phrase.
    """
    templates = (*BASE, *notices)
    rest = docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    words, places, starts, hits = unused(rest.columns, "words", "places", "starts", "hits")
    n, df = document_frequencies(rest.select("text"), templates)
    index: dict[str, list[Column]] = {}
    for k, t in enumerate(templates):
        for offset, word in rare_words(t, n, df):
            index.setdefault(word, []).append(F.struct(F.lit(k).alias("t"), F.lit(offset).alias("o")))
    table = F.create_map(*(c for w, where in sorted(index.items()) for c in (F.lit(w), F.array(*where))))
    rare = sorted(index)
    of = lambda values: F.array(*map(F.lit, values))
    whole, key = (F.array(*(of(x) for x in y)) for y in ([t.words for t in templates], [t.words[slice(*t.key)] for t in templates]))
    key_at, labels, needed = of(t.key[0] for t in templates), of(t.label for t in templates), of(1.0 if t.base else least for t in templates)
    pick = lambda array, h: F.element_at(array, h["t"] + 1)

    out = rest.withColumn(words, _words())
    met = F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    out = out.withColumn(places, F.when(F.arrays_overlap(words, of(rare)), met).otherwise(F.array().cast("array<int>")))
    begins = F.flatten(F.transform(places, lambda i: F.transform(F.element_at(table, F.get(words, i)), lambda p: F.struct(p["t"].alias("t"), (i - p["o"]).alias("b")))))
    out = out.withColumn(starts, F.when(F.size(places) > 1, F.array_sort(begins)))
    both = F.filter(starts, lambda h, i: (i >= RARE - 1) & F.coalesce(F.get(starts, i - (RARE - 1)) == h, F.lit(False)))
    begin = lambda h: h["b"] + pick(key_at, h)
    stands = lambda h: (begin(h) >= 0) & (F.slice(words, F.greatest(begin(h) + 1, F.lit(1)), F.size(pick(key, h))) == pick(key, h))
    same = lambda h: F.aggregate(F.transform(pick(whole, h), lambda w, j: F.coalesce(F.get(words, h["b"] + j) == w, F.lit(False)).cast("int")), F.lit(0), lambda a, x: a + x)
    found = F.transform(F.filter(both, stands), lambda h: F.struct(h["t"].alias("t"), h["b"].alias("b"), (same(h) / F.size(pick(whole, h))).alias("share")))
    out = out.withColumn(hits, F.coalesce(found, F.array().cast("array<struct<t: int, b: int, share: double>>")))
    base = F.filter(hits, lambda h: h["t"] < len(BASE))
    join = lambda items: F.array_join(F.array_sort(F.array_distinct(F.transform(items, lambda h: pick(labels, h)))), ",")
    return out.select(
        *rest.columns,
        F.size(words).cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["b"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["b"])).cast("long").alias("last_word"),
        join(base).alias("base_labels"),
        join(F.filter(hits, lambda h: h["share"] >= pick(needed, h))).alias("labels"),
        F.coalesce(F.array_max(F.transform(hits, lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )


def op10_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(id_and_text(documents(spark, sf_dir)))
    return out.drop("text")

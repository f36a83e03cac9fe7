"""Lexical search: the query language as column predicates, and ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrove.config import DEFAULT
from tracegrove.functions.text import sigmoid_score, snippet
from tracegrove.functions.trigrams import Condition, conjunction, of_pattern, of_term
from tracegrove.operators.textindex import TextIndex

_ATOM = re.compile(r'(?P<field>r|lang|branch|case|sym|file|content|type):(?P<value>/(?:\\.|[^/])*/|"[^"]*"|\S+)|(?P<term>"[^"]*"|\S+)')


@dataclass(frozen=True)
class Query:
    """A parsed query: fields narrow the files, terms must all occur."""

    terms: tuple[str, ...] = ()
    repo: str | None = None
    lang: str | None = None
    branch: str | None = None
    case: str = "auto"
    symbol: str | None = None
    file: str | None = None
    pattern: str | None = None
    type: str | None = None
    words: list[str] = field(default_factory=list, compare=False)


def parse(text: str) -> Query:
    """``r: lang: branch: case: sym: file: content:/re/ type:`` and terms; white space is a conjunction."""
    got: dict = {}
    terms = []
    names = {"r": "repo", "sym": "symbol", "content": "pattern"}
    for m in _ATOM.finditer(text):
        if m["field"]:
            value = m["value"]
            value = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in '/"' else value
            got[names.get(m["field"], m["field"])] = value
        else:
            terms.append(m["term"].strip('"'))
    return Query(terms=tuple(t for t in terms if t), **got)


def compose(query: str, repos: str | None = None, lang: str | None = None, branch: str | None = None, case: str = "auto") -> str:
    """The query text with its narrowing fields in front."""
    parts = [f"case:{case}" if case != "auto" else "", f"branch:{branch}" if branch else "", f"lang:{lang}" if lang else "", f"r:{repos}" if repos else "", query]
    return " ".join(p for p in parts if p)


def check_pattern(pattern: str) -> str:
    """Refuses what a linear-time engine lacks: look-around and back-references."""
    if re.search(r"\(\?[=!<](?!P)|\\[1-9]", pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern}")
    return pattern


def in_own_case(term: str, case: str = "auto") -> bool:
    return case == "yes" or (case == "auto" and any(c.isupper() for c in term))


def has_term(content: Column, term: str, case: str = "auto") -> Column:
    """Whether the term occurs; with ``auto``, case counts only if the term has an upper-case letter."""
    return F.contains(content, F.lit(term)) if in_own_case(term, case) else F.contains(F.lower(content), F.lit(term.lower()))


def matches(q: Query) -> Column:
    """The predicate of a query over repo, lang, branch, path, content (and symbols if ``sym:`` is used)."""
    conds: list[Column] = []
    if q.repo:
        conds.append(F.col("repo").rlike(check_pattern(q.repo)))
    if q.lang:
        conds.append(F.col("lang") == q.lang)
    if q.branch:
        conds.append(F.contains("branch", F.lit(q.branch)))
    if q.file:
        conds.append(F.col("path").rlike(check_pattern(q.file)))
    if q.symbol:
        conds.append(F.col("content").rlike(rf"(?:^|[^A-Za-z0-9_]){re.escape(q.symbol)}(?:[^A-Za-z0-9_]|$)"))
    if q.pattern:
        conds.append(F.col("content").rlike(check_pattern(q.pattern)))
    conds += [has_term(F.col("content"), t, q.case) for t in q.terms]
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def condition(q: Query) -> Condition:
    """What the trigrams of every matching text meet."""
    parts = [of_term(t, in_own_case(t, q.case)) for t in q.terms]
    parts += [of_term(q.symbol, exact=True)] if q.symbol else []
    return conjunction([*parts, *([of_pattern(q.pattern)] if q.pattern else [])])


def occurrences(content: Column, term: str) -> Column:
    """How often a term occurs, without overlaps and regardless of case."""
    low = F.lower(content)
    return ((F.char_length(low) - F.char_length(F.replace(low, F.lit(term.lower()), F.lit("")))) / max(1, len(term))).cast("int")


def search(files: DataFrame | TextIndex, query: str, top_k: int = DEFAULT.route_limit, threshold: float = 0.0) -> DataFrame:
    """The best ``top_k`` files: rank (from 0), repo, path, doc_id, raw, score, content.

    The raw score counts occurrences of the terms; scores are normalised by a logistic; those below
    ``threshold`` leave before the cut. Ties go by doc_id. Of an index, only candidates' texts are read.
    """
    return search_all(files, [query], top_k, threshold)[0]


def search_all(files: DataFrame | TextIndex, queries: list[str], top_k: int = DEFAULT.route_limit, threshold: float = 0.0) -> list[DataFrame]:
    """``search`` of several queries; an index looks up the candidates of all of them at once."""
    parsed = [parse(q) for q in queries]
    rows = files.narrowed([condition(q) for q in parsed]) if isinstance(files, TextIndex) else [files] * len(parsed)
    return [_best(r, q, top_k, threshold) for r, q in zip(rows, parsed, strict=True)]


def _best(files: DataFrame, q: Query, top_k: int, threshold: float) -> DataFrame:
    raw = reduce(lambda a, b: a + b, (occurrences(F.col("content"), t) for t in q.terms), F.lit(0)).cast("double")
    found = files.where(matches(q)).withColumn("raw", raw)
    best = found.orderBy(F.col("raw").desc(), "doc_id").limit(3 * top_k)
    rows = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("raw")).alias("o"), "doc_id", "repo", "path", "raw", "content"))).alias("r"))
    rows = rows.select(F.posexplode("r").alias("position", "r"), F.size("r").alias("n")).select("position", "n", "r.*").drop("o")
    rows = rows.withColumn("score", sigmoid_score(F.col("raw"), F.col("position"), F.col("n")))
    kept = rows.where(F.col("score") >= threshold).orderBy("position").limit(top_k)
    return kept.select(F.col("position").alias("rank"), "repo", "path", "doc_id", "raw", "score", "content")


def with_snippets(found: DataFrame, query: str, around: int = DEFAULT.context_lines) -> DataFrame:
    """Results with ``snippet``, ``L<n>: <line>`` for each line that matches, and ``start_line`` and ``end_line`` around the first one (null without any).

    A line matches if it holds a term or the symbol, in its own case where that counts, or a match of the pattern.
    """
    q = parse(query)
    tests = [lambda x, t=t: has_term(x, t, q.case) for t in q.terms]
    tests += [lambda x: F.contains(x, F.lit(q.symbol))] if q.symbol else []
    tests += [lambda x: x.rlike(check_pattern(q.pattern))] if q.pattern else []
    holds = lambda x: reduce(lambda a, b: a | b, (t(x) for t in tests), F.lit(False))
    none = F.lit(None).cast("string")
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("line_num"), F.array(F.struct(none.alias("pre"), x.alias("match"), none.alias("post"))).alias("fragments")))
    rows = found.withColumn("_hits", F.filter(lines, lambda m: holds(m["fragments"][0]["match"])))
    first = F.get("_hits", F.lit(0))["line_num"]
    return rows.withColumns({"snippet": snippet(F.coalesce("_hits", F.array().cast(rows.schema["_hits"].dataType))), "start_line": F.when(first.isNotNull(), F.greatest(F.lit(1), first - around)), "end_line": first + around}).drop("_hits")


def list_repos(files: DataFrame, query: str = "", top_k: int = 50) -> DataFrame:
    """Distinct repositories whose name matches, in order of first appearance by doc_id."""
    rows = files.where(F.col("repo").rlike(check_pattern(query))) if query else files
    return rows.groupBy("repo").agg(F.min("doc_id").alias("first")).orderBy("first").limit(top_k)


def tokens(content: Column) -> Column:
    return F.regexp_extract_all(F.lower(content), F.lit("[a-z0-9_]+"), F.lit(0))


def postings(files: DataFrame) -> DataFrame:
    """term, doc_id, tf: the inverted index."""
    return files.select("doc_id", F.explode(tokens(F.col("content"))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def bm25(files: DataFrame, terms: list[str], k1: float = DEFAULT.bm25_k1, b: float = DEFAULT.bm25_b, top_k: int = 20) -> DataFrame:
    """doc_id and BM25 score of the best files for a few terms; only the terms' counts are kept of each text."""
    counted = files.select("doc_id", tokens(F.col("content")).alias("t"))
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    tf = [count(w).alias(f"tf{i}") for i, w in enumerate(terms)]
    rows = counted.select("doc_id", F.size("t").alias("len"), *tf)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))))
    rows = rows.where(reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(len(terms))))).crossJoin(F.broadcast(stats))  # one row
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    score = reduce(lambda x, y: x + y, (part(i) for i in range(len(terms))))
    return rows.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(top_k)

"""Search: lanes as sub-plans, fused and reranked in one plan."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrove.config import DEFAULT, Config
from tracegrove.functions.text import classify_query, entity_tokens, fallback_rewrite, numbered_lines
from tracegrove.operators import fusion, lexical
from tracegrove.operators.textindex import TextIndex


class Lane(Protocol):
    """A retrieval lane: rank, repo, path, title, content, score, source for a query."""

    def __call__(self, query: str, limit: int) -> DataFrame: ...


def evaluated(spark: SparkSession, column) -> object:  # noqa: ANN001
    """The value of an expression over literals."""
    return spark.range(1).select(column.alias("v")).first()["v"]


@dataclass
class Searcher:
    """Unified search over files (doc_id, repo, lang, branch, path, content) or an index of them, with further lanes and a rewriter if given.

    With ``strict``, as in all named queries, a lane or a rewriter that fails is an error. Without, a search goes on without it, warns, and
    ``failed`` says what failed in the last one and why.
    """

    source: DataFrame | TextIndex
    lanes: dict[str, Lane] = field(default_factory=dict)
    rewriter: object = None
    concepts: dict[str, list[str]] = field(default_factory=dict)
    config: Config = DEFAULT
    strict: bool = False
    failed: dict[str, str] = field(default_factory=dict, init=False)

    @property
    def files(self) -> DataFrame:
        return self.source.files if isinstance(self.source, TextIndex) else self.source

    def _result(self, found: DataFrame) -> DataFrame:
        return found.select("rank", "repo", "path", F.concat_ws("/", "repo", "path").alias("title"), "content", "score", F.lit(None).cast("string").alias("source"))

    def _without(self, name: str, error: Exception) -> None:
        """Goes on without a lane or the rewriter, or not at all if ``strict``."""
        if self.strict:
            raise error
        self.failed[name] = f"{type(error).__name__}: {error}"
        warnings.warn(f"search without {name}: {self.failed[name]}", RuntimeWarning, stacklevel=3)

    def rewrite(self, query: str) -> list[str]:
        """Routes: those of the first concept that the query holds, else the rewriter's, else the fallback's."""
        for concept, symbols in self.concepts.items():
            if concept in query:
                return symbols
        routes: list[str] = []
        if self.rewriter:
            try:
                routes = list(self.rewriter(query))
            except Exception as e:  # noqa: BLE001  a failing rewriter means the fallback, unless strict
                self._without("rewriter", e)
        return routes or evaluated(self.files.sparkSession, fallback_rewrite(F.lit(query)))

    def exact(self, query: str, top_k: int | None = None, threshold: float = 0.0, **narrow: str) -> DataFrame:
        whole = lexical.compose(query, **narrow)
        q = lexical.parse(whole)
        if q.type == "repo":  # repositories, not files
            found = self.repos(q.repo or " ".join(q.terms), top_k or self.config.top_k)
            order = Window.orderBy("first")  # of top_k rows
            text = F.lit(None).cast("string")
            return found.select((F.row_number().over(order) - 1).alias("rank"), "repo", F.lit("").alias("path"), F.col("repo").alias("title"), text.alias("content"), F.lit(1.0).alias("score"), text.alias("source"))
        return self._result(lexical.search(self.source, whole, top_k or self.config.top_k, threshold))

    def hits(self, query: str, top_k: int | None = None, threshold: float = 0.0, **narrow: str) -> DataFrame:
        """Exact results as a user reads them: rank, title, score, the lines that match and the span around the first of them."""
        whole = lexical.compose(query, **narrow)
        found = lexical.with_snippets(lexical.search(self.source, whole, top_k or self.config.top_k, threshold), whole, self.config.context_lines)
        return found.select("rank", F.concat_ws("/", "repo", "path").alias("title"), "score", "snippet", "start_line", "end_line")

    def lane_plan(self, query: str, **narrow: str) -> DataFrame:
        """All lanes' rows: a lexical route for each rewrite, then the other lanes; one that can't be planned is an error or noted in ``failed``."""
        self.failed.clear()
        routes = [lexical.compose(route, **narrow) for route in self.rewrite(query)]
        out = [self._result(found) for found in lexical.search_all(self.source, routes, self.config.route_limit)]
        for name, lane in self.lanes.items():
            try:
                out.append(lane(query, self.config.lane_top_k).select(*out[0].columns))
            except Exception as e:  # noqa: BLE001
                self._without(name, e)
        return fusion.union_lanes(out)

    def natural(self, query: str, top_k: int | None = None, threshold: float = 0.0, **narrow: str) -> DataFrame:
        """Fused and reranked lanes; the threshold comes after the cut."""
        narrow.pop("case", None)
        fused = fusion.rrf_merge(self.lane_plan(query, **narrow), self.config.rrf_k)
        best = fusion.feature_rerank(query, fused, top_k or self.config.top_k)
        return best.where(F.col("score") >= threshold) if threshold > 0 else best

    def search(self, query: str, top_k: int | None = None, threshold: float = 0.0, **narrow: str) -> DataFrame:
        """Exact queries go to the lexical engine as they are, others through all lanes."""
        kind = evaluated(self.files.sparkSession, classify_query(F.lit(query)))
        return (self.exact if kind == "exact" else self.natural)(query, top_k, threshold, **narrow)

    def symbol(self, name: str, top_k: int = 5) -> DataFrame:
        """Files with the symbol as a whole word; without any, files with the term."""
        strict, loose = lexical.search_all(self.source, [f"sym:{name} {name}", name], top_k)
        none = strict.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
        return self._result(strict.unionByName(loose.join(F.broadcast(none)).drop("n")))

    def file(self, path: str, extra: str = "", top_k: int = 5) -> DataFrame:
        return self._result(lexical.search(self.source, f"file:{path} {extra}".strip(), top_k))

    def regex(self, pattern: str, top_k: int = 10) -> DataFrame:
        return self._result(lexical.search(self.source, f"content:/{pattern}/", top_k))

    def repos(self, query: str = "", top_k: int = 50) -> DataFrame:
        return lexical.list_repos(self.files, query, top_k)

    def content(self, repo: str, path: str, start: int = 1, end: int | None = None) -> DataFrame:
        """Numbered lines of one file, the last line given (from 1), and how many it has; no row if there is no such file."""
        one = self.files.where((F.col("repo") == repo) & (F.col("path") == path)).withColumn("lines", F.split("content", "\n"))
        return one.select("repo", "path", numbered_lines(F.col("lines"), F.lit(start), F.lit(end).cast("int")).alias("content"), F.greatest(F.lit(max(start, 1) - 1), F.least(F.lit(end or None).cast("int"), F.size("lines"))).alias("end_line"), F.size("lines").alias("total_lines"))


def render(results: DataFrame) -> DataFrame:
    """One text of numbered results, for reading by people and models."""
    row = F.concat(F.lit("## "), (F.col("rank") + 1).cast("string"), F.lit(". "), F.col("title"), F.lit("\n"), F.substring("content", 1, 200))
    return results.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def entities(spark: SparkSession, query: str) -> list[str]:
    return evaluated(spark, entity_tokens(F.lit(query)))

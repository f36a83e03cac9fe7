"""The dense and the graph lane of unified search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrove.functions.text import result_title
from tracegrove.operators import dense, graph
from tracegrove.operators.chunkstore import ChunkStore, with_id
from tracegrove.plans.search import Lane, entities
from tracegrove.sources.store import kept


def _lane(found: DataFrame, source: str, *ties: str) -> DataFrame:
    """Rows of a lane from repo, path, content, score: ranks from 0 by score, then ``ties``."""
    order = Window.orderBy(F.col("score").desc(), *ties)  # of the lane's few rows
    lines = [F.col(c) if c in found.columns else F.lit(None).cast("int") for c in ("start_line", "end_line")]
    title = result_title(F.col("repo"), F.col("path"), *lines if source == "graph" else ())
    return found.select((F.row_number().over(order) - 1).alias("rank"), "repo", "path", title.alias("title"), "content", "score", F.lit(source).alias("source"))


def dense_lane(own: ChunkStore) -> Lane:
    """The stored chunks nearest to the query by cosine; chunks of one file are rows of their own. Only the query is embedded."""
    call = own.embedder or dense.hash_embedder()

    def lane(query: str, limit: int) -> DataFrame:
        vector = [float(x) for x in call(pd.Series([query]))[0]]
        best = own.search_cells().nearest(own.spark.createDataFrame([(0, vector)], "qid int, q array<double>"), limit, few=True).best
        # a row a neighbour, ``limit`` at most
        found = with_id(own.rows()).join(F.broadcast(best.select("id", "score")), "id")
        return _lane(found.select("repo", "path", "start_line", "content_hash", "content", "score"), "dense", "repo", "path", "start_line", "content_hash")

    return lane


def of_repos(found: DataFrame, repos: list[str] | str | None) -> DataFrame:
    """Rows of the repositories of a list, or of those that have the string in their name."""
    if not repos:
        return found
    return found.where(F.contains("repo", F.lit(repos)) if isinstance(repos, str) else F.col("repo").isin(*repos))


def build_graph(files: DataFrame, path: str) -> None:
    """Writes the graph of files (doc_id, repo, path, content, and ``language`` if paths don't tell it): nodes (nid, kind, name), edges (a, b, type) and files (node, repo, path, content).

    Symbols of one name are one node. Each file is parsed once; too many whose nesting doesn't close are an error.
    """
    language = F.col("language") if "language" in files.columns else graph.language_of(F.col("path"))
    parsed = kept(graph.parse_files(files.select(F.col("doc_id").cast("string").alias("path"), "content", language.alias("language"))))
    tally = parsed.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("failed"), 1)).alias("failed")).first()
    symbol = lambda c: F.concat(F.lit("symbol:"), F.col(c))
    target = F.when(F.col("type") == "DEFINED_IN", F.concat(F.lit("file:"), F.col("dst"))).otherwise(symbol("dst"))
    tables = {
        "nodes": graph.symbols_of(parsed).select(symbol("name").alias("nid"), "kind", "name").distinct(),
        "edges": graph.relations_of(parsed).select(symbol("src").alias("a"), target.alias("b"), "type").distinct(),
        "files": files.select(F.concat(F.lit("file:"), F.col("doc_id").cast("string")).alias("node"), "repo", "path", F.substring("content", 1, dense.CONTENT_LIMIT).alias("content")),
    }
    graph.build_report(tally["n"], tally["failed"], tables["nodes"], tables["edges"])
    for name, rows in tables.items():
        rows.write.option("compression", "zstd").parquet(f"{path}/{name}")


def graph_lane(spark: SparkSession, path: str, repos: list[str] | str | None = None) -> Lane:
    """Files of a written graph within reach of the symbols whose names hold a term of the query.

    ``repos`` leaves out others' files once the reached ones are found and cut.
    """
    nodes, edges, known = (spark.read.parquet(f"{path}/{t}") for t in ("nodes", "edges", "files"))

    def lane(query: str, limit: int) -> DataFrame:
        start = graph.seeds(nodes, entities(spark, query)).select("nid").distinct()
        best = graph.rank_targets(graph.expand_counts(edges, start), "file").orderBy(F.col("score").desc(), "length", "node").limit(limit)
        return _lane(of_repos(best.join(known, "node"), repos), "graph", "length", "node")

    return lane

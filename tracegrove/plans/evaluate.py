"""Evaluation of search configurations over a set of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.operators.evalm import difference, quality


def evaluate(spark: SparkSession, configs: dict[str, Callable[[str], DataFrame]], items: list[tuple[str, str, list[str]]], k: int = 10) -> DataFrame:
    """config, recall and mrr over (id, query, expected paths); each configuration maps a query to ranked rows with ``title``."""
    wanted = spark.createDataFrame([(i, e) for i, _, e in items], "qid string, expected array<string>")
    out = []
    for name, search in configs.items():
        found = [search(q).select(F.lit(i).alias("qid"), (F.row_number().over(_order()) - 1).alias("rank"), F.col("title").alias("path")) for i, q, _ in items]
        judged = quality(reduce(DataFrame.unionByName, found), wanted, k)
        out.append(judged.agg(F.lit(name).alias("config"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"), F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, out)


def _order():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.orderBy(F.col("score").desc(), "title")


def compare(a: Callable[[str], DataFrame], b: Callable[[str], DataFrame], queries: list[str]) -> DataFrame:
    """query, title, only_in: what one of two configurations finds and the other doesn't."""
    return reduce(DataFrame.unionByName, (difference(a(q), b(q)).withColumn("query", F.lit(q)) for q in queries))

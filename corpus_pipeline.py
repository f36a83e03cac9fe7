"""A corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, mixing.

In every stage, texts of any length are taken whole; an empty table gives an empty one; columns beyond those of
documents stay, whatever their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from tracegrove.llm._tables import aside, cut, documents, table


def _ids(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold; it learns from the labels of the stage's own input.

    Null and empty texts are scored like texts without words, repeated rows alike; a score at the threshold goes.
    """
    rows, back = aside(_ids(docs), "score")
    model = toxicity.train(rows.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return back(toxicity.score(rows, model).where(F.col("score") < toxicity.THRESHOLD))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier; a document all of whose lines went has nothing left and goes.

    Null and empty texts, and rows without an id, stay as they are; repeated rows don't take each other out.
    """
    rows, back = aside(_ids(docs), "n_lines", "n_removed")
    out = line_dedup.dedup_lines(rows).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(out)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that similarity links connect.

    Texts without words and rows without an id stay; rows of one id and text stay or go together.
    """
    return ngram_join.one_of_each(_ids(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words, or none, lie in benchmark windows.

    Null and empty texts have no words and stay; repeated rows are judged alike; exactly a twentieth goes.
    """
    return decontaminate.clean(_ids(docs), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; null and empty texts have none, a null source is the last one, repeated rows count one by one."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The engine's views on stored tables, and file sources."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrove.operators import cells, textindex
from tracegrove.operators.graph import language_of
from tracegrove.sources.store import stored

Opened = TypeVar("Opened")

# Suffixes of source files that get indexed.
SOURCE_SUFFIXES = (".java", ".kt", ".py", ".c", ".cc", ".cpp", ".h", ".hpp", ".xml", ".aidl", ".rs")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, repo, lang, branch, path, content: documents in the role of source files."""
    suffix = F.when(F.col("lang") == "en", ".java").when(F.col("lang") == "de", ".cpp").when(F.col("lang") == "fr", ".py").otherwise(".txt")
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("repo"),
        "lang",
        F.lit("main").alias("branch"),
        F.concat(F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.col("text").alias("content"),
    )


_open: dict[tuple[str, str], object] = {}


def _opened(spark: SparkSession, at: str, kind: Callable[[SparkSession, str], Opened]) -> Opened:
    """A stored form, opened once in an application; its place goes by the state of its input."""
    key = (spark.sparkContext.applicationId, at)
    if key not in _open:
        _open[key] = kind(spark, at)
    return _open[key]


def text_index(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    """The stored index of ``code_files``, built at its first use."""
    at = stored(spark, [f"{sf_dir}/documents.parquet"], "texts", lambda to: textindex.build(code_files(spark, sf_dir), to), textindex)
    return _opened(spark, at, textindex.TextIndex)


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit event table, from ``events``; user 0 stands for events without a trace."""
    trace = F.when(F.col("user_id") == 0, "").otherwise(F.col("user_id").cast("string"))
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts_ms"),
        trace.alias("trace_id"),
        F.col("event_type").alias("event"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        (F.col("value") > 100).cast("int").alias("slow"),
        F.col("event_type").alias("tool"),
        F.lit(None).cast("string").alias("stage"),
        F.lit("api").alias("interface"),
        F.col("props").alias("payload_json"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("repo"))


def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, repo, path, content, language: a small source file for each document, whose names are the document's first words of three letters and more."""
    # one match that ends with the third word, so the rest of a text isn't looked at
    first = "(?s)^.*?([a-z]{3,})(?:.*?([a-z]{3,}))?(?:.*?([a-z]{3,}))?"
    word = lambda k: F.coalesce(F.nullif(F.regexp_extract("low", first, k + 1), F.lit("")), F.lit("none"))
    source = F.concat(F.lit("class C"), word(0), F.lit(" {\n  void m_"), word(1), F.lit("(int x) {\n    m_"), word(2), F.lit("(x);\n  }\n}\n"))
    return code_files(spark, sf_dir).withColumn("low", F.lower("content")).select("doc_id", "repo", "path", source.alias("content"), F.lit("java").alias("language"))


def vector_cells(spark: SparkSession, sf_dir: str) -> cells.VectorCells:
    """The stored cells of ``vectors``, built at their first use."""
    at = stored(spark, [f"{sf_dir}/embeddings.parquet"], "cells", lambda to: cells.build(vectors(spark, sf_dir), to), cells)
    return _opened(spark, at, cells.VectorCells)


def index_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("repo_path"))


def index_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the index catalog, from ``orders``; an open order is a running job."""
    started = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "success").otherwise("fail")
    backend = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "lexical").when(F.col("o_orderpriority") == "3-MEDIUM", "dense").otherwise("graph")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo_id"), backend.alias("backend"), started.alias("started_at"), status.alias("status"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, type: parts call suppliers, suppliers are defined in nations, nations are members of regions."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    calls = load(spark, sf_dir, "lineitem").select(node("part", "l_partkey").alias("a"), node("supplier", "l_suppkey").alias("b"), F.lit("CALLS").alias("type")).distinct()
    defined = load(spark, sf_dir, "supplier").select(node("supplier", "s_suppkey").alias("a"), node("nation", "s_nationkey").alias("b"), F.lit("DEFINED_IN").alias("type"))
    member = load(spark, sf_dir, "nation").select(node("nation", "n_nationkey").alias("a"), node("region", "n_regionkey").alias("b"), F.lit("MEMBER_OF").alias("type"))
    return calls.unionByName(defined).unionByName(member)


def scan_source_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SOURCE_SUFFIXES) -> DataFrame:
    """path (below ``root``) and content of source files; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    keep: Column = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("path").endswith(s)
    base = root.rstrip("/")
    rel = F.substring_index(F.col("path"), f"{base}/", -1)
    return files.where(keep).select(rel.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def scan_graph_files(spark: SparkSession, root: str, languages: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """path (below ``root``), content and language of the files that are parsed, of some languages or all; of more than ``limit``, the first by path.

    Suffixes count in either case. With a limit, names are listed without contents, and only so many files are read.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    language = language_of(F.col("path"))
    keep = language.isNotNull() if languages is None else F.coalesce(language.isin(*languages), F.lit(False))
    files = read.load(root).where(keep)
    if limit is not None:
        chosen = [r["path"] for r in files.select("path").orderBy("path").limit(limit).collect()]
        files = read.load(chosen) if chosen else files.limit(0)
    rel = F.substring_index(F.col("path"), f"{root.rstrip('/')}/", -1)
    return files.select(rel.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), language.alias("language"))


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Items of an evaluation set in JSON lines, without its ``_meta`` row and blank lines."""
    return spark.read.schema("_meta string, id string, query string, expected_paths array<string>, category string, notes string").json(path).where("_meta IS NULL AND id IS NOT NULL").drop("_meta")


def read_latencies(spark: SparkSession, path: str, stages: tuple[str, ...]) -> DataFrame:
    """stage and duration_ms of the wanted stages in an event log; lines that don't parse are left out."""
    raw = spark.read.text(path)
    d = F.expr("try_cast(get_json_object(value, '$.duration_ms') AS double)")
    return raw.select(F.get_json_object("value", "$.stage").alias("stage"), d.alias("duration_ms")).where(F.col("stage").isin(*stages) & F.col("duration_ms").isNotNull())


def log_page(spark: SparkSession, path: str, offset: int, page: int = 65536) -> DataFrame:
    """Bytes of a job log from an offset on, one page, and the next offset."""
    whole = spark.read.format("binaryFile").load(path)
    part = F.substring(F.col("content"), offset + 1, page)
    return whole.select(F.make_valid_utf8(part.cast("string")).alias("content"), (F.lit(offset) + F.octet_length(part)).cast("long").alias("next_offset"), (F.lit(offset) + F.octet_length(part) >= F.col("length")).alias("at_end"))

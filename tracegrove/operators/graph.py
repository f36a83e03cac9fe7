"""Symbol graph: extraction, upserts, edge resolution, expansion and scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrove.config import DEFAULT
from tracegrove.functions import source_code

#: Comments of fewer characters are no source of concepts.
COMMENT_CHARS = 20

PARSED = (
    "path string, failed boolean, symbols array<struct<kind: string, name: string, start_line: int, end_line: int, signature: string>>, "
    "relations array<struct<type: string, src: string, dst: string>>, comments array<struct<line: int, text: string>>"
)


def parse_files(files: DataFrame) -> DataFrame:
    """A row for each source file (path, content, and ``language`` if the path doesn't tell it): symbols, relations, comments, and whether its nesting doesn't close.

    Files of other languages than Java, C++ and Python are left out; a null content is an empty one.
    """
    kind = pa.struct([("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string())])
    types = (pa.list_(kind), pa.list_(pa.struct([(c, pa.string()) for c in ("type", "src", "dst")])), pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content, language in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "language")), strict=True):
                try:
                    s = source_code.parse(content or "", language)
                except RecursionError:
                    s = source_code.Source([], [], False)
                symbols = [{"kind": b.kind, "name": b.name, "start_line": b.start, "end_line": b.end, "signature": b.signature} for b in s.blocks]
                found = [{"type": t, "src": a, "dst": b} for t, a, b, _ in source_code.relations(s, path)]
                rows.append((path, not s.whole, symbols, found, [{"line": n, "text": t} for n, t in s.comments]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), *(pa.array(c, t) for c, t in zip(cols[2:], types, strict=True))], names=["path", "failed", "symbols", "relations", "comments"])

    known = language_of(F.col("path")) if "language" not in files.columns else F.coalesce("language", language_of(F.col("path")))
    return files.select("path", "content", known.alias("language")).where("language IS NOT NULL AND path IS NOT NULL").mapInArrow(run, PARSED)


def language_of(path: Column) -> Column:
    """The language that is parsed for a path's suffix, or null."""
    out = F.lit(None).cast("string")
    for suffix, language in source_code.SUFFIXES.items():
        out = F.when(F.lower(path).endswith(suffix), language).otherwise(out)
    return out


def symbols_of(parsed: DataFrame) -> DataFrame:
    """Classes and methods of parsed files, with their lines."""
    return parsed.select("path", F.explode("symbols").alias("s")).select("s.kind", "s.name", "path", "s.start_line", "s.end_line", "s.signature")


def relations_of(parsed: DataFrame) -> DataFrame:
    """DEFINED_IN, MEMBER_OF, INHERITS and CALLS by name, with the file they stand in."""
    return parsed.select("path", F.explode("relations").alias("r")).select("r.type", "r.src", "r.dst", "path").distinct()


def extract_symbols(files: DataFrame) -> DataFrame:
    return symbols_of(parse_files(files))


def extract_relations(files: DataFrame) -> DataFrame:
    return relations_of(parse_files(files))


def comments(content: Column) -> Column:
    """Block comments longer than COMMENT_CHARS, of texts in no language that is parsed."""
    return F.filter(F.regexp_extract_all(content, F.lit(r"(?s)/\*.*?\*/"), F.lit(0)), lambda c: F.char_length(c) > COMMENT_CHARS)


def file_comments(files: DataFrame) -> DataFrame:
    """path, comments (longer than COMMENT_CHARS) and the file's characters: by the lexer, or block comments where the language isn't parsed."""
    size = F.coalesce(F.char_length("content"), F.lit(0)).alias("chars")
    known = files.where(language_of(F.col("path")).isNotNull())
    long = F.transform(F.filter("comments", lambda c: F.char_length(c["text"]) > COMMENT_CHARS), lambda c: c["text"])
    lexed = parse_files(known).select("path", long.alias("comments")).join(known.select("path", size), "path")
    others = files.where(language_of(F.col("path")).isNull()).select("path", F.coalesce(comments(F.col("content")), F.array().cast("array<string>")).alias("comments"), size)
    return lexed.unionByName(others)


def comment_density(found: Column, chars: Column) -> Column:
    """Characters of comments by characters of the file."""
    return F.aggregate(found, F.lit(0), lambda a, c: a + F.char_length(c)) / F.greatest(chars, F.lit(1))


def upsert_nodes(nodes: DataFrame, new: DataFrame, key: tuple[str, ...] = ("kind", "name", "path")) -> DataFrame:
    """Nodes by key, the last version of each: ``new`` over old, a greater ``seq`` over a smaller one."""
    both = nodes.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    rest = [c for c in nodes.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_gen", "seq")).alias("v")).select(*key, "v.*")


def resolve_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src_id, dst_id, type) between nodes (nid, name) of the related names; several nodes of a name all take part."""
    s, d = (nodes.select(F.col("nid").alias(f"{x}_id"), F.col("name").alias(x)) for x in ("src", "dst"))
    return relations.join(s, "src").join(d, "dst").select("src_id", "dst_id", "type").distinct()


#: Kinds of the ends of relations; a file is met by its path, everything else by its name.
ENDS = {"DEFINED_IN": (("Class", "Method"), "File"), "MEMBER_OF": (("Method",), "Class"), "INHERITS": (("Class",), "Class"), "CALLS": (("Method",), "Method")}


def resolve_by_kind(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src_id, dst_id, type) between nodes (nid, kind, name, path) of the kinds that a relation joins.

    Nodes of one name in several files all take part, as a name alone doesn't tell them apart.
    """
    ends = nodes.sparkSession.createDataFrame([(t, k, dst) for t, (src, dst) in ENDS.items() for k in src], "type string, src_kind string, dst_kind string")
    s = nodes.select(F.col("nid").alias("src_id"), F.col("name").alias("src"), F.col("kind").alias("src_kind"))
    met = F.when(F.col("kind") == "File", F.col("path")).otherwise(F.col("name"))
    d = nodes.select(F.col("nid").alias("dst_id"), met.alias("dst"), F.col("kind").alias("dst_kind"))
    return relations.join(F.broadcast(ends), "type").join(s, ["src", "src_kind"]).join(d, ["dst", "dst_kind"]).select("src_id", "dst_id", "type").distinct()


def node_counts(nodes: DataFrame, repo: str | None = None) -> DataFrame:
    """repo, n: nodes of each repository, or of one."""
    own = nodes if repo is None else nodes.where(F.col("repo") == repo)
    return own.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def build_report(files: int, failed: int, nodes: DataFrame, edges: DataFrame, most: float = 0.2) -> dict:
    """Counts of a build and its rate of files that didn't parse; more than ``most`` of them is an error."""
    rate = failed / max(files, 1)
    if rate > most:
        raise RuntimeError(f"{failed} of {files} files didn't parse, more than {most:.0%}")
    return {"files": files, "parse_failures": failed, "failure_rate": rate, "nodes": nodes.count(), "edges": edges.count()}


def by_density(files: DataFrame) -> DataFrame:
    """path, density of files (path, content), the most commented first."""
    density = F.round(comment_density(F.col("comments"), F.col("chars")), 6)
    return file_comments(files).select("path", density.alias("density")).orderBy(F.col("density").desc(), "path")


def concept_entities(files: DataFrame, extract: Callable[[str], list[dict]], most: int = 500, batch: int = 10, cut: int = 800) -> list[dict]:
    """Named entities that ``extract`` finds in the comments of files (path, content), the most commented files first.

    Comments go to it in batches joined by ``---``, each cut to ``cut`` characters; a call that fails finds nothing, and what
    has no name is left out. No call is made once ``most`` entities are there; files come to the driver one by one.
    """
    rows = file_comments(files).select("path", "comments", comment_density(F.col("comments"), F.col("chars")).alias("density")).where("size(comments) > 0")
    out: list[dict] = []
    for row in rows.orderBy(F.col("density").desc(), "path").toLocalIterator():
        for at in range(0, len(row["comments"]), batch):
            if len(out) >= most:
                return out[:most]
            try:
                found = extract("\n---\n".join(c[:cut] for c in row["comments"][at : at + batch]))
            except Exception:  # noqa: BLE001, S112  a failing service finds nothing
                continue
            out += [{**e, "source_path": row["path"]} for e in found if isinstance(e, dict) and e.get("name")]
    return out[:most]


def anchors(reached: DataFrame, kind: str) -> DataFrame:
    """node, length, anchors: of each reached node of a kind (seed, node, length, n), the shortest length and the seeds that reach it, one entry a path."""
    own = reached.where(F.col("node").startswith(f"{kind}:"))
    each = F.flatten(F.collect_list(F.array_repeat("seed", F.col("n").cast("int"))))
    return own.groupBy("node").agg(F.min("length").cast("int").alias("length"), F.array_sort(each).alias("anchors"))


def with_stubs(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names of nodes, and those of missing targets whose source is there, marked as stubs."""
    known = nodes.select("name").distinct()
    missing = relations.join(known.withColumnRenamed("name", "src"), "src", "left_semi").select(F.col("dst").alias("name")).distinct().join(known, "name", "left_anti")
    return known.withColumn("stub", F.lit(False)).unionByName(missing.withColumn("stub", F.lit(True)))


def doc_entities(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """MENTIONED_IN the entity's file, and RELATED_TO the class or method of its name there: (name, source_path, type, target)."""
    mentioned = entities.select("name", "source_path", F.lit("MENTIONED_IN").alias("type"), F.col("source_path").alias("target"))
    related = entities.join(nodes, (entities["name"] == nodes["name"]) & (entities["source_path"] == nodes["path"])).select(entities["name"], "source_path", F.lit("RELATED_TO").alias("type"), nodes["kind"].alias("target"))
    return mentioned.unionByName(related).distinct()


def seeds(nodes: DataFrame, terms: list[str], limit: int = DEFAULT.graph_seeds) -> DataFrame:
    """nid, kind, score: nodes whose names hold a term; the best ``limit`` of each kind, the best score of each node."""
    name = F.lower(F.col("name"))
    score = sum((F.when(F.contains(name, F.lit(t)), 1.0).otherwise(0.0) for t in terms), F.lit(0.0))
    found = nodes.select("nid", "kind", score.alias("score")).where("score > 0").groupBy("nid", "kind").agg(F.max("score").alias("score"))
    order = Window.partitionBy("kind").orderBy(F.col("score").desc(), "nid")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def expand(edges: DataFrame, start: DataFrame, hops: int = DEFAULT.graph_hops) -> DataFrame:
    """seed, node, length: each undirected path of 1 to ``hops`` edges, no edge twice, from the seeds (nid); a row a path."""
    e = edges.select("a", "b", F.xxhash64("a", "b", "type").alias("e"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
    front = start.select(F.col("nid").alias("seed")).join(both, F.col("seed") == both["a"]).select("seed", F.col("b").alias("node"), F.array("e").alias("path"))
    out = front.select("seed", "node", F.lit(1).alias("length"))
    for k in range(2, hops + 1):
        front = front.join(both, front["node"] == both["a"]).where(~F.array_contains("path", F.col("e"))).select("seed", F.col("b").alias("node"), F.concat("path", F.array("e")).alias("path"))
        out = out.unionByName(front.select("seed", "node", F.lit(k).alias("length")))
    return out


#: Parts that a node's edges are dealt to when a frontier meets them.
HUB_PARTS = 16


def expand_counts(edges: DataFrame, start: DataFrame, hops: int = DEFAULT.graph_hops) -> DataFrame:
    """seed, node, length, n: how many undirected paths of 1 to ``hops`` edges (2 at most), no edge twice, lead from a seed (nid) to a node.

    Frontiers are nodes with counts, so a step makes a row for each edge of a seed's frontier and no row a path. Parallel edges
    count each. A second step's way back along the edge of the first is taken off the seed's own count. A hub's edges are
    dealt to HUB_PARTS parts that the frontier's rows all meet.
    """
    if not 1 <= hops <= 2:
        raise ValueError(f"paths of {hops} edges aren't counted; expand lists them")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("part", F.pmod(F.xxhash64("b"), F.lit(HUB_PARTS)))

    def step(front: DataFrame) -> DataFrame:
        dealt = front.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1)).cast("array<bigint>")))
        met = dealt.join(both, (dealt["node"] == both["a"]) & (dealt["part"] == both["part"])).select("seed", F.col("b").alias("node"), "n")
        return met.groupBy("seed", "node").agg(F.sum("n").alias("n"))

    one = step(start.groupBy(F.col("nid").alias("seed")).agg(F.count(F.lit(1)).alias("n")).withColumn("node", F.col("seed")))
    out = one.select("seed", "node", F.lit(1).alias("length"), "n")
    if hops == 2:
        # an edge from a node to itself is there in both directions, so each of its two steps has two ways back
        back = one.select("seed", F.col("seed").alias("node"), F.when(F.col("node") == F.col("seed"), -2 * F.col("n")).otherwise(-F.col("n")).alias("n"))
        two = step(one).unionByName(back).groupBy("seed", "node").agg(F.sum("n").alias("n")).where("n > 0")
        out = out.unionByName(two.select("seed", "node", F.lit(2).alias("length"), "n"))
    return out


def graph_score(length: Column, match: Column, most: Column, alpha: float = DEFAULT.graph_alpha) -> Column:
    s = alpha / F.greatest(length, F.lit(1)) + (1 - alpha) * match / F.greatest(most, F.lit(1))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def rank_targets(reached: DataFrame, kind: str, limit: int = DEFAULT.graph_files) -> DataFrame:
    """Reached nodes (seed, node, length, n) of a kind (their ids' prefix): shortest length, paths, score; the nearest ``limit``."""
    files = reached.where(F.col("node").startswith(f"{kind}:")).groupBy("node").agg(F.min("length").alias("length"), F.sum("n").alias("matches"))
    near = files.orderBy("length", "node").limit(limit)
    most = near.agg(F.max("matches").alias("most"))
    return near.crossJoin(F.broadcast(most)).select("node", "length", "matches", F.round(graph_score(F.col("length"), F.col("matches"), F.col("most")), 6).alias("score"))


def drop_nodes(edges: DataFrame, nodes: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes (nid) without those that meet the condition, and edges both of whose ends are left."""
    keep = nodes.where(~F.coalesce(gone, F.lit(False)))
    ids = keep.select("nid")
    left = edges.join(ids.withColumnRenamed("nid", "a"), "a", "left_semi").join(ids.withColumnRenamed("nid", "b"), "b", "left_semi")
    return keep, left

"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrove.llm._tables import cut, documents

#: Words of a block, words of a shard (a shard is one window partition), and the seed.
BLOCK, SHARD, SEED = 16, 1_000_000, "mix"
#: The weights that repeat over the sources, the share of all words to take, the most passes over a text.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Primes above any shard's number of blocks: block j comes (j * stride + offset) mod blocks-th, with a stride of these
#: and an offset for each pass that the seed gives a shard.
STRIDES = (2147483647, 2147483629, 2147483587, 2147483579)

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: weights share the total, each at most PASSES times its size, the rest reshared.

    Sources in order of the most they can take by weight are full as long as the
    level that the others share lies above theirs; so one sorted pass replaces the rounds.
    """
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everywhere = Window.partitionBy()
    ranked = of.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("most", PASSES * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    total = SHARE * F.sum("source_size").over(everywhere)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0))
    open_w = F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), F.lit(0))
    ranked = ranked.withColumns({"left": left, "open_w": open_w})
    ranked = ranked.withColumn("full", F.col("w") * F.col("left") / F.col("open_w") > F.col("most"))
    level = F.min_by(F.when(~F.col("full"), F.struct("left", "open_w")), F.when(~F.col("full"), F.struct(F.col("most") / F.col("w"), F.col("place")))).over(everywhere)
    ranked = ranked.withColumn("level", level)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("w") * F.col("level.left") / F.col("level.open_w"))
    return ranked.select("source", "place", "source_size", F.round(F.coalesce(target, F.lit(0.0)), 6).alias("target"))


def _level(parties: DataFrame, group: list[str], weight: str, most: str, share: Column, name: str) -> DataFrame:
    """Adds ``name``: the x at which the sum of min(most, weight * x) over a group is ``share``; null where all are full.

    In order of most / weight, parties are full as long as the level that the others share lies above theirs; that of the first one
    that isn't is the greatest.
    """
    order = Window.partitionBy(*group).orderBy(F.col(most) / F.col(weight))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    left = share - F.coalesce(F.sum(most).over(before), F.lit(0))
    x = left / (F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    return parties.withColumn("_x", x).withColumn(name, F.max(F.when(F.col("_x") * F.col(weight) < F.col(most), F.col("_x"))).over(whole)).drop("_x")


def apportion(parties: DataFrame, within: list[str], weight: str, seats: str, most: str, tie: str) -> DataFrame:
    """Adds ``quota``: ``seats`` go to the parties of a group by the highest quotients weight / (2 k + 1), k < ``most``.

    At a level x, a party has min(most, weight * x) seats give or take a half. Of a group of n, the seats at the level
    that gives out n / 2 less are sure, and those beyond the level for n / 2 more are never won; so only
    about 2 n quotients in between are ranked. Without enough places, each party gets its ``most``.
    """
    group = Window.partitionBy(*within)
    able = parties.withColumn("_able", (F.col(weight) > 0) & (F.col(most) > 0))
    n = F.count(F.when(F.col("_able"), 1)).over(group)
    out = able.withColumns({"_n": n, "_w": F.when(F.col("_able"), F.col(weight).cast("double")), "_m": F.when(F.col("_able"), F.col(most).cast("double"))})
    out = _level(out, [*within, "_able"], "_w", "_m", F.greatest(F.col(seats) - F.col("_n") / 2 - 1, F.lit(0)), "_lo")
    out = _level(out, [*within, "_able"], "_w", "_m", F.col(seats) + F.col("_n") / 2 + 1, "_hi")
    at = lambda x, more: F.when(F.col("_able"), F.greatest(F.least(F.coalesce(F.floor(F.col("_w") * F.col(x) + 0.5) + more, F.col("_m")), F.col("_m")), F.lit(0))).otherwise(0).cast("long")
    out = out.withColumns({"_sure": at("_lo", -1), "_upto": at("_hi", 1)})
    out = out.withColumn("_rest", F.col(seats) - F.sum("_sure").over(group))
    ks = F.when(F.col("_upto") > F.col("_sure"), F.sequence("_sure", F.col("_upto") - 1))
    tried = out.withColumn("_k", F.explode_outer(ks)).withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
    order = Window.partitionBy(*within).orderBy(F.col("_q").desc_nulls_last(), tie)
    tried = tried.withColumn("_won", (F.row_number().over(order) <= F.col("_rest")) & F.col("_k").isNotNull())
    keys = parties.columns
    return tried.groupBy(*keys).agg((F.first("_sure") + F.sum(F.col("_won").cast("long"))).alias("quota"))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words that the mix takes from each document.

    A source's documents are dealt to shards of about ``shard`` words by a seeded hash and lie
    there in seeded order as a stream of words, cut into blocks of ``block``. Sources get
    numbers of blocks by Sainte-Laguë quotients of their targets, their shards by those of
    their sizes; a shard takes its quota of blocks in a seeded order, twice round at most.
    Equal quotients go to the source, then the shard, that comes first.

    Null and empty texts have size 0 and take 0; a text of any length is counted whole, its words lie in one
    shard; a null source is one source, the last; repeated rows count one by one, and rows of one id lie next to
    each other by size; without any words, targets are 0, and without rows, there are none. Of other columns, whatever their
    names, none is read. Only ids, sources and sizes are shuffled; they are written once, to the checkpoint folder.
    Sources are ranked in one task, a row a source; a shard's rows are one window.
    """
    sizes = cut(sized(docs))
    plan = targets(sizes).withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    rows = sizes.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select("d.doc_id", "d.size", "p.place", "p.source_size", "p.target", "p.shards", key.alias("key"))
    rows = rows.withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards"))
    stream = Window.partitionBy("place", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("to", F.sum("size").over(stream))
    shards = rows.groupBy("place", "shard", "target").agg(F.sum("size").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block))
    of = shards.groupBy("place", "target").agg((PASSES * F.sum("blocks")).alias("most")).withColumn("seats", F.floor(F.sum("target").over(Window.partitionBy()) / block))
    quota = apportion(of, [], "target", "seats", "most", "place").select("place", F.col("quota").alias("seats"))
    parties = shards.join(quota, "place").withColumn("most", PASSES * F.col("blocks")).select("place", "shard", "words", "blocks", "seats", "most")
    quotas = apportion(parties, ["place"], "words", "seats", "most", "shard").select("place", "shard", "blocks", "quota")
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.col("place").cast("string"), F.col("shard").cast("string")).cast("binary"))
    number = lambda r: F.conv(F.substring(drawn, 1 + 8 * r, 8), 16, 10).cast("long")
    rows = rows.join(quotas.withColumns({"stride": F.element_at(F.array(*map(F.lit, STRIDES)), (number(PASSES) % len(STRIDES) + 1).cast("int")), **{f"from{r}": number(r) for r in range(PASSES)}}), ["place", "shard"])
    begin = F.col("to") - F.col("size")
    place_of = lambda j, r: (j * F.col("stride") + F.col(f"from{r}")) % F.col("blocks")
    chosen = lambda j: sum(((place_of(j, r) + r * F.col("blocks")) < F.col("quota")).cast("long") for r in range(PASSES))
    inside = lambda j: F.least(F.col("to"), (j + 1) * block) - F.greatest(begin, j * block)
    blocks = F.sequence(F.floor(begin / block), F.floor((F.col("to") - 1) / block))
    taken = F.when(F.col("size") > 0, F.aggregate(blocks, F.lit(0).cast("long"), lambda a, j: a + inside(j) * chosen(j))).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"))


def op4_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def sql(shard: int = SHARD) -> str:
    """DuckDB SQL of the query with shards of so many words."""
    return SQL.replace("1000000.0", f"{shard}.0")


SQL = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS most FROM s
), l AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open_w
  FROM w WINDOW b AS (ORDER BY most::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, w * rest / open_w > most AS is_full FROM l
), lev AS (
  SELECT rest, open_w FROM f WHERE NOT is_full ORDER BY most::DOUBLE / w, place LIMIT 1
), t AS (
  SELECT source, place, source_size, round(coalesce(CASE WHEN is_full THEN most::DOUBLE ELSE w * (SELECT rest FROM lev) / (SELECT open_w FROM lev) END, 0.0), 6) AS target,
    greatest(CAST(ceil(source_size / 1000000.0) AS BIGINT), 1) AS shards FROM f
), r AS (
  SELECT d.doc_id, d.size, t.place, t.source_size, t.target, md5('mix:' || d.doc_id) AS key, t.shards FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), h AS (
  SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard FROM r
), c AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY place, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM h
), sh AS (
  SELECT place, shard, target, CAST(sum(size) AS BIGINT) AS words, CAST(ceil(sum(size) / 16.0) AS BIGINT) AS blocks FROM c GROUP BY ALL
), so AS (
  SELECT place, target, CAST(2 * sum(blocks) AS BIGINT) AS most FROM sh GROUP BY ALL
), n AS (
  SELECT CAST(floor(sum(target) / 16) AS BIGINT) AS seats FROM so
), q AS (  -- every quotient of every source, ranked
  SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS rn FROM (SELECT place, target, unnest(range(most)) AS k FROM so WHERE target > 0)
), qs AS (
  SELECT so.place, count(q.place) AS seats FROM so LEFT JOIN (SELECT * FROM q WHERE rn <= (SELECT seats FROM n)) q ON so.place = q.place GROUP BY ALL
), p AS (
  SELECT place, shard, seats, row_number() OVER (PARTITION BY place ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard) AS rn
  FROM (SELECT sh.place, shard, words, seats, unnest(range(2 * blocks)) AS k FROM sh JOIN qs ON sh.place = qs.place)
), ps AS (
  SELECT sh.place, sh.shard, sh.blocks, md5('mix:' || sh.place || ':' || sh.shard) AS drawn, count(p.place) AS quota
  FROM sh LEFT JOIN (SELECT * FROM p WHERE rn <= seats) p ON sh.place = p.place AND sh.shard = p.shard GROUP BY ALL
), o AS (
  SELECT *, CAST('0x' || substr(drawn, 1, 8) AS BIGINT) AS from0, CAST('0x' || substr(drawn, 9, 8) AS BIGINT) AS from1,
    [2147483647, 2147483629, 2147483587, 2147483579][CAST('0x' || substr(drawn, 17, 8) AS BIGINT) % 4 + 1] AS stride FROM ps
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN list_sum([
    (least(upto, (j + 1) * 16) - greatest(upto - size, j * 16)) * (CASE WHEN (j * stride + from0) % blocks < quota THEN 1 ELSE 0 END + CASE WHEN (j * stride + from1) % blocks + blocks < quota THEN 1 ELSE 0 END)
    for j in range((upto - size) // 16, (upto - 1) // 16 + 1)]) ELSE 0 END AS BIGINT) AS taken
FROM c JOIN o ON c.place = o.place AND c.shard = o.shard
"""

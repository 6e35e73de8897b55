"""Mixing sources to target weights by Sainte-Laguë apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, quoted, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Total of the mix and bound of one source, as multiples of sizes.
SHARE, MOST = 1.5, 2
#: Words of a block; words of a shard, about, and most shards of a source: beyond that, its shards grow.
BLOCK_WORDS, SHARD_WORDS, MOST_SHARDS = 16, 100_000, 50_000


def n_words(text: Column) -> Column:
    """Number of runs of [^ \\t-\\r] in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source, null last.

    The share that all sources get per weight is found in closed form: sources are ordered by the share at which they are full
    (2 * size / weight), and the first k are full if what is left for the others stays below the (k+1)-th bound. The windows run over
    one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    ranked = ranked.withColumn("most", MOST * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", SHARE * F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("open"))
    )
    # the first source that is not full at its level sets the level of all the others
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)
    return (
        ranked.withColumn("level", level["level"])
        .withColumn("target", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("most")), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def sainte_lague(parties: DataFrame, by: list[str], votes: str, seats: str, ties: list[str]) -> DataFrame:
    """Adds the column quota: parties of one group (by) get its seats in the order of the quotients votes / (2k - 1), ties by the given
    columns. Only quotients near the threshold are listed: rounding shares of seats - n and seats + n (n parties) bounds each quota
    below and above, which leaves at most about three quotients a party."""
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    total, n = F.sum(F.col(votes).cast("double")).over(group), F.count(F.lit(1)).over(group)
    near = lambda shift: F.when(total > 0, F.floor(F.greatest(F.col(seats) + shift, F.lit(0)) * F.col(votes) / total + 0.5)).otherwise(0).cast("long")
    bounds = parties.withColumn("low_", F.greatest(near(-n) - 1, F.lit(0))).withColumn("high_", F.when(F.col(votes) > 0, near(n) + 1).otherwise(0))
    listed = bounds.withColumn("sum_low_", F.sum("low_").over(group)).withColumn(
        "k_", F.explode_outer(F.when(F.col("high_") > F.col("low_"), F.sequence(F.col("low_") + 1, F.col("high_")))))
    order = Window.partitionBy(*by).orderBy((F.col(votes) / (2 * F.col("k_") - 1)).desc_nulls_last(), *ties)
    won = listed.withColumn("won_", (F.col("k_").isNotNull() & (F.row_number().over(order) <= F.col(seats) - F.col("sum_low_"))).cast("long"))
    own = [c for c in parties.columns]
    return won.groupBy(*own).agg((F.first("low_") + F.sum("won_")).alias("quota"))


def mix_sources(docs: DataFrame, *, seed: int = 7, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, shard, quota (blocks of the shard) and taken (words) of every row of docs.

    A source's target becomes a number of equal blocks; sources get blocks, and shards of a source theirs, by Sainte-Laguë. The
    documents of a shard stand in a seeded order (md5 of seed and id), as a stream that is cut into blocks; a quota takes whole passes
    over the stream and then the first blocks of the next one, so that a document's words are taken at most twice. A shard holds about
    shard_words words, so a hot source is dealt over many; windows run over one row per source or, by source, per shard. Null texts and texts without words have size 0 and take 0; a null source is
    a source, and comes last; repeated rows count each; an empty table gives an empty result. Column names other than doc_id, text and
    source are not read."""
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    everything = Window.partitionBy()
    seats = F.greatest(F.round(F.sum("target").over(everything) / block_words), F.lit(0)).cast("long")
    quotas = sainte_lague(targets.withColumn("seats", seats), [], "target", "seats", ["source"]).withColumnRenamed("quota", "source_quota").drop("seats")
    # sources are few: one row each, written out so that the joins below know their size
    quotas = cut(quotas.withColumn("shards", F.least(F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_words), F.lit(MOST_SHARDS))), "quotas")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    dealt = (
        sized.alias("a").join(quotas.alias("b").hint("merge"), same)
        .select("doc_id", "a.source", "size", "source_size", "target", "source_quota", "shards", key.alias("key_"))
        .withColumn("shard", F.pmod(F.conv(F.substring("key_", 1, 8), 16, 10).cast("long"), F.col("shards")))
    )
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = sainte_lague(shards, ["source"], "shard_size", "source_quota", ["shard"]).select("source", "shard", "shard_size", "quota")
    stream = Window.partitionBy("source", "shard").orderBy("key_", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("end_", F.sum("size").over(stream))
    same = same & (F.col("a.shard") == F.col("b.shard"))
    words = F.least(F.col("quota") * block_words, MOST * F.col("shard_size"))
    return (
        placed.alias("a").join(shards.alias("b").hint("merge"), same)
        .select("doc_id", "a.source", "size", "source_size", "target", "a.shard", "quota", "end_", "shard_size", words.alias("words_"))
        .withColumn("passes_", F.when(F.col("shard_size") > 0, F.expr("words_ div shard_size")).otherwise(0))
        .withColumn("rest_", F.col("words_") - F.col("passes_") * F.col("shard_size"))
        .withColumn("part_", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest_") - (F.col("end_") - F.col("size")))))
        .select("doc_id", "source", "size", "source_size", "target", "shard", "quota", (F.col("passes_") * F.col("size") + F.col("part_")).alias("taken"))
    )


def op7_mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them whole, and those of which it takes a part with the first words of their text.

    Rows that the mix leaves out go before any text moves; the others are joined with their share by doc_id, which should be unique: of rows
    that repeat one, each is taken as often as the one of them that the mix takes most (by taken, then size). Rows with a null doc_id are
    not taken; columns keep their names and values, whatever they are called."""
    size, taken = fresh(docs, "size", "taken")
    shares = mix_sources(docs, **options).filter("taken > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("taken", "size")).alias("s"))
    joined = docs.join(cut(shares.select("doc_id", F.col("s.size").alias(size), F.col("s.taken").alias(taken)), "shares").hint("merge"), "doc_id")
    words = F.array_join(F.expr(rf"slice(regexp_extract_all(text, r'[\x20\x09-\x0D]*[^\x20\x09-\x0D]+', 0), 1, cast({taken} % {size} as int))"), "")
    whole = F.array_repeat(F.col("text"), F.expr(f"cast({taken} div {size} as int)"))
    texts = F.when(F.col(taken) % F.col(size) > 0, F.array_append(whole, words)).otherwise(whole)
    return joined.withColumn("text", F.explode(texts)).select(*[quoted(c) for c in docs.columns])


#: op7_mix by definition: every quotient of every source and shard is listed.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
r AS (SELECT *, 2 * source_size AS most, 2 * source_size / weight AS ratio FROM w),
l AS (SELECT *, (CAST({SHARE} AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(most) OVER b, 0) AS DOUBLE)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT level AS open_level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN open_level IS NULL OR open_level * weight > most THEN CAST(most AS DOUBLE) ELSE open_level * weight END AS target, CAST(least(ceil(greatest(source_size, 1) / {SHARD_WORDS}), {MOST_SHARDS}) AS BIGINT) AS shards FROM l LEFT JOIN v ON true),
n AS (SELECT CAST(round(sum(target) / {BLOCK_WORDS}) AS BIGINT) AS seats FROM t),
q AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source) AS nr FROM t, LATERAL (SELECT unnest(generate_series(1, CAST(ceil(target / {BLOCK_WORDS}) AS BIGINT) + 20)) AS k) WHERE target > 0),
sq AS (SELECT source, count(*) AS seats FROM q, n WHERE nr <= n.seats GROUP BY source),
e AS (SELECT d.*, t.source_size, t.target, coalesce(sq.seats, 0) AS source_quota, CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN sq ON sq.source IS NOT DISTINCT FROM d.source),
h AS (SELECT source, shard, sum(size) AS shard_size, any_value(source_quota) AS seats FROM e GROUP BY source, shard),
hq AS (SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k - 1) DESC, shard) AS nr FROM h, LATERAL (SELECT unnest(generate_series(1, seats)) AS k) WHERE shard_size > 0),
hs AS (SELECT source, shard, count(*) AS quota FROM hq WHERE nr <= seats GROUP BY source, shard),
p AS (SELECT e.*, h.shard_size, least(coalesce(quota, 0) * {BLOCK_WORDS}, {MOST} * h.shard_size) AS words, sum(size) OVER (PARTITION BY e.source, e.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM e JOIN h ON h.source IS NOT DISTINCT FROM e.source AND h.shard = e.shard LEFT JOIN hs ON hs.source IS NOT DISTINCT FROM e.source AND hs.shard = e.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN shard_size > 0 THEN (words // shard_size) * size + greatest(0, least(size, words % shard_size - (upto - size))) ELSE 0 END AS BIGINT) AS taken FROM p"""

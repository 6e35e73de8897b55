"""Panels from the driver tables: weekly bars from lineitem, hourly ticks from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.plans.session import cut

BENCHMARK = "BENCH"
#: Suppliers that are broadcast, two numbers each; beyond, they and the lines are dealt by key.
BROADCAST_SUPPLIERS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly (date, symbol, open, high, low, close, volume), written out: a symbol is the supplier's nation, BENCH all lines. The first and
    last price follow a total order of the lines.

    Taken by that order, a struct, prices would have all lines sorted by group. Numbers are aggregated by hash instead: a pass over the lines
    gives the times of the first and the last lines of each week and nation, another the orders at those times, and only the lines of these
    orders are compared in full. BENCH is made of the nations. What is broadcast has a row per week and nation, however many the lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = lines.withColumns({"date": F.trunc(F.col("l_shipdate").cast("date"), "week"), "order": F.coalesce("l_orderkey", F.lit(-(1 << 63)))})  # nulls come first
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # 25 rows
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    suppliers = suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    few = table(spark, sf_dir, "supplier").count() <= BROADCAST_SUPPLIERS
    suppliers = F.broadcast(suppliers) if few else suppliers.hint("shuffle_hash")

    def supplied(rows: DataFrame) -> DataFrame:
        return rows.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))

    def met(rows: DataFrame, groups: DataFrame) -> DataFrame:
        return supplied(rows).join(F.broadcast(groups), F.col("date").eqNullSafe(F.col("week")) & (F.col("s_nationkey") == F.col("nation")))

    kept = lambda *names: [F.first(c).alias(c) for c in names]
    times = supplied(lines).groupBy(F.col("date").alias("week"), F.col("s_nationkey").alias("nation")).agg(
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.max("px").alias("high"), F.min("px").alias("low"), F.sum("l_quantity").alias("volume"))
    first, last = (F.col("l_shipdate").eqNullSafe(F.col(c)) for c in ("first", "last"))
    orders = met(lines, cut(times, "times")).filter(first | last).groupBy("week", "nation").agg(
        F.min(F.when(first, F.col("order"))).alias("first_order"), F.max(F.when(last, F.col("order"))).alias("last_order"), *kept("first", "last", "high", "low", "volume"))
    orders = cut(orders, "orders")
    wanted = orders.select(F.explode(F.array("first_order", "last_order")).alias("wanted"))
    ends = met(lines.join(F.broadcast(wanted), F.col("order") == F.col("wanted"), "left_semi"), orders)
    ends = ends.filter((first & (F.col("order") == F.col("first_order"))) | (last & (F.col("order") == F.col("last_order"))))
    ends = ends.withColumn("k", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    by_nation = ends.groupBy("week", "nation").agg(
        F.min_by("px", "k").alias("open"), F.min("k").alias("k"), F.max_by("px", "k").alias("close"), F.max("k").alias("z"), *kept("high", "low", "volume"))
    both = by_nation.join(F.broadcast(nations), F.col("nation") == F.col("n_nationkey")).withColumn("symbol", F.explode(F.array("n_name", F.lit(BENCHMARK))))
    found = both.groupBy(F.col("week").alias("date"), "symbol").agg(
        F.min_by("open", "k").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "z").alias("close"), F.sum("volume").alias("volume"))
    return cut(found, "bars")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly (date, symbol, open, high, low, close, volume) of events with a positive value; date is the hour, symbol the type."""
    rows = table(spark, sf_dir, "events").filter("value > 0")
    return rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("date"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"))


BARS_SQL = """
lines_ AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, n_name, l_extendedprice / l_quantity AS px, l_quantity AS q, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
both_ AS (SELECT *, n_name AS symbol FROM lines_ UNION ALL SELECT *, 'BENCH' AS symbol FROM lines_),
panel AS (SELECT date, symbol, first(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max(px) AS high, min(px) AS low,
  last(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close, sum(q) AS volume FROM both_ GROUP BY date, symbol),
bars AS (SELECT * FROM panel WHERE symbol <> 'BENCH')"""

"""Capacity: what a traded record would have filled and cost at other sizes of the fund."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import ratio

AUDITS = {
    "not_finite": "desired_notional is null or traded_notional is null or isnan(desired_notional) or isnan(traded_notional) or abs(desired_notional) = double('infinity') or abs(traded_notional) = double('infinity')",
    "opposite_direction": "desired_notional * traded_notional < 0",
    "overfilled": "abs(traded_notional) > abs(desired_notional) * (1 + 1e-9) + 1e-6",
    "information_not_before_trade": "information_date >= date",
    "no_liquidity": "not coalesce(lagged_adv_notional > 0, false)",
}


def audit(trades: DataFrame) -> DataFrame:
    one = trades.agg(*[F.count_if(F.expr(r)).alias(k) for k, r in AUDITS.items()])
    return one.unpivot([], list(AUDITS), "rule", "violations")


def liquidity(trades: DataFrame) -> DataFrame:
    """lagged_adv_notional as given, else lagged shares times the reference price."""
    if "lagged_adv_notional" in trades.columns:
        return trades
    return trades.withColumn("lagged_adv_notional", F.col("lagged_adv_shares") * F.col("reference_price"))


def cost_bps(trades: DataFrame) -> DataFrame:
    """base_cost_bps: lagged estimate as given, else realised cost over what was traded."""
    if "cost_bps" in trades.columns:
        return trades.withColumn("base_cost_bps", F.col("cost_bps"))
    t = F.abs("traded_notional")
    return trades.withColumn("base_cost_bps", F.when(t > 0, F.col("total_cost") * 1e4 / t).otherwise(0.0))


def scenarios(trades: DataFrame, aums: DataFrame, *, reference_aum: float, max_participation: float = 0.10, variable_fraction: float = 0.5, impact_exponent: float = 0.5) -> DataFrame:
    """Every trade at every size (aum): scaled, capped by participation in lagged volume, cost growing with the filled ratio. aums is a
    short list."""
    df = cost_bps(liquidity(trades)).filter("lagged_adv_notional > 0").crossJoin(F.broadcast(aums)).withColumn("aum_multiple", F.col("aum") / reference_aum)
    base = F.abs("traded_notional")
    df = df.withColumns({"desired": F.abs("desired_notional") * F.col("aum_multiple"), "empirical": base * F.col("aum_multiple"), "limit_": F.col("lagged_adv_notional") * max_participation})
    df = df.withColumn("modeled", F.least("empirical", "limit_"))
    grown = F.when(base > 0, F.pow(F.col("modeled") / base, impact_exponent)).otherwise(F.lit(0.0))
    df = df.withColumn("modeled_cost_bps", F.col("base_cost_bps") * ((1 - variable_fraction) + variable_fraction * grown))
    return df.withColumns({
        "modeled_cost": F.col("modeled") * F.col("modeled_cost_bps") / 1e4, "total_shortfall": F.col("desired") - F.col("modeled"), "capacity_shortfall": F.col("empirical") - F.col("modeled"),
        "participation": F.col("modeled") / F.col("lagged_adv_notional"), "constrained": F.col("empirical") - F.col("modeled") > 1e-6})


def curve(details: DataFrame) -> DataFrame:
    active = F.col("empirical") > 0
    p = F.when(active, F.col("participation"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return details.groupBy("aum").agg(
        F.count_distinct("date").alias("n_dates"), F.count_if(active).alias("n_trades"), F.count_if("constrained").alias("n_constrained"), zero(F.avg(F.when(active, F.col("constrained").cast("double")))).alias("constrained_fraction"),
        F.sum("desired").alias("desired"), F.sum("empirical").alias("empirical"), F.sum("modeled").alias("modeled"), F.sum("total_shortfall").alias("total_shortfall"), F.sum("capacity_shortfall").alias("capacity_shortfall"),
        zero(ratio(F.sum("modeled"), F.sum("desired"))).alias("fill_ratio"), (F.sum("modeled") / F.sum("lagged_adv_notional")).alias("aggregate_participation"),
        zero(F.percentile(p, 0.5)).alias("participation_p50"), zero(F.percentile(p, 0.95)).alias("participation_p95"), zero(F.max(p)).alias("participation_max"),
        F.sum("modeled_cost").alias("modeled_cost"), zero(ratio(F.sum("modeled_cost"), F.sum("modeled")) * 1e4).alias("cost_bps"))


def largest_feasible(curve_: DataFrame, minimum_fill: float) -> DataFrame:
    return curve_.filter(F.col("fill_ratio") >= minimum_fill).agg(F.max("aum").alias("largest_feasible_aum"))


def execution_summary(fills: DataFrame) -> DataFrame:
    n = F.count("*")
    return fills.agg(
        n.alias("orders"), ratio(F.sum(F.abs(F.col("filled_shares") * F.col("price"))), F.sum(F.abs(F.col("requested_shares") * F.col("price")))).alias("fill_ratio"),
        F.avg((F.col("status") == "partial").cast("double")).alias("partial_rate"), F.avg((F.col("status") == "rejected").cast("double")).alias("rejected_rate"),
        F.sum("commission").alias("commission"), F.sum("spread_cost").alias("spread_cost"), F.sum("slippage_cost").alias("slippage_cost"), F.sum("impact_cost").alias("impact_cost"))


def with_trade_id(trades: DataFrame) -> DataFrame:
    """Numbers trades by (date, symbol) within the date, so that order of input does not matter."""
    return trades.withColumn("trade_nr", F.row_number().over(Window.partitionBy("date").orderBy("symbol", "desired_notional", "traded_notional")))

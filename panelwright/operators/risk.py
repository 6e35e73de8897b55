"""Risk and performance of an equity curve (date, return, equity, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import PERIODS_PER_YEAR, ratio


def in_time():
    """A curve has a row per date: the only windows without a partition."""
    return Window.orderBy("date")


def so_far():
    return in_time().rowsBetween(Window.unboundedPreceding, 0)


def drawdown(curve: DataFrame) -> DataFrame:
    return curve.withColumn("drawdown", F.col("equity") / F.max("equity").over(so_far()) - 1)


def trim_inactive(curve: DataFrame, *by: str) -> DataFrame:
    """Rows (of each curve of the keys by) from the first with exposure on; all, if there never was any."""
    active = (F.coalesce(F.col("gross_exposure"), F.lit(0.0)) > 0).cast("int")
    own = Window.partitionBy(*by)
    df = curve.withColumns({"a_": F.max(active).over(own.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), "any_": F.max(active).over(own)})
    return df.filter("a_ = 1 or any_ = 0").drop("a_", "any_")


def _annual(r: str = "return"):
    return F.pow(F.product(1 + F.col(r)), PERIODS_PER_YEAR / F.count(r)) - 1


def performance(curve: DataFrame, trim: bool = True, by: list[str] | None = None) -> DataFrame:
    """18 statistics per group. Beta is sample covariance over population variance; value at risk is the interpolated 5 % quantile."""
    by = by or []
    df = trim_inactive(curve) if trim else curve
    for c in ("benchmark_return", "turnover", "transaction_cost", "gross_exposure", "net_exposure"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    w = Window.partitionBy(*by)
    df = df.withColumn("return", F.coalesce("return", F.lit(0.0)))
    df = df.withColumn("dd_", F.col("equity") / F.max("equity").over(w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("q_", F.percentile("return", 0.05).over(w))
    r, b, year = F.col("return"), F.col("benchmark_return"), PERIODS_PER_YEAR
    beta = F.when(F.var_pop(b) > 0, F.covar_samp(r, b) / F.var_pop(b))
    down = F.stddev_samp(F.when(r < 0, r))
    return df.groupBy(*by).agg(
        F.count("*").alias("n_days"), (F.product(1 + r) - 1).alias("total_return"), _annual().alias("annual_return"), (F.stddev_samp(r) * year ** 0.5).alias("annual_volatility"),
        (ratio(F.avg(r), F.stddev_samp(r)) * year ** 0.5).alias("sharpe"), (ratio(F.avg(r), down) * year ** 0.5).alias("sortino"), F.min("dd_").alias("max_drawdown"),
        ratio(_annual(), F.abs(F.min("dd_"))).alias("calmar"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.avg("turnover").alias("average_turnover"), ratio(F.lit(1.0), F.avg("turnover")).alias("avg_holding_period_days"),
        F.sum("transaction_cost").alias("transaction_cost_impact"), F.avg("gross_exposure").alias("average_gross_exposure"), F.avg("net_exposure").alias("average_net_exposure"),
        beta.alias("beta_to_benchmark"), ((F.avg(r) - beta * F.avg(b)) * year).alias("alpha_estimate"), F.max("q_").alias("var_95_daily"), F.avg(F.when(r <= F.col("q_"), r)).alias("expected_shortfall_95_daily"))


def monthly_returns(curve: DataFrame) -> DataFrame:
    """Compounded return per calendar month between the first and last; a month without rows has 0."""
    months = curve.groupBy(F.last_day("date").alias("date")).agg((F.product(1 + F.col("return")) - 1).alias("return"))
    span = curve.agg(F.trunc(F.min("date"), "month").alias("a"), F.trunc(F.max("date"), "month").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m")).select(F.last_day("m").alias("date"))
    return span.join(months.hint("merge"), "date", "left").select("date", F.coalesce("return", F.lit(0.0)).alias("return"))


def by_regime(curve: DataFrame, regimes: DataFrame) -> DataFrame:
    """Performance of the days of each regime (date, regime); drawdown compounds those days only."""
    df = trim_inactive(curve).join(regimes.hint("merge"), "date").filter("regime is not null")
    w = Window.partitionBy("regime").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("e_", F.product(1 + F.col("return")).over(w)).withColumn("dd_", F.col("e_") / F.max("e_").over(w) - 1)
    r = F.col("return")
    return df.groupBy("regime").agg(F.count("*").alias("n_days"), _annual().alias("annual_return"), (F.stddev_samp(r) * PERIODS_PER_YEAR ** 0.5).alias("annual_volatility"), (ratio(F.avg(r), F.stddev_samp(r)) * PERIODS_PER_YEAR ** 0.5).alias("sharpe"), F.min("dd_").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("hit_rate"))


def exposure(weights: DataFrame) -> DataFrame:
    """Of the latest date: gross, net, positions, largest weight and concentration."""
    last = weights.agg(F.max("date").alias("date"))
    w = F.col("weight")
    g = F.sum(F.abs(w))
    return weights.join(F.broadcast(last), "date", "left_semi").agg(
        F.coalesce(g, F.lit(0.0)).alias("gross_exposure"), F.coalesce(F.sum(w), F.lit(0.0)).alias("net_exposure"), F.count_if(w != 0).alias("n_positions"), F.coalesce(F.max(F.abs(w)), F.lit(0.0)).alias("max_abs_weight"), ratio(F.sum(w * w), g * g).alias("hhi_concentration"))


def stress(weights: DataFrame, scenarios: DataFrame, betas: DataFrame | None = None) -> DataFrame:
    """Each scenario's shock on the latest weight of every symbol, through its beta (1 where unknown)."""
    last = weights.groupBy("symbol").agg(F.max_by("weight", "date").alias("w"))
    last = last.join(betas.select("symbol", "beta").hint("merge"), "symbol", "left") if betas is not None else last.withColumn("beta", F.lit(1.0))
    one = last.agg(F.sum(F.col("w") * F.coalesce("beta", F.lit(1.0))).alias("portfolio_beta"), F.sum(F.abs("w")).alias("gross_exposure"), F.sum("w").alias("net_exposure"))
    return scenarios.crossJoin(F.broadcast(one)).select("scenario", "market_shock", "portfolio_beta", (F.col("portfolio_beta") * F.col("market_shock")).alias("estimated_portfolio_return"), "gross_exposure", "net_exposure")


def latest_betas(features: DataFrame) -> DataFrame:
    return features.filter("beta is not null").groupBy("symbol").agg(F.max_by("beta", "date").alias("beta"))


def drawdown_runs(curve: DataFrame) -> DataFrame:
    """Share of days under water and the longest run of them."""
    df = drawdown(curve).withColumn("u_", F.col("drawdown") < 0)
    df = df.withColumn("g_", F.row_number().over(in_time()) - F.sum(F.col("u_").cast("int")).over(so_far()))
    runs = df.filter("u_").groupBy("g_").agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"))
    return df.agg(F.avg(F.col("u_").cast("double")).alias("time_under_water")).crossJoin(runs).select("time_under_water", F.coalesce("longest", F.lit(0)).alias("longest_run"))


def by_year(curve: DataFrame) -> DataFrame:
    return performance(curve.withColumn("year", F.year("date")), trim=False, by=["year"])


def borrow_drag(curve: DataFrame, borrow_bps: float, financing_bps: float) -> DataFrame:
    """The curve after borrow cost on shorts and financing on gross exposure over 1, both annual basis points."""
    short, cash = F.greatest((F.col("gross_exposure") - F.col("net_exposure")) / 2, F.lit(0.0)), F.greatest(F.col("gross_exposure") - 1, F.lit(0.0))
    df = curve.withColumn("r0_", F.col("return")).withColumn("return", F.col("return") - (short * borrow_bps + cash * financing_bps) / 1e4 / 252)
    first = F.first("equity").over(in_time()) / (1 + F.first("r0_").over(in_time()))
    return df.withColumn("equity", first * F.product(1 + F.col("return")).over(so_far())).drop("r0_")


def readiness(metrics: DataFrame, *, minimum_days: int = 252, minimum_dsr: float = 0.95, maximum_pbo: float = 0.5, maximum_drawdown: float = 0.25, minimum_excess: float = 0.0, maximum_turnover: float = 0.5, more: dict[str, str] | None = None) -> DataFrame:
    """decision and failed gates per row of metrics (n_days, deflated_sharpe_prob, pbo, max_drawdown, annual_excess_return, average_turnover,
    point_in_time_complete, accounting_reconciled, stress_passed); what is unknown fails. more: further gates by name, each a boolean column."""
    gates = {
        "holdout_sample": F.col("n_days") >= minimum_days, "deflated_sharpe": F.col("deflated_sharpe_prob") >= minimum_dsr, "selection_bias": F.col("pbo") <= maximum_pbo,
        "drawdown": F.col("max_drawdown") >= -maximum_drawdown, "benchmark_excess": F.col("annual_excess_return") >= minimum_excess, "turnover": F.col("average_turnover") <= maximum_turnover,
        "point_in_time_evidence": F.col("point_in_time_complete"), "accounting_reconciliation": F.col("accounting_reconciled"), "stress_scenarios": F.col("stress_passed")}
    for name, column in (more or {}).items():
        if not name.strip() or name in gates:
            raise ValueError(f"invalid or repeated gate: {name!r}")
        if dict(metrics.dtypes).get(column) != "boolean":
            raise ValueError(f"gate {name!r} needs a boolean column")
        gates[name] = F.col(column)
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(k)) for k, g in sorted(gates.items())]))
    return metrics.withColumn("failed_gates", failed).withColumn("decision", F.when(F.size("failed_gates") == 0, "READY_FOR_PAPER").otherwise("NOT_READY"))

"""Stress tests of a long-short book: the scenario is a key of one plan that goes from ranks through weights, targets and fills to performance.

Scenarios are a short list of settings, so that rows meet them by an array of structs in the row itself, never by a join: ranks are taken once, weights
once for each distinct quantile, targets, fills and books once for each scenario."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import by_date, dated, ratio
from panelwright.plans.session import cut

from . import ledger, risk, signals

KEY = "scenario"


@dataclass(frozen=True)
class Scenario:
    scenario: str
    commission_bps: float
    half_spread_bps: float
    slippage_bps: float
    quantile: float
    lag: int
    cap: float | None


def scenarios(costs: ledger.Costs, policy: ledger.Policy, quantile: float = 0.2, lag: int = 1) -> list[Scenario]:
    """The base and six ways in which it may be worse: doubled costs, tripled spread and slippage, a session of delay, half the participation (without
    a cap: half of 5 %), a narrower and a wider selection."""
    c, s, x = costs.commission_bps, costs.half_spread_bps, costs.slippage_bps
    cap = policy.max_participation_rate
    return [
        Scenario("base", c, s, x, quantile, lag, cap),
        Scenario("doubled_costs", 2 * c, 2 * s, 2 * x, quantile, lag, cap),
        Scenario("tripled_spread_and_slippage", c, 3 * s, 3 * x, quantile, lag, cap),
        Scenario("additional_session_delay", c, s, x, quantile, lag + 1, cap),
        Scenario("halved_participation", c, s, x, quantile, lag, (0.05 if cap is None else cap) / 2),
        Scenario("narrower_selection", c, s, x, quantile * 0.75, lag, cap),
        Scenario("wider_selection", c, s, x, min(quantile * 1.25, 0.49), lag, cap),
    ]


def checked(tests: list[Scenario]) -> list[Scenario]:
    if not tests or len({s.scenario for s in tests}) < len(tests):
        raise ValueError("scenarios need names, each its own")
    for s in tests:
        if not (0 < s.quantile < 0.5 and s.lag >= 1 and (s.cap is None or 0 < s.cap <= 1) and min(s.commission_bps, s.half_spread_bps, s.slippage_bps) >= 0):
            raise ValueError(f"bad scenario: {s}")
    return tests


def _settings(tests: list[Scenario]) -> Column:
    """The scenarios as an array of structs."""
    kinds = {"scenario": "string", "lag": "int"}
    return F.array(*[F.struct(*[F.lit(v).cast(kinds.get(k, "double")).alias(k) for k, v in asdict(s).items()]) for s in tests])


def weights(predictions: DataFrame, quantiles: list[float]) -> DataFrame:
    """(quantile, date, symbol, target_weight) of long-short books of all quantiles, over one ranking of each date's finite predictions."""
    p = F.col("prediction")
    ranks = predictions.filter(p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))).select(
        "date", "symbol", F.count("*").over(by_date()).alias("n_"), F.row_number().over(by_date().orderBy("prediction", "symbol")).alias("rn_"))
    rows = ranks.withColumn("quantile", F.explode(F.array(*map(F.lit, quantiles))))
    return signals.uncapped_weights(rows.select("quantile", "date", "symbol", signals.tails(F.col("n_"), F.col("rn_"), F.col("quantile")).alias("signal")), by=("quantile",))


def orders(books: DataFrame, panel: DataFrame, days: DataFrame, tests: list[Scenario], policy: ledger.Policy, *, every: int, cash: float) -> DataFrame:
    """The steps of every scenario's targets, dated by its lag and sized by the starting cash. books: weights() of the scenarios' quantiles; every
    every-th of its dates is a whole snapshot, in which a symbol without a row has 0. days: the panel's calendar (date, idx). A step whose session
    lies behind the last one drops."""
    decided = dated(books).filter(F.col("idx") % every == 0).withColumn("idx", (F.col("idx") / every).cast("long"))
    grid = ledger.on_sessions(books.select("symbol").distinct().withColumn("first", F.lit(0).cast("long")), decided)
    grid = grid.withColumn("quantile", F.explode(F.array(*map(F.lit, sorted({s.quantile for s in tests})))))
    targets = grid.join(books.hint("merge"), ["quantile", "date", "symbol"], "left").withColumn("s_", F.explode(_settings(tests))).filter("quantile = s_.quantile")
    targets = targets.select("date", "symbol", F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), "s_.scenario", "s_.commission_bps", "s_.half_spread_bps", "s_.slippage_bps", "s_.lag", "s_.cap")
    placed = targets.withColumnRenamed("date", "decision_date").join(days.select(F.col("date").alias("decision_date"), F.col("idx").alias("at_")).hint("merge"), "decision_date")
    placed = placed.withColumn("idx", F.col("at_") + F.col("lag")).join(days.hint("merge"), "idx").drop("idx", "at_")
    own = Window.partitionBy(KEY, "symbol").orderBy("date")
    steps = placed.withColumn("dw", F.col("target_weight") - F.coalesce(F.lag("target_weight").over(own), F.lit(0.0))).filter("dw <> 0")
    inputs = ledger.lagged_inputs(panel, policy).select("date", "symbol", F.col("open").alias("price"), "adv", "vol")
    sized = steps.join(inputs.hint("merge"), ["date", "symbol"], "left")
    return sized.withColumn("requested_shares", F.coalesce(F.col("dw") * cash / F.col("price"), F.lit(0.0))).drop("dw")


def fills(stressed: DataFrame, policy: ledger.Policy) -> DataFrame:
    """orders() filled under each scenario's own costs and participation."""
    costs = ledger.Costs(F.col("commission_bps"), F.col("half_spread_bps"), F.col("slippage_bps"))
    return ledger.fill(stressed, costs, policy, F.col("cap"))


def curves(filled: DataFrame, panel: DataFrame, days: DataFrame, tests: list[Scenario], cash: float) -> DataFrame:
    """Every scenario's curve over all sessions: return, equity, turnover, costs, exposures. A scenario without fills keeps its cash."""
    value = F.col("filled_shares") * F.col("fill_price")
    paid = F.col("commission") + F.col("spread_cost") + F.col("slippage_cost") + F.col("impact_cost")
    flows = filled.groupBy(KEY, "date", "symbol").agg(
        F.sum("filled_shares").alias("q"), F.sum(-value - F.col("commission")).alias("flow"), F.sum(F.abs(value)).alias("traded"), F.sum(paid).alias("transaction_cost"))
    firsts = filled.groupBy(KEY, "symbol").agg(F.min("date").alias("date")).join(days.hint("merge"), "date").select(KEY, "symbol", F.col("idx").alias("first"))
    grid = ledger.on_sessions(firsts, days).join(flows.hint("merge"), [KEY, "date", "symbol"], "left").join(panel.select("date", "symbol", "close").hint("merge"), ["date", "symbol"], "left")
    so_far = Window.partitionBy(KEY, "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    shares, mark = F.sum(F.coalesce("q", F.lit(0.0))).over(so_far), F.last("close", ignorenulls=True).over(so_far)
    held = grid.withColumn("value_", shares * F.coalesce(mark, F.lit(0.0)))
    sums = ["flow", "traded", "transaction_cost", "market_value", "gross"]
    daily = held.groupBy(KEY, "date").agg(F.sum("flow").alias("flow"), F.sum("traded").alias("traded"), F.sum("transaction_cost").alias("transaction_cost"), F.sum("value_").alias("market_value"), F.sum(F.abs("value_")).alias("gross"))
    sessions = days.select("date", F.explode(F.array(*[F.lit(s.scenario) for s in tests])).alias(KEY))
    daily = sessions.join(daily.hint("merge"), [KEY, "date"], "left").fillna(0.0, sums)
    in_time = Window.partitionBy(KEY).orderBy("date")
    df = daily.withColumn("equity", cash + F.sum("flow").over(in_time) + F.col("market_value"))
    df = df.withColumn("before_", F.coalesce(F.lag("equity").over(in_time), F.lit(cash)))
    return df.select(
        KEY, "date", (F.col("equity") / F.col("before_") - 1).alias("return"), "equity", (F.col("traded") / F.col("before_")).alias("turnover"), "transaction_cost",
        ratio(F.col("gross"), F.col("equity")).alias("gross_exposure"), ratio(F.col("market_value"), F.col("equity")).alias("net_exposure"))


def results(stressed: DataFrame, max_drawdown: float) -> DataFrame:
    """Performance of each scenario's curve from its first exposure on, and passed: its largest drawdown is known and within max_drawdown."""
    found = risk.performance(risk.trim_inactive(stressed, KEY), trim=False, by=[KEY])
    within = F.coalesce(~F.isnan("max_drawdown") & (F.col("max_drawdown") >= -abs(max_drawdown)), F.lit(False))
    return found.withColumn("passed", within)


def all_passed(found: DataFrame) -> DataFrame:
    """One row: stress_passed and the names of the scenarios that failed, in order; nothing tested is nothing passed."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col(KEY))))
    return found.agg(F.coalesce(F.min("passed"), F.lit(False)).alias("stress_passed"), F.array_join(failed, ",").alias("failed"))


def stress_curves(predictions: DataFrame, panel: DataFrame, tests: list[Scenario], policy: ledger.Policy, *, every: int = 1, cash: float = 1_000_000.0) -> DataFrame:
    """curves() of all scenarios from predictions (date, symbol, prediction) and a panel. Weights, calendar and fills are written once, as several
    parts of the plan read them."""
    checked(tests)
    days = cut(dated(panel).withColumn("idx", F.col("idx").cast("long")), "days")
    books = cut(weights(predictions, sorted({s.quantile for s in tests})), "books")
    filled = cut(fills(orders(books, panel, days, tests, policy, every=every, cash=cash), policy), "fills")
    return curves(filled, panel, days, tests, cash)

"""Backtest accounting as tables: calendars, order sizing, fills with costs, positions, marks, attribution, audits, and the closed-loop replay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import PERIODS_PER_YEAR, by_symbol, dated, ratio


@dataclass(frozen=True)
class Costs:
    """Basis points of the reference notional."""

    commission_bps: float = 1.0
    half_spread_bps: float = 1.0
    slippage_bps: float = 1.0

    def rate(self) -> float:
        return (self.commission_bps + self.half_spread_bps + self.slippage_bps) / 1e4


@dataclass(frozen=True)
class Policy:
    adv_lookback: int = 20
    volatility_lookback: int = 20
    max_participation_rate: float | None = None
    impact_coefficient: float = 0.0

    def __post_init__(self):
        if self.adv_lookback < 1 or self.volatility_lookback < 2 or self.impact_coefficient < 0:
            raise ValueError("lookbacks must be positive, the impact coefficient not negative")
        if self.max_participation_rate is not None and not 0 < self.max_participation_rate <= 1:
            raise ValueError("max_participation_rate must be in (0, 1]")


def linear_costs(turnover: DataFrame, costs: Costs) -> DataFrame:
    return turnover.withColumn("cost", F.col("turnover") * costs.rate())


def decision_targets(weights: DataFrame, every: int) -> DataFrame:
    """Each every-th decision date as a complete snapshot: a symbol without a row has target 0. Symbols and dates are dimensions of the
    table itself; the product of the two is the snapshot's size."""
    days = dated(weights).filter(F.col("idx") % every == 0).withColumn("idx", (F.col("idx") / every).cast("long"))
    grid = on_sessions(weights.select("symbol").distinct().withColumn("first", F.lit(0).cast("long")), days)
    return grid.join(weights.hint("merge"), ["date", "symbol"], "left").select("date", "symbol", F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"))


def on_sessions(names: DataFrame, days: DataFrame) -> DataFrame:
    """names (with first, a position) on every session from its first on: a sequence of positions for each, joined with the calendar (date, idx
    without gaps) by position."""
    last = days.agg(F.max("idx")).scalar()
    return names.withColumn("idx", F.explode(F.when(F.col("first") <= last, F.sequence(F.col("first"), last)))).drop("first").join(days.hint("merge"), "idx").drop("idx")


def unknown_targets(weights: DataFrame, panel: DataFrame) -> DataFrame:
    """(kind, value) of target symbols and dates that the panel does not have."""
    a = weights.select("symbol").distinct().join(panel.select("symbol").distinct().hint("merge"), "symbol", "left_anti").select(F.lit("symbol").alias("kind"), F.col("symbol").alias("value"))
    b = weights.select("date").distinct().join(panel.select("date").distinct().hint("merge"), "date", "left_anti").select(F.lit("date").alias("kind"), F.col("date").cast("string").alias("value"))
    return a.union(b)


def with_fill_date(decisions: DataFrame, panel: DataFrame, lag: int = 1) -> DataFrame:
    """Adds fill_date, the lag-th session after; decisions too late for one drop."""
    days = dated(panel)
    ahead = days.select((F.col("idx") - lag).alias("idx"), F.col("date").alias("fill_date"))
    return decisions.join(days.hint("merge"), "date").join(ahead.hint("merge"), "idx").drop("idx")


def lagged_inputs(panel: DataFrame, policy: Policy) -> DataFrame:
    """(date, symbol, open, adv, vol): mean volume and return deviation over the full lookback up to the session before."""
    a, v = policy.adv_lookback, policy.volatility_lookback
    wa, wv = by_symbol().rowsBetween(-a, -1), by_symbol().rowsBetween(-v, -1)
    df = panel.withColumn("r_", ratio(F.col("close"), F.lag("close").over(by_symbol())) - 1)
    return df.select("date", "symbol", "open", F.when(F.count("volume").over(wa) == a, F.avg("volume").over(wa)).alias("adv"), F.when(F.count("r_").over(wv) == v, F.stddev_samp("r_").over(wv)).alias("vol"))


def size_orders(positions: DataFrame, targets: DataFrame, equity) -> DataFrame:
    """(key, symbol, requested_shares): target weight times equity over price, less what is held; a held symbol without target goes to 0.
    positions: key, symbol, shares; targets: key, symbol, target_weight, price; equity: a column of targets or a number."""
    both = targets.withColumn("eq_", F.col(equity) if isinstance(equity, str) else F.lit(float(equity))).join(positions.hint("merge"), ["key", "symbol"], "full_outer")
    want = F.coalesce(F.col("target_weight") * F.col("eq_") / F.when(F.col("price") > 0, F.col("price")), F.lit(0.0))
    return both.select("key", "symbol", (want - F.coalesce("shares", F.lit(0.0))).alias("requested_shares"))


def fill(orders: DataFrame, costs: Costs, policy: Policy, cap: Column | None = None) -> DataFrame:
    """Adds the fill to orders (requested_shares, price, adv, vol): a participation cap on lagged volume (no volume: rejected), half spread,
    slippage and square-root impact in the price, commission beside it. cap: a column of the orders instead of the policy's participation rate (null:
    none); the costs may be columns as well."""
    rq = F.abs("requested_shares")
    adv_ok = F.coalesce(F.col("adv") > 0, F.lit(False))
    if cap is None and policy.max_participation_rate is not None:
        cap = F.lit(policy.max_participation_rate)
    size = rq if cap is None else F.when(cap.isNull(), rq).when(adv_ok, F.least(rq, F.col("adv") * cap)).otherwise(0.0)
    size = F.when(F.coalesce(F.col("price") > 0, F.lit(False)), F.coalesce(size, F.lit(0.0))).otherwise(0.0)
    df = orders.withColumn("q_", size)
    df = df.withColumn("participation", F.when(adv_ok & (F.col("q_") > 0), F.col("q_") / F.col("adv")).otherwise(0.0))
    df = df.withColumn("impact_bps", F.when(F.col("q_") > 0, policy.impact_coefficient * F.greatest(F.coalesce("vol", F.lit(0.0)), F.lit(0.0)) * 1e4 * F.sqrt("participation")).otherwise(0.0))
    sign, ref = F.signum("requested_shares"), F.col("q_") * F.coalesce("price", F.lit(0.0))
    bps = F.col("impact_bps") + costs.half_spread_bps + costs.slippage_bps
    return df.withColumns({
        "filled_shares": sign * F.col("q_"),
        "status": F.when(F.col("q_") <= 0, "rejected").when(rq - F.col("q_") <= 1e-8 + 1e-5 * rq, "filled").otherwise("partial"),
        "fill_price": F.when(F.col("q_") > 0, F.col("price") * (1 + sign * bps / 1e4)).otherwise(F.col("price")),
        "commission": ref * costs.commission_bps / 1e4, "spread_cost": ref * costs.half_spread_bps / 1e4,
        "slippage_cost": ref * costs.slippage_bps / 1e4, "impact_cost": ref * F.col("impact_bps") / 1e4,
    }).withColumn("residual_shares", F.col("requested_shares") - F.col("filled_shares")).drop("q_")


def trades(fills: DataFrame) -> DataFrame:
    """Filled orders with their notional and weight of the equity before."""
    n = F.col("filled_shares") * F.col("fill_price")
    return fills.filter("filled_shares <> 0").withColumns({"notional": n, "trade_weight": n / F.col("pretrade_equity"), "total_cost": F.col("commission") + F.col("spread_cost") + F.col("slippage_cost") + F.col("impact_cost")})


def positions(fills: DataFrame, panel: DataFrame, cash: float) -> tuple[DataFrame, DataFrame]:
    """(holdings, equity): per session and symbol shares, mark, value and weight; per session cash, market value and equity. fills:
    date, symbol, filled_shares, fill_price, commission. A symbol is held from its first fill on, equity stands for every session. Sums over
    all earlier fills; marks are the last close."""
    flows = fills.groupBy("date", "symbol").agg(F.sum("filled_shares").alias("q"), F.sum(-F.col("filled_shares") * F.col("fill_price") - F.col("commission")).alias("flow"))
    so_far = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    days = dated(panel)
    firsts = fills.groupBy("symbol").agg(F.min("date").alias("date")).join(days.hint("merge"), "date").select("symbol", F.col("idx").cast("long").alias("first"))
    grid = on_sessions(firsts, days.withColumn("idx", F.col("idx").cast("long")))
    held = grid.join(flows.hint("merge"), ["date", "symbol"], "left").join(panel.select("date", "symbol", "close").hint("merge"), ["date", "symbol"], "left")
    held = held.select("date", "symbol", F.sum(F.coalesce("q", F.lit(0.0))).over(so_far).alias("shares"), F.last("close", ignorenulls=True).over(so_far).alias("mark_price"), F.coalesce("flow", F.lit(0.0)).alias("flow"))
    held = held.withColumn("market_value", F.col("shares") * F.coalesce("mark_price", F.lit(0.0)))
    daily = held.groupBy("date").agg(F.sum("flow").alias("flow"), F.sum("market_value").alias("market_value"), F.sum(F.abs("market_value")).alias("gross"))
    daily = days.select("date").join(daily.hint("merge"), "date", "left").fillna(0.0, ["flow", "market_value", "gross"])
    equity = daily.withColumn("cash", cash + F.sum("flow").over(Window.orderBy("date"))).withColumn("equity", F.col("cash") + F.col("market_value"))
    equity = equity.select("date", "cash", "market_value", "gross", "equity")
    holdings = held.join(equity.select("date", "equity").hint("merge"), "date").select("date", "symbol", "shares", "mark_price", "market_value", ratio(F.col("market_value"), F.col("equity")).alias("weight"))
    return holdings, equity


def curve(equity: DataFrame, fills: DataFrame, cash: float) -> DataFrame:
    """Per session: return, equity, turnover (traded value over the equity before), costs and exposures."""
    t = fills.groupBy("date").agg(F.sum(F.abs(F.col("filled_shares") * F.col("fill_price"))).alias("traded"), F.sum(F.col("commission") + F.col("spread_cost") + F.col("slippage_cost") + F.col("impact_cost")).alias("transaction_cost"))
    before = F.coalesce(F.lag("equity").over(Window.orderBy("date")), F.lit(cash))
    df = equity.join(t.hint("merge"), "date", "left").withColumn("before", before)
    return df.select(
        "date", (F.col("equity") / F.col("before") - 1).alias("return"), "equity", (F.coalesce("traded", F.lit(0.0)) / F.col("before")).alias("turnover"), F.coalesce("transaction_cost", F.lit(0.0)).alias("transaction_cost"),
        ratio(F.col("gross"), F.col("equity")).alias("gross_exposure"), ratio(F.col("market_value"), F.col("equity")).alias("net_exposure"), (F.col("gross") > 0).alias("active"))


def attribution(holdings: DataFrame, fills: DataFrame, panel: DataFrame) -> DataFrame:
    """Per session and symbol: overnight P&L of what was held, intraday P&L of what is held after the open's fills, trading cost, net."""
    px = panel.select("date", "symbol", "open", "close")
    df = holdings.select("date", "symbol", "shares", "mark_price").withColumns({"held": F.coalesce(F.lag("shares").over(by_symbol()), F.lit(0.0)), "last": F.lag("mark_price").over(by_symbol())})
    f = fills.groupBy("date", "symbol").agg(F.sum(F.col("filled_shares") * F.col("price") - F.col("filled_shares") * F.col("fill_price") - F.col("commission")).alias("drag"))
    df = df.join(px.hint("merge"), ["date", "symbol"], "left").join(f.hint("merge"), ["date", "symbol"], "left")
    night = F.col("held") * F.coalesce(F.coalesce("open", "mark_price") - F.col("last"), F.lit(0.0))
    day = F.col("shares") * F.coalesce(F.col("mark_price") - F.coalesce("open", "mark_price"), F.lit(0.0))
    cost = -F.coalesce("drag", F.lit(0.0))
    return df.select("date", "symbol", night.alias("overnight_pnl"), day.alias("intraday_pnl"), cost.alias("trading_cost"), (night + day - cost).alias("net_pnl"))


def reconcile(attributed: DataFrame, equity: DataFrame, cash: float, tolerance: float = 1e-6) -> DataFrame:
    """Sessions on which the symbols' net P&L does not add up to the change of equity: must be empty."""
    change = equity.select("date", (F.col("equity") - F.coalesce(F.lag("equity").over(Window.orderBy("date")), F.lit(cash))).alias("change"), "equity")
    sums = attributed.groupBy("date").agg(F.sum("net_pnl").alias("pnl"))
    return change.join(sums.hint("merge"), "date", "left").withColumn("gap", F.abs(F.col("change") - F.coalesce("pnl", F.lit(0.0)))).filter(F.col("gap") > tolerance * F.greatest(F.lit(1.0), F.abs("equity")))


def risk_scale(equity: DataFrame, *, vol_target: float | None = None, lookback: int = 20, max_leverage: float = 1.5, drawdown_deleverage: float | None = None, drawdown_cut: float = 0.5) -> DataFrame:
    """Adds risk_scale from the realised path up to each session: target over realised volatility, at most max_leverage, times the cut in a
    drawdown."""
    w = Window.orderBy("date")
    sd = F.stddev_samp("return").over(w.rowsBetween(-(lookback - 1), 0)) * PERIODS_PER_YEAR ** 0.5
    scale = F.lit(1.0) if vol_target is None else F.when((F.count("return").over(w.rowsBetween(-(lookback - 1), 0)) >= 2) & (sd > 0), F.least(vol_target / sd, F.lit(max_leverage))).otherwise(1.0)
    if drawdown_deleverage is not None:
        dd = F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
        scale = scale * F.when(dd < -abs(drawdown_deleverage), drawdown_cut).otherwise(1.0)
    return equity.withColumn("risk_scale", scale)


def missing_prices(required: DataFrame, panel: DataFrame, column: str = "open") -> DataFrame:
    """Required (date, symbol) without a finite, positive price."""
    ok = panel.filter((F.col(column) > 0) & (F.abs(column) < float("inf"))).select("date", "symbol")
    return required.select("date", "symbol").distinct().join(ok.hint("merge"), ["date", "symbol"], "left_anti")


def with_liquidation(targets: DataFrame, panel: DataFrame, sessions: int, lag: int = 1) -> DataFrame:
    """Targets with a zero snapshot so many sessions after the last decision, and nothing after its fill."""
    days = dated(panel)
    last = targets.agg(F.max("date").alias("date")).join(days.hint("merge"), "date").select((F.col("idx") + sessions).alias("idx"))
    end = last.join(days.hint("merge"), "idx").select("date")
    return targets.unionByName(targets.select("symbol").distinct().join(F.broadcast(end)).select("date", "symbol", F.lit(0.0).alias("target_weight")))


def order_view(fills: DataFrame, sessions: int = 5) -> DataFrame:
    """Orders of the last sessions up to the latest fill: side, shortfall in basis points against the reference price, state."""
    rank = F.dense_rank().over(Window.orderBy(F.desc("date")))
    days = fills.select("date").distinct().withColumn("k_", rank).filter(F.col("k_") <= sessions).select("date")
    side = F.when(F.col("requested_shares") > 0, "buy").when(F.col("requested_shares") < 0, "sell").otherwise("flat")
    short = F.when(F.col("filled_shares") != 0, F.signum("filled_shares") * (F.col("fill_price") / F.col("price") - 1) * 1e4)
    state = F.when(F.col("status") == "filled", "FILLED").when(F.col("status") == "partial", "PARTIALLY_FILLED").otherwise("REJECTED")
    return fills.join(F.broadcast(days), "date").select("date", "symbol", side.alias("side"), "requested_shares", "filled_shares", short.alias("shortfall_bps"), state.alias("state"))


def replay(panel: DataFrame, targets: DataFrame, scenarios: DataFrame, *, cash: float = 1_000_000.0, lag: int = 1) -> DataFrame:
    """The closed loop per (portfolio, scenario): (portfolio, scenario, date, equity, cash, gross, net, traded, cost). Orders of a day are
    sized from the equity at its open, filled at the open under costs and a participation cap, and marked at the close.

    panel: date, symbol, open, close, adv; targets: portfolio, date, symbol, target_weight (complete snapshots); scenarios: scenario,
    cost_bps, cap (null: none). A portfolio's panel becomes one array of days, each an array over its sorted symbols; the SQL fold runs over
    it with the state (cash, shares), and every portfolio and scenario is a task of its own. Prices that are missing carry no trade."""
    names = targets.select("portfolio", "symbol").distinct().withColumn("first", F.lit(0).cast("long"))
    fills = with_fill_date(targets, panel, lag).select("portfolio", "symbol", F.col("fill_date").alias("date"), "target_weight")
    grid = on_sessions(names, dated(panel).withColumn("idx", F.col("idx").cast("long"))).join(panel.hint("merge"), ["date", "symbol"], "left").join(fills.hint("merge"), ["portfolio", "date", "symbol"], "left")
    w = Window.partitionBy("portfolio", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumns({"mark": F.last("close", ignorenulls=True).over(w), "px": F.coalesce("open", F.last("close", ignorenulls=True).over(w))})
    row = F.struct("symbol", F.coalesce("px", F.lit(0.0)).alias("px"), F.coalesce("mark", F.lit(0.0)).alias("mark"), F.coalesce("adv", F.lit(0.0)).alias("adv"), F.coalesce(F.col("open") > 0, F.lit(False)).alias("ok"), "target_weight")
    per_day = grid.groupBy("portfolio", "date").agg(F.array_sort(F.collect_list(row)).alias("s"))
    books = per_day.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct("date", "s"))).alias("days"))
    kind = "struct<date: date, equity: double, cash: double, gross: double, net: double, traded: double, cost: double>"
    total = lambda arr, expr: f"aggregate({arr}, 0D, (t, x) -> t + {expr})"
    fold = f"""aggregate(days, named_struct('cash', {cash}D, 'pos', transform(days[0].s, x -> 0D), 'out', cast(array() as array<{kind}>)),
      (st, d) -> transform(array(st.cash + {total("zip_with(st.pos, d.s, (p, x) -> p * x.px)", "x")}), eq ->
        transform(array(zip_with(st.pos, d.s, (p, x) -> transform(array(if(x.target_weight is null or not x.ok, 0D, x.target_weight * eq / x.px - p)), o ->
            if(cap is null, o, signum(o) * least(abs(o), x.adv * cap)))[0])), q ->
          transform(array(named_struct('cost', {total("zip_with(q, d.s, (o, x) -> abs(o) * x.px * cost_bps / 1e4D)", "x")}, 'spent', {total("zip_with(q, d.s, (o, x) -> o * x.px)", "x")},
                                       'traded', {total("zip_with(q, d.s, (o, x) -> abs(o) * x.px)", "x")}, 'pos', zip_with(st.pos, q, (p, o) -> p + o))), f ->
            named_struct('cash', st.cash - f.spent - f.cost, 'pos', f.pos, 'out', array_append(st.out, named_struct(
              'date', d.date, 'equity', st.cash - f.spent - f.cost + {total("zip_with(f.pos, d.s, (p, x) -> p * x.mark)", "x")}, 'cash', st.cash - f.spent - f.cost,
              'gross', {total("zip_with(f.pos, d.s, (p, x) -> abs(p * x.mark))", "x")}, 'net', {total("zip_with(f.pos, d.s, (p, x) -> p * x.mark)", "x")}, 'traded', f.traded, 'cost', f.cost))))[0])[0])[0],
      st -> st.out)"""
    runs = books.join(F.broadcast(scenarios))  # a handful of scenarios
    return runs.select("portfolio", "scenario", F.explode(F.expr(fold)).alias("o")).select("portfolio", "scenario", "o.*")

"""Derived tables that several queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.windows import by_symbol
from panelwright.operators import ledger, signals, stress
from panelwright.operators.features import k_return
from panelwright.operators.labels import build_labels
from panelwright.sources.adapter import BARS_SQL, BENCHMARK, bars

from .session import cut

CASH = 1_000_000.0
COSTS = ledger.Costs(1.0, 1.0, 2.0)
POLICY = ledger.Policy(adv_lookback=4, volatility_lookback=4, max_participation_rate=0.10, impact_coefficient=0.05)
EVERY = 4


def panel(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d)


def once(spark: SparkSession, d: str) -> DataFrame:
    """The panel, for queries whose plan reads it in many places: bars() writes it at each call."""
    return bars(spark, d)


# p, where a query has it: its panel


def names(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    return (panel(spark, d) if p is None else p).filter(F.col("symbol") != BENCHMARK)


def bench(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    return (panel(spark, d) if p is None else p).filter(F.col("symbol") == BENCHMARK)


def predictions(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    """Two rules against the return of the next five bars; rows without target or signal are left out."""
    rows = names(spark, d, p).select("date", "symbol", "close", k_return(5).alias("m"), k_return(1).alias("r"), (F.lead("close", 5).over(by_symbol()) / F.col("close") - 1).alias("target"))
    rows = rows.filter("m is not null and r is not null and target is not null")
    return rows.select("date", "symbol", "target", F.explode(F.array(F.struct(F.lit("momentum").alias("model"), F.col("m").alias("prediction")), F.struct(F.lit("reversal").alias("model"), (-F.col("r")).alias("prediction")))).alias("p")).select("date", "symbol", "p.model", "p.prediction", "target")


def one_model(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    return predictions(spark, d, p).filter("model = 'momentum'")


def weights(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    return signals.uncapped_weights(signals.build_signals(one_model(spark, d, p)))


def orders(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    own = names(spark, d, p)
    t = ledger.with_fill_date(ledger.decision_targets(cut(weights(spark, d, p), "weights"), EVERY), own)
    t = t.select(F.col("fill_date").alias("date"), "symbol", (F.col("target_weight") - F.coalesce(F.lag("target_weight").over(by_symbol()), F.lit(0.0))).alias("dw"), F.col("date").alias("decision_date"), "target_weight")
    x = ledger.lagged_inputs(own, POLICY).select("date", "symbol", F.col("open").alias("price"), "adv", "vol")
    rows = t.filter("dw <> 0").join(x.hint("merge"), ["date", "symbol"], "left")
    return rows.select("date", "symbol", "decision_date", "target_weight", F.coalesce(F.col("dw") * CASH / F.col("price"), F.lit(0.0)).alias("requested_shares"), "price", "adv", "vol", F.lit(CASH).alias("pretrade_equity"))


def fills(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    return ledger.fill(orders(spark, d, once(spark, d) if p is None else p), COSTS, POLICY)


class Books:
    """Panel, fills, holdings and equity, each written once for all that a query reads from them."""

    def __init__(self, spark: SparkSession, d: str):
        whole = once(spark, d)
        self.panel, self.bench = names(spark, d, whole), bench(spark, d, whole)
        self.fills = cut(fills(spark, d, whole), "fills")
        holdings, equity = ledger.positions(self.fills, self.panel, CASH)
        self.holdings, self.equity = holdings, cut(equity, "equity")

    def attribution(self) -> DataFrame:
        return ledger.attribution(self.holdings, self.fills, self.panel)


def curve(spark: SparkSession, d: str, books: Books | None = None) -> DataFrame:
    """A row per session."""
    at = books or Books(spark, d)
    b = at.bench.select("date", k_return(1).alias("benchmark_return"))
    return cut(ledger.curve(at.equity, at.fills, CASH).join(b.hint("merge"), "date", "left").withColumn("benchmark_return", F.coalesce("benchmark_return", F.lit(0.0))), "curve")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return build_labels(panel(spark, d), BENCHMARK, (1, 5), 5)


def rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, of: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({of}) {rows(n)} >= {least or n} THEN {agg} {rows(n)} END"


S = "OVER (PARTITION BY symbol ORDER BY date)"
RANK = "(rank() OVER (PARTITION BY {p} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {p}, {x}) - 1) / 2.0)"


def avg_rank(x: str, p: str) -> str:
    return RANK.format(x=x, p=p)


def pct(x: str, p: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {avg_rank(x, p)} / count({x}) OVER (PARTITION BY {p}) END"


PRED = f"""{BARS_SQL},
moves_ AS (SELECT date, symbol, close, close / nullif(lag(close, 5) {S}, 0) - 1 AS m, close / nullif(lag(close) {S}, 0) - 1 AS r, lead(close, 5) {S} / close - 1 AS target FROM bars),
known_ AS (SELECT * FROM moves_ WHERE m IS NOT NULL AND r IS NOT NULL AND target IS NOT NULL),
pred AS (SELECT date, symbol, 'momentum' AS model, m AS prediction, target FROM known_ UNION ALL SELECT date, symbol, 'reversal', -r, target FROM known_)"""

WEIGHTS = f"""{PRED},
ranked_ AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY prediction, symbol) AS rn, count(*) OVER (PARTITION BY date) AS n FROM pred WHERE model = 'momentum'),
sig AS (SELECT date, symbol, prediction, CASE WHEN n < 2 THEN 0.0 WHEN rn > n - greatest(1, floor(n * 0.2)) THEN 1.0 WHEN rn <= greatest(1, floor(n * 0.2)) THEN -1.0 ELSE 0.0 END AS signal FROM ranked_),
sides_ AS (SELECT *, sum(greatest(signal, 0.0)) OVER (PARTITION BY date) AS p, -sum(least(signal, 0.0)) OVER (PARTITION BY date) AS m FROM sig),
raw_ AS (SELECT *, greatest(least(CASE WHEN p > 0 AND m > 0 THEN CASE WHEN signal > 0 THEN signal / p WHEN signal < 0 THEN signal / m ELSE 0 END * 0.5
  ELSE coalesce(signal / nullif(p + m, 0), 0) END, 0.1), -0.1) AS w FROM sides_),
weights AS (SELECT date, symbol, CASE WHEN g > 1 THEN w / g ELSE w END AS target_weight FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY date) AS g FROM raw_))"""

FILLS = f"""{WEIGHTS},
wdays_ AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM weights)),
targets AS (SELECT d.date, s.symbol, coalesce(w.target_weight, 0) AS target_weight FROM wdays_ d CROSS JOIN (SELECT DISTINCT symbol FROM weights) s LEFT JOIN weights w ON w.date = d.date AND w.symbol = s.symbol WHERE idx % {EVERY} = 0),
pdays_ AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars)),
dated_ AS (SELECT b.date, t.symbol, t.date AS decision_date, t.target_weight FROM targets t JOIN pdays_ a ON a.date = t.date JOIN pdays_ b ON b.idx = a.idx + 1),
steps_ AS (SELECT *, target_weight - coalesce(lag(target_weight) {S}, 0) AS dw FROM dated_),
rets_ AS (SELECT *, close / nullif(lag(close) {S}, 0) - 1 AS r FROM bars),
inputs AS (SELECT date, symbol, open AS price,
  CASE WHEN count(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS adv,
  CASE WHEN count(r) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS vol FROM rets_),
orders_ AS (SELECT s.date, s.symbol, s.decision_date, s.target_weight, coalesce(s.dw * {CASH} / i.price, 0) AS requested_shares, price, adv, vol FROM steps_ s LEFT JOIN inputs i ON i.date = s.date AND i.symbol = s.symbol WHERE dw <> 0),
sized_ AS (SELECT *, CASE WHEN coalesce(price > 0, false) AND coalesce(adv > 0, false) THEN least(abs(requested_shares), adv * 0.10) ELSE 0.0 END AS q FROM orders_),
part_ AS (SELECT *, CASE WHEN q > 0 THEN q / adv ELSE 0 END AS participation FROM sized_),
imp_ AS (SELECT *, CASE WHEN q > 0 THEN 0.05 * greatest(coalesce(vol, 0), 0) * 1e4 * sqrt(participation) ELSE 0 END AS impact_bps FROM part_),
fills AS (SELECT date, symbol, decision_date, target_weight, requested_shares, price, adv, vol, participation, impact_bps, sign(requested_shares) * q AS filled_shares,
  CASE WHEN q <= 0 THEN 'rejected' WHEN abs(requested_shares) - q <= 1e-8 + 1e-5 * abs(requested_shares) THEN 'filled' ELSE 'partial' END AS status,
  CASE WHEN q > 0 THEN price * (1 + sign(requested_shares) * (impact_bps + 3.0) / 1e4) ELSE price END AS fill_price,
  q * coalesce(price, 0) * 1.0 / 1e4 AS commission, q * coalesce(price, 0) * 1.0 / 1e4 AS spread_cost, q * coalesce(price, 0) * 2.0 / 1e4 AS slippage_cost, q * coalesce(price, 0) * impact_bps / 1e4 AS impact_cost,
  requested_shares - sign(requested_shares) * q AS residual_shares FROM imp_)"""

CURVE = f"""{FILLS},
flows_ AS (SELECT date, symbol, sum(filled_shares) AS q, sum(-filled_shares * fill_price - commission) AS flow FROM fills GROUP BY date, symbol),
grid_ AS (SELECT d.date, s.symbol, f.q, coalesce(f.flow, 0) AS flow, b.close, b.open FROM (SELECT DISTINCT date FROM bars) d JOIN (SELECT symbol, min(date) AS since FROM fills GROUP BY symbol) s ON d.date >= since
  LEFT JOIN flows_ f ON f.date = d.date AND f.symbol = s.symbol LEFT JOIN bars b ON b.date = d.date AND b.symbol = s.symbol),
held_ AS (SELECT date, symbol, flow, open, sum(coalesce(q, 0)) OVER w AS shares, last_value(close IGNORE NULLS) OVER w AS mark_price FROM grid_ WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
values_ AS (SELECT *, shares * coalesce(mark_price, 0) AS market_value FROM held_),
daily_ AS (SELECT d.date, coalesce(sum(flow), 0) AS flow, coalesce(sum(market_value), 0) AS market_value, coalesce(sum(abs(market_value)), 0) AS gross FROM (SELECT DISTINCT date FROM bars) d LEFT JOIN values_ v ON v.date = d.date GROUP BY d.date),
equity AS (SELECT date, {CASH} + sum(flow) OVER (ORDER BY date) AS cash, market_value, gross, {CASH} + sum(flow) OVER (ORDER BY date) + market_value AS equity FROM daily_),
paid_ AS (SELECT date, sum(abs(filled_shares * fill_price)) AS traded, sum(commission + spread_cost + slippage_cost + impact_cost) AS cost FROM fills GROUP BY date),
before_ AS (SELECT e.*, coalesce(lag(equity) OVER (ORDER BY e.date), {CASH}) AS prev, traded, cost FROM equity e LEFT JOIN paid_ p ON p.date = e.date),
bench_ AS (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS b FROM panel WHERE symbol = 'BENCH'),
curve AS (SELECT x.date, equity / prev - 1 AS "return", equity, coalesce(traded, 0) / prev AS turnover, coalesce(cost, 0) AS transaction_cost, gross / nullif(equity, 0) AS gross_exposure,
  market_value / nullif(equity, 0) AS net_exposure, gross > 0 AS active, coalesce(b, 0) AS benchmark_return FROM before_ x LEFT JOIN bench_ ON bench_.date = x.date)"""

STRESSES = stress.scenarios(COSTS, POLICY)
_TESTS = ", ".join(f"('{s.scenario}', {s.commission_bps}e0, {s.half_spread_bps}e0, {s.slippage_bps}e0, {s.quantile!r}e0, {s.lag}, {s.cap!r}e0)" for s in STRESSES)

STRESSED = f"""{PRED},
tests_ AS (SELECT * FROM (VALUES {_TESTS}) v(scenario, commission_bps, half_spread_bps, slippage_bps, quantile, lag, cap)),
ranked_ AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY prediction, symbol) AS rn, count(*) OVER (PARTITION BY date) AS n FROM pred WHERE model = 'momentum'),
sig_ AS (SELECT scenario, date, symbol, CASE WHEN n < 2 THEN 0.0 WHEN rn > n - greatest(1, floor(n * quantile)) THEN 1.0 WHEN rn <= greatest(1, floor(n * quantile)) THEN -1.0 ELSE 0.0 END AS signal FROM ranked_, tests_),
sides_ AS (SELECT *, sum(greatest(signal, 0.0)) OVER (PARTITION BY scenario, date) AS p, -sum(least(signal, 0.0)) OVER (PARTITION BY scenario, date) AS m FROM sig_),
raw_ AS (SELECT *, greatest(least(CASE WHEN p > 0 AND m > 0 THEN CASE WHEN signal > 0 THEN signal / p WHEN signal < 0 THEN signal / m ELSE 0 END * 0.5
  ELSE coalesce(signal / nullif(p + m, 0), 0) END, 0.1), -0.1) AS w FROM sides_),
books_ AS (SELECT scenario, date, symbol, CASE WHEN g > 1 THEN w / g ELSE w END AS target_weight FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY scenario, date) AS g FROM raw_)),
wdays_ AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM books_)),
pdays_ AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars)),
placed_ AS (SELECT t.*, b.date, s.symbol, coalesce(w.target_weight, 0) AS target_weight FROM wdays_ d CROSS JOIN (SELECT DISTINCT symbol FROM books_) s CROSS JOIN tests_ t
  LEFT JOIN books_ w ON w.date = d.date AND w.symbol = s.symbol AND w.scenario = t.scenario JOIN pdays_ a ON a.date = d.date JOIN pdays_ b ON b.idx = a.idx + t.lag WHERE d.idx % {EVERY} = 0),
steps_ AS (SELECT *, target_weight - coalesce(lag(target_weight) OVER (PARTITION BY scenario, symbol ORDER BY date), 0) AS dw FROM placed_),
rets_ AS (SELECT *, close / nullif(lag(close) {S}, 0) - 1 AS r FROM bars),
inputs_ AS (SELECT date, symbol, open AS price,
  CASE WHEN count(volume) OVER w = 4 THEN avg(volume) OVER w END AS adv, CASE WHEN count(r) OVER w = 4 THEN stddev_samp(r) OVER w END AS vol FROM rets_
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
orders_ AS (SELECT s.*, price, adv, vol, coalesce(s.dw * {CASH} / i.price, 0) AS wanted FROM steps_ s LEFT JOIN inputs_ i ON i.date = s.date AND i.symbol = s.symbol WHERE dw <> 0),
sized_ AS (SELECT *, CASE WHEN coalesce(price > 0, false) AND coalesce(adv > 0, false) THEN least(abs(wanted), adv * cap) ELSE 0.0 END AS q FROM orders_),
imp_ AS (SELECT *, CASE WHEN q > 0 THEN 0.05 * greatest(coalesce(vol, 0), 0) * 1e4 * sqrt(q / adv) ELSE 0 END AS impact_bps FROM sized_),
sfills_ AS (SELECT *, sign(wanted) * q AS shares, CASE WHEN q > 0 THEN price * (1 + sign(wanted) * (impact_bps + half_spread_bps + slippage_bps) / 1e4) ELSE price END AS fill_price, q * coalesce(price, 0) * commission_bps / 1e4 AS commission,
  q * coalesce(price, 0) * (commission_bps + half_spread_bps + slippage_bps + impact_bps) / 1e4 AS paid FROM imp_),
flows_ AS (SELECT scenario, date, symbol, sum(shares) AS q, sum(-shares * fill_price - commission) AS flow, sum(abs(shares * fill_price)) AS traded, sum(paid) AS paid FROM sfills_ GROUP BY scenario, date, symbol),
grid_ AS (SELECT s.scenario, d.date, s.symbol, f.q, coalesce(f.flow, 0) AS flow, f.traded, f.paid, b.close FROM pdays_ d JOIN (SELECT scenario, symbol, min(date) AS since FROM sfills_ GROUP BY scenario, symbol) s ON d.date >= since
  LEFT JOIN flows_ f ON f.date = d.date AND f.symbol = s.symbol AND f.scenario = s.scenario LEFT JOIN bars b ON b.date = d.date AND b.symbol = s.symbol),
values_ AS (SELECT *, sum(coalesce(q, 0)) OVER w * coalesce(last_value(close IGNORE NULLS) OVER w, 0) AS market_value FROM grid_ WINDOW w AS (PARTITION BY scenario, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
daily_ AS (SELECT t.scenario, d.date, coalesce(sum(flow), 0) AS flow, coalesce(sum(traded), 0) AS traded, coalesce(sum(paid), 0) AS paid, coalesce(sum(market_value), 0) AS market_value, coalesce(sum(abs(market_value)), 0) AS gross
  FROM pdays_ d CROSS JOIN tests_ t LEFT JOIN values_ v ON v.date = d.date AND v.scenario = t.scenario GROUP BY t.scenario, d.date),
equity_ AS (SELECT *, {CASH} + sum(flow) OVER (PARTITION BY scenario ORDER BY date) + market_value AS equity FROM daily_),
before_ AS (SELECT *, coalesce(lag(equity) OVER (PARTITION BY scenario ORDER BY date), {CASH}) AS prev FROM equity_),
scurve AS (SELECT scenario, date, equity / prev - 1 AS "return", equity, traded / prev AS turnover, paid AS transaction_cost, gross / nullif(equity, 0) AS gross_exposure, market_value / nullif(equity, 0) AS net_exposure FROM before_)"""

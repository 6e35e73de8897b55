"""All queries of the library over the driver tables, with their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import by_symbol
from panelwright.operators import capacity, evaluate, features, ledger, models, regimes, risk, signals, splits, stress
from panelwright.operators.labels import build_labels
from panelwright.sources import contract
from panelwright.sources.adapter import BARS_SQL, BENCHMARK, table, ticks
from panelwright.streaming import gate

from . import tables as t
from .session import cut
from .tables import CASH, CURVE, FILLS, PRED, STRESSED, S, WEIGHTS, avg_rank, full, pct, rows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_RAW: dict[str, str] = {}  # the same without rounding, for queries that are made of others


SHIFT = 0.000137


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many decimals, NaN as null, no negative zero. Sums of money are rounded to three, shifted a little: many end in 5
    exactly, where the order of summation would decide."""
    return df.select(*[(F.round(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) + (SHIFT if digits == 3 else 0.0), digits) + 0.0).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(name: str, ctes: str = "", select: str = "", doubles: str = "", digits: int = 6):
    """Registers a function of (spark, folder); with SQL, its named doubles are rounded alike."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
        if select:
            names = doubles.split()
            replace = f" REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE){f' + {SHIFT}' if digits == 3 else ''}, {digits}) + 0 AS {c}' for c in names)})" if names else ""
            start = f"WITH RECURSIVE {ctes + ',' if ctes else ''} result_ AS ({select}) SELECT *"
            _SQL[name], _RAW[name] = f"{start}{replace} FROM result_", f"{start} FROM result_"
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- sources and contracts -----------------------------------------------------------------------------------------


# a price is a two-decimal amount over a quantity up to 50: where that ends, it does so within seven decimals, so that eight never tie
@query("bars", BARS_SQL, "SELECT * FROM panel", "open high low close volume", digits=8)
def _(spark, d):
    return t.panel(spark, d)


@query("ticks", "", """SELECT date_trunc('hour', ts) AS date, event_type AS symbol, first(value ORDER BY ts) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events WHERE value > 0 GROUP BY 1, 2""", "open high low close volume")
def _(spark, d):
    return ticks(spark, d)


@query("panel_violations", BARS_SQL, """SELECT r.rule, CAST(r.v AS BIGINT) AS violations FROM (SELECT count(*) - count(DISTINCT (date, symbol)) AS dk, count(*) FILTER (date IS NULL OR symbol IS NULL) AS nk, count(*) FILTER (close <= 0) AS np,
  count(*) FILTER (close IS NULL) AS nc, count(*) FILTER (volume IS NULL) AS nv, count(*) FILTER (high < low) AS hl FROM gaps_), LATERAL (VALUES ('duplicate_key', dk), ('null_key', nk), ('non_positive_close', np), ('null_close', nc), ('null_volume', nv), ('high_below_low', hl)) r(rule, v)""".replace("gaps_", "(SELECT date, symbol, CASE WHEN day(date) % 3 <> 0 THEN close END AS close, CASE WHEN day(date) % 4 <> 0 THEN volume END AS volume, CASE WHEN day(date) % 7 = 0 THEN low - 1 ELSE high END AS high, low FROM panel)"))
def _(spark, d):
    p = t.panel(spark, d)
    day = F.dayofmonth("date")
    return contract.violations(p.withColumns({"close": F.when(day % 3 != 0, F.col("close")), "volume": F.when(day % 4 != 0, F.col("volume")), "high": F.when(day % 7 == 0, F.col("low") - 1).otherwise(F.col("high"))}))


ALL_NAMES = [*sorted(f"NATION_{i}" for i in range(25)), "BENCH"]


@query("panel_wide", BARS_SQL, "SELECT date, " + ", ".join(f"max(close) FILTER (symbol = '{n}') AS \"{n}\"" for n in ALL_NAMES) + " FROM panel GROUP BY date", " ".join(f'"{n}"' for n in ALL_NAMES))
def _(spark, d):
    # the symbols are those of a table of 25 rows
    found = sorted(r[0] for r in table(spark, d, "nation").select("n_name").distinct().collect())
    return contract.to_wide(t.panel(spark, d), [*found, BENCHMARK])


@query("quality_report", BARS_SQL, f"""SELECT symbol, min(date) AS start, max(date) AS "end", count(*) AS "rows", (SELECT count(DISTINCT date) FROM panel q WHERE q.date BETWEEN min(r.date) AND max(r.date)) - count(*) AS missing_sessions,
  count(*) FILTER (close IS NULL) AS null_close, count(*) FILTER (volume = 0) AS zero_volume, count(*) FILTER (r > 0.40) AS extreme_returns, max(r) AS max_abs_return FROM (SELECT *, abs(close / lag(close) {S} - 1) AS r FROM panel) r GROUP BY symbol""", "max_abs_return")
def _(spark, d):
    return contract.quality_report(t.panel(spark, d)).withColumn("missing_sessions", F.col("missing_sessions").cast("long"))


@query("fill_missing", BARS_SQL, """SELECT date, symbol, coalesce(close, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS close, open, high, low, coalesce(volume, 0) AS volume
  FROM (SELECT date, symbol, open, high, low, CASE WHEN day(date) > 12 THEN close END AS close, CASE WHEN day(date) % 4 <> 0 THEN volume END AS volume FROM panel)""", "open high low close volume")
def _(spark, d):
    day = F.dayofmonth("date")
    return contract.fill_missing(t.panel(spark, d).withColumns({"close": F.when(day > 12, F.col("close")), "volume": F.when(day % 4 != 0, F.col("volume"))}), 2)


def bundle(spark, d):
    """Events as bundle rows: a session a day that closes with its last event; rows become available eight hours later."""
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select(
        F.to_date("ts").alias("date"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("ticker"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("instrument_id"),
        *[F.col("value").alias(c) for c in ("open", "low", "close")], (F.col("value") + (F.col("user_id") % 3 - 1)).alias("high"), (F.col("user_id") - 1).cast("double").alias("volume"),
        ts.alias("effective_at"), (ts + F.expr("interval 8 hours")).alias("available_at"), F.when(F.col("user_id") % 10 == 0, "EUR").otherwise("USD").alias("currency"))


BUNDLE = """bundle_ AS (SELECT CAST(ts AS DATE) AS date, event_type || '-' || event_id AS ticker, event_type || '-' || event_id AS instrument_id, value AS open, value AS low, value AS close, value + (user_id % 3 - 1) AS high, user_id - 1 AS volume,
  ts AS effective_at, ts + INTERVAL 8 HOUR AS available_at, CASE WHEN user_id % 10 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM events)"""


@query("row_contract_audit", BUNDLE, """SELECT rule, CAST(v AS BIGINT) AS violations FROM (SELECT count(*) - count(DISTINCT (date, ticker)) AS dk, count(*) FILTER (effective_at IS NULL) AS a, count(*) FILTER (available_at IS NULL) AS b, count(*) FILTER (available_at < effective_at) AS c,
  count(*) FILTER (date > CAST(effective_at AS DATE)) AS e, count(*) FILTER (least(open, high, low, close) <= 0 OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS f, count(*) FILTER (volume < 0) AS g,
  count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS h, count(*) FILTER (trim(coalesce(instrument_id, '')) = '' OR trim(coalesce(currency, '')) = '') AS i, count(*) FILTER (currency NOT IN ('USD')) AS j, count(*) FILTER (ticker <> instrument_id) AS k FROM bundle_),
  LATERAL (VALUES ('duplicate_key', dk), ('effective_missing', a), ('available_missing', b), ('available_before_effective', c), ('date_after_effective', e), ('non_positive_price', f), ('negative_volume', g), ('bounds', h), ('empty_text', i), ('currency', j), ('instrument', k)) r(rule, v)""")
def _(spark, d):
    return contract.audit_rows(bundle(spark, d))


@query("as_of_view", BUNDLE, "SELECT date, count(*) AS n, sum(close) AS total FROM bundle_ WHERE available_at <= TIMESTAMP '2024-01-12 00:00:00' GROUP BY date", "total")
def _(spark, d):
    return contract.as_of(bundle(spark, d), "2024-01-12 00:00:00").groupBy("date").agg(F.count("*").alias("n"), F.sum("close").alias("total"))


@query("decision_panel", BUNDLE, """SELECT b.ticker, b.date, min(c.date) AS decision_date FROM bundle_ b JOIN (SELECT date, max(effective_at) AS close_at FROM bundle_ GROUP BY date) c ON c.close_at >= b.available_at GROUP BY b.ticker, b.date""")
def _(spark, d):
    return contract.decision_panel(bundle(spark, d)).select("ticker", "date", "decision_date")


@query("latest_predictions", PRED, "SELECT symbol, model, date, prediction FROM pred WHERE date = (SELECT max(date) FROM pred)", "prediction")
def _(spark, d):
    p = t.predictions(spark, d)
    last = p.agg(F.max("date").alias("date"))
    return p.join(F.broadcast(last), "date", "left_semi").select("symbol", "model", "date", "prediction")


#: Feature windows of the queries: weekly bars over seven years are too few for the defaults, which are those of daily bars.
CONFIG = {
    "vol_windows": [5, 20], "ma_windows": [5, 20], "momentum_windows": [5, 20], "drawdown_window": 60, "rolling_sharpe_window": 20, "beta_window": 20, "regime_trend_fast": 10, "regime_trend_slow": 30,
}


# --- features and labels ----------------------------------------------------------------------------------------------


TECH = f"""{BARS_SQL}, r_ AS (SELECT *, close / nullif(lag(close) {S}, 0) - 1 AS r, close / nullif(lag(close, 5) {S}, 0) - 1 AS r5 FROM bars)"""
YEAR = "sqrt(252)"


@query("features_returns", TECH, f"SELECT date, symbol, r AS ret_1, r5 AS ret_5, close / nullif(lag(close, 20) {S}, 0) - 1 AS ret_20, ln(close) - ln(lag(close) {S}) AS log_ret, ({full('stddev_samp(r)', 'r', 5)}) * {YEAR} AS vol_5, ({full('stddev_samp(r)', 'r', 20)}) * {YEAR} AS vol_20, r5 AS momentum_5 FROM r_", "ret_1 ret_5 ret_20 log_ret vol_5 vol_20 momentum_5")
def _(spark, d):
    return features.technical(t.names(spark, d), CONFIG).select("date", "symbol", "ret_1", "ret_5", "ret_20", "log_ret", "vol_5", "vol_20", "momentum_5")


@query("features_levels", TECH, f"""SELECT date, symbol, close / nullif({full('avg(close)', 'close', 5)}, 0) - 1 AS ma_ratio_5, close / nullif({full('avg(close)', 'close', 20)}, 0) - 1 AS ma_ratio_20,
  (close - ({full('avg(close)', 'close', 20)})) / nullif(2 * ({full('stddev_samp(close)', 'close', 20)}), 0) AS bollinger_z, close / nullif({full('max(close)', 'close', 60, 20)}, 0) - 1 AS drawdown,
  ({full('avg(r)', 'r', 20)}) / nullif({full('stddev_samp(r)', 'r', 20)}, 0) * {YEAR} AS rolling_sharpe, (r5 - ({full('avg(r5)', 'r5', 60)})) / nullif({full('stddev_samp(r5)', 'r5', 60)}, 0) AS mean_reversion_z FROM r_""", "ma_ratio_5 ma_ratio_20 bollinger_z drawdown rolling_sharpe mean_reversion_z")
def _(spark, d):
    return features.technical(t.names(spark, d), CONFIG).select("date", "symbol", "ma_ratio_5", "ma_ratio_20", "bollinger_z", "drawdown", "rolling_sharpe", "mean_reversion_z")


@query("features_volume", TECH, f"""SELECT date, symbol, (volume - ({full('avg(volume)', 'volume', 20)})) / nullif({full('stddev_samp(volume)', 'volume', 20)}, 0) AS volume_z, volume / nullif({full('avg(volume)', 'volume', 20)}, 0) AS volume_ratio, ln(1 + close * volume) AS log_dollar_volume FROM r_""", "volume_z volume_ratio log_dollar_volume")
def _(spark, d):
    return features.technical(t.names(spark, d), CONFIG).select("date", "symbol", "volume_z", "volume_ratio", "log_dollar_volume")


def _ewm(x: str, alpha: str) -> str:
    """Bias-adjusted exponential mean by power sums over the row number n."""
    w = "OVER (PARTITION BY symbol ORDER BY date)"
    return f"sum(CASE WHEN {x} IS NOT NULL THEN {x} * pow(1 - {alpha}, -n) ELSE 0 END) {w} / nullif(sum(CASE WHEN {x} IS NOT NULL THEN pow(1 - {alpha}, -n) ELSE 0 END) {w}, 0)"


@query("features_rsi", f"""{BARS_SQL}, d_ AS (SELECT *, close - lag(close) {S} AS d, row_number() {S} - 1 AS n FROM bars), g_ AS (SELECT *, greatest(d, 0) + d * 0 AS g, greatest(-d, 0) + d * 0 AS l FROM d_),
  e_ AS (SELECT *, {_ewm('g', '(1.0 / 14)')} AS up, {_ewm('l', '(1.0 / 14)')} AS down, count(d) {S} AS c FROM g_)""", "SELECT date, symbol, CASE WHEN c >= 14 AND down > 0 THEN 1 - 1 / (1 + up / down) END AS rsi FROM e_", "rsi")
def _(spark, d):
    return features.rsi(t.names(spark, d), 14)


@query("features_macd", f"""{BARS_SQL}, d_ AS (SELECT *, row_number() {S} - 1 AS n FROM bars), e_ AS (SELECT *, {_ewm('close', '(2.0 / 13)')} - {_ewm('close', '(2.0 / 27)')} AS m FROM d_), f_ AS (SELECT *, {_ewm('m', '(2.0 / 10)')} AS s FROM e_)""",
       "SELECT date, symbol, m / nullif(close, 0) AS macd, s / nullif(close, 0) AS macd_signal, (m - s) / nullif(close, 0) AS macd_hist FROM f_", "macd macd_signal macd_hist")
def _(spark, d):
    return features.macd(t.names(spark, d))


@query("features_beta", f"""{TECH}, b_ AS (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS b FROM panel WHERE symbol = 'BENCH'),
  j_ AS (SELECT r_.date, symbol, CASE WHEN b IS NOT NULL THEN r END AS x, CASE WHEN r IS NOT NULL THEN b END AS y FROM r_ LEFT JOIN b_ ON b_.date = r_.date)""",
       f"""SELECT date, symbol, CASE WHEN count(x) {rows(20)} >= 20 AND var_samp(y) {rows(20)} > 0 THEN covar_samp(x, y) {rows(20)} / var_samp(y) {rows(20)} END AS beta,
  CASE WHEN count(x) {rows(20)} >= 20 AND var_samp(y) {rows(20)} > 0 AND stddev_samp(x) {rows(20)} > 0 THEN covar_samp(x, y) {rows(20)} / sqrt(var_samp(y) {rows(20)}) / stddev_samp(x) {rows(20)} END AS benchmark_corr FROM j_""", "beta benchmark_corr")
def _(spark, d):
    return features.benchmark_features(t.names(spark, d), t.bench(spark, d), 20)


REGIME = f"""{BARS_SQL}, q_ AS (SELECT *, close / nullif(lag(close) {S}, 0) - 1 AS r FROM panel WHERE symbol = 'BENCH'),
  v_ AS (SELECT date, symbol, r AS bench_ret, ({full('stddev_samp(r)', 'r', 20)}) * {YEAR} AS bench_vol, ({full('avg(close)', 'close', 10)}) / nullif({full('avg(close)', 'close', 30)}, 0) - 1 AS bench_trend, row_number() {S} AS n FROM q_),
  p_ AS (SELECT a.date, (count(*) FILTER (b.bench_vol < a.bench_vol) + (count(*) FILTER (b.bench_vol = a.bench_vol) + 1) / 2.0) / count(*) AS p, count(*) AS c FROM v_ a JOIN v_ b ON b.n <= a.n WHERE a.bench_vol IS NOT NULL AND b.bench_vol IS NOT NULL GROUP BY a.date),
  regime AS (SELECT v_.date, bench_ret, bench_vol, CASE WHEN c >= 60 THEN p END AS vol_percentile, bench_trend, CASE WHEN c >= 60 AND p > 0.75 THEN 1.0 ELSE 0.0 END AS high_vol_regime FROM v_ LEFT JOIN p_ ON p_.date = v_.date)"""


@query("market_regime", REGIME, "SELECT * FROM regime", "bench_ret bench_vol vol_percentile bench_trend high_vol_regime")
def _(spark, d):
    return features.market_regime(cut(t.bench(spark, d), "benchmark"), 20, 10, 30)


@query("features_cross_section", TECH, f"SELECT date, symbol, {pct('r', 'date')} AS ret_1_rank, {pct('r5', 'date')} AS ret_5_rank FROM r_", "ret_1_rank ret_5_rank")
def _(spark, d):
    f = t.names(spark, d).withColumns({"ret_1": features.k_return(1), "ret_5": features.k_return(5)})
    return features.cross_sectional(features.finite(f, ["ret_1", "ret_5"]), ["ret_1", "ret_5"]).select("date", "symbol", "ret_1_rank", "ret_5_rank")


_PARTS = {"a_": "features_returns", "l_": "features_levels", "v_": "features_volume", "s_": "features_rsi", "m_": "features_macd", "b_": "features_beta", "g_": "market_regime"}
_OWN = "ret_1 ret_5 ret_20 log_ret vol_5 vol_20 momentum_5 momentum_20 ma_ratio_5 ma_ratio_20 bollinger_z drawdown rolling_sharpe mean_reversion_z volume_z volume_ratio log_dollar_volume rsi macd macd_signal macd_hist beta benchmark_corr bench_ret bench_vol vol_percentile bench_trend high_vol_regime"
_RANKS = ["ret_1", "ret_5", "vol_20", "momentum_20", "volume_z"]


@query("feature_panel", ", ".join(f"{k} AS ({_RAW[q]})" for k, q in _PARTS.items()) + """, j_ AS (SELECT a_.*, a_.ret_20 AS momentum_20, l_.* EXCLUDE (date, symbol), v_.* EXCLUDE (date, symbol), s_.rsi, m_.* EXCLUDE (date, symbol), b_.* EXCLUDE (date, symbol), g_.* EXCLUDE (date)
  FROM a_ JOIN l_ USING (date, symbol) JOIN v_ USING (date, symbol) JOIN s_ USING (date, symbol) JOIN m_ USING (date, symbol) JOIN b_ USING (date, symbol) LEFT JOIN g_ USING (date))""",
       f"SELECT date, symbol, {', '.join(_OWN.split())}, {', '.join(f'{pct(c, 'date')} AS {c}_rank' for c in _RANKS)} FROM j_", f"{_OWN} {' '.join(f'{c}_rank' for c in _RANKS)}")
def _(spark, d):
    return features.build_features(t.once(spark, d), BENCHMARK, CONFIG)


@query("scaled_features", f"{TECH}, f_ AS (SELECT avg(r) AS m, stddev_samp(r) AS s, avg(r5) AS m5, stddev_samp(r5) AS s5 FROM r_ WHERE date < DATE '1997-01-01')",
       "SELECT date, symbol, greatest(least((r - m) / s, 5), -5) + 0 * r AS ret_1, greatest(least((r5 - m5) / s5, 5), -5) + 0 * r5 AS ret_5 FROM r_, f_ WHERE date >= DATE '1997-01-01'", "ret_1 ret_5")
def _(spark, d):
    f = t.names(spark, d).select("date", "symbol", features.k_return(1).alias("ret_1"), features.k_return(5).alias("ret_5"))
    fitted = features.fit_scaler(f.filter("date < '1997-01-01'"), ["ret_1", "ret_5"])
    return features.apply_scaler(f.filter("date >= '1997-01-01'"), fitted, ["ret_1", "ret_5"])


@query("sequence_windows", TECH, f"""SELECT date, symbol, coalesce(r, 0) + coalesce(lag(r) {S}, 0) + coalesce(lag(r, 2) {S}, 0) + coalesce(lag(r, 3) {S}, 0) AS total, 4 AS length FROM r_ QUALIFY row_number() {S} >= 4""", "total")
def _(spark, d):
    s = features.sequences(t.names(spark, d).withColumn("ret_1", features.k_return(1)), ["ret_1"], 4)
    return s.select("date", "symbol", F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]).alias("total"), F.size("window").alias("length"))


LABELS = f"""{BARS_SQL}, l0_ AS (SELECT *, close / nullif(lag(close) {S}, 0) - 1 AS r, row_number() {S} AS n FROM panel WHERE symbol <> 'BENCH'),
  l1_ AS (SELECT *, {full('stddev_samp(r)', 'r', 5)} AS v, lead(close, 1) {S} / nullif(close, 0) - 1 AS f1, lead(close, 5) {S} / nullif(close, 0) - 1 AS f5,
    CASE WHEN n >= 5 AND count(r) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END AS fv5 FROM l0_),
  lb_ AS (SELECT date, lead(close, 1) OVER (ORDER BY date) / nullif(close, 0) - 1 AS b1, lead(close, 5) OVER (ORDER BY date) / nullif(close, 0) - 1 AS b5 FROM panel WHERE symbol = 'BENCH'),
  labels_ AS (SELECT l.date, l.symbol, f1 AS fwd_ret_1, CASE WHEN f1 > 0 THEN 1.0 WHEN f1 <= 0 THEN 0.0 END AS fwd_dir_1, f1 / nullif(v, 0) AS fwd_ret_1_voladj, CAST(NULL AS DOUBLE) AS fwd_vol_1, f5 AS fwd_ret_5, CASE WHEN f5 > 0 THEN 1.0 WHEN f5 <= 0 THEN 0.0 END AS fwd_dir_5,
    f5 / nullif(v, 0) AS fwd_ret_5_voladj, fv5 AS fwd_vol_5, f1 - b1 AS fwd_excess_1, f5 - b5 AS fwd_excess_5, {pct('f1', 'l.date')} AS fwd_rank_1, {pct('f5', 'l.date')} AS fwd_rank_5 FROM l1_ l LEFT JOIN lb_ ON lb_.date = l.date)"""


@query("labels_forward", LABELS, "SELECT * FROM labels_", "fwd_ret_1 fwd_dir_1 fwd_ret_1_voladj fwd_vol_1 fwd_ret_5 fwd_dir_5 fwd_ret_5_voladj fwd_vol_5 fwd_excess_1 fwd_excess_5 fwd_rank_1 fwd_rank_5")
def _(spark, d):
    return t.labels(spark, d)


# --- splits, models ------------------------------------------------------------------------------------------------------


DAYS = f"{BARS_SQL}, days_ AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"
WINDOWS = f"""{DAYS}, w_ AS (SELECT CAST(i AS INTEGER) AS window_id, 105 + 52 * i AS s FROM range(0, 20) r(i) WHERE 105 + 52 * i < (SELECT max(n) FROM days_)),
  windows AS (SELECT window_id, a.date AS train_start, b.date AS train_end, c.date AS test_start, e.date AS test_end FROM w_ JOIN days_ a ON a.idx = greatest(0, s - 105) JOIN days_ b ON b.idx = s - 6 JOIN days_ c ON c.idx = s JOIN days_ e ON e.idx = least(s + 51, e.n - 1))"""


def windows(spark, d):
    return splits.walk_forward(t.names(spark, d).select("date"), min_train=100, test=52, step=52, embargo=5, scheme="rolling", max_horizon=5)


@query("walk_forward_windows", WINDOWS, "SELECT * FROM windows")
def _(spark, d):
    return windows(spark, d)


@query("walk_forward_rows", f"{WINDOWS}, p_ AS (SELECT * FROM bars)", "SELECT window_id, CASE WHEN date BETWEEN train_start AND train_end THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM bars JOIN windows ON date BETWEEN train_start AND train_end OR date BETWEEN test_start AND test_end GROUP BY 1, 2")
def _(spark, d):
    own = t.names(spark, d, t.once(spark, d)).select("date", "symbol")
    w = splits.walk_forward(own, min_train=100, test=52, step=52, embargo=5, scheme="rolling", max_horizon=5)
    return splits.assign(own, w).groupBy("window_id", "role").agg(F.count("*").alias("n"))


FOLDS = f"{DAYS}, f_ AS (SELECT date, idx, ntile(5) OVER (ORDER BY idx) - 1 AS fold FROM days_), b_ AS (SELECT fold, min(idx) AS lo, max(idx) AS hi FROM f_ GROUP BY fold)"


@query("purged_kfold", FOLDS, "SELECT CAST(b_.fold AS INTEGER) AS fold, f_.date, CASE WHEN idx BETWEEN lo AND hi THEN 'test' ELSE 'train' END AS role FROM f_, b_ WHERE idx BETWEEN lo AND hi OR NOT idx BETWEEN lo - 4 AND hi + 4 + 2")
def _(spark, d):
    return splits.purged_kfold(t.names(spark, d).select("date"), 5, purge=4, embargo=2)


@query("combinatorial_cv", f"""{FOLDS}, c_ AS (SELECT row_number() OVER (ORDER BY a.fold, b.fold) - 1 AS split_id, a.fold AS x, b.fold AS y FROM b_ a JOIN b_ b ON a.fold < b.fold),
  n_ AS (SELECT split_id, x || ',' || y AS test_groups, date, max(CASE WHEN b_.fold IN (x, y) AND idx BETWEEN lo AND hi THEN 2 WHEN b_.fold IN (x, y) AND idx BETWEEN lo - 4 AND hi + 6 THEN 1 ELSE 0 END) AS k FROM c_, f_, b_ GROUP BY 1, 2, 3)""",
       "SELECT split_id, test_groups, CASE k WHEN 2 THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM n_ WHERE k <> 1 GROUP BY 1, 2, 3")
def _(spark, d):
    c = splits.combinatorial(t.names(spark, d).select("date"), 5, 2, purge=4, embargo=2)
    return c.groupBy(F.col("split_id").cast("long").alias("split_id"), "test_groups", "role").agg(F.count("*").alias("n"))


@query("development_cutoff", DAYS, "SELECT date AS cutoff FROM days_ WHERE idx = (SELECT min(idx) FROM days_ WHERE date >= DATE '1997-06-01') - 6")
def _(spark, d):
    return splits.development_cutoff(t.names(spark, d).select("date"), "1997-06-01", 5)


@query("fraction_split", DAYS, "SELECT date, CASE WHEN idx < floor(n * 0.7) THEN 'train' WHEN idx < floor(n * 0.7) + 5 THEN 'embargo' ELSE 'test' END AS role FROM days_")
def _(spark, d):
    return splits.fractions(t.names(spark, d).select("date"), 0.7, 5)


@query("baseline_mean", f"{WINDOWS}, s_ AS (SELECT date, symbol, lead(close, 5) {S} / close - 1 AS target FROM bars)",
       """SELECT s.date, s.symbol, w.window_id, (SELECT avg(target) FROM s_ q WHERE q.date BETWEEN w.train_start AND w.train_end) AS prediction FROM s_ s JOIN windows w ON s.date BETWEEN w.test_start AND w.test_end WHERE target IS NOT NULL""", "prediction")
def _(spark, d):
    rows_ = t.names(spark, d).select("date", "symbol", (F.lead("close", 5).over(by_symbol()) / F.col("close") - 1).alias("target")).filter("target is not null")
    return models.historical_mean(splits.assign(rows_, windows(spark, d))).select("date", "symbol", "window_id", "prediction")


@query("supervised_momentum", f"{BARS_SQL}, m_ AS (SELECT date, symbol, close / nullif(lag(close, 5) {S}, 0) - 1 AS m, lead(close, 5) {S} / nullif(close, 0) - 1 AS target FROM bars)", "SELECT date, symbol, target, 0.5 * coalesce(m, 0) AS prediction FROM m_", "target prediction")
def _(spark, d):
    f = t.names(spark, d).select("date", "symbol", features.k_return(5).alias("momentum_5"))
    s = models.supervised(f, build_labels(t.names(spark, d), None, (5,), 5), "fwd_ret_5")
    return models.momentum_baseline(s, "momentum_5", 0.5).select("date", "symbol", "target", "prediction")


@query("ensemble_of_two", f"""{PRED}, v_ AS (SELECT model, corr(rp, rt) AS ic FROM (SELECT model, {avg_rank('prediction', 'model')} AS rp, {avg_rank('target', 'model')} AS rt FROM pred WHERE date < DATE '1997-01-01') GROUP BY model),
  w_ AS (SELECT model, (greatest(ic, 0) + 0.05) / sum(greatest(ic, 0) + 0.05) OVER () AS w FROM v_)""", "SELECT date, symbol, sum(w * prediction) AS prediction FROM pred JOIN w_ USING (model) WHERE date >= DATE '1997-01-01' GROUP BY date, symbol", "prediction")
def _(spark, d):
    p = t.predictions(spark, d)
    w = models.ic_weights(p.filter("date < '1997-01-01'"), 0.05)
    return models.combine(p.filter("date >= '1997-01-01'"), w).select("date", "symbol", "prediction")


MODEL_FEATURES = ["ret_1", "ret_5", "momentum_20", "vol_5", "volume_z"]


TWO = ["ret_1", "ret_5"]


def _fitted_sql(windows: str, models: dict[str, str]) -> str:
    """CTEs up to fits_ and pred_: models (name to penalty on the diagonal, given n) by normal equations over two standardized features with
    medians for missing values. windows: roles_ (window_id, date, role) in SQL."""
    one = lambda x: f"(coalesce({x}, m_{x}) - a_{x}) / s_{x}"
    solved = " UNION ALL ".join(
        f"SELECT window_id, '{name}' AS model, y, ((g22 + {l2}) * h1 - g12 * h2) / ((g11 + {l2}) * (g22 + {l2}) - g12 * g12) AS w1, ((g11 + {l2}) * h2 - g12 * h1) / ((g11 + {l2}) * (g22 + {l2}) - g12 * g12) AS w2 FROM gram_" for name, l2 in models.items())
    return f"""{windows}, rows_ AS (SELECT date, symbol, r, r5, lead(close, 5) {S} / nullif(close, 0) - 1 AS target FROM r_),
all_ AS (SELECT x.*, window_id, role FROM rows_ x JOIN roles_ USING (date) WHERE target IS NOT NULL), train_ AS (SELECT * FROM all_ WHERE role = 'train'),
med_ AS (SELECT window_id, coalesce(median(r), 0) AS m_r, coalesce(median(r5), 0) AS m_r5 FROM train_ GROUP BY window_id),
std_ AS (SELECT window_id, m_r, m_r5, avg(coalesce(r, m_r)) AS a_r, stddev_pop(coalesce(r, m_r)) AS s_r, avg(coalesce(r5, m_r5)) AS a_r5, stddev_pop(coalesce(r5, m_r5)) AS s_r5, avg(target) AS y FROM train_ JOIN med_ USING (window_id) GROUP BY ALL),
gram_ AS (SELECT window_id, y, count(*) AS n, avg({one('r')} * {one('r')}) AS g11, avg({one('r')} * {one('r5')}) AS g12, avg({one('r5')} * {one('r5')}) AS g22, avg({one('r')} * (target - y)) AS h1, avg({one('r5')} * (target - y)) AS h2 FROM train_ JOIN std_ USING (window_id) GROUP BY ALL),
fits_ AS ({solved}),
pred_ AS (SELECT date, symbol, window_id, model, target, f.y + {one('r')} * w1 + {one('r5')} * w2 AS prediction FROM all_ JOIN std_ s USING (window_id) JOIN fits_ f USING (window_id) WHERE role = 'test')"""


def _metrics_sql(by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, avg((target - prediction) ** 2) AS mse, avg(abs(target - prediction)) AS mae, 1 - sum((target - prediction) ** 2) / (var_pop(target) * count(*)) AS r2,
  avg(CASE WHEN sign(target) = sign(prediction) THEN 1.0 ELSE 0.0 END) AS directional_accuracy, corr(prediction, target) AS ic, corr(rp, rt) AS rank_ic
  FROM (SELECT *, {avg_rank('prediction', by)} AS rp, {avg_rank('target', by)} AS rt FROM pred_) GROUP BY {by}"""


MODEL_DAYS = "days_ AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"
EXPANDING = f"""{TECH}, {MODEL_DAYS}, w_ AS (SELECT CAST(i AS INTEGER) AS window_id, 155 + 100 * i AS s FROM range(0, 20) r(i) WHERE 155 + 100 * i < (SELECT max(n) FROM days_)),
roles_ AS (SELECT window_id, date, CASE WHEN idx < s THEN 'train' ELSE 'test' END AS role FROM days_, w_ WHERE idx <= s - 6 OR idx BETWEEN s AND s + 99)"""
THREE = f"""{TECH}, {MODEL_DAYS}, f_ AS (SELECT date, idx, ntile(3) OVER (ORDER BY idx) - 1 AS fold FROM days_), b_ AS (SELECT fold, min(idx) AS lo, max(idx) AS hi FROM f_ GROUP BY fold),
roles_ AS (SELECT CAST(b_.fold AS INTEGER) AS window_id, f_.date, CASE WHEN idx BETWEEN lo AND hi THEN 'test' ELSE 'train' END AS role FROM f_, b_ WHERE idx BETWEEN lo AND hi OR NOT idx BETWEEN lo - 5 AND hi + 5 + 2)"""


def _expanding(own: DataFrame) -> DataFrame:
    return splits.walk_forward(own.select("date"), min_train=150, test=100, step=100, embargo=5, max_horizon=5)


def _modelled(own: DataFrame, columns: list[str]) -> DataFrame:
    f = features.technical(own, CONFIG).select("date", "symbol", *columns)
    return cut(models.supervised(f, build_labels(own, None, (5,), 5), "fwd_ret_5"), "modelled")


@query("walk_forward_models", _fitted_sql(EXPANDING, {"linear": "0", "ridge": "10.0 / n"}), _metrics_sql("model, window_id"), "mse mae r2 directional_accuracy ic rank_ic")
def _(spark, d):
    own = t.names(spark, d, t.once(spark, d))
    p, _ = models.run_walk_forward(_modelled(own, TWO), _expanding(own), {"linear": {}, "ridge": {"alpha": 10.0}}, TWO)
    return evaluate.regression_metrics(p, ["model", "window_id"])


@query("purged_cv_models", _fitted_sql(THREE, {"linear": "0"}), f"SELECT * EXCLUDE (window_id), window_id AS fold FROM ({_metrics_sql('model, window_id')})", "mse mae r2 directional_accuracy ic rank_ic")
def _(spark, d):
    own = t.names(spark, d, t.once(spark, d))
    folds = splits.purged_kfold(own.select("date"), 3, purge=5, embargo=2)
    return evaluate.regression_metrics(models.run_purged_cv(_modelled(own, TWO), folds, {"linear": {}}, TWO), ["model", "fold"])


@query("model_importances", _fitted_sql(EXPANDING, {"linear": "0", "ridge": "10.0 / n"}), "SELECT model, window_id, 'ret_1' AS feature, abs(w1) AS importance FROM fits_ UNION ALL SELECT model, window_id, 'ret_5', abs(w2) FROM fits_", "importance")
def _(spark, d):
    own = t.names(spark, d, t.once(spark, d))
    _, w = models.run_walk_forward(_modelled(own, TWO), _expanding(own), {"linear": {}, "ridge": {"alpha": 10.0}}, TWO)
    return w


@query("walk_forward_ensembles")
def _(spark, d):
    own = t.names(spark, d, t.once(spark, d))
    p, _ = models.run_walk_forward(_modelled(own, MODEL_FEATURES), _expanding(own), {"ridge": {"alpha": 10.0}, "elastic_net": {"alpha": 0.001}, "random_forest": {}, "ensemble": {"members": {"ridge": {}, "elastic_net": {}}}}, MODEL_FEATURES)
    return evaluate.regression_metrics(p, ["model", "window_id"])


@query("walk_forward_boosting")
def _(spark, d):
    own = t.names(spark, d, t.once(spark, d))
    p, w = models.run_walk_forward(_modelled(own, MODEL_FEATURES), _expanding(own), {"gradient_boosting": {"rounds": 10, "rate": 0.2}}, MODEL_FEATURES)
    return evaluate.regression_metrics(p, ["model", "window_id"]).join(w.groupBy("model", "window_id").agg(F.max_by("feature", "importance").alias("leading_feature")).hint("merge"), ["model", "window_id"])


@query("baseline_zero", f"{WINDOWS}, rows_ AS (SELECT date, lead(close, 5) {S} / nullif(close, 0) - 1 AS target FROM bars)",
       "SELECT window_id, count(*) AS n, avg(target ** 2) AS mse, avg(abs(target)) AS mae FROM rows_ JOIN windows ON date BETWEEN test_start AND test_end WHERE target IS NOT NULL GROUP BY window_id", "mse mae")
def _(spark, d):
    own = t.names(spark, d, t.once(spark, d))
    w = splits.walk_forward(own.select("date"), min_train=100, test=52, step=52, embargo=5, scheme="rolling", max_horizon=5)
    rows = build_labels(own, None, (5,), 5).select("date", "symbol", F.col("fwd_ret_5").alias("target")).filter("target is not null")
    return evaluate.regression_metrics(models.zero_baseline(splits.assign(rows, w).filter("role = 'test'")), ["window_id"]).select("window_id", "n", "mse", "mae")


# --- evaluation --------------------------------------------------------------------------------------------------------------


METRICS = f"""SELECT model, count(*) AS n, avg((target - prediction) ** 2) AS mse, avg(abs(target - prediction)) AS mae, 1 - sum((target - prediction) ** 2) / (var_pop(target) * count(*)) AS r2,
  avg(CASE WHEN sign(target) = sign(prediction) THEN 1.0 ELSE 0.0 END) AS directional_accuracy, corr(prediction, target) AS ic, corr(rp, rt) AS rank_ic
  FROM (SELECT *, {avg_rank('prediction', 'model')} AS rp, {avg_rank('target', 'model')} AS rt FROM pred) GROUP BY model"""


@query("regression_metrics", PRED, METRICS, "mse mae r2 directional_accuracy ic rank_ic")
def _(spark, d):
    return evaluate.regression_metrics(t.predictions(spark, d), ["model"])


@query("candidate", PRED, f"SELECT model, rank_ic, mae FROM ({METRICS}) ORDER BY rank_ic DESC, mae, model LIMIT 1", "rank_ic mae")
def _(spark, d):
    return evaluate.select_candidate(evaluate.regression_metrics(t.predictions(spark, d), ["model"]))


@query("selected_model", f"{PRED}, all_ AS (SELECT * REPLACE (CASE model WHEN 'momentum' THEN 'ridge' ELSE 'gradient_boosting' END AS model) FROM pred UNION ALL SELECT date, symbol, 'baseline_mean', 0, target FROM pred WHERE model = 'momentum' AND date < DATE '1995-01-01')",
       """SELECT model, count(*) AS n FROM all_ WHERE model = (SELECT model FROM (SELECT DISTINCT model FROM all_) ORDER BY CASE model WHEN 'ensemble' THEN 0 WHEN 'gradient_boosting' THEN 1 WHEN 'ridge' THEN 2 ELSE 3 END, model LIMIT 1) GROUP BY model""")
def _(spark, d):
    p = t.predictions(spark, d)
    named = p.withColumn("model", F.when(F.col("model") == "momentum", "ridge").otherwise("gradient_boosting"))
    mean = p.filter("model = 'momentum' and date < '1995-01-01'").withColumns({"model": F.lit("baseline_mean"), "prediction": F.lit(0.0)})
    return signals.select_model(named.unionByName(mean)).groupBy("model").agg(F.count("*").alias("n"))


# ranks doubled and centred are whole numbers: a correlation of zero is exactly zero on both sides
ICS = f"""{PRED}, i_ AS (SELECT *, 2 * {avg_rank('prediction', 'model, date')} - count(*) OVER (PARTITION BY model, date) - 1 AS rp, 2 * {avg_rank('target', 'model, date')} - count(*) OVER (PARTITION BY model, date) - 1 AS rt FROM pred),
  ics AS (SELECT model, date, count(*) AS n, CASE WHEN stddev_pop(prediction) > 0 AND stddev_pop(target) > 0 THEN corr(prediction, target) END AS ic, CASE WHEN sum(rp * rp) > 0 AND sum(rt * rt) > 0 THEN sum(rp * rt) / (sqrt(sum(rp * rp)) * sqrt(sum(rt * rt))) END AS rank_ic FROM i_ GROUP BY model, date)"""


@query("ic_by_date", ICS, "SELECT * FROM ics", "ic rank_ic")
def _(spark, d):
    return evaluate.ic_by_date(t.predictions(spark, d))


def _nw(source: str, value: str, by: str) -> str:
    """CTEs that end in nw_(by, n, mean, t_stat)."""
    return f"""nw0_ AS (SELECT {by} AS k, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY date) AS rn, count(*) OVER (PARTITION BY {by}) AS n, avg({value}) OVER (PARTITION BY {by}) AS m FROM {source} WHERE {value} IS NOT NULL),
  nw1_ AS (SELECT *, v - m AS e, greatest(0, least(floor(4 * pow(n / 100.0, 2.0 / 9)), n - 2)) AS lags FROM nw0_),
  nw2_ AS (SELECT a.k, b.rn - a.rn AS lag, avg(a.e * b.e) * 2 * (1 - (b.rn - a.rn) / (first(a.lags) + 1)) AS g FROM nw1_ a JOIN nw1_ b ON a.k = b.k AND b.rn > a.rn AND b.rn - a.rn <= a.lags GROUP BY a.k, b.rn - a.rn),
  nw_ AS (SELECT k, n, mean, CASE WHEN n > 2 AND g0 + gs > 0 THEN mean / sqrt((g0 + gs) / n) END AS t_stat FROM (SELECT k, first(n) AS n, first(m) AS mean, avg(e * e) AS g0, coalesce((SELECT sum(g) FROM nw2_ WHERE nw2_.k = nw1_.k), 0) AS gs FROM nw1_ GROUP BY k))"""


@query("ic_summary", f"{ICS}, {_nw('ics', 'rank_ic', 'model')}", """SELECT model, count(*) AS n_dates, avg(rank_ic) AS mean_ic, stddev_samp(rank_ic) AS std_ic, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_share,
  (SELECT t_stat FROM nw_ WHERE k = model) AS t_stat, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS icir FROM ics WHERE rank_ic IS NOT NULL GROUP BY model""", "mean_ic std_ic positive_share t_stat icir")
def _(spark, d):
    return evaluate.ic_summary(evaluate.ic_by_date(t.predictions(spark, d)))


@query("ic_decay", f"""{PRED}, fw_ AS (SELECT date, symbol, lead(close, 1) {S} / nullif(close, 0) - 1 AS f1, lead(close, 5) {S} / nullif(close, 0) - 1 AS f5 FROM bars),
  lg_ AS (SELECT p.model || '|1' AS model, p.date, prediction, f1 AS target FROM pred p JOIN fw_ USING (date, symbol) UNION ALL SELECT p.model || '|5', p.date, prediction, f5 FROM pred p JOIN fw_ USING (date, symbol)),
  rk_ AS (SELECT model, date, {avg_rank('prediction', 'model, date')} AS rp, {avg_rank('target', 'model, date')} AS rt FROM lg_ WHERE target IS NOT NULL),
  dc_ AS (SELECT model, date, CASE WHEN stddev_pop(rp) > 0 AND stddev_pop(rt) > 0 THEN corr(rp, rt) END AS rank_ic FROM rk_ GROUP BY model, date HAVING count(*) >= 3), {_nw('dc_', 'rank_ic', 'model')}""",
       "SELECT split_part(k, '|', 1) AS model, CAST(split_part(k, '|', 2) AS INTEGER) AS horizon, n AS n_dates, mean AS mean_ic, t_stat FROM nw_", "mean_ic t_stat")
def _(spark, d):
    return evaluate.ic_decay(t.predictions(spark, d), build_labels(t.names(spark, d), None, (1, 5), 5), [1, 5])


@query("ic_matrix", ICS, "SELECT date, model, rank_ic AS ic FROM ics WHERE rank_ic IS NOT NULL AND date IN (SELECT date FROM ics WHERE rank_ic IS NOT NULL GROUP BY date HAVING count(*) = 2)", "ic")
def _(spark, d):
    return evaluate.ic_matrix(evaluate.ic_by_date(t.predictions(spark, d)))


@query("rolling_ic", ICS, "SELECT model, date, CASE WHEN count(rank_ic) OVER w >= 21 THEN avg(rank_ic) OVER w END AS rolling_ic FROM ics WINDOW w AS (PARTITION BY model ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)", "rolling_ic")
def _(spark, d):
    return evaluate.rolling_ic(evaluate.ic_by_date(t.predictions(spark, d)))


@query("quantile_returns", f"""{PRED}, e_ AS (SELECT date, list_distinct(quantile_cont(prediction, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM pred WHERE model = 'momentum' GROUP BY date HAVING count(DISTINCT prediction) >= 2)""",
       "SELECT CAST(greatest(len(list_filter(edges, lambda x: x < prediction)), 1) AS INTEGER) AS quantile, avg(target) AS mean_target, median(target) AS median_target, count(*) AS n FROM pred JOIN e_ USING (date) WHERE model = 'momentum' GROUP BY 1", "mean_target median_target")
def _(spark, d):
    return evaluate.quantile_returns(t.one_model(spark, d))


@query("prediction_density", PRED, """SELECT CAST(floor((least(greatest(prediction, -1), 1 - 1e-12) + 1) / 2 * 20) AS INTEGER) AS bin_x, CAST(floor((least(greatest(target, -1), 1 - 1e-12) + 1) / 2 * 20) AS INTEGER) AS bin_y, count(*) AS n FROM pred GROUP BY 1, 2""")
def _(spark, d):
    return evaluate.density(t.predictions(spark, d), "prediction", "target", -1.0, 1.0, 20)


@query("feature_correlations", TECH, "SELECT 'ret_1' AS a, 'ret_5' AS b, corr(r, r5) AS corr FROM r_ UNION ALL SELECT 'ret_1', 'volume', corr(r, volume) FROM r_ UNION ALL SELECT 'ret_5', 'volume', corr(r5, volume) FROM r_", "corr")
def _(spark, d):
    return evaluate.correlations(t.names(spark, d).withColumns({"ret_1": features.k_return(1), "ret_5": features.k_return(5)}), ["ret_1", "ret_5", "volume"])


# block b is bit 15 - b, so that larger numbers are earlier choices
_COMBOS = """c_ AS (SELECT combo, block, mask >> (15 - block) & 1 = 1 AS inside FROM (SELECT * FROM (SELECT mask, row_number() OVER (ORDER BY mask DESC) - 1 AS combo FROM range(65536) m(mask) WHERE bit_count(mask) = 8) ORDER BY md5('7|' || combo), combo LIMIT 2000), range(16) b(block))"""


@query("overfitting_probability", f"""{BARS_SQL}, s_ AS (SELECT date, symbol AS strategy, close / nullif(lag(close) {S}, 0) - 1 AS r FROM bars), k_ AS (SELECT date FROM s_ WHERE r IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)),
  d_ AS (SELECT date, ntile(16) OVER (ORDER BY date) - 1 AS block FROM k_), {_COMBOS}, p_ AS (SELECT block, strategy, count(*) AS n, sum(r) AS s, sum(r * r) AS ss FROM s_ JOIN d_ USING (date) GROUP BY 1, 2),
  h_ AS (SELECT combo, strategy, inside, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM p_ JOIN c_ USING (block) GROUP BY 1, 2, 3),
  x_ AS (SELECT combo, strategy, inside, (s / n) / sqrt(greatest(ss / n - (s / n) ** 2, 1e-18)) AS q FROM h_),
  b_ AS (SELECT combo, strategy, max(q) FILTER (inside) AS i, max(q) FILTER (NOT inside) AS o FROM x_ GROUP BY 1, 2),
  w_ AS (SELECT combo, row_number() OVER (PARTITION BY combo ORDER BY i DESC, strategy) AS best, count(*) OVER (PARTITION BY combo ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank, count(*) OVER (PARTITION BY combo) AS k FROM b_),
  g_ AS (SELECT ln((rank / (k + 1)) / (1 - rank / (k + 1))) AS logit FROM w_ WHERE best = 1)""", "SELECT count(*) AS combinations, avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END) AS pbo, avg(logit) AS mean_logit FROM g_", "pbo mean_logit")
def _(spark, d):
    r = t.names(spark, d).select("date", F.col("symbol").alias("strategy"), features.k_return(1).alias("r"))
    n = r.agg(F.count_distinct("strategy").alias("k"))
    whole = r.filter("r is not null").groupBy("date").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).filter("c = k").select("date")
    return evaluate.overfitting_probability(r.join(whole.hint("merge"), "date"), 16, 2000)


def _cdf(x: str) -> str:
    """The normal distribution as evaluate.normal_cdf computes it."""
    horner = lambda c: functools.reduce(lambda acc, k: f"({acc} * abs({x}) + {k})", c[1:], str(c[0]))
    far = functools.reduce(lambda acc, k: f"(abs({x}) + {k} / {acc})", (4, 3, 2, 1), f"(abs({x}) + 0.65)")
    tail = f"exp(-abs({x}) * abs({x}) / 2) * CASE WHEN abs({x}) < 7.07106781186547 THEN {horner(evaluate._TOP)} / {horner(evaluate._LOW)} ELSE 1 / ({far} * 2.506628274631) END"
    return f"CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END"


@query("deflated_sharpe", f"""{TECH}, m0_ AS (SELECT symbol, r, avg(r) OVER (PARTITION BY symbol) AS m FROM r_ WHERE r IS NOT NULL),
  m1_ AS (SELECT symbol, count(*) AS n, first(m) AS m, stddev_samp(r) AS s, avg((r - m) ** 3) / pow(var_pop(r), 1.5) AS g3, avg((r - m) ** 4) / var_pop(r) ** 2 AS g4 FROM m0_ GROUP BY symbol),
  m2_ AS (SELECT *, m / nullif(s, 0) AS sharpe, sqrt(1.0 / (n - 1)) * {evaluate.expected_max_sharpe(25, 1.0)} AS threshold FROM m1_),
  m3_ AS (SELECT *, sqrt(n - 1) / sqrt(1 - g3 * sharpe + (g4 - 1) / 4 * sharpe ** 2) AS unit FROM m2_), m4_ AS (SELECT *, sharpe * unit AS z0, (sharpe - threshold) * unit AS z1 FROM m3_)""",
       f"SELECT symbol, n, sharpe, sharpe * {YEAR} AS annual_sharpe, threshold, {_cdf('z0')} AS psr, {_cdf('z1')} AS deflated_sharpe_prob FROM m4_", "sharpe annual_sharpe threshold psr deflated_sharpe_prob")
def _(spark, d):
    r = t.names(spark, d).select("symbol", features.k_return(1).alias("r")).filter("r is not null")
    return evaluate.deflated_sharpe(r, ["symbol"], 25)


@query("bootstrap_intervals", f"""{CURVE}, s0_ AS (SELECT "return" AS r, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM curve WHERE "return" IS NOT NULL), n_ AS (SELECT max(n) AS n FROM s0_),
  k_ AS (SELECT k, b, n, CAST('0x' || substr(md5('7|' || k || '|' || b), 1, 8) AS BIGINT) % n AS start FROM n_, range(500) a(k), LATERAL (SELECT unnest(range(CAST(ceil(n / 20.0) AS BIGINT))) AS b)),
  j_ AS (SELECT k, (start + j) % n AS i FROM k_, range(20) c(j) WHERE b * 20 + j < n),
  e_ AS (SELECT k, pow(greatest(product(1 + r), 0), 252.0 / count(*)) - 1 AS a, avg(r) / stddev_samp(r) * {YEAR} AS s FROM j_ JOIN s0_ USING (i) GROUP BY k)""",
       "SELECT " + ", ".join(f"quantile_cont({c}, {q}) AS {name}_{p}" for c, name in (("a", "annual_return"), ("s", "sharpe")) for q, p in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))) + " FROM e_", "annual_return_p05 annual_return_p50 annual_return_p95 sharpe_p05 sharpe_p50 sharpe_p95")
def _(spark, d):
    return evaluate.bootstrap(t.curve(spark, d).select("date", F.col("return").alias("r")), 500, 20)


@query("placebo", f"""{PRED}, x_ AS (SELECT *, row_number() OVER (PARTITION BY model, date ORDER BY symbol) AS own, row_number() OVER (PARTITION BY model, date ORDER BY md5('7|' || date || '|' || symbol), symbol) AS dealt FROM pred)""",
       "SELECT a.date, a.symbol, a.model, b.prediction, a.target FROM x_ a JOIN x_ b ON b.model = a.model AND b.date = a.date AND b.dealt = a.own", "prediction target")
def _(spark, d):
    return evaluate.placebo(t.predictions(spark, d)).select("date", "symbol", "model", "prediction", "target")


@query("trial_ledger")
def _(spark, d):
    m = evaluate.regression_metrics(t.predictions(spark, d), ["model"])
    nr = F.row_number().over(Window.orderBy("model"))
    return evaluate.trial_ledger(m.select(nr.alias("nr"), F.to_json(F.struct("model", "n")).alias("payload")))


# --- signals and weights -----------------------------------------------------------------------------------------------------


def _signal(name, sql, **params):
    @query(f"signals_{name}", f"{PRED}, m_ AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM pred WHERE model = 'momentum')", f"SELECT date, symbol, prediction, {sql} AS signal FROM m_", "prediction signal")
    def _(spark, d):
        return signals.build_signals(t.one_model(spark, d), name, **params)


_D = "PARTITION BY date"
_signal("long_short", f"CASE WHEN n < 2 THEN 0 WHEN row_number() OVER ({_D} ORDER BY prediction, symbol) > n - greatest(1, floor(n * 0.2)) THEN 1 WHEN row_number() OVER ({_D} ORDER BY prediction, symbol) <= greatest(1, floor(n * 0.2)) THEN -1 ELSE 0 END", quantile=0.2)
_signal("long_only_topk", f"CASE WHEN row_number() OVER ({_D} ORDER BY prediction DESC, symbol) <= 5 THEN 1 ELSE 0 END", top_k=5)
_RW = f"({avg_rank('prediction', 'date')} / count(prediction) OVER ({_D}) - 0.5)"
_signal("rank_weighted", f"CASE WHEN min(prediction) OVER ({_D}) < max(prediction) OVER ({_D}) THEN {_RW} / nullif((SELECT sum(abs(c)) FROM (SELECT ({avg_rank('x.prediction', 'x.date')} / count(x.prediction) OVER () - 0.5) AS c FROM m_ x WHERE x.date = m_.date)), 0) ELSE 0 END")
_signal("confidence_weighted", f"CASE WHEN n < 2 OR stddev_pop(prediction) OVER ({_D}) = 0 THEN 0 ELSE greatest(least((prediction - avg(prediction) OVER ({_D})) / stddev_pop(prediction) OVER ({_D}), 2), -2) / 2 END", clip=2.0)
_signal("threshold", "CASE WHEN prediction > 0.1 THEN 1 WHEN prediction < -0.1 THEN -1 ELSE 0 END", threshold=0.1)


@query("regime_filter", f"{REGIME}, {WEIGHTS.replace(BARS_SQL + ',', '')}", "SELECT s.date, symbol, signal * CASE WHEN coalesce(high_vol_regime, 0) <= 0.7 THEN 1 - coalesce(high_vol_regime, 0) ELSE 0 END AS signal FROM sig s LEFT JOIN regime r ON r.date = s.date", "signal")
def _(spark, d):
    return signals.regime_filter(signals.build_signals(t.one_model(spark, d)), features.market_regime(t.bench(spark, d), 20, 10, 30)).select("date", "symbol", "signal")


@query("portfolio_weights", WEIGHTS, "SELECT * FROM weights", "target_weight")
def _(spark, d):
    return t.weights(spark, d)


@query("inverse_vol_weights", f"""{WEIGHTS}, vr_ AS (SELECT *, close / nullif(lag(close) {S}, 0) - 1 AS r FROM bars), vv_ AS (SELECT date, symbol, nullif({full('stddev_samp(r)', 'r', 20)}, 0) * {YEAR} AS vol FROM vr_),
  sv_ AS (SELECT sig.date, sig.symbol, signal / coalesce(vol, median(vol) OVER (PARTITION BY sig.date), 1.0) AS x FROM sig LEFT JOIN vv_ ON vv_.date = sig.date AND vv_.symbol = sig.symbol),
  s2_ AS (SELECT *, sum(greatest(x, 0)) OVER (PARTITION BY date) AS p, -sum(least(x, 0)) OVER (PARTITION BY date) AS m FROM sv_),
  s3_ AS (SELECT *, greatest(least(CASE WHEN p > 0 AND m > 0 THEN CASE WHEN x > 0 THEN x / p WHEN x < 0 THEN x / m ELSE 0 END * 0.5 ELSE coalesce(x / nullif(p + m, 0), 0) END, 0.1), -0.1) AS w FROM s2_)""",
       "SELECT date, symbol, CASE WHEN g > 1 THEN w / g ELSE w END AS target_weight FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY date) AS g FROM s3_)", "target_weight")
def _(spark, d):
    f = features.technical(t.names(spark, d), CONFIG).select("date", "symbol", "vol_20")
    return signals.construct_portfolio(signals.build_signals(t.one_model(spark, d)), f, {"max_weight": 0.1, "max_gross_exposure": 1.0})


@query("turnover_capped_weights")
def _(spark, d):
    return signals.turnover_cap(t.weights(spark, d), 0.3)


# --- ledger --------------------------------------------------------------------------------------------------------------------


@query("decision_targets", FILLS, "SELECT * FROM targets", "target_weight")
def _(spark, d):
    return ledger.decision_targets(cut(t.weights(spark, d), "weights"), t.EVERY)


@query("lagged_inputs", FILLS, "SELECT * FROM inputs", "price adv vol")
def _(spark, d):
    return ledger.lagged_inputs(t.names(spark, d), t.POLICY).withColumnRenamed("open", "price")


@query("fills", FILLS, "SELECT date, symbol, decision_date, status, requested_shares, filled_shares, residual_shares, participation, impact_bps, fill_price, commission, spread_cost, slippage_cost, impact_cost FROM fills", "requested_shares filled_shares residual_shares participation impact_bps fill_price commission spread_cost slippage_cost impact_cost", digits=3)
def _(spark, d):
    return t.fills(spark, d).select("date", "symbol", "decision_date", "status", "requested_shares", "filled_shares", "residual_shares", "participation", "impact_bps", "fill_price", "commission", "spread_cost", "slippage_cost", "impact_cost")


@query("trades", FILLS, f"SELECT date, symbol, filled_shares * fill_price AS notional, filled_shares * fill_price / {CASH} AS trade_weight, commission + spread_cost + slippage_cost + impact_cost AS total_cost FROM fills WHERE filled_shares <> 0", "notional trade_weight total_cost", digits=3)
def _(spark, d):
    return ledger.trades(t.fills(spark, d)).select("date", "symbol", "notional", "trade_weight", "total_cost")


@query("holdings", CURVE, "SELECT v.date, symbol, shares, mark_price, v.market_value, v.market_value / nullif(equity, 0) AS weight FROM values_ v JOIN equity e ON e.date = v.date", "shares mark_price market_value weight", digits=3)
def _(spark, d):
    return t.Books(spark, d).holdings


@query("equity_curve", CURVE, 'SELECT * REPLACE (CAST(active AS INTEGER) AS active) FROM curve', '"return" equity turnover transaction_cost gross_exposure net_exposure benchmark_return', digits=3)
def _(spark, d):
    return t.curve(spark, d).withColumn("active", F.col("active").cast("int"))


ATTRIBUTION = f"""{CURVE}, a0_ AS (SELECT *, coalesce(lag(shares) {S}, 0) AS held, lag(mark_price) {S} AS last FROM values_), a1_ AS (SELECT date, symbol, sum(filled_shares * price - filled_shares * fill_price - commission) AS drag FROM fills GROUP BY date, symbol),
  attr_ AS (SELECT a0_.date, a0_.symbol, held * coalesce(coalesce(open, mark_price) - last, 0) AS overnight_pnl, shares * coalesce(mark_price - coalesce(open, mark_price), 0) AS intraday_pnl, -coalesce(drag, 0) AS trading_cost FROM a0_ LEFT JOIN a1_ ON a1_.date = a0_.date AND a1_.symbol = a0_.symbol)"""


@query("pnl_attribution", ATTRIBUTION, "SELECT *, overnight_pnl + intraday_pnl - trading_cost AS net_pnl FROM attr_", "overnight_pnl intraday_pnl trading_cost net_pnl", digits=3)
def _(spark, d):
    return t.Books(spark, d).attribution()


@query("pnl_by_symbol", ATTRIBUTION, "SELECT symbol, sum(overnight_pnl + intraday_pnl - trading_cost) AS net_pnl, sum(trading_cost) AS trading_cost FROM attr_ GROUP BY symbol", "net_pnl trading_cost", digits=3)
def _(spark, d):
    return t.Books(spark, d).attribution().groupBy("symbol").agg(F.sum("net_pnl").alias("net_pnl"), F.sum("trading_cost").alias("trading_cost"))


RECONCILED = f"""{ATTRIBUTION}, tampered_ AS (SELECT date, CASE WHEN extract('day' FROM date) = 7 THEN 1.5 ELSE 0.0 END AS wrong FROM curve),
  pnl_ AS (SELECT date, sum(overnight_pnl + intraday_pnl - trading_cost) AS pnl FROM attr_ GROUP BY date), gaps_ AS (SELECT b.date, equity, abs(equity - prev - coalesce(pnl, 0) - wrong) AS gap FROM before_ b JOIN tampered_ t ON t.date = b.date LEFT JOIN pnl_ p ON p.date = b.date)"""


@query("reconciliation", RECONCILED, "SELECT date, gap FROM gaps_ WHERE gap > 1e-6 * greatest(1.0, abs(equity))", "gap", digits=3)
def _(spark, d):
    """Attributed P&L against the change of equity, with 1.5 too much on every seventh of a month: those sessions, and no others, are found."""
    at = t.Books(spark, d)
    wrong = at.panel.filter(F.dayofmonth("date") == 7).select("date").distinct().select("date", F.lit("?").alias("symbol"), *[F.lit(0.0).alias(c) for c in ("overnight_pnl", "intraday_pnl", "trading_cost")], F.lit(1.5).alias("net_pnl"))
    return ledger.reconcile(at.attribution().unionByName(wrong), at.equity, CASH).select("date", "gap")


@query("risk_scale", CURVE, """SELECT date, CASE WHEN count("return") OVER w >= 2 AND stddev_samp("return") OVER w > 0 THEN least(0.2 / (stddev_samp("return") OVER w * sqrt(252)), 1.5) ELSE 1 END * CASE WHEN equity / max(equity) OVER (ORDER BY date) - 1 < -0.1 THEN 0.5 ELSE 1 END AS risk_scale
  FROM curve WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "risk_scale")
def _(spark, d):
    return ledger.risk_scale(t.curve(spark, d), vol_target=0.2, drawdown_deleverage=0.1).select("date", "risk_scale")


@query("missing_prices", FILLS, "SELECT DISTINCT t.date, t.symbol FROM targets t WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.date = t.date AND b.symbol = t.symbol AND b.open > 0)")
def _(spark, d):
    p = t.once(spark, d)
    return ledger.missing_prices(ledger.decision_targets(cut(t.weights(spark, d, p), "weights"), t.EVERY), t.names(spark, d, p))


@query("unknown_targets", BARS_SQL, "SELECT 'date' AS kind, CAST(date AS VARCHAR) AS value FROM (SELECT DISTINCT date FROM bars) WHERE date < DATE '1996-06-01' UNION ALL SELECT 'symbol', symbol FROM (SELECT DISTINCT symbol FROM bars) WHERE symbol < 'NATION_12'")
def _(spark, d):
    p = t.names(spark, d)
    return ledger.unknown_targets(p, p.filter("date >= '1996-06-01' and symbol >= 'NATION_12'"))


@query("terminal_liquidation", FILLS, "SELECT date, count(*) AS n, sum(abs(target_weight)) AS gross FROM (SELECT * FROM targets UNION ALL SELECT p.date, s.symbol, 0 FROM (SELECT DISTINCT symbol FROM targets) s, pdays_ p WHERE p.idx = (SELECT idx + 2 FROM pdays_ WHERE date = (SELECT max(date) FROM targets))) GROUP BY date", "gross")
def _(spark, d):
    p = t.once(spark, d)
    targets = cut(ledger.decision_targets(cut(t.weights(spark, d, p), "weights"), t.EVERY), "targets")
    x = ledger.with_liquidation(targets, t.names(spark, d, p), 2)
    return x.groupBy("date").agg(F.count("*").alias("n"), F.sum(F.abs("target_weight")).alias("gross"))


@query("order_view", FILLS, """SELECT date, symbol, CASE WHEN requested_shares > 0 THEN 'buy' WHEN requested_shares < 0 THEN 'sell' ELSE 'flat' END AS side, requested_shares, filled_shares, CASE WHEN filled_shares <> 0 THEN sign(filled_shares) * (fill_price / price - 1) * 1e4 END AS shortfall_bps,
  CASE status WHEN 'filled' THEN 'FILLED' WHEN 'partial' THEN 'PARTIALLY_FILLED' ELSE 'REJECTED' END AS state FROM fills WHERE date IN (SELECT DISTINCT date FROM fills ORDER BY date DESC LIMIT 5)""", "requested_shares filled_shares shortfall_bps")
def _(spark, d):
    return ledger.order_view(t.fills(spark, d), 5)


@query("execution_summary", FILLS, """SELECT count(*) AS orders, sum(abs(filled_shares * price)) / nullif(sum(abs(requested_shares * price)), 0) AS fill_ratio, avg(CASE WHEN status = 'partial' THEN 1.0 ELSE 0.0 END) AS partial_rate, avg(CASE WHEN status = 'rejected' THEN 1.0 ELSE 0.0 END) AS rejected_rate,
  sum(commission) AS commission, sum(spread_cost) AS spread_cost, sum(slippage_cost) AS slippage_cost, sum(impact_cost) AS impact_cost FROM fills""", "fill_ratio partial_rate rejected_rate commission spread_cost slippage_cost impact_cost", digits=3)
def _(spark, d):
    return capacity.execution_summary(t.fills(spark, d))


@query("linear_costs", CURVE, "SELECT date, turnover * 4.0 / 1e4 AS cost FROM curve", "cost")
def _(spark, d):
    return ledger.linear_costs(t.curve(spark, d), t.COSTS).select("date", "cost")


def scenarios(spark):
    return spark.createDataFrame([("base", 4.0, 0.1), ("doubled_costs", 8.0, 0.1), ("halved_participation", 4.0, 0.05), ("no_cap", 4.0, None)], "scenario string, cost_bps double, cap double")


@query("scenario_replay")
def _(spark, d):
    whole = t.once(spark, d)
    p = t.names(spark, d, whole)
    x = ledger.lagged_inputs(p, t.POLICY).select("date", "symbol", "adv").join(p.hint("merge"), ["date", "symbol"])
    targets = ledger.decision_targets(cut(t.weights(spark, d, whole), "weights"), t.EVERY).withColumn("portfolio", F.lit("momentum"))
    return ledger.replay(x.select("date", "symbol", "open", "close", "adv"), targets, scenarios(spark), cash=CASH)


def _stressed(spark, d):
    whole = t.once(spark, d)
    return stress.stress_curves(t.one_model(spark, d, whole), t.names(spark, d, whole), t.STRESSES, t.POLICY, every=t.EVERY, cash=CASH)


@query("stress_curves", STRESSED, 'SELECT * FROM scurve', '"return" equity turnover transaction_cost gross_exposure net_exposure', digits=3)
def _(spark, d):
    """Seven scenarios of the momentum book, session by session."""
    return _stressed(spark, d)


STRESS_LIVE = f"""{STRESSED}, act_ AS (SELECT *, max(CASE WHEN coalesce(gross_exposure, 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY scenario ORDER BY date) AS a FROM scurve),
  live_ AS (SELECT *, equity / max(equity) OVER (PARTITION BY scenario ORDER BY date) - 1 AS dd, "return" AS r FROM act_ WHERE a = 1)"""
#: Largest drawdown that a stressed book may have. The tables' prices jump at random and books lose more than they hold; at this limit some pass.
STRESS_DRAWDOWN = 1.6


@query("stress_results", STRESS_LIVE, f"""SELECT scenario, count(*) AS n_days, product(1 + r) - 1 AS total_return, stddev_samp(r) * sqrt(252) AS annual_volatility, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe, min(dd) AS max_drawdown, avg(turnover) AS average_turnover,
  sum(transaction_cost) AS transaction_cost_impact, min(dd) >= -{STRESS_DRAWDOWN} AS passed FROM live_ GROUP BY scenario""", "total_return annual_volatility sharpe max_drawdown average_turnover transaction_cost_impact")
def _(spark, d):
    """Performance of each scenario and whether its drawdown is within the limit."""
    found = stress.results(_stressed(spark, d), STRESS_DRAWDOWN)
    return found.select("scenario", "n_days", "total_return", "annual_volatility", "sharpe", "max_drawdown", "average_turnover", "transaction_cost_impact", "passed")


# --- risk, capacity --------------------------------------------------------------------------------------------------------------


ACTIVE = f'{CURVE}, act_ AS (SELECT *, max(CASE WHEN coalesce(gross_exposure, 0) > 0 THEN 1 ELSE 0 END) OVER (ORDER BY date) AS a FROM curve), live_ AS (SELECT *, equity / max(equity) OVER (ORDER BY date) - 1 AS dd, "return" AS r FROM act_ WHERE a = 1)'


@query("drawdown", CURVE, "SELECT date, equity / max(equity) OVER (ORDER BY date) - 1 AS drawdown FROM curve", "drawdown")
def _(spark, d):
    return risk.drawdown(t.curve(spark, d)).select("date", "drawdown")


@query("performance_summary", f"{ACTIVE}, v_ AS (SELECT quantile_cont(r, 0.05) AS q FROM live_)", """SELECT count(*) AS n_days, product(1 + r) - 1 AS total_return, pow(product(1 + r), 252.0 / count(*)) - 1 AS annual_return, stddev_samp(r) * sqrt(252) AS annual_volatility, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe,
  avg(r) / nullif(stddev_samp(r) FILTER (r < 0), 0) * sqrt(252) AS sortino, min(dd) AS max_drawdown, (pow(product(1 + r), 252.0 / count(*)) - 1) / nullif(abs(min(dd)), 0) AS calmar, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(turnover) AS average_turnover,
  1 / nullif(avg(turnover), 0) AS avg_holding_period_days, sum(transaction_cost) AS transaction_cost_impact, avg(gross_exposure) AS average_gross_exposure, avg(net_exposure) AS average_net_exposure, covar_samp(r, benchmark_return) / nullif(var_pop(benchmark_return), 0) AS beta_to_benchmark,
  (avg(r) - covar_samp(r, benchmark_return) / nullif(var_pop(benchmark_return), 0) * avg(benchmark_return)) * 252 AS alpha_estimate, (SELECT q FROM v_) AS var_95_daily, avg(r) FILTER (r <= (SELECT q FROM v_)) AS expected_shortfall_95_daily FROM live_""",
       "total_return annual_return annual_volatility sharpe sortino max_drawdown calmar hit_rate average_turnover avg_holding_period_days transaction_cost_impact average_gross_exposure average_net_exposure beta_to_benchmark alpha_estimate var_95_daily expected_shortfall_95_daily")
def _(spark, d):
    return risk.performance(t.curve(spark, d))


@query("year_stability", CURVE, """SELECT year(date) AS year, count(*) AS n_days, product(1 + "return") - 1 AS total_return, stddev_samp("return") * sqrt(252) AS annual_volatility, avg(turnover) AS average_turnover FROM curve GROUP BY 1""", "total_return annual_volatility average_turnover")
def _(spark, d):
    return risk.by_year(t.curve(spark, d)).select("year", "n_days", "total_return", "annual_volatility", "average_turnover")


@query("monthly_returns", CURVE, """SELECT last_day(m) AS date, coalesce((SELECT product(1 + "return") - 1 FROM curve c WHERE last_day(c.date) = last_day(m)), 0) AS "return" FROM (SELECT CAST(unnest(generate_series(date_trunc('month', (SELECT min(date) FROM curve)), date_trunc('month', (SELECT max(date) FROM curve)), INTERVAL 1 MONTH)) AS DATE) AS m)""", '"return"')
def _(spark, d):
    return risk.monthly_returns(t.curve(spark, d))


@query("regime_performance", f"{ACTIVE}, {REGIME.replace(BARS_SQL + ',', '')}, j_ AS (SELECT l.date, r, CASE WHEN high_vol_regime > 0.5 THEN 'stress' ELSE 'calm' END AS regime FROM live_ l JOIN regime USING (date)), e_ AS (SELECT *, product(1 + r) OVER (PARTITION BY regime ORDER BY date) AS e FROM j_), k_ AS (SELECT *, e / max(e) OVER (PARTITION BY regime ORDER BY date) - 1 AS dd FROM e_)".replace("q_ AS", "qr_ AS").replace("FROM q_", "FROM qr_"),
       "SELECT regime, count(*) AS n_days, pow(product(1 + r), 252.0 / count(*)) - 1 AS annual_return, stddev_samp(r) * sqrt(252) AS annual_volatility, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe, min(dd) AS max_drawdown, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM k_ GROUP BY regime", "annual_return annual_volatility sharpe max_drawdown hit_rate")
def _(spark, d):
    regimes = features.market_regime(t.bench(spark, d), 20, 10, 30).select("date", F.when(F.col("high_vol_regime") > 0.5, "stress").otherwise("calm").alias("regime"))
    return risk.by_regime(t.curve(spark, d), regimes)


@query("exposure_summary", CURVE, "SELECT sum(abs(w)) AS gross_exposure, sum(w) AS net_exposure, count(*) FILTER (w <> 0) AS n_positions, max(abs(w)) AS max_abs_weight, sum(w * w) / nullif(sum(abs(w)) ** 2, 0) AS hhi_concentration FROM (SELECT v.market_value / nullif(equity, 0) AS w FROM values_ v JOIN equity e USING (date) WHERE date = (SELECT max(date) FROM equity))", "gross_exposure net_exposure max_abs_weight hhi_concentration")
def _(spark, d):
    return risk.exposure(t.Books(spark, d).holdings.select("date", "symbol", "weight"))


@query("latest_betas", f"beta_ AS ({_RAW['features_beta']})", "SELECT symbol, arg_max(beta, date) AS beta FROM beta_ WHERE beta IS NOT NULL GROUP BY symbol", "beta")
def _(spark, d):
    p = t.once(spark, d)
    return risk.latest_betas(features.benchmark_features(t.names(spark, d, p), t.bench(spark, d, p), 20))


@query("stress_scenarios", f"""{CURVE}, l_ AS (SELECT symbol, arg_max(v.market_value / nullif(equity, 0), date) AS w FROM values_ v JOIN equity e USING (date) GROUP BY symbol), z_ AS ({_RAW['latest_betas']}),
  o_ AS (SELECT sum(w * coalesce(beta, 1)) AS portfolio_beta, sum(abs(w)) AS gross_exposure, sum(w) AS net_exposure FROM l_ LEFT JOIN z_ USING (symbol))""",
       "SELECT scenario, market_shock, portfolio_beta, portfolio_beta * market_shock AS estimated_portfolio_return, gross_exposure, net_exposure FROM o_, (VALUES ('market -10%', -0.1), ('market +5%', 0.05)) s(scenario, market_shock)", "market_shock portfolio_beta estimated_portfolio_return gross_exposure net_exposure")
def _(spark, d):
    s = spark.createDataFrame([("market -10%", -0.1), ("market +5%", 0.05)], "scenario string, market_shock double")
    at = t.Books(spark, d)
    return risk.stress(at.holdings.select("date", "symbol", "weight"), s, risk.latest_betas(features.benchmark_features(at.panel, at.bench, 20)))


@query("drawdown_runs", f"""{CURVE}, u_ AS (SELECT date, equity / max(equity) OVER (ORDER BY date) - 1 < 0 AS u FROM curve), g_ AS (SELECT u, row_number() OVER (ORDER BY date) - sum(CASE WHEN u THEN 1 ELSE 0 END) OVER (ORDER BY date) AS g FROM u_)""",
       "SELECT (SELECT avg(CASE WHEN u THEN 1.0 ELSE 0.0 END) FROM u_) AS time_under_water, coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM g_ WHERE u GROUP BY g)), 0) AS longest_run", "time_under_water")
def _(spark, d):
    return risk.drawdown_runs(t.curve(spark, d))


@query("borrow_drag", f"""{CURVE}, d_ AS (SELECT date, "return" AS r0, equity AS e0, "return" - (greatest((gross_exposure - net_exposure) / 2, 0) * 200 + greatest(gross_exposure - 1, 0) * 100) / 1e4 / 252 AS r FROM curve)""",
       """SELECT date, r AS "return", first(e0) OVER (ORDER BY date) / (1 + first(r0) OVER (ORDER BY date)) * product(1 + r) OVER (ORDER BY date) AS equity FROM d_""", '"return" equity', digits=3)
def _(spark, d):
    return risk.borrow_drag(t.curve(spark, d), 200.0, 100.0).select("date", "return", "equity")


AUMS = [5e5, 1e6, 2e6, 8e6]
CAPACITY = f"""{FILLS}, tr_ AS (SELECT date, symbol, requested_shares * price AS desired_notional, filled_shares * price AS traded_notional, adv * price AS lagged_adv_notional, commission + spread_cost + slippage_cost + impact_cost AS total_cost FROM fills WHERE adv * price > 0),
  b_ AS (SELECT *, CASE WHEN abs(traded_notional) > 0 THEN total_cost * 1e4 / abs(traded_notional) ELSE 0 END AS base_cost_bps FROM tr_),
  sc_ AS (SELECT *, abs(desired_notional) * aum / 1e6 AS desired, abs(traded_notional) * aum / 1e6 AS empirical, least(abs(traded_notional) * aum / 1e6, lagged_adv_notional * 0.1) AS modeled FROM b_, (VALUES {', '.join(f'({a})' for a in AUMS)}) a(aum)),
  det_ AS (SELECT *, modeled * base_cost_bps * (0.5 + 0.5 * CASE WHEN abs(traded_notional) > 0 THEN pow(modeled / abs(traded_notional), 0.5) ELSE 0 END) / 1e4 AS modeled_cost, modeled / lagged_adv_notional AS participation, CASE WHEN empirical - modeled > 1e-6 THEN 1.0 ELSE 0.0 END AS constrained FROM sc_),
  cap_ AS (SELECT CAST(aum AS DOUBLE) AS aum, count(DISTINCT date) AS n_dates, count(*) FILTER (empirical > 0) AS n_trades, CAST(sum(constrained) AS BIGINT) AS n_constrained, coalesce(avg(constrained) FILTER (empirical > 0), 0) AS constrained_fraction, sum(desired) AS desired, sum(empirical) AS empirical, sum(modeled) AS modeled, sum(desired - modeled) AS total_shortfall,
    sum(empirical - modeled) AS capacity_shortfall, coalesce(sum(modeled) / nullif(sum(desired), 0), 0) AS fill_ratio, sum(modeled) / sum(lagged_adv_notional) AS aggregate_participation, coalesce(quantile_cont(participation, 0.5) FILTER (empirical > 0), 0) AS participation_p50, coalesce(quantile_cont(participation, 0.95) FILTER (empirical > 0), 0) AS participation_p95,
    coalesce(max(participation) FILTER (empirical > 0), 0) AS participation_max, sum(modeled_cost) AS modeled_cost, coalesce(sum(modeled_cost) / nullif(sum(modeled), 0) * 1e4, 0) AS cost_bps FROM det_ GROUP BY aum)"""


def _capacity(spark, d):
    f = t.fills(spark, d)
    tr = f.select("date", "symbol", (F.col("requested_shares") * F.col("price")).alias("desired_notional"), (F.col("filled_shares") * F.col("price")).alias("traded_notional"), (F.col("adv") * F.col("price")).alias("lagged_adv_notional"), (F.col("commission") + F.col("spread_cost") + F.col("slippage_cost") + F.col("impact_cost")).alias("total_cost"))
    return capacity.curve(capacity.scenarios(tr, spark.createDataFrame([(a,) for a in AUMS], "aum double"), reference_aum=1e6))


@query("capacity_curve", CAPACITY, "SELECT * FROM cap_", "constrained_fraction desired empirical modeled total_shortfall capacity_shortfall fill_ratio aggregate_participation participation_p50 participation_p95 participation_max modeled_cost cost_bps", digits=3)
def _(spark, d):
    return _capacity(spark, d)


@query("largest_feasible_aum", CAPACITY, "SELECT max(aum) AS largest_feasible_aum FROM cap_ WHERE fill_ratio >= 0.01", "largest_feasible_aum")
def _(spark, d):
    return capacity.largest_feasible(_capacity(spark, d), 0.01)


@query("capacity_audit", FILLS, """SELECT rule, CAST(v AS BIGINT) AS violations FROM (SELECT count(*) FILTER (requested_shares * price IS NULL OR filled_shares * price IS NULL) AS a, count(*) FILTER (requested_shares * price * filled_shares * price < 0) AS b,
  count(*) FILTER (abs(filled_shares * price) > abs(requested_shares * price) * (1 + 1e-9) + 1e-6) AS c, count(*) FILTER (decision_date >= date) AS e, count(*) FILTER (NOT coalesce(adv * price > 0, false)) AS f FROM fills),
  LATERAL (VALUES ('not_finite', a), ('opposite_direction', b), ('overfilled', c), ('information_not_before_trade', e), ('no_liquidity', f)) r(rule, v)""")
def _(spark, d):
    f = t.fills(spark, d)
    return capacity.audit(f.select("date", F.col("decision_date").alias("information_date"), (F.col("requested_shares") * F.col("price")).alias("desired_notional"), (F.col("filled_shares") * F.col("price")).alias("traded_notional"), (F.col("adv") * F.col("price")).alias("lagged_adv_notional")))


@query("readiness", f"{ACTIVE}, p_ AS (SELECT count(*) AS n, min(dd) AS dd, avg(turnover) AS tu FROM live_)", """SELECT n AS n_days, CASE WHEN n >= 252 AND dd >= -0.25 AND tu <= 0.5 THEN 'READY_FOR_PAPER' ELSE 'NOT_READY' END AS decision, concat_ws(',', CASE WHEN NOT dd >= -0.25 THEN 'drawdown' END, CASE WHEN NOT n >= 252 THEN 'holdout_sample' END, CASE WHEN NOT tu <= 0.5 THEN 'turnover' END) AS failed FROM p_""")
def _(spark, d):
    yes = F.lit(True)
    m = risk.performance(t.curve(spark, d)).withColumns({"deflated_sharpe_prob": F.lit(1.0), "pbo": F.lit(0.0), "annual_excess_return": F.lit(0.1), "point_in_time_complete": yes, "accounting_reconciled": yes, "stress_passed": yes})
    return risk.readiness(m).select("n_days", "decision", F.array_join("failed_gates", ",").alias("failed"))


def decisions(spark, d):
    """Events as proposed decisions: a portfolio is user_id modulo 8; every 97th id repeats the one before it."""
    e = table(spark, d, "events")
    w = F.create_map(F.lit("A"), (F.col("user_id") % 7) / 50.0, F.lit("B"), -(F.col("user_id") % 5) / 25.0)
    c = F.create_map(F.lit("B"), F.lit(-0.05), F.lit("C"), (F.col("user_id") % 3) / 10.0)
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select(
        (F.col("user_id") % 8).alias("portfolio"), F.col("event_id").alias("seq"), (F.col("event_id") - F.when(F.col("event_id") % 97 == 0, 8).otherwise(0)).cast("string").alias("decision_id"),
        ts.alias("decision_time"), (ts - F.make_dt_interval(hours=(F.col("event_id") % 130).cast("int"))).alias("data_available_at"), w.alias("target_weights"), c.alias("current_weights"),
        (1e6 + 1000 * F.col("value")).alias("equity"), F.lit(1.05e6).alias("previous_equity"))


@query("control_gate", """e_ AS (SELECT user_id % 8 AS portfolio, event_id AS seq, CAST(event_id - CASE WHEN event_id % 97 = 0 THEN 8 ELSE 0 END AS VARCHAR) AS decision_id, (event_id % 130) * 3600.0 AS age, (user_id % 7) / 50.0 AS a, -(user_id % 5) / 25.0 AS b, (user_id % 3) / 10.0 AS c, 1e6 + 1000 * value AS equity FROM events),
  o_ AS (SELECT *, abs(a) + abs(b) AS gross, abs(a + b) AS net, greatest(abs(a), abs(b)) AS pos, abs(a) + abs(b + 0.05) + abs(c) AS turn, row_number() OVER (PARTITION BY portfolio, decision_id ORDER BY seq) AS nr FROM e_),
  p_ AS (SELECT *, max(CASE WHEN nr = 1 THEN equity END) OVER (PARTITION BY portfolio ORDER BY seq) AS peak FROM o_)""",
       """SELECT portfolio, seq, decision_id, CASE WHEN nr > 1 THEN 'duplicate_decision_id' ELSE concat_ws(',', CASE WHEN age < 0 THEN 'future_data_availability' WHEN age > 345600 THEN 'stale_data' END, CASE WHEN gross > 1 THEN 'gross_exposure_limit' END, CASE WHEN net > 1 THEN 'net_exposure_limit' END, CASE WHEN pos > 0.1 THEN 'position_limit' END,
  CASE WHEN turn > 0.3 THEN 'turnover_limit' END, CASE WHEN gross * equity > 260000 THEN 'notional_limit' END, CASE WHEN equity / peak - 1 < -0.15 THEN 'drawdown_limit' END, CASE WHEN equity / 1.05e6 - 1 < -0.047 THEN 'daily_loss_limit' END) END AS reasons, CASE WHEN nr = 1 THEN gross END AS gross_exposure, CASE WHEN nr = 1 THEN net END AS absolute_net_exposure,
  CASE WHEN nr = 1 THEN pos END AS maximum_position_weight, CASE WHEN nr = 1 THEN turn END AS turnover, CASE WHEN nr = 1 THEN gross * equity END AS notional, CASE WHEN nr = 1 THEN equity / peak - 1 END AS drawdown,
  CASE WHEN nr = 1 THEN equity / 1.05e6 - 1 END AS daily_return, CASE WHEN nr = 1 THEN age END AS data_age_seconds FROM p_""", "gross_exposure absolute_net_exposure maximum_position_weight turnover notional drawdown daily_return data_age_seconds")
def _(spark, d):
    limits = gate.Limits(maximum_turnover=0.3, maximum_notional=260_000.0, maximum_daily_loss=0.047)
    return gate.batch_gate(decisions(spark, d), limits).select("portfolio", "seq", "decision_id", F.array_join("reasons", ",").alias("reasons"), *[F.try_element_at("observed", F.lit(c)).alias(c) for c in gate.OBSERVED])


_DENS = "exp(-0.5 * pow((r - {mu}) / {sd}, 2)) / {sd}"


@query("regime_probability", f"""{TECH}, fit_ AS (SELECT symbol AS series, avg(r) AS mu, stddev_samp(r) * 0.5 AS sd0, stddev_samp(r) * 1.5 AS sd1 FROM r_ WHERE date < DATE '1997-01-01' AND r IS NOT NULL GROUP BY symbol HAVING stddev_samp(r) > 0),
  y_ AS (SELECT series, date, {_DENS.format(mu='mu', sd='sd0')} AS d0, {_DENS.format(mu='mu', sd='sd1')} AS d1, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM r_ JOIN fit_ ON series = symbol WHERE r IS NOT NULL),
  f_(series, date, i, p) AS (SELECT series, date, i, CASE WHEN 0.7 * d0 + 0.3 * d1 > 0 THEN 0.3 * d1 / (0.7 * d0 + 0.3 * d1) ELSE 0.3 END FROM y_ WHERE i = 1
    UNION ALL SELECT series, date, i, CASE WHEN a + b > 0 THEN b / (a + b) ELSE p END FROM (SELECT y_.series, y_.date, y_.i, f_.p, ((1 - p) * 0.95 + p * (1 - 0.9)) * d0 AS a, ((1 - p) * (1 - 0.95) + p * 0.9) * d1 AS b FROM f_ JOIN y_ ON y_.series = f_.series AND y_.i = f_.i + 1))""",
       "SELECT series, date, p AS stress FROM f_", "stress")
def _(spark, d):
    r = t.names(spark, d, t.once(spark, d)).select(F.col("symbol").alias("series"), "date", features.k_return(1).alias("r"))
    fit = r.filter("date < '1997-01-01' and r is not null").groupBy("series").agg(F.avg("r").alias("mu0"), F.stddev_samp("r").alias("sd")).filter("sd > 0")
    p = fit.select("series", "mu0", F.col("mu0").alias("mu1"), (F.col("sd") * 0.5).alias("sd0"), (F.col("sd") * 1.5).alias("sd1"), F.lit(0.95).alias("p00"), F.lit(0.9).alias("p11"), F.lit(0.3).alias("pi1"))
    return regimes.filtered_probabilities(r, p)


def _refit_sql() -> str:
    """The recursion from the start of history under each refit's parameters, of which the dates in force are kept."""
    return f"""{TECH}, at_ AS (SELECT CAST(x AS DATE) AS since, CAST(lead(x) OVER (ORDER BY x) AS DATE) AS until FROM (VALUES ('1996-01-01'), ('1997-01-06'), ('1998-01-05')) v(x)),
  fit_ AS (SELECT symbol AS series, since, any_value(until) AS until, avg(r) AS mu, stddev_samp(r) * 0.5 AS sd0, stddev_samp(r) * 1.5 AS sd1 FROM r_ JOIN at_ ON date < since WHERE r IS NOT NULL GROUP BY symbol, since HAVING stddev_samp(r) > 0),
  next_ AS (SELECT *, lead(since) OVER (PARTITION BY series ORDER BY since) AS stop FROM fit_),
  y_ AS (SELECT series, since, stop, date, {_DENS.format(mu='mu', sd='sd0')} AS d0, {_DENS.format(mu='mu', sd='sd1')} AS d1, row_number() OVER (PARTITION BY series, since ORDER BY date) AS i FROM r_ JOIN next_ ON series = symbol WHERE r IS NOT NULL AND (stop IS NULL OR date < stop)),
  f_(series, since, date, i, p) AS (SELECT series, since, date, i, CASE WHEN 0.7 * d0 + 0.3 * d1 > 0 THEN 0.3 * d1 / (0.7 * d0 + 0.3 * d1) ELSE 0.3 END FROM y_ WHERE i = 1
    UNION ALL SELECT series, since, date, i, CASE WHEN a + b > 0 THEN b / (a + b) ELSE p END FROM (SELECT y_.series, y_.since, y_.date, y_.i, f_.p, ((1 - p) * 0.95 + p * (1 - 0.9)) * d0 AS a, ((1 - p) * (1 - 0.95) + p * 0.9) * d1 AS b
      FROM f_ JOIN y_ ON y_.series = f_.series AND y_.since = f_.since AND y_.i = f_.i + 1))"""


@query("regime_refits", _refit_sql(), "SELECT series, date, p AS stress FROM f_ WHERE date >= since", "stress")
def _(spark, d):
    """Means and deviations of all returns before each refit."""
    r = cut(t.names(spark, d, t.once(spark, d)).select(F.col("symbol").alias("series"), "date", features.k_return(1).alias("r")), "returns")
    at = F.explode(F.array(*[F.lit(x).cast("date") for x in ("1996-01-01", "1997-01-06", "1998-01-05")]))
    seen = r.filter("r is not null").withColumn("block_start", at).filter("date < block_start")
    fit = seen.groupBy("series", "block_start").agg(F.avg("r").alias("mu0"), F.stddev_samp("r").alias("sd")).filter("sd > 0")
    p = fit.select("series", "block_start", "mu0", F.col("mu0").alias("mu1"), (F.col("sd") * 0.5).alias("sd0"), (F.col("sd") * 1.5).alias("sd1"), F.lit(0.95).alias("p00"), F.lit(0.9).alias("p11"), F.lit(0.3).alias("pi1"))
    return regimes.causal_stress(r, p)


# --- flagship ----------------------------------------------------------------------------------------------------------------------


@query("flagship_momentum", f"{ICS}, {WEIGHTS.replace(PRED + ',', '')}", """SELECT i.date, i.n, i.rank_ic, w.gross, w.net FROM ics i JOIN (SELECT date, sum(abs(target_weight)) AS gross, sum(target_weight) AS net FROM weights GROUP BY date) w ON w.date = i.date WHERE model = 'momentum'""", "rank_ic gross net")
def _(spark, d):
    """Weekly rank IC of a momentum rule beside the exposure of its target weights."""
    p = t.once(spark, d)
    ic = evaluate.ic_by_date(t.one_model(spark, d, p)).select("date", "n", "rank_ic")
    w = t.weights(spark, d, p).groupBy("date").agg(F.sum(F.abs("target_weight")).alias("gross"), F.sum("target_weight").alias("net"))
    return ic.join(w.hint("merge"), "date")

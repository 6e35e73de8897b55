"""Causal features. Every symbol window uses the same partitioning and order, so that Spark plans one exchange and one sort for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import PERIODS_PER_YEAR, by_date, by_symbol, ewm_means, expanding_rank, full, last_rows, pct_rank, ratio

#: Daily bars.
DEFAULTS = {
    "return_lags": [1, 5, 20], "vol_windows": [5, 20, 60], "ma_windows": [10, 20, 50, 200], "momentum_windows": [20, 60, 120], "rsi_window": 14, "macd": {"fast": 12, "slow": 26, "signal": 9},
    "bollinger_window": 20, "mean_reversion_window": 5, "volume_window": 20, "drawdown_window": 252, "rolling_sharpe_window": 60, "beta_window": 60,
    "regime_vol_window": 20, "regime_trend_fast": 50, "regime_trend_slow": 200, "cross_sectional": True,
}
RANKED = ["ret_1", "ret_5", "vol_20", "momentum_20", "volume_z"]


def config_of(config: dict | None) -> dict:
    unknown = set(config or {}) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown feature settings: {sorted(unknown)}")
    return DEFAULTS | (config or {})


def k_return(k: int):
    return ratio(F.col("close"), F.lag("close", k).over(by_symbol())) - 1


def technical(panel: DataFrame, config: dict | None = None) -> DataFrame:
    """Per-symbol features of price and volume; a window that is not full gives null."""
    cfg = config_of(config)
    year = PERIODS_PER_YEAR ** 0.5
    df = panel.withColumns({"ret_": k_return(1), "log_ret": F.log("close") - F.log(F.lag("close").over(by_symbol())), "dollar_": F.col("close") * F.col("volume")})
    cols = {f"ret_{k}": k_return(k) for k in cfg["return_lags"]}
    cols |= {f"vol_{w}": full(F.stddev_samp("ret_"), F.col("ret_"), w) * year for w in cfg["vol_windows"]}
    cols |= {f"ma_ratio_{w}": ratio(F.col("close"), full(F.avg("close"), F.col("close"), w)) - 1 for w in cfg["ma_windows"]}
    cols |= {f"momentum_{w}": k_return(w) for w in cfg["momentum_windows"]}
    b = cfg["bollinger_window"]
    cols["bollinger_z"] = ratio(F.col("close") - full(F.avg("close"), F.col("close"), b), 2 * full(F.stddev_samp("close"), F.col("close"), b))
    v = cfg["volume_window"]
    cols["volume_z"] = ratio(F.col("volume") - full(F.avg("volume"), F.col("volume"), v), full(F.stddev_samp("volume"), F.col("volume"), v))
    cols["volume_ratio"] = ratio(F.col("volume"), full(F.avg("volume"), F.col("volume"), v))
    cols["log_dollar_volume"] = F.log1p("dollar_")
    d = cfg["drawdown_window"]
    cols["drawdown"] = ratio(F.col("close"), full(F.max("close"), F.col("close"), d, least=20)) - 1
    s = cfg["rolling_sharpe_window"]
    cols["rolling_sharpe"] = ratio(full(F.avg("ret_"), F.col("ret_"), s), full(F.stddev_samp("ret_"), F.col("ret_"), s)) * year
    w = cfg["mean_reversion_window"]
    df = df.withColumns(cols | {"wret_": k_return(w)})
    df = df.withColumn("mean_reversion_z", ratio(F.col("wret_") - full(F.avg("wret_"), F.col("wret_"), 60), full(F.stddev_samp("wret_"), F.col("wret_"), 60)))
    return df.drop("ret_", "dollar_", "wret_")


def with_rsi(panel: DataFrame, window: int = 14) -> DataFrame:
    """Adds rsi in [0, 1] by Wilder smoothing; null before window differences, and where there was no loss."""
    df = panel.withColumn("d_", F.col("close") - F.lag("close").over(by_symbol()))
    df = df.withColumns({"gain_": F.greatest("d_", F.lit(0.0)) + F.col("d_") * 0, "loss_": F.greatest(-F.col("d_"), F.lit(0.0)) + F.col("d_") * 0})
    df = ewm_means(df, {"up_": ("gain_", 1 / window), "down_": ("loss_", 1 / window)})
    seen = F.count("d_").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("rsi", F.when((seen >= window) & (F.col("down_") > 0), 1 - 1 / (1 + F.col("up_") / F.col("down_")))).drop("d_", "gain_", "loss_", "up_", "down_")


def rsi(panel: DataFrame, window: int = 14) -> DataFrame:
    """(date, symbol, rsi)."""
    return with_rsi(panel.select("date", "symbol", "close"), window).select("date", "symbol", "rsi")


def with_macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Adds macd, macd_signal and macd_hist, all as shares of the close."""
    df = ewm_means(panel, {"f_": ("close", 2 / (fast + 1)), "s_": ("close", 2 / (slow + 1))}).withColumn("m_", F.col("f_") - F.col("s_"))
    df = ewm_means(df, {"g_": ("m_", 2 / (signal + 1))})
    return df.withColumns({"macd": ratio(F.col("m_"), F.col("close")), "macd_signal": ratio(F.col("g_"), F.col("close")), "macd_hist": ratio(F.col("m_") - F.col("g_"), F.col("close"))}).drop("f_", "s_", "m_", "g_")


def macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(date, symbol, macd, macd_signal, macd_hist)."""
    return with_macd(panel.select("date", "symbol", "close"), fast, slow, signal).select("date", "symbol", "macd", "macd_signal", "macd_hist")


def benchmark_features(panel: DataFrame, benchmark: DataFrame, window: int = 60) -> DataFrame:
    """(date, symbol, beta, benchmark_corr): rolling regression on the benchmark's return of the same date. The benchmark has a row per
    date, so the join is by key, not broadcast."""
    own = panel.select("date", "symbol", k_return(1).alias("r_"))
    bench = benchmark.select("date", k_return(1).alias("b_"))
    return with_beta(own.join(bench.hint("merge"), "date", "left"), window).select("date", "symbol", "beta", "benchmark_corr")


def with_beta(df: DataFrame, window: int) -> DataFrame:
    """Adds beta and benchmark_corr of the returns r_ on those of the benchmark, b_."""
    df = df.withColumns({"x_": F.when(F.col("b_").isNotNull(), F.col("r_")), "y_": F.when(F.col("r_").isNotNull(), F.col("b_"))})
    over = last_rows(window)
    ok = F.count("x_").over(over) >= window
    cov, var = F.covar_samp("x_", "y_").over(over), F.var_samp("y_").over(over)
    sx = F.stddev_samp("x_").over(over)
    return df.withColumns({"beta": F.when(ok & (var > 0), cov / var), "benchmark_corr": F.when(ok & (var > 0) & (sx > 0), cov / F.sqrt(var) / sx)}).drop("x_", "y_")


def market_regime(benchmark: DataFrame, window: int = 20, fast: int = 50, slow: int = 200) -> DataFrame:
    """(date, bench_ret, bench_vol, vol_percentile, bench_trend, high_vol_regime) of one benchmark series. The expanding percentile ranks
    each volatility among those up to it, ties averaged, from 3 * window values on."""
    df = benchmark.withColumn("bench_ret", k_return(1))
    df = df.withColumns({
        "bench_vol": full(F.stddev_samp("bench_ret"), F.col("bench_ret"), window) * PERIODS_PER_YEAR ** 0.5,
        "bench_trend": ratio(full(F.avg("close"), F.col("close"), fast), full(F.avg("close"), F.col("close"), slow)) - 1})
    df = expanding_rank(df.select("symbol", "date", "bench_ret", "bench_vol", "bench_trend"), "bench_vol", "p_", "c_")
    out = df.withColumn("vol_percentile", F.when(F.col("c_") >= 3 * window, F.col("p_")))
    return out.select("date", "bench_ret", "bench_vol", "vol_percentile", "bench_trend", F.coalesce((F.col("vol_percentile") > 0.75).cast("double"), F.lit(0.0)).alias("high_vol_regime"))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite values and NaN become null."""
    return df.withColumns({c: F.when((F.abs(c) < float("inf")) & ~F.isnan(c), F.col(c)) for c in columns})


def cross_sectional(features: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_rank: the percentile rank within the date."""
    return features.withColumns({f"{c}_rank": pct_rank(F.col(c), by_date()) for c in columns})


def build_features(panel: DataFrame, benchmark_symbol: str | None = None, config: dict | None = None) -> DataFrame:
    """The feature panel without the benchmark: one lazy plan. What the benchmark gives is joined once, by date, before the symbols'
    windows, so that all of these share one exchange."""
    cfg = config_of(config)
    rows = panel.filter(F.col("symbol") != benchmark_symbol) if benchmark_symbol else panel
    if benchmark_symbol:
        bench = panel.filter(F.col("symbol") == benchmark_symbol)
        regime = market_regime(bench, cfg["regime_vol_window"], cfg["regime_trend_fast"], cfg["regime_trend_slow"])
        rows = rows.join(regime.withColumn("b_", F.col("bench_ret")).hint("merge"), "date", "left").withColumn("r_", k_return(1))
        rows = with_beta(rows, cfg["beta_window"]).drop("r_", "b_")
    out = with_macd(with_rsi(technical(rows, cfg), cfg["rsi_window"]), **cfg["macd"]).drop("open", "high", "low")
    numbers = [c for c, t in out.dtypes if t == "double" and c not in ("close", "volume")]
    out = finite(out, numbers).drop("close", "volume")
    return cross_sectional(out, [c for c in RANKED if c in out.columns]) if cfg["cross_sectional"] else out


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and sample deviation of each column (1 where it does not vary)."""
    sd = lambda c: F.when(F.coalesce(F.stddev_samp(c), F.lit(0.0)) > 0, F.stddev_samp(c)).otherwise(1.0)
    return train.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean_"), sd(c).alias(f"{c}_sd_"))])


def apply_scaler(df: DataFrame, fitted: DataFrame, columns: list[str], clip: float = 5.0) -> DataFrame:
    scaled = {c: F.greatest(F.least((F.col(c) - F.col(f"{c}_mean_")) / F.col(f"{c}_sd_"), F.lit(clip)), F.lit(-clip)) for c in columns}
    # fitted is a single row
    return df.crossJoin(F.broadcast(fitted)).withColumns({c: F.when(F.col(c).isNotNull(), x) for c, x in scaled.items()}).select(*df.columns)


def sequences(features: DataFrame, columns: list[str], length: int) -> DataFrame:
    """(date, symbol, window): the last length rows of the columns (null as 0), only where there are so many."""
    w = F.collect_list(F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns])).over(last_rows(length))
    return features.select("date", "symbol", w.alias("window")).filter(F.size("window") == length)

"""Signals from predictions, and weights from signals, date by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import by_date, pct_rank, ratio


def select_model(predictions: DataFrame, model: str | None = None) -> DataFrame:
    """Predictions of one model: the named one, else ensemble, gradient_boosting, ridge, else the first by name."""
    if model:
        return predictions.filter(F.col("model") == model)
    rank = F.when(F.col("model") == "ensemble", 0).when(F.col("model") == "gradient_boosting", 1).when(F.col("model") == "ridge", 2).otherwise(3)
    best = predictions.select("model").distinct().orderBy(rank, "model").limit(1)
    return predictions.join(F.broadcast(best), "model", "left_semi")  # one row


def tails(n: Column, rn: Column, quantile: Column | float) -> Column:
    """1 for the quantile's highest of n ranks, at least one, -1 for as many lowest."""
    k = F.greatest(F.lit(1), F.floor(n * quantile))
    return F.when(n < 2, 0.0).when(rn > n - k, 1.0).when(rn <= k, -1.0).otherwise(0.0)


def build_signals(predictions: DataFrame, strategy: str = "long_short", *, quantile: float = 0.2, top_k: int = 5, clip: float = 2.0, threshold: float = 0.0, allow_short: bool = True) -> DataFrame:
    """(date, symbol, prediction, signal), signal in [-1, 1]. Ties go by symbol."""
    p = F.col("prediction")
    df = predictions.select("date", "symbol", "prediction").filter(p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")))
    n = F.count("*").over(by_date())
    if strategy == "long_short":
        signal = tails(n, F.row_number().over(by_date().orderBy("prediction", "symbol")), quantile)
    elif strategy == "long_only_topk":
        signal = F.when(F.row_number().over(by_date().orderBy(F.desc("prediction"), "symbol")) <= top_k, 1.0).otherwise(0.0)
    elif strategy == "rank_weighted":
        df = df.withColumn("c_", pct_rank(p, by_date()) - 0.5)
        varies = F.min(p).over(by_date()) < F.max(p).over(by_date())
        signal = F.when(varies, ratio(F.col("c_"), F.sum(F.abs("c_")).over(by_date()))).otherwise(0.0)
    elif strategy == "confidence_weighted":
        sd = F.stddev_pop(p).over(by_date())
        z = ratio(p - F.avg(p).over(by_date()), sd)
        signal = F.when((n < 2) | (sd == 0), 0.0).otherwise(F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)) / clip)
    elif strategy == "threshold":
        signal = F.when(p > threshold, 1.0).when(F.lit(allow_short) & (p < -threshold), -1.0).otherwise(0.0)
    else:
        raise ValueError(f"unknown signal strategy: {strategy!r}")
    return df.withColumn("signal", signal).select("date", "symbol", "prediction", "signal")


def regime_filter(signals: DataFrame, features: DataFrame, column: str = "hmm_stress_prob", fallback: str = "high_vol_regime", max_stress: float = 0.7) -> DataFrame:
    """Signals times 1 - stress, 0 beyond max_stress; unchanged when neither column is there."""
    col = column if column in features.columns else fallback
    if col not in features.columns:
        return signals
    per_date = features.filter(F.col(col).isNotNull()).groupBy("date").agg(F.min_by(col, "symbol" if "symbol" in features.columns else "date").alias("s_"))
    stress = F.least(F.greatest(F.coalesce("s_", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    scale = F.when(stress <= max_stress, 1 - stress).otherwise(0.0)
    return signals.join(per_date.hint("merge"), "date", "left").withColumn("signal", F.col("signal") * scale).drop("s_")


def uncapped_weights(signals: DataFrame, vols: DataFrame | None = None, *, max_weight: float = 0.10, max_gross: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(date, symbol, target_weight): scores over volatility (a missing one is the date's median, else 1), scaled to half the gross a side
    when both are there, clipped by name, then scaled down to the gross. by: further keys of the signals; each has weights of its own."""
    df, day = signals.select(*by, "date", "symbol", "signal"), by_date(*by)
    if vols is not None:
        df = df.join(vols.select("date", "symbol", "vol").hint("merge"), ["date", "symbol"], "left").withColumn("vol", F.when(F.col("vol") != 0, F.col("vol")))
        df = df.withColumn("signal", F.col("signal") / F.coalesce("vol", F.percentile("vol", 0.5).over(day), F.lit(1.0)))
    df = df.withColumn("x", F.coalesce("signal", F.lit(0.0)))
    df = df.withColumns({"p_": F.sum(F.greatest("x", F.lit(0.0))).over(day), "m_": -F.sum(F.least("x", F.lit(0.0))).over(day)})
    two = (F.col("p_") > 0) & (F.col("m_") > 0)
    side = F.when(F.col("x") > 0, ratio(F.col("x"), F.col("p_"))).when(F.col("x") < 0, ratio(F.col("x"), F.col("m_"))).otherwise(0.0)
    w = F.when(two, side * (max_gross / 2)).otherwise(F.coalesce(ratio(F.col("x"), F.col("p_") + F.col("m_")), F.lit(0.0)) * max_gross)
    df = df.withColumn("w_", F.greatest(F.least(w, F.lit(max_weight)), F.lit(-max_weight))).withColumn("g_", F.sum(F.abs("w_")).over(day))
    return df.select(*by, "date", "symbol", F.when(F.col("g_") > max_gross, F.col("w_") * max_gross / F.col("g_")).otherwise(F.col("w_")).alias("target_weight"))


def turnover_cap(weights: DataFrame, cap: float | None) -> DataFrame:
    """Blends each date's weights with the date's before, so that they move by cap at most. Path-dependent: a fold over the dates of a
    portfolio. Names missing today leave the book without counting afterwards; without a cap, or with 0, nothing changes."""
    if not cap:
        return weights
    key = ["portfolio"] if "portfolio" in weights.columns else []
    df = weights if key else weights.withColumn("portfolio", F.lit("all"))
    days = df.groupBy("portfolio", "date").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "target_weight"))).alias("w"))
    rows = days.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct("date", F.map_entries("w").alias("w")))).alias("rows"))
    fold = f"""aggregate(rows, named_struct('prev', cast(map() as map<string, double>), 'out', cast(array() as array<struct<date: date, w: map<string, double>>>)),
      (s, d) -> transform(array(map_from_entries(d.w)), w ->
        transform(array(aggregate(map_values(map_zip_with(s.prev, w, (k, a, b) -> abs(coalesce(b, 0D) - coalesce(a, 0D)))), 0D, (t, x) -> t + x)), t ->
          transform(array(if(size(s.prev) > 0 and t > {cap}D, transform_values(w, (k, b) -> coalesce(s.prev[k], 0D) + (b - coalesce(s.prev[k], 0D)) * {cap}D / t), w)), v ->
            named_struct('prev', v, 'out', array_append(s.out, named_struct('date', d.date, 'w', v))))[0])[0])[0],
      s -> s.out)"""
    out = rows.select("portfolio", F.explode(F.expr(fold)).alias("o")).select("portfolio", "o.date", F.explode("o.w").alias("symbol", "target_weight"))
    return out.select(*key, "date", "symbol", "target_weight")


def construct_portfolio(signals: DataFrame, features: DataFrame | None = None, config: dict | None = None) -> DataFrame:
    """Target weights from signals under max_weight, max_gross_exposure, inverse_vol_scaling and turnover_cap."""
    cfg = {"max_weight": 0.10, "max_gross_exposure": 1.0, "inverse_vol_scaling": True, "turnover_cap": None}
    unknown = set(config or {}) - set(cfg)
    if unknown:
        raise ValueError(f"unknown portfolio settings: {sorted(unknown)}")
    cfg |= config or {}
    vols = features.select("date", "symbol", F.col("vol_20").alias("vol")) if cfg["inverse_vol_scaling"] and features is not None and "vol_20" in features.columns else None
    return turnover_cap(uncapped_weights(signals, vols, max_weight=cfg["max_weight"], max_gross=cfg["max_gross_exposure"]), cfg["turnover_cap"])

"""Forward labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.windows import by_date, by_symbol, full, pct_rank, ratio


def build_labels(panel: DataFrame, benchmark_symbol: str | None = None, horizons: tuple[int, ...] = (1, 5, 20), vol_window: int = 20) -> DataFrame:
    """Per horizon h: return to h rows ahead, its direction, over trailing volatility, volatility of the next h rows, excess over the
    benchmark on the same date, percentile rank within the date."""
    rows = panel.filter(F.col("symbol") != benchmark_symbol) if benchmark_symbol else panel
    df = rows.withColumns({"r_": ratio(F.col("close"), F.lag("close").over(by_symbol())) - 1, "n_": F.row_number().over(by_symbol())})
    df = df.withColumn("v_", full(F.stddev_samp("r_"), F.col("r_"), vol_window))
    cols = {}
    for h in horizons:
        fwd = ratio(F.lead("close", h).over(by_symbol()), F.col("close")) - 1
        ahead = by_symbol().rowsBetween(1, h)
        cols |= {f"fwd_ret_{h}": fwd, f"fwd_dir_{h}": F.when(fwd > 0, 1.0).when(fwd <= 0, 0.0), f"fwd_ret_{h}_voladj": ratio(fwd, F.col("v_")),
                 f"fwd_vol_{h}": F.when((F.count("r_").over(ahead) == h) & (F.col("n_") >= h), F.stddev_samp("r_").over(ahead))}
    df = df.withColumns(cols)
    if benchmark_symbol:
        bench = panel.filter(F.col("symbol") == benchmark_symbol)
        bench = bench.select("date", *[(ratio(F.lead("close", h).over(by_symbol()), F.col("close")) - 1).alias(f"b_{h}") for h in horizons])
        df = df.join(bench.hint("merge"), "date", "left").withColumns({f"fwd_excess_{h}": F.col(f"fwd_ret_{h}") - F.col(f"b_{h}") for h in horizons})
    df = df.withColumns({f"fwd_rank_{h}": pct_rank(F.col(f"fwd_ret_{h}"), by_date()) for h in horizons})
    return df.select("date", "symbol", *[c for c in df.columns if c.startswith("fwd_")])

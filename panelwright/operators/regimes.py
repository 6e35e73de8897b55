"""Filtered regime probabilities by an associative scan.

A step of the two-state forward recursion is a 2 x 2 matrix, and the state after a row is the product of the matrices up to it, applied to
the prior. A series is dealt in blocks of rows; a block's product is four numbers, products over the blocks before one give the state at its
start, and only blocks whose dates are wanted are unrolled. No row, array or task holds a whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.ranks import running_totals
from panelwright.plans.session import cut, ship

#: Rows of a block.
BLOCK = 1024
PARAMS = ["mu0", "mu1", "sd0", "sd1", "p00", "p11", "pi1"]


def _matrices(r: np.ndarray, first: bool, p: pd.Series) -> np.ndarray:
    """A matrix per row: transition, then both states' densities; a row that neither state can give leaves the state as it is. The very
    first row has no transition."""
    density = np.stack([np.exp(-0.5 * ((r - p[f"mu{k}"]) / p[f"sd{k}"]) ** 2) / p[f"sd{k}"] for k in (0, 1)])
    step = np.array([[p["p00"], 1 - p["p11"]], [1 - p["p00"], p["p11"]]])
    out = density.T[:, :, None] * step
    if first:
        out[0] = np.diag(density[:, 0])
    out[~(density.sum(0) > 0)] = np.eye(2)
    return out


def prefix_products(m: np.ndarray) -> np.ndarray:
    """Products of the matrices up to each, each scaled to a largest entry of 1: by doubling, log2(n) rounds."""
    out, reach = m / m.max((1, 2), keepdims=True), 1
    while reach < len(out):
        tail = out[reach:] @ out[:-reach]
        out = np.concatenate((out[:reach], tail / np.maximum(tail.max((1, 2), keepdims=True), 1e-300)))
        reach *= 2
    return out


def _product(rows: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
    """For each set of parameters, the product of a block's rows before the set ends."""
    rows, out = rows.sort_values("pos"), []
    r, date = rows["r"].to_numpy(float), rows["date"].to_numpy()
    for _, p in params.iterrows() if len(rows) else ():
        n = len(r) if pd.isna(p["until"]) else int((date < p["until"]).sum())
        if n:
            out.append((p["series"], p["block"], p["nr"], *prefix_products(_matrices(r[:n], rows["pos"].iloc[0] == 0, p))[-1].ravel()))
    return pd.DataFrame(out, columns=["series", "block", "nr", "a", "b", "c", "d"])


def _starts(products: pd.DataFrame) -> pd.DataFrame:
    """The state before each block of a series and set of parameters: at most a row per block."""
    products = products.sort_values("block")
    state, out = np.array([1 - products["pi1"].iloc[0], products["pi1"].iloc[0]]), []
    for m in products[["a", "b", "c", "d"]].to_numpy(float):
        out.append(state[1])
        state = m.reshape(2, 2) @ state
        state = state / state.sum() if state.sum() > 0 else state
    return products[["series", "block", "nr"]].assign(before=out)


def _unroll(rows: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
    """States after a block's rows, where a set of parameters is in force."""
    rows, out = rows.sort_values("pos"), []
    r, date = rows["r"].to_numpy(float), rows["date"].to_numpy()
    for _, p in params.iterrows() if len(rows) else ():
        n = len(r) if pd.isna(p["until"]) else int((date < p["until"]).sum())
        if not n:
            continue
        states = prefix_products(_matrices(r[:n], rows["pos"].iloc[0] == 0, p)) @ np.array([1 - p["before"], p["before"]])
        own = np.ones(n, bool) if pd.isna(p["since"]) else date[:n] >= p["since"]
        out.append(pd.DataFrame({"series": p["series"], "date": date[:n][own], "stress": (states[:, 1] / states.sum(1))[own]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["series", "date", "stress"])


def causal_stress(returns: DataFrame, params: DataFrame) -> DataFrame:
    """(series, date, stress) of a two-state Gaussian regime model whose parameters (series, block_start and PARAMS) are refitted: a date uses
    the last set that starts at or before it, and its recursion runs over the whole history up to the date. A null block_start starts with
    the series; dates before the first set have no row. Null returns are left out; null series have no parameters, and no row. Rows of one
    date count in order of their returns."""
    ship(returns.sparkSession)
    order = Window.partitionBy("series").orderBy(F.col("block_start").asc_nulls_first())
    sets = cut(params.filter("series is not null").select("series", *[F.col(c).cast("double").alias(c) for c in PARAMS], F.col("block_start").alias("since"), F.lead("block_start").over(order).alias("until"), F.row_number().over(order).alias("nr")), "sets")
    rows = returns.filter("r is not null and not isnan(r) and series is not null").select("series", "date", F.col("r").cast("double").alias("r"))
    rows = cut(running_totals(rows, ["series"], ["date", "r"], "pos").withColumn("block", F.floor(F.col("pos") / BLOCK)), "placed")
    blocks = rows.groupBy("series", "block").agg(F.min("date").alias("from"), F.max("date").alias("to"))
    met = cut(blocks.join(sets.hint("merge"), "series").filter("until is null or `from` < until"), "blocks")
    kinds = dict(rows.dtypes)
    by = ["series", "block"]
    key = f"series {kinds['series']}, block long, nr int"
    products = rows.groupBy(*by).cogroup(met.groupBy(*by)).applyInPandas(_product, f"{key}, a double, b double, c double, d double")
    starts = cut(products.join(sets.select("series", "nr", "pi1").hint("merge"), ["series", "nr"]).groupBy("series", "nr").applyInPandas(_starts, f"{key}, before double"), "starts")
    wanted = met.filter("since is null or `to` >= since").join(starts.hint("merge"), [*by, "nr"])
    own = rows.join(wanted.select(*by).distinct().hint("merge"), by, "left_semi")
    return own.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInPandas(_unroll, f"series {kinds['series']}, date {kinds['date']}, stress double")


def filtered_probabilities(returns: DataFrame, params: DataFrame) -> DataFrame:
    """causal_stress() with one set of parameters for all dates of a series."""
    return causal_stress(returns, params.withColumn("block_start", F.lit(None).cast(dict(returns.dtypes)["date"])))

"""Linear models of all windows at once.

A row z = (features with 0 for missing, missing flags, 1, target) gives the matrix z z'. Its sums per date add up along the calendar, so that
the sums of any training range are a difference of two prefix sums, whatever the number of windows that hold a row. Medians of a window turn
them into those of the imputed features; standardizing and solving then works on small matrices, one per window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.ranks import BROADCAST_GROUPS, exact_percentiles
from panelwright.functions.windows import dated
from panelwright.plans.session import cut, ship

#: Coordinate descent: sweeps, and the change at which it ends.
SWEEPS, TOLERANCE = 10_000, 1e-13


@dataclass(frozen=True)
class Spec:
    """A linear model: least (1 / 2n) |y - Xw|^2 + l1 |w| + l2 / 2 |w|^2 over standardized features; l2 as a total over rows if shared."""

    name: str
    l1: float = 0.0
    l2: float = 0.0
    shared: bool = False


def spec(name: str, kind: str, alpha: float | None = None, l1_ratio: float = 0.5) -> Spec:
    """kind: linear, ridge (alpha 10), lasso or elastic_net (alpha 0.001)."""
    if kind == "linear":
        return Spec(name)
    if kind == "ridge":
        return Spec(name, l2=10.0 if alpha is None else alpha, shared=True)
    if kind not in ("lasso", "elastic_net"):
        raise ValueError(f"no linear model {kind}")
    a, share = 0.001 if alpha is None else alpha, 1.0 if kind == "lasso" else l1_ratio
    return Spec(name, l1=a * share, l2=a * (1 - share))


KINDS = ("linear", "ridge", "lasso", "elastic_net")


def solve(g: np.ndarray, r: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Weights from the features' covariances g and those with the target r: least squares of least norm without penalties, normal
    equations with a quadratic one, coordinate descent otherwise."""
    if l1 == 0:
        return np.linalg.solve(g + l2 * np.eye(len(r)), r) if l2 > 0 else np.linalg.pinv(g, rcond=1e-10, hermitian=True) @ r
    w = np.zeros(len(r))
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(len(r)):
            if g[j, j] + l2 == 0:
                continue
            part = r[j] - g[j] @ w + g[j, j] * w[j]
            new = np.sign(part) * max(abs(part) - l1, 0.0) / (g[j, j] + l2)
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved <= TOLERANCE * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def _fit(total: np.ndarray, median: np.ndarray, specs: list[Spec]) -> tuple[np.ndarray, np.ndarray, float, list[np.ndarray]]:
    """Means, deviations, the target's mean and each model's weights from a window's sums of z z'."""
    k = len(median)
    fill = np.zeros((k + 2, 2 * k + 2))  # imputed features, 1 and the target from z
    fill[:k, :k], fill[:k, k : 2 * k] = np.eye(k), np.diag(median)
    fill[k, 2 * k] = fill[k + 1, 2 * k + 1] = 1
    m = fill @ total @ fill.T
    n = m[k, k]
    mean = m[k] / n
    cov = m / n - np.outer(mean, mean)
    var = np.diag(cov)[:k]
    # what is left of a constant by rounding does not vary
    varies = var > 1e-12 * np.maximum(mean[:k] ** 2, 1e-300)
    sd = np.where(varies, np.sqrt(np.where(varies, var, 1.0)), 1.0)
    g = np.where(np.outer(varies, varies), cov[:k, :k], 0.0) / np.outer(sd, sd)
    r = np.where(varies, cov[:k, k + 1], 0.0) / sd
    return mean[:k], sd, mean[k + 1], [solve(g, r, s.l1, s.l2 / n if s.shared else s.l2) for s in specs]


def moments(rows: DataFrame, columns: list[str], target: str = "target") -> DataFrame:
    """(date, cell, value): sums of z z' per date, the upper triangle numbered by rows. Workers add up their batches date by date."""
    m = 2 * len(columns) + 2
    upper = np.triu_indices(m)
    kind = rows.schema["date"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in columns])
            y = batch.column(target).cast(pa.float64()).to_numpy(zero_copy_only=False)
            lost = ~np.isfinite(x)
            z = np.column_stack([np.where(lost, 0.0, x), lost.astype(float), np.ones(len(y)), y])
            codes = batch.column("date").dictionary_encode()
            of = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(of, kind="stable")
            first = np.flatnonzero(np.diff(of[order], prepend=-1))
            sums = np.stack([z[part].T @ z[part] for part in np.split(order, first[1:])])[:, upper[0], upper[1]]
            days = codes.dictionary.take(pa.array(np.repeat(of[order][first], len(upper[0]))))
            yield pa.RecordBatch.from_arrays([days, pa.array(np.tile(np.arange(len(upper[0]), dtype=np.int32), len(first))), pa.array(sums.ravel())], names=["date", "cell", "value"])

    parts = rows.select("date", *[F.col(c).cast("double").alias(c) for c in columns], F.col(target).cast("double").alias(target)).mapInArrow(run, f"date {kind.simpleString()}, cell int, value double")
    return parts.groupBy("date", "cell").agg(F.sum("value").alias("value"))


def ranges(roles: DataFrame, role: str) -> DataFrame:
    """(window_id, lo, hi): runs of neighbouring positions of (window_id, idx, role)."""
    w = Window.partitionBy("window_id").orderBy("idx")
    runs = roles.filter(F.col("role") == role).withColumn("run", F.col("idx") - F.row_number().over(w))
    return runs.groupBy("window_id", "run").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).drop("run")


def fit_windows(rows: DataFrame, roles: DataFrame, specs: list[Spec], columns: list[str], target: str = "target") -> DataFrame:
    """(window_id, model, n, intercept, medians, means, deviations, weights) of every window and model, by the dates on which a window
    trains: roles (window_id, date, role). rows (date, features, target): missing and non-finite features take the window's exact median
    (0 if it has no value); rows without target do not train. Windows without a training row are left out.

    Jobs do not grow in number with windows: one for the sums, some for medians, and one grouped call over a small matrix per window."""
    if not specs or not columns:
        raise ValueError("a fit needs models and features")
    ship(rows.sparkSession)
    known = rows.filter(F.col(target).isNotNull() & ~F.isnan(target))
    days = cut(dated(rows.select("date")), "calendar")
    placed = cut(roles.join(days.hint("merge"), "date").select("window_id", "idx", "role"), "roles")
    # sums up to a position; a window over the calendar for each cell, a row per date
    per_date = moments(known, columns, target).join(days.hint("merge"), "date")
    cells = len(np.triu_indices(2 * len(columns) + 2)[0])
    grid = days.select("idx", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    sums = grid.join(per_date.select("idx", "cell", "value").hint("merge"), ["idx", "cell"], "left")
    upto = F.sum(F.coalesce("value", F.lit(0.0))).over(Window.partitionBy("cell").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    prefix = cut(sums.select("cell", "idx", upto.alias("upto")), "prefix")
    spans = cut(ranges(placed, "train"), "ranges")
    ends = spans.select("window_id", F.explode(F.array(F.struct(F.lit(1.0).alias("sign"), F.col("hi").alias("idx")), F.struct(F.lit(-1.0).alias("sign"), (F.col("lo") - 1).alias("idx")))).alias("e")).select("window_id", "e.*")
    totals = ends.hint("merge").join(prefix.hint("merge"), "idx").groupBy("window_id", "cell").agg(F.sum(F.col("sign") * F.col("upto")).alias("value"))
    medians = _medians(rows, known, placed, days, columns)
    both = totals.unionByName(medians.select("window_id", (F.col("feature") + cells).alias("cell"), F.col("median").alias("value")))
    kind = dict(roles.dtypes)["window_id"]
    upper, k, names = np.triu_indices(2 * len(columns) + 2), len(columns), [s.name for s in specs]

    def solve_window(part: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(cells + k)
        values[part["cell"].to_numpy()] = part["value"].to_numpy()
        total = np.zeros((2 * k + 2, 2 * k + 2))
        total[upper] = values[:cells]
        total = total + np.triu(total, 1).T
        n = round(total[2 * k, 2 * k])
        if n < 1:
            return pd.DataFrame(columns=["window_id", "model", "n", "intercept", "medians", "means", "deviations", "weights"])
        mean, sd, y, weights = _fit(total, values[cells:], specs)
        same = [values[cells:].tolist(), mean.tolist(), sd.tolist()]
        return pd.DataFrame([(part["window_id"].iloc[0], name, n, y, *same, w.tolist()) for name, w in zip(names, weights, strict=True)], columns=["window_id", "model", "n", "intercept", "medians", "means", "deviations", "weights"])

    return both.groupBy("window_id").applyInPandas(solve_window, f"window_id {kind}, model string, n long, intercept double, medians array<double>, means array<double>, deviations array<double>, weights array<double>")


def _medians(rows: DataFrame, known: DataFrame, placed: DataFrame, days: DataFrame, columns: list[str]) -> DataFrame:
    """(window_id, feature, median) of the features that miss a value on a date of the window, training or test; the others need none."""
    value = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))  # noqa: E731  NaN compares as larger

    def long(df: DataFrame) -> DataFrame:
        return df.select("date", F.posexplode(F.array(*[value(c) for c in columns])).alias("feature", "x")).join(days.hint("merge"), "date").select("idx", "feature", "x")

    lost = long(rows).filter("x is null").select("idx", "feature").distinct()
    needed = cut(lost.join(placed.hint("merge"), "idx").select("window_id", "feature").distinct(), "needed")
    asked = placed.filter("role = 'train'").select("window_id", "idx").join(needed.hint("merge"), "window_id")
    values = cut(asked.join(long(known).filter("x is not null").hint("merge"), ["idx", "feature"]).select("window_id", "feature", "x"), "values")
    return exact_percentiles(values, ["window_id", "feature"], "x", [0.5], "median").drop("share")


def predict_windows(rows: DataFrame, roles: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """rows of each window's test dates with window_id, model and prediction."""
    few = fitted.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    test = rows.join(roles.filter("role = 'test'").select("date", "window_id").hint("merge"), "date")
    met = test.join(F.broadcast(fitted) if few else fitted.hint("merge"), "window_id")
    total = F.col("intercept")
    for i, c in enumerate(columns):
        at = lambda name, i=i: F.element_at(name, i + 1)
        x = F.col(c).cast("double")
        total = total + (F.coalesce(F.when(F.abs(x) < float("inf"), x), at("medians")) - at("means")) / at("deviations") * at("weights")
    return met.select(*rows.columns, "window_id", "model", total.alias("prediction"))


def importances(fitted: DataFrame, columns: list[str]) -> DataFrame:
    """(model, window_id, feature, importance): sizes of the weights of standardized features."""
    names = F.array(*[F.lit(c) for c in columns])
    return fitted.select("model", "window_id", F.explode(F.arrays_zip(names.alias("feature"), F.transform("weights", lambda w: F.abs(w)).alias("importance"))).alias("e")).select("model", "window_id", "e.feature", "e.importance")


def run_linear(data: DataFrame, roles: DataFrame, specs: list[Spec], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions, importances) of all windows and models. data (date, symbol, features, target), roles (window_id, date, role)."""
    rows = cut(data.filter("target is not null").select("date", "symbol", *columns, "target"), "rows")
    roles = cut(roles.select("window_id", "date", "role"), "roles")
    fitted = cut(fit_windows(rows, roles, specs, columns), "fitted")
    found = predict_windows(rows, roles, fitted, columns)
    return found.select("date", "symbol", "model", "window_id", "target", "prediction"), importances(fitted, columns)

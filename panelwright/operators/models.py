"""Baselines, models on pyspark.ml for one training set, and the drivers that fit models on the windows of a split."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.ranks import exact_percentiles
from panelwright.plans.session import cut

from . import linear as linear_windows
from . import trees as tree_windows
from .evaluate import regression_metrics
from .splits import roles

ID = ["date", "symbol"]


def supervised(features: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """Features beside the target, matched by date and symbol."""
    return features.join(labels.select(*ID, F.col(target).alias("target")).hint("merge"), ID)


# --- baselines: projections and one aggregation over all windows ---------------------------------------------------


def zero_baseline(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prediction", F.lit(0.0))


def momentum_baseline(rows: DataFrame, feature: str, scale: float = 1.0) -> DataFrame:
    return rows.withColumn("prediction", scale * F.coalesce(feature, F.lit(0.0)))


def historical_mean(assigned: DataFrame) -> DataFrame:
    """Test rows of every window with the mean training target of the window."""
    means = assigned.filter("role = 'train'").groupBy("window_id").agg(F.avg("target").alias("prediction"))
    return assigned.filter("role = 'test'").join(means.hint("merge"), "window_id")


# --- fitted models -------------------------------------------------------------------------------------------------


@dataclass
class Fitted:
    """Medians for missing values, population-scaled features, a pyspark.ml model."""

    columns: list[str]
    stats: dict
    model: Transformer

    def _vector(self, rows: DataFrame) -> DataFrame:
        s = self.stats
        x = {f"{c}__": (F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(s[f"{c}_med"])) - s[f"{c}_mean"]) / s[f"{c}_sd"] for c in self.columns}
        return VectorAssembler(inputCols=list(x), outputCol="features_").transform(rows.withColumns(x)).drop(*x)

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self._vector(rows)).drop("features_")

    def importance(self) -> list[tuple[str, float]]:
        values = self.model.coefficients if hasattr(self.model, "coefficients") else self.model.featureImportances
        return [(c, abs(float(values[i]))) for i, c in enumerate(self.columns)]


def _prepare(train: DataFrame, columns: list[str]) -> dict:
    """Exact medians, then mean and population deviation after imputation; the label's deviation and count. One row reaches the driver."""
    long = train.select(*columns).unpivot([], columns, "feature", "x").filter(~F.isnan("x"))
    found = {r["feature"]: r["percentile"] for r in exact_percentiles(long, ["feature"], "x", [0.5]).collect()}
    med = {f"{c}_med": found.get(c, 0.0) for c in columns}
    filled = {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(med[f"{c}_med"])) for c in columns}
    sd = lambda x: F.when(F.stddev_pop(x) > 0, F.stddev_pop(x)).otherwise(1.0)
    rest = train.agg(F.count("*").alias("n_"), F.coalesce(F.stddev_samp("target"), F.lit(0.0)).alias("sd_y_"), *[y for c, x in filled.items() for y in (F.avg(x).alias(f"{c}_mean"), sd(x).alias(f"{c}_sd"))]).first().asDict()
    return med | rest


def _fit(train: DataFrame, columns: list[str], estimator: Callable[[dict], object]) -> Fitted:
    out = Fitted(columns, _prepare(train, columns), None)
    out.model = estimator(out.stats).fit(out._vector(train))
    return out


def _linear(stats: dict, l2: float, l1: float) -> LinearRegression:
    """l2 and l1 as multiples of |w|^2 / 2 and |w| beside half the mean squared error; the library divides the first part of its penalty by
    the label's deviation."""
    reg = stats["sd_y_"] * l2 + l1
    return LinearRegression(featuresCol="features_", labelCol="target", regParam=reg, elasticNetParam=l1 / reg if reg > 0 else 0.0, standardization=False, solver="l-bfgs", tol=1e-12, maxIter=1000)


def linear(train, columns):
    return _fit(train, columns, lambda s: _linear(s, 0.0, 0.0))


def ridge(train, columns, alpha: float = 10.0):
    return _fit(train, columns, lambda s: _linear(s, alpha / s["n_"], 0.0))


def lasso(train, columns, alpha: float = 0.001):
    return _fit(train, columns, lambda s: _linear(s, 0.0, alpha))


def elastic_net(train, columns, alpha: float = 0.001, l1_ratio: float = 0.5):
    return _fit(train, columns, lambda s: _linear(s, alpha * (1 - l1_ratio), alpha * l1_ratio))


def random_forest(train, columns, trees: int = 200, depth: int = 6, leaf: int = 50, seed: int = 7):
    return _fit(train, columns, lambda _: RandomForestRegressor(featuresCol="features_", labelCol="target", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed))


def gradient_boosting(train, columns, rounds: int = 300, depth: int = 4, rate: float = 0.05, seed: int = 7):
    return _fit(train, columns, lambda _: GBTRegressor(featuresCol="features_", labelCol="target", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed))


REGISTRY: dict[str, Callable[..., Fitted]] = {"linear": linear, "ridge": ridge, "lasso": lasso, "elastic_net": elastic_net, "random_forest": random_forest, "gradient_boosting": gradient_boosting}
_OWN = dict(REGISTRY)


def register(name: str, fit: Callable[..., Fitted]) -> None:
    """fit(train, columns, **params) returns an object with predict(rows) and importance()."""
    REGISTRY[name] = fit


# --- ensembles ------------------------------------------------------------------------------------------------------


@dataclass
class Ensemble:
    """Fitted members and their weights."""

    members: list[tuple[str, object]]
    weights: list[float]

    def predict(self, rows: DataFrame) -> DataFrame:
        names = [f"prediction_{i}_" for i in range(len(self.members))]
        for name, (_, m) in zip(names, self.members, strict=True):
            rows = m.predict(rows).withColumnRenamed("prediction", name)
        return rows.withColumn("prediction", sum((w * F.col(n) for w, n in zip(self.weights, names, strict=True)), F.lit(0.0))).drop(*names)

    def importance(self) -> list[tuple[str, float]]:
        """Mean over the members, each scaled to a total of one; members without any are left out."""
        scaled = []
        for _, m in self.members:
            own = dict(m.importance())
            if sum(own.values()) > 0:
                scaled.append({c: v / sum(own.values()) for c, v in own.items()})
        return [(c, sum(x.get(c, 0.0) for x in scaled) / len(scaled)) for c in scaled[0]] if scaled else []


def last_share(rows: DataFrame, share: float, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """rows before, and within, their last share by date and symbol (least rows at least). Positions are counts of earlier dates and places
    within a date; the window over dates has a row per date."""
    days = rows.groupBy("date").agg(F.count("*").alias("n_")).withColumn("before_", F.sum("n_").over(Window.orderBy("date")) - F.col("n_"))
    placed = rows.join(days.select("date", "before_").hint("merge"), "date").withColumn("at_", F.col("before_") + F.row_number().over(Window.partitionBy("date").orderBy("symbol")))
    n = rows.count()
    edge = n - max(least, int(n * share))
    return tuple(placed.filter(c).select(*rows.columns) for c in (F.col("at_") <= edge, F.col("at_") > edge))


def ensemble(train, columns, members: dict[str, dict], weighting: str = "ic", share: float = 0.2, floor: float = 0.05):
    """Members (name to parameters), equally weighted or by their rank IC on the last share of the training rows, by date, on which they
    are not fitted; then all are fitted again on all rows. Under 50 rows the weights are equal."""
    if not members or weighting not in ("equal", "ic"):
        raise ValueError("an ensemble needs members, and equal or ic weighting")
    weights = {k: 1 / len(members) for k in members}
    if weighting == "ic" and train.count() >= 50:
        early, late = last_share(train, share)
        tried = [REGISTRY[k](early, columns, **params).predict(late).select(*ID, F.lit(k).alias("model"), "target", "prediction") for k, params in members.items()]
        weights = {r["model"]: r["weight"] for r in ic_weights(reduce(DataFrame.unionByName, tried), floor).collect()}
    return Ensemble([(k, REGISTRY[k](train, columns, **params)) for k, params in members.items()], [weights[k] for k in members])


register("ensemble", ensemble)


def ic_weights(validation: DataFrame, floor: float = 0.05) -> DataFrame:
    """(model, weight): non-negative rank IC plus a floor, adding up to one; equal if none is positive. Under 10 rows, or without variation,
    a model's IC counts as 0."""
    ic = regression_metrics(validation, ["model"]).select("model", F.when((F.col("n") >= 10) & F.col("rank_ic").isNotNull(), F.greatest("rank_ic", F.lit(0.0))).otherwise(0.0).alias("w")).withColumn("w", F.col("w") + floor)
    one = ic.agg(F.sum("w").alias("t"), F.count("*").alias("k"))
    return ic.crossJoin(F.broadcast(one)).select("model", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(1 / F.col("k")).alias("weight"))


def combine(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean prediction of the members, as model ensemble. weights has a row per member."""
    return predictions.join(F.broadcast(weights), "model").groupBy(*ID).agg(F.sum(F.col("weight") * F.col("prediction")).alias("prediction"), F.first("target").alias("target")).withColumn("model", F.lit("ensemble"))


# --- drivers ----------------------------------------------------------------------------------------------------------


def _of_kind(specs: dict[str, dict], kinds: tuple[str, ...]) -> dict[str, dict]:
    """Models of these kinds that a user has not registered anew."""
    return {k: v for k, v in specs.items() if k in kinds and REGISTRY[k] is _OWN[k]}


def run_roles(data: DataFrame, roles: DataFrame, specs: dict[str, dict], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions, importances): every model of specs (name to parameters) is fitted on the training dates of each window of roles
    (window_id, date, role) and predicts its test rows. Linear models and trees are fitted for all windows at once; ensembles, and models
    that a user registers, a window at a time, each fit a few jobs over its rows."""
    linears, grown = _of_kind(specs, linear_windows.KINDS), _of_kind(specs, tree_windows.KINDS)
    others = {k: v for k, v in specs.items() if k not in linears and k not in grown}
    rows = cut(data.filter("target is not null"), "rows")
    roles = cut(roles.select("window_id", "date", "role"), "roles")
    spark, parts, weights = data.sparkSession, [], []
    for own, kind, run in ((linears, linear_windows, linear_windows.run_linear), (grown, tree_windows, tree_windows.run_trees)):
        if own:
            p, w = run(rows, roles, [kind.spec(k, k, **v) for k, v in own.items()], columns)
            parts.append(p.select(*ID, "model", "window_id", "target", "prediction"))
            weights.append(w)
    if others:
        found = []
        assigned = cut(rows.join(roles.hint("merge"), "date"), "assigned")  # every fit reads it
        for w in [r["window_id"] for r in roles.select("window_id").distinct().orderBy("window_id").collect()]:
            train, test = (assigned.filter((F.col("window_id") == w) & (F.col("role") == role)) for role in ("train", "test"))
            for name, params in others.items():
                m = REGISTRY[name](train, columns, **params)
                parts.append(m.predict(test).select(*ID, F.lit(name).alias("model"), "window_id", "target", "prediction"))
                found += [(name, w, c, v) for c, v in m.importance()]
        weights.append(spark.createDataFrame(found, f"model string, window_id {dict(roles.dtypes)['window_id']}, feature string, importance double"))
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, weights)


def run_walk_forward(data: DataFrame, windows: DataFrame, specs: dict[str, dict], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """run_roles() over walk-forward windows."""
    return run_roles(data, roles(data.filter("target is not null"), windows), specs, columns)


def run_purged_cv(data: DataFrame, folds: DataFrame, specs: dict[str, dict], columns: list[str], fold: str = "fold") -> DataFrame:
    """Predictions of every fold's test dates from its training dates. folds: (fold, date, role)."""
    p, _ = run_roles(data, folds.select(F.col(fold).alias("window_id"), "date", "role"), specs, columns)
    return p.withColumnRenamed("window_id", fold)

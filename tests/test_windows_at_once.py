"""Ranks, exact percentiles and linear models of all windows against pandas and numpy."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import ranks
from panelwright.operators import evaluate, linear, models, splits

SHARES = [0.0, 0.05, 0.5, 0.913, 1.0]


def test_exact_percentiles_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SELECTED", 400)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), 1.0, rng.gauss(0, 1) ** 9])) for _ in range(6000)] + [("c", 5.0), ("d", None), ("e", 2.0), ("e", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.share): r.p for r in ranks.exact_percentiles(df, ["g"], "v", SHARES, "p").collect()}
    for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("p")).collect():
        assert [got.get((r.g, s)) for s in SHARES] == (list(r.p) if r.p else [None] * 5)
    assert ranks.exact_percentiles(df.filter("false"), [], "v", [0.5]).count() == 0
    assert ranks.exact_percentiles(df, [], "v", [0.5]).first().percentile == df.agg(F.percentile("v", 0.5)).first()[0]
    with pytest.raises(ValueError):
        ranks.exact_percentiles(df, [], "v", [1.5])


def test_ranks_and_positions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), 1.0, -2.0]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "at string, n double, i long").repartition(7)
    pdf = pd.DataFrame(rows, columns=["g", "v", "i"]).fillna({"g": ""})
    got = ranks.doubled_ranks(df, ["at"], "n", "r").toPandas().set_index("i").r.sort_index()
    by = pdf.groupby("g").v
    assert (got.to_numpy() == (2 * by.rank() - by.transform("count") - 1).to_numpy()).all()
    got = ranks.running_totals(df, ["at"], ["n", "i"], "before").toPandas().set_index("i").before.sort_index()
    assert (got.to_numpy() == pdf.sort_values(["v", "i"]).groupby("g").cumcount().sort_index().to_numpy()).all()


def test_rank_correlation_of_a_model_with_ties(spark):
    p = spark.createDataFrame([("m", float(i % 7), float(i)) for i in range(50)], "model string, prediction double, target double")
    got = evaluate.regression_metrics(p, ["model"]).first()
    frame = pd.DataFrame([(i % 7, i) for i in range(50)], columns=["p", "t"])
    assert abs(got.rank_ic - frame.corr(method="spearman").iloc[0, 1]) < 1e-12


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        for j in range(6):
            x = [float(rng.normal(3 * c, 1 + c)) for c in range(3)]
            y = None if rng.random() < 0.05 else 0.4 * x[0] - 0.2 * x[1] + float(rng.normal())
            if rng.random() < 0.1:
                x[1] = None if i < 60 else float("nan")
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(i), f"s{j}", *x, 1.5, y))
    return spark.createDataFrame(rows, "date date, symbol string, a double, b double, c double, k double, target double")


def objective(z, y, w, l1, l2):
    return ((y - z @ w) ** 2).mean() / 2 + l1 * np.abs(w).sum() + l2 / 2 * (w**2).sum()


def test_linear_models_of_all_windows(spark, panel):
    columns = ["a", "b", "c", "k"]
    windows = splits.walk_forward(panel.select("date"), min_train=40, test=20, step=20, embargo=2)
    roles = splits.roles(panel, windows)
    specs = [linear.spec("linear", "linear"), linear.spec("ridge", "ridge"), linear.spec("lasso", "lasso", 0.05), linear.spec("net", "elastic_net", 0.1)]
    found, sizes = linear.run_linear(panel, roles, specs, columns)
    got, sizes, frame, parts = found.toPandas(), sizes.toPandas(), panel.toPandas(), roles.toPandas()
    assert got.groupby("model").size().nunique() == 1 and set(sizes.feature) == set(columns)
    for (window, model), g in got.groupby(["window_id", "model"]):
        train = frame[frame.date.isin(parts[(parts.window_id == window) & (parts.role == "train")].date)].dropna(subset=["target"])
        x = train[columns].astype(float)
        x = x.fillna(x.median())
        mean, sd = x.mean(), x.std(ddof=0).mask(lambda s: s < 1e-9, 1.0)
        z, y, n = ((x - mean) / sd).to_numpy(), train.target.to_numpy() - train.target.mean(), len(x)
        test = g.merge(frame.drop(columns="target"), on=["date", "symbol"])
        zt = ((test[columns].astype(float).fillna(train[columns].astype(float).median()) - mean) / sd).to_numpy()
        l1, l2 = {"linear": (0, 0), "ridge": (0, 10 / n), "lasso": (0.05, 0), "net": (0.05, 0.05)}[model]
        w = np.linalg.lstsq(zt, test.prediction.to_numpy() - train.target.mean(), rcond=None)[0]  # weights back from predictions
        w[np.abs(w) < 1e-10] = 0.0
        assert np.abs(zt @ w + train.target.mean() - test.prediction).max() < 1e-9
        assert np.abs(np.abs(w) - sizes[(sizes.window_id == window) & (sizes.model == model)].set_index("feature").importance[columns].to_numpy()).max() < 1e-9
        slope = z.T @ (y - z @ w) / n - l2 * w  # optimality
        assert np.abs(slope[w != 0] - l1 * np.sign(w[w != 0])).max() < 1e-9 and np.abs(slope).max() <= l1 + 1e-9
        assert objective(z, y, w, l1, l2) <= objective(z, y, w + 1e-3, l1, l2)


def test_drivers_share_windows(spark, panel):
    folds = splits.purged_kfold(panel.select("date"), 3, purge=2, embargo=1)
    p = models.run_purged_cv(panel, folds, {"ridge": {"alpha": 1.0}}, ["a", "c"])
    assert p.columns == ["date", "symbol", "model", "fold", "target", "prediction"]
    assert p.count() == panel.filter("target is not null").count()


def test_roles_by_position_equal_comparison(spark, panel):
    windows = spark.createDataFrame([(0, dt.date(2019, 1, 1), dt.date(2020, 1, 9), dt.date(2020, 1, 12), dt.date(2020, 1, 20)), (1, dt.date(2020, 1, 5), dt.date(2020, 2, 1), dt.date(2020, 1, 25), dt.date(2030, 1, 1)),
                                     (2, dt.date(2021, 1, 1), dt.date(2021, 2, 1), dt.date(2021, 2, 2), dt.date(2021, 3, 1))], "window_id int, train_start date, train_end date, test_start date, test_end date")
    got = splits.assign(panel.select("date", "symbol"), windows)
    want = panel.select("date", "symbol").join(windows, F.expr("date between train_start and train_end or date between test_start and test_end")).selectExpr("date", "symbol", "window_id", "CASE WHEN date BETWEEN train_start AND train_end THEN 'train' ELSE 'test' END AS role")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()

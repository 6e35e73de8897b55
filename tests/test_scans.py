"""Scans, unranked choices and prefix bootstraps against plain loops."""

import datetime as dt
import hashlib
import itertools

import numpy as np
import pytest

from panelwright.functions.choices import combinations
from panelwright.operators import evaluate, regimes, splits


def days(n):
    return [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(n)]


def recursion(x, p):
    prob, out = p[6], []
    for i, v in enumerate(x):
        one = prob if i == 0 else (1 - prob) * (1 - p[4]) + prob * p[5]
        a, b = ((1 - one) * np.exp(-0.5 * ((v - p[0]) / p[2]) ** 2) / p[2], one * np.exp(-0.5 * ((v - p[1]) / p[3]) ** 2) / p[3])
        prob = b / (a + b) if a + b > 0 else prob
        out.append(prob)
    return out


NAMES = "series string, mu0 double, mu1 double, sd0 double, sd1 double, p00 double, p11 double, pi1 double, block_start date"


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_stress_over_blocks_equals_the_recursion(spark, monkeypatch, block):
    monkeypatch.setattr(regimes, "BLOCK", block)
    rng = np.random.default_rng(block)
    x = {s: rng.normal(0, 0.02, 90) for s in ("x", "y")}
    x["x"][40:43] = 9.0  # neither state can give these
    rows = [(s, d, float(v), 1) for s in x for d, v in zip(days(90), x[s])] + [("x", days(91)[90], None, 1), ("z", days(1)[0], 0.1, 1), (None, days(1)[0], 0.1, 1)]
    one, two, three = (0.0, 0.001, 0.01, 0.03, 0.95, 0.9, 0.3), (0.0, 0.0, 0.005, 0.05, 0.8, 0.7, 0.5), (0.0, 0.0, 0.02, 0.05, 0.99, 0.6, 0.0)
    params = [("x", *one, None), ("x", *two, days(90)[25]), ("x", *three, days(90)[60]), ("y", *two, days(90)[30])]
    got = regimes.causal_stress(spark.createDataFrame(rows, "series string, date date, r double, block int").repartition(5), spark.createDataFrame(params, NAMES)).toPandas()
    assert got.groupby("series").size().to_dict() == {"x": 90, "y": 60}
    mine = got[got.series == "x"].sort_values("date").stress.to_numpy()
    want = np.concatenate((recursion(x["x"], one)[:25], recursion(x["x"], two)[25:60], recursion(x["x"], three)[60:]))
    assert np.abs(mine - want).max() < 1e-9
    assert np.abs(got[got.series == "y"].sort_values("date").stress.to_numpy() - recursion(x["y"], two)[30:]).max() < 1e-9


def test_a_long_series(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("'s' AS series", "date_add(date '1500-01-01', cast(id AS int)) AS date", "sin(id * id) * 0.02 AS r")
    params = spark.createDataFrame([("s", 0.0, 0.0, 0.01, 0.03, 0.95, 0.9, 0.3)], NAMES.rsplit(", ", 1)[0])
    got = regimes.filtered_probabilities(rows, params).toPandas().sort_values("date").stress.to_numpy()
    r = rows.toPandas().sort_values("date").r.to_numpy()
    assert len(got) == n and np.abs(got - recursion(r, (0.0, 0.0, 0.01, 0.03, 0.95, 0.9, 0.3))).max() < 1e-9


@pytest.mark.parametrize("n,k", [(6, 3), (7, 2), (5, 5), (5, 0), (9, 4), (1, 1)])
def test_choices(spark, n, k):
    got = [tuple(r.chosen) for r in combinations(spark, n, k).orderBy("combo").collect()]
    assert got == list(itertools.combinations(range(n), k))


def test_bounded_choices(spark):
    every = {r.combo: r.chosen for r in combinations(spark, 16, 8).collect()}
    some = combinations(spark, 16, 8, 100).collect()
    assert len(every) == 12870 and len(some) == 100 and all(every[r.combo] == r.chosen for r in some)
    order = sorted(every, key=lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i))
    assert {r.combo for r in some} == set(order[:100])
    with pytest.raises(ValueError):
        combinations(spark, 61, 2)


def test_overfitting_of_half_the_choices(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(0, 0.01, (200, 6))
    table = spark.createDataFrame([(d, f"s{j}", float(r[i, j])) for i, d in enumerate(days(200)) for j in range(6)], "date date, strategy string, r double")
    whole, part = evaluate.overfitting_probability(table, 6).first(), evaluate.overfitting_probability(table, 6, 10).first()
    assert whole.combinations == 20 and part.combinations == 10 and 0 <= part.pbo <= 1


@pytest.mark.parametrize("values", [np.random.default_rng(1).normal(0, 0.02, 57), np.array([0.1, -0.2, 0.05]), np.array([-1.0, 0.5, 0.2, 0.1] * 6), np.array([-1.5, 0.5, 0.2, 0.1] * 6), np.array([0.3])])
def test_bootstrap_equals_resampled_rows(spark, values):
    n, starts = len(values), lambda k, b: int(hashlib.md5(f"7|{k}|{b}".encode()).hexdigest()[:8], 16) % n
    a, s = [], []
    for k in range(60):
        x = np.concatenate([np.take(values, np.arange(starts(k, b), starts(k, b) + 20), mode="wrap") for b in range(-(-n // 20))])[:n]
        a.append(max(np.prod(1 + x), 0) ** (252 / n) - 1)
        s.append(x.mean() / x.std(ddof=1) * 252**0.5 if n > 1 and x.std(ddof=1) > 1e-12 else np.nan)
    got = evaluate.bootstrap(spark.createDataFrame([(d, float(v)) for d, v in zip(days(n), values)] + [(days(99)[98], None)], "date date, r double"), 60, 20).first()
    want = [*np.quantile(a, [0.05, 0.5, 0.95]), *(np.nanquantile(s, [0.05, 0.5, 0.95]) if np.isfinite(s).any() else [None] * 3)]
    assert all((g is None and w is None) or abs(g - w) < 1e-6 * max(1, abs(w)) for g, w in zip(got, want))


def test_bootstrap_of_nothing_and_combinatorial_folds(spark):
    assert set(evaluate.bootstrap(spark.createDataFrame([], "date date, r double")).first()) == {None}
    dates = spark.createDataFrame([(d,) for d in days(50)], "date date")
    got = {(r.split_id, r.date): r.role for r in splits.combinatorial(dates, 5, 2, purge=2, embargo=1).collect()}
    for i, pair in enumerate(itertools.combinations(range(5), 2)):
        for at, d in enumerate(days(50)):
            role = "test" if at // 10 in pair else None if any(10 * g - 2 <= at <= 10 * g + 9 + 3 for g in pair) else "train"
            assert got.get((i, d)) == role

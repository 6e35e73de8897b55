"""Trees of all windows against trees grown one by one in numpy."""

import datetime as dt

import numpy as np
import pytest

from panelwright.operators import models, splits, trees

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(100):
        for j in range(5):
            x = [float(v) for v in rng.normal(size=2)] + [float(rng.integers(0, 4))]
            y = 2.0 * (x[0] > 0.3) + (x[1] > 0) * (x[0] < 0) - x[2] * 0.3 + float(rng.normal()) * 0.1
            if rng.random() < 0.1:
                x[1] = None if i % 2 else float("nan")
            out.append((dt.date(2020, 1, 1) + dt.timedelta(i), f"s{j}", *x, None if rng.random() < 0.03 else y))
    return spark.createDataFrame(out, "date date, symbol string, a double, b double, c double, target double")


@pytest.fixture(scope="module")
def roles(rows):
    return splits.roles(rows, splits.walk_forward(rows.select("date"), min_train=50, test=20, step=20, embargo=2))


def grow(bins, rest, n, depth, leaf):
    """A tree as nested tuples (feature, bin, left, right) or values: the best split of every node, ties to the first feature and bin."""

    def node(some, level):
        total, count = (n[some] * rest[some]).sum(), n[some].sum()
        best = None
        if level < depth:
            for f in range(bins.shape[1]):
                for b in range(trees.BINS + 2):
                    left = some[bins[some, f] <= b]
                    nl = n[left].sum()
                    if nl < leaf or count - nl < leaf or nl == count:
                        continue
                    sl = (n[left] * rest[left]).sum()
                    gain = round(sl * sl / nl + (total - sl) ** 2 / (count - nl) - total * total / count, 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b)
        if best is None:
            return total / count
        _, f, b = best
        return f, b, node(some[bins[some, f] <= b], level + 1), node(some[bins[some, f] > b], level + 1)

    return node(np.flatnonzero(n > 0), 0)


def value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_boosting_and_forest_equal_trees_grown_one_by_one(spark, rows, roles, monkeypatch):
    monkeypatch.setattr(trees, "REFRESH", 3)
    monkeypatch.setattr(trees, "FLUSH", 100)
    monkeypatch.setattr(trees, "CELLS", 9 * 3 * 4 * 65 * 3)
    boost, forest = trees.spec("gb", "gradient_boosting", rounds=7, depth=3, rate=0.3, leaf=4), trees.spec("rf", "random_forest", trees=4, depth=3, leaf=6, seed=5)
    found, sizes = trees.run_trees(rows, roles, [boost, forest], COLUMNS)
    got, again = found.toPandas(), trees.run_trees(rows, roles, [forest], COLUMNS)[0].toPandas()
    assert got.groupby("model").size().nunique() == 1 and abs(sizes.toPandas().groupby(["model", "window_id"]).importance.sum() - 1).max() < 1e-9
    both = got[got.model == "rf"].merge(again, on=["date", "symbol", "window_id"])
    assert abs(both.prediction_x - both.prediction_y).max() < 1e-12
    joined = rows.filter("target is not null").join(roles, "date")
    train = joined.filter("role = 'train'")
    edges = trees.bin_edges(train, COLUMNS)
    parts = {}
    for r in trees.binned(joined.selectExpr("*", "target AS y"), edges, COLUMNS, ["role", "y", "date", "symbol"]).collect():
        parts.setdefault(r.window_id, []).append(r)
    for w, part in parts.items():
        own = [r for r in part if r.role == "train"]
        bins, y, keys = np.array([list(r.bins) for r in own]), np.array([r.y for r in own]), np.array([r.key for r in own])
        rest, grown = y - y.mean(), []
        for _ in range(7):
            t = grow(bins, rest, np.ones(len(y)), 3, 4)
            rest = rest - 0.3 * np.array([value(t, b) for b in bins])
            grown.append(t)
        bag = [grow(bins, y, trees.sample_counts(keys, k, 5), 3, 6) for k in range(4)]
        mine = {(r.model, r.date, r.symbol): r.prediction for r in got[got.window_id == w].itertuples()}
        for r in part:
            if r.role == "test":
                b = list(r.bins)
                assert abs(mine["gb", r.date, r.symbol] - y.mean() - 0.3 * sum(value(t, b) for t in grown)) < 1e-9
                assert abs(mine["rf", r.date, r.symbol] - np.mean([value(t, b) for t in bag])) < 1e-9


def test_bins_and_samples(spark, rows):
    edges = {0: [np.array([1.0, 2.0]), np.array([]), np.array([0.0])]}
    data = spark.createDataFrame([(0, dt.date(2020, 1, 1), "s", 1.0, 5.0, None), (0, dt.date(2020, 1, 1), "s", 1.5, None, float("nan")), (0, dt.date(2020, 1, 1), "s", 9.0, float("inf"), 0.5)], "window_id int, date date, symbol string, a double, b double, c double")
    assert [list(r.bins) for r in trees.binned(data, edges, COLUMNS, []).collect()] == [[1, 1, 0], [2, 0, 0], [3, 0, 2]]
    counts = trees.sample_counts(np.arange(200_000), 3, 7)
    assert abs(counts.mean() - 1) < 0.01 and abs((counts == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(counts, trees.sample_counts(np.arange(200_000), 4, 7))[0, 1]) < 0.01


def test_drivers_grow_trees_for_all_windows(spark, rows, roles):
    p, w = models.run_roles(rows, roles, {"random_forest": {"trees": 2, "depth": 2, "leaf": 5}, "ridge": {}}, COLUMNS)
    assert {r.model for r in p.select("model").distinct().collect()} == {"random_forest", "ridge"} and w.columns == ["model", "window_id", "feature", "importance"]
    with pytest.raises(ValueError):
        trees.spec("x", "linear")

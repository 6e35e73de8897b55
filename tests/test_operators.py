"""Hand-worked cases and properties of the operators."""

import datetime as dt
import hashlib
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import windows
from panelwright.operators import capacity, evaluate, features, ledger, models, regimes, risk, signals, splits
from panelwright.operators.labels import build_labels
from panelwright.sources import contract, panels

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in ("AAA", "BBB", "BENCH"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 90)))
        rows += [(d, s, float(c), float(c * 1.01), float(c * 0.99), float(c), float(v)) for d, c, v in zip(days(90), close, rng.integers(900, 1100, 90))]
    return spark.createDataFrame(rows, "date date, symbol string, open double, high double, low double, close double, volume double")


def test_features_do_not_look_ahead(spark, walk):
    config = {"macd": {"fast": 6, "slow": 13, "signal": 5}, "regime_vol_window": 5}
    changed = walk.withColumns({c: F.when(F.col("date") > days(90)[60], F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    a, b = (features.build_features(p, "BENCH", config).filter(F.col("date") <= days(90)[60]).orderBy("symbol", "date").toPandas() for p in (walk, changed))
    pd.testing.assert_frame_equal(a, b)


def test_ewm_equals_pandas(spark):
    rng = np.random.default_rng(8)
    missing = lambda s, i: s == "b" and (i < 3 or i % 7 == 2)
    rows = [(days(3000)[i], s, (None, float("nan"))[i % 2] if missing(s, i) else float(x)) for s in "ab" for i, x in enumerate(100 + np.cumsum(rng.normal(size=3000)))]
    spans = {"short": 2 / 27, "mid": 2 / 201, "long": 2 / 1001, "longest": 2 / 3001, "quick": 0.99, "last": 1.0}
    df = spark.createDataFrame(rows, "date date, symbol string, v double")
    got = windows.ewm_means(df, {k: ("v", a) for k, a in spans.items()}).toPandas()
    for s in "ab":
        one = got[got.symbol == s].sort_values("date")
        for k, a in spans.items():
            want = one["v"].ffill() if a == 1 else one["v"].ewm(alpha=a).mean()
            assert np.allclose(one[k], want, rtol=1e-9, equal_nan=True), (s, k)
    with pytest.raises(ValueError):
        windows.ewm_means(df, {"x": ("v", 0.0)})


def test_expanding_rank_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(days(300)[i], s, None if rng.random() < 0.1 else float(rng.integers(0, 25))) for s, n in (("a", 300), ("b", 37), ("c", 1)) for i in range(n)]
    got = windows.expanding_rank(spark.createDataFrame(rows, "date date, symbol string, v double"), "v", "p", "n").toPandas()
    for s in "abc":
        seen = []
        for r in got[got.symbol == s].sort_values("date").itertuples():
            if np.isnan(r.v):
                assert np.isnan(r.p)
                continue
            seen.append(r.v)
            x = np.array(seen)
            assert r.n == len(x) and abs(r.p - ((x < r.v).sum() + ((x == r.v).sum() + 1) / 2) / len(x)) < 1e-12


def test_rank_correlation_of_zero_is_zero(spark):
    p = spark.createDataFrame([("m", days(1)[0], a, b) for a, b in ((1.1, 0.3), (1.1, 0.1), (2.7, 0.1), (2.7, 0.3), (5.3, 0.2))], "model string, date date, prediction double, target double")
    assert evaluate.ic_by_date(p).first().rank_ic == 0.0


def test_labels_are_forward_returns(walk):
    got = build_labels(walk, "BENCH", (1, 5), 5).filter("symbol = 'AAA'").orderBy("date").toPandas()
    close = walk.filter("symbol = 'AAA'").orderBy("date").toPandas()["close"]
    assert np.allclose(got["fwd_ret_5"].dropna(), (close.shift(-5) / close - 1).dropna()) and got["fwd_vol_1"].isna().all()


def test_sequences_and_regime_probability(spark, walk):
    s = features.sequences(walk, ["close", "volume"], 5)
    assert s.count() == 3 * 86
    r = walk.select(F.col("symbol").alias("series"), "date", features.k_return(1).alias("r"))
    p = spark.createDataFrame([(n, 0.0, 0.0, 0.005, 0.02, 0.95, 0.9, 0.3) for n in ("AAA", "BBB")], "series string, mu0 double, mu1 double, sd0 double, sd1 double, p00 double, p11 double, pi1 double")
    got = regimes.filtered_probabilities(r, p).filter("series = 'AAA'").orderBy("date").toPandas()
    x = r.filter("series = 'AAA' and r is not null").orderBy("date").toPandas()["r"]
    prob, out = 0.3, []
    for i, v in enumerate(x):
        one = prob if i == 0 else (1 - prob) * 0.05 + prob * 0.9
        a, b = ((1 - one) * np.exp(-0.5 * (v / 0.005) ** 2) / 0.005, one * np.exp(-0.5 * (v / 0.02) ** 2) / 0.02)
        prob = b / (a + b)
        out.append(prob)
    assert np.allclose(got["stress"], out)


def test_splits_keep_their_distance(spark):
    dates = spark.createDataFrame([(d,) for d in days(220)], "date date")
    for w in splits.walk_forward(dates, min_train=100, test=40, step=40, embargo=5, max_horizon=5).collect():
        assert (w.test_start - w.train_end).days == 6
    with pytest.raises(ValueError):
        splits.walk_forward(dates, min_train=100, test=40, step=40, embargo=3, max_horizon=5)
    folds = splits.purged_kfold(dates, 5, purge=3, embargo=2).toPandas()
    for _, f in folds.groupby("fold"):
        test, train = set(f[f.role == "test"].date), set(f[f.role == "train"].date)
        assert min(abs((a - b).days) for a in test for b in train) > 3
    assert splits.combinatorial(dates, 6, 2).select("split_id").distinct().count() == 15


def test_signals_and_caps(spark):
    p = spark.createDataFrame([(DAY, f"S{i:02d}", i - 4.5) for i in range(10)], "date date, symbol string, prediction double")
    s = signals.build_signals(p, "long_short", quantile=0.2)
    assert sorted(r.signal for r in s.collect()) == [-1.0] * 2 + [0.0] * 6 + [1.0] * 2
    w = signals.uncapped_weights(s, max_weight=0.2)
    assert abs(sum(abs(r.target_weight) for r in w.collect()) - 0.8) < 1e-12
    stress = spark.createDataFrame([(DAY, "S00", 0.25)], "date date, symbol string, hmm_stress_prob double")
    assert max(r.signal for r in signals.regime_filter(s, stress).collect()) == 0.75
    two = spark.createDataFrame([(DAY, "A", 1.0), (days(2)[1], "A", 0.0)], "date date, symbol string, target_weight double")
    assert [round(r.target_weight, 12) for r in signals.turnover_cap(two, 0.25).orderBy("date").collect()] == [1.0, 0.75]


def test_fill_costs_and_rejection(spark):
    o = spark.createDataFrame([("A", 100.0, 10.0, 500.0, 0.02), ("B", -10.0, 20.0, 500.0, None), ("C", 5.0, 10.0, None, None)], "symbol string, requested_shares double, price double, adv double, vol double")
    f = {r.symbol: r for r in ledger.fill(o, ledger.Costs(1, 2, 3), ledger.Policy(max_participation_rate=0.1, impact_coefficient=0.1)).collect()}
    assert f["A"].filled_shares == 50 and f["A"].status == "partial" and abs(f["A"].impact_bps - 0.1 * 0.02 * 1e4 * 0.1 ** 0.5) < 1e-9
    assert f["B"].status == "filled" and abs(f["B"].fill_price - 20 * (1 - 5e-4)) < 1e-12 and abs(f["B"].commission - 0.02) < 1e-12
    assert f["C"].status == "rejected" and f["C"].filled_shares == 0


def test_order_sizing(spark):
    held = spark.createDataFrame([("k", "A", 4.0)], "key string, symbol string, shares double")
    want = spark.createDataFrame([("k", "A", 0.5, 125.0), ("k", "B", -0.25, 50.0)], "key string, symbol string, target_weight double, price double")
    got = {r.symbol: r.requested_shares for r in ledger.size_orders(held, want, 1100.0).collect()}
    assert abs(got["A"] - 0.4) < 1e-12 and abs(got["B"] + 5.5) < 1e-12


def test_replay_does_not_earn_the_gap_before_the_fill(spark):
    panel = spark.createDataFrame([(d, "AAA", o, c, 1e9) for d, (o, c) in zip(days(3), [(100.0, 100.0), (200.0, 200.0), (220.0, 220.0)])], "date date, symbol string, open double, close double, adv double")
    target = spark.createDataFrame([("p", DAY, "AAA", 1.0)], "portfolio string, date date, symbol string, target_weight double")
    runs = spark.createDataFrame([("free", 0.0, None), ("dear", 10.0, None)], "scenario string, cost_bps double, cap double")
    got = ledger.replay(panel, target, runs, cash=1000.0).orderBy("scenario", "date").toPandas()
    assert np.allclose(got[got.scenario == "free"].equity, [1000, 1000, 1100]) and got[got.scenario == "dear"].equity.iloc[1] == 999


def test_positions_reconcile(spark):
    panel = spark.createDataFrame([(d, s, 10.0 + i, 10.5 + i) for i, d in enumerate(days(4)) for s in ("A", "B")], "date date, symbol string, open double, close double")
    fills = spark.createDataFrame([(days(4)[0], "A", 5.0, 10.0, 10.01, 0.1), (days(4)[2], "A", -2.0, 12.0, 11.99, 0.1), (days(4)[1], "B", -3.0, 11.0, 10.98, 0.1)], "date date, symbol string, filled_shares double, price double, fill_price double, commission double")
    held, equity = ledger.positions(fills, panel, 1000.0)
    attributed = ledger.attribution(held, fills, panel)
    assert ledger.reconcile(attributed, equity, 1000.0).count() == 0
    assert [r.date for r in ledger.reconcile(attributed.withColumn("net_pnl", F.col("net_pnl") + F.when(F.col("date") == days(4)[2], 0.01).otherwise(0.0)), equity, 1000.0).collect()] == [days(4)[2]]
    # every session has an equity, a symbol is held from its first fill on
    assert equity.count() == 4 and {(r.symbol, r.n) for r in held.groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {("A", 4), ("B", 3)}
    late = ledger.positions(fills.filter("symbol = 'B'"), panel, 1000.0)[1].orderBy("date").first()
    assert (late.date, late.equity, late.market_value) == (days(4)[0], 1000.0, 0.0)


def test_capacity_curve(spark):
    tr = spark.createDataFrame([(DAY, "A", 100.0, 90.0, 1000.0, 0.09), (DAY, "B", -130.0, -110.0, 500.0, 0.2)], "date date, symbol string, desired_notional double, traded_notional double, lagged_adv_notional double, total_cost double")
    got = capacity.curve(capacity.scenarios(tr, spark.createDataFrame([(0.5e6,), (1e6,), (4e6,)], "aum double"), reference_aum=1e6)).orderBy("aum").toPandas()
    assert got.fill_ratio.is_monotonic_decreasing and abs(got.fill_ratio[0] - (45 + 50) / 115) < 1e-12


def test_ridge_equals_normal_equations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2] + 2
    y = x @ [0.5, -0.1, 2] + rng.normal(size=300)
    data = spark.createDataFrame([(DAY, f"s{i}", *map(float, x[i]), float(y[i])) for i in range(300)], "date date, symbol string, a double, b double, c double, target double")
    m = models.ridge(data, ["a", "b", "c"], alpha=10.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(m.model.coefficients.toArray(), w, atol=1e-6)


def fitted_rows(spark, n=300):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + 2
    y = x @ [0.5, -0.1, 2] + rng.normal(size=n)
    return x, y, spark.createDataFrame([(days(n)[i // 3], f"s{i % 3}", *map(float, x[i]), float(y[i])) for i in range(n)], "date date, symbol string, a double, b double, c double, target double")


def test_lasso_and_elastic_net_satisfy_their_conditions(spark):
    """At the optimum of mean squared error / 2 + l1 |w| + l2 |w|^2 / 2 the gradient balances the penalty."""
    x, y, data = fitted_rows(spark)
    z = (x - x.mean(0)) / x.std(0)
    for fit, l1, l2 in ((models.lasso(data, ["a", "b", "c"], alpha=0.45), 0.45, 0.0), (models.elastic_net(data, ["a", "b", "c"], alpha=0.4, l1_ratio=0.5), 0.2, 0.2)):
        w = fit.model.coefficients.toArray()
        pull = z.T @ (y - y.mean() - z @ w) / len(y) - l2 * w
        assert (np.abs(pull) <= l1 + 1e-5).all() and np.allclose(pull[w != 0], l1 * np.sign(w[w != 0]), atol=1e-4)
    assert (models.lasso(data, ["a", "b", "c"], alpha=0.45).model.coefficients.toArray() == 0).any()


def test_ensemble_weighs_on_its_last_rows(spark):
    x, y, data = fitted_rows(spark)
    columns = ["a", "b", "c"]
    early, late = models.last_share(data, 0.2)
    assert (early.count(), late.count()) == (240, 60) and early.agg(F.max("date")).first()[0] <= late.agg(F.min("date")).first()[0]
    members = {"ridge": {"alpha": 1.0}, "gradient_boosting": {"rounds": 3, "depth": 2}}
    e = models.ensemble(data, columns, members)
    ics = []
    for k, params in members.items():
        p = models.REGISTRY[k](early, columns, **params).predict(late).select("prediction", "target").toPandas()
        ics.append(max(p["prediction"].rank().corr(p["target"].rank()), 0) + 0.05)
    assert np.allclose(e.weights, np.array(ics) / sum(ics), atol=1e-9) and e.weights[0] != e.weights[1]
    out = e.predict(data).orderBy("date", "symbol").toPandas()
    parts = [m.predict(data).orderBy("date", "symbol").toPandas()["prediction"] for _, m in e.members]
    assert np.allclose(out["prediction"], e.weights[0] * parts[0] + e.weights[1] * parts[1]) and abs(sum(v for _, v in e.importance()) - 1) < 1e-9
    with pytest.raises(ValueError):
        models.ensemble(data, columns, {})


def test_sharpe_probabilities(spark):
    rng = np.random.default_rng(6)
    r = rng.standard_t(5, 250) * 0.01 + 0.0008
    got = evaluate.deflated_sharpe(spark.createDataFrame([("s", float(x)) for x in r], "s string, r double"), ["s"], 25).first()
    z, sharpe = (r - r.mean()) / r.std(), r.mean() / r.std(ddof=1)
    unit = np.sqrt(len(r) - 1) / np.sqrt(1 - (z**3).mean() * sharpe + ((z**4).mean() - 1) / 4 * sharpe**2)
    top = np.sqrt(1 / (len(r) - 1)) * evaluate.expected_max_sharpe(25, 1.0)
    assert abs(got.sharpe - sharpe) < 1e-12 and abs(got.psr - NormalDist().cdf(sharpe * unit)) < 1e-9 and abs(got.deflated_sharpe_prob - NormalDist().cdf((sharpe - top) * unit)) < 1e-9
    xs = [float(x) for x in np.linspace(-12, 12, 97)] + [float("nan"), None]
    found = [row[0] for row in spark.createDataFrame([(x,) for x in xs], "x double").select(evaluate.normal_cdf(F.col("x"))).collect()]
    assert np.allclose(found[:97], [NormalDist().cdf(x) for x in xs[:97]], rtol=1e-9, atol=1e-15) and found[97:] == [None, None]


def test_named_gates(spark):
    row = spark.createDataFrame([(300, 0.99, 0.1, -0.1, 0.05, 0.2, True, True, True, False)], "n_days int, deflated_sharpe_prob double, pbo double, max_drawdown double, annual_excess_return double, average_turnover double, point_in_time_complete boolean, accounting_reconciled boolean, stress_passed boolean, signed_off boolean")
    assert risk.readiness(row).first().decision == "READY_FOR_PAPER"
    assert risk.readiness(row, more={"review": "signed_off"}).first().failed_gates == ["review"]
    for more in ({"drawdown": "signed_off"}, {" ": "signed_off"}, {"review": "n_days"}):
        with pytest.raises(ValueError):
            risk.readiness(row, more=more)


def test_placebo_moves_rows(spark):
    rows = [("m", d, f"s{i}", float(i)) for d in days(6) for i in range(9)]
    got = evaluate.placebo(spark.createDataFrame(rows, "model string, date date, symbol string, prediction double")).toPandas()
    assert len(got) == 54 and (got["prediction"] != got["symbol"].str[1:].astype(float)).mean() > 0.6
    assert (got.groupby("date")["prediction"].apply(sorted).apply(lambda x: x == [float(i) for i in range(9)])).all() and got.groupby("symbol")["prediction"].nunique().max() > 1


def test_causal_stress_uses_parameters_of_its_block(spark):
    rng = np.random.default_rng(10)
    r = spark.createDataFrame([("x", d, float(v)) for d, v in zip(days(40), rng.normal(0, 0.02, 40))], "series string, date date, r double")
    names = "series string, mu0 double, mu1 double, sd0 double, sd1 double, p00 double, p11 double, pi1 double"
    one, two = ("x", 0.0, 0.0, 0.01, 0.03, 0.95, 0.9, 0.3), ("x", 0.0, 0.0, 0.005, 0.05, 0.8, 0.7, 0.5)
    got = regimes.causal_stress(r, spark.createDataFrame([(*one, days(40)[0]), (*two, days(40)[25])], names + ", block_start date")).orderBy("date").toPandas()
    a, b = (regimes.filtered_probabilities(r, spark.createDataFrame([p], names)).orderBy("date").toPandas()["stress"] for p in (one, two))
    assert len(got) == 40 and np.allclose(got["stress"], np.concatenate((a[:25], b[25:])))


def test_newey_west_and_overfitting(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0.05, 1, 200)
    got = evaluate.newey_west(spark.createDataFrame([("m", d, float(x)) for d, x in zip(days(200), v)], "model string, date date, v double"), "v", ["model"]).first()
    e, lags = v - v.mean(), int(4 * (200 / 100) ** (2 / 9))
    var = (e @ e) / 200 + sum(2 * (1 - k / (lags + 1)) * np.mean(e[k:] * e[:-k]) for k in range(1, lags + 1))
    assert abs(got.t_stat - v.mean() / np.sqrt(var / 200)) < 1e-9
    r = rng.normal(0, 0.01, (200, 6))
    r[:, 2] += 0.01
    p = evaluate.overfitting_probability(spark.createDataFrame([(d, f"s{j}", float(r[i, j])) for i, d in enumerate(days(200)) for j in range(6)], "date date, strategy string, r double"), 6).first()
    assert p.combinations == 20 and p.pbo == 0


def test_validation_and_sources(spark, walk, tmp_path):
    assert contract.validate(walk).count() == 270
    with pytest.raises(ValueError, match="duplicate_key"):
        contract.validate(walk.union(walk.limit(1)))
    (tmp_path / "abc.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-01,10,11,9,10,5,100\n")
    got = panels.load_csv_dir(spark, str(tmp_path)).collect()
    assert [(r.symbol, r.open, r.close) for r in got] == [("ABC", 5.0, 5.0)]
    with pytest.raises(ValueError):
        panels.load_panel(spark, {"source": "web"})
    folder = panels.write_run({"panel": walk}, str(tmp_path), "run1")
    manifest = spark.createDataFrame([("none.parquet", 1, "x")], "path string, rows long, sha256 string")
    assert {r.rule for r in panels.bundle_integrity(spark, folder, manifest).collect()} == {"missing", "surplus"}
    with pytest.raises(Exception, match="exists"):
        panels.write_run({"panel": walk}, str(tmp_path), "run1")
    part = next((tmp_path / "run1" / "panel").glob("*.parquet"))
    whole, n = hashlib.sha256(part.read_bytes()).hexdigest(), spark.read.parquet(str(part)).count()
    for rows, sha, want in ((n, whole, set()), (n + 1, whole, {"rows"}), (n, "0" * 64, {"sha256"})):
        found = panels.bundle_integrity(spark, str(part.parent), spark.createDataFrame([(part.name, rows, sha)], "path string, rows long, sha256 string"))
        assert {r.rule for r in found.filter(F.col("path") == part.name).collect()} == want


def test_digests_by_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(panels, "CHUNK", 1000)
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "bundle with space"))
    part = next((tmp_path / "bundle with space").glob("*.parquet"))
    (part.parent / "broken.parquet").write_bytes(b"no parquet" * 1000)
    (part.parent / "empty.parquet").write_bytes(b"")
    sha = {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in part.parent.glob("*.parquet")}
    manifest = spark.createDataFrame([(part.name, 5000, sha[part.name]), ("broken.parquet", 7, sha["broken.parquet"]), ("empty.parquet", 0, sha["empty.parquet"]), ("gone.parquet", 1, "x")], "path string, rows long, sha256 string")
    got = {r.path: (r.rule, r.found) for r in panels.bundle_integrity(spark, str(part.parent), manifest).collect()}
    assert got == {"broken.parquet": ("rows", sha["broken.parquet"]), "gone.parquet": ("missing", ""), "empty.parquet": ("missing", "")}
    assert {r.rule for r in panels.bundle_integrity(spark, str(part.parent), manifest.filter("path = 'none'")).collect()} == {"surplus"}

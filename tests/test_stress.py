"""Stress scenarios against the single-book path and on hard input."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions.windows import by_symbol
from panelwright.operators import ledger, signals, stress

COSTS = ledger.Costs(1.0, 2.0, 3.0)
POLICY = ledger.Policy(adv_lookback=3, volatility_lookback=3, max_participation_rate=0.02, impact_coefficient=0.1)
CASH = 1e6


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * k) for k in range(40)]
    rows = []
    for s in range(12):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, len(days))))
        rows += [(d, f"S{s:02d}", float(c * rng.uniform(0.99, 1.01)), float(c), float(rng.integers(5_000, 90_000)), float(rng.normal())) for d, c in zip(days, close, strict=True)]
    df = spark.createDataFrame(rows, "date date, symbol string, open double, close double, volume double, prediction double")
    return df.drop("prediction"), df.filter("date < '2024-09-01'").select("date", "symbol", "prediction")


def single(panel, predictions, quantile, lag, costs, cap):
    """The book of one setting by the operators of a single book."""
    weights = signals.uncapped_weights(signals.build_signals(predictions, quantile=quantile))
    t = ledger.with_fill_date(ledger.decision_targets(weights, 2), panel, lag)
    t = t.select(F.col("fill_date").alias("date"), "symbol", (F.col("target_weight") - F.coalesce(F.lag("target_weight").over(by_symbol()), F.lit(0.0))).alias("dw")).filter("dw <> 0")
    policy = ledger.Policy(3, 3, cap, 0.1)
    x = ledger.lagged_inputs(panel, policy).select("date", "symbol", F.col("open").alias("price"), "adv", "vol")
    orders = t.join(x, ["date", "symbol"], "left").withColumn("requested_shares", F.coalesce(F.col("dw") * CASH / F.col("price"), F.lit(0.0)))
    fills = ledger.fill(orders, costs, policy)
    return ledger.curve(ledger.positions(fills, panel, CASH)[1], fills, CASH).toPandas().set_index("date").sort_index()


def test_each_scenario_is_the_book_of_its_settings(spark, market):
    panel, predictions = market
    tests = stress.scenarios(COSTS, POLICY, 0.3, 1)
    found = stress.stress_curves(predictions, panel, tests, POLICY, every=2, cash=CASH).toPandas()
    assert len(found) == 40 * 7
    ends = {}
    for name, quantile, lag, costs, cap in [
        ("base", 0.3, 1, COSTS, 0.02), ("additional_session_delay", 0.3, 2, COSTS, 0.02), ("halved_participation", 0.3, 1, COSTS, 0.01),
        ("tripled_spread_and_slippage", 0.3, 1, ledger.Costs(1.0, 6.0, 9.0), 0.02), ("narrower_selection", 0.3 * 0.75, 1, COSTS, 0.02),
    ]:
        ours = found[found.scenario == name].set_index("date").sort_index()
        theirs = single(panel, predictions, quantile, lag, costs, cap)
        for c in ("return", "equity", "turnover", "transaction_cost", "gross_exposure", "net_exposure"):
            assert np.allclose(ours[c].astype(float), theirs[c].astype(float), rtol=1e-9, atol=1e-12, equal_nan=True), (name, c)
        ends[name] = ours.equity.iloc[-1]
    assert len(set(ends.values())) == len(ends)


def test_scenarios_without_cap_halve_five_percent_and_settings_are_checked():
    tests = {s.scenario: s for s in stress.scenarios(COSTS, ledger.Policy(), 0.45)}
    assert tests["base"].cap is None and tests["halved_participation"].cap == 0.025 and tests["wider_selection"].quantile == 0.49
    assert len(stress.checked(list(tests.values()))) == 7
    base = stress.scenarios(COSTS, POLICY)[0]
    for bad in ([], [base, base], [stress.Scenario("x", 1, 1, 1, 0.5, 1, None)], [stress.Scenario("x", 1, 1, 1, 0.2, 0, None)], [stress.Scenario("x", -1, 1, 1, 0.2, 1, None)], [stress.Scenario("x", 1, 1, 1, 0.2, 1, 2.0)]):
        with pytest.raises(ValueError):
            stress.checked(bad)


def test_hard_predictions_and_no_predictions(spark, market):
    panel, predictions = market
    tests = stress.scenarios(COSTS, ledger.Policy(3, 3), 0.2)[:2]
    hard = predictions.withColumn("prediction", F.when(F.col("symbol") == "S00", F.lit(float("nan"))).when(F.col("symbol") == "S01", F.lit(None)).when(F.col("symbol") == "S02", F.lit(float("inf"))).otherwise(F.lit(1.0)))
    found = stress.stress_curves(hard, panel, tests, ledger.Policy(3, 3), cash=CASH)
    assert found.count() == 80 and found.filter("equity is null or isnan(equity)").count() == 0
    none = stress.stress_curves(predictions.limit(0), panel, tests, POLICY, cash=CASH).toPandas()
    assert len(none) == 80 and (none.equity == CASH).all() and (none["return"] == 0).all()


def test_passing_is_by_drawdown_from_the_first_exposure_on(spark):
    day = dt.date(2024, 1, 1)
    rows = [(s, day + dt.timedelta(days=k), 0.0 if k == 0 else e / es[k - 1] - 1, float(e), 0.0 if s == "idle" or k == 0 else 1.0) for s, es in {"calm": (100, 99, 104), "deep": (100, 120, 60), "idle": (100, 100, 100)}.items() for k, e in enumerate(es)]
    curve = spark.createDataFrame(rows, "scenario string, date date, return double, equity double, gross_exposure double")
    found = stress.results(curve, 0.1)
    got = found.toPandas().set_index("scenario")
    assert got.passed.to_dict() == {"calm": True, "deep": False, "idle": True} and got.n_days.to_dict() == {"calm": 2, "deep": 2, "idle": 3}
    assert pd.Series(got.max_drawdown).round(6).to_dict() == {"calm": 0.0, "deep": -0.5, "idle": 0.0}
    assert stress.all_passed(found).collect()[0].asDict() == {"stress_passed": False, "failed": "deep"}
    assert stress.all_passed(found.limit(0)).collect()[0].asDict() == {"stress_passed": False, "failed": ""}

"""Weekly bars against plain Python, on lines that tie, lack values or meet suppliers and nations more than once."""

import datetime as dt
import random

import pytest

from panelwright.sources import adapter

LEAST = -(1 << 63)


def write(spark, folder):
    rng = random.Random(5)
    lines = []
    for i in range(3000):
        at = dt.datetime(2020, 1, 6) + dt.timedelta(days=rng.randrange(20), hours=rng.choice([0, 0, 0, 7]), microseconds=rng.choice([0, 0, 1]))
        order = rng.choice([None, LEAST, -3, *range(40)])
        lines.append((order, i, rng.choice([None, *range(10)]), rng.choice([None, 0, 1]), rng.choice([None, 2.0, 4.0]), float(rng.randrange(1, 90)), None if rng.random() < 0.03 else at))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    suppliers = [(k, k % 5) for k in range(7)] + [(1, 4), (7, None), (8, 77), (None, 1)]  # 1 of two nations, 7 and 8 of none, 9 missing
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    nations = [(0, "A"), (1, "B"), (2, "B"), (3, "BENCH"), (4, None), (5, "none sells"), (None, "C")]
    spark.createDataFrame(nations, "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    found = {}
    for order, part, supplier, number, quantity, price, at in lines:
        for name in [n for s, k in suppliers for m, n in nations if s == supplier is not None and k == m is not None]:
            for symbol in (name, "BENCH"):
                week = at and at.date() - dt.timedelta(at.weekday())
                key = tuple((x is not None, x or 0) for x in (at and at.timestamp(), order, number, part, supplier))
                found.setdefault((week, symbol), []).append((key, quantity and price / quantity, quantity))
    return found


@pytest.mark.parametrize("few", [True, False])
def test_bars_by_hash(spark, tmp_path, monkeypatch, few):
    plans = []
    cut = getattr(adapter, "cut", None)

    def kept(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, what)

    monkeypatch.setattr(adapter, "cut", kept, raising=False)
    monkeypatch.setattr(adapter, "BROADCAST_SUPPLIERS", 500_000 if few else 0, raising=False)
    groups = write(spark, str(tmp_path))
    got = adapter.bars(spark, str(tmp_path))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    rows = {(r.date, r.symbol): r for r in got.collect()}
    assert set(rows) == set(groups) and got.count() == len(groups) and None in {d for d, _ in groups}
    for g, lines in groups.items():
        prices = [p for _, p, _ in lines if p is not None]
        assert (rows[g].open, rows[g].close) == (min(lines)[1], max(lines)[1])
        assert (rows[g].high, rows[g].low, rows[g].volume) == (max(prices), min(prices), sum(q for _, _, q in lines if q is not None))
    # lines are sorted only where they are those of the wanted orders, and dealt by key only to meet many suppliers
    reading = [p for p in plans if "l_extendedprice#" in p]
    assert reading and not [p for p in reading if "SortMergeJoin" in p or "SortAggregate" in p and "wanted#" not in p]
    assert all(("ShuffledHashJoin" in p) != few for p in reading)

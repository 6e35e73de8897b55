"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelwright.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SOME = ["bars", "quality_report", "decision_panel", "features_levels", "features_rsi", "features_beta", "labels_forward", "walk_forward_windows", "combinatorial_cv", "ic_summary", "quantile_returns", "portfolio_weights", "fills", "equity_curve", "performance_summary", "stress_curves", "stress_results", "capacity_curve", "control_gate", "flagship_momentum"]


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in one order, whatever the engine: by columns that are not doubles first, as doubles differ in their last digits."""
    df = df[sorted(df.columns)].copy()
    exact = [c for c in df if not pd.api.types.is_float_dtype(df[c])]
    for c in df:
        if pd.api.types.is_numeric_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
        elif pd.api.types.is_datetime64_any_dtype(df[c]) or hasattr(df[c].dropna().iloc[0] if df[c].notna().any() else 0, "isoformat"):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[ns]").astype(str)
    keys = pd.DataFrame({c: df[c] for c in exact} | {c: df[c].round(3) for c in df if c not in exact})
    return df.loc[keys.sort_values(exact + [c for c in df if c not in exact], na_position="first").index].reset_index(drop=True)


def assert_same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert len(ours) == len(theirs) and list(ours.columns) == list(theirs.columns)
    for c in ours:
        a, b = ours[c], theirs[c]
        if pd.api.types.is_float_dtype(a):
            assert np.allclose(a, b.astype(float), rtol=1e-9, atol=2e-6, equal_nan=True), c
        else:
            assert a.astype(object).where(a.notna(), None).tolist() == b.astype(object).where(b.notna(), None).tolist(), c


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    ours = comparable(registry.queries()[name](spark, FOLDER).toPandas())
    assert len(ours)
    assert_same(ours, comparable(duck.execute(registry.oracle_sql()[name]).df()))


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())

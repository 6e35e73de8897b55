"""Data contracts: panel validation, quality reports, bounded filling, row audits, as-of views and the decision panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.windows import by_symbol, dated

RULES = {
    "null_key": "date is null or symbol is null",
    "non_positive_close": "close <= 0",
    "null_close": "close is null",
    "null_volume": "volume is null",
    "high_below_low": "high < low",
}


def violations(panel: DataFrame) -> DataFrame:
    """(rule, violations): rows against each rule, and rows whose key is there before. One aggregation by key, one over its result."""
    keys = panel.groupBy("date", "symbol").agg(F.count("*").alias("n"), *[F.count_if(F.expr(r)).alias(k) for k, r in RULES.items()])
    sums = keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_key"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in RULES])
    return sums.unpivot([], ["duplicate_key", *RULES], "rule", "violations")


def validate(panel: DataFrame, allow_null_volume: bool = False) -> DataFrame:
    """panel, or ValueError naming the rules it breaks; closes or volumes may be null in part, not all."""
    missing = {"date", "symbol", "open", "high", "low", "close", "volume"} - set(panel.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    found = {r["rule"]: r["violations"] for r in violations(panel).collect()}  # six rows
    total = panel.agg(F.count("*")).first()[0]
    broken = [k for k in ("duplicate_key", "null_key", "non_positive_close", "high_below_low") if found[k]]
    broken += ["all_null_close"] if total and found["null_close"] == total else []
    broken += ["all_null_volume"] if total and found["null_volume"] == total and not allow_null_volume else []
    if broken:
        raise ValueError(f"panel breaks: {broken}")
    return panel


def quality_report(panel: DataFrame) -> DataFrame:
    """Per symbol: first and last date, rows, sessions of the union calendar that are missing in between, null closes, rows without volume,
    returns beyond 40 % and the largest return in size."""
    calendar = dated(panel)
    ret = F.abs(F.col("close") / F.lag("close").over(by_symbol()) - 1)
    rows = panel.withColumn("r", ret).groupBy("symbol").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("rows"), F.count_if(F.col("close").isNull()).alias("null_close"),
        F.count_if(F.col("volume") == 0).alias("zero_volume"), F.count_if(F.col("r") > 0.40).alias("extreme_returns"), F.max("r").alias("max_abs_return"))
    # one row per date on one side, one per symbol on the other
    at = lambda c, n: calendar.select(F.col("date").alias(c), F.col("idx").alias(n)).hint("merge")
    both = rows.join(at("start", "i0"), "start").join(at("end", "i1"), "end")
    return both.select("symbol", "start", "end", "rows", (F.col("i1") - F.col("i0") + 1 - F.col("rows")).alias("missing_sessions"), "null_close", "zero_volume", "extreme_returns", "max_abs_return")


def fill_missing(panel: DataFrame, limit: int = 5) -> DataFrame:
    """Prices carried forward over at most limit rows of a symbol; a missing volume is 0."""
    w = by_symbol().rowsBetween(-limit, 0)
    return panel.select("date", "symbol", *[F.coalesce(c, F.last(c, ignorenulls=True).over(w)).alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"))


def to_wide(panel: DataFrame, symbols: list[str], column: str = "close") -> DataFrame:
    """One column per given symbol, one row per date."""
    return panel.groupBy("date").pivot("symbol", symbols).agg(F.first(column))


ROW_RULES = {
    "effective_missing": "effective_at is null",
    "available_missing": "available_at is null",
    "available_before_effective": "available_at < effective_at",
    "date_after_effective": "date > to_date(effective_at)",
    "non_positive_price": "least(open, high, low, close) <= 0 or open is null or high is null or low is null or close is null",
    "negative_volume": "volume < 0",
    "bounds": "high < greatest(open, close, low) or low > least(open, close, high)",
    "empty_text": "trim(coalesce(instrument_id, '')) = '' or trim(coalesce(currency, '')) = ''",
    "currency": "currency not in ('USD')",
    "instrument": "ticker <> instrument_id",
}


def audit_rows(rows: DataFrame) -> DataFrame:
    """(rule, violations) of bundle rows against the row contract, repeated keys included."""
    keys = rows.groupBy("date", "ticker").agg(F.count("*").alias("n"), *[F.count_if(F.expr(r)).alias(k) for k, r in ROW_RULES.items()])
    sums = keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_key"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ROW_RULES])
    return sums.unpivot([], ["duplicate_key", *ROW_RULES], "rule", "violations")


def as_of(rows: DataFrame, cutoff: str) -> DataFrame:
    """Rows that were available at the cutoff; the filter reaches the Parquet scan."""
    return rows.filter(F.col("available_at") <= F.lit(cutoff).cast(dict(rows.dtypes)["available_at"]))


def decision_panel(rows: DataFrame) -> DataFrame:
    """Each row dated at the first session close at or after its available_at; rows after the last close drop.

    The forward as-of join is an equi-join: the calendar has a row per day with that day's closes, in order, and the first close of a later
    day; a row meets its own day and takes the first close that is not before it."""
    closes = rows.groupBy("date").agg(F.max("effective_at").alias("close_at"))
    days = closes.groupBy(F.to_date("close_at").alias("day")).agg(F.array_sort(F.collect_list(F.struct("close_at", "date"))).alias("closes"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).withColumn("c", rows.agg(F.min(F.to_date("available_at"))).scalar()).select(
        F.explode(F.sequence(F.least("a", "c"), "b")).alias("day"))
    later = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    calendar = span.join(days.hint("merge"), "day", "left").withColumn("next", F.last(F.element_at("closes", 1), ignorenulls=True).over(later))
    met = rows.withColumn("day", F.to_date("available_at")).join(calendar.hint("merge"), "day")
    first = F.coalesce(F.expr("try_element_at(filter(closes, c -> c.close_at >= available_at), 1)"), F.col("next"))
    return met.withColumn("decision", first).filter("decision is not null").withColumn("decision_date", F.col("decision.date")).drop("day", "closes", "next", "decision")

"""Window helpers that all panel operators share: one window specification per symbol, full-window guards, ranks and exponential means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS_PER_YEAR = 252


def by_symbol():
    return Window.partitionBy("symbol").orderBy("date")


def by_date(*keys: str):
    return Window.partitionBy(*keys, "date")


def last_rows(n: int):
    """The symbol's last n rows, the current one included."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def full(agg: Column, of: Column, n: int, least: int | None = None) -> Column:
    """agg over the last n rows, null unless n (or least) of them have a value."""
    return F.when(F.count(of).over(last_rows(n)) >= (least or n), agg.over(last_rows(n)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def pct_rank(x: Column, window) -> Column:
    """Rank as a share of the non-null values, ties averaged; null stays null. window: an unordered partition."""
    ordered = window.orderBy(x.asc_nulls_last())
    ties = F.count(x).over(_ties(window, x))
    return F.when(x.isNotNull(), (F.rank().over(ordered) + (ties - 1) / 2) / F.count(x).over(window))


def _ties(window, x: Column):
    """Rows of the partition with the same value."""
    return window.orderBy(x.asc_nulls_last()).rangeBetween(Window.currentRow, Window.currentRow)


def average_rank(x: Column, window) -> Column:
    return F.when(x.isNotNull(), F.rank().over(window.orderBy(x.asc_nulls_last())) + (F.count(x).over(_ties(window, x)) - 1) / 2)


def dated(df: DataFrame, column: str = "date") -> DataFrame:
    """Distinct dates with their position from 0. One row per date: the only window without a partition."""
    days = df.select(column).distinct()
    return days.withColumn("idx", F.row_number().over(Window.orderBy(column)) - 1)


def ewm_means(df: DataFrame, means: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds a column for each entry out: (value, alpha) of means: the bias-adjusted exponential mean of value along each symbol; null values
    and NaN take no weight but time goes on, and after the first value the mean is never null again.

    With r = 1 - alpha, sums of value r^-j over the first j rows of a block of rows, times r^j, are sums of value decayed by age. A block is
    as long as r^-j stays far from overflow (r^-length up to 1e100), so that what stands before the block before a row's own weighs less
    than 1e-100: a row adds the total of one earlier block, and the result is exact for any span. Windows over the symbol only: one
    exchange for all means, which keep its order."""
    rows = df.withColumn("n_", F.row_number().over(by_symbol()) - 1)
    earlier = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    for out, (value, alpha) in means.items():
        if not 0 < alpha <= 1:
            raise ValueError("alpha must be in (0, 1]")
        x, r = F.nullif(F.col(value).cast("double"), F.lit(float("nan"))), 1.0 - alpha
        if r == 0:  # nothing but the latest value counts
            rows = rows.withColumn(out, F.last(x, ignorenulls=True).over(so_far))
            continue
        length = max(1, min(1 << 40, int(100 * math.log(10) / -math.log(r)))) if r < 1 else 1 << 40
        rows = rows.withColumns({"b_": F.floor(F.col("n_") / length), "j_": F.col("n_") % length})
        inside = Window.partitionBy("symbol", "b_").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        weight = F.when(x.isNotNull(), F.pow(F.lit(r), -F.col("j_"))).otherwise(0.0)
        decay = F.pow(F.lit(r), F.col("j_"))
        rows = rows.withColumns({"top_": F.sum(F.coalesce(x, F.lit(0.0)) * weight).over(inside) * decay, "low_": F.sum(weight).over(inside) * decay})
        total = lambda c: F.coalesce(F.last(F.when(F.col("j_") == length - 1, F.col(c)), ignorenulls=True).over(earlier), F.lit(0.0))  # noqa: E731, B023
        rows = rows.withColumns({"top_": F.col("top_") + total("top_") * decay * r, "low_": F.col("low_") + total("low_") * decay * r})
        rows = rows.withColumn(out, F.last(F.when(F.col("low_") > 1e-250, F.col("top_") / F.col("low_")), ignorenulls=True).over(so_far)).drop("b_", "j_", "top_", "low_")
    return rows.drop("n_")


def expanding_rank(df: DataFrame, value: str, out: str, count: str) -> DataFrame:
    """Adds out: the rank, ties averaged, of each non-null value among the symbol's values up to it, as a share of their number (count).

    Instead of every earlier value, a row meets halves: at each level the values are parted by position into blocks of 1, 2, 4, ...; the
    smaller ones in the left half of a block are counted for those in its right half, by a window in the order of values. A row takes part
    once a level, so that the work grows as n log n."""
    some = df.filter(F.col(value).isNotNull()).select("symbol", "date", F.col(value).alias("v_"), (F.row_number().over(by_symbol()) - 1).alias("n_"))
    levels = F.expr("sequence(0, cast(floor(log2(greatest(all_ - 1, 1))) as int))")
    parts = some.withColumn("all_", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).withColumn("level", F.explode(levels))
    parts = parts.withColumns({"half": F.expr("shiftright(n_, level) & 1"), "block": F.expr("shiftright(n_, level + 1)")})
    order = Window.partitionBy("symbol", "level", "block").orderBy("v_")
    left = F.when(F.col("half") == 0, 1).otherwise(0)
    upto, equal = (F.sum(left).over(order.rangeBetween(lo, Window.currentRow)) for lo in (Window.unboundedPreceding, Window.currentRow))
    met = parts.withColumns({"upto": upto, "equal": equal}).filter("half = 1")
    sums = met.groupBy("symbol", "date").agg(F.sum(F.col("upto") - F.col("equal")).alias("less_"), F.sum("equal").alias("equal_"))
    ranks = some.join(sums.hint("merge"), ["symbol", "date"], "left").select(
        "symbol", "date", (F.col("n_") + 1).alias(count), ((F.coalesce("less_", F.lit(0)) + (F.coalesce("equal_", F.lit(0)) + 2) / 2) / (F.col("n_") + 1)).alias(out))
    return df.join(ranks.hint("merge"), ["symbol", "date"], "left")

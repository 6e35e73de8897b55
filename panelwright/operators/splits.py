"""Leak-safe splits over dates: walk-forward windows, purged and combinatorial folds, cut-offs and fractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.choices import combinations
from panelwright.functions.windows import dated
from panelwright.plans.session import cut


def walk_forward(dates: DataFrame, *, min_train: int, test: int, step: int, embargo: int, scheme: str = "expanding", max_horizon: int | None = None, max_windows: int | None = None) -> DataFrame:
    """(window_id, train_start, train_end, test_start, test_end) with an embargo of dates between training and test."""
    if embargo < 0 or scheme not in ("expanding", "rolling"):
        raise ValueError("embargo must not be negative, scheme expanding or rolling")
    if max_horizon is not None and embargo < max_horizon:
        raise ValueError("the embargo must cover the label horizon")
    idx = cut(dated(dates), "calendar")  # read at each end of a window
    n = idx.agg((F.max("idx") + 1).alias("n"))
    first = min_train + embargo
    starts = n.filter(F.col("n") > first).select("n", F.explode(F.sequence(F.lit(first), F.col("n") - 1, F.lit(step))).alias("s"))
    w = starts.select(
        ((F.col("s") - first) / step).cast("int").alias("window_id"), (F.col("s") - embargo - 1).alias("te"), "s", F.least(F.col("s") + test - 1, F.col("n") - 1).alias("e"))
    w = w.withColumn("ts", F.greatest(F.lit(0), F.col("te") - min_train + 1) if scheme == "rolling" else F.lit(0))
    if max_windows is not None:
        w = w.filter(F.col("window_id") < max_windows)
    for key, name in (("ts", "train_start"), ("te", "train_end"), ("s", "test_start"), ("e", "test_end")):
        w = w.join(idx.select(F.col("idx").alias(key), F.col("date").alias(name)).hint("merge"), key)
    return w.select("window_id", "train_start", "train_end", "test_start", "test_end")


def roles(dates: DataFrame, windows: DataFrame) -> DataFrame:
    """(date, window_id, role) of every distinct date inside a window's training or test range; a date in both trains.

    The ends of the windows take their places in the calendar, and a range is the sequence of its places: an equi-join with the calendar,
    where rows would meet windows by comparison. A table of dates and windows, without the rows."""
    ends = windows.select("window_id", F.explode(F.array(*[
        F.struct(F.lit(role).alias("role"), F.col(f"{role}_start").alias("lo"), F.col(f"{role}_end").alias("hi")) for role in ("train", "test")])).alias("r")).select("window_id", "r.*")
    ends = cut(ends.filter("lo <= hi"), "ends")
    days = cut(dated(dates.select("date").union(ends.select("lo")).union(ends.select("hi"))), "calendar")
    at = lambda c: days.select(F.col("date").alias(c), F.col("idx").alias(f"{c}_at")).hint("merge")
    spans = ends.join(at("lo"), "lo").join(at("hi"), "hi").select("window_id", "role", F.explode(F.sequence("lo_at", "hi_at")).alias("idx"))
    met = spans.hint("merge").join(days.hint("merge"), "idx")
    return met.groupBy("date", "window_id").agg(F.max("role").alias("role"))  # train comes after test


def assign(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of each window with their role; a row may belong to many, a row of both ranges trains."""
    return rows.join(cut(roles(rows, windows), "roles").hint("merge"), "date").select(*rows.columns, "window_id", "role")


def _folds(dates: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    return dated(dates).withColumn("fold", F.ntile(k).over(Window.orderBy("idx")) - 1)


def purged_kfold(dates: DataFrame, k: int, purge: int = 0, embargo: int = 0) -> DataFrame:
    """(fold, date, role): contiguous folds; dates near a test block (purge on both sides, embargo after) have no role."""
    if k < 2:
        raise ValueError("k must be 2 or more")
    days = _folds(dates, k)
    blocks = days.groupBy("fold").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    near = F.col("idx").between(F.col("lo") - purge, F.col("hi") + purge + embargo)
    role = F.when(F.col("idx").between(F.col("lo"), F.col("hi")), "test").when(~near, "train")
    # k rows
    return days.drop("fold").crossJoin(F.broadcast(blocks)).withColumn("role", role).filter("role is not null").select("fold", "date", "role")


def combinatorial(dates: DataFrame, groups: int, test_groups: int, purge: int = 0, embargo: int = 0) -> DataFrame:
    """(split_id, test_groups, date, role) for every choice of test groups."""
    if not 0 < test_groups < groups:
        raise ValueError("need 0 < test_groups < groups")
    combos = cut(combinations(dates.sparkSession, groups, test_groups).select(F.col("combo").cast("int").alias("split_id"), "chosen"), "choices")
    days = cut(_folds(dates, groups), "days")
    blocks = days.groupBy("fold").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    near = combos.select("split_id", F.explode("chosen").alias("fold")).join(blocks.hint("merge"), "fold").select("split_id", "fold", "lo", "hi")
    # each test group's dates and those near it, by position
    reach = near.withColumn("idx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("lo") - purge), F.col("hi") + purge + embargo)))
    reach = reach.groupBy("split_id", "idx").agg(F.max(F.col("idx").between(F.col("lo"), F.col("hi"))).alias("test"))
    count = days.count()
    every = combos.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count else combos.withColumn("idx", F.lit(0))
    role = F.when(F.col("test"), "test").when(F.col("test").isNull(), "train")
    met = every.join(reach.hint("merge"), ["split_id", "idx"], "left").hint("merge").join(days.select("date", "idx").hint("merge"), "idx")
    return met.withColumn("role", role).filter("role is not null").select(
        "split_id", F.concat_ws(",", F.col("chosen").cast("array<string>")).alias("test_groups"), "date", "role")


def development_cutoff(dates: DataFrame, holdout_start: str, embargo: int) -> DataFrame:
    """One row: the last date before the holdout less the embargo."""
    days = dated(dates)
    start = days.filter(F.col("date") >= F.lit(holdout_start).cast("date")).agg(F.min("idx").alias("h"))
    return days.join(F.broadcast(start), F.col("idx") == F.col("h") - embargo - 1).select(F.col("date").alias("cutoff"))


def fractions(dates: DataFrame, train: float, embargo: int) -> DataFrame:
    """(date, role): the first share of dates trains, then an embargo, then the test."""
    days = dated(dates)
    n = days.agg((F.max("idx") + 1).alias("n"))
    cut = F.floor(F.col("n") * train)
    return days.crossJoin(F.broadcast(n)).select("date", F.when(F.col("idx") < cut, "train").when(F.col("idx") < cut + embargo, "embargo").otherwise("test").alias("role"))

"""Positions, ranks and exact quantiles of groups of any size: no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.plans.session import cut

#: Rows of a group of brackets that one task sorts in a selection; relative accuracy of the sketch that narrows brackets.
SELECTED, ACCURACY = 100_000, 10_000
#: Groups whose brackets are broadcast; beyond, they are joined by key.
BROADCAST_GROUPS = 10_000


def _free(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, made from names."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(1, len(taken) + 2)) if n.lower() not in taken) for name in names]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _same(a: list[str], b: list[str]) -> Column:
    """Equality of two lists of columns of different names; null equals null."""
    return F.expr(" and ".join(f"{_q(x)} <=> {_q(y)}" for x, y in zip(a, b, strict=True)) or "true")


def _join_groups(df: DataFrame, other: DataFrame, by: list[str], hint: str = "merge") -> DataFrame:
    """df with the other columns of other, by the columns by; null equals null."""
    taken = {c.lower() for c in [*df.columns, *other.columns]}
    names = [f"g{i}_" + "_" * max(map(len, taken)) for i in range(len(by))]
    side = other.select(*[F.col(_q(c)).alias(g) for c, g in zip(by, names, strict=True)], *[_q(c) for c in other.columns if c not in by])
    return df.join(F.broadcast(side) if hint == "broadcast" else side.hint(hint), _same(by, names)).drop(*names)


def running_totals(df: DataFrame, by: list[str], order: list[str], out: str, weight: str | None = None) -> DataFrame:
    """df with out: the total of weight (rows, if None) over the rows of its group by that stand before it in order. Null groups count
    as one; ties in order stand in an order of their own, so that order should be a key.

    Rows are dealt by ranges of (by, order), written, and numbered within their range; a range's start is a running total over one row per
    range and group. A hot group is as many ranges as it needs, so that a task holds one range, however large the group."""
    at, part, start = _free(df, "at", "part", "start")
    keys = [F.col(_q(c)) for c in [*by, *order]]
    w = F.lit(1).cast("long") if weight is None else F.col(_q(weight))
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "ranged")
    placed = placed.withColumn(part, F.shiftright(at, 33))
    own = [_q(c) for c in by] + [part]
    # a row per range and group that it holds
    starts = placed.groupBy(*own).agg(F.sum(w).alias(start))
    earlier = Window.partitionBy(*[_q(c) for c in by]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn(start, F.coalesce(F.sum(start).over(earlier), F.lit(0)))
    inside = Window.partitionBy(*own).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    joined = _join_groups(placed, starts, [*by, part])
    return joined.withColumn(out, F.col(start) + F.coalesce(F.sum(w).over(inside), F.lit(0))).select(*[F.col(_q(c)) for c in df.columns], out)


def doubled_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df with out (long): the average rank of value within its group, doubled, less n + 1, so that it is a whole number and adds up to zero
    over a group. Null groups count as one; value without nulls.

    Equal values are counted first, so that a tie of any size is one row of the ranking; a row finds its rank by (by, value)."""
    n, before, total = _free(df, "n", "before", "total")
    cols = [_q(c) for c in by]
    ties = df.groupBy(*cols, _q(value)).agg(F.count("*").alias(n))
    ranked = running_totals(ties, by, [value], before, n)
    size = ties.groupBy(*cols).agg(F.sum(n).alias(total))
    few = size.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    ranked = _join_groups(ranked, size, by, "broadcast" if few else "merge").select(*cols, _q(value), (2 * F.col(before) + F.col(n) - F.col(total)).alias(out))
    return _join_groups(df, ranked, [*by, value])


def _sized(df: DataFrame, most: int) -> DataFrame:
    """df to join: broadcast where it has at most so many rows, counted; by merge beyond."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], out: str = "percentile") -> DataFrame:
    """(by, share, out) for every group and share: the percentile as percentile() gives it, by linear interpolation between neighbours in
    order, over values that are not null; groups without any are left out. Null groups count as one.

    A round narrows each group's bracket of values: a sketch of the rows inside gives values that surely lie on both sides of the wanted
    ranks (its error in rank is bounded by 1 / ACCURACY), and one aggregation counts what lies below them. When a bracket holds few rows
    (SELECTED), or one value, its counted values are ranked. A round reads the rows and shuffles sketches and counts; two rounds do for
    10^9 rows a group."""
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must lie in [0, 1]")
    names, met = [f"k{i}_" for i in range(len(by))], [f"m{i}_" for i in range(len(by))]
    keys, met_keys = [*names, "share_"], [*met, "m_share_"]
    rows = df.select(*[F.col(_q(c)).alias(k) for c, k in zip(by, names, strict=True)], F.col(_q(value)).cast("double").alias("v_")).filter("v_ is not null")
    sizes = rows.groupBy(*names).agg(F.count("*").alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_")).filter("n_ > 0")
    # each wanted share, with the places of its two neighbours from 0
    wanted = sizes.withColumn("share_", F.explode(F.array(*[F.lit(float(s)) for s in dict.fromkeys(shares)])))
    wanted = wanted.withColumn("h_", (F.col("n_") - 1) * F.col("share_")).withColumns({"a_": F.floor("h_"), "b_": F.ceil("h_"), "below_": F.lit(0).cast("long"), "inside_": F.col("n_")})
    state = [*keys, "h_", "a_", "b_", "lo_", "hi_", "below_", "inside_"]
    wanted = cut(wanted.select(*state), "wanted")
    wide = (F.col("inside_") > SELECTED) & (F.col("lo_") < F.col("hi_"))
    slack, steps = 2.0 / ACCURACY, 200

    def inside(brackets: DataFrame, low: str) -> DataFrame:
        """The rows of each bracket from column low on, with the bracket's columns; its keys under other names."""
        side = brackets.select(*[F.col(a).alias(b) for a, b in zip(keys, met_keys, strict=True)], *[c for c in brackets.columns if c not in keys])
        return rows.join(_sized(side, BROADCAST_GROUPS), _same(names, met) & F.col("v_").between(F.col(low), F.col("hi_")))

    while wanted.filter(wide).limit(1).count():
        open_ = wanted.filter(wide)
        sketch = inside(open_, "lo_").groupBy(*met_keys).agg(F.percentile_approx("v_", [i / steps for i in range(steps + 1)], ACCURACY).alias("grid_"))
        # where the wanted places stand among the rows inside, with room for the sketch's error
        low = F.floor(((F.col("a_") - F.col("below_")) / F.col("inside_") - slack) * steps).cast("int")
        high = F.ceil(((F.col("b_") - F.col("below_") + 1) / F.col("inside_") + slack) * steps).cast("int")
        point = lambda i: F.element_at("grid_", F.greatest(F.lit(0), F.least(i, F.lit(steps))) + 1)
        narrow = open_.join(sketch.hint("merge"), _same(keys, met_keys)).withColumns({"from_": F.when(low >= 0, point(low)).otherwise(F.col("lo_")), "to_": F.when(high <= steps, point(high)).otherwise(F.col("hi_"))})
        narrow = narrow.select(*[c for c in state if c not in ("lo_", "hi_")], F.col("lo_").alias("old_"), F.col("from_").alias("lo_"), F.col("to_").alias("hi_"))
        narrow = cut(narrow, "brackets")
        met_rows = inside(narrow, "old_")
        counts = met_rows.groupBy(*met_keys).agg(F.sum((F.col("v_") < F.col("lo_")).cast("long")).alias("less_"), F.sum((F.col("v_") >= F.col("lo_")).cast("long")).alias("some_"))
        new = narrow.join(counts.hint("merge"), _same(keys, met_keys))
        stuck = new.filter("some_ >= inside_").limit(1).count()
        new = new.withColumns({"below_": F.col("below_") + F.col("less_"), "inside_": F.col("some_")})
        wanted = cut(wanted.filter(~wide).unionByName(new.select(*state)), "wanted")
        if stuck:  # a few values that many rows share, which no sketch parts further: their counts are ranked below
            break
    # what is left of a bracket: its values, counted, in order
    values = inside(wanted, "lo_").groupBy(*met_keys, "v_").agg(F.count("*").alias("c_"), *[F.first(c).alias(c) for c in ("below_", "a_", "b_", "h_")])
    values = values.withColumn("upto_", F.col("below_") + F.sum("c_").over(Window.partitionBy(*met_keys).orderBy("v_")))
    at = lambda c: F.min(F.when(F.col("upto_") > F.col(c), F.col("v_")))  # noqa: E731  the first value that reaches the place
    got = values.groupBy(*met_keys).agg(at("a_").alias("x_"), at("b_").alias("y_"), *[F.first(c).alias(c) for c in ("a_", "b_", "h_")])
    between = (F.col("b_") - F.col("h_")) * F.col("x_") + (F.col("h_") - F.col("a_")) * F.col("y_")
    found = F.when((F.col("a_") == F.col("b_")) | (F.col("x_") == F.col("y_")), F.col("x_")).otherwise(between)
    return got.select(*[F.col(m).alias(c) for m, c in zip(met, by, strict=True)], F.col("m_share_").alias("share"), found.alias(out))

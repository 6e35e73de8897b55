"""Choices of k things out of n as a table, unranked from their numbers by Spark."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Things that a choice is made of, at most: numbers of choices stay within 64 bits.
MOST = 60


def combinations(spark: SparkSession, n: int, k: int, most: int | None = None, seed: int = 7) -> DataFrame:
    """(combo, chosen): the k-element subsets of 0 to n - 1 in lexicographic order, numbered from 0; with most, those of them whose number
    has the least md5 of seed and number, so that more choices never displace chosen ones by order.

    A subset is found from its number alone, element by element: c stands at its place if the number falls among the choices that go on
    with c, and the number is reduced by the choices that c rules out."""
    if not 0 <= k <= n <= MOST:
        raise ValueError(f"need 0 <= k <= n <= {MOST}")
    ways = F.array(*[F.array(*[F.lit(math.comb(a, b)) for b in range(k + 1)]) for a in range(n + 1)])
    # state: number left, elements still to choose, chosen so far
    step = """aggregate(sequence(0, {last}), named_struct('left', combo, 'need', {k}, 'chosen', cast(array() as array<int>)),
      (s, c) -> CASE WHEN s.need = 0 THEN s
        WHEN s.left < ways[{last} - c][s.need - 1] THEN named_struct('left', s.left, 'need', s.need - 1, 'chosen', array_append(s.chosen, c))
        ELSE named_struct('left', s.left - ways[{last} - c][s.need - 1], 'need', s.need, 'chosen', s.chosen) END, s -> s.chosen)"""
    found = spark.range(math.comb(n, k)).select(F.col("id").alias("combo"))
    if most is not None and most < math.comb(n, k):
        found = found.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("combo").cast("string"))), "combo").limit(most)
    return found.withColumn("ways", ways.cast("array<array<bigint>>")).select("combo", F.expr(step.format(last=n - 1, k=k)).alias("chosen")) if n else found.select("combo", F.array().cast("array<int>").alias("chosen"))

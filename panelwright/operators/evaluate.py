"""Evaluation of predictions: errors, information coefficients, quantile tables, decay, densities, and inference on series."""

from __future__ import annotations

import itertools
import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.choices import combinations
from panelwright.functions.ranks import doubled_ranks, exact_percentiles
from panelwright.functions.windows import PERIODS_PER_YEAR, average_rank, ratio
from panelwright.plans.session import cut

EULER = 0.5772156649015329


def _pairs(df: DataFrame, p: str, t: str) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.filter(ok(p) & ok(t))


def _corr(a: str, b: str):
    """corr, null where a side does not vary."""
    return F.when((F.coalesce(F.stddev_pop(a), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_pop(b), F.lit(0.0)) > 0), F.corr(a, b))


def with_ranks(df: DataFrame, p: str, t: str, by: list[str]) -> DataFrame:
    """Adds the average ranks of two columns within their group, a cross-section, as whole numbers: doubled, less n + 1, so that each adds up
    to zero and sums of products carry no rounding."""
    w = Window.partitionBy(*by)
    whole = lambda c: 2 * average_rank(F.col(c), w) - F.count(F.lit(1)).over(w) - 1
    return df.withColumns({"rp_": whole(p), "rt_": whole(t)})


def _rank_corr():
    """Correlation of ranks as of with_ranks(), null where a side does not vary; exactly 0 where they are uncorrelated. Sums are of whole
    numbers of 38 digits, enough for groups of 10^12 rows."""
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    of = lambda a, b: F.sum(whole(a) * whole(b)).cast("double")
    return F.when((of("rp_", "rp_") > 0) & (of("rt_", "rt_") > 0), of("rp_", "rt_") / (F.sqrt(of("rp_", "rp_")) * F.sqrt(of("rt_", "rt_"))))


def regression_metrics(predictions: DataFrame, by: list[str], p: str = "prediction", t: str = "target") -> DataFrame:
    """Per group: n, mse, mae, r2, directional accuracy, IC and rank IC over finite pairs. A group is all history of a model: its ranks come
    from ranges of values, not from a window over the group."""
    df = cut(_pairs(predictions, p, t).select(*by, p, t), "pairs")  # read by both rankings
    df = doubled_ranks(doubled_ranks(df, by, p, "rp_"), by, t, "rt_")
    e = F.col(t) - F.col(p)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.when(F.var_pop(t) > 0, 1 - F.sum(e * e) / (F.var_pop(t) * F.count("*"))).alias("r2"),
        F.avg((F.signum(t) == F.signum(p)).cast("double")).alias("directional_accuracy"), _corr(p, t).alias("ic"), _rank_corr().alias("rank_ic"))


def ic_by_date(predictions: DataFrame, p: str = "prediction", t: str = "target", by: str = "model") -> DataFrame:
    """Pearson and Spearman correlation of prediction and target per model and date."""
    df = with_ranks(_pairs(predictions, p, t), p, t, [by, "date"])
    return df.groupBy(by, "date").agg(F.count("*").alias("n"), _corr(p, t).alias("ic"), _rank_corr().alias("rank_ic"))


def quantile_returns(predictions: DataFrame, q: int = 5, p: str = "prediction", t: str = "target") -> DataFrame:
    """Mean, median and count of the target by the prediction's quantile within its date. Edges are interpolated linearly, repeated ones
    dropped, bins closed on the right; dates with under two distinct predictions are left out. Edges are those of a cross-section; medians are
    selected from all history."""
    edges = predictions.filter(f"{p} is not null and {t} is not null").groupBy("date").agg(
        F.array_distinct(F.percentile(p, F.array(*[F.lit(k / q) for k in range(q + 1)]))).alias("edges"), F.count_distinct(p).alias("d")).filter("d >= 2")
    df = predictions.filter(f"{p} is not null and {t} is not null").join(edges.hint("merge"), "date")
    bin_ = F.greatest(F.size(F.filter("edges", lambda x: x < F.col(p))), F.lit(1))
    df = cut(df.select(F.col(t).alias("target"), bin_.alias("quantile")), "quantiles")
    medians = exact_percentiles(df, ["quantile"], "target", [0.5], "median_target").drop("share")
    return df.groupBy("quantile").agg(F.avg("target").alias("mean_target"), F.count("*").alias("n")).join(medians.hint("merge"), "quantile").select("quantile", "mean_target", "median_target", "n")


def newey_west(series: DataFrame, value: str, by: list[str], order: str = "date") -> DataFrame:
    """Per group: n, mean and the t statistic with Newey-West variance; lag floor(4 (T/100)^(2/9)), at most T - 2. The autocovariance of a
    lag divides by its number of pairs."""
    w = Window.partitionBy(*by)
    df = series.filter(F.col(value).isNotNull()).select(*by, order, value)
    df = df.withColumns({"n_": F.count("*").over(w), "m_": F.avg(value).over(w), "rn_": F.row_number().over(w.orderBy(order))})
    df = df.withColumn("e_", F.col(value) - F.col("m_")).withColumn("lags_", F.greatest(F.lit(0), F.least(F.floor(4 * F.pow(F.col("n_") / 100, 2 / 9)), F.col("n_") - 2)).cast("int"))
    base = df.groupBy(*by).agg(F.first("n_").alias("n"), F.first("m_").alias("mean"), F.avg(F.col("e_") * F.col("e_")).alias("g0"), F.first("lags_").alias("lags"))
    a = df.filter("lags_ > 0").select(*by, "e_", "lags_", F.explode(F.sequence(F.lit(1), F.col("lags_"))).alias("lag"), "rn_").withColumn("rn_", F.col("rn_") + F.col("lag"))
    b = df.select(*by, F.col("e_").alias("f_"), "rn_")
    gammas = a.join(b.hint("merge"), [*by, "rn_"]).groupBy(*by, "lag").agg((F.avg(F.col("e_") * F.col("f_")) * 2 * (1 - F.first("lag") / (F.first("lags_") + 1))).alias("g")).groupBy(*by).agg(F.sum("g").alias("g"))
    var = F.col("g0") + F.coalesce("g", F.lit(0.0))
    return base.join(gammas.hint("merge"), by, "left").select(*by, "n", "mean", F.when((F.col("n") > 2) & (var > 0), F.col("mean") / F.sqrt(var / F.col("n"))).alias("t_stat"))


def ic_summary(ics: DataFrame, column: str = "rank_ic", by: str = "model") -> DataFrame:
    """Per model: dates, mean, deviation, information ratio, Newey-West t and share of positive coefficients."""
    some = ics.filter(F.col(column).isNotNull())
    a = some.groupBy(by).agg(F.count("*").alias("n_dates"), F.avg(column).alias("mean_ic"), F.stddev_samp(column).alias("std_ic"), F.avg((F.col(column) > 0).cast("double")).alias("positive_share"))
    t = newey_west(some, column, [by]).select(by, "t_stat")
    return a.join(t.hint("merge"), by).withColumn("icir", ratio(F.col("mean_ic"), F.col("std_ic")))


def ic_decay(predictions: DataFrame, labels: DataFrame, horizons: list[int]) -> DataFrame:
    """(model, horizon, n_dates, mean_ic, t_stat) of the rank IC at each horizon, over dates with three names or more."""
    df = predictions.select("model", "date", "symbol", "prediction").join(labels.select("date", "symbol", *[f"fwd_ret_{h}" for h in horizons]).hint("merge"), ["date", "symbol"], "left")
    long = df.unpivot(["model", "date", "symbol", "prediction"], [f"fwd_ret_{h}" for h in horizons], "horizon", "target").withColumn("horizon", F.regexp_extract("horizon", r"(\d+)$", 1).cast("int"))
    ics = ic_by_date(long.withColumn("model", F.concat_ws("|", "model", "horizon")), by="model").filter("n >= 3 and rank_ic is not null")
    t = newey_west(ics, "rank_ic", ["model"])
    return t.select(F.split_part("model", F.lit("|"), F.lit(1)).alias("model"), F.split_part("model", F.lit("|"), F.lit(2)).cast("int").alias("horizon"), F.col("n").alias("n_dates"), F.col("mean").alias("mean_ic"), "t_stat")


def ic_matrix(ics: DataFrame, column: str = "rank_ic") -> DataFrame:
    """(date, model, ic) of the dates on which every model that has any value has one."""
    some = ics.filter(F.col(column).isNotNull()).select("date", "model", F.col(column).alias("ic"))
    live = some.agg(F.count_distinct("model").alias("models"))
    whole = some.groupBy("date").agg(F.count("*").alias("k")).crossJoin(F.broadcast(live)).filter("k = models").select("date")
    return some.join(whole.hint("merge"), "date", "left_semi")


def rolling_ic(ics: DataFrame, window: int = 63, least: int = 21) -> DataFrame:
    w = Window.partitionBy("model").orderBy("date").rowsBetween(-(window - 1), 0)
    return ics.select("model", "date", F.when(F.count("rank_ic").over(w) >= least, F.avg("rank_ic").over(w)).alias("rolling_ic"))


def density(df: DataFrame, x: str, y: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of square bins of two columns."""
    b = lambda c: F.floor((F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi - 1e-12)) - lo) / (hi - lo) * bins).cast("int")
    return df.filter(f"{x} is not null and {y} is not null").groupBy(b(x).alias("bin_x"), b(y).alias("bin_y")).agg(F.count("*").alias("n"))


def correlations(features: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of every pair of columns over the rows where both are known: one aggregation."""
    pairs = list(itertools.combinations(columns, 2))
    both = lambda a, b, c: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c))
    one = features.agg(*[F.corr(both(a, b, a), both(a, b, b)).alias(f"{a}|{b}") for a, b in pairs])
    return one.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "corr")


# --- overfitting -------------------------------------------------------------------------------------------------


#: A rational approximation of the normal distribution to double precision (Hart 1968), by powers from the highest.
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_LOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x):
    """Distribution function of the standard normal, by SQL functions; null for null and NaN. Beyond 7 in size a continued fraction."""
    a = F.abs(x)
    power = lambda c: reduce(lambda t, k: t * a + k, c[1:], F.lit(c[0]))
    far = reduce(lambda t, k: a + k / t, (4, 3, 2, 1), a + 0.65) * 2.506628274631
    tail = F.exp(-a * a / 2) * F.when(a < 7.07106781186547, power(_TOP) / power(_LOW)).otherwise(1 / far)
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x > 0, 1 - tail).otherwise(tail))


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    """Of n independent trials without skill."""
    if n_trials < 2 or variance <= 0:
        return 0.0
    inv = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * inv(1 - 1 / n_trials) + EULER * inv(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(returns: DataFrame, by: list[str], n_trials: int, trial_variance: float | None = None) -> DataFrame:
    """Per group: n, the per-period Sharpe ratio and its probability of exceeding 0 and the expected maximum of n_trials. The normal
    distribution is evaluated on the aggregated rows, one a group."""
    one = returns.groupBy(*by).agg(F.count("r").alias("n"), F.avg("r").alias("m_"), F.stddev_samp("r").alias("s_"), F.skewness("r").alias("g3_"), (F.kurtosis("r") + 3).alias("g4_"))
    one = one.withColumn("sharpe", ratio(F.col("m_"), F.col("s_")))
    var = F.lit(trial_variance) if trial_variance is not None else 1 / (F.col("n") - 1)
    unit = expected_max_sharpe(n_trials, 1.0)
    one = one.withColumn("threshold", F.sqrt(var) * unit)
    z = lambda c: (F.col("sharpe") - c) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("g3_") * F.col("sharpe") + (F.col("g4_") - 1) / 4 * F.col("sharpe") ** 2)
    return one.select(*by, "n", "sharpe", (F.col("sharpe") * PERIODS_PER_YEAR ** 0.5).alias("annual_sharpe"), "threshold", normal_cdf(z(F.lit(0.0))).alias("psr"), normal_cdf(z(F.col("threshold"))).alias("deflated_sharpe_prob"))


def overfitting_probability(matrix: DataFrame, n_blocks: int = 16, max_combinations: int | None = None, seed: int = 7) -> DataFrame:
    """One row: combinations, the share of them in which the strategy that is best in one half of the blocks ranks in the lower half in
    the other, and the mean logit. matrix: (date, strategy, r), every strategy on every date. Sums and sums of squares per block and
    strategy are all that the combinations read. Where there are more than max_combinations, those with the least hashes count."""
    days = matrix.select("date").distinct().withColumn("block", F.ntile(n_blocks).over(Window.orderBy("date")) - 1)
    parts = cut(matrix.join(days.hint("merge"), "date").groupBy("block", "strategy").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss")), "blocks")
    chosen = combinations(matrix.sparkSession, n_blocks, n_blocks // 2, max_combinations, seed)
    # a row per combination and block, on the side where the block stands
    table = chosen.select("combo", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "chosen").select("combo", "block", F.array_contains("chosen", F.col("block")).alias("inside"))
    half = table.hint("merge").join(parts.hint("merge"), "block").groupBy("combo", "strategy", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    sharpe = mean / F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(1e-18)))
    both = half.groupBy("combo", "strategy").agg(F.max(F.when(F.col("inside"), sharpe)).alias("i"), F.max(F.when(~F.col("inside"), sharpe)).alias("o"))
    w = Window.partitionBy("combo")
    best = F.row_number().over(w.orderBy(F.desc("i"), "strategy"))
    # how many are no better outside
    both = both.withColumns({"best": best, "rank": F.count("*").over(w.orderBy("o").rangeBetween(Window.unboundedPreceding, Window.currentRow)), "k": F.count("*").over(w)})
    u = F.col("rank") / (F.col("k") + 1)
    won = both.filter("best = 1").select(F.log(u / (1 - u)).alias("logit"))
    return won.agg(F.count("*").alias("combinations"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg("logit").alias("mean_logit"))


def bootstrap(returns: DataFrame, resamples: int = 500, block: int = 20, seed: int = 7) -> DataFrame:
    """One row: 5, 50 and 95 % of the annual return and Sharpe ratio over circular moving-block resamples of (date, r), whose starts are
    hashes (md5) of seed, resample and block.

    Sums of r, r^2 and log(1 + r), and the numbers of losses that leave nothing or less, up to each position make a block of a resample the
    difference of two rows, and that of a block that goes past the end the sum of two differences. r is centred for the squares."""
    spark = returns.sparkSession
    known = returns.filter("r is not null")
    totals = known.agg(F.count("*").alias("n"), F.coalesce(F.avg("r"), F.lit(0.0)).alias("mean")).first()
    n, centre = totals["n"], totals["mean"]
    if not n:
        return spark.createDataFrame([(None,) * 6], ", ".join(f"{name}_{p} double" for name in ("annual_return", "sharpe") for p in ("p05", "p50", "p95")))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    e, growth = F.col("r") - centre, 1 + F.col("r")
    upto = known.select(
        F.row_number().over(Window.orderBy("date")).alias("i"), F.sum(e).over(before).alias("s"), F.sum(e * e).over(before).alias("ss"), F.sum(F.when(growth != 0, F.log(F.abs(growth))).otherwise(0.0)).over(before).alias("g"),
        F.sum((growth < 0).cast("int")).over(before).alias("minus"), F.sum((growth == 0).cast("int")).over(before).alias("zero"))
    zero = spark.range(1).select(F.lit(0).alias("i"), *[F.lit(0.0).alias(c) for c in ("s", "ss", "g")], *[F.lit(0).cast("long").alias(c) for c in ("minus", "zero")])
    upto = cut(upto.unionByName(zero), "prefix")
    blocks = -(-n // block)
    draws = spark.range(resamples).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("k").cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n))
    length = F.least(F.lit(block), F.lit(n) - F.col("b") * block)
    draws = draws.select("k", start.alias("lo"), length.alias("length"))
    # ends of differences with their signs: past the end, whole rounds and what is left of the last
    hi = F.col("lo") + F.col("length")
    ends = draws.select("k", F.explode(F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("lo").alias("i")), F.struct(F.lit(1).alias("sign"), (hi % n).alias("i")), F.struct(F.floor(hi / n).cast("int").alias("sign"), F.lit(n).cast("long").alias("i")))).alias("e")).select("k", "e.*").filter("sign <> 0")
    signed = lambda c: F.sum(F.col("sign") * F.col(c)).alias(c)
    each = ends.groupBy("k", "i").agg(F.sum("sign").alias("sign")).hint("merge").join(upto.hint("merge"), "i").groupBy("k").agg(*[signed(c) for c in ("s", "ss", "g", "minus", "zero")])
    total = F.when(F.col("zero") > 0, 0.0).when(F.col("minus") % 2 == 1, 0.0).otherwise(F.exp("g"))
    mean, var = centre + F.col("s") / n, (F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1) if n > 1 else F.lit(None).cast("double")
    each = each.select((F.pow(total, PERIODS_PER_YEAR / n) - 1).alias("a"), (mean / F.when(var > 1e-24, F.sqrt(var)) * PERIODS_PER_YEAR ** 0.5).alias("s"))
    qs = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    out = each.agg(F.percentile("a", qs).alias("a"), F.percentile("s", qs).alias("s"))
    return out.select(*[F.element_at(c, i + 1).alias(f"{name}_{p}") for c, name in (("a", "annual_return"), ("s", "sharpe")) for i, p in enumerate(("p05", "p50", "p95"))])


def placebo(predictions: DataFrame, seed: int = 7) -> DataFrame:
    """Predictions dealt anew among the names of each model and date, in the order of md5 of seed, date and symbol."""
    w = Window.partitionBy("model", "date")
    a = predictions.drop("prediction").withColumn("n_", F.row_number().over(w.orderBy("symbol")))
    b = predictions.select("model", "date", "prediction", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("date").cast("string"), "symbol")), "symbol")).alias("n_"))
    return a.join(b.hint("merge"), ["model", "date", "n_"]).drop("n_")


def trial_ledger(trials: DataFrame) -> DataFrame:
    """Adds entry_hash to the ordered trials (nr, payload): sha256 over the one before and the payload."""
    rows = trials.agg(F.array_sort(F.collect_list(F.struct("nr", "payload"))).alias("rows"))
    chain = F.expr("""aggregate(rows, named_struct('h', repeat('0', 64), 'out', cast(array() as array<struct<nr: int, payload: string, entry_hash: string>>)),
      (s, x) -> named_struct('h', sha2(concat(s.h, x.payload), 256), 'out', array_append(s.out, named_struct('nr', x.nr, 'payload', x.payload, 'entry_hash', sha2(concat(s.h, x.payload), 256)))), s -> s.out)""")
    return rows.select(F.explode(chain).alias("e")).select("e.*")


def select_candidate(metrics: DataFrame, metric: str = "rank_ic") -> DataFrame:
    """The best model by mean metric, then mean absolute error, then name."""
    means = metrics.groupBy("model").agg(F.avg(metric).alias(metric), F.avg("mae").alias("mae")).filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    return means.orderBy(F.desc(metric), "mae", "model").limit(1)

"""Quality rules: fixed base rules, and robust multivariate outliers by minimum-covariance-determinant estimates per language and source."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, claim, cut, shingle_hashes, slices, table, texts_of, word_hashes, words_of

#: Share of a group's rows that an estimate is fitted to, and rows that a group needs for an estimate of its own.
SUBSET, LEAST_ROWS = 0.75, 30
#: Concentration steps of every start, and at most of the best one; a fall of the log determinant below which it has converged.
FIRST_STEPS, MORE_STEPS, CONVERGED = 2, 6, 1e-3
#: Rows of its language that a group's estimate is shrunk towards count as so many of its own.
PRIOR_ROWS = 50
#: Squared distance beyond which a row is rejected: with five variables, about 1 in 10^7 rows of a normal distribution.
REJECT = 40.0
#: Groups up to this number are broadcast with their estimates (some 400 bytes each); more are joined by sorting.
BROADCAST_GROUPS = 10_000
STATS = ("x0", "x1", "x2", "x3", "x4")
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
STAT_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long"


def text_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base statistics of each whole text; words are [^ \\t-\\r]+ and lines are split at \\n."""
    out = {k.split()[0]: np.zeros(len(texts), np.int64) for k in STAT_SCHEMA.split(", ")}
    for lo, hi in slices(texts):
        some, n = texts[lo:hi], hi - lo
        data, starts, ends, doc = words_of(some)
        out["n_words"][lo:hi] = np.bincount(doc, minlength=n)
        # code points are the bytes that do not continue a character; no byte of a word is white space
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        out["word_chars"][lo:hi] = np.bincount(doc, heads[ends] - heads[starts], minlength=n).astype(np.int64)
        hashes = word_hashes(data, starts, ends, fold=False)
        out["n_repeat_words"][lo:hi] = _repeated(hashes, doc, n)
        keys = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12)))
        new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        out["n_distinct"][lo:hi] = np.bincount((keys[new] >> np.uint64(52)).astype(np.int64), minlength=n)
        for i, t in enumerate(some, lo):
            out["n_symbols"][i] = len(_SYMBOLS.findall(t))
            if b"\n" in t:
                lines = [x for x in t.split(b"\n") if x and not x.isspace()]
                out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
            else:
                out["n_lines"][i] = out["n_words"][i] > 0
    return out


def _repeated(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each text that stand in a 3-word window found twice or more in it."""
    at = np.flatnonzero(doc[:-2] == doc[2:]) if len(doc) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(n, np.int64)
    long = np.bincount(doc, minlength=n) >= 3
    windows, of = shingle_hashes(hashes, doc, n, 3)
    windows, of = windows[: len(at)], of[: len(at)]  # what follows are whole short texts
    assert long[of].all()
    key = (of.astype(np.uint64) << np.uint64(52)) | (windows >> np.uint64(12))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = at[order[twice]]
    covered = np.zeros(len(doc), bool)
    for k in range(3):
        covered[first + k] = True
    return np.bincount(doc[covered], minlength=n)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim(None)
    for batch in bounded(batches):
        stats = text_statistics(texts_of(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(v) for v in stats.values()], names=["doc_id", "lang", "source", *stats])


def transformed() -> list[Column]:
    """The vector whose outliers are rejected: logarithms and logits-like roots that make the statistics' spread about even."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("n_words").cast("double")).alias("x0"),
        F.log((F.col("word_chars") + 1) / words).alias("x1"),
        F.sqrt(F.col("n_symbols") / words).alias("x2"),
        F.sqrt((F.col("n_dup_lines") + F.col("n_repeat_words") / 20) / words).alias("x3"),
        (F.log((F.col("n_distinct") + 1) / words) / F.log1p(words.cast("double"))).alias("x4"),
    ]


# --- minimum covariance determinant ------------------------------------------------------------------------------

#: Least spread of the statistics, in any direction when each is measured in its own: below it, a difference of texts means nothing.
FLOOR = np.array([0.5, 0.08, 0.08, 0.05, 0.03])
P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_EDGES = 16  # bins of a doubling of the squared distance
KEYS = ["group_lang", "group_source"]
FIT_SCHEMA = "group_lang string, group_source string, start int, mu array<double>, cov array<double>, inv array<double>, logdet double, fell double, n long"


def _chi2(x: float, dof: int) -> float:
    """Distribution function of chi-squared with 5 or 7 degrees of freedom."""
    five = math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    return five - (math.sqrt(2 / math.pi) * x**2.5 * math.exp(-x / 2) / 15 if dof == 7 else 0.0)


def consistency(share: float) -> float:
    """Factor that makes the covariance of the inner share of normal rows that of all of them."""
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, 5) < share else (low, mid)
    return share / _chi2(low, 7)


def floored(cov: np.ndarray) -> np.ndarray:
    """cov with at least the spread FLOOR in every direction."""
    values, vectors = np.linalg.eigh(cov / np.outer(FLOOR, FLOOR))
    return (vectors * np.maximum(values, 1.0)) @ vectors.T * np.outer(FLOOR, FLOOR)


def _fit_row(of: pd.DataFrame, start: int, mu: np.ndarray, cov: np.ndarray, n: int, before: float = np.inf) -> pd.DataFrame:
    cov = floored(cov)
    logdet = float(np.linalg.slogdet(cov)[1])
    return pd.DataFrame({
        "group_lang": [of["group_lang"].iloc[0]], "group_source": [of["group_source"].iloc[0]], "start": [start], "mu": [mu.tolist()], "cov": [cov.ravel().tolist()],
        "inv": [np.linalg.inv(cov).ravel().tolist()], "logdet": [logdet], "fell": [before - logdet], "n": [n]})


def _start(counts: pd.DataFrame) -> pd.DataFrame:
    """Medians and median deviations of one group from the counts of its bins (stat, bin, n)."""
    mu, sd = [], []
    for k in range(P):
        one = counts[counts["stat"] == k].sort_values("bin")
        x, n = one["bin"].to_numpy() / 128.0, one["n"].to_numpy()
        mid = x[np.searchsorted(np.cumsum(n), n.sum() / 2)]
        dev = np.abs(x - mid)
        order = np.argsort(dev, kind="stable")
        sd.append(1.4826 * dev[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])
        mu.append(mid)
    return _fit_row(counts, 0, np.array(mu), np.diag(np.square(sd)), int(counts[counts["stat"] == 0]["n"].sum()))


def _moments(columns: list[Column]) -> list[Column]:
    return [F.sum(x).alias(f"s{i}") for i, x in enumerate(columns)] + [F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i, j in PAIRS]


def _mean_cov(sums: dict[str, float], n: float) -> tuple[np.ndarray, np.ndarray]:
    mu, cov = np.array([sums[f"s{i}"] for i in range(P)]) / n, np.zeros((P, P))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = sums[f"s{i}_{j}"] / n - mu[i] * mu[j]
    return mu, cov


def _other_starts(both: pd.DataFrame) -> pd.DataFrame:
    """From moments of all rows of a group (start 1) and of their directions from the median (start 2): mean and covariance; and the median
    with the directions' covariance, scaled to the medians' deviations."""
    of, n = both.iloc[0], int(both["n"].iloc[0])
    mu, cov = _mean_cov({c: of[c] for c in both.columns if c[0] == "s"}, n)
    sign = np.zeros((P, P))
    for i, j in PAIRS:
        sign[i, j] = sign[j, i] = of[f"d{i}_{j}"] / n
    sign *= np.trace(np.array(of["cov"]).reshape(P, P) / np.outer(FLOOR, FLOOR)) / max(np.trace(sign), 1e-12)
    return pd.concat([_fit_row(both, 1, mu, cov, n), _fit_row(both, 2, np.array(of["mu"]), sign * np.outer(FLOOR, FLOOR), n)])


def _concentrate(bins: pd.DataFrame) -> pd.DataFrame:
    """One C-step of a group from the moments of its bins of squared distance: mean and covariance of the nearest SUBSET of its rows; of the
    bin in which the subset ends, its share counts."""
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy().astype(float)
    want = np.ceil(SUBSET * n.sum())
    share = np.clip((want - (np.cumsum(n) - n)) / n, 0, 1)
    sums = {c: float((bins[c].to_numpy() * share).sum()) for c in bins.columns if c[0] == "s" and c[1:2].isdigit()}
    mu, cov = _mean_cov(sums, want)
    return _fit_row(bins, int(bins["start"].iloc[0]), mu, consistency(SUBSET) * cov, int(n.sum()), bins["before"].iloc[0])


def _shrunk(fit: pd.DataFrame) -> pd.DataFrame:
    """The inverse of a group's covariance, shrunk towards that of its language, of which it is a part."""
    for k in range(len(fit)):
        if fit["own_cov"].iloc[k] is not None and fit["lang_cov"].iloc[k] is not None:
            n = fit["own_n"].iloc[k]
            cov = (n * np.array(fit["own_cov"].iloc[k]) + PRIOR_ROWS * np.array(fit["lang_cov"].iloc[k])) / (n + PRIOR_ROWS)
            fit.at[fit.index[k], "inv"] = np.linalg.inv(cov.reshape(P, P)).ravel().tolist()
    return fit


def distance() -> Column:
    d = [F.col(x) - F.element_at("mu", i + 1) for i, x in enumerate(STATS)]
    out = F.lit(0.0)
    for i, j in PAIRS:
        out = out + (1 if i == j else 2) * d[i] * d[j] * F.element_at("inv", i * P + j + 1)
    return F.greatest(out, F.lit(0.0))


def strategy(groups: DataFrame) -> str:
    """How rows are joined with groups, a written table with a row for each: broadcast if they are counted to be few, by sorting otherwise."""
    return "broadcast" if groups.count() <= BROADCAST_GROUPS else "merge"


def _step(rows: DataFrame, fit: DataFrame, how: str) -> DataFrame:
    near = rows.join(fit.select(*KEYS, "start", "mu", "inv", "logdet").hint(how), KEYS).withColumn("bin", F.floor(F.log2(distance() + 2.0**-20) * _EDGES))
    sums = near.groupBy(*KEYS, "start", "bin").agg(F.count("*").alias("n"), F.max("logdet").alias("before"), *_moments([F.col(x) for x in STATS]))
    return cut(sums.groupBy(*KEYS, "start").applyInPandas(_concentrate, FIT_SCHEMA), "fit")


def robust_fit(rows: DataFrame) -> DataFrame:
    """(group_lang, group_source, start, mu, cov, inv, logdet, fell, n): the estimate of each group over all its rows (group_lang, group_source, x0 to
    x4), a deterministic search for the minimum covariance determinant.

    Three starts (medians with their deviations; mean and covariance; medians with the covariance of directions) take FIRST_STEPS
    concentration steps each; the one with the least determinant goes on until no group's determinant falls any more. A step sums
    moments by bin of distance, partially before the shuffle, whatever the size of a group."""
    binned = rows.select(*KEYS, F.posexplode(F.array(*[F.floor(F.col(x) * 128 + 0.5).cast("long") for x in STATS])).alias("stat", "bin"))
    first = cut(binned.groupBy(*KEYS, "stat", "bin").agg(F.count("*").alias("n")).groupBy(*KEYS).applyInPandas(_start, FIT_SCHEMA), "fit")
    away = [(F.col(x) - F.element_at("mu", i + 1)) / float(FLOOR[i]) for i, x in enumerate(STATS)]
    norm = sum((a * a for a in away[1:]), away[0] * away[0]) + 1e-9
    ways = [F.sum(away[i] * away[j] / norm).alias(f"d{i}_{j}") for i, j in PAIRS]
    how = strategy(first)
    sums = rows.join(first.select(*KEYS, "mu").hint(how), KEYS).groupBy(*KEYS).agg(F.count("*").alias("n"), *_moments([F.col(x) for x in STATS]), *ways)
    others = sums.join(first.select(*KEYS, "mu", "cov").hint("merge"), KEYS).groupBy(*KEYS).applyInPandas(_other_starts, FIT_SCHEMA)
    fit = cut(first.union(others), "fit")
    for _ in range(FIRST_STEPS):
        fit = _step(rows, fit, how)
    names = fit.columns
    fit = cut(fit.groupBy(*KEYS).agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("f")).select("f.*"), "fit")
    for _ in range(MORE_STEPS):
        fit = _step(rows, fit, how)
        fell = fit.agg(F.max("fell")).first()[0]
        if fell is None or fell < CONVERGED:
            break
    return fit


def estimates(rows: DataFrame, least_rows: int) -> DataFrame:
    """(lang_, source_, mu, inv) for each language and source in rows (lang_, source_, x0 to x4): its own estimate, shrunk towards its
    language's, where it has least_rows rows; else its language's, else that of all rows, where they have as many; else null."""
    levels = [("lang_", "source_"), ("lang_", None), (None, None)]
    group = [F.struct(*[(F.col(c) if c else F.lit("*")).alias(k) for c, k in zip(level, KEYS, strict=True)]) for level in levels]
    # a language with one source, or a corpus with one language, is estimated again at the next level: no case is told apart
    leveled = rows.select(F.explode(F.array(*group)).alias("g"), *STATS).select("g.*", *STATS)
    fit = cut(robust_fit(leveled).filter(F.col("n") >= least_rows), "fits")
    side = lambda name: fit.select(*KEYS, *[F.col(c).alias(f"{name}_{c}") for c in ("mu", "cov", "inv", "n")]).hint("merge")
    groups = rows.groupBy("lang_", "source_").agg(F.count("*").alias("rows_")).withColumns({"group_lang": F.col("lang_"), "group_source": F.col("source_")})
    all_ = groups.join(side("own"), KEYS, "left").drop(*KEYS)
    all_ = all_.join(side("lang").filter("group_source = '*'").drop("group_source").withColumnRenamed("group_lang", "lang_"), "lang_", "left")
    rest = fit.filter("group_lang = '*'").select(F.struct("mu", "inv")).scalar()  # one row, or none
    all_ = all_.withColumn("rest", rest)
    chosen = all_.select("lang_", "source_", "own_cov", "own_n", "lang_cov", F.coalesce("own_mu", "lang_mu", "rest.mu").alias("mu"), F.coalesce("own_inv", "lang_inv", "rest.inv").alias("inv"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return cut(chosen.mapInPandas(lambda parts: (_shrunk(x) for x in parts), shape).select("lang_", "source_", "mu", "inv"), "estimates")


def quality_rules(docs: DataFrame, *, reject: float = REJECT, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (squared, null without an estimate) and
    kept, one row per row of docs.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. The others are rejected if the squared robust
    distance of their statistics from those of their language and source is over reject; rows that failed do not take part in the
    estimates. Language and source groups under least_rows rows are judged by their language's estimate, languages under it by that of all
    rows; with less than that in all, nothing but the base rules rejects. Null texts have no words and fail; null languages and sources are
    values of their own; repeated rows count each; an empty table gives an empty result; other columns are not read."""
    stats = cut(docs.select("doc_id", "lang", "source", "text").mapInArrow(_measure, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, source string, {STAT_SCHEMA}"), "stats")
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # a prefix keeps null apart from any text, and "*" apart from both
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    rows = stats.select("*", *transformed(), name(F.col("lang")).alias("lang_"), name(F.col("source")).alias("source_"))
    chosen = estimates(rows.filter("not base_failed"), least_rows)
    judged = rows.join(chosen.hint(strategy(chosen)), ["lang_", "source_"], "left")
    judged = judged.withColumn("distance", F.when(F.col("mu").isNotNull() & ~F.col("base_failed"), distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= reject)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"), "lang", "source")


def op8_quality(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("lang", "source")

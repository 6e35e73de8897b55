"""Histogram trees of all windows at once: random forests and gradient boosting.

Features are binned per window at quantiles of its training rows. A level of the trees of all windows is one aggregation: workers count
rows and add up residuals by (window, tree, node, feature, bin), Spark adds the workers' counts, and running totals over the bins give each
node's best split. What comes back to the driver is a split per open node."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.plans.session import cut, ship

#: Bins of a feature, besides one for missing values; relative accuracy of their quantiles.
BINS, ACCURACY = 63, 10_000
#: Cells (window, tree, node, feature, bin) of one aggregation, about, which sets how many trees of a forest grow together.
CELLS = 4_000_000
#: Rounds of boosting after which predictions so far are written beside the rows.
REFRESH = 10
#: Counts that a worker gathers before it adds them up.
FLUSH = 2_000_000
#: Cumulated shares of a Poisson distribution of mean 1: how often a row counts in a bootstrap sample.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.append(1, np.arange(1, 12))))


@dataclass(frozen=True)
class Spec:
    """trees grow independently on bootstrap samples (boost False) or one after another on residuals."""

    name: str
    trees: int
    depth: int
    leaf: int
    rate: float = 1.0
    boost: bool = False
    seed: int = 7


def spec(name: str, kind: str, **params) -> Spec:
    """random_forest (trees 200, depth 6, leaf 50, seed) or gradient_boosting (rounds 300, depth 4, leaf 1, rate 0.05, seed)."""
    if kind == "random_forest":
        p = {"trees": 200, "depth": 6, "leaf": 50, "seed": 7} | params
        return Spec(name, p["trees"], p["depth"], p["leaf"], seed=p["seed"])
    if kind == "gradient_boosting":
        p = {"rounds": 300, "depth": 4, "leaf": 1, "rate": 0.05, "seed": 7} | params
        return Spec(name, p["rounds"], p["depth"], p["leaf"], p["rate"], True, p["seed"])
    raise ValueError(f"no tree model {kind}")


KINDS = ("random_forest", "gradient_boosting")


@dataclass
class Trees:
    """Trees of the windows, in order of heap: split feature (-1 for a leaf), last bin that goes left, value; what each feature gained."""

    windows: list
    base: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, windows: list, trees: int, depth: int, columns: int, base: np.ndarray) -> Trees:
        shape = (len(windows), trees, 2 ** (depth + 1) - 1)
        return cls(windows, base, np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape), np.zeros((len(windows), columns)))

    def node(self, w: np.ndarray, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """Where rows of windows w stand after so many levels; a leaf keeps its rows."""
        at, rows = np.zeros(len(w), np.int64), np.arange(len(w))
        for _ in range(levels):
            f = self.feature[w, tree, at]
            down = bins[rows, np.maximum(f, 0)] > self.bin[w, tree, at]
            at = np.where(f >= 0, 2 * at + 1 + down, at)
        return at

    def total(self, w: np.ndarray, bins: np.ndarray, lo: int, hi: int, depth: int) -> np.ndarray:
        """Sum of the values of trees lo to hi - 1."""
        out = np.zeros(len(w))
        for t in range(lo, hi):
            out += self.value[w, t, self.node(w, t, bins, depth)]
        return out


def sample_counts(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts in the bootstrap sample of a tree: Poisson, by a hash of the row's key."""
    x = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, x.astype(np.float64) / 2**64).astype(np.float64)


def bin_edges(train: DataFrame, columns: list[str]) -> dict:
    """Window to the edges of each column: distinct quantiles of its training rows. A row per window comes to the driver."""
    shares = [k / (BINS + 1) for k in range(1, BINS + 1)]
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    found = train.groupBy("window_id").agg(*[F.percentile_approx(number(c), shares, ACCURACY).alias(f"e{i}") for i, c in enumerate(columns)]).collect()
    return {r["window_id"]: [np.unique(np.array(r[f"e{i}"] or [], float)) for i in range(len(columns))] for r in found}


def binned(rows: DataFrame, edges: dict, columns: list[str], keep: list[str]) -> DataFrame:
    """keep, window_id, key and bins (a byte per column: 0 missing, else 1 and the edges below the value) of rows (window_id, columns)."""
    shared = rows.sparkSession.sparkContext.broadcast(edges)
    own = [f"c{i}_" for i in range(len(columns))]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = np.array(batch.column("window_id").to_pylist())
            out = np.zeros((batch.num_rows, len(own)), np.uint8)
            x = [batch.column(c).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in own]
            for w in np.unique(windows):
                mine = np.flatnonzero(windows == w)
                for i, e in enumerate(shared.value[w.item()]):
                    v = x[i][mine]
                    out[mine, i] = np.where(np.isfinite(v), 1 + np.searchsorted(e, v), 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*keep, "window_id", "key"]], pa.array([r.tobytes() for r in out], pa.binary())], names=[*keep, "window_id", "key", "bins"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keep, "window_id"]) + ", key long, bins binary"
    known = rows.filter(F.col("window_id").isin(list(edges))) if len(edges) < 100 else rows
    key = F.xxhash64(F.col("date").cast("string"), "symbol").alias("key")
    return known.select(*[c for c in dict.fromkeys([*keep, "window_id"])], key, *[F.col(c).cast("double").alias(o) for c, o in zip(columns, own, strict=True)]).mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows' windows, and their bins."""
    return np.searchsorted(windows, batch.column("window_id").to_numpy(zero_copy_only=False)), np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)


def _level(state: DataFrame, s: Spec, model: Trees, group: range, level: int, seen: tuple[int, int], width: int) -> list:
    """The best split of every open node of a level of the trees in group, for all windows: one job."""
    shared = state.sparkSession.sparkContext.broadcast(model)
    windows = np.array(model.windows)
    nodes, size = 2**level, BINS + 2

    def added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return cells, np.bincount(of, np.concatenate([p[1] for p in parts])), np.bincount(of, np.concatenate([p[2] for p in parts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m = shared.value
            w, bins = _rows(batch, windows, width)
            rest = batch.column("y").to_numpy(zero_copy_only=False) - batch.column("f").to_numpy(zero_copy_only=False)
            if s.boost:
                rest = rest - m.total(w, bins, *seen, s.depth)
            for j, tree in enumerate(group):
                at = m.node(w, tree, bins, level) - (nodes - 1)
                n = np.ones(len(w)) if s.boost else sample_counts(batch.column("key").to_numpy(zero_copy_only=False), tree, s.seed)
                some = np.flatnonzero((at >= 0) & (n > 0))  # a row below 0 has met a leaf
                base = ((w[some] * len(group) + j) * nodes + at[some])[:, None] * width + np.arange(width)
                cells = (base * size + bins[some]).ravel()
                parts.append(added([(cells, np.repeat(n[some], width), np.repeat(n[some] * rest[some], width))]))
                held += len(parts[-1][0])
                if held > FLUSH:
                    parts = [added(parts)]
                    held = len(parts[0][0])
        if parts:
            cells, n, total = added(parts)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n), pa.array(total)], names=["cell", "n", "s"])

    cells = state.mapInArrow(run, "cell long, n double, s double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    cells = cells.select("n", "s", F.expr(f"cast(cell % {size} as int)").alias("bin"), F.expr(f"cast(cell div {size} % {width} as int)").alias("feature"), F.expr(f"cell div {size * width}").alias("node"))
    by = Window.partitionBy("node", "feature")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.withColumns({"nl": F.sum("n").over(upto), "sl": F.sum("s").over(upto), "n": F.sum("n").over(by), "s": F.sum("s").over(by)})
    left, right = F.col("sl") * F.col("sl") / F.col("nl"), (F.col("s") - F.col("sl")) ** 2 / (F.col("n") - F.col("nl"))
    # rounded, so that the order of summation does not choose between equal splits
    gain = F.when((F.col("nl") >= s.leaf) & (F.col("n") - F.col("nl") >= s.leaf) & (F.col("n") > F.col("nl")), F.round(left + right - F.col("s") * F.col("s") / F.col("n"), 9))
    best = F.max(F.when(gain > 0, F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "nl", "sl")))
    return sums.groupBy("node").agg(best.alias("best"), F.max(F.when(F.col("feature") == 0, F.struct("n", "s"))).alias("all")).collect()


def _grow(state: DataFrame, s: Spec, model: Trees, group: range, seen: tuple[int, int], width: int) -> None:
    """All levels of the trees in group, for all windows."""
    for level in range(s.depth):
        found = _level(state, s, model, group, level, seen, width)
        for r in found:
            place, local = divmod(r["node"], 2**level)
            w, tree = place // len(group), group[place % len(group)]
            at = local + 2**level - 1
            n, total = r["all"]["n"], r["all"]["s"]
            model.value[w, tree, at] = s.rate * total / n
            b = r["best"]
            if b is None:
                continue
            model.feature[w, tree, at], model.bin[w, tree, at] = -b["feature"], -b["bin"]
            model.gain[w, -b["feature"]] += b["gain"]
            model.value[w, tree, 2 * at + 1] = s.rate * b["sl"] / b["nl"]
            model.value[w, tree, 2 * at + 2] = s.rate * (total - b["sl"]) / (n - b["nl"])
        if not any(r["best"] for r in found):
            break


def fit(train: DataFrame, s: Spec, width: int) -> Trees:
    """The model of s for every window of train (window_id, key, bins, y): rounds or groups of trees times levels jobs, whatever the number
    of windows."""
    means = {r["window_id"]: r["m"] for r in train.groupBy("window_id").agg(F.avg("y").alias("m")).collect()}
    windows = sorted(means)
    base = np.array([means[w] for w in windows]) if s.boost else np.zeros(len(windows))
    model = Trees.empty(windows, s.trees, s.depth, width, base)
    if not windows:
        return model
    start = F.lit(0.0)
    if s.boost:
        start = F.element_at(F.create_map(*[x for w in windows for x in (F.lit(w), F.lit(float(means[w])))]), F.col("window_id"))
    state = cut(train.select("window_id", "key", "bins", F.col("y").cast("double").alias("y"), start.alias("f")), "boosted")
    if not s.boost:
        at_once = max(1, min(s.trees, CELLS // (len(windows) * 2 ** max(0, s.depth - 1) * width * (BINS + 2))))
        for lo in range(0, s.trees, at_once):
            _grow(state, s, model, range(lo, min(s.trees, lo + at_once)), (0, 0), width)
        return model
    written = 0
    for t in range(s.trees):
        _grow(state, s, model, range(t, t + 1), (written, t), width)
        if t + 1 - written == REFRESH and t + 1 < s.trees:
            state, written = cut(_advanced(state, model, (written, t + 1), s.depth, width), "boosted"), t + 1
    return model


def _advanced(state: DataFrame, model: Trees, seen: tuple[int, int], depth: int, width: int) -> DataFrame:
    """state with the trees seen added to f."""
    shared, windows = state.sparkSession.sparkContext.broadcast(model), np.array(model.windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w, bins = _rows(batch, windows, width)
                f = batch.column("f").to_numpy(zero_copy_only=False) + shared.value.total(w, bins, *seen, depth)
                yield batch.set_column(batch.schema.get_field_index("f"), "f", pa.array(f))

    return state.mapInArrow(run, state.schema)


def run_trees(data: DataFrame, roles: DataFrame, specs: list[Spec], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions, importances) of every model and window. data (date, symbol, features, target), roles (window_id, date, role).

    Missing and non-finite features have a bin of their own, below all others. Windows without a training row are left out. Importances
    are shares of what the splits gain. A model is windows x trees x nodes numbers, which workers get as a whole: 12
    bytes a node, 4.5 MB for 40 windows of 300 rounds of depth 4. Equal seeds give equal models."""
    spark, width = ship(data.sparkSession), len(columns)
    rows = data.filter("target is not null").select("date", "symbol", *columns, "target").join(roles.select("window_id", "date", "role").hint("merge"), "date")
    rows = cut(rows, "assigned")
    train, test = (rows.filter(F.col("role") == role) for role in ("train", "test"))
    edges = bin_edges(train, columns)
    train = cut(binned(train.withColumn("y", F.col("target").cast("double")), edges, columns, ["y"]), "binned")
    ready = cut(binned(test, edges, columns, ["date", "symbol", "target"]), "binned")
    kind = dict(roles.dtypes)["window_id"]
    parts, sizes = [], []
    for s in specs:
        model = fit(train, s, width)
        sums = model.gain.sum(1, keepdims=True)
        share = model.gain / np.where(sums > 0, sums, 1.0)
        sizes += [(s.name, w, c, float(share[i, j])) for i, w in enumerate(model.windows) for j, c in enumerate(columns)]
        parts.append(_predicted(ready, s, model, width))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, spark.createDataFrame(sizes, f"model string, window_id {kind}, feature string, importance double")


def _predicted(ready: DataFrame, s: Spec, model: Trees, width: int) -> DataFrame:
    shared, windows = ready.sparkSession.sparkContext.broadcast(model), np.array(model.windows)
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = shared.value
                w, bins = _rows(batch, windows, width)
                found = m.base[w] + m.total(w, bins, 0, s.trees, s.depth) / (1 if s.boost else s.trees)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("date", "symbol")], pa.array([s.name] * len(w)), batch.column("window_id"), batch.column("target"), pa.array(found)], names=["date", "symbol", "model", "window_id", "target", "prediction"])

    return ready.mapInArrow(run, f"date {kinds['date']}, symbol {kinds['symbol']}, model string, window_id {kinds['window_id']}, target {kinds['target']}, prediction double")

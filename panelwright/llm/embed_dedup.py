"""Embedding near-duplicates by collision-counting projections.

Vectors of length one are projected onto orthonormal directions. Two vectors with cosine c lie sqrt(2 - 2c) apart, so that each of their
projections differs like a normal variable with that spread over sqrt(dimensions). The first projections deal the vectors into cells, in
which a query meets everything in its window; there, sorted by one more projection, each query counts in how many of the remaining
projections a candidate falls into its window, and verifies the cosine of those with enough collisions. Windows and the count are
calibrated on the least cosine that links."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, components, cut, table

#: Projections that deal cells, and those whose collisions are counted.
CELL_DIMS, COUNTED = 3, 24
#: Half widths of the windows of cells and of counted projections, in standard deviations at the threshold; share of linked pairs that may
#: fall below the collision count.
CELL_SIGMAS, COUNT_SIGMAS, LOST = 4.5, 2.0, 1e-6
#: Queries and candidates that one task compares at most, about.
BLOCK = 4096
STEP = 512
#: Pairs whose cosine is verified at once.
PAIRS = 1 << 15
SEED = 11


def directions(dim: int) -> np.ndarray:
    """CELL_DIMS + 1 + COUNTED unit vectors, orthogonal in runs of dim."""
    rng = np.random.default_rng(SEED)
    need = CELL_DIMS + 1 + COUNTED
    return np.vstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-need // dim))])[:need]


def spread(dim: int, cosine: float) -> float:
    return math.sqrt((2 - 2 * cosine) / dim)


def least_collisions() -> int:
    """The largest count that a linked pair at the threshold reaches with probability 1 - LOST or more."""
    p = math.erf(COUNT_SIGMAS / math.sqrt(2))
    below = 0.0
    for k in range(COUNTED + 1):
        below += math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)
        if below > LOST:
            return k
    return COUNTED


def _units(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows that can be compared, by length: vectors without null or non-finite components and not zero, scaled to length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.asarray(column.value_lengths().fill_null(0))
    starts = np.concatenate(([0], np.cumsum(lens)))[:-1]
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    out, good = {}, np.zeros(len(lens), bool)
    for dim in np.unique(lens[lens > 0]):
        rows = np.flatnonzero(lens == dim)
        v = flat[starts[rows][:, None] + np.arange(dim)]
        ok = np.isfinite(v).all(1)
        v[~ok] = 0
        big = np.abs(v).max(1)
        ok &= big > 0
        rows, v, big = rows[ok], v[ok], big[ok]
        v = v / big[:, None]
        good[rows] = True
        out[int(dim)] = (rows, v / np.linalg.norm(v, axis=1, keepdims=True))
    return good, out


def _deal(cosine: float):
    def run(batches):
        for batch in batches:
            _, found = _units(batch.column("embedding"))
            for dim, (rows, v) in found.items():
                width = 2 * CELL_SIGMAS * spread(dim, cosine)
                at = v @ directions(dim)[:CELL_DIMS].T / width
                home = np.floor(at).astype(np.int64)
                data = [x.tobytes() for x in v]
                ids, labels, copies = (batch.column(c).take(pa.array(rows)) for c in ("vec_id", "label", "copies"))
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, copies, pa.array(np.full(len(rows), dim)), pa.array(data, pa.binary()), *[pa.array(x) for x in home.T],
                     *[pa.array(x) for x in (np.floor(at + 0.5) - home).astype(np.int64).T]],
                    names=["vec_id", "label", "copies", "dim", "unit", *[f"c{i}" for i in range(CELL_DIMS)], *[f"up{i}" for i in range(CELL_DIMS)]])

    return run


def _tie(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ties the nodes x and y of every link in root (the smallest node each is known to reach, changed in place); returns the places of
    links that say as much about components as all of them: about one for every node that a link ties to a smaller one."""
    used = []
    at = np.arange(len(x))
    while len(at := at[root[x[at]] != root[y[at]]]):
        high, low = np.maximum(root[x[at]], root[y[at]]), np.minimum(root[x[at]], root[y[at]])
        up = np.arange(len(root))
        np.minimum.at(up, high, low)
        hooked = np.flatnonzero(up[high] == low)
        used.append(at[hooked[np.unique(high[hooked], return_index=True)[1]]])
        while (up[up] != up).any():
            up = up[up]
        root[:] = up[root]
    return np.concatenate(used) if used else np.zeros(0, np.int64)


def _compare(cosine: float):
    """Links of the queries of one block with its candidates: per query their number of copies and, for components, a few edges. vec_id is the key of a class of equal vectors."""
    least = least_collisions()

    def run(block: pa.Table) -> pa.Table:
        claim(None)
        ids, size = block.column("vec_id").to_numpy(), block.column("copies").to_numpy()
        is_query = block.column("query").to_numpy()
        dim = block.column("dim")[0].as_py()
        v = np.frombuffer(b"".join(block.column("unit").to_pylist()), np.float64).reshape(-1, dim)
        proj = v @ directions(dim)[CELL_DIMS:].T
        half, wide = COUNT_SIGMAS * spread(dim, cosine), CELL_SIGMAS * spread(dim, cosine)
        data = np.flatnonzero(~is_query)
        data = data[np.argsort(proj[data, 0], kind="stable")]
        queries = np.flatnonzero(is_query)
        queries = queries[np.argsort(proj[queries, 0], kind="stable")]
        vd, pd_ = v[data], proj[data]
        linked = np.zeros(len(ids), np.int64)
        distinct, node = np.unique(ids, return_inverse=True)
        root, edges = np.arange(len(distinct)), [np.zeros((0, 2), np.int64)]
        for lo in range(0, len(queries), STEP):
            q = queries[lo : lo + STEP]
            a = np.searchsorted(pd_[:, 0], proj[q[0], 0] - wide)
            b = np.searchsorted(pd_[:, 0], proj[q[-1], 0] + wide, side="right")
            for c in range(a, b, BLOCK):
                d = slice(c, min(c + BLOCK, b))
                hits = np.zeros((len(q), d.stop - d.start), np.uint8)
                for k in range(1, proj.shape[1]):
                    hits += np.abs(proj[q, k][:, None] - pd_[d, k][None, :]) <= half
                i, j = np.nonzero((hits >= least) & (ids[q][:, None] != ids[data[d]][None, :]))
                for part in range(0, len(i), PAIRS):  # so that a cloud of near copies takes no more memory than others
                    x, y = i[part : part + PAIRS], j[part : part + PAIRS]
                    close = np.einsum("nd,nd->n", v[q[x]], vd[d][y]) >= cosine
                    x, y = q[x[close]], data[d][y[close]]
                    np.add.at(linked, x, size[y])
                    kept = _tie(root, node[x], node[y])
                    edges.append(np.stack((ids[x[kept]], ids[y[kept]]), 1))
        q = queries[linked[queries] > 0]
        n, edge = len(q), np.concatenate(edges)
        return pa.table({
            "vec_id": pa.array(np.concatenate((ids[q], edge[:, 0]))), "other": pa.array([None] * n + edge[:, 1].tolist(), pa.int64()),
            "links": pa.array(np.concatenate((linked[q], np.zeros(len(edge), np.int64))))})

    return run


def embedding_near_duplicates(vectors: DataFrame, *, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label): rows with equal labels are linked if the
    cosine of their vectors, in double precision, is at least the given one.

    Equal vectors of a label are one class with its number of copies, compared once. A hot cell is dealt in blocks of queries by blocks of
    candidates. n_links counts other rows; links are counted where they are found, and only a spanning forest of each block is kept for
    components. Vectors that are null, empty, zero or hold null or non-finite components, and rows without label or vec_id, link with
    nothing (their own component); vectors of different lengths are not compared; rows that repeat a vec_id are vectors each, copies where
    the vector is the same and links where it is near, and each has the links and component of its own vector; an empty table gives an empty
    result; other columns are not read."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    label = dict(rows.dtypes)["label"]
    classes = rows.filter("label is not null and vec_id is not null and embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # the key of a class, since a vec_id may have several vectors
    classes = cut(classes.withColumn("vec_id", F.monotonically_increasing_id()), "vectors")
    ints = ", ".join(f"{c}{i} long" for c in ("c", "up") for i in range(CELL_DIMS))
    dealt = cut(classes.select("vec_id", "label", "copies", "embedding").mapInArrow(_deal(cosine), f"vec_id long, label {label}, copies long, dim long, unit binary, {ints}"), "dealt")
    cell = [f"c{i}" for i in range(CELL_DIMS)]
    # a window as wide as a cell around a vector reaches into its own cell and, in each direction, the nearer neighbour
    probes = F.array(*[F.struct(*[(F.col(f"c{i}") + (F.when(F.col(f"up{i}") > 0, 1).otherwise(-1) if mask >> i & 1 else 0)).alias(f"c{i}") for i in range(CELL_DIMS)]) for mask in range(1 << CELL_DIMS)])
    counts = dealt.groupBy("label", "dim", *cell).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    counts = cut(counts, "cells")
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    data = dealt.join(counts.hint("merge"), ["label", "dim", *cell]).select("label", "dim", *cell, "vec_id", "unit", "copies", F.lit(False).alias("query"), block("blocks").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    asked = dealt.select("label", "dim", "vec_id", "unit", "copies", F.explode(probes).alias("p")).select("label", "dim", "p.*", "vec_id", "unit", "copies")
    query = asked.join(counts.hint("merge"), ["label", "dim", *cell]).select("label", "dim", *cell, "vec_id", "unit", "copies", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), block("blocks").alias("j"))
    # dealt by block: as the joins above deal by cell, all blocks of a hot one would else stay in one task
    dealt_out = data.unionByName(query).repartition("label", "dim", *cell, "i", "j")
    found = dealt_out.groupBy("label", "dim", *cell, "i", "j").applyInArrow(_compare(cosine), "vec_id long, other long, links long")
    found = cut(found, "found")
    links = found.filter("links > 0").groupBy("vec_id").agg(F.sum("links").alias("links"))
    comp = cut(components(found.filter("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))), "components")
    # the smallest vec_id of a component's classes
    lowest = comp.join(classes.select(F.col("vec_id").alias("node"), "least").hint("merge"), "node").groupBy("component").agg(F.min("least").alias("lowest"))
    comp = comp.join(lowest.hint("merge"), "component").select(F.col("node").alias("vec_id"), "lowest")
    result = classes.join(links.hint("merge"), "vec_id", "left").join(comp.hint("merge"), "vec_id", "left").select(
        "label", "embedding", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("lowest", "least").alias("component"), F.col("vec_id").alias("rep"))
    finite = F.expr("exists(embedding, x -> x <> 0) and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    out = rows.join(result.hint("merge"), ["label", "embedding"], "left").withColumn("good", F.coalesce(finite, F.lit(False)) & F.col("rep").isNotNull() & F.col("vec_id").isNotNull())
    return out.select(
        "vec_id",
        F.when(F.col("good"), F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("good"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_dedup(spark, sf_dir):
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))

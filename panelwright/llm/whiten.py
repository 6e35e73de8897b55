"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed: a pass over the table gives V Q for a block Q of directions, as a sum of each task's
centred X'(X Q). A cycle takes the Rayleigh-Ritz values of the block, then a Chebyshev polynomial of V that stays within 1 on the part of
the spectrum below the block's least value and grows fast above it, applied by its three-term recurrence, a pass a term, and orthonormalizes
by QR. Cycles go on until the residuals of the wanted components certify them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import claim, cut, table

#: Components; directions of a block, as a multiple of these.
COMPONENTS, WIDE = 8, 3
#: Entries become whole numbers floor(SCALE * c) + SHIFT. Vectors with an entry of LIMIT or more do not fit and are left out.
SCALE, SHIFT, LIMIT = 1024, 100_000, 2.0**40
#: Residual of a certified component, as a share of the first eigenvalue; most terms of a polynomial and its largest value; cycles before the
#: block is widened to the whole space, which gives the components in one pass.
CERTIFIED, TERMS, GROWTH, CYCLES = 2e-14, 12, 1e8, 40
#: Eigenvalues below this share of the first are zero: they have no component.
ZERO = 1e-13
SEED = 17


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sum(vectors: DataFrame, partial: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all rows of partial(X), an array of fixed length that does not depend on the number of rows, in cells: each task adds up its
    own batches, Spark the tasks."""
    arrow = {"long": pa.int64(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(None)
        total = None
        for batch in batches:
            if batch.num_rows:
                own = partial(_matrix(batch.column("x"))).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total, arrow)], names=["cell", "value"])

    cells = vectors.select("x").mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(cells.num_rows, np.int64 if kind == "long" else np.float64)
    out[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less its mean; the difference is one of whole numbers, and exact."""
    return (n * x - sums) / n


class Covariance:
    """V as an operator: each product is a pass over the vectors."""

    def __init__(self, vectors: DataFrame, n: int, sums: np.ndarray):
        self.vectors, self.n, self.sums, self.passes = vectors, n, sums, 0

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums

        def partial(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ q)

        self.passes += 1
        return _sum(self.vectors, partial, "double").reshape(q.shape) / n


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, vectors and their images of the block, by falling value."""
    h = q.T @ vq
    values, u = np.linalg.eigh((h + h.T) / 2)
    u = u[:, ::-1]
    return values[::-1], q @ u, vq @ u


def components(v: Covariance, dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the wanted largest eigenvalues of v, fewer where the rest are zero.

    A component is certified when |V q - e q| is at most CERTIFIED of the first value, the rounding of a sum over all rows, or when two more
    cycles do not halve a residual that is already within 1000 times of it."""
    width = min(dim, WIDE * wanted)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, width)))[0]
    best, since = math.inf, 0
    for _ in range(CYCLES):
        values, q, vq = ritz(q, v @ q)
        first = max(values[0], 0.0)
        k = min(wanted, width)
        worst = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max()
        since = 0 if worst < best / 2 else since + 1
        best = min(best, worst)
        if width == dim or first == 0 or worst <= CERTIFIED * first or since >= 2 and worst <= 1000 * CERTIFIED * first:
            break
        # the unwanted spectrum lies in [0, edge]
        edge = max(values[-1], 1e-8 * first)
        half = edge / 2
        terms = max(1, min(TERMS, int(math.log(GROWTH) / math.acosh(max(2 * first / edge - 1, 1 + 1e-9)))))
        before, now = q, (vq - half * q) / half
        for _ in range(terms - 1):
            before, now = now, 2 * (v @ now - half * now) / half - before
        q = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]
    else:
        q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0]
        values, q, vq = ritz(q, v @ q)
    some = values[:wanted] > ZERO * max(values[0], 0.0)
    values, q = values[:wanted][some], q[:, :wanted][:, some]
    return values, q * np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])])


def _deviation(d: np.ndarray) -> list[int | None]:
    """Sums of squares of whole numbers, exact; null beyond 64 bits."""
    if not d.size or float(np.abs(d).max()) ** 2 * d.shape[1] < 2.0**62:
        return (d * d).sum(1).tolist()
    sums = [sum(int(e) ** 2 for e in row) for row in d.tolist()]
    return [s if s < 2**63 else None for s in sums]


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row of embeddings (vec_id, embedding) that can be
    used and each of the wanted components.

    Left out are vectors that are null or empty, hold null or non-finite entries, entries of 2^40 or more, or have another length than most
    (of equally frequent lengths, the shortest counts). Repeated rows and ids count each; a null vec_id stays null. Directions without
    variance have no component, so that a single vector or equal vectors give no rows, nor does an empty table; equal eigenvalues share
    some basis of their space. deviation is null where it needs more than 64 bits. Other columns are not read. What a pass gathers is the
    size of the block of directions, whatever the number of rows; the table is read once for all."""
    c = F.col("embedding").cast("array<double>")
    usable = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LIMIT))
    rows = embeddings.select("vec_id", c.alias("v")).filter("v is not null and size(v) > 0").filter(usable)
    whole = cut(rows.select("vec_id", F.transform("v", lambda e: F.floor(e * SCALE).cast("long") + SHIFT).alias("x")), "vectors")
    kind = dict(embeddings.dtypes)["vec_id"]
    schema = f"vec_id {kind}, {SCHEMA}"
    common = whole.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    dim, n = common
    vectors = whole.filter(F.size("x") == dim)
    sums = _sum(vectors, lambda x: x.sum(0), "long")
    v = Covariance(vectors, n, sums)
    values, q = components(v, dim, wanted)
    k = len(values)
    scaled = q / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        c = _centred(x, n, sums)
        z = c @ scaled
        return np.append((z.T @ z).ravel(), (c * c).sum())

    *cov, square = (_sum(vectors, moments, "double") / n).tolist()
    error = float(np.abs(np.array(cov).reshape(k, k) - np.eye(k)).max()) if k else 0.0
    explained = values / square if square else values
    ids = to_arrow_type(embeddings.schema["vec_id"].dataType)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(None)
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            d = n * _matrix(batch.column("x")) - sums
            r = batch.num_rows
            whole_ids = batch.column("vec_id").cast(ids).take(pa.array(np.repeat(np.arange(r), k)))
            deviation = pa.array(_deviation(d), pa.int64()).take(pa.array(np.repeat(np.arange(r), k)))
            yield pa.RecordBatch.from_arrays(
                [whole_ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, n, np.int64)), deviation, pa.array(((d / n) @ scaled).ravel()),
                 pa.array(np.tile(explained, r)), pa.array(np.full(r * k, error))], names=["vec_id", *[f.split()[0] for f in SCHEMA.split(", ")]])

    return vectors.mapInArrow(project, schema)


def op11_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))

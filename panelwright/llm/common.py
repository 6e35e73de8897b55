"""What the operators of this subpackage share: shared storage, batches of text as bytes, word hashes, id bitmaps and components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.plans.session import cut as cut, shared_path as shared_path, ship

#: Text that JVM and Python hand each other at once. Spark's own bound is a number of rows, which long texts make large.
BATCH_BYTES, DEFAULT_BATCH = 4 << 20, "67108864b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text that is handled at once inside a task.
SLICE_BYTES, SLICE_DOCS = 1 << 20, 4096


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on its workers, and batches for Python bounded by bytes unless the user has set a bound."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(conf) == DEFAULT_BATCH:
        spark.conf.set(conf, str(BATCH_BYTES))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, each made from one of names: helper columns must not clash with those of a user."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(1, len(taken) + 2)) if n.lower() not in taken) for name in names]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def schema_of(df: DataFrame, *, but: tuple[str, ...] = ()) -> list[str]:
    """The columns of df, as a schema string has them."""
    return [f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in but]


# --- text inside tasks -------------------------------------------------------------------------------------------


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in parts that slices() allows, so that what a task holds besides does not grow with a batch. At the end what is free goes
    back to the system, since workers live on."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi in _ranges(sizes.tolist()):
            yield batch.slice(lo, hi - lo)
    release()


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts with at most SLICE_DOCS texts and, but for a single long text, SLICE_BYTES bytes."""
    return _ranges([len(t) for t in texts])


def _ranges(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, n in enumerate(sizes):
        if i > lo and (size + n > SLICE_BYTES or i - lo >= SLICE_DOCS):
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes)


#: How to drop what an operator remembers in a worker from task to task.
CACHES: dict[str, Callable[[], None]] = {}


def claim(owner: str | None) -> None:
    """At the start of a task: drop what other operators have left in this worker, so that a reused worker holds one operator's memory."""
    for name, clear in CACHES.items():
        if name != owner:
            clear()
    release()


def release() -> None:
    """Give memory that is free in this process back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: ASCII white space: space, tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _SYMBOL.copy()
_FOLDED[65:91] = _SYMBOL[97:123]
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """0th to (n-1)th power of an odd base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 256), _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts joined, each followed by a space; start, end and text index of every word [^ \\t-\\r]+."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if not texts:
        none = np.zeros(0, np.int64)
        return data, none, none, none
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    offsets = np.concatenate(([0], np.cumsum(np.array([len(t) + 1 for t in texts]))))
    return data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word; with fold, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    within = np.arange(lens.sum()) - np.repeat(first, lens)
    codes = (_FOLDED if fold else _SYMBOL)[data[np.repeat(starts, lens) + within]]
    return mix(np.add.reduceat(codes * powers(int(lens.max()))[within], first) + lens.astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of n words of a text; a text with 1 to n - 1 words has its whole sequence as its one shingle."""
    mult = mix(np.arange(1, n + 1, dtype=np.uint64))  | np.uint64(1)
    m = len(hashes) - n + 1
    if m > 0:
        whole = np.flatnonzero(doc[: m] == doc[n - 1 :])
        h = np.zeros(len(whole), np.uint64)
        for k in range(n):
            h += hashes[whole + k] * mult[k]
        d = doc[whole]
    else:
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(doc, short)
        s = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            s[has] += hashes[first[has] + k] * mult[k]
        h, d = np.concatenate((h, s + count[short].astype(np.uint64))), np.concatenate((d, short))
    return mix(h), d


# --- sets of ids -------------------------------------------------------------------------------------------------

#: Bits of an id bitmap: at most 2^23 bits in 131,072 words, whatever the input.
ID_BITS = 23


def with_bitmap(docs: DataFrame, ids: DataFrame, maybe: str, key: str = "doc_id") -> DataFrame:
    """docs with a column maybe (a name that docs does not have): false only for rows whose key is surely not in ids (column key). The bitmap
    that is broadcast has a fixed size bound (2^ID_BITS bits); with very many ids it tells less, never wrong."""
    slot, word, bits = fresh(docs, "slot", "word", "bits")
    place = F.pmod(F.xxhash64(F.col(quoted(key))), F.lit(1 << ID_BITS))
    bit = F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")
    words = ids.select(place.alias(slot)).groupBy(F.shiftright(slot, 6).cast("int").alias(word)).agg(F.bit_or(bit).alias(bits))
    return (
        docs.withColumn(slot, place).withColumn(word, F.shiftright(slot, 6).cast("int"))
        .join(F.broadcast(words), word, "left")
        .withColumn(maybe, F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False)))
        .drop(slot, word, bits)
    )


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not in ids, all columns as they were. Only rows that the bitmap leaves in doubt are shuffled with their texts. A
    null doc_id stays."""
    (maybe,) = fresh(docs, "maybe")
    marked = with_bitmap(docs, ids, maybe)
    sure = marked.filter(~F.col(maybe)).drop(maybe)
    left = marked.filter(maybe).drop(maybe).join(ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti")
    return sure.unionByName(left.select(*[quoted(c) for c in sure.columns]))


# --- connected components ----------------------------------------------------------------------------------------


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties the nodes of a partition's edges to the smallest they reach within it; what is held is bounded by flushing."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def flush() -> pa.RecordBatch:
        pairs = [(u, find(u)) for u in list(root)]
        root.clear()
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > CONTRACTED:
            yield flush()
    yield flush()


#: Nodes that a worker ties together at once.
CONTRACTED = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that it reaches.

    Each round first ties together what a partition holds, then takes a large-star and a small-star step: each node's neighbours are tied
    to the smallest of them, first those above the node, then those below, until all edges are those of stars. A step is a partial minimum
    by node and a join; a hot node is split by adaptive execution. Nothing is collected but one number per round. Loops and repeated or null
    edges are dropped."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    while True:
        e = cut(e.mapInArrow(_contract, "u long, v long").distinct(), "edges")
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(tied.union(low).filter("u <> v").distinct(), "edges")
        # in stars, a node that has a smaller one has no other edge
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up > 1 or up > 0 and down > 0").agg(F.count("*")).first()[0] == 0:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

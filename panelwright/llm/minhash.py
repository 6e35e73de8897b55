"""MinHash near-duplicates: HyperMinHash registers, banded; a collision-corrected estimate of the Jaccard similarity, then full sets.

Of the words' shingles each bucket (8 hash bits) keeps its smallest value in compressed form: its leading zeros and the bits that follow. For
the bands, but not for estimates, buckets that stay empty take the register of another one, so that bands of small sets are as selective as
those of large ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, claim, components, cut, fresh, mix, shingle_hashes, slices, table, texts_of, with_bitmap, word_hashes, words_of

BUCKETS, MANTISSA, VALUE_BITS = 256, 10, 44
#: Registers that are unequal sets agree in by chance, with MANTISSA bits kept: the share for large sets.
CHANCE = 0.1699 * 2.0**-MANTISSA
#: Estimates this many standard errors below the threshold are still verified.
SLACK = 4.0
#: Best partners in other components that a document tries before all of them are.
BEST = 4
#: Members of a band's bucket that one task compares with one another at once.
BLOCK, BLOCK_HASHES = 2048, 1 << 21
#: Buckets that an empty one asks in turn for its register, before it takes that of the next used one.
_DONORS = np.random.default_rng(23).integers(0, BUCKETS, (24, BUCKETS))


def band_rows(threshold: float) -> int:
    """Registers a band, so that less than one in 10,000 pairs at the threshold shares no band."""
    return next(r for r in range(16, 0, -1) if (1 - threshold**r) ** (BUCKETS // r) < 1e-4)


def registers(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct n-word shingles and the registers (u16, 0 = empty bucket) of each text; A-Z count as a-z."""
    sizes, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), BUCKETS), np.uint16)
    for lo, hi in slices(texts):
        data, starts, ends, doc = words_of(texts[lo:hi])
        h, d = shingle_hashes(word_hashes(data, starts, ends, fold=True), doc, hi - lo, n)
        # text, bucket and value in one number: sorted, the first of each text and bucket is its smallest value
        key = np.unique((d.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
        of = (key >> np.uint64(52)).astype(np.int64)
        sizes[lo:hi] = np.bincount(of, minlength=hi - lo)
        cell = key >> np.uint64(VALUE_BITS)
        key = key[np.concatenate(([True], cell[1:] != cell[:-1]))] if len(key) else key
        value = (key & np.uint64(2**VALUE_BITS - 1)).astype(np.float64)
        mantissa, exponent = np.frexp(np.maximum(value, 1))
        reg = (VALUE_BITS - exponent + 1) * 2**MANTISSA + np.floor((2 * mantissa - 1) * 2**MANTISSA)
        cell = (key >> np.uint64(VALUE_BITS)).astype(np.int64)
        out[lo + cell // BUCKETS, cell % BUCKETS] = reg
    return sizes, out


def dense(regs: np.ndarray) -> np.ndarray:
    """Registers without empty buckets (but for empty sets). Whom a bucket asks does not depend on the set, so that two sets still agree in
    each register with the probability of their similarity."""
    out = regs.copy()
    row, at = np.nonzero((regs == 0) & regs.any(1)[:, None])
    for donors in _DONORS:
        found = regs[row, donors[at]]
        got = found > 0
        out[row[got], at[got]] = found[got]
        row, at = row[~got], at[~got]
    if len(row):
        some, inverse = np.unique(row, return_inverse=True)
        twice = np.concatenate((regs[some], regs[some]), 1)
        place = np.where(twice > 0, np.arange(2 * BUCKETS), 2 * BUCKETS)
        following = np.minimum.accumulate(place[:, ::-1], 1)[:, ::-1]
        out[row, at] = twice[inverse, following[inverse, at]]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard similarity of registers that stand against each other in the last axis, and its standard error."""
    used = ((a | b) > 0).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    raw = (same / np.maximum(used, 1) - CHANCE) / (1 - CHANCE)
    return raw, np.sqrt(np.maximum(raw * (1 - raw), 0.05) / np.maximum(used, 1))


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of each band of dense registers."""
    bands = BUCKETS // rows
    mult = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
    banded = regs[:, : bands * rows].reshape(-1, bands, rows)
    keys = np.zeros((len(regs), bands), np.uint64)
    for k in range(rows):
        keys += banded[:, :, k].astype(np.uint64) * mult[:, k]
    return mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x51ED27)).view(np.int64)


def _sketch(n: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(None)
        for batch in bounded(batches):
            texts = texts_of(batch.column("text"))
            sizes, regs = registers(texts, n)
            keys = band_keys(dense(regs), rows)
            keys = keys[sizes > 0]
            # the whole word sequence decides which texts are copies
            digest = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(sizes), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((sizes > 0) * keys.shape[1]))).astype(np.int32)), pa.array(keys.ravel()))],
                names=["doc_id", "h", "n_shingles", "digest", "regs", "bands"])

    return run


def _unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            j, se = estimate(_unpack(batch.column("regs_a")), _unpack(batch.column("regs_b")))
            yield batch.filter(pa.array(j + SLACK * se >= threshold)).select(["a", "b", "ha", "hb"])

    return run


def shingle_set(text: bytes, n: int) -> set:
    w = text.lower().split()
    return set(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else {tuple(w)} if w else set()


def _linked(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, set] = (None, set())
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), texts_of(batch.column("text_a")), texts_of(batch.column("text_b")), strict=True):
                if last[0] != a:
                    last = a, shingle_set(ta, n)
                other = shingle_set(tb, n)
                both = len(last[1] & other)
                keep.append(both > 0 and 100 * both >= percent * (len(last[1]) + len(other) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _across(threshold: float, rows: int, percent: int, best: int | None):
    """Of one block of a bucket, pairs of a member outside the bucket's largest component (left) and a member of another component whose
    estimate is near or over the threshold. With best, each left member's best few of them; where those are not all, a row without ids names
    the band. Without, all that the hashes of their full shingle sets link, in the first band that both share."""

    def run(block: pa.Table) -> pa.Table:
        ids, comp, left, size = (block.column(c).to_numpy() for c in ("node", "component", "left", "n_shingles"))
        band = block.column("band")[0].as_py()
        regs = _unpack(block.column("regs").combine_chunks())
        keys = band_keys(dense(regs), rows)
        here = int(np.flatnonzero(keys[0] == band)[0])
        sets = [np.frombuffer(x or b"", np.uint64) for x in block.column("shingles").to_pylist()]
        right = np.flatnonzero(~left)
        out_a, out_b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
        for i in np.flatnonzero(left):
            small, large = np.minimum(size[right], size[i]), np.maximum(size[right], size[i])
            others = right[(comp[right] != comp[i]) & (100 * small >= percent * large)]
            j, se = estimate(regs[i], regs[others])
            near = j + SLACK * se >= threshold
            others, j = others[near], j[near]
            if best is not None:
                more |= len(others) > best
                others = others[np.lexsort((ids[others], -j))[:best]]
            else:
                others = others[(keys[others] == keys[i]).argmax(1) == here]
                if len(others):
                    both = _shared(sets[i], [sets[k] for k in others])
                    others = others[100 * both >= percent * (size[others] + size[i] - both)]
            out_a.append(np.full(len(others), ids[i]))
            out_b.append(ids[others])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        n = len(a)
        low, high = (pa.array(f(a, b).tolist() + [None] * more, pa.int64()) for f in (np.minimum, np.maximum))
        return pa.table({"a": low, "b": high, "band": pa.array([None] * n + [band] * more, pa.int64())})

    return run


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values each of others has in common with one; all are sorted."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def across_components(members: DataFrame, regs: DataFrame, threshold: float, percent: int, best: int | None) -> DataFrame:
    """Pairs (a, b) that share a bucket and lie in different components, and (null, null, band) for bands of which there are more. members:
    node, component, bands (all or some of its bands); regs: doc_id, regs, n_shingles and shingles (hashes of the full set, needed without
    best). A bucket is dealt in blocks of about BLOCK members, or BLOCK_HASHES of their hashes, by as many, so that no task holds a whole
    one; what stands in regs is joined once for all buckets of a node."""
    weight = F.length("shingles") / 8 if best is None else F.lit(0)
    weights = regs.select(F.col("doc_id").alias("node"), F.coalesce(weight, F.lit(0)).alias("weight")).hint("merge")
    placed = members.join(weights, "node").select("node", "component", "weight", F.explode("bands").alias("band"))
    counts = placed.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    heads = counts.groupBy("band").agg(F.max_by(F.struct("component", "n", "weight"), F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.sum("weight").alias("weight")).filter("n > top.n")
    parts = lambda n, weight: F.greatest(F.ceil(n / BLOCK), F.ceil(weight / BLOCK_HASHES))
    heads = heads.select("band", F.col("top.component").alias("major"), parts(F.col("n"), F.col("weight")).alias("blocks"), parts(F.col("n") - F.col("top.n"), F.col("weight") - F.col("top.weight")).alias("lefts"))
    each = placed.join(cut(heads, "buckets").hint("merge"), "band")
    each = each.groupBy("node", "component").agg(F.collect_list(F.struct("band", "major", "blocks", "lefts")).alias("places"))
    each = each.join(regs.select(F.col("doc_id").alias("node"), "regs", "n_shingles", F.col("shingles") if best is None else F.lit(None).cast("binary").alias("shingles")).hint("merge"), "node")
    fixed = ["node", "component", "regs", "n_shingles", "shingles"]
    each = each.select(*fixed, F.explode("places").alias("place")).select(*fixed, "place.*")
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cell = lambda left, i, j: F.struct(F.lit(left).alias("left"), i.alias("i"), j.alias("j"))
    right = F.transform(upto("lefts"), lambda j: cell(False, own("blocks", 1), j))
    left = F.when(F.col("component") != F.col("major"), F.transform(upto("blocks"), lambda i: cell(True, i, own("lefts", 2)))).otherwise(F.array())
    dealt = each.select("band", *fixed, F.explode(F.concat(right, left)).alias("cell")).select("band", *fixed, "cell.*")
    return dealt.groupBy("band", "i", "j").applyInArrow(_across(threshold, band_rows(threshold), percent, best), "a long, b long, band long")


def _shingle_hashes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(None)
        for batch in bounded(batches):
            data, starts, ends, doc = words_of(texts_of(batch.column("text")))
            h, d = shingle_hashes(word_hashes(data, starts, ends, fold=True), doc, batch.num_rows, n)
            order = np.argsort(d, kind="stable")
            bounds = np.searchsorted(d[order], np.arange(batch.num_rows + 1))
            sets = [np.unique(h[order[lo:hi]]).tobytes() for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sets, pa.binary())], names=["doc_id", "h", "shingles"])

    return run


def best_leaders(banded: DataFrame, salts: int) -> DataFrame:
    """(doc_id, leader, n): documents with a smaller one that leads a bucket of theirs, and the number of such buckets. banded: band,
    doc_id. A bucket is dealt by salts: each part has a leader, its smallest member, and the parts' leaders have one in turn, so that a
    bucket that holds most documents is nowhere a single task's."""
    upto = lambda *by: Window.partitionBy(*by).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = banded.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(salts)).cast("int"))
    parts = parts.withColumn("leader", F.first("doc_id").over(upto("band", "salt")))
    wholes = parts.filter("doc_id = leader").select("band", "doc_id").withColumn("leader", F.first("doc_id").over(upto("band")))
    led = parts.select("doc_id", "leader").union(wholes.select("doc_id", "leader")).filter("doc_id <> leader")
    return led.groupBy("doc_id", "leader").agg(F.count("*").alias("n"))


def verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b, ha, hb) whose full shingle sets have 100 * intersection >= percent * union. docs: doc_id, text and h, the hash of the
    text. Only texts of documents in a pair move."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    (maybe,) = fresh(docs, "maybe")
    texts = with_bitmap(docs, ids, maybe).filter(maybe).drop(maybe)
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("h").alias(f"h{c}"), F.col("text").alias(f"text_{c}")).hint("merge")
    full = pairs.join(side("b"), ["b", "hb"]).join(side("a"), ["a", "ha"])
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_linked(n, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs: documents are linked if 100 * intersection >= percent * union of
    their sets of shingle-word shingles (words [^ \\t-\\r]+, A-Z as a-z; with fewer words the whole sequence is the one shingle), and a
    component keeps its smallest doc_id.

    Copies (equal word sequences) are tied to their smallest id first and take no further part. The others meet in bands of registers.
    Round 1 verifies each document against the leader with which it shares most buckets, round 2 each document's best partners (by estimate)
    in other components; round 3, in buckets where those were not all, all pairs across components whose estimate allows it, which hashes of
    the full sets decide before texts do: pairs inside a component cannot change the result. No cap is set on buckets. Null and empty texts have no shingles and link with nothing; a null doc_id keeps itself (component null); rows that repeat a doc_id are one
    document, with the text of the smallest xxhash64; an empty table gives an empty result; other columns are not read."""
    threshold = percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    sketch = cut(docs.mapInArrow(_sketch(shingle, band_rows(threshold)), "doc_id long, h long, n_shingles long, digest binary, regs binary, bands array<long>"), "sketches")
    some = sketch.filter("n_shingles > 0 and doc_id is not null")
    texts = some.groupBy("doc_id").agg(F.min(F.struct("h", "digest")).alias("t")).select("doc_id", "t.h", "t.digest")
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = cut(texts.join(first.hint("merge"), "digest").select("doc_id", "h", "rep"), "classes")
    reps = classes.filter("doc_id = rep").select("doc_id", "h")
    thin = some.select("doc_id", "h", "bands").join(reps.hint("merge"), ["doc_id", "h"], "left_semi").select("doc_id", "bands").dropDuplicates(["doc_id"])
    led = cut(best_leaders(thin.select("doc_id", F.explode("bands").alias("band")), max(1, math.isqrt(classes.count()) // 8)), "leaders")
    # those that share a bucket with another document: their registers, bands and texts are all that moves from here on
    met = cut(led.select("doc_id").union(led.select("leader")).distinct(), "met")
    (maybe,) = fresh(some, "maybe")
    regs = with_bitmap(some, met, maybe).filter(maybe).select("doc_id", "h", "n_shingles", "regs", "bands", F.lit(None).cast("binary").alias("shingles"))
    regs = cut(regs.join(met.hint("merge"), "doc_id", "left_semi").join(reps.hint("merge"), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id"]), "regs")
    of = lambda c: regs.select(F.col("doc_id").alias(c), F.col("h").alias(f"h{c}"), F.col("regs").alias(f"regs_{c}")).hint("merge")
    pairs = led.groupBy("doc_id").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("a")).select("a", F.col("doc_id").alias("b"))
    tried = cut(pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(_likely(threshold), "a long, b long, ha long, hb long"), "pairs")
    comp = cut(components(verify(tried, docs, shingle, percent)), "components")
    members = regs.select(F.col("doc_id").alias("node"), "bands")
    hashes = lambda c: regs.select(F.col("doc_id").alias(c), F.col("h").alias(f"h{c}")).hint("merge")
    for best in (BEST, None):
        state = members.join(comp.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"), "bands")
        found = cut(across_components(state, regs, threshold, percent, best), "across")
        pairs = found.filter("a is not null").select("a", "b").distinct()
        if best is not None:
            pairs = pairs.join(tried.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        more = cut(pairs.join(hashes("b"), "b").join(hashes("a"), "a").select("a", "b", "ha", "hb"), "pairs")
        if not more.isEmpty():
            # what a component holds stands for its links
            stars = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comp = cut(components(stars.union(verify(more, docs, shingle, percent))), "components")
        open_bands = found.filter("band is not null").select("band").distinct()
        if open_bands.isEmpty():
            break
        # who is left, with the hashes of the full sets
        left = members.select("node", F.explode("bands").alias("band")).join(open_bands.hint("merge"), "band", "left_semi")
        members = cut(left.groupBy("node").agg(F.collect_list("band").alias("bands")), "members")
        regs = regs.join(members.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
        (maybe,) = fresh(docs, "maybe")
        whole = with_bitmap(docs, regs.select("doc_id"), maybe).filter(maybe).select("doc_id", "h", "text").mapInArrow(_shingle_hashes(shingle), "doc_id long, h long, shingles binary")
        regs = cut(regs.drop("shingles").join(whole.hint("merge"), ["doc_id", "h"]).dropDuplicates(["doc_id"]), "regs")
    ids = classes.select("doc_id", F.col("rep").alias("node")).join(comp.hint("merge"), "node", "left")
    ids = ids.select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return (
        sketch.select("doc_id", "n_shingles").join(ids.hint("merge"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("doc_id", "n_shingles", "component_id", "kept")
    )


def op6_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))

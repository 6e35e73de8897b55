"""Substring dedup by content-defined chunks.

A gear rolling hash over the last SPAN bytes decides at every word start whether a chunk ends there, so that cuts depend on nearby text only
and an insertion moves no other cut. As chunks of a few words repeat by chance, what is deduplicated by digest is, from each chunk on, as
many chunks as hold WINDOW_WORDS words or RUN_BYTES bytes: a variable chunk of its own whose ends are content-defined. In long stretches
without white space the hash decides at every character. What a text has left from its last run on, all of a short text, is compared too. The
document that has it first (smallest doc_id) stays whole. From later ones every chunk is cut out where such runs, one after another, cover
LEAST_WORDS words or LEAST_BYTES bytes or the whole text: a single sentence that texts share, such as a license line, is left alone, and so is
what repeats inside one document only, as a refrain does."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _SPACE, bounded, claim, cut, fresh, quoted, schema_of, slices, table, texts_of, with_bitmap

#: One word start in CUT_ONE_IN ends a chunk; LONG_BYTES after the start of a word, one character in LONG_ONE_IN as well.
CUT_ONE_IN, LONG_BYTES, LONG_ONE_IN = 2, 48, 8
#: Bytes that the rolling hash looks back on, a power of two: so much of a passage's start takes its cuts from what stands before it.
SPAN = 8
#: Least words of the runs of chunks that are compared. Runs of longer words, as in text without spaces, end at RUN_BYTES.
WINDOW_WORDS, RUN_BYTES = 15, 256
#: Least words or bytes of what is cut out. Of a passage that repeats amid other text, the chunks inside it cover as much in 95 cases of 100 or more
#: from PASSAGE_WORDS words on (unspaced: from PASSAGE_BYTES on); of 38 words and more, in all of some thousand tried.
LEAST_WORDS, LEAST_BYTES = 25, 400
PASSAGE_WORDS, PASSAGE_BYTES = 34, 600
#: Repeated runs that a task remembers, at most; beyond it, it starts anew.
COMMON = 100_000
_GEAR = np.random.default_rng(19).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray, first: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The gear hash h = (h << 1) + G[byte] after each byte, over the last span bytes (a power of two) of the same text, by doubling. Texts begin
    at first."""
    h, step = _GEAR[data], 1
    while step < min(span, len(h)):
        earlier = np.zeros_like(h)
        earlier[step:] = h[:-step] << np.uint32(step)
        at_start = (first[:, None] + np.arange(step)).ravel()
        earlier[at_start[at_start < len(h)]] = 0
        h, step = h + earlier, 2 * step
    return h


def cuts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of all chunks of texts that begin at first (ascending; empty texts have no start). Chunks never cross texts, nor cut a
    character."""
    space = _SPACE[data]
    start = np.zeros(len(data), bool)
    word = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if len(word):
        # the hash of what stands before the word
        h = gear(data, first)
        start[word[(h[word - 1] ^ (h[word - 1] >> np.uint32(15))) % np.uint32(CUT_ONE_IN) == 0]] = True
    where = np.arange(len(data), dtype=np.int32)
    opened = np.where(space, where + 1, 0).astype(np.int32)
    opened[first] = np.maximum(opened[first], first)
    far = np.flatnonzero((where - np.maximum.accumulate(opened) >= LONG_BYTES) & (data & 0xC0 != 0x80))
    if len(far):
        h = gear(data, first)[far - 1]
        start[far[(h ^ (h >> np.uint32(15))) % np.uint32(LONG_ONE_IN) == 0]] = True
    start[first] = True
    return np.flatnonzero(start)


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text index, start and end within the text and words of every chunk of every text, in order; the number of chunks from each on that
    hold WINDOW_WORDS words or RUN_BYTES (0 if the text ends before); the number of chunks to the end of the text from its last such run
    on, or of all if it has none (0 for other chunks, where the run itself reaches the end, and in texts without words)."""
    out = []
    for lo, hi in slices(texts):
        some = texts[lo:hi]
        joined = b"".join(some)
        if not joined:
            continue
        data = np.frombuffer(joined, np.uint8)
        lens = np.array([len(t) for t in some])
        offsets = np.concatenate(([0], np.cumsum(lens)))
        at = cuts(data, offsets[:-1][lens > 0])
        doc = np.searchsorted(offsets, at, side="right") - 1
        end = np.append(at[1:], len(data))
        space = _SPACE[data]
        head = ~space
        head[1:] &= space[:-1]
        head[offsets[:-1][lens > 0]] = ~space[offsets[:-1][lens > 0]]
        words = np.concatenate(([0], np.cumsum(head)))
        last = np.minimum(np.searchsorted(words[end], words[at] + WINDOW_WORDS), np.searchsorted(end, at + RUN_BYTES))
        inside = last < len(at)
        inside[inside] = doc[last[inside]] == doc[inside]
        span = np.where(inside, last - np.arange(len(at)) + 1, 0)
        head_of = np.searchsorted(doc, np.unique(doc))
        stop = np.append(head_of[1:], len(doc))
        tail = np.maximum(np.maximum.reduceat(np.where(span > 0, np.arange(len(at)), 0), head_of), head_of)
        rest = np.zeros_like(span)
        rest[tail] = np.where(words[end[stop - 1]] > words[at[head_of]], stop - tail, 0)
        rest[rest == span] = 0
        out.append((doc + lo, at - offsets[doc], end - offsets[doc], words[end] - words[at], span, rest))
    if not out:
        return tuple([np.zeros(0, np.int64)] * 6)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, doc_id, nr, known) of every run of chunks that is compared; nr is twice the number of its first chunk, and one more if it
    goes on to the end of the text. Runs that an earlier document has, in the same part of a batch or, for those that come up again and
    again, among what the task has seen, are repeats already (known), whatever other tasks hold, and get a digest of their own place: a
    common passage does not gather in one task."""
    claim(None)
    common: dict[int, int] = {}  # digest to the first document that the task has seen it in
    for batch in bounded(batches):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        texts = texts_of(batch.column("text"))
        texts = [texts[i] for i in order]
        doc, at, end, _, span, rest = chunks_of(texts)
        nr = 2 * (np.arange(len(doc)) - np.searchsorted(doc, doc))
        both = np.stack((span, rest), 1).ravel()
        runs = np.flatnonzero(both)
        first = runs // 2
        doc, nr, at, end = doc[first], nr[first] + runs % 2, at[first], end[first + both[runs] - 1]
        # white space at the end is not part of what is compared
        digest = np.array([xxhash.xxh3_64_intdigest(texts[d][a:b].rstrip()) for d, a, b in zip(doc.tolist(), at.tolist(), end.tolist(), strict=True)], np.uint64)
        doc_id = ids[order][doc]
        distinct, where, of, times = np.unique(digest, return_index=True, return_inverse=True, return_counts=True)
        home = doc_id[where]
        if len(common) > COMMON:
            common = {}
        again = np.isin(distinct, np.fromiter(common, np.uint64, len(common)))
        for k in np.flatnonzero(again | (times > 1)).tolist():
            home[k] = common[int(distinct[k])] = min(common.get(int(distinct[k]), home[k]), int(home[k]))
        known = doc_id > home[of]
        digest = digest.view(np.int64).copy()
        digest[known] = doc_id[known] * np.int64(0x9E3779B1) + nr[known]
        yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(doc_id, pa.int64()), pa.array(nr.astype(np.int32)), pa.array(known)], names=["digest", "doc_id", "nr", "known"])


def _long_enough(gone: np.ndarray, words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """gone (by chunk of one text) without the stretches that are too short to be cut out."""
    if gone.all():
        return gone
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    n_words, n_bytes = (np.concatenate(([0], np.cumsum(x))) for x in (words, size))
    out = gone.copy()
    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        out[a:b] = n_words[b] - n_words[a] >= LEAST_WORDS or n_bytes[b] - n_bytes[a] >= LEAST_BYTES
    return out


def _remove(nrs_name: str):
    """Cut out the chunks of each text that lie in a repeated run (column nrs: where such runs start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts = texts_of(batch.column("text"))
            doc, at, end, words, span, rest = chunks_of(texts)
            both = np.stack((span, rest), 1)
            first = np.searchsorted(doc, np.arange(len(texts) + 1))
            new, gone_words, gone_chars = [], [], []
            for i, nrs in enumerate(batch.column(nrs_name).to_pylist()):
                own = slice(first[i], first[i + 1])
                n = first[i + 1] - first[i]
                nr = np.array([k for k in nrs or () if k < 2 * n], np.int64)
                starts = nr // 2
                edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + both[own][starts, nr % 2], minlength=n + 1)
                gone = _long_enough(np.cumsum(edge)[:-1] > 0, words[own], end[own] - at[own])
                t = texts[i]
                left = b"".join(t[a:b] for a, b, g in zip(at[own].tolist(), end[own].tolist(), gone.tolist(), strict=True) if not g) if gone.any() else t
                new.append(left)
                gone_words.append(int(words[own][gone].sum()))
                gone_chars.append(len(t.decode()) - len(left.decode()) if gone.any() else 0)
            null = batch.column("text").is_null()
            text = pa.array([None if n else x for n, x in zip(null.to_pylist(), new, strict=True)], pa.binary()).cast(pa.string())
            columns = {c: text if c == "text" else batch.column(c) for c in batch.schema.names if c != nrs_name}
            yield pa.RecordBatch.from_pydict(columns | {"removed_words": pa.array(gone_words, pa.int64()), "removed_chars": pa.array(gone_chars, pa.int64())})

    return run


def substring_dedup(docs: DataFrame) -> DataFrame:
    """docs with text cut and two more columns, removed_words and removed_chars.

    Of passages of PASSAGE_WORDS words or more (PASSAGE_BYTES, where there are no spaces) that repeat across documents, those of the document with the
    smallest doc_id stay; shorter ones are found less and less often, those under LEAST_WORDS words and LEAST_BYTES bytes never. Only documents with a run that an earlier
    one has are touched or moved; the others pass through as they are. Text that is left is as it was, white space included. Null texts stay
    null, empty ones empty; a text that repeats another whole one goes, however short; one character that goes on and on is a single chunk;
    rows with a null doc_id stay as they are; rows that repeat a doc_id are one document; an empty table gives an empty result; further columns are kept whatever their names, but those named removed_words and
    removed_chars are replaced."""
    docs = docs.drop("removed_words", "removed_chars")
    key = F.col("doc_id").cast("long")
    runs = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(key.alias("doc_id"), "text").mapInArrow(_window_rows, "digest long, doc_id long, nr int, known boolean")
    later = F.col("doc_id") > F.first("doc_id").over(Window.partitionBy("digest").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    repeats = runs.withColumn("later", later).filter("later or known").select("doc_id", "nr")
    own, nrs, maybe = fresh(docs, "own", "nrs", "maybe")
    by_doc = cut(repeats.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("nr").alias(nrs)), "repeats")
    marked = with_bitmap(docs.withColumn(own, key), by_doc, maybe, own)
    none = F.lit(0).cast("long")
    names = [quoted(c) for c in docs.columns]
    sure = marked.filter(~F.col(maybe) | F.col(own).isNull()).withColumn("removed_words", none).withColumn("removed_chars", none).select(*names, "removed_words", "removed_chars")
    joined = marked.filter(F.col(maybe) & F.col(own).isNotNull()).join(by_doc.hint("merge"), own, "left").select(*names, nrs)
    schema = ", ".join([*schema_of(docs), "removed_words long, removed_chars long"])
    return sure.union(joined.mapInArrow(_remove(nrs), schema))


def op5_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars_left"), "removed_words", "removed_chars", (F.col("removed_words") > 0).alias("changed"), "text")

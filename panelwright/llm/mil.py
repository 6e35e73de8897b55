"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded (frequencies of pairs of byte classes and of hashed words, a few statistics, one
learned layer); gated attention, learned from labels of documents only, weighs the passages, and the weighted representation is scored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SLICE_BYTES, bounded, claim, table, texts_of, word_hashes, words_of
from .lm import crc

#: Bytes of a passage, about, and how far its end may move to the next space.
PASSAGE, REACH = 512, 64
#: Buckets of hashed words; units of an encoded passage and of the attention.
WORDS, UNITS, GATE = 256, 32, 16
#: The sample on which the model is fitted: documents with a label, at most, and passages of one of them, spread evenly over the text.
SAMPLE, SAMPLE_PASSAGES = 4000, 32
#: Epochs, documents of a step, learning rate, decay of the weights.
EPOCHS, STEP, RATE, DECAY = 30, 64, 3e-3, 1e-3
SEED = 23

#: Classes of bytes: white space, letters, digits, groups of signs, parts of characters beyond ASCII.
_GROUPS = [b" ", b"\t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",;:", b"!?", b"\"'`", b"()[]{}", b"#$%&*@", b"|<>/\\^~", b"-_+=", bytes(range(192, 256)), bytes(range(128, 192))]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _k, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _k
CLASSES = len(_GROUPS) + 1
STATISTICS = 3
WIDTH = CLASSES * CLASSES + WORDS + STATISTICS


def passages(text: bytes) -> list[tuple[int, int]]:
    """Start and end of each passage of a text: equal parts of about PASSAGE bytes, cut at a space if one is near; an empty text is one."""
    n = max(1, round(len(text) / PASSAGE))
    cuts = [0]
    for k in range(1, n):
        at = k * len(text) // n
        space = text.find(b" ", at, at + REACH)
        cuts.append(space + 1 if space >= 0 else at)
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True))


def features(parts: list[bytes]) -> np.ndarray:
    """A row of WIDTH values from 0 to 255 for each passage: square roots of shares, so that rare things show."""
    n = len(parts)
    lens = np.array([len(p) for p in parts])
    data, starts, ends, owner = words_of(parts)
    of = np.repeat(np.arange(n), lens + 1)  # each part is followed by a space
    kinds = _CLASS[data]
    cells = of[:-1] * (CLASSES * CLASSES) + kinds[:-1] * CLASSES + kinds[1:]
    pairs = np.bincount(cells[of[:-1] == of[1:]], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    hashes = word_hashes(data, starts, ends, fold=True)
    count = np.bincount(owner, minlength=n)
    words = np.bincount(owner * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, -1)
    order = np.lexsort((hashes, owner))
    again = (np.diff(hashes[order]) == 0) & (np.diff(owner[order]) == 0) if len(order) else np.zeros(0, bool)
    repeated = np.bincount(owner[order][1:][again], minlength=n) if len(again) else np.zeros(n)
    some, size = np.maximum(count, 1), np.maximum(lens, 1)
    letters = np.bincount(owner, ends - starts, minlength=n)
    out = np.empty((n, WIDTH))
    out[:, : CLASSES * CLASSES] = np.sqrt(pairs / size[:, None])
    out[:, CLASSES * CLASSES : -STATISTICS] = np.sqrt(words / some[:, None])
    out[:, -3], out[:, -2], out[:, -1] = repeated / some, np.minimum(letters / some / 32, 1), np.minimum(lens / (2 * PASSAGE), 1)
    return np.round(255 * out).astype(np.uint8)


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the score, with the shift and scale of the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) * self.scale) @ self.weights["w"] + self.weights["b"])

    def attention(self, h: np.ndarray) -> np.ndarray:
        """The gated attention of each passage, before it is scaled to a total of one within a document."""
        w = self.weights
        return (np.tanh(h @ w["v"] + w["vb"]) * _sigmoid(h @ w["u"] + w["ub"])) @ w["a"]

    def score(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(z @ self.weights["c"] + self.weights["c0"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def start(prior: float = 0.5) -> Model:
    """A model that scores every document by the prior."""
    rng = np.random.default_rng(SEED)
    small = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    w = {"w": small(WIDTH, UNITS), "b": np.zeros(UNITS), "v": small(UNITS, GATE), "vb": np.zeros(GATE), "u": small(UNITS, GATE), "ub": np.zeros(GATE), "a": small(GATE) * 0.1, "c": np.zeros(UNITS), "c0": np.log(prior / (1 - prior))}
    return Model(np.zeros(WIDTH), np.ones(WIDTH), w)


def loss_and_gradients(m: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of the documents whose passages are the rows of x (scaled) from first on, and its gradient."""
    w = m.weights
    doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    h = np.tanh(x @ w["w"] + w["b"])
    t, g = np.tanh(h @ w["v"] + w["vb"]), _sigmoid(h @ w["u"] + w["ub"])
    e = (t * g) @ w["a"]
    share = np.exp(e - np.maximum.reduceat(e, first)[doc])
    share /= np.add.reduceat(share, first)[doc]
    z = np.add.reduceat(share[:, None] * h, first)
    p = _sigmoid(z @ w["c"] + w["c0"])
    loss = -np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
    dl = (p - y) / len(y)
    dz = (dl[:, None] * w["c"])[doc]
    # through the softmax: each passage's share of the change of the mean
    gain = (dz * h).sum(1)
    de = share * (gain - np.add.reduceat(share * gain, first)[doc])
    dtg = de[:, None] * w["a"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = share[:, None] * dz + dt @ w["v"].T + dg @ w["u"].T
    dx = dh * (1 - h * h)
    return float(loss), {
        "w": x.T @ dx, "b": dx.sum(0), "v": h.T @ dt, "vb": dt.sum(0), "u": h.T @ dg, "ub": dg.sum(0), "a": (t * g).T @ de, "c": z.T @ dl, "c0": dl.sum()}


def fit(bags: list[np.ndarray], y: np.ndarray) -> Model:
    """Adam over the bags in a seeded order. Without bags every document scores 0.5; with one label only, near that label."""
    if not bags:
        return start()
    m = start(float(np.clip(y.mean(), 0.01, 0.99)))
    rng = np.random.default_rng(SEED)
    n = sum(map(len, bags))
    m.mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
    m.scale = 1 / np.maximum(np.sqrt(np.maximum(sum((b.astype(np.float64) ** 2).sum(0) for b in bags) / n - m.mean**2, 0)), 4.0)
    moment = {k: np.zeros_like(v, dtype=float) for k, v in m.weights.items()}
    square = {k: np.zeros_like(v, dtype=float) for k, v in m.weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), STEP):
            some = order[lo : lo + STEP]
            x = (np.concatenate([bags[i] for i in some]) - m.mean) * m.scale
            first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in some])[:-1]))
            _, grad = loss_and_gradients(m, x, first, y[some])
            step += 1
            for k, d in grad.items():
                d = d + DECAY * m.weights[k] if k in ("w", "v", "u", "c") else d
                moment[k] = 0.9 * moment[k] + 0.1 * d
                square[k] = 0.99 * square[k] + 0.01 * d * d
                m.weights[k] = m.weights[k] - RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return m


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim(None)
    for batch in bounded(batches):
        rows = []
        for text in texts_of(batch.column("text")):
            parts = passages(text)
            if len(parts) > SAMPLE_PASSAGES:
                parts = [parts[k * len(parts) // SAMPLE_PASSAGES] for k in range(SAMPLE_PASSAGES)]
            rows.append(features([text[lo:hi] for lo, hi in parts]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("y"), pa.array(rows, pa.binary())], names=["doc_id", "y", "bag"])


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model fitted on the labelled documents that are not held out: the SAMPLE of them whose ids have the least hashes, which bounds
    what the driver holds (66 MB)."""
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("quality")))
    known = labels.filter("doc_id is not null and quality is not null").filter(crc(F.col("doc_id")) % 3 != 1).groupBy("doc_id").agg(y.alias("y"))
    known = known.join(docs.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE)
    # of rows with one id, one text
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    bags = texts.mapInArrow(_sampled, "doc_id string, y double, bag binary").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(b, np.uint8).reshape(-1, WIDTH) for b in bags.column("bag").to_pylist()], bags.column("y").to_numpy())


FIELDS = "score double, n_passages long, top_passage long, top_start long, top_attention double"


def _scores(m: Model, kind: pa.DataType):
    names = ["doc_id", *[f.split()[0] for f in FIELDS.split(", ")]]
    # the attention of any passage is at most this, so that sums of its exponentials neither overflow nor vanish
    most = float(np.abs(m.weights["a"]).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(None)
        for batch in bounded(batches):
            texts = texts_of(batch.column("text"))
            n = len(texts)
            total, mean, top, at, start_at, count = np.zeros(n), np.zeros((n, UNITS)), np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            parts, owners, places = [], [], []

            def flush() -> None:
                if not parts:
                    return
                doc = np.array(owners)
                h = m.encode(features(parts))
                e = m.attention(h)
                share = np.exp(e - most)
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                own = doc[first]
                total[own] += np.add.reduceat(share, first)
                mean[own] += np.add.reduceat(share[:, None] * h, first)
                for lo, hi, i in zip(first, [*first[1:], len(doc)], own, strict=True):
                    k = lo + int(e[lo:hi].argmax())
                    if e[k] > top[i]:
                        top[i], at[i], start_at[i] = e[k], count[i] + k - lo, places[k]
                    count[i] += hi - lo
                parts.clear(), owners.clear(), places.clear()

            held = 0
            for i, text in enumerate(texts):
                for lo, hi in passages(text):
                    parts.append(text[lo:hi])
                    owners.append(i)
                    places.append(lo)
                    held += hi - lo
                    if held >= SLICE_BYTES or len(parts) >= 2048:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(kind), pa.array(m.score(mean / np.maximum(total, 1e-300)[:, None])), pa.array(count), pa.array(at), pa.array(start_at), pa.array(np.exp(top - most) / np.maximum(total, 1e-300))], names=names)

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, top_passage, top_start and top_attention of every row of docs (doc_id, text); labels
    (doc_id, quality) are read of documents only whose crc32 of the id as text is not 1 modulo 3. A score depends on the text alone.

    top_passage (from 0), top_start (its first byte) and top_attention tell which passage weighs most. A null text is an empty one, which
    has one passage; every passage of a long text is weighed. Several labels of a document count as their mean, null labels as none,
    labels outside 0 to 1 as the nearer of these; rows with one id are scored each, and learned from once. Without labels all scores
    are 0.5. A null doc_id is not held out and has no label. An empty table gives an empty result; other columns are not read."""
    found = docs.select("doc_id", "text").mapInArrow(_scores(learned(docs, labels), to_arrow_type(docs.schema["doc_id"].dataType)), f"doc_id {dict(docs.dtypes)['doc_id']}, {FIELDS}")
    own = ["n_passages", "top_passage", "top_start", "top_attention"]
    return found.select("doc_id", (crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *own)


def op13_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

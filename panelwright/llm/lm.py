"""LM scoring: a gated recurrent language model in numpy with class-factored output, trained by truncated backpropagation.

Words are parted into classes. The most frequent ones stand in small classes, whose softmax depends on the state as that of the classes
does; the other words of the head vocabulary stand in classes by language and frequency with fixed shares; all remaining words, known or
not, are the tail class, whose shares come from exact counts of the whole training corpus. p(word) = p(class | state) p(word | class, state)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded, claim, cut, table

#: Words with counts that each worker holds, at most; words in small classes, and their number in one; units of the state.
HEAD, SMALL, SLOTS, HIDDEN = 200_000, 512, 16, 16
#: Languages with classes of their own (the most frequent in training), and frequency classes of each.
LANGS, BANDS = 6, 4
#: Streams that are trained together, steps that gradients reach back, learning rate; rounds of training and averaging, each over another
#: hash part of the training documents, so that every one of them is trained on once.
STREAMS, STEPS, RATE, ROUNDS = 512, 16, 0.01, 2
#: Windows that a partition's streams have at least; fewer tokens go in fewer streams.
LEAST_WINDOWS = 64
#: Counts that a worker gathers before it sends them on; documents and tokens that are scored together; rows of one softmax, which a cache holds.
FLUSH, SCORED_DOCS, SCORED_TOKENS, ROWS = 500_000, 8192, 8_000_000, 8192
WINDOW = 64
#: The end of a document; no word holds white space.
END = b"\n"


def crc(column: Column) -> Column:
    """crc32 of an id as text; of the empty text for null."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in turn, A-Z lower-cased, and where each text's begin in them (one bound more than texts). A null text is empty."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    words, offsets = split.flatten(), split.offsets.to_numpy()
    real = pc.not_equal(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty string there
    bounds = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return words.filter(real), bounds[offsets - offsets[0]]


# --- counts ------------------------------------------------------------------------------------------------------


def _count(langs: list[str]):
    slot = {lang: k for k, lang in enumerate(langs)}
    n = len(langs) + 1
    fields = ["word", *[f"c{k}" for k in range(n)]]

    def merged(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        """Distinct words and their counts by language."""
        words = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
        which, counts = words.indices.to_numpy(), np.concatenate([c for _, c in parts])
        return words.dictionary, np.stack([np.bincount(which, c, len(words.dictionary)) for c in counts.T], 1).astype(np.int64)

    def rows(words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words, *[pa.array(np.ascontiguousarray(c)) for c in counts.T]], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        parts, held, ends = [], 0, np.zeros((1, n), np.int64)
        for batch in bounded(batches):
            words, bounds = words_of(batch.column("text"))
            own = np.array([slot.get(lang, n - 1) for lang in batch.column("lang").to_pylist()], np.int64)
            ends[0] += np.bincount(own, minlength=n)
            coded = words.dictionary_encode()
            key = coded.indices.to_numpy() * np.int64(n) + np.repeat(own, np.diff(bounds))
            parts.append((coded.dictionary, np.bincount(key, minlength=n * len(coded.dictionary)).reshape(-1, n)))
            held += len(coded.dictionary)
            if held > 2 * FLUSH:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > FLUSH:
                    yield rows(*parts[0])
                    parts, held = [], 0
        if parts:
            yield rows(*merged(parts))
        yield rows(pa.array([END.decode()]), ends)

    return run


def word_counts(training: DataFrame) -> tuple[DataFrame, int]:
    """(word, c, lang) over all of training (text, lang), and the number of languages told apart; lang is the one in which a word is most
    frequent, as a number. Each worker sends its counts, not its words."""
    langs = [r["lang"] for r in training.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()]
    columns = [f"c{k}" for k in range(len(langs) + 1)]
    parts = training.select("text", "lang").mapInArrow(_count(langs), "word string, " + ", ".join(f"{c} long" for c in columns))
    sums = parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])
    most = F.greatest(*columns, F.lit(0))
    lang = F.coalesce(*[F.when(F.col(c) == most, F.lit(k)) for k, c in enumerate(columns)])
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return cut(sums.select("word", total.alias("c"), lang.alias("lang")), "counts"), len(columns)


class Vocabulary:
    """Head words with their input, class, slot and share in the class; one more number stands for all tail words."""

    def __init__(self, words: list[bytes], counts: np.ndarray, lang: np.ndarray, n_langs: int, tail: float):
        order = np.lexsort((words, -counts))
        self.words, counts, lang = [words[i] for i in order], counts[order].astype(float), lang[order]
        n = len(order)
        small = np.arange(n) < SMALL
        # neighbours in a small class: words of one language, by frequency
        first = np.flatnonzero(small)
        first = first[np.lexsort((first, lang[first]))]
        self.cls, self.slot = np.zeros(n + 1, np.int64), np.full(n + 1, -1)
        self.cls[first], self.slot[first] = np.arange(len(first)) // SLOTS, np.arange(len(first)) % SLOTS
        self.n_small = -(-len(first) // SLOTS)
        rest = np.flatnonzero(~small)
        # equal shares of the logarithm of frequency
        bands = np.minimum(BANDS - 1, (np.arange(len(rest)) / max(1, len(rest))) ** 0.5 * BANDS).astype(np.int64)
        self.cls[rest] = self.n_small + lang[rest] * BANDS + bands
        self.n_classes = self.n_small + n_langs * BANDS + 1
        self.cls[n] = self.n_classes - 1
        mass = np.bincount(self.cls, np.append(counts, tail), minlength=self.n_classes)
        self.log_share = np.zeros(n + 1)
        self.log_share[rest] = np.log(counts[rest] / mass[self.cls[rest]])
        self.input = np.append(np.where(small, np.arange(n), 0), 0)
        self.input[rest] = min(n, SMALL) + self.cls[rest]
        self.input[n] = min(n, SMALL) + self.cls[n]
        self.n_inputs = min(n, SMALL) + self.n_classes
        # the model starts as one of frequencies alone
        self.class_bias = np.log(np.maximum(mass, 0.5) / np.maximum(mass, 0.5).sum())
        self.slot_bias = np.full((self.n_small, SLOTS), -30.0)
        self.slot_bias[self.cls[first], self.slot[first]] = np.log(counts[first] / mass[self.cls[first]])
        self.counts = counts

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


# --- the model ---------------------------------------------------------------------------------------------------


def initial(v: Vocabulary) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(3)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {"E": small(v.n_inputs, 3 * HIDDEN), "U": small(HIDDEN, 3 * HIDDEN), "W": small(HIDDEN, v.n_classes), "b": v.class_bias.astype(np.float32),
            "Ws": small(v.n_small, SLOTS, HIDDEN), "bs": v.slot_bias.astype(np.float32)}


def gates(p: dict) -> tuple[np.ndarray, ...]:
    """E and U of the gates z and r, then of the candidate c, laid out and scaled so that each is a function of exp of a sum of both."""
    e, u = (w.reshape(len(w), 3, HIDDEN).transpose(1, 0, 2) for w in (p["E"], p["U"]))
    return -e[:2], -u[:2], -2 * e[2], -2 * u[2]


def advance(w: tuple[np.ndarray, ...], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """New state after the inputs x, and what its derivative needs."""
    e_zr, u_zr, e_c, u_c = w
    zr = e_zr.take(x, axis=1)
    zr += np.matmul(h, u_zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr
    c = e_c.take(x, axis=0)
    c += (r * h) @ u_c
    np.exp(c, out=c)
    c += 1
    np.divide(2, c, out=c)
    c -= 1
    new = c - h
    new *= z
    new += h
    return new, z, r, c


def step(p: dict, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    with np.errstate(over="ignore"):
        return advance(gates(p), x, h)


def _log_share(logits: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log of the softmax of each column at its place which. logits are overwritten."""
    top = logits.max(0)
    picked = logits[which, np.arange(len(which))] - top
    logits -= top
    np.exp(logits, out=logits)
    return picked - np.log(np.ones(len(logits), logits.dtype) @ logits)


def _slots(p: dict, c: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Logits of all slots of each state's small class c, a column each, and the columns of each class; c ascends."""
    bounds = np.searchsorted(c, np.arange(len(p["Ws"]) + 1)).tolist()
    out = p["bs"].T.take(c, axis=1)
    ranges = list(zip(bounds[:-1], bounds[1:], strict=True))
    for s, (lo, hi) in enumerate(ranges):
        if hi > lo:
            out[:, lo:hi] += p["Ws"][s] @ h[lo:hi].T
    return out, ranges


def log_probability(p: dict, v: Vocabulary, h: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Natural log of each token's class, and of its slot or share in it; a tail word's share is not in it."""
    out = np.empty(len(tokens))
    for lo in range(0, len(tokens), ROWS):
        t, hh = tokens[lo : lo + ROWS], h[lo : lo + ROWS]
        cls, slot = v.cls[t], v.slot[t]
        logits = p["W"].T @ hh.T
        logits += p["b"][:, None]
        some = _log_share(logits, cls) + v.log_share[t]
        k = np.flatnonzero(slot >= 0)
        if len(k):
            k = k[np.argsort(cls[k].astype(np.int32), kind="stable")]
            some[k] += _log_share(_slots(p, cls[k], hh[k])[0], slot[k])
        out[lo : lo + ROWS] = some
    return out


def _probabilities(logits: np.ndarray) -> np.ndarray:
    """Softmax of each column, in place."""
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= np.ones(len(logits), logits.dtype) @ logits
    return logits


def gradients(p: dict, v: Vocabulary, x: np.ndarray, fresh: np.ndarray, target: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Mean gradients over one window (steps by streams) that starts in state h, its last state, and the mean loss of the classes."""
    steps, b = x.shape
    n = steps * b
    before, z, r, c, hs = (np.empty((steps, b, HIDDEN), h.dtype) for _ in range(5))
    inputs, go_on, w = v.input[x], (~fresh)[:, :, None].astype(h.dtype), gates(p)
    with np.errstate(over="ignore"):
        for t in range(steps):
            np.multiply(h, go_on[t], out=before[t])
            h, z[t], r[t], c[t] = advance(w, inputs[t], before[t])
            hs[t] = h
    hs, y = hs.reshape(n, HIDDEN), target.ravel()
    cls, slot = v.cls[y], v.slot[y]
    probs = p["W"].T @ hs.T
    probs += p["b"][:, None]
    _probabilities(probs)
    loss = -float(np.log(probs[cls, np.arange(n)] + 1e-30).mean())
    probs[cls, np.arange(n)] -= 1
    g = {"W": (probs @ hs).T / n, "b": probs.sum(1) / n, "E": np.zeros_like(p["E"]), "U": np.empty_like(p["U"]), "Ws": np.zeros_like(p["Ws"]), "bs": np.zeros_like(p["bs"])}
    dhs = probs.T @ p["W"].T
    k = np.flatnonzero(slot >= 0)
    if len(k):
        # in order of their classes, so that those of one class stand together
        k = k[np.argsort(cls[k].astype(np.int32), kind="stable")]
        own, back = hs[k], np.empty((len(k), HIDDEN), hs.dtype)
        q, ranges = _slots(p, cls[k], own)
        _probabilities(q)
        q[slot[k], np.arange(len(k))] -= 1
        for s, (lo, hi) in enumerate(ranges):
            if hi > lo:
                g["Ws"][s], g["bs"][s] = q[:, lo:hi] @ own[lo:hi] / n, q[:, lo:hi].sum(1) / n
                np.matmul(q[:, lo:hi].T, p["Ws"][s], out=back[lo:hi])
        dhs[k] += back
    dhs = dhs.reshape(steps, b, HIDDEN)
    dhs /= n
    # what a step's derivatives are multiplied by, of all steps at once
    by_z, by_r, by_c, stay = (c - before) * z * (1 - z), before * r * (1 - r), z * (1 - c * c), 1 - z
    down = np.zeros((b, HIDDEN), h.dtype)
    u_z, u_r, u_c = (p["U"][:, i * HIDDEN : (i + 1) * HIDDEN].T.copy() for i in range(3))
    da = np.empty((3, steps, b, HIDDEN), dhs.dtype)
    for t in range(steps - 1, -1, -1):
        dh = dhs[t]
        dh += down
        da_z, da_r, da_c = da[:, t]
        np.multiply(dh, by_c[t], out=da_c)
        d_rh = da_c @ u_c
        np.multiply(dh, by_z[t], out=da_z)
        np.multiply(d_rh, by_r[t], out=da_r)
        np.multiply(dh, stay[t], out=down)
        d_rh *= r[t]
        down += d_rh
        down += da_z @ u_z
        down += da_r @ u_r
        down *= go_on[t]
    da, before, rh = da.reshape(3, n, HIDDEN), before.reshape(n, HIDDEN), (r * before).reshape(n, HIDDEN)
    for i, of in enumerate((before, before, rh)):
        g["U"][:, i * HIDDEN : (i + 1) * HIDDEN] = of.T @ da[i]
    inputs = inputs.ravel()
    order = np.argsort(inputs.astype(np.int16), kind="stable")  # two bytes are sorted by counting
    inputs = inputs[order]
    first = np.flatnonzero(np.diff(inputs, prepend=-1))
    g["E"][inputs[first]] = np.add.reduceat(np.concatenate(da, axis=1).take(order, axis=0), first)
    return g, h, loss


def train(p: dict, v: Vocabulary, tokens: np.ndarray) -> dict:
    """Adam over the tokens of whole documents (each ends with END), dealt into parallel streams; the state carries on from window to
    window and starts anew at each document. What the streams leave over, less than a token each, is a last window of single steps."""
    end = v.words.index(END)
    p = {k: x.copy() for k, x in p.items()}
    streams = max(1, min(STREAMS, len(tokens) // (STEPS * LEAST_WINDOWS)))
    whole = len(tokens) // streams * streams
    # the input of a document's first word is the end before it, in a fresh state
    before = np.append(end, tokens[:-1]).astype(tokens.dtype)
    x, y = (t[:whole].reshape(streams, -1).T for t in (before, tokens))
    windows = [(x[lo : lo + STEPS], y[lo : lo + STEPS]) for lo in range(0, len(x), STEPS)]
    if whole < len(tokens):
        windows.append((before[None, whole:], tokens[None, whole:]))
    m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    h = np.zeros((streams, HIDDEN), np.float32)
    for i, (x, y) in enumerate(windows, 1):
        g, h, _ = gradients(p, v, x, x == end, y, h if x.shape[1] == len(h) else np.zeros((x.shape[1], HIDDEN), np.float32))
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            s[k] += 0.01 * (g[k] ** 2 - s[k])
            p[k] -= RATE * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-7)
    return p


def numbers(v: Vocabulary, head: pa.Array, words: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts in turn, an end behind each, and how many each text has. head: the words of v."""
    found = pc.index_in(words, value_set=head).fill_null(len(head)).to_numpy()
    return np.insert(found, bounds[1:], v.words.index(END)), np.diff(bounds) + 1


def _head(v: Vocabulary) -> pa.Array:
    return pa.array(v.words, pa.binary()).cast(pa.string())


def _flat(p: dict) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def _unflat(like: dict, data: bytes) -> dict:
    out, at = {}, 0
    flat = np.frombuffer(data, "<f4")
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        v, p = shared.value
        head, parts, held = _head(v), [], 0
        models: list[tuple[bytes, int]] = []
        for batch in bounded(batches):
            parts.append(numbers(v, head, *words_of(batch.column("text")))[0])
            held += len(parts[-1])
            if held > SCORED_TOKENS:  # goes on from here, so that what is held is bounded
                p = train(p, v, np.concatenate(parts))
                models, parts, held = [(_flat(p), (models[0][1] if models else 0) + held)], [], 0
        if held:
            p = train(p, v, np.concatenate(parts))
            models = [(_flat(p), (models[0][1] if models else 0) + held)]
        for data, n in models:
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([n], pa.int64())], names=["model", "n"])

    return run


def _average(models: pa.Table) -> pa.Table:
    """Mean of models, weighted by tokens."""
    total, n = 0.0, 0
    for data, k in zip(models.column("model"), models.column("n"), strict=True):
        total, n = total + np.frombuffer(data.as_py(), "<f4").astype(float) * k.as_py(), n + k.as_py()
    return pa.table({"model": pa.array([(total / n).astype("<f4").tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})


def fit(training: DataFrame, v: Vocabulary) -> dict:
    """Weights after ROUNDS rounds, which part the training documents between them: in each, every partition trains on its own documents
    from the same weights, and the results are averaged, in 64 groups first. Only those 64 models reach the driver."""
    spark, p = training.sparkSession, initial(v)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((v, p))
        own = training.filter(F.floor(crc(F.col("doc_id")) / 5) % ROUNDS == k).select("text")
        models = own.mapInArrow(_train(shared), "model binary, n long").withColumn("g", F.pmod(F.xxhash64("model"), F.lit(64)))
        groups = models.groupBy("g").applyInArrow(_average, "model binary, n long").toArrow()
        if groups.num_rows:
            p = _unflat(p, _average(groups).column("model")[0].as_py())
        shared.unpersist()
    return p


# --- scoring -----------------------------------------------------------------------------------------------------


def score_documents(p: dict, v: Vocabulary, tokens: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each document but for the shares of tail words; tokens are those of all documents in turn (each ends with
    END), lens long. All documents advance together, the longest first in order; states carry on from window to window until the document
    ends."""
    order = np.argsort(-lens, kind="stable")
    starts, less = (np.cumsum(lens) - lens)[order], -lens[order]
    # the input of a document's first word is the end before it, in a fresh state
    inputs = v.input[np.append(tokens[-1], tokens[:-1])].astype(np.int32)
    total, h, w = np.zeros(len(lens)), np.zeros((len(lens), HIDDEN), np.float32), gates(p)
    longest = -int(less[0])
    for lo in range(0, longest, WINDOW):
        live = np.searchsorted(less, -np.arange(lo, min(lo + WINDOW, longest)))  # documents with more than t tokens
        ends = np.cumsum(live).tolist()
        rows = np.arange(ends[-1]) - np.repeat(np.cumsum(live) - live, live)
        at = starts[rows] + np.repeat(np.arange(lo, lo + len(live)), live)
        x, states, before = inputs[at], np.empty((ends[-1], HIDDEN), np.float32), 0
        with np.errstate(over="ignore"):
            for end in ends:
                h = advance(w, x[before:end], h[: end - before])[0]
                states[before:end] = h
                before = end
        total[: live[0]] += np.bincount(rows, log_probability(p, v, states, tokens[at]), minlength=live[0])
    out = np.empty(len(lens))
    out[order] = total
    return out


def _score(shared, log_total: float, doc_type: pa.DataType):
    names = ["rid", "doc_id", "word", "tf", "n_tokens", "n_known", "base", "score"]

    def tails(rid: pa.Array, doc_id: pa.Array, words: pa.Array, of: np.ndarray) -> pa.RecordBatch:
        """A row per document and tail word; of: each word's document."""
        coded = words.dictionary_encode()
        pairs, tf = np.unique(of * np.int64(len(coded.dictionary) + 1) + coded.indices.to_numpy(), return_counts=True)
        doc, word = (pa.array(k) for k in np.divmod(pairs, len(coded.dictionary) + 1))
        zero, none = pa.array(np.zeros(len(tf), np.int64)), pa.array(np.zeros(len(tf)))
        return pa.RecordBatch.from_arrays([rid.take(doc), doc_id.take(doc), coded.dictionary.take(word), pa.array(tf.astype(np.int64)), zero, zero, none, none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        v, p = shared.value
        head, tail = _head(v), len(v.words)
        base = np.append(np.log10(v.counts + 0.5) - log_total, 0.0)
        counted = np.append(v.counts >= 1, False)

        def scored(rows: list[tuple]) -> pa.RecordBatch:
            """A row per document; rows: rid, doc_id, tokens and number of tokens of documents."""
            rid, doc_id, tokens, lens = zip(*rows, strict=True)
            rid, tokens, lens = pa.concat_arrays(rid), np.concatenate(tokens), np.concatenate(lens)
            first = np.cumsum(lens) - lens
            known, sums = np.add.reduceat(counted[tokens].astype(np.int64), first), np.add.reduceat(base[tokens], first)
            marks = pa.array([f"\n{i}" for i in rid.to_pylist()])
            return pa.RecordBatch.from_arrays(
                [rid, pa.concat_arrays(doc_id), marks, pa.array(np.zeros(len(lens), np.int64)), pa.array(lens.astype(np.int64)), pa.array(known), pa.array(sums),
                 pa.array(score_documents(p, v, tokens, lens) / math.log(10))], names=names)

        rows, docs, held = [], 0, 0
        # documents advance together whatever batches they come in, as each step of the longest costs the same for one as for many
        for batch in bounded(batches):
            if not batch.num_rows:
                continue
            rid, doc_id = batch.column("rid"), batch.column("doc_id").cast(doc_type)
            words, bounds = words_of(batch.column("text"))
            tokens, lens = numbers(v, head, words, bounds)
            of = np.repeat(np.arange(len(lens)), lens)[tokens == tail]
            rare = np.delete(tokens == tail, np.cumsum(lens) - 1)
            yield tails(rid, doc_id, words.filter(pa.array(rare)), of)
            rows.append((rid, doc_id, tokens, lens))
            docs, held = docs + len(lens), held + len(tokens)
            if docs >= SCORED_DOCS or held >= SCORED_TOKENS:
                yield scored(rows)
                rows, docs, held = [], 0, 0
        if rows:
            yield scored(rows)

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text, lang).

    Rows whose crc32 of doc_id as text is 1 modulo 5 are held out; counts cover all others. base_score sums log10 of
    (c + 0.5) / (N + 0.5 (V + 1)), score the model's log10 probabilities over whole texts. Words outside the head vocabulary are joined
    with their counts, whatever their number: none of them is frequent, so no key is hot. Null and empty texts have the end token only;
    null languages share the classes of rare ones; a null doc_id counts as an empty text; repeated rows are counted and scored each; an
    empty table gives an empty result, and without any training row every word is unknown; other columns are not read."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    held_out = crc(F.col("doc_id")) % 5 == 1
    training = docs.filter(~held_out)
    counts, n_langs = word_counts(training)
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the smallest count from which on at most HEAD words are left; the window has a row per distinct count
    ranked = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("c"))))
    least = ranked.filter(F.col("upto") <= HEAD).agg(F.min("c")).first()[0]
    in_head = (F.col("c") >= F.lit(least if least is not None else 2**62)) | (F.col("word") == END.decode())
    head = counts.filter(in_head).toArrow()  # at most HEAD + 1 words
    words, c, lang = [w.encode() for w in head.column("word").to_pylist()], head.column("c").to_numpy().astype(float), head.column("lang").to_numpy().astype(np.int64)
    if END not in words:
        words, c, lang = [*words, END], np.append(c, 0.5), np.append(lang, 0)
    known = float(head.column("c").to_numpy().sum()) if head.num_rows else 0.0
    v = Vocabulary(words, c, lang, n_langs, total - known)
    if not total:
        v.counts[:] = 0
    shared = spark.sparkContext.broadcast((v, fit(training, v)))
    log_total = math.log10(total + 0.5 * (types + 1))
    tail_total = math.log10(total - known + 0.5 * (types - head.num_rows + 1))
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")).mapInArrow(
        _score(shared, log_total, to_arrow_type(docs.schema["doc_id"].dataType)), f"rid long, doc_id {kind}, word string, tf long, n_tokens long, n_known long, base double, score double")
    found = scored.join(counts.filter(~in_head).select("word", "c").hint("merge"), "word", "left")
    seen = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    sums = found.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("tf") * (seen - log_total)).alias("base_score"),
        F.sum(F.col("score") + F.col("tf") * (seen - tail_total)).alias("score"))
    return sums.select("doc_id", (crc(F.col("doc_id")) % 5 == 1).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))

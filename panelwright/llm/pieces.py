"""SentencePiece encoding and decoding by batched Viterbi over the pieces and scores of a model file.

A text, with a space before it where the model asks for one, is split into units: a word with the space before it, or one other white-space
character. Every distinct unit is segmented once a worker. Units of equal length advance together: at each position the hashes of all
substrings that end there probe the sorted keys of the pieces, and the best sum of scores so far and its length are kept as a backpointer.
A long unit, as in text without spaces, goes by itself: all its substrings are probed block by block, and the sum is carried over what they
hit. Bytes that no piece covers fall back to byte pieces, so that decoding gives back every text; a literal U+2581 is bytes as well, as that
character stands for a space in pieces. The model's normalizer has to be the identity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHES, bounded, claim, schema_of, table, texts_of

#: A word with all spaces before it, a run of spaces, or one other character of white space: no piece goes on from a word to a space.
_UNIT = re.compile(rb" *[^ \t-\r]+| +|[\t-\r]")
#: Units up to this many bytes advance together with others of their length.
TOGETHER_BYTES = 512
#: Score of a byte piece, at most; models with worse pieces give it BYTE_TIMES the score of the worst, so that no way that does without
#: byte pieces, of up to so many pieces a byte, loses to one with them.
BYTE_SCORE, BYTE_TIMES = -1e6, 64
#: Units that a worker remembers, and bytes of the longest of them.
CACHE_UNITS, CACHE_BYTES = 200_000, 64
#: Bytes of the units of one length that advance together, and positions of a long unit that are probed at once.
GROUP_BYTES, PROBED = 4 << 20, 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_CODE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)

_models: dict[str, "Pieces"] = {}
CACHES["pieces"] = _models.clear


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        #: Bytes of an id, and what stands before a text.
        self.width = 2 if n <= 1 << 16 else 4
        self.prefix = b" " if (model.encode("a", out_type=str) or [""])[0].startswith("▁") else b""
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        found: dict[bytes, tuple[float, int]] = {}
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.bytes[i], self.byte_id[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace("▁", " ").encode()
                self.bytes[i] = piece
                found[piece] = max(found.get(piece, (-np.inf, 0)), (model.get_score(i), i))
        keys = np.array([self.key(p) for p in found], np.uint64)
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], np.array([s for s, _ in found.values()])[order]
        self.ids = np.array([i for _, i in found.values()], np.int64)[order]
        self.lengths = np.array(sorted({len(p) for p in found}))
        self.byte_score = min(BYTE_SCORE, BYTE_TIMES * float(self.scores.min(initial=0.0)))
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    @staticmethod
    def key(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + int(_CODE[b])) & (2**64 - 1)
        return h

    def segment(self, units: list[bytes]) -> list[bytes]:
        """Piece ids (little-endian) of units of one length."""
        n, length = len(units), len(units[0])
        if length > TOGETHER_BYTES:
            return [self.segment_long(u) for u in units]
        data = np.frombuffer(b"".join(units), np.uint8).reshape(n, length)
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + _CODE[data[:, j]]
        power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(length, _BASE))))
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.ones((length + 1, n), np.int16), np.zeros((length + 1, n), np.int32)
        for j in range(1, length + 1):
            best[j], piece[j] = best[j - 1] + self.byte_score, self.byte_id[data[:, j - 1]]
            for size in self.lengths[self.lengths <= j]:
                h = prefix[j] - prefix[j - size] * power[size]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                score = best[j - size] + self.scores[at]
                better = (self.keys[at] == h) & (score > best[j])
                if better.any():
                    best[j][better], back[j][better], piece[j][better] = score[better], size, self.ids[at[better]]
        out, count = np.zeros((n, length), f"<u{self.width}"), np.zeros(n, np.int64)
        pos, rows = np.full(n, length), np.arange(n)
        while len(rows):
            count[rows] += 1
            out[rows, length - count[rows]] = piece[pos[rows], rows]
            pos[rows] -= back[pos[rows], rows]
            rows = rows[pos[rows] > 0]
        raw, row = out.tobytes(), self.width * length
        found = [raw[(k + 1) * row - self.width * c : (k + 1) * row] for k, c in enumerate(count.tolist())]
        # a hash that only looks like a piece's is found here, and its unit segmented by bytes
        return [ids if self._joined(ids) == u else self.segment_long(u) for u, ids in zip(units, found, strict=True)]

    def _hits(self, unit: bytes) -> Iterator[tuple[int, int, float, int]]:
        """(end, length, score, id) of every substring that is a piece, by end and length."""
        code = _CODE[np.frombuffer(unit, np.uint8)]
        down = np.multiply.accumulate(np.full(len(unit), _INVERSE))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * down)))
        power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(unit), _BASE))))
        for lo in range(1, len(unit) + 1, PROBED):
            found = []
            for size in self.lengths.tolist():
                end = np.arange(max(lo, size), min(lo + PROBED, len(unit) + 1))
                h = (sums[end] - sums[end - size]) * power[end]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == h)
                found.append((end[hit], np.full(len(hit), size), self.scores[at[hit]], self.ids[at[hit]]))
            end, size, score, i = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((size, end))
            yield from zip(end[order].tolist(), size[order].tolist(), score[order].tolist(), i[order].tolist(), strict=True)

    def segment_long(self, unit: bytes) -> bytes:
        """Piece ids (little-endian) of one unit of any length."""
        n = len(unit)
        best, back, piece = [0.0] * (n + 1), [1] * (n + 1), [0] * (n + 1)
        hits = self._hits(unit)
        hit, byte_id = next(hits, None), self.byte_id[np.frombuffer(unit, np.uint8)].tolist()
        for j in range(1, n + 1):
            top, size, which = best[j - 1] + self.byte_score, 1, byte_id[j - 1]
            while hit and hit[0] == j:
                _, k, score, i = hit
                if best[j - k] + score > top and self.bytes[i] == unit[j - k : j]:
                    top, size, which = best[j - k] + score, k, i
                hit = next(hits, None)
            best[j], back[j], piece[j] = top, size, which
        out, j = [], n
        while j:
            out.append(piece[j])
            j -= back[j]
        return np.array(out[::-1], f"<u{self.width}").tobytes()

    def learn(self, units: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each unit; short ones are remembered."""
        by_length: dict[int, list[bytes]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        long: dict[bytes, bytes] = {}
        for length, some in by_length.items():
            step = max(1, GROUP_BYTES // (16 * length))
            for lo in range(0, len(some), step):
                part = some[lo : lo + step]
                (self.known if length <= CACHE_BYTES else long).update(zip(part, self.segment(part), strict=True))
        return long

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [_UNIT.findall(self.prefix + t) if t else [] for t in texts]
        if len(self.known) > CACHE_UNITS:
            self.known = {}
        known, long = self.known, self.learn(set().union(*split) - self.known.keys())
        if not long:
            return [b"".join(map(known.__getitem__, units)) for units in split]
        return [b"".join([known.get(u) or long[u] for u in units]) for units in split]

    def _joined(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, f"<u{self.width}").tolist()))

    def decode(self, ids: bytes) -> bytes:
        return self._joined(ids).removeprefix(self.prefix)


def _encode(path: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces")
        pieces = Pieces.of(path)
        for batch in bounded(batches):
            ids = pieces.encode(texts_of(batch.column("text")))
            more = [pa.array(ids, pa.binary())]
            if check:
                more.append(pa.array([pieces.decode(x) for x in ids], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "ids", *["decoded"] * check])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces")
        pieces = Pieces.of(path)
        for batch in bounded(batches, "ids"):
            text = pa.array([pieces.decode(x) for x in texts_of(batch.column("ids"))], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with the column ids: piece ids of the whole text, little-endian u16, or u32 where the model has more than 65,536 pieces. Null and
    empty texts have no ids; repeated rows are encoded each; an empty table gives an empty result; a column named ids is replaced, all others
    are kept. Every row is encoded by itself: nothing is shuffled."""
    docs = docs.drop("ids")
    return docs.mapInArrow(_encode(model_path, False), ", ".join([*schema_of(docs), "ids binary"]))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded with the column decoded, the text that its ids stand for. Null ids decode to an empty text."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(_decode(model_path), ", ".join([*schema_of(encoded), "decoded string"]))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with ids, as encode() gives them, and decoded, as decode() does, by one worker a task."""
    docs = docs.drop("ids", "decoded")
    return docs.mapInArrow(_encode(model_path, True), ", ".join([*schema_of(docs), "ids binary", "decoded string"]))


def id_count(ids: str, model_path: str) -> Column:
    """Number of ids in a column of encode()."""
    return (F.length(ids) / Pieces.of(model_path).width).cast("long")


def op9_sentencepiece(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return both.select(
        "doc_id", id_count("ids", path).alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.crc32("decoded").alias("decoded_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))

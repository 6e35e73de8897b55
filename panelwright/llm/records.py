"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A record is: length of the payload (u64), masked CRC-32 of those 8 bytes (u32), payload, masked CRC-32 of the payload (u32), all little
endian. The payload is: doc_id (i64), flags (u8: 1 = doc_id is null), bytes per id (u8: 2 where the vocabulary has at most 65,536 ids,
else 4), number of ids (u64), ids. The index file has one entry per record: offset of the record (u64), its length with framing (u64),
ids before it in the file (u64), doc_id (i64). A checksum is masked by a rotation by 15 bits and an addition, so that a checksum of data
that hold checksums stays meaningful.
"""

from __future__ import annotations

import functools
import os
import re
import string
import struct
import sys
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, bounded, claim, cut, shared_path, table

MASK_ADD = 0xA282EAD8
#: Words that are more than Latin letters and signs, and parts of words, whose ids a Python worker remembers; beyond it, it starts anew.
CACHE_WORDS, CACHE_PARTS = 200_000, 800_000
#: Bytes of text whose words are told apart at once.
ENCODE_BYTES = 4 << 20
#: A word of letters with ASCII signs behind it that no contraction or special token holds, and all those signs.
_SIGNS = r"!-%(-/:;=?@\[-`{}~"
_LETTERS_SIGNS = re.compile(rb"([A-Za-z\x80-\xff]+)([%s]*)" % _SIGNS.encode())
_EACH_SIGN = "".join(re.findall(f"[{_SIGNS}]", bytes(range(33, 127)).decode()))
#: Letters of ASCII, Latin-1 and Latin Extended-A: each stands for itself whatever letters stand beside it.
_LATIN = string.ascii_letters + "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isalpha())
#: Records that stand one after another are read at once up to this many bytes; entries of an index that are held together.
READ_BYTES, ENTRIES = 4 << 20, 8192
#: One entry of an index: offset and length of a record, ids before it in the file, doc_id.
ENTRY = np.dtype([("at", "<u8"), ("length", "<u8"), ("before", "<u8"), ("doc_id", "<i8")])

_encoders: dict[str, "WordEncoder"] = {}
CACHES["records"] = _encoders.clear


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


@functools.cache
def marked_letters() -> frozenset[str]:
    """Letters that the normalizer turns into a letter and a mark."""
    letters = filter(str.isalpha, map(chr, range(0x80, sys.maxunicode + 1)))
    return frozenset(c for c in letters if not unicodedata.normalize("NFC", c).lower().isalpha())


class WordEncoder:
    """Encodes texts with a tokenizer of the tokenizers library whose normalizer lower-cases and whose pre-tokenizer parts words at ASCII
    white space, and letters from signs: the ids of a text are then those of its words in turn, and those of letters with signs behind
    them are the ids of both in turn. Letters are what the normalizer (NFC, lower case) leaves as letters: some become a letter and a
    mark, which joins the signs, so that their words go whole. Each distinct part is encoded once, Latin letters by the tokenizer's model
    alone, on what its normalizer and pre-tokenizer make of each letter."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        # ids by bytes of a word or part; of Latin letters by the text
        self.tokenizer, self.known, self.parts = Tokenizer.from_file(path), {}, {}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        made = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c)) for c in _LATIN if c not in marked_letters()}
        self.letter = {ord(c): m[0][0] for c, m in made.items()}
        if len(self.tokenizer.pre_tokenizer.pre_tokenize_str("".join(made))) != 1 or any(len(m) != 1 for m in made.values()):
            raise ValueError("the tokenizer parts letters")
        self.latin, self.model = "".join(made), self.tokenizer.model
        self.plain = f"^[{self.latin}]+[{_SIGNS}]*$"

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _single(self, some: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in got]

    def _letters(self, some: list[str]) -> list[bytes]:
        """Ids of words of letters only, encoded in one text and parted after each token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        after = np.flatnonzero(self.ends[ids]) + 1
        if len(after) != len(some) or not len(ids) or after[-1] != len(ids):
            return self._single(some)
        data, cuts = ids.tobytes(), [0, *(4 * after).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn_parts(self, letters: set[bytes], others: set[bytes]) -> None:
        for found, encode, step in ((letters, self._letters, 500), (others, self._single, 50_000)):
            new = list(found - self.parts.keys())
            for lo in range(0, len(new), step):
                some = new[lo : lo + step]
                self.parts.update(zip(some, encode([w.decode() for w in some]), strict=True))

    def _learn(self, words: set[bytes]) -> None:
        """Add words to known, by their parts where a word is letters and signs."""
        two, letters, others, marked = [], set(), set(), marked_letters()
        for w in words:
            m = _LETTERS_SIGNS.fullmatch(w)
            if m and (w.isascii() or (text := m[1].decode()).isalpha() and marked.isdisjoint(text)):
                body, signs = m[1].lower(), m[2]
                two.append((w, body, signs))
                letters.add(body)
                if signs:
                    others.add(signs)
            else:
                two.append((w, w, b""))
                others.add(w)
        self._learn_parts(letters, others)
        self.known.update((w, self.parts[body] + self.parts[signs] if signs else self.parts[body]) for w, body, signs in two)

    def _latin_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters only."""
        tokenize, letter, ids, cuts = self.model.tokenize, self.letter, [], [0]
        new = [w for w in words if w not in self.parts]
        for w in new:
            ids += [token.id for token in tokenize(w.translate(letter))]
            cuts.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        self.parts.update(zip(new, [data[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))
        return [self.parts[w] for w in words]

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (u32) of distinct words, one after another, and how many each has. Words of Latin letters and signs are parted in Arrow, so that Python
        sees their distinct parts only."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        if len(self.parts) > CACHE_PARTS:
            self.parts = {}
        plain = pc.match_substring_regex(words, self.plain)
        two, rest = words.filter(plain), _values(words.filter(pc.invert(plain)).cast(pa.binary()))
        body = pc.ascii_lower(pc.ascii_rtrim(two, characters=_EACH_SIGN)).dictionary_encode()
        signs = pc.utf8_ltrim(two, characters=self.latin).dictionary_encode()
        bodies, tails = _values(body.dictionary), _values(signs.dictionary.cast(pa.binary()))
        self._learn_parts(set(), set(tails) - {b""})
        self._learn({w for w in rest if w not in self.known} - {b""})
        found = [b"", *self._latin_ids(bodies), *[self.parts[x] if x else b"" for x in tails], *[self.known[w] if w else b"" for w in rest]]
        # of each word, where its first and second part stand in found
        slot, plain = np.zeros((len(words), 2), np.int64), plain.to_numpy(zero_copy_only=False)
        slot[plain, 0], slot[plain, 1] = 1 + body.indices.to_numpy(), 1 + len(bodies) + signs.indices.to_numpy()
        slot[~plain, 0] = 1 + len(bodies) + len(tails) + np.arange(len(rest))
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        return _gathered(np.frombuffer(b"".join(found), "<u4"), size, slot.ravel())[0], size[slot].sum(1, dtype=np.int32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (u32) of each text. Words are split and told apart in Arrow; ids are gathered by word."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        ids, ends = _gathered(*self._ids_of(coded.dictionary), coded.indices.to_numpy())
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _values(words: pa.Array) -> list:
    """The same as to_pylist, without a scalar for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _gathered(ids: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches of ids that follow one another, size long, the ones of which in turn; and where each ends in them, after a 0."""
    starts, long = np.cumsum(size, dtype=np.int32) - size, size[which]
    ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(long, dtype=np.int32)))
    return ids[np.repeat(starts[which] - ends[:-1], long) + np.arange(ends[-1], dtype=np.int32)], ends


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack("<qBBQ", doc_id or 0, doc_id is None, width, len(ids)) + ids.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids (u32) of one framed record; damage raises ValueError."""
    if len(data) < 12 or masked_crc(data[:8]) != struct.unpack_from("<I", data, 8)[0]:
        raise ValueError("damaged record length")
    n = struct.unpack_from("<Q", data)[0]
    payload = data[12 : 12 + n]
    if len(data) != n + 16 or masked_crc(payload) != struct.unpack_from("<I", data, 12 + n)[0]:
        raise ValueError("damaged record")
    doc_id, null, width, count = struct.unpack_from("<qBBQ", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", count, 18).astype("<u4")


def unframe(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids (u32) of every record of an open file, front to back, without an index; damage raises ValueError."""
    while head := stream.read(12):
        if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("damaged record length")
        yield parse(head + stream.read(struct.unpack("<Q", head[:8])[0] + 4))


def index_of(place: fs.FileSystem, root: str, part: int) -> Iterator[np.ndarray]:
    """The entries of a file's index, ENTRIES at a time."""
    with place.open_input_stream(f"{root}/part-{part:07d}.idx") as stream:
        while data := stream.read(ENTRIES * ENTRY.itemsize):
            if len(data) % ENTRY.itemsize:
                raise ValueError("damaged index")
            yield np.frombuffer(data, ENTRY)


def records_at(place: fs.FileSystem, root: str, part: int, entries: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids (u32) of the records of a file that entries name, in their order, whatever that is. What stands together in the file is
    read at once; an entry that does not fit its record raises ValueError."""
    with place.open_input_file(f"{root}/part-{part:07d}.rec") as file:
        lo = 0
        while lo < len(entries):
            hi, start = lo + 1, int(entries["at"][lo])
            end = start + int(entries["length"][lo])
            while hi < len(entries) and int(entries["at"][hi]) == end and end + int(entries["length"][hi]) - start <= READ_BYTES:
                end, hi = end + int(entries["length"][hi]), hi + 1
            file.seek(start)
            data = file.read(end - start)
            for at, length, _, doc_id in entries[lo:hi].tolist():
                found, ids = parse(data[at - start : at - start + length])
                if (found or 0) != doc_id:
                    raise ValueError("index and record differ")
                yield found, ids
            lo = hi


def _writer(folder: str, tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("records")
        encoder, part = WordEncoder.of(tokenizer_path), TaskContext.get().partitionId()
        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        # a task that runs again writes the same bytes; each attempt has names of its own until it is done
        names = [f"{root}/part-{part:07d}.{kind}" for kind in ("rec", "idx")]
        drafts = [f"{root}/.{uuid.uuid4().hex}.{kind}" for kind in ("rec", "idx")]
        at = tokens = records = 0
        with place.open_output_stream(drafts[0]) as rec, place.open_output_stream(drafts[1]) as idx:
            for batch in batches:
                texts, doc_ids = batch.column("text"), batch.column("doc_id").to_pylist()
                sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
                at_bytes = np.searchsorted(sizes, np.arange(ENCODE_BYTES, sizes[-1] if len(sizes) else 0, ENCODE_BYTES)).tolist()
                bounds = sorted({0, *at_bytes, len(texts)})
                for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                    for doc_id, some in zip(doc_ids[lo:hi], encoder.encode(texts.slice(lo, hi - lo)), strict=True):
                        ids = np.append(some, np.uint32(end_id))
                        data = frame(doc_id, ids, encoder.width)
                        rec.write(data)
                        idx.write(struct.pack("<QQQq", at, len(data), tokens, doc_id or 0))
                        at, tokens, records = at + len(data), tokens + len(ids), records + 1
        for draft, name in zip(drafts, names, strict=True):
            place.move(draft, name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "records": pa.array([records], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "bytes": pa.array([at], pa.int64())})

    return write


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> DataFrame:
    """Write the ids of docs (doc_id, text) into folder, a URI that driver and executors share, in ascending order of doc_id over the
    files part-0000000.rec, ... with their .idx; returns the manifest (part, records, tokens, bytes), one row per file.

    Texts are dealt by ranges of doc_id before they are encoded; rows with the same doc_id come in the order of a hash of the text, and a
    null doc_id first. A null or empty text has the end id only; repeated rows are written each; an empty table gives empty files; other
    columns are not read."""
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h_")).repartitionByRange("doc_id", "h_").sortWithinPartitions("doc_id", "h_", "text")
    return cut(ordered.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer_path, end_id), "part int, records long, tokens long, bytes long"), "manifest")


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, start in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for entries in index_of(place, root, part):
                    rows = [(doc_id, start + before, len(ids), zlib.crc32(ids.tobytes())) for before, (doc_id, ids) in zip(entries["before"].tolist(), records_at(place, root, part, entries), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_FOUND)

    return read


def placed(manifest: DataFrame) -> DataFrame:
    """part and start (ids in all files before it) of the files that hold records, dealt one by one. The window has a row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).filter("records > 0").select("part", "start")
    return files.repartition(max(1, min(4096, manifest.count())), "part")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every record in folder, found through the index files."""
    return placed(manifest).mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _indexer(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.column("part").to_pylist():
                for entries in index_of(place, root, part):
                    yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(entries), part, np.int32))} | {c: pa.array(entries[c].astype(np.int64)) for c in ENTRY.names})

    return read


def _fetcher(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            part, asked = batch.column("part").to_numpy(), np.empty(batch.num_rows, ENTRY)
            for c in ENTRY.names:
                asked[c] = batch.column(c).to_numpy()
            turns = np.flatnonzero(np.diff(part, prepend=-1))
            for lo, hi in zip(turns.tolist(), [*turns[1:].tolist(), len(part)], strict=True):
                for k in range(lo, hi, 256):
                    found = list(records_at(place, root, int(part[k]), asked[k : min(k + 256, hi)]))
                    ids = pa.array([x.tobytes() for _, x in found], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), ids], names=["doc_id", "ids"])

    return read


def shuffled_records(manifest: DataFrame, folder: str, seed: int, partitions: int) -> DataFrame:
    """doc_id and ids (little-endian u32) of every record in folder, dealt and ordered by a hash of seed and place: only index entries are
    shuffled, and each record is read at its offset. The same seed gives the same order."""
    entries = placed(manifest).select("part").mapInArrow(_indexer(folder), "part int, at long, length long, before long, doc_id long")
    dealt = entries.withColumn("key", F.xxhash64(F.lit(seed), "part", "at")).repartition(partitions, "key").sortWithinPartitions("key")
    return dealt.drop("key").mapInArrow(_fetcher(folder), "doc_id long, ids binary")


def op10_records(spark, sf_dir):
    import public_tokenizers

    folder = shared_path(spark, "records")
    manifest = write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    return read_records(manifest, folder)

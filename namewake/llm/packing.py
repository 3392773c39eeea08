"""Packing along a space-filling curve: similar documents become neighbours in the sequences.

Each document's token counts, hashed to a few hundred buckets, are projected to a few dimensions by fixed random
signs; the place of that point on a Hilbert curve is the document's key. The keys are range-sorted over the cluster
and running token counts give each document its place in one long stream, which is cut every ``length`` tokens.
So only the last sequence is padded, no document has to fit into one task together with others, and documents
of any length or number of copies are dealt evenly: equal keys are ordered by a hash of the row's number.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, saved

BUCKETS, DIMENSIONS, BITS = 256, 4, 10


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    letters = {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordIds(dict):
    """Word (UTF-8) -> its ids as little-endian unsigned 32-bit integers; a cache that computes what it lacks.

    The tokenizer never joins text over ASCII white space, so a text's ids are those of its words; it lower-cases, so
    ASCII case is dropped first where no combining mark could make that differ; and a mark of punctuation at the end
    of a word is a token of its own. A word of lower-case Latin letters passes normalising and splitting
    unchanged, so it goes straight to the library's merges. When ``keep`` words are held they become the older half,
    from which those still in use come back.
    """

    def __init__(self, path: str, keep: int) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.keep = keep
        self.older: dict[bytes, bytes] = {}
        self.direct = all(self.merged(w.encode()) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("the", "straße", "élanción", "x"))

    def merged(self, word: bytes) -> list[int]:
        text = word.decode() if word.isascii() else "".join([self.letters[b] for b in word])
        return [t.id for t in self.model.tokenize(text)]

    def is_plain(self, word: bytes) -> bool:
        if word.isascii():
            return word.isalpha() and word.islower()
        text = word.decode()
        return text.isalpha() and max(text) < "\u0250" and text == text.lower() and unicodedata.is_normalized("NFC", text)

    def __missing__(self, word: bytes) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            if word[-1:] in b",.;:!?" and (word[-2:-1].isalpha() or len(word) > 1 and self.is_plain(word[:-1])):
                packed = self[word[:-1]] + self[word[-1:]]
            else:
                ids = self.merged(word) if self.direct and self.is_plain(word) else self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
                packed = np.array(ids, dtype="<u4").tobytes()
        self[word] = packed
        return packed

    def ids(self, text: str) -> bytes:
        raw = text.encode()
        words = raw.split() if b"\xcc" in raw or b"\xcd" in raw else raw.lower().split()  # first bytes of combining marks
        if b"<|" in raw:  # special strings count as they are written, before case is dropped
            words = [w if b"<|" in w else low for w, low in zip(raw.split(), words, strict=True)]
        packed = b"".join(map(self.__getitem__, words))
        if len(self) > self.keep:
            self.older = dict(self)
            self.clear()
        return packed


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on a Hilbert curve of whole-number points (rows), each coordinate of ``bits`` bits.

    The bits are first untwisted from the highest down, then put into Gray code and interleaved (Skilling 2004).
    """
    x = points.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def curve_points(counts: np.ndarray) -> np.ndarray:
    """Bucket counts (rows) -> whole-number points: square roots, unit length, random signs, squashed to a grid."""
    signs = np.random.default_rng(7).choice((-1.0, 1.0), (counts.shape[1], DIMENSIONS))
    roots = np.sqrt(counts)
    norms = np.linalg.norm(roots, axis=1, keepdims=True)
    flat = (roots / np.where(norms > 0, norms, 1)) @ signs
    return np.clip((np.tanh(flat) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


_loaded: dict[tuple[str, int], WordIds] = {}


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, keep: int) -> DataFrame:
    """(row, doc_id, key, doc_tokens, ids): each document's ids with ``end_id`` and its place on the curve."""

    def make():
        at = (tokenizer_path, keep)
        if at not in _loaded:
            _loaded[at] = WordIds(tokenizer_path, keep)
        words, end = _loaded[at], np.array([end_id], dtype="<u4").tobytes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [words.ids(t or "") + end for t in batch.column(2).to_pylist()]
            counts = np.stack([np.bincount(np.frombuffer(p, "<u4") % BUCKETS, minlength=BUCKETS) for p in packed])
            keys = hilbert_keys(curve_points(counts))
            narrow = [_narrow(p) for p in packed]
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(narrow, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "key", "doc_tokens", "ids"])

        return each

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, make, "row long, doc_id long, key long, doc_tokens long, ids binary")


def _narrow(packed: bytes) -> bytes:
    """Ids as stored between the passes: a byte that tells the width, then 16-bit ids where all fit."""
    ids = np.frombuffer(packed, "<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\x04" + packed


def _wide(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[0] == 2 else "<u4", offset=1).astype("<u4")


def packed(docs: DataFrame, *, tokenizer_path: str, length: int = 4096, end_id: int = 2, keep: int = 1_000_000, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of whole ``docs`` (doc_id, text).

    Every id lies in exactly one piece; sequences are numbered from 0 without gaps and only the last can be short.
    A null or empty text is the end id alone. Rows with a null or repeated doc_id are packed like any other. An empty
    table gives no pieces. Documents with the same key (copies, ties) keep one fixed order within a run. Columns
    besides doc_id and text are not read. ``with_ids`` adds the ids, for writing the sequences.
    """
    rows = saved(tokenized(docs, tokenizer_path, end_id, keep))
    order = ["key", "spread", "row"]
    keys = rows.select("row", "key", "doc_tokens", F.xxhash64("row").alias("spread"))
    ranged = saved(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("doc_tokens").alias("n"))  # a row for each partition
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def running():
        total, current = 0, None

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal total, current
            part = batch.column(2)[0].as_py()
            if part != current:
                total, current = 0, part
            sizes = batch.column(1).to_numpy()
            ends = total + np.cumsum(sizes)
            total = int(ends[-1])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ends - sizes, pa.int64())], names=["row", "part", "within"])

        return each

    places = map_arrow(ranged.select("row", "doc_tokens", "part"), running, "row long, part int, within long")
    starts = places.join(F.broadcast(before), "part").select("row", (F.col("before") + F.col("within")).alias("place"))

    def cut():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, stored, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, done = _wide(stored), 0
                while done < len(ids):
                    at = place + done
                    size = min(length - at % length, len(ids) - done)
                    piece = ids[done : done + size]
                    values = (doc_id, done, size, zlib.crc32(piece.tobytes()), len(ids), at // length, at % length, piece if with_ids else None)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    done += size
            columns = [pa.array(c, pa.int64()) for c in out[:7]]
            if with_ids:
                columns.append(pa.array(out[7], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in names.split(", ")])

        return each

    names = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return map_arrow(rows.join(starts, "row").select("doc_id", "ids", "place"), cut, names)

"""Benchmark decontamination: latent semantic retrieval of passages, then subsequence and answer checks.

Benchmark items and the corpus's passages near them become TF-IDF rows, with document frequencies counted over the whole
corpus. A distributed randomised SVD (subspace iteration on the Gram operator, whose products are summed over Spark
partitions) gives a latent basis. The windows of a document are projected on it and compared by cosine with the items. Windows near
an item are then checked word by word: the longest common subsequence must cover most of the item within a stretch of
about its length, and the item's answer words - given, or its rarest - must be there.

A document without enough answer words of an item can't pass the last check for it, so its windows are not projected for that item: that
bound is exact. Words outside the benchmark's vocabulary have no row in the basis, so the work on them ends with one lookup.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved

WORD = re.compile(r"[^\W_]+")
CELL = 16  # words; a window is two neighbouring cells
BLOCK = 64  # terms whose rows of a matrix go together


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def best_stretch(item: list[str], words: list[str]) -> tuple[float, list[str]]:
    """The largest share of ``item`` that is a common subsequence with a stretch of ``words`` half as long again, and the first such stretch."""
    size, known = len(item) + len(item) // 2 + 2, set(item)
    best, at = 0, 0
    for start, word in enumerate(words):
        if word in known and (found := common_length(item, words[start : start + size])) > best:
            best, at = found, start
            if best == len(item):
                break
    return best / len(item), words[at : at + size]


def gram_product(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """Sum of a^T (a basis) over the sparse rows (terms, weights): each partition sums its own rows, then the partitions are added for each ``BLOCK`` of terms.

    The driver gets the total only, in rows of one block and about a megabyte at a time, however many partitions there are.
    """
    shape = basis.shape

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            for terms, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                weights = np.array(weights)
                total[terms] += np.outer(weights, weights @ basis[terms])
        place = TaskContext.get().partitionId()
        for low in range(0, len(total), BLOCK):
            if (part := total[low : low + BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int32()), pa.array([place], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["low", "place", "part"])

    def added(block: pa.Table) -> pa.Table:
        parts = sorted(zip(block["place"].to_pylist(), block["part"].to_pylist(), strict=True))  # always in the same order, as rounding depends on it
        total = sum(np.frombuffer(part) for _, part in parts)
        return pa.table({"low": block["low"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(run, "low int, place int, part binary").groupBy("low").applyInArrow(added, "low int, part binary")
    product = np.zeros(shape)
    for r in sums.coalesce(max(1, product.nbytes >> 20)).toLocalIterator():
        product[r.low : r.low + BLOCK] = np.frombuffer(r.part).reshape(-1, shape[1])
    return product


def latent_basis(rows: DataFrame, terms: int, rank: int, *, extra: int = 16, rounds: int = 2, seed: int = 5) -> np.ndarray:
    """Right singular vectors (terms x rank) of the sparse rows, by randomised subspace iteration."""
    width = min(terms, rank + extra)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(gram_product(rows, q))[0]
    values, vectors = np.linalg.eigh(q.T @ gram_product(rows, q))
    keep = np.argsort(values)[::-1][:rank]
    return q @ vectors[:, keep[values[keep] > 1e-9 * max(values.max(), 1e-12)]]


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """For each term, the number of documents with one of its words; and the number of documents."""
    terms = max(vocabulary.values(), default=-1) + 1

    def run(batches):
        counts, n = np.zeros(terms, np.int64), 0
        known = frozenset(vocabulary)
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                found = known.intersection(words_of(text))
                counts[list({vocabulary[w] for w in found})] += 1
        index = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *index], pa.int32()), pa.array([n, *counts[index]], pa.int64())], names=["term", "n"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts, total = np.zeros(terms, np.int64), 0
    for r in sums.collect():  # a row for each term at most
        if r.term < 0:
            total = r.n
        else:
            counts[r.term] = r.n
    return counts, total


Found = dict[int, tuple[float, float, float]]


@dataclass(frozen=True)
class Space:
    """What all items share: the vocabulary's terms, their weights and the latent basis (terms x rank)."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    basis: np.ndarray

    def row(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The unit TF-IDF row (terms, weights) of the words in the vocabulary."""
        terms, times = np.unique([self.vocabulary[w] for w in words if w in self.vocabulary], return_counts=True)
        weights = (1 + np.log(times)) * self.idf[terms.astype(np.int64)]
        return terms.astype(np.int64), weights / np.linalg.norm(weights)


class Finder:
    """A slice of the benchmark's items, and the search for them in a text. What it finds of an item depends on no other item."""

    def __init__(self, rows: list, space: Space, min_cosine: float, min_common: float, min_answer: float, min_words: int) -> None:
        self.space, self.min_cosine, self.min_common, self.min_answer = space, min_cosine, min_common, min_answer
        self.items = [(r.item_id, w, words_of(r.answer)) for r in rows if len(w := words_of(r.text)) >= min_words]
        weight = lambda w: space.idf[space.vocabulary[w]]
        self.answers = [set(a) or {w for _, w in sorted((-weight(w), w) for w in set(words))[: max(3, len(set(words)) // 3)]} for _, words, a in self.items]
        self.needed = [math.ceil(min_answer * len(a) - 1e-9) for a in self.answers]
        self.asked: dict[str, list[int]] = {}
        for i, answer in enumerate(self.answers):
            for w in answer:
                self.asked.setdefault(w, []).append(i)
        self.asked_words = frozenset(self.asked)
        self.free = [i for i, n in enumerate(self.needed) if n <= 0]

    def project(self) -> None:
        rows = [self.space.row(words) for _, words, _ in self.items]
        targets = np.stack([w @ self.space.basis[t] for t, w in rows]) if rows else np.zeros((0, self.space.basis.shape[1]))
        self.targets = (targets / np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)).T.astype(np.float32)
        self.term_rows = (self.space.basis * self.space.idf[:, None]).astype(np.float32)
        self.space = Space(self.space.vocabulary, self.space.idf, self.space.basis[:, :0])  # tasks need the scaled rows only

    def possible(self, words: list[str]) -> list[int]:
        """The items of which enough answer words stand somewhere in the text; no other can pass the answer check."""
        seen: dict[int, int] = {}
        for w in self.asked_words.intersection(words):
            for i in self.asked[w]:
                seen[i] = seen.get(i, 0) + 1
        return sorted({i for i, n in seen.items() if n >= self.needed[i]}.union(self.free))

    def passages(self, words: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each possible item the window with most of its answer words, as a TF-IDF row, if half of those needed are in it."""
        out = []
        for i in self.possible(words):
            cells: dict[int, set[str]] = {}
            for at, w in enumerate(words):
                if w in self.answers[i]:
                    cells.setdefault(at // CELL, set()).add(w)
            held, low = max(((len(cells.get(c, set()) | cells.get(c + 1, set())), -c) for c in {*cells, *(c - 1 for c in cells)}), default=(0, 0))
            if held and 2 * held >= self.needed[i]:
                terms, weights = self.space.row(words[max(0, -low * CELL) : (2 - low) * CELL])
                if len(terms):
                    out.append((i, terms, weights))
        return out

    def windows(self, words: list[str], wanted: list[int]) -> dict[int, list[tuple[int, float]]]:
        """Item number -> its windows (cell, cosine) above the least cosine."""
        ids = np.fromiter(map(self.space.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return {}
        found: dict[int, list[tuple[int, float]]] = {}
        cells, targets = at // CELL, self.targets[:, wanted]
        for low in range(0, int(cells[-1]) + 1, 2048):  # cells at a time, so that long texts take bounded memory
            a, b = np.searchsorted(cells, (low, low + 2049))
            if a == b:
                continue
            own = cells[a:b]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sums = np.zeros((2050, self.term_rows.shape[1]), np.float32)
            sums[own[starts] - low] = np.add.reduceat(self.term_rows[ids[at[a:b]]], starts, axis=0)
            pairs = sums[:2049] + sums[1:]
            used = np.flatnonzero(pairs.any(axis=1))
            pairs = pairs[used]
            cosines = (pairs @ targets) / np.maximum(np.linalg.norm(pairs, axis=1, keepdims=True), 1e-12)
            for w, item in zip(*np.nonzero(cosines >= self.min_cosine), strict=True):
                found.setdefault(wanted[item], []).append((low + int(used[w]), float(cosines[w, item])))
        return found

    def checked(self, words: list[str], item: int, near: list[tuple[int, float]]) -> tuple[float, float, float] | None:
        wanted = self.items[item][1]
        spans: list[list[int]] = []
        for cell, _ in sorted(near):
            low, high = max(0, cell * CELL - len(wanted)), (cell + 2) * CELL + len(wanted)
            if spans and low <= spans[-1][1]:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        best = None
        for low, high in spans:
            stretch = words[low:high]
            there = set(stretch)
            if sum(w in there for w in wanted) < self.min_common * len(wanted):
                continue  # no common subsequence is longer than the item's words that are there
            common, held = best_stretch(wanted, stretch)
            share = len(self.answers[item].intersection(held)) / len(self.answers[item])
            if common >= self.min_common and share >= self.min_answer and (best is None or (common, share) > best[:2]):
                best = (common, share, max(c for _, c in near))
        return best

    def find(self, text: str | None) -> Found:
        words = words_of(text)
        best: Found = {}
        if possible := self.possible(words):
            for item, near in self.windows(words, possible).items():
                found = self.checked(words, item, near)
                if found and found > best.get(self.items[item][0], (-1.0,)):
                    best[self.items[item][0]] = found
        return best


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, common, answer, cosine): the documents that hold a benchmark item, whole texts, one row a pair.

    ``benchmark`` has item_id and text, and may have ``answer``. ``common`` is the share of the item's words found as
    a common subsequence, ``answer`` the share of its answer words there, ``cosine`` the best window's. Options: see ``search``.

    Null or empty texts on either side never match, nor do items of under ``min_words`` words. Rows with a null doc_id are
    reported with it. Repeated documents are each reported; repeated items are each reported under their own item_id, and
    rows that repeat an item_id are searched as separate texts, the best of them reported. Empty tables give no
    rows. Columns besides those named are not read.
    """
    schema = "doc_id long, item_id long, common double, answer double, cosine double"
    out = docs.sparkSession.createDataFrame([], schema)
    for finder, near in search(docs, benchmark, **options):

        def make(finder=finder):
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                out: list[list] = [[] for _ in range(5)]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for item_id, found in finder.find(text).items():
                        for column, value in zip(out, (doc_id, item_id, *found), strict=True):
                            column.append(value)
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "item_id", "common", "answer", "cosine"])

            return each

        out = out.union(saved(map_arrow(near, make, schema)))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text holds no benchmark item; null and empty texts stay."""
    for finder, _ in search(docs, benchmark, **options):

        def make(finder=finder):
            return lambda batch: batch.filter(pa.array([not finder.find(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = map_arrow(docs, make, docs.schema)
    return docs


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    rank: int = 128,
    min_cosine: float = 0.5,
    min_common: float = 0.65,
    min_answer: float = 0.5,
    min_words: int = 8,
    terms: int = 1 << 16,
    slice_chars: int = 4_000_000,
    seed: int = 5,
) -> Iterator[tuple[Finder, DataFrame]]:
    """For each slice of the benchmark, its finder and the (doc_id, text) of the documents in which it can find anything.

    There is one vocabulary, hashed to ``terms``, one set of document frequencies and one basis for the whole benchmark. A slice, of
    about ``slice_chars`` characters, only bounds how many items a task holds; items don't influence each other, so the slices' size changes no result.

    The basis is of the items' TF-IDF rows and of the corpus's passages near them: in each document with enough answer words of an item, the
    window with most of them. An item's passages together weigh as much as the item, however often it is copied.
    """
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.alias("answer")).where("length(text) > 0")
    chars = items.agg(F.coalesce(F.sum(F.length("text") + F.coalesce(F.length("answer"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-chars // slice_chars))
    part = F.pmod(F.xxhash64("item_id"), F.lit(slices))
    spark = docs.sparkSession

    def item_words(rows: Iterator) -> Iterator[list[str]]:
        return (w for r in rows if len(w := words_of(r.text)) >= min_words)

    known = sorted({w for words in item_words(items.select("text").toLocalIterator()) for w in words})  # distinct words of the benchmark
    if not known:
        return
    places = {h: i for i, h in enumerate(sorted({zlib.crc32(w.encode()) % terms for w in known}))}
    vocabulary = {w: places[zlib.crc32(w.encode()) % terms] for w in known}
    counts, total = document_frequencies(docs, vocabulary)
    space = Space(vocabulary, np.log((1 + total) / (1 + counts)) + 0.1, np.zeros((len(places), 0)))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def finder(i: int, space: Space) -> Finder:
        return Finder(items.where(part == i).orderBy("item_id", "text", "answer").collect(), space, min_cosine, min_common, min_answer, min_words)  # one slice

    near, passages = [], spark.createDataFrame([], "item long, terms array<int>, weights array<double>")
    for i in range(slices):
        one = finder(i, space)

        def possible(one=one):
            return lambda batch: batch.filter(pa.array([bool(one.possible(words_of(t))) for t in batch.column(1).to_pylist()], pa.bool_()))

        near.append(saved(map_arrow(texts, possible, texts.schema)))

        def rows(one=one, i=i):
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [p for t in batch.column(1).to_pylist() for p in one.passages(words_of(t))]
                columns = [pa.array([slices * n + i for n, _, _ in found], pa.int64()), pa.array([t for _, t, _ in found], pa.list_(pa.int32())), pa.array([w for _, _, w in found], pa.list_(pa.float64()))]
                return pa.RecordBatch.from_arrays(columns, names=["item", "terms", "weights"])

            return each

        own = [(t.tolist(), w.tolist()) for t, w in (space.row(words) for _, words, _ in one.items)]
        passages = passages.union(map_arrow(near[-1], rows, passages.schema))
        passages = passages.union(spark.createDataFrame([(-1, *r) for r in own], passages.schema))
    passages = saved(passages)
    copies = passages.groupBy("item").agg(F.count("*").alias("n"))
    scaled = passages.join(copies, "item").select("terms", F.when(F.col("item") < 0, F.col("weights")).otherwise(F.transform("weights", lambda w: w / F.sqrt("n"))).alias("weights"))
    size = scaled.count()
    scaled = saved(scaled.repartition(min(64, math.ceil(size / 2000))))
    space = Space(vocabulary, space.idf, latent_basis(scaled, len(places), min(rank, size), seed=seed))
    for i in range(slices):
        one = finder(i, space)
        one.project()
        yield one, near[i]

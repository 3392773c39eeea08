"""Language identification: averaged hashed subword embeddings with a linear softmax, trained in numpy.

A text's subwords are its runs of two to four bytes that do not reach over a space. Each is hashed to an embedding;
the mean of the embeddings goes into a linear softmax. Both are trained by stochastic gradient descent. A temperature
and a rejection score are fitted on training rows that the descent has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

LETTER = regex.compile(r"\p{L}")
SIZES = (2, 3, 4)
CHUNK = 1 << 20


def subwords(text: bytes, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: the hashed bucket of the run that starts at each byte, and whether the run is a subword."""
    codes = np.frombuffer(text, np.uint8)
    space = codes <= 32
    found = []
    rolling = codes.astype(np.uint32)
    inner = np.zeros(len(codes), bool)
    for size in range(2, max(SIZES) + 1):
        n = len(codes) - size + 1
        if n <= 0:
            break
        rolling = rolling[:n] * np.uint32(0x01000193) ^ codes[size - 1 :]
        if size > 2:
            inner = inner[:n] | space[size - 2 : size - 2 + n]
        else:
            inner = inner[:n]
        mixed = rolling * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        found.append(((mixed % np.uint32(buckets)).astype(np.int32), ~inner))
    return found


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode() + b" "


def bucket_counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the whole text and their shares."""
    hashed = [h[ok] for h, ok in subwords(prepared(text), buckets)]
    index, counts = np.unique(np.concatenate(hashed) if hashed else np.zeros(0, np.int32), return_counts=True)
    return index, (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """Mean table row over all subwords of each whole text, in chunks of bounded size."""
        sums = np.zeros((len(texts), len(self.languages)), np.float64)
        sizes = np.zeros(len(texts), np.int64)
        group: list[bytes] = []
        first = 0

        def flush(until: int) -> None:
            nonlocal group, first
            if group:
                ends = np.cumsum([len(g) for g in group])
                starts = np.concatenate(([0], ends[:-1]))
                for size, (hashed, ok) in zip(SIZES, subwords(b"".join(group), len(self.table)), strict=False):
                    for back in range(1, size):  # a run that reaches into the next text
                        ok[ends[ends - back < len(ok)] - back] = False
                    values = self.table[hashed]
                    values[~ok] = 0
                    at = np.minimum(starts, len(ok) - 1)
                    sums[first:until] += np.add.reduceat(values, at, axis=0)
                    sizes[first:until] += np.add.reduceat(ok.astype(np.int64), at)
            group, first = [], until

        room = CHUNK
        for i, text in enumerate(texts):
            ready = prepared(text)
            if len(ready) > CHUNK:  # a very long text goes through in parts that overlap by no subword
                flush(i)
                for at in range(0, len(ready), CHUNK):
                    for hashed, ok in subwords(ready[at : at + CHUNK], len(self.table)):
                        sums[i] += self.table[hashed[ok]].sum(axis=0, dtype=np.float64)
                        sizes[i] += int(ok.sum())
                first, room = i + 1, CHUNK
                continue
            group.append(ready)
            room -= len(ready)
            if room < 0:
                flush(i + 1)
                room = CHUNK
        flush(len(texts))
        return sums / np.maximum(sizes, 1)[:, None] + self.bias

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language of each text and its calibrated probability."""
        p = softmax(self.logits(texts) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], *, buckets: int = 1 << 15, dimensions: int = 16, epochs: int = 6, rate: float = 4.0, false_rejects: float = 0.002, seed: int = 1) -> LanguageModel:
    """Fit on labelled texts; every fifth is kept out of the descent and fits the temperature and the rejection score."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    rows = [(*bucket_counts(t, buckets), names.index(y)) for t, y in zip(texts, langs, strict=True)]
    order = rng.permutation(len(rows))
    held = [rows[i] for i in order[::5]] if len(rows) >= 20 else rows
    seen = [rows[i] for k, i in enumerate(order) if k % 5 or len(rows) < 20]
    embed = rng.normal(0, 0.1, (buckets, dimensions)).astype(np.float32)
    weights = rng.normal(0, 0.1, (dimensions, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, done = epochs * len(seen), 0
    for _ in range(epochs):
        for i in rng.permutation(len(seen)):
            index, share, y = seen[i]
            now = rate * (1 - done / steps)
            done += 1
            mean = share @ embed[index]
            error = softmax(mean @ weights + bias)
            error[y] -= 1
            back = weights @ error
            weights -= now * 0.1 * np.outer(mean, error)
            bias -= now * 0.01 * error
            embed[index] -= now * share[:, None] * back[None, :]
    table = embed @ weights
    logits = np.array([share @ table[index] + bias for index, share, _ in held])
    truth = np.array([y for *_, y in held])
    loss = {t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in np.geomspace(0.05, 5, 40)}
    temperature = min(loss, key=loss.get)
    p = softmax(logits / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    low = float(right[int(false_rejects * len(right))]) if len(right) else 0.0
    chance = 1 / len(names)  # rejected are scores nearer to chance than to what a right answer may have
    return LanguageModel(names, table.astype(np.float32), bias.astype(np.float64), float(temperature), min((low + chance) / 2, low))


def training_rows(labelled: DataFrame, per_language: int, most_languages: int = 1000, seed: int = 11) -> DataFrame:
    """About ``per_language`` rows of each language (doc_id, text, lang), chosen by a hash; a language with fewer gives all.

    The languages are counted first, so that texts are filtered where they are read and never dealt by language.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30).cast("long")) / float(1 << 30)
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], per_language / r["n"])]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    return usable.where(place < F.try_element_at(shares, F.col("lang"))).select("doc_id", "text", "lang")


def fit(labelled: DataFrame, *, per_language: int = 500, **options) -> LanguageModel:
    """Train on a bounded sample of ``labelled`` (doc_id, text, lang): about ``per_language`` whole texts of each language, one row of each text."""
    rows = sorted((r for r in training_rows(labelled, per_language).dropDuplicates(["doc_id", "text", "lang"]).collect() if LETTER.search(r.text)), key=lambda r: (r.doc_id is None, r.doc_id, r.text))
    return train([r.text for r in rows], [r.lang for r in rows], **options)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept out of training: crc32 of the doc_id as text, modulo ``folds``, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text), from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0 and rejected, as is everything when nothing was
    learned. Ties go to the first language by name. Null and repeated doc_ids keep their rows; an empty
    table gives none. ``rejected`` is also true below the calibrated score. Columns besides doc_id and text are not read.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            sure = [bool(t and model.languages and LETTER.search(t)) for t in texts]
            best, score = model.scores([t for t, ok in zip(texts, sure, strict=True) if ok]) if any(sure) else (np.zeros(0, int), np.zeros(0))
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            for i, at, s in zip(np.flatnonzero(sure), best, score, strict=True):
                langs[i], scores[i] = model.languages[at], s
            columns = [batch.column(0), pa.array(langs), pa.array(scores), pa.array((scores < model.reject_below) | (np.array(langs) == "und"))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

        return each

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, make, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns, that ``predict`` does not reject."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            sure = [bool(t and model.languages and LETTER.search(t)) for t in texts]
            keep = np.array(sure, bool)
            if any(sure):
                keep[keep] = model.scores([t for t, ok in zip(texts, sure, strict=True) if ok])[1] >= model.reject_below
            return batch.filter(pa.array(keep))

        return each

    return map_arrow(docs, make, docs.schema)

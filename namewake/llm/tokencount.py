"""Token counts by heap-and-linked-list byte-pair merging over a sentencepiece vocabulary.

The symbols of a piece of text stand in a doubly linked list; a heap holds the mergeable neighbours by score and
place. Popping the best pair until none is left gives the merges, and the count is the initial symbols minus the
merges, plus the extra bytes of symbols that the vocabulary can only spell byte by byte. No identifiers are made.

A merge never crosses the end of a word, because no piece of the vocabulary has a space mark after another
character (checked when the vocabulary is loaded). So a text is counted word by word, and the counts of words are
kept in a table of bounded size in each task.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SPACE = "▁"


class PairMerger(dict):
    """Text without inner space marks -> number of tokens; a cache that computes what it lacks."""

    def __init__(self, model_path: str, keep: int) -> None:
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        known = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): -model.get_score(i) for i in known}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.scores):
            raise ValueError("a piece has a space mark after another character; words can't be counted one by one")
        if model.encode("  ") == model.encode(" ") or model.encode("a") == model.encode(" a") or model.encode("ﬁ", out_type=str)[-1] == "fi":
            raise ValueError("the vocabulary normalises text; only spaces as they are and one leading space are supported")
        inner = set().union(*(piece for piece in self.scores if len(piece) > 1))
        self.alone = "".join(c for c in map(chr, range(32)) if c not in inner)
        self.words = re.compile(f"{SPACE}*[^{SPACE}{re.escape(self.alone)}]+|{SPACE}+|[{re.escape(self.alone)}]")
        self.keep = keep

    def __missing__(self, piece: str) -> int:
        self[piece] = count = self.merged(piece)
        return count

    def merged(self, piece: str) -> int:
        symbols: list[str | None] = list(piece)
        scores, n = self.scores, len(piece)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if (both := piece[i : i + 2]) in scores:
                heap.append((scores[both], i, both))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, both = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != len(both) or left + symbols[j] != both:
                continue  # one side has been merged since
            symbols[i], symbols[j] = both, None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (new := both + symbols[k]) in scores:
                    heapq.heappush(heap, (scores[new], i, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + both) in scores:
                heapq.heappush(heap, (scores[new], h, new))
        spelled = sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in scores)
        return n - merges + spelled

    def count(self, text: str) -> int:
        if not text:
            return 0
        total = sum(map(self.__getitem__, self.words.findall(SPACE + text.replace(" ", SPACE))))
        if len(self) > self.keep:
            self.clear()
        return total


_loaded: dict[tuple[str, int], PairMerger] = {}


def token_counts(docs: DataFrame, *, model_path: str, limit: int = 4096, keep: int = 400_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text), whole texts.

    A null text counts as empty: no bytes, no tokens. Rows with a null or repeated doc_id get their own row. An empty
    table gives no rows. Columns besides doc_id and text are not read. A word of any length is merged whole; the
    table of words is emptied when it has more than ``keep`` entries.
    """

    def make():
        key = (model_path, keep)
        if key not in _loaded:
            _loaded[key] = PairMerger(model_path, keep)
        merger = _loaded[key]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [merger.count(t) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return each

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

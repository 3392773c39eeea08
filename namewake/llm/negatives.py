"""Hard negatives: for each anchor and each of its positives, the best rows of other labels in a window below the positive's score.

The windows of an anchor overlap, but they differ only in where they end. So the upper limits of its positives cut the
scores into disjoint slots, from the highest limit down; a row of another label falls into one slot. Tasks keep the best
``k`` rows of each slot of each anchor, a group limit before and after the shuffle combines them, and what a window
holds are the first ``k`` of its own slot and all lower ones: a suffix of the slots, in falling order, cut at the
window's lower limit.

Scores are computed twice, by shards of the rows and blocks of the anchors: for the positives, then, with the limits they
give, for the slots. The two saved tables are read against each other part by part: neither is shuffled or broadcast for it.
A task takes one pair of a shard and a block at a time and carries, from shard to shard, the best rows of the anchors of its
part. So neither side has to fit anywhere as a whole, no label is gathered, and a task's result is as large as its anchors,
whatever they are compared with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved
from .topk import quantised, usable


NONE, ALL = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Scores computed at a time, numbers held for the anchors of a task, and shards that one task should at least go through in a large table.
CELLS, HELD, SHARDS = 2**19, 2**23, 64


def narrow(numbers: np.ndarray) -> np.ndarray:
    """The same integers in the shortest type that holds them."""
    kinds = [np.iinfo(t) for t in (np.int16, np.int32, np.int64)]
    return numbers.astype(next(x.dtype for x in kinds if x.min <= numbers.min() and numbers.max() <= x.max))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (vec_id, label, v, and for anchors limits, least) packed where they lie, by label: up to ``size`` of one width in a row, nothing is shuffled."""
    more = rows.columns[3:]
    schema = ", ".join(["width int", "ids array<long>", "labels array<long>", "vectors binary", *(f"{x} array<long>" for x in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                of = batch.filter(pa.array(widths == width)).sort_by("label")
                for at in range(0, of.num_rows, size):
                    part = of.slice(at, size)
                    numbers = [part.column(c) for c in (0, 1, *range(3, 3 + len(more)))]
                    numbers = [x.flatten() if pa.types.is_list(x.type) or pa.types.is_large_list(x.type) else x for x in numbers]
                    ids, labels, *others = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in numbers)
                    vectors = pa.array([narrow(part.column(2).flatten().to_numpy()).tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), ids, labels, vectors, *others], names=["width", "ids", "labels", "vectors", *more])

    return rows.mapInArrow(run, schema)


def unpacked(batch: pa.RecordBatch, row: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of a packed row whose columns begin at ``first``; the batch begins with the width."""
    ids, labels = (batch.column(first + c)[row].values.to_numpy() for c in (0, 1))
    cell, numbers = batch.column(first + 2)[row].as_buffer(), len(ids) * batch.column(0)[row].as_py()
    return ids, labels, np.frombuffer(cell, f"i{len(cell) // numbers}").reshape(len(ids), -1)


def slot_of(scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The slot of each score no higher than the first of the falling ``limits`` (one list, or one for each score, filled up with ``NONE``): the last limit that is not below it."""
    return (limits >= scores[:, None]).sum(axis=1) - 1


class Best:
    """The ``k`` best rows of each slot of each anchor of a block, from all shards that it has met."""

    def __init__(self, limits: np.ndarray, least: np.ndarray, k: int):
        self.limits, self.least, self.k, self.met = limits, least, k, False
        self.last = (limits > NONE).sum(axis=1) - 1
        self.scores = np.full((limits.size, k), NONE)
        self.ids = np.zeros((limits.size, k), np.int64)

    def low(self, at: slice) -> np.ndarray:
        """Lower scores of these anchors count no more: they would fall into the last slot, which is full of better ones."""
        full = self.scores.reshape(*self.limits.shape, self.k)[at, :, -1]
        return np.maximum(self.least[at], np.take_along_axis(full, self.last[at, None], 1)[:, 0])

    def add(self, anchor: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in rows between the anchors' ``low`` and their highest limit."""
        group = anchor * self.limits.shape[1] + slot_of(scores, self.limits[anchor])
        good = scores >= self.scores[group, -1]
        if not good.any():
            return
        group, scores, ids = group[good], scores[good], ids[good]
        groups = np.unique(group)
        group = np.concatenate([group, np.repeat(groups, self.k)])
        scores = np.concatenate([scores, self.scores[groups].ravel()])
        ids = np.concatenate([ids, self.ids[groups].ravel()])
        order = np.lexsort((ids, ~scores, group))  # ~ falls as - does, and has no overflow
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        first = order[(starts[:, None] + np.arange(self.k)).ravel()]  # a group has the k it had at least
        self.scores[groups], self.ids[groups] = scores[first].reshape(-1, self.k), ids[first].reshape(-1, self.k)

    def found(self, anchors: np.ndarray) -> pa.RecordBatch:
        group, place = np.nonzero(self.scores > NONE)
        anchor, slot = np.divmod(group, self.limits.shape[1])
        columns = (anchors[anchor], slot, self.ids[group, place], self.scores[group, place])
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["anchor_id", "slot", "vec_id", "score"])


def compare(best: Best, anchors: tuple[np.ndarray, np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray, np.ndarray], *, same: bool) -> None:
    """Add a shard's rows of the anchors' own labels, or with ``same`` false of all others, to what the block's anchors hold. Both are sorted by label."""
    (own, of, wanted), (ids, labels, vectors) = anchors, rows
    most = [max(-float(x.min()), float(x.max())) for x in (wanted, vectors)]
    bound = most[0] * most[1] * wanted.shape[1]
    kind, edge = (np.float32, 2**24) if bound < 2**24 else (np.float64, 2**53) if bound < 2**53 else (np.int64, ALL)  # float products are exact here, and fast
    wanted, vectors = wanted.astype(kind), vectors.astype(kind)
    if same:
        shared = np.intersect1d(of, labels)
        ranges = zip(*(np.searchsorted(x, shared, side).tolist() for x in (of, labels) for side in ("left", "right")), strict=True)
    else:
        ranges = [(0, len(own), 0, len(ids))]
    for a, a_end, r, r_end in ranges:
        cuts = [r, r_end] if best.met else [x for x in (r, r + 32, r + 256) if x < r_end] + [r_end]  # a few rows first give bounds to the others
        for start, end in zip(cuts, cuts[1:], strict=False):
            step = max(1, CELLS // (end - start))
            for at in range(a, a_end, step):
                part = slice(at, min(a_end, at + step))
                table = wanted[part] @ vectors[start:end].T
                low, high = (np.clip(x, -edge, edge).astype(kind)[:, None] for x in (best.low(part), best.limits[part, 0]))
                hit = np.flatnonzero((table >= low) & (table <= high))
                anchor, row = np.divmod(hit, end - start)
                anchor, row = anchor + at, row + start
                right = ids[row] != own[anchor] if same else (ids[row] != own[anchor]) & (labels[row] != of[anchor])
                if right.any():
                    best.add(anchor[right], table.ravel()[hit[right]].astype(np.int64), ids[row[right]])
    best.met = True


def met(members: DataFrame, asking: DataFrame, held: int, block_anchors: int) -> DataFrame:
    """A row for each shard of ``members`` and each block of ``asking`` (vec_id, label, v, limits, least) of its width; an anchor takes ``held`` numbers of a task's memory besides its own."""
    size = asking.agg(F.count("*").alias("anchors"), F.sum(F.size("v") + held).alias("numbers")).first()
    cores = members.sparkSession.sparkContext.defaultParallelism
    spread = min(-(-4 * cores // max(1, members.rdd.getNumPartitions())), -(-size["anchors"] // 512))  # where the rows lie in few parts
    parts = max(1, spread, -(-(size["numbers"] or 0) // HELD))
    blocks = saved(packed(asking.repartition(parts), max(1, min(block_anchors, HELD // held))))
    blocks = blocks.select("width", *(F.col(x).alias(f"asking_{x}") for x in blocks.columns[1:]))
    return members.hint("shuffle_replicate_nl").join(blocks, "width")


def scored(members: DataFrame, asking: DataFrame, limits: int, k: int, block_anchors: int, *, same: bool) -> DataFrame:
    """(anchor_id, slot, vec_id, score, place): of each anchor and each slot of its ``limits`` limits the ``k`` best rows of its label, or with ``same`` false of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, Best]] = {}  # an anchor is in one block only
        for batch in batches:
            for row in range(batch.num_rows):
                anchors = unpacked(batch, row, 4)
                if (block := int(anchors[0][0])) not in found:
                    ends, least = (batch.column(c)[row].values.to_numpy() for c in (7, 8))
                    found[block] = anchors[0].copy(), Best(ends.reshape(-1, limits).copy(), least.copy(), k)
                compare(found[block][1], anchors, unpacked(batch, row, 1), same=same)
        for ids, best in found.values():
            yield best.found(ids)

    pairs = met(members, asking.select("vec_id", "label", "v", "limits", "least"), 2 * limits * k, block_anchors)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return pairs.mapInArrow(run, "anchor_id long, slot long, vec_id long, score long").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(vectors: DataFrame, anchors: Column, *, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, scale: int = 256, shard_rows: int = 4096, block_anchors: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id, label, embedding) that ``anchors`` picks.

    An anchor's positives are its ``positives`` best other rows of the same label. For each, the ``k`` best rows of other labels are
    returned whose score is from ``low`` to ``high`` percent of the positive's; fewer rows give all, none gives no row. A positive with a
    negative score has an empty window (if ``low`` is below ``high``), one with the score 0 only rows with the score 0.

    Rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no part. Vectors of different lengths
    never meet. Ties go to the smaller vec_id. Rows that share an anchor's vec_id are its own and neither positives nor negatives; of
    repeated anchors the smallest (width, label, vector) asks; other rows that share a vec_id count one by one. An empty table gives no rows. Other columns are
    not read. Scores are exact while sums of absolute products are below 2^63.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").alias("v"), anchors.alias("asked"))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    numbers = quantised(F.col("v"), scale).alias("v")
    members = saved(packed(rows.where(whole).select("vec_id", "label", numbers), shard_rows))
    members = members.coalesce(max(4 * members.sparkSession.sparkContext.defaultParallelism, -(-members.count() // SHARDS)))
    once = rows.where("asked").where(whole).select("vec_id", "label", numbers).groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("width"), "label", "v")).alias("first"))
    asking = saved(once.select("vec_id", "first.*"))

    no_limits = asking.withColumns({"limits": F.array(F.lit(int(ALL))), "least": F.lit(int(NONE))})
    found = scored(members, no_limits, 1, positives, block_anchors, same=True)
    upper = F.floor(F.col("score") * high / F.lit(100)) if high % 100 else F.col("score") * (high // 100)
    positive = saved(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), upper.cast("long").alias("limit")))

    ends = positive.groupBy("anchor_id").agg(F.sort_array(F.collect_set("limit"), asc=False).alias("limits"), F.min(F.col("positive_score") * low).alias("lowest"))
    ends = ends.withColumn("limits", F.concat("limits", F.array_repeat(F.lit(int(NONE)), F.lit(positives) - F.size("limits"))))
    ends = ends.select(F.col("anchor_id").alias("vec_id"), "limits", F.expr("(lowest - pmod(lowest, 100)) div 100").alias("least"))
    limited = saved(asking.join(ends, "vec_id"))
    found = scored(members, limited, positives, k, block_anchors, same=False)
    row = F.struct("slot", (-F.col("score")).alias("down"), "vec_id")  # at most k rows of each of an anchor's few slots
    slots = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    window = positive.join(slots, "anchor_id").join(limited.select(F.col("vec_id").alias("anchor_id"), "limits"), "anchor_id")
    own = F.array_position("limits", F.col("limit")) - 1
    suffix = F.slice(F.filter("rows", lambda x: x["slot"] >= own), 1, k)
    inside = F.filter(suffix, lambda x: -x["down"] * 100 >= F.col("positive_score") * low)
    each = window.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("place", "row"))
    return each.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("row.vec_id").alias("negative_id"), "positive_score", (-F.col("row.down")).alias("negative_score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS a, c.vec_id AS c, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), p AS (
  SELECT a, c AS p, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5
), w AS (
  SELECT p.a, p.p, p.score AS ps, s.c, s.score AS ns, CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.c) AS INTEGER) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT a AS anchor_id, p AS positive_id, rank, c AS negative_id, ps AS positive_score, ns AS negative_score FROM w WHERE rank <= 5
"""

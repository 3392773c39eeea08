"""Exact top-k by inner product with Fagin's threshold algorithm, over shards of the vectors and blocks of the queries.

Vectors are dealt to shards of bounded size by a hash of their row. In a shard each dimension has a sorted list. A query
walks all lists at once, from the end that its sign prefers; what it meets is scored in full; it stops when the best
score that an unseen vector could have - the sum of what stands at its places in the lists - cannot beat the kth score.
The shards' results are merged by rank. Each pair of a shard and a query block is a task's row, so neither side has to
fit anywhere as a whole, and no pair of rows is emitted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, saved


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, not empty, and no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def threshold_search(lists: np.ndarray, values: np.ndarray, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int | None, k: int) -> tuple[list[tuple[int, int]], int]:
    """The k best (id, score) of a shard, ties to the smaller id, and how many rows were scored for them.

    ``lists[j]`` holds row numbers by falling component j and ``values[j]`` these components. Rows with the query's own
    id take no part. A row tied with the kth score still counts, so the walk stops only when the bound is below it.
    """
    n = len(ids)
    active = np.flatnonzero(query)
    if not len(active):
        order = np.argsort(ids, kind="stable")
        return [(int(i), 0) for i in ids[order] if i != own][:k], 0
    up = query[active] < 0
    seen = np.zeros(n, bool)
    best: list[tuple[int, int]] = []
    depth, step = 0, max(1, 64 * k // (4 * len(active)))
    while depth < n:
        end = min(n, depth + step)
        met = np.concatenate([lists[active[~up], depth:end].ravel(), lists[active[up], n - end : n - depth].ravel()])
        new = np.unique(met[~seen[met]])
        seen[new] = True
        new = new[ids[new] != own] if own is not None else new
        if len(new):
            scores = vectors[new] @ query
            if len(new) > k:  # all that reach the kth score among the new ones
                top = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                new, scores = new[top], scores[top]
            best = sorted([*best, *((-int(s), int(i)) for s, i in zip(scores, ids[new], strict=True))])[:k]
        depth, step = end, step * 2
        if depth < n and len(best) == k:
            edge = np.where(up, values[active, n - 1 - depth], values[active, depth])
            if int((edge * query[active]).sum()) < -best[-1][0]:
                break
    return [(i, -s) for s, i in best], int(seen.sum())


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, shard_rows: int = 8192, block_queries: int = 512, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row of ``vectors`` (vec_id, embedding) that ``queries`` picks.

    Fewer than k candidates give all of them. Vectors that are null, empty or hold a null or non-finite component take
    no part, nor do rows with a null vec_id. Vectors of different lengths never meet. Rows with the same vec_id
    are the query's own and never its candidates; of repeated queries the smallest vector asks. Repeated vec_ids
    among candidates are ranked as separate rows. An empty table gives no rows. Other columns are not read. Scores are exact while the
    sum of absolute products is below 2^53, as for any unit vectors.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"), queries.alias("asked"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).select("vec_id", "asked", quantised(F.col("v"), scale).alias("v"))
    rows = saved(rows.withColumn("width", F.size("v")))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    shards, blocks = max(1, -(-counts["n"] // shard_rows)), max(1, -(-counts["q"] // block_queries))
    place = F.xxhash64("vec_id", F.monotonically_increasing_id())
    packed = F.sort_array(F.collect_list(F.struct("vec_id", "v")))
    every_shard, every_block = F.sequence(F.lit(0), F.lit(shards - 1)), F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = rows.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int")).groupBy("width", "shard").agg(packed.alias("members"))
    once = rows.where("asked").groupBy("vec_id").agg(F.min(F.struct("width", "v")).alias("first")).select("vec_id", "first.*")
    asked = once.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("width", "block").agg(packed.alias("asking"))
    each_pair = ["width", "shard", "block"]  # one row on either side
    tasks = dealt.withColumn("block", F.explode(every_block)).join(asked.withColumn("shard", F.explode(every_shard)), each_pair)

    def make():
        def unpacked(cell: pa.ListScalar, width: int) -> tuple[np.ndarray, np.ndarray]:
            ids = cell.values.field("vec_id").to_numpy()
            return ids, cell.values.field("v").flatten().to_numpy().reshape(len(ids), width)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list[int]] = [[], [], []]
            for r in range(batch.num_rows):
                width = batch.column(0)[r].as_py()
                ids, found = unpacked(batch.column(1)[r], width)
                query_ids, wanted = unpacked(batch.column(2)[r], width)
                exact = float(np.abs(found).max()) * float(np.abs(wanted).max()) * width < 2**53
                kind = np.float64 if exact else np.int64  # float64 products are exact here, and fast
                lists = np.argsort(-found.T, axis=1, kind="stable")
                values = np.take_along_axis(found.T, lists, axis=1)
                found = found.astype(kind)
                for own, query in zip(query_ids.tolist(), wanted.astype(kind), strict=True):
                    for other, score in threshold_search(lists, values, found, ids, query, own, k)[0]:
                        for column, value in zip(out, (own, other, score), strict=True):
                            column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

        return each

    found = map_arrow(tasks.select("width", "members", "asking"), make, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

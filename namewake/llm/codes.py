"""Product codes of vectors: Lloyd's rounds over parts, by trees over both the parts and the codebook's entries.

A vector is cut into equal parts; each part position has a codebook of a few entries. Shards of the vectors keep, for each
position, their parts in the order of a balanced tree: a node is a range of that order with a box around it, and its sum is a
difference of running sums. The entries have such a tree too. Both are walked together, level by level: a node of parts is
paired with nodes of entries, and a pair goes when its least distance is above the largest distance of some other pair of
that node. A node of parts with one entry left is assigned whole, by its cached sum; in leaves that keep several the
integer distances decide. Pairs tied with the best stay, so the result is that of comparing all parts with all entries.

Codebooks are a small table, a row for each vector length; sums of all shards meet by position and entry, combined in each task first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved
from .topk import quantised, usable


#: Components beyond this are set to it, so that squared distances of up to 64 components fit into 63 bits.
LARGEST = 1 << 27


def ranges(n: int, level: int) -> np.ndarray:
    """Ends of the nodes of a level: node j holds the places from ends[j] to ends[j + 1]; its children share its ends."""
    return np.arange((1 << level) + 1) * n >> level


def tree_order(points: np.ndarray, levels: int) -> np.ndarray:
    """An order of the points in which every node of every level is a range: nodes are halved along their widest side."""
    n = len(points)
    order = np.arange(n)
    for level in range(levels):
        ends = ranges(n, level)
        here = points[order]
        side = (np.maximum.reduceat(here, ends[:-1]) - np.minimum.reduceat(here, ends[:-1])).argmax(axis=1)
        node = np.repeat(np.arange(1 << level), np.diff(ends))
        order = order[np.lexsort((here[np.arange(n), side[node]], node))]
    return order


class Tree:
    """Boxes of every level, over points in the order of ``tree_order``."""

    def __init__(self, points: np.ndarray, levels: int):
        self.points, self.levels = points, levels
        ends = ranges(len(points), levels)
        self.low, self.high = [np.minimum.reduceat(points, ends[:-1])], [np.maximum.reduceat(points, ends[:-1])]
        for _ in range(levels):
            self.low.insert(0, np.minimum(self.low[0][::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][::2], self.high[0][1::2]))
        self.sums = np.vstack([np.zeros_like(points[:1]), points.cumsum(axis=0)])


def entry_tree(entries: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of the different entries with one in each leaf, and each leaf's entry number, the lowest of equal ones; -1 for leaves that only fill up."""
    different, first = np.unique(entries, axis=0, return_index=True)
    levels = (len(different) - 1).bit_length()
    fill = (1 << levels) - len(different)
    points, numbers = np.vstack([different, different[-1:].repeat(fill, axis=0)]), np.concatenate([first, np.full(fill, -1)])
    order = tree_order(points, levels)
    return Tree(points[order], levels), numbers[order]


def assign(tree: Tree, entries: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Whole nodes as (starts, ends, entry numbers), a triple for each level; the places of the other points and their entries. Each point is in one of them."""
    codebook, numbers = entry_tree(entries)
    n, level, entry_level = len(tree.points), 0, 0
    node, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole = []
    while True:
        low, high, entry_low, entry_high = tree.low[level][node], tree.high[level][node], codebook.low[entry_level][entry], codebook.high[entry_level][entry]
        least = (np.maximum(0, np.maximum(entry_low - high, low - entry_high)) ** 2).sum(axis=1)
        most = (np.maximum(entry_high - low, high - entry_low) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        bound = np.repeat(np.minimum.reduceat(most, starts), np.diff(starts, append=len(node)))
        keep = least <= bound
        if entry_level == codebook.levels:
            keep &= numbers[entry] >= 0
        node, entry = node[keep], entry[keep]
        if entry_level == codebook.levels:
            starts = np.flatnonzero(np.diff(node, prepend=-1))
            times = np.diff(starts, append=len(node))
            ends, of = ranges(n, level), node[starts[times == 1]]
            whole.append((ends[of], ends[of + 1], numbers[entry[starts[times == 1]]]))
            several = np.repeat(times > 1, times)
            node, entry = node[several], entry[several]
        if not len(node) or (level == tree.levels and entry_level == codebook.levels):
            break
        if level < tree.levels:
            node, entry, level = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([entry, entry]), level + 1
        if entry_level < codebook.levels:
            node, entry, entry_level = np.concatenate([node, node]), np.concatenate([2 * entry, 2 * entry + 1]), entry_level + 1
        order = np.lexsort((entry, node))
        node, entry = node[order], entry[order]
    if not len(node):
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = numbers[entry]
    order = np.lexsort((number, node))
    node, number = node[order], number[order]
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    times, ends = np.diff(starts, append=len(node)), ranges(n, level)
    of = node[starts]
    sizes = ends[of + 1] - ends[of]
    places = np.concatenate([np.arange(a, b) for a, b in zip(ends[of], ends[of + 1], strict=True)])
    each = np.repeat(times, sizes)  # candidates of each place
    at = np.repeat(np.cumsum(each) - each, each)
    candidate = number[np.repeat(np.repeat(starts, sizes), each) + np.arange(each.sum()) - at]
    distance = ((tree.points[np.repeat(places, each)] - entries[candidate]) ** 2).sum(axis=1)
    best = np.repeat(np.minimum.reduceat(distance, np.cumsum(each) - each), each)
    hit = np.flatnonzero(distance == best)  # candidates rise, so the first is the lowest number
    _, first = np.unique(np.repeat(np.arange(len(places)), each)[hit], return_index=True)
    return whole, places, candidate[hit[first]]


SHARD = "width int, lane long, ids array<long>, labels array<{label}>, places array<int>, parts array<int>"


def shards(rows: DataFrame, parts: int, shard_rows: int, leaf: int) -> DataFrame:
    """``rows`` (vec_id, label, v) packed where they lie, each part position in the order of its tree; ``places`` leads back to the rows."""
    names = ["width", "lane", "ids", "labels", "places", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                of = batch.filter(pa.array(widths == width))
                for at in range(0, of.num_rows, shard_rows):
                    part = of.slice(at, shard_rows)
                    values = part.column(2).flatten().to_numpy().reshape(part.num_rows, parts, width // parts)
                    orders = [tree_order(values[:, p], levels_of(part.num_rows, leaf)) for p in range(parts)]
                    ordered = np.concatenate([values[o, p].ravel() for p, o in enumerate(orders)]).astype(np.int32)
                    lane = int(np.bitwise_xor.reduce(values.ravel() * np.int64(0x9E3779B97F4A7C1)))
                    lists = [part.column(0), part.column(1), pa.array(np.concatenate(orders).astype(np.int32)), pa.array(ordered)]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([lane], pa.int64()), *lists], names=names)

    return rows.mapInArrow(run, SHARD.format(label=rows.schema["label"].dataType.simpleString()))


def levels_of(n: int, leaf: int) -> int:
    """Halvings after which nodes of ``n`` points hold up to ``leaf`` and at least one."""
    return max(0, (-(-n // leaf) - 1).bit_length())


def unpacked(batch: pa.RecordBatch, row: int, parts: int, leaf: int) -> Iterator[tuple[int, np.ndarray, Tree, np.ndarray]]:
    """(position, places, tree, entries) of a row of shards with codebooks."""
    width = batch.column("width")[row].as_py()
    size = width // parts
    places = batch.column("places")[row].values.to_numpy().reshape(parts, -1)
    values = batch.column("parts")[row].values.to_numpy().astype(np.int64).reshape(parts, -1, size)
    entries = batch.column("codebook")[row].values.to_numpy().reshape(parts, -1, size)
    for p in range(parts):
        yield p, places[p], Tree(values[p], levels_of(values.shape[1], leaf)), entries[p]


def with_codebooks(members: DataFrame, codebooks: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Each shard with its length's codebook: broadcast if all of them are small, else joined by a spread key."""
    if codebooks.agg(F.coalesce(F.sum(F.size("codebook")), F.lit(0))).first()[0] * 8 <= broadcast_bytes:
        return members.join(F.broadcast(codebooks), "width").drop("lane")
    lanes = max(1, members.count())
    spread = codebooks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return members.withColumn("lane", F.pmod(F.xxhash64("lane"), F.lit(lanes)).cast("int")).join(spread, ["width", "lane"]).drop("lane")


def moved(members: DataFrame, codebooks: DataFrame, parts: int, leaf: int, broadcast_bytes: int) -> DataFrame:
    """The codebooks after a round: each entry is the floor of the mean of its parts, or stays without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of all shards of this task
        for batch in batches:
            for row in range(batch.num_rows):
                width = batch.column("width")[row].as_py()
                for p, _, tree, entries in unpacked(batch, row, parts, leaf):
                    sums, counts = total.setdefault(width, (np.zeros((parts, *entries.shape), np.int64), np.zeros((parts, len(entries)), np.int64)))
                    whole, places, chosen = assign(tree, entries)
                    for starts, ends, numbers in whole:
                        np.add.at(sums[p], numbers, tree.sums[ends] - tree.sums[starts])
                        np.add.at(counts[p], numbers, ends - starts)
                    np.add.at(sums[p], chosen, tree.points[places])
                    np.add.at(counts[p], chosen, 1)
        for width, (sums, counts) in total.items():
            n = np.repeat(counts.ravel(), width // parts)
            used = np.flatnonzero(n)
            columns = [pa.array(np.full(len(used), width, np.int32)), pa.array(used.astype(np.int32)), pa.array(sums.ravel()[used]), pa.array(n[used])]
            yield pa.RecordBatch.from_arrays(columns, names=["width", "at", "total", "n"])

    found = with_codebooks(members, codebooks, broadcast_bytes).mapInArrow(run, "width int, at int, total long, n long")
    means = found.groupBy("width", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    means = means.select("width", "at", F.expr("(total - pmod(total, n)) div n").alias("mean"))
    old = codebooks.select("width", F.posexplode("codebook").alias("at", "value"))
    new = old.join(means, ["width", "at"], "left").select("width", F.struct("at", F.coalesce("mean", "value").alias("value")).alias("item"))
    return saved(new.groupBy("width").agg(F.sort_array(F.collect_list("item"))["value"].alias("codebook")))


def coded(members: DataFrame, codebooks: DataFrame, label: str, parts: int, leaf: int, broadcast_bytes: int) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) by the final codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, order, tree, entries in unpacked(batch, row, parts, leaf):
                    whole, places, chosen = assign(tree, entries)
                    code = np.zeros(len(ids), np.int64)
                    for starts, ends, numbers in whole:
                        size = ends - starts
                        code[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(numbers, size)
                    code[places] = chosen
                    codes[order, p] = code
                    error[order] += ((tree.points - entries[code]) ** 2).sum(axis=1)
                digest = hashlib.sha256(",".join(map(str, batch.column("codebook")[row].values.to_pylist())).encode()).hexdigest()
                texts = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(texts, pa.string()), pa.array(error), pa.array([digest] * len(ids), pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return with_codebooks(members, codebooks, broadcast_bytes).mapInArrow(run, f"vec_id long, label {label}, code string, error long, codebooks_sha256 string")


def compress(
    vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, shard_rows: int = 4096, leaf: int = 16, broadcast_bytes: int = 1 << 25, broadcast_labels: int = 100_000
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for each usable row of ``vectors`` (vec_id, label, embedding).

    Each position's codebook starts as that part of the ``entries`` rows of smallest vec_id (rows of one vec_id by their vectors; null ids last; all rows, if
    fewer), and goes through ``rounds`` rounds. Ties go to the lower entry. ``error`` sums a row's squared distances, ``label_error`` the errors
    of all rows of its label, nulls together (null if it exceeds a long).

    Rows with a null or empty vector, one that can't be cut into ``parts`` equal parts, or a null or non-finite component are dropped. Vectors of different
    lengths have codebooks of their own. Quantised components beyond 2^27 are set to that. A null vec_id or label stays null; repeated rows count
    and are returned each. An empty table gives no rows. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").alias("v"))
    rows = rows.where(usable(F.col("v")) & (F.size("v") % parts == 0))
    limit = F.lit(LARGEST).cast("long")
    rows = rows.withColumn("v", F.transform(quantised(F.col("v"), scale), lambda x: F.greatest(F.least(x, limit), -limit)))
    members = saved(shards(rows, parts, shard_rows, leaf))

    order = Window.partitionBy("width").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    first = rows.select(F.size("v").alias("width"), "vec_id", "v").withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries)
    first = first.groupBy("width").agg(F.sort_array(F.collect_list(F.struct("place", "v")))["v"].alias("all"))
    size = (F.col("width") / parts).cast("int")
    by_part = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.flatten(F.transform("all", lambda v: F.slice(v, p * size + 1, size))))
    codebooks = saved(first.select("width", F.flatten(by_part).alias("codebook")))
    for _ in range(rounds):
        codebooks = moved(members, codebooks, parts, leaf, broadcast_bytes)

    found = saved(coded(members, codebooks, vectors.schema["label"].dataType.simpleString(), parts, leaf, broadcast_bytes))
    totals = saved(found.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    small = F.broadcast(totals) if totals.count() <= broadcast_labels else totals
    return found.join(small, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


_ASSIGNED = """
{name} AS MATERIALIZED (
  SELECT n, p, x, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
    SELECT parts.n, parts.p, parts.x, c.e, CAST(list_sum(list_transform(list_zip(parts.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM parts JOIN {book} c ON c.p = parts.p) GROUP BY n, p, x
)"""
_MOVED = """
{name} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM {book} c LEFT JOIN (
    SELECT p, e, list(mean ORDER BY i) AS x FROM (
      SELECT p, e, i, CAST((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean FROM {assigned}, range(1, 5) r(i) GROUP BY p, e, i
    ) GROUP BY p, e) m ON m.p = c.p AND m.e = c.e
)"""
#: For vectors of 64 components.
ORACLE = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, v) AS n, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), parts AS MATERIALIZED (SELECT n, p, v[4 * p + 1 : 4 * p + 4] AS x FROM v, range(16) r(p)
), book0 AS MATERIALIZED (SELECT p, n - 1 AS e, x FROM parts WHERE n <= 64),"""
    + ",".join(_ASSIGNED.format(name=f"a{i}", book=f"book{i}") + "," + _MOVED.format(name=f"book{i + 1}", book=f"book{i}", assigned=f"a{i}") for i in range(2))
    + ","
    + _ASSIGNED.format(name="a2", book="book2")
    + """, s AS (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS sha FROM book2, range(1, 5) r(i)
), c AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY n)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM v JOIN c USING (n), s
"""
)

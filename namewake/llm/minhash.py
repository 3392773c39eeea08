"""MinHash near-duplicates by bottom-k sketches of one hash function.

A text's sketch is the ``k`` least hashes of its distinct word shingles; a set of up to ``k`` is kept whole. The least ``k`` values of two
sketches together are the sketch of the union, and the share of them that both hold estimates the Jaccard similarity.

* Copies cost nothing: rows with the same set are one node.
* Inverted lists of the retained values generate overlaps. A link of the wanted similarity shares at least ``needed`` retained values (with a
  chance of all but ``miss``; for sets that are kept whole always), so each sketch enters only its rarest values into lists: with ``s`` values, the first
  ``s - needed + 1`` in an order by frequency; two such starts must meet. Passages that many texts share are the last in that order.
* A list's members are first compared with one member, which ties a group of near copies together by as many pairs as it has members; then
  only across the components that remain. There, the shingles that others have too, counted by hash, bound what two texts can
  share, which leaves few pairs even in a crowd whose members all differ from one original.
* Pairs go through the union sketch, then through an exact comparison of whole shingle sets.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved, stored
from .components import connected_components
from .simhash import shingle_hashes, shingle_sets


def needed(k: int, percent: int, miss: float) -> int:
    """The largest count that a share of ``percent`` falls short of with at most the chance ``miss`` in ``k`` draws."""
    p, below = percent / 100, 0.0
    for count in range(k + 1):
        below += comb(k, count) * p**count * (1 - p) ** (k - count)
        if below > miss:
            return count
    return k


def sketches(rows: DataFrame, words: int, k: int, seed: int = 42) -> DataFrame:
    """(doc_id, digest, n, h1, h2, sketch) of each text of (doc_id, text, digest): its number of distinct shingles, a 128-bit hash of their set, the ``k`` least."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, halves, kept = [], [], []
            for text in batch.column(1).to_pylist():
                values = np.unique(np.array(shingle_hashes(text, words, seed), np.uint64).view(np.int64))
                sizes.append(len(values))
                halves.append(np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64))
                kept.append(values[:k])
            columns = [pa.array(sizes, pa.int64()), pa.array([h[0] for h in halves], pa.int64()), pa.array([h[1] for h in halves], pa.int64()), pa.array(kept, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "digest", "n", "h1", "h2", "sketch"])

        return each

    return map_arrow(rows.select("doc_id", "text", "digest"), make, "doc_id long, digest long, n long, h1 long, h2 long, sketch array<long>")


def postings(nodes: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """(value, node, n, weight): the starts of the sketches of ``nodes`` (node, n, sketch), rarest values first, in lists of two or more members.

    ``weight`` sums how many nodes hold each value of the node's whole sketch: an original weighs more than its copies, which have values of their own.
    """
    every = nodes.select("node", F.explode("sketch").alias("value"))
    common = every.groupBy("value").agg(F.count("*").alias("times")).where("times > 1")
    shared = every.join(common, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("shared"))
    held = F.least(F.col("n"), F.lit(k))
    wanted = F.least(F.lit(least), F.ceil(F.col("n") * percent / F.lit(100)))
    alone = held - F.size("shared")  # values of one node stand first in the order, and in no list
    start = F.slice("shared", 1, F.greatest(F.lit(0), held - wanted + 1 - alone).cast("int"))
    weight = F.aggregate("shared", F.lit(0).cast("long"), lambda t, x: t + x["times"])
    placed = saved(nodes.join(shared, "node").select("node", "n", weight.alias("weight"), F.explode(start).alias("at")).select(F.col("at.value").alias("value"), "node", "n", "weight"))
    several = placed.groupBy("value").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    return stored(placed.join(several, "value"))


def _sizes_fit(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def star(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a list with its weightiest member."""
    pivots = lists.groupBy("value").agg(F.max(F.struct("weight", "node", "n")).alias("best"))
    pairs = lists.join(pivots, "value").where((F.col("node") != F.col("best.node")) & _sizes_fit(F.col("n"), F.col("best.n"), percent))
    return saved(pairs.select(F.col("best.node").alias("a"), F.col("node").alias("b")).distinct())


def shareable(sets: DataFrame, classes: int) -> DataFrame:
    """(node, others, counts) of ``sets`` (node, shingles): how many of a node's shingles other nodes have too, and these in ``classes`` by hash."""

    def combined():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            values, first, times = np.unique(lists.flatten().to_numpy(), return_index=True, return_counts=True)
            nodes = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(nodes[first]), pa.array(times)], names=["shingle", "node", "nodes"])

        return each

    def counted():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = [np.bincount(np.asarray(values.values) % classes, minlength=classes) for values in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(lists, np.int32).reshape(-1, classes).tolist(), pa.list_(pa.int32()))], names=["node", "counts"])

        return each

    once = map_arrow(sets, combined, "shingle long, node long, nodes long").groupBy("shingle").agg(F.sum("nodes").alias("nodes"), F.min("node").alias("node")).where("nodes = 1")
    place = F.pmod(F.col("shingle"), F.lit(classes)).cast("int")
    own = once.groupBy("node", place.alias("class")).agg(F.count("*").cast("int").alias("n")).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("own"))
    rest = F.transform("counts", lambda n, i: n - F.coalesce(F.try_element_at("own", i), F.lit(0)))
    every = map_arrow(sets, counted, "node long, counts array<int>").join(own, "node", "left")
    every = every.select("node", F.when(F.col("own").isNull(), F.col("counts")).otherwise(rest).alias("counts"))
    return every.select("node", F.aggregate("counts", F.lit(0), lambda t, n: t + n).alias("others"), "counts")


def across(lists: DataFrame, labels: DataFrame, wanted: DataFrame, rows: DataFrame, words: int, percent: int, classes: int = 64, lane_rows: int = 1024) -> DataFrame:
    """(a, b): the pairs of members of one list with different labels that can be similar; members of a list's main label do not meet each other.

    ``wanted`` has the first row of each node, ``rows`` their texts. What two nodes share is at most the sum of the lesser of their counts of shareable
    shingles by class; a pair for which that is too little for the similarity is no link and leaves no row. Lists with many members outside the main label are dealt by lanes.
    """
    named = saved(lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    by_label = named.groupBy("value", "label").agg(F.count("*").alias("here"))
    several = by_label.groupBy("value").agg(F.count("*").alias("labels"), F.max(F.struct("here", "label"))["label"].alias("main")).where("labels > 1").drop("labels")
    apart = saved(named.join(several, "value").select("value", "node", "n", "label", "main"))

    sets = shingle_sets(rows, wanted.join(apart.select("node").distinct(), "node", "left_semi"), words)
    able = saved(apart.join(shareable(sets, classes), "node").where(F.col("others") * 100 >= F.col("n") * percent))
    longest = F.col("others") * (100 + percent) - F.col("n") * percent  # a partner's size times ``percent`` is at most that
    lanes = able.groupBy("value").agg(F.ceil(F.count_if(F.col("label") != F.col("main")) / F.lit(lane_rows)).cast("int").alias("lanes"), F.min("n").alias("least"), F.count("*").alias("able"))
    able = able.join(lanes.where("lanes > 0 and able > 1").drop("able"), "value").where(F.col("least") * percent <= longest)
    left = able.where("label <> main").withColumn("lane", F.pmod(F.xxhash64("node"), F.col("lanes")).cast("int")).alias("l")
    right = able.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).alias("r")
    met = (F.col("l.value") == F.col("r.value")) & (F.col("l.lane") == F.col("r.lane")) & ((F.col("r.label") == F.col("l.main")) | (F.col("l.label") < F.col("r.label")))
    size = (F.col("l.n") + F.col("r.n")) * percent
    cheap = (F.least("l.others", "r.others") * (100 + percent) >= size) & _sizes_fit(F.col("l.n"), F.col("r.n"), percent)
    bound = F.aggregate(F.zip_with("l.counts", "r.counts", lambda x, y: F.least(x, y)), F.lit(0), lambda t, n: t + n)
    pairs = left.join(right, met & cheap & (bound * (100 + percent) >= size))
    return saved(pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct())


def likely(pairs: DataFrame, nodes: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """The pairs whose union sketch holds enough values of both."""
    sketch = nodes.select("node", "sketch")
    both = pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    union = F.slice(F.sort_array(F.array_union("x", "y")), 1, k)
    found = F.size(F.array_intersect(union, F.array_intersect("x", "y")))
    enough = F.when(F.size(union) < k, found * 100 >= F.size(union) * percent).otherwise(found >= least)
    return saved(both.where(enough).select("a", "b"))


def confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets have the similarity."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = shingle_sets(rows, nodes.join(ends, "node", "left_semi"), words)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return stored(both.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).select("a", "b"))


def components(docs: DataFrame, *, words: int = 5, percent: int = 85, k: int = 64, miss: float = 1e-9) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Rows are linked if the sets of their distinct word shingles have a Jaccard similarity of ``percent`` or more; a text of fewer words
    is one shingle. ``component_id`` is the smallest doc_id that can be reached over links, ``kept`` tells whether it is the row's own. A
    link with exactly the wanted similarity is missed in the search with at most the chance ``miss``; those found are exact, up to equal
    64-bit hashes of different shingles. At ``k`` 64 and 85 percent a link shares 34 values, and a sketch enters its rarest 31 into lists.

    A null, empty or blank text has no shingles and is linked with nothing. Rows with a null doc_id are linked like any other but name a
    component (by null) only if no other row is in it. Rows that share a doc_id stay separate rows. An empty table gives no rows. Other columns are not read.
    """
    least = needed(k, percent, miss)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("digest", F.xxhash64("text"))
    prints = saved(sketches(rows, words, k))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first")
    distinct = prints.where("n > 0").groupBy("h1", "h2", "n").agg(first, F.min("sketch").alias("sketch"))
    nodes = stored(distinct.withColumn("node", F.monotonically_increasing_id()))
    wanted = nodes.select("node", "first")

    lists = postings(nodes.select("node", "n", "sketch"), k, percent, least)
    ends = saved(nodes.select("node", "sketch").join(lists.select("node").distinct(), "node", "left_semi"))
    links = confirmed(likely(star(lists, percent), ends, k, percent, least), wanted, rows, words, percent)
    labels = connected_components(links)
    more = confirmed(likely(across(lists, labels, wanted, rows, words, percent), ends, k, percent, least), wanted, rows, words, percent)
    if not more.isEmpty():
        labels = connected_components(links.union(more))

    least_rows = labels.join(wanted, "node").groupBy("label").agg(F.min("first").alias("least"))
    reached = labels.join(least_rows, "label").select("node", "least")
    every = nodes.select("h1", "h2", "node", "first").join(reached, "node", "left").select("h1", "h2", F.coalesce("least", "first")["doc_id"].alias("component"))
    found = prints.select("doc_id", "n", "h1", "h2").join(every, ["h1", "h2"], "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

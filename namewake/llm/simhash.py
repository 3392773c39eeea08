"""SimHash near-duplicates: pigeonhole blocks for candidates, Hamming distance for links.

A fingerprint is cut into blocks. Two fingerprints that differ in at most ``max_bits`` bits agree on at least
``blocks - max_bits`` whole blocks, so with ``blocks >= max_bits + agree`` they share the value of some ``agree``
blocks. A row for each choice of ``agree`` blocks makes that an equality join on keys long enough to be selective.

Copies cost nothing: only distinct fingerprints are blocked. Within a block the members are first compared
with one pivot (the one whose blocks are largest), which ties a crowd of near copies together by as many rows as it has
members; then the members outside a block's main component are compared with the rest. Blocks of more than
``hot_block`` members take a linear path instead: two fingerprints are within four bits exactly if some value
is within two bits of both, so each member is joined on the values around it.

Similar texts may differ in any number of SimHash bits. Where a Jaccard similarity is asked for, ``bands`` searches by
MinHash instead: a permutation's least shingle is the same in two texts with the probability of their similarity, however
short they are, so the chance that some band agrees whole is known for each similarity. The lanes are then one bit of each minimum.
``more_bands`` keeps SimHash and adds such bands to its blocks as further candidates; fingerprints and their Hamming distance then decide what is compared exactly.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hamming, map_arrow, saved
from .components import connected_components


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of every word shingle, repeats included; a text of fewer words is one shingle, none gives none."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not found:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    if len(found) <= words:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = ends - np.fromiter(map(len, found), np.int64, len(found)) - 1
    spans = zip(starts[: len(found) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)
    return [digest(joined[a:b], seed) for a, b in spans]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; as a signed 64-bit integer. No hashes: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 1 << 15):
        part = values[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, words: int = 4, lanes: int = 1, seed: int = 42) -> DataFrame:
    """(doc_id, digest, f0, f1 ...): ``lanes`` fingerprints of each text of (doc_id, text, digest), lane i hashed with ``seed + i``."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            columns = [pa.array([fingerprint(shingle_hashes(t, words, seed + i)) for t in texts], pa.int64()) for i in range(lanes)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "digest", *_lanes(lanes)])

        return each

    return map_arrow(docs.select("doc_id", "text", "digest"), make, "doc_id long, digest long, " + ", ".join(f"{f} long" for f in _lanes(lanes)))


def minima(hashes: list[int] | np.ndarray, n: int, seed: int) -> np.ndarray:
    """The least of the hashes under each of ``n`` permutations; no hashes: the largest number each time."""
    rng = np.random.default_rng(seed)
    factors, shifts = rng.integers(0, 1 << 64, (2, n), np.uint64)
    least, values = np.full(n, (1 << 64) - 1, np.uint64), np.array(hashes, dtype=np.uint64)
    factors |= np.uint64(1)
    for at in range(0, len(values), 2048):
        part = values[at : at + 2048, None] * factors
        part += shifts
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, *, words: int, lanes: int, bands: int, seed: int = 42) -> DataFrame:
    """(doc_id, digest, f0, f1 ..., keys): one bit of each of 64 minima a lane, and a key for each of ``bands`` runs of them."""
    n = 64 * lanes
    rows = n // bands

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits, keys = [], []
            for text in batch.column(1).to_pylist():
                least = minima(shingle_hashes(text, words, seed), n, seed)
                bits.append(np.packbits(((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.uint8), bitorder="little").view("<i8"))
                keys.append([xxhash.xxh64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)])
            columns = [pa.array([int(b[i]) for b in bits], pa.int64()) for i in range(lanes)]
            keys = pa.array(np.array(keys, np.uint64).view(np.int64).tolist(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, keys], names=["doc_id", "digest", *_lanes(lanes), "keys"])

        return each

    return map_arrow(docs.select("doc_id", "text", "digest"), make, "doc_id long, digest long, " + ", ".join(f"{f} long" for f in _lanes(lanes)) + ", keys array<long>")


def mixed(values: np.ndarray, lane: int) -> np.ndarray:
    """Other 64-bit hashes for each lane; those of lane 0 are the values."""
    if not lane:
        return values
    z = values + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints_and_bands(docs: DataFrame, *, words: int, lanes: int, bands: int, rows: int = 7, seed: int = 42) -> DataFrame:
    """(doc_id, digest, f0, f1 ..., sketch, keys): fingerprints of each text's different shingles, a hash of all its minima, and a key for each of ``bands`` runs of ``rows`` minima.

    As similarity is that of sets, repeats don't count here: a line repeated a thousand times would else be all that a fingerprint shows.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints, whole, keys = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = np.unique(np.array(shingle_hashes(text, words, seed), np.uint64))
                prints.append([fingerprint(mixed(hashes, lane)) for lane in range(lanes)])
                least = minima(hashes, bands * rows, seed)
                whole.append(xxhash.xxh64_intdigest(least.tobytes()))
                keys.append([xxhash.xxh64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)])
            columns = [pa.array([p[i] for p in prints], pa.int64()) for i in range(lanes)]
            keys = pa.array(np.array(keys, np.uint64).reshape(-1, bands).view(np.int64).tolist(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, pa.array(np.array(whole, np.uint64).view(np.int64)), keys], names=["doc_id", "digest", *_lanes(lanes), "sketch", "keys"])

        return each

    return map_arrow(docs.select("doc_id", "text", "digest"), make, "doc_id long, digest long, " + ", ".join(f"{f} long" for f in _lanes(lanes)) + ", sketch long, keys array<long>")


def block_keys(lanes: int, blocks: int, agree: int) -> Column:
    """An array of longs, one for each choice of ``agree`` blocks: its number and the bits of the blocks."""
    each = blocks // lanes
    edges = [round(64 * i / each) for i in range(each + 1)]
    parts = [(lane, lo, hi - lo) for lane in range(lanes) for lo, hi in zip(edges, edges[1:], strict=False)]
    if agree * max(width for *_, width in parts) > 48:
        raise ValueError("a block key must fit into 48 bits")
    keys = []
    for number, choice in enumerate(combinations(parts, agree)):
        key = F.lit(number).cast("long")
        for lane, low, width in choice:
            bits = F.shiftrightunsigned(F.col(f"f{lane}"), low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def hot_links(hot: DataFrame, lanes: int, max_bits: int) -> DataFrame:
    """Links among the members of very large blocks, through the values within max_bits / 2 bits of each.

    A value has at most a few thousand neighbours, so what meets at one value is bounded.
    """
    masks = [0]
    for n in range(1, (max_bits + 1) // 2 + 1):
        masks += [sum(1 << i for i in c) for c in combinations(range(64), n)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    ball = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    around = hot.select("node", "f0", ball.alias("mask")).select("node", F.col("f0").bitwiseXOR(F.col("mask")).alias("value"))
    met = around.groupBy("value").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where(F.size("all") > 1)
    return met.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def _busy(keyed: DataFrame) -> DataFrame:
    """(node, key, size): the rows of blocks with more than one member. Sizes are counted before anything meets in one task."""
    sizes = saved(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    return saved(keyed.join(sizes, "key").select("node", "key", "size"))


def _star(grouped: DataFrame, nodes: DataFrame, lanes: int, max_bits: int) -> DataFrame:
    """(a, b): each member of a block with the block's most central member, where they are close enough.

    The most central is the one whose blocks are largest: an original is in more of its copies' blocks than any of the copies.
    """
    weights = grouped.groupBy("node").agg(F.sum("size").alias("weight"))
    members = saved(grouped.join(weights.join(nodes, "node"), "node").select("key", "node", "weight", *_lanes(lanes)))
    pivots = saved(members.groupBy("key").agg(F.max(F.struct("weight", "node", *_lanes(lanes))).alias("best")))
    star = members.alias("star").join(pivots, "key").where("star.node <> best.node")
    return star.where(hamming("star", "best", lanes) <= max_bits).select(F.col("best.node").alias("a"), F.col("star.node").alias("b")).distinct()


def _apart(grouped: DataFrame, nodes: DataFrame, labels: DataFrame, lanes: int) -> DataFrame:
    """Members, with their labels, of the blocks that still hold several, and each such block's ``main`` label: the one with most members in all blocks."""
    named = saved(grouped.where("size > 2").join(nodes, "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))  # of a block of two the only pair is the pivot's
    most = named.groupBy("label").agg(F.count("*").alias("n"))
    blocks = named.groupBy("key", "label").agg(F.count("*").alias("n")).drop("n").join(most, "label")
    several = saved(blocks.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("most")).where("labels > 1").select("key", F.col("most.label").alias("main")))
    return saved(named.join(several, "key").select("key", "node", "size", "label", "main", *_lanes(lanes)))


def _across(members: DataFrame, lanes: int, max_bits: int, also: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(a, b): the close members of one block with different labels. Members of a block's main label are not compared with each other."""
    columns = ["key", "node", "label", *_lanes(lanes), *extra]
    left, right = members.where("label <> main").select("main", *columns).alias("l"), members.select(*columns).alias("r")
    met = (F.col("l.key") == F.col("r.key")) & ((F.col("r.label") == F.col("l.main")) | (F.col("l.label") < F.col("r.label"))) & (hamming("l", "r", lanes) <= max_bits)
    pairs = left.join(right, met if also is None else met & also)
    return pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _lanes(lanes: int) -> list[str]:
    return [f"f{i}" for i in range(lanes)]


def components(
    docs: DataFrame, *, words: int = 4, max_bits: int = 4, blocks: int = 7, agree: int = 3, lanes: int = 1, seed: int = 42, min_jaccard: float | None = None, hot_block: int | None = None, bands: int | None = None, more_bands: int | None = None
) -> DataFrame:
    """(doc_id, f0 ..., component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id among the rows that can be reached over links. With
    ``min_jaccard`` a link must also have that Jaccard similarity of its word shingles; the blocks are then a
    search with a recall below 1, since similar texts may differ in any number of bits. Without it the links are
    exactly those of at most ``max_bits`` bits. With ``bands`` as well the search is by MinHash, of ``64 * lanes // bands``
    minima a band (``blocks`` and ``agree`` are not used); with ``more_bands`` it is by the blocks and as many bands of seven minima, and the
    fingerprints are those of sets. Blocks of more than ``hot_block`` members (16384, or 64 for
    similarities) are searched by another path, with the same links.

    A null, empty or blank text has fingerprint 0 and is linked like any other. Rows with a null doc_id get a
    fingerprint and never name a component (null only if no other row is in it). Rows with the same doc_id stay
    separate rows. An empty table gives no rows. Columns besides doc_id and text are not read.
    """
    found = _grouped(docs, words, max_bits, blocks, agree, lanes, seed, min_jaccard, hot_block, bands, more_bands)
    return found.select("doc_id", *_lanes(lanes), F.col("component.doc_id").alias("component_id"))


def _grouped(docs: DataFrame, words: int, max_bits: int, blocks: int, agree: int, lanes: int, seed: int, min_jaccard: float | None, hot_block: int | None, bands: int | None, more_bands: int | None) -> DataFrame:
    """(doc_id, digest, f0 ..., component): a row of ``docs`` is known by its doc_id and its text's digest; ``component`` is the least such pair, null ids last."""
    if (bands is not None or more_bands is not None) and min_jaccard is None:
        raise ValueError("bands are a search for a Jaccard similarity")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("digest", F.xxhash64("text"))
    if more_bands is not None:
        prints = saved(fingerprints_and_bands(rows, words=words, lanes=lanes, bands=more_bands, seed=seed)).withColumn("node", F.xxhash64(*_lanes(lanes), "sketch"))
    else:
        prints = saved(fingerprints(rows, words=words, lanes=lanes, seed=seed) if bands is None else sketches(rows, words=words, lanes=lanes, bands=bands, seed=seed))
        prints = prints.withColumn("node", F.col("f0") if lanes == 1 else F.xxhash64(*_lanes(lanes)))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    least_keys = [] if bands is None and more_bands is None else [F.min("keys").alias("keys")]
    distinct = saved(prints.groupBy("node", *_lanes(lanes)).agg(F.min(row).alias("first"), *least_keys))
    nodes = distinct.select("node", *_lanes(lanes))
    keys = F.col("keys") if bands is not None else block_keys(lanes, blocks, agree)
    keys = keys if more_bands is None else F.concat(keys, "keys")
    grouped = _busy(distinct.select("node", F.explode(keys).alias("key")))
    sets = None if min_jaccard is None else shingle_sets(rows, distinct.join(grouped.select("node").distinct(), "node", "left_semi"), words)

    first = _similar(saved(_star(grouped, nodes, lanes, max_bits)), sets, min_jaccard)
    labels = connected_components(first)
    members = _apart(grouped, nodes, labels, lanes)
    hot = F.col("size") > (hot_block or (16384 if min_jaccard is None else 64))
    second = _across(members.where(~hot), lanes, max_bits)
    if min_jaccard is not None:
        second = second.union(_crowd_links(members.where(hot), sets, lanes, max_bits, min_jaccard))
    elif lanes == 1:
        second = second.union(hot_links(members.where(hot).select("node", "f0").distinct(), lanes, max_bits))
    else:
        second = second.union(_across(members.where(hot), lanes, max_bits))
    second = _similar(saved(second.distinct()), sets, min_jaccard)
    labels = connected_components(first.union(second)) if not second.isEmpty() else labels

    least = labels.join(distinct.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("component"))
    reached = labels.join(least, "label").select("node", "component")
    every = distinct.select("node", "first").join(reached, "node", "left").select("node", F.coalesce("component", "first").alias("component"))
    return prints.join(every, "node").select("doc_id", "digest", *_lanes(lanes), "component")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of its smallest doc_id, and of its smallest digest where texts share one.

    A row with a null doc_id stays only if its component has no other row that is named. Texts that are no near-duplicates
    all stay, though they share a doc_id. Of wholly repeated rows one stays. An empty table gives no rows. Options: see ``components``.
    """
    options = {"words": 4, "max_bits": 4, "blocks": 7, "agree": 3, "lanes": 1, "seed": 42, "min_jaccard": None, "hot_block": None, "bands": None, "more_bands": None} | options
    first = saved(_grouped(docs, **options).where("doc_id <=> component.doc_id and digest = component.digest").select("doc_id", "digest"))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("first.doc_id")) & (F.xxhash64(F.col("doc.text").cast("string")) == F.col("first.digest"))
    kept = docs.alias("doc").join(first.distinct().alias("first"), same, "left_semi")
    return kept if first.groupBy("doc_id", "digest").count().where("count > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def shingle_sets(rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of the first document of each of the ``nodes``."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.unique(np.array(shingle_hashes(t, words, 0), np.uint64)).view(np.int64) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

        return each

    wanted = nodes.select("node", F.col("first.doc_id").alias("id"), F.col("first.digest").alias("of"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")))
    return saved(map_arrow(texts.select("node", "text"), make, "node long, shingles array<long>").dropDuplicates(["node"]))


def _similar(pairs: DataFrame, sets: DataFrame | None, least: float | None) -> DataFrame:
    """The pairs of nodes whose shingle sets have that Jaccard similarity."""
    if least is None:
        return pairs
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return saved(both.where(shared >= least * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def _crowd_links(members: DataFrame, sets: DataFrame, lanes: int, max_bits: int, least: float, classes: int = 32) -> DataFrame:
    """Candidate pairs of different labels in very large blocks, without those that can't be similar.

    Only shingles of several nodes can be shared by such a pair. Each node's are counted in ``classes`` by hash; the
    sum of the lesser counts is no less than what two nodes share, so a pair whose sum is too small is no link. In a crowd
    of copies that differ from their original in places of their own this leaves few pairs but links.
    """
    crowd = saved(members.select("node").distinct().join(sets, "node"))

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(1)
        return np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()

    def combined():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, values = flat(batch)
            values, first, times = np.unique(values, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(nodes[first]), pa.array(times)], names=["shingle", "node", "nodes"])

        return each

    def counted():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = [np.bincount(np.asarray(values.values) % classes, minlength=classes) for values in batch.column(1)]
            counts = pa.array(np.array(lists, np.int32).reshape(-1, classes).tolist(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).value_lengths(), counts], names=["node", "n", "counts"])

        return each

    once = map_arrow(crowd, combined, "shingle long, node long, nodes long").groupBy("shingle").agg(F.sum("nodes").alias("nodes"), F.min("node").alias("node")).where("nodes = 1")
    place = F.pmod(F.col("shingle"), F.lit(classes))
    own = once.groupBy("node").agg(F.array(*[F.count_if(place == i).cast("int") for i in range(classes)]).alias("own"))
    every = map_arrow(crowd, counted, "node long, n int, counts array<int>").join(own, "node", "left")
    shared = F.when(F.col("own").isNull(), F.col("counts")).otherwise(F.zip_with("counts", "own", lambda x, y: x - y))
    every = every.select("node", "n", shared.alias("counts"))
    able = saved(every.where(F.aggregate("counts", F.lit(0), lambda t, x: t + x) >= F.lit(least) * F.col("n")))
    bound = F.aggregate(F.zip_with("l.counts", "r.counts", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    also = bound * (1 + least) >= least * (F.col("l.n") + F.col("r.n"))
    return _across(members.join(able, "node"), lanes, max_bits, also, ("n", "counts"))

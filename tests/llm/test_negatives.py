"""Hard negatives against brute force, with ties, negative scores and the defined odd cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewake.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score long, slot long, rows long"


def brute(rows, positives=5, k=5, low=80, high=100):
    """rows: (vec_id, label, vector of integers)."""
    found = []
    for a, of, q in rows:
        if a % 100:
            continue
        other = sorted(((-int(np.dot(q, v)), i, label) for i, label, v in rows if i != a))
        for s, p, _ in [x for x in other if x[2] == of][:positives]:
            window = [x for x in other if x[2] != of and low * -s <= 100 * -x[0] <= high * -s][:k]
            found += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(window, 1)]
    return sorted(found)


def frame(spark, rows):
    return spark.createDataFrame([(i, label, None if v is None else [x / 256 if x is not None else None for x in v], 1, 2, 3) for i, label, v in rows], SCHEMA)


@pytest.mark.parametrize(("values", "labels", "shard"), [((-3, 4), 3, 64), ((0, 2), 2, 16), ((-40, -20), 4, 4096)])
def test_brute_force_with_ties(spark, values, labels, shard):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(labels)), rng.integers(*values, 6).tolist()) for i in range(700)]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, shard_rows=shard, block_anchors=3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert dict(got.dtypes)["rank"] == "int"


def test_another_upper_limit_and_k(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(3)), rng.integers(-2, 9, 5).tolist()) for i in range(400)]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, positives=3, k=2, low=50, high=95)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 2, 50, 95)


def test_odd_rows(spark):
    rows = [(0, 1, [4, 0]), (1, 1, [4, 0]), (2, 2, [4, 0]), (3, 2, [3, 9]), (4, 2, [4, -1])]
    odd = [(5, None, [4, 0]), (6, 2, None), (7, 2, [4, None]), (8, 2, [4, float("inf")]), (9, 2, [float("nan"), 0]), (10, 2, []), (11, 2, [4, 0, 0]), (None, 2, [4, 0]), (100, 1, [4, 0, 0]), (0, 2, [4, 0])]
    got = negatives.mine(frame(spark, rows + odd), F.col("vec_id") % 100 == 0)
    # the row with the anchor's id is its own; the smallest (width, label, vector) asks; the anchor of length 3 has no positive
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 2, 16, 16), (0, 1, 2, 4, 16, 16)]


def test_empty_and_without_anchors(spark):
    assert negatives.mine(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(frame(spark, [(1, 1, [1]), (2, 2, [1])]), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(frame(spark, [(100, 1, [1]), (2, 2, [1])]), F.col("vec_id") % 100 == 0).count() == 0


def test_slots_are_the_last_limits_not_below():
    limits = np.array([90, 50, 20])
    assert negatives.slot_of(np.array([90, 89, 51, 50, 21, 20, 3]), limits).tolist() == [0, 0, 0, 1, 1, 2, 2]


def test_shards_meet_blocks_without_a_shuffle(spark, monkeypatch):
    plans, kept = [], negatives.saved

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(negatives, "saved", watched)
    rows = [(i, i % 3, [i % 7 - 3, i % 5 - 2, i % 11 - 4]) for i in range(400)]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, shard_rows=16, block_anchors=2)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    scan = "Scan ExistingRDD"  # a plan is printed from its end: what the scoring steps read, up to their second table
    read = [scan.join(x.split(scan)[:2]) for p in plans for x in p.split("MapInArrow")[1:] if x.count(scan) >= 2]
    assert len(read) == 2 and all("CartesianProduct" in x for x in read) and not any("Exchange" in x or "Broadcast" in x for x in read)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_anchors_in_several_parts_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "HELD", 160)
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(3)), rng.integers(-9, 9, 4).tolist()) for i in range(900)]
    got = negatives.mine(frame(spark, rows).repartition(5), F.col("vec_id") % 100 == 0, shard_rows=32, block_anchors=2)
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("power", [12, 25])
def test_products_beyond_the_exact_floats(spark, power):
    rng = np.random.default_rng(10)
    rows = [(i, int(rng.integers(3)), (rng.integers(-4, 5, 6) * 2**power + (i % 3 if power < 20 else 0)).tolist()) for i in range(300)]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, shard_rows=64)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_narrow_keeps_the_numbers():
    for top, kind in ((2**15 - 1, np.int16), (2**15, np.int32), (-(2**31), np.int32), (2**31, np.int64)):
        found = negatives.narrow(np.array([top, 0]))
        assert found.dtype == kind and found.tolist() == [top, 0]

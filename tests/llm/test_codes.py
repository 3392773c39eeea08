"""Product codes against comparing all parts with all entries, on clustered, tied and odd vectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from namewake.llm import codes

SCHEMA = "vec_id long, label string, embedding array<double>, code long, error string, of string"


def nearest(points, entries):
    return ((points[:, None, :] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)  # the first of the least


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, label, vector of integers) of one length, in the order of their ids."""
    values = np.array([v for *_, v in rows], np.int64).reshape(len(rows), parts, -1)
    books = [values[:entries, p].copy() for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            of = nearest(values[:, p], books[p])
            for e in set(of.tolist()):
                books[p][e] = np.floor_divide(values[of == e, p].sum(axis=0), (of == e).sum())
    of = [nearest(values[:, p], books[p]) for p in range(parts)]
    error = sum(((values[:, p] - books[p][of[p]]) ** 2).sum(axis=1) for p in range(parts))
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    total = {}
    for (_, label, _), e in zip(rows, error.tolist(), strict=True):
        total[label] = total.get(label, 0) + e
    return [(i, label, "".join(f"{of[p][n]:02x}" for p in range(parts)), int(error[n]), total[label], sha) for n, (i, label, _) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, label, None if v is None else [None if x is None else x / 256 for x in v], 1, "x", "y") for i, label, v in rows], SCHEMA)


def result(df):
    assert df.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("low", "high", "shard", "options"), [(-300, 300, 4096, {}), (0, 3, 64, {"broadcast_bytes": 0, "broadcast_labels": 0}), (-2, 2, 200, {"leaf": 1})])
def test_brute_force(spark, low, high, shard, options):
    rng = np.random.default_rng(3)
    rows = [(i, [None, "a", "b"][i % 3], rng.integers(low, high, 32).tolist()) for i in range(900)]
    assert result(codes.compress(frame(spark, rows[::-1]), shard_rows=shard, **options)) == sorted(brute(rows), key=str)


def test_fewer_rows_than_entries_and_other_sizes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "a", rng.integers(-9, 9, 12).tolist()) for i in range(20)]
    assert result(codes.compress(frame(spark, rows), parts=4, rounds=3)) == sorted(brute(rows, 4, 64, 3), key=str)
    assert result(codes.compress(frame(spark, rows), parts=4, entries=3, rounds=1, leaf=2)) == sorted(brute(rows, 4, 3, 1), key=str)


def test_odd_rows(spark):
    good = [(1, "a", [1, 2, 3, 4]), (1, "a", [1, 2, 3, 4]), (2, None, [5, 5, -5, 1 << 40]), (None, None, [5, 5, 5, 5])]
    held = [(i, label, [min(x, 1 << 27) for x in v]) for i, label, v in good]
    bad = [(3, "a", None), (4, "a", []), (5, "a", [1, None, 3, 4]), (6, "a", [1, math.inf, 3, 4]), (7, "a", [math.nan, 2, 3, 4]), (8, "a", [1, 2, 3])]
    assert result(codes.compress(frame(spark, good + bad), parts=2)) == sorted(brute(held, 2), key=str)
    longer = [(9, "b", [1, 2, 3, 4, 5, 6])]  # codebooks of its own
    assert result(codes.compress(frame(spark, good + longer), parts=2)) == sorted(brute(held, 2) + brute(longer, 2), key=str)
    assert codes.compress(frame(spark, [])).count() == 0


def test_trees_assign_whole_nodes_and_agree():
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (20, 4))
    points = centres[rng.integers(20, size=4000)] + rng.integers(-9, 9, (4000, 4))
    entries = np.vstack([centres, centres[:5], rng.integers(-1000, 1000, (30, 4))])  # repeated entries lose to the first
    tree = codes.Tree(points[(order := codes.tree_order(points, 8))], 8)
    whole, places, chosen = codes.assign(tree, entries)
    got = np.full(len(points), -1)
    for starts, ends, numbers in whole:
        for a, b, e in zip(starts, ends, numbers, strict=True):
            assert (got[a:b] == -1).all()
            got[a:b] = e
            assert (tree.sums[b] - tree.sums[a] == tree.points[a:b].sum(axis=0)).all()
    assert (got[places] == -1).all()
    got[places] = chosen
    assert (got == nearest(points[order], entries)).all()
    assert len(places) < len(points) / 2  # most nodes are settled by their boxes

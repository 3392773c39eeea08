"""What SQL can't express, against plain Python."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import functions as F

from namewake.operators import names, themes
from namewake.operators.ranking import global_rank


def test_mincost_segmentation(spark):
    rng, words = random.Random(1), ["red", "bolt", "redb", "olt", "a", "ring", "ringa", "gear", "ge", "ar"]
    labels = ["".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(80)] + ["zzz", "bolt1", "b", ""]

    def cost(label):
        best = [0] + [math.inf] * len(label)
        for i in range(1, len(label) + 1):
            for w in words:
                if label[:i].endswith(w):
                    best[i] = min(best[i], best[i - len(w)] + 2 + (len(w) < 4))
        return best[-1]

    frame = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {r.label: r for r in themes.segment_mincost(frame, spark.createDataFrame([(w,) for w in words], "entry string")).collect()}
    assert set(got) == {x for x in labels if x and cost(x) < math.inf}
    for label, row in got.items():
        assert row.cost == cost(label) and "".join(row.pieces) == label
        assert sum(2 + (len(p) < 4) for p in row.pieces) == row.cost


def test_greedy_segmentation_and_coined_terms(spark):
    frame = spark.createDataFrame([("redzzbolt",), ("qq-red",), ("redbo",), ("x",)], "label string")
    cut = names.segment_greedy(frame, spark.createDataFrame([("red",), ("bolt",)], "entry string"))
    assert {r.label: r.pieces for r in cut.collect()} == {"redzzbolt": ["?", "bolt"], "qq-red": ["?", "red"], "redbo": ["?"], "x": ["?"]}
    terms = {(r.label, r.term) for r in themes.coined_terms(cut).collect()}
    assert ("redzzbolt", "redzz") in terms and ("qq-red", "qq-") in terms


def test_keyword_clusters(spark):
    use = {"a": [1, 2, 3], "b": [1, 2, 3], "c": [2, 3, 4], "d": [9], "e": [9], "f": [20, 21], "g": [20, 21]}
    rows = [(t, op) for t, ops in use.items() for op in ops]
    got = sorted((r.cluster, r.term) for r in themes.keyword_clusters(spark.createDataFrame(rows, "term string, op long")).collect())
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("f", "f"), ("f", "g")]


def test_keyword_lists(spark):
    rows = [("x1", 9, 5, 2, 2.0), ("x2", 8, 5, 2, None), ("1digit", 2, 1, 1, 3.0), ("rare", 2, 1, 3, 1.0)]
    metrics = spark.createDataFrame(rows, "term string, ops long, days long, zones long, rise double")
    got = {(r["list"], r.term, r.place) for r in themes.keyword_lists(metrics, 10, top=2).collect()}
    assert {("biggest", "x1", 1), ("biggest", "x2", 2), ("trending", "x1", 1), ("trending", "1digit", 2), ("emerging", "rare", 1)} == got


def test_global_rank(spark):
    values = [(i, (i * 7919) % 101) for i in range(1000)]
    frame = spark.createDataFrame(values, "id long, v long").repartition(7)
    got = {r.id: r.place for r in global_rank(frame, [F.desc("v"), F.asc("id")], "place").collect()}
    wanted = sorted(values, key=lambda x: (-x[1], x[0]))
    assert [got[i] for i, _ in wanted] == list(range(1, 1001))


def test_operators_join_over_keys(spark):
    rows = [(1, "a", None), (2, "a", "p"), (3, "b", "p"), (4, None, None), (5, "c", "q"), (6, "c", None)]
    frame = spark.createDataFrame(rows, "site long, t string, s string")
    got = {r.site: r.operator for r in names.resolve_operators(frame, "site", {"t": F.col("t"), "s": F.col("s")}).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_fragments_brute_force(spark):
    labels = ["boltring", "boltgear", "oldbolt", "redbolts", "ringtone", "xx"]
    found = {}
    for label in labels:
        for i, j in itertools.combinations(range(len(label) + 1), 2):
            if 4 <= j - i <= 12:
                found.setdefault(label[i:j], set()).add(label)
    support = {f: len(s) for f, s in found.items() if len(s) >= 2}
    wanted = {(f, n) for f, n in support.items() if not any(len(g) == len(f) + 1 and f in g and m >= 0.7 * n for g, m in support.items())}
    got = {(r.fragment, r.support) for r in names.mine_fragments(spark.createDataFrame([(x,) for x in labels], "label string"), least=2).collect()}
    assert got == wanted

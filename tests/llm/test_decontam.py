"""The latent basis of the leak search: its sums are made in Spark, the driver gets them in small rows."""

from __future__ import annotations

import numpy as np

from namewake.llm import decontam


def test_products_reach_the_driver_once_and_in_small_rows(spark, monkeypatch):
    """However many partitions there are, the driver gets each block of terms once."""
    rng = np.random.default_rng(3)
    terms, width = 1000, 40
    sparse = [(np.sort(rng.choice(terms - 100, 30, replace=False)).tolist(), rng.random(30).tolist()) for _ in range(200)]
    dense = np.zeros((len(sparse), terms))
    for row, (at, weights) in zip(dense, sparse, strict=True):
        row[at] = weights
    rows = spark.createDataFrame(sparse, "terms array<int>, weights array<double>").repartition(7)
    basis = rng.normal(size=(terms, width))
    seen, kept = [], type(rows).toLocalIterator

    def watched(self, *args, **options):
        for r in kept(self, *args, **options):
            seen.append(sum(len(x) for x in r if isinstance(x, (bytes, bytearray))))
            yield r

    monkeypatch.setattr(type(rows), "toLocalIterator", watched)
    assert np.allclose(decontam.gram_product(rows, basis), dense.T @ (dense @ basis))
    assert max(seen) <= 64 * width * 8 and sum(seen) <= terms * width * 8


def test_products_of_no_rows_and_of_few_terms(spark):
    rows = spark.createDataFrame([], "terms array<int>, weights array<double>")
    assert not decontam.gram_product(rows, np.ones((5, 3))).any()
    one = spark.createDataFrame([([1, 2], [0.5, 2.0])], "terms array<int>, weights array<double>")
    assert decontam.gram_product(one, np.ones((3, 2))).tolist() == [[0, 0], [1.25, 1.25], [5, 5]]


def test_a_projected_finder_carries_no_basis(spark):
    """What is sent to each task holds the scaled rows, not the basis beside them."""
    item = type("Item", (), {"item_id": 1, "text": "one two three four five six seven eight", "answer": "eight"})
    words = item.text.split()
    space = decontam.Space({w: i for i, w in enumerate(words)}, np.ones(8), np.eye(8))
    finder = decontam.Finder([item], space, 0.5, 0.65, 0.5, 8)
    finder.project()
    assert not finder.space.basis.size and finder.find(item.text)[1][:2] == (1.0, 1.0)

"""The pipeline's near-duplicates: SimHash's blocks and distance take part, for sets."""

from __future__ import annotations

import random

import corpus_pipeline
from namewake.llm import simhash


def test_the_stage_searches_by_simhash(spark, sf, monkeypatch):
    """Without any band in common, what is close in the fingerprints is found by their blocks."""
    rng = random.Random(4)
    text = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    near = [*text[:-1], "other"]
    far = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    table = spark.createDataFrame(list(enumerate(" ".join(t) for t in (text, near, far))), "doc_id long, text string")
    by_blocks = lambda docs, **options: simhash.components(docs, **options | {"more_bands": 1})
    monkeypatch.setattr(simhash, "minima", lambda hashes, n, seed: simhash.np.full(n, len(hashes) + int(hashes[0] % 1000), "u8") + simhash.np.uint64(hashes.sum() % 10**9))
    monkeypatch.setattr(simhash, "one_of_each", by_blocks)
    found = {r.doc_id: r.component_id for r in corpus_pipeline.near_duplicates(spark, table, sf).collect()}
    assert found == {0: 0, 1: 0, 2: 2}


def test_a_repeated_line_hides_no_text(spark, sf):
    """Texts of one set are one, however often a line is repeated; a common repeated line makes no near-duplicates."""
    rng = random.Random(5)
    line = " ".join(f"line{i}" for i in range(12))
    own = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(3)]
    texts = [f"{line} {line} {own[0]}", " ".join([line] * 800) + f" {own[0]}", " ".join([line] * 800) + f" {own[1]}", " ".join([line] * 800) + f" {own[2]}"]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]

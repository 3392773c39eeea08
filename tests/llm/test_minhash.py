"""Bottom-k near-duplicates against brute force over all pairs, in crowds, at the threshold, and on the defined odd cases."""

from __future__ import annotations

import random
import re

import pandas as pd

from namewake.llm import minhash, queries

SCHEMA = "doc_id long, text string, n_shingles string, component_id long, node long"


def shingles(text, words=5):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)} or ({b" ".join(found)} if found else set())


def brute(docs, percent=85):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    holders: dict[bytes, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for among in holders.values():
        for at, i in enumerate(among):
            for j in among[at + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    shared = len(sets[i] & sets[j])
                    if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                        label[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), c := least.get(root(i)), doc == c) for i, (doc, _) in enumerate(docs)), key=str)


def result(spark, docs, **options):
    got = minhash.components(spark.createDataFrame([(i, t, "x", -1, -2) for i, t in docs], SCHEMA), **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


def edited(rng, words, times, own):
    words = list(words)
    for n in range(times):
        words[rng.randrange(len(words))] = f"{own}x{n}"
    return " ".join(words)


def test_whole_table(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = queries.op13_minhash(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(docs[["doc_id", "text"]].itertuples(index=False, name=None)))


def test_crowds_around_the_threshold(spark):
    rng = random.Random(11)
    docs = []
    for length in (12, 40, 150, 500):  # sets kept whole and sampled ones; up to 12 % of the shingles change
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for c in range(90):
            docs.append((len(docs), edited(rng, base, rng.randrange(0, 2 + length // 40), f"c{c}")))
    for c in range(60):  # chains: copies of copies
        docs.append((len(docs), edited(rng, docs[-1][1].split(), 3, f"d{c}")))
    rng.shuffle(docs)
    assert result(spark, docs) == brute(docs)


def test_common_passages_make_no_links(spark):
    rng = random.Random(12)
    passage = " ".join(f"common{i}" for i in range(60))
    docs = [(i, " ".join(f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 90))) + " " + passage) for i in range(150)]
    docs += [(200 + i, passage) for i in range(40)] + [(300 + i, f"{passage} end{i}") for i in range(40)]
    assert result(spark, docs) == brute(docs)


def test_other_parameters(spark):
    rng = random.Random(13)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, edited(rng, base, rng.randrange(9), f"c{i}")) for i in range(80)]
    assert result(spark, docs, percent=70, k=32) == brute(docs, 70)


def test_odd_rows(spark):
    long = " ".join(f"palabra{i % 9777}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, " \n\t "), (None, None), (None, "alone without a name"), (5, "Same TEXT here"), (4, "same text\there"), (None, "same text here"), (6, "one two three four five six"), (6, "an other text of the same id"), (6, "one two three four five six")]
    docs += [(7, long), (8, long + " more"), (9, "x y   É"), (10, "x y   é")]
    assert result(spark, docs) == brute(docs)
    assert result(spark, []) == []


def test_needed_is_a_binomial_quantile():
    assert minhash.needed(64, 85, 1e-9) == 34
    assert minhash.needed(10, 100, 1e-9) == 10

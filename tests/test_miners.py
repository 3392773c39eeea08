"""Planted cases of themes, types, networks, coined words, the lexicon and the search index."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from namewake.operators import containment, folds, lexicon, miners, names, networks, search_index

WORDS = ["amber", "basil", "cedar", "delta", "ember", "fable", "grove", "haven", "inlet", "jolly", "karma", "lemon", "maple", "noble", "ocean", "pearl", "quilt", "river", "solar", "tiger", "ultra", "vivid", "waltz", "xenon", "yacht", "zebra"]
PLACES = ["denver", "boston", "dallas", "austin", "tucson", "tampa", "miami", "omaha"]


def segments(spark, labels, words):
    return names.segment_greedy(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(w,) for w in words], "entry string"))


def adds(spark, rows):
    return spark.createDataFrame(rows, "label string, zone string")


def converging(spark, now, before):
    rows = lambda labels: adds(spark, [(x, ["com", "io", "ai"][i % 3]) for i, x in enumerate(labels)])
    cut = segments(spark, {*now, *before}, [*WORDS, *PLACES, "agent", "copper", "copperfield"])
    found = miners.converging_themes(rows(now), rows(before), cut, generic=["haven"], cities=PLACES, product_zones=["com", "io", "ai"]).collect()
    return {r.theme: r for r in found}


def test_a_sweep_of_one_actor_raises_no_theme(spark):
    independent = [f"agent{a}" if i % 2 else f"{a}agent" for i, a in enumerate(WORDS)]
    sweep = [f"copper{w}mountaintop" for w in WORDS]
    both = converging(spark, independent + sweep, [f"{a}{b}" for a, b in zip(WORDS, WORDS[1:], strict=False)])
    assert "copper" not in both  # labels with a run of letters that no dictionary has are not covered
    swept = [f"{w}coppergrovelemon" for w in WORDS]
    found = converging(spark, independent + swept, ["amberbasil", "cedardelta"])
    assert found["agent"].kit_share == 0 and "new" in found["agent"].buckets and "rising" in found["agent"].buckets
    assert found["agent"].independent_roots >= 10 and found["agent"].constructions >= 2
    assert "copper" not in found and "grove" not in found  # all members hold the run: none is left


def test_city_grid_is_found(spark):
    labels = [f"{p}roofing" for p in PLACES] + [f"{a}{b}" for a, b in zip(WORDS, WORDS[3:], strict=False)]
    cut = segments(spark, labels, [*WORDS, *PLACES, "roofing"])
    found = {r.kind: r for r in miners.ranked_types(adds(spark, [(x, z) for x in labels for z in ("com", "net", "xyz")]), adds(spark, [("amberbasil", "com")]), cut, cities=PLACES, product_zones=["com", "net"]).collect()}
    assert found["grid:{city}+roofing"].n == 8 and found["suffix:*roofing"].n == 8
    grid = found["grid:{city}+roofing"]
    assert grid.kits == 8 and not grid.junk and grid.acceleration > 8 and grid.zones == 3
    assert grid.score == pytest.approx(found["suffix:*roofing"].score * 1.6)


def test_concentration_names_the_actor(spark):
    labels = [f"agent{w}" for w in WORDS[:4]] + [f"agentmaplelemon{w}" for w in WORDS[4:12]]
    cut = segments(spark, labels, [*WORDS, "agent"])
    found = {r.kind: r for r in miners.ranked_types(adds(spark, [(x, "com") for x in labels]), adds(spark, []), cut, product_zones=["com"]).collect()}
    assert found["prefix:agent*"].concentration == pytest.approx(8 / 12, abs=1e-6)
    assert found["prefix:agent*"].dominant == "aplelem"


def sites(spark, rows):
    schema = "site string, day date, label string, title string, skeleton string, brand array<string>"
    return spark.createDataFrame([(d, dt.date(2024, 1, 1) + dt.timedelta(days=day), d.split(".")[0], title, sk, [d.split(".")[0]]) for d, day, title, sk in rows], schema)


def test_shops_and_kits(spark):
    shops = [(f"{w}beans.com", i % 7, f"{w} coffee roasters", f"sk{i}") for i, w in enumerate(WORDS)]
    kit = [(f"{w}gardenplan.net", 5, "Garden Planner Suite", "kit") for w in WORDS]
    mods = [(f"{w}apk.com", 1 + i // 9, f"Download {w}apk mod v{i} for free today", f"m{i}") for i, w in enumerate(WORDS)]
    gaps = [(f"{w}soft.org", 3 * i, f"Cracked {w}soft keys and serials list for {WORDS[i - 5]}", f"g{i}") for i, w in enumerate(WORDS)]
    series = [("shop1.com", 1, "One", "x"), ("shop2.com", 9, "Two", "y")]
    operators, found = networks.resolve_networks(sites(spark, shops + kit + mods + gaps + series), ["for", "and"])
    by = {r.site: r.operator for r in operators.collect()}
    assert len({by[s[0]] for s in shops}) == len(shops)
    assert len({by[s[0]] for s in kit}) == 1 and len({by[s[0]] for s in mods}) == 1
    assert len({by[s[0]] for s in gaps}) == len(gaps)  # never eight in a run of days
    assert by["shop1.com"] == by["shop2.com"]
    shown = {r.operator: r for r in found.collect()}
    assert set(shown) == {by[kit[0][0]], by[mods[0][0]]} and all(r.spam_kit for r in shown.values())
    assert shown[by[mods[0][0]]].via in ("shingle", "skeleton") and shown[by[mods[0][0]]].sites == len(mods)


def test_containing_equals_a_scan(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 30))) for _ in range(300)] + ["", "abcd"]
    terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    got = containment.containing(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(t,) for t in terms], "w string"), "w")
    assert sorted(map(tuple, got.collect())) == sorted({(t, w) for t in texts for w in terms if len(w) >= 4 and w in t})


def test_lexicon_day_by_day_equals_one_pass(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), dt.date(2024, 1, 25) + dt.timedelta(days=rng.randrange(50)), rng.randrange(1, 9)) for _ in range(300)]
    daily = spark.createDataFrame(rows, "term string, day date, n long").groupBy("term", "day").agg(F.sum("n").alias("n"))
    sizes = daily.groupBy("day").agg(F.sum("n").alias("total"))
    lexicon.fold(spark, f"{tmp_path}/one", daily, sizes)
    for part in range(4):
        lexicon.fold(spark, f"{tmp_path}/many", daily, sizes.where(F.dayofyear("day") % 4 <= part))
    one, many = (sorted(map(tuple, lexicon.lexicon(spark, f"{tmp_path}/{x}").collect())) for x in ("one", "many"))
    assert one == many and len(one) == 3 and all(r[4] is not None for r in one)


def test_inflections():
    forms = search_index.inflections
    assert forms("ai") == ["ai"]
    assert {"computes", "computed", "computing"} <= set(forms("compute")) and "computer" not in forms("compute")
    assert {"agencies"} <= set(forms("agency")) and {"planning", "planned"} <= set(forms("plan")) and "playying" not in forms("play")


def test_search_index(spark, tmp_path):
    docs = [("a", ["compute", "pilot"], [], []), ("b", ["x"], ["computing", "pilots"], []), ("c", ["computer", "pilot"], [], []), ("d", [], [], ["computepilot"]), ("e", ["compute"], ["pilot"], []), ("f", ["pilot", "computed"], ["compute", "pilot"], [])]
    frame = spark.createDataFrame(docs, "doc string, name array<string>, site array<string>, theme array<string>")
    search_index.write_index(frame, "doc", f"{tmp_path}/index")
    facts = spark.createDataFrame([("a", True, True, False), ("b", True, False, False), ("d", False, False, True), ("f", True, True, False)], "doc string, built boolean, alpha boolean, batch boolean")
    found = search_index.search(spark, f"{tmp_path}/index", "Compute pilot", "doc", facts)
    assert {r.doc: (r.match, r.rank) for r in found.collect()} == {"a": ("name", 3), "b": ("site", 1), "d": ("theme", 11), "f": ("name", 0)}
    assert search_index.search(spark, f"{tmp_path}/index", "??", "doc", facts).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") or "bucket" in plan.split("PartitionFilters")[1][:200]


def test_folds_compose(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), i, rng.randrange(3)) for i in range(500)]
    tables = [[1, 2, 0], [0, 0, 2], [2, 1, 1]]
    step = F.element_at(F.array(*[F.array(*[F.lit(x) for x in t]) for t in tables]), F.col("move") + 1)
    got = folds.folded(spark.createDataFrame(rows, "k string, n long, move int"), "k", ["n"], step, 3, stretch=7)
    wanted = {}
    for k, _, move in rows:
        wanted[k] = tables[move][wanted.get(k, 0)]
    assert {r.k: r.state for r in got.collect()} == wanted

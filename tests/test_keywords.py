"""Profiles, stages and lists of keywords, derived rows, probe order, timelines and merges by hand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from namewake.operators import constructions, derived, keywords

USES = "term string, site string, op long, day date, zone string, role string, partner string, described boolean, lang string"


def day(n):
    return dt.date(2024, 1, n)


def profiles(spark, uses, regs=(), **options):
    crowd = [("filler", f"f{n}-{d}", 1000 + n, day(d), "com", None, None, False, None) for d in range(1, 15) for n in range(12)]
    found = keywords.keyword_profiles(spark.createDataFrame([*uses, *crowd], USES), spark.createDataFrame(list(regs), "term string, day date, n long"), F.lit("2024-01-14").cast("date"), **options)
    return {r.term: r for r in found.collect()}


def use(term, n, d, zone="com", **more):
    return (term, f"{term}{n}.{zone}", n, day(d), zone, more.get("role"), more.get("partner"), more.get("described", True), more.get("lang"))


def test_stages(spark):
    steady = [use("steady", n, d, z) for n, d, z in [(1, 2, "com"), (2, 3, "net"), (3, 4, "com"), (4, 9, "com"), (5, 10, "com"), (6, 11, "com"), (7, 12, "com"), (8, 13, "com")]]
    new = [use("new", n, 11 + n, role=["head", "modifier"][n % 2]) for n in (1, 2, 3)]
    sinking = [use("sinking", n, 3 + n % 8) for n in range(20)] + [use("sinking", 1, 13)]
    single = [use("single", 1, 13)]
    found = profiles(spark, steady + new + sinking + single)
    assert {t: r.stage for t, r in found.items()} == {"steady": "confirmed", "new": "forming", "sinking": "watch", "filler": "watch"}
    assert found["new"].rise is None and found["new"].rise_raw > 1 and found["new"].organic
    assert (found["steady"].ops_first, found["steady"].ops_last, found["steady"].days_first, found["steady"].days_last) == (3, 5, 3, 5)


def test_shares_of_registrations(spark):
    flat = [use("flat", n, 5 + n) for n in range(6)] + [use("flat", n, 12 + n % 3) for n in range(3)]
    regs = [("flat", day(d), 1) for d in range(5, 12)] + [("flat", day(d), 20) for d in (12, 13, 14)] + [("other", day(1), 1)]
    found = profiles(spark, flat, regs)["flat"]
    assert found.share_falling and found.stage == "watch"
    assert profiles(spark, flat)["flat"].share_falling is False  # nothing is known of registrations


def test_languages(spark):
    uses = [use("word", n, 12 + n % 3, lang=["en", "de", "fr"][n % 3]) for n in range(6)] + [use("слово", n, 13, lang=["en", "de"][n % 2]) for n in range(4)]
    found = profiles(spark, uses)
    assert found["word"].is_global and found["word"].boost == 1.5 and found["word"].languages == "de:2,en:2,fr:2"
    assert not found["слово"].is_global and found["слово"].boost == 1.0


def test_lists(spark):
    rows = [("a", 9, 3, 2.0, 1.0), ("b", 9, 4, None, 1.0), ("c", 3, 1, 1.6, 1.5), ("7d", 5, 1, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "term string, operators long, days_active long, rise double, boost double")
    novelty = spark.createDataFrame([("a", 1.0, True), ("c", 0.5, False), ("7d", 2.0, False)], "term string, score double, common boolean")
    found = {(r.list, r.place): r.term for r in keywords.ranked_keywords(frame, 3, novelty=novelty).collect()}
    assert found == {("biggest", 1): "b", ("biggest", 2): "a", ("biggest", 3): "7d", ("trending", 1): "a", ("trending", 2): "c", ("emerging", 1): "c"}


def test_word_places_and_constructions(spark):
    rows = [("boltcity", ["bolt", "city"]), ("boltcity2", ["bolt", "city", "?"]), ("boltcityone", ["bolt", "city", "one"]), ("redbolt", ["red", "bolt"]), ("bolts", ["bolts"]), ("gobolter", ["?", "bolter"]), ("xboltx", ["?", "bolt", "?"])]
    segments = spark.createDataFrame(rows, "label string, pieces array<string>")
    words = spark.createDataFrame([("bolt",)], "word string")
    uses = constructions.word_uses(segments, words)
    assert {r.label for r in uses.collect()} == {"boltcity", "boltcity2", "boltcityone", "redbolt", "bolts", "xboltx"}
    row = constructions.constructions(uses).first()
    assert (row.labels, row.prefix, row.suffix, row.internal) == (6, 4, 1, 1) and (row.kind, row.text, row.n) == ("prefix", "boltcit", 3)
    row = constructions.constructions(uses, least=2, share=0.3).first()
    assert (row.kind, row.text, row.n) == ("prefix", "boltcity", 2)
    numbered = constructions.constructions(spark.createDataFrame([("bolt", f"bolt{i}x") for i in range(4)], "word string, label string")).first()
    assert (numbered.kind, numbered.text, numbered.n) == ("numbered", "bolt#x", 4)
    assert [tuple(r) for r in constructions.family_patterns(segments, words).collect()] == [("bolt", "boltcity", 3, 1)]


def test_probe_order(spark):
    schema = "domain string, state string, classification string, probe_count int, expiration boolean, suspended boolean, parking boolean, buyer_use boolean, page_error boolean, moved_to string, cohort int, left_seller boolean, kit string, alpha_rank int, theme_rank int"
    base = ("exited", None, 0, False, False, False, False, False, "hosting", 1, True, None, 2, 0)
    change = lambda **c: tuple(c.get(k, v) for k, v in zip([x.strip().split()[0] for x in schema.split(",")][1:], base, strict=True))
    cases = {
        "first": (change(), -95), "transfer": (change(state="transferring"), -100), "gone": (change(classification="expiration"), 6), "gone2": (change(classification="expiration", probe_count=2), 5), "sale": (change(classification="likely-sale", probe_count=1), -1),
        "use": (change(buyer_use=True, probe_count=1, moved_to=None), 1), "small": (change(probe_count=1), 1), "else": (change(probe_count=1, moved_to="other"), 2), "middle": (change(probe_count=1, cohort=50), 2), "bulk": (change(probe_count=1, cohort=200), 4), "old": (change(probe_count=1, moved_to=None), 4), "unknown": (change(probe_count=1, moved_to=None, left_seller=False), 3),
        **{f"k{i}": (change(kit="k"), -95 if i < 3 else -45) for i in range(5)},
    }
    frame = spark.createDataFrame([(name, *row) for name, (row, _) in cases.items()], schema)
    assert {r.domain: r.priority for r in derived.probe_order(frame).collect()} == {name: wanted for name, (_, wanted) in cases.items()}


def test_timelines_keep_the_last(spark):
    moves = spark.createDataFrame([("a", 5, "left"), ("b", 1, "left")], "domain string, at long, detail string")
    seen = spark.createDataFrame([("a", i, None if i % 2 else "probe", "" if i == 14 else f"d{i}") for i in range(15)], "domain string, at long, kind string, detail string")
    found = {r.domain: [tuple(e) for e in r.timeline] for r in derived.timelines(moves, seen).collect()}
    assert found["b"] == [(1, "movement", "left")]
    assert [e[0] for e in found["a"]] == [5, *range(4, 15)] and found["a"][-1] == (14, "probe", "observed") and found["a"][2][1] == "probe"


def test_better_sales_and_merge(spark):
    rows = [("a", "com", True, False, False, None, None, "1"), ("a", "com", False, True, True, 9.0, None, "2"), ("a", "com", False, True, True, 8.0, None, "3"), ("b", "com", False, True, False, 1.0, None, "4"), ("b", "com", True, False, False, None, None, "5")]
    offers = spark.createDataFrame(rows, "label string, zone string, checked boolean, live boolean, for_sale boolean, price double, ends_at timestamp, url string")
    assert {r.label: r.url for r in derived.better_sales(offers).collect()} == {"a": "3", "b": "5"}
    schema = "keyword string, day date, n_zones long, new_zones long, zones string, source string"
    observed = spark.createDataFrame([(" Bolt ", day(3), 2, 2, "com,net", "observed"), ("", day(3), 1, 1, "", "observed")], schema)
    zones = spark.createDataFrame([("bolt", day(3), 5, 1, "ai", "daily-diff"), ("gear", day(4), 1, 1, "io", "daily-diff")], schema)
    assert [tuple(r) for r in derived.merged_trends(observed, zones, 5).collect()] == [("gear", day(4), 1, 1, "io", "daily-diff"), ("bolt", day(3), 5, 2, "com,net", "observed+daily-diff")]

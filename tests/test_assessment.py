"""Each rung of the assessment ladder, identity of destinations, views and trending by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from namewake.operators import assessment, trending

NOW = dt.datetime(2024, 3, 1, 12)
DAY = dt.timedelta(days=1)
BASE = {
    "domain": "copperleaf.com", "departure_day": dt.date(2024, 2, 20), "prev_day": dt.date(2024, 2, 19), "move_day": dt.date(2024, 2, 20), "last_changed": None, "prev_class": "seller", "today_class": "hosting",
    "cohort": 1, "kit_size": 0, "seller_hosts": 2, "today_hosts": 2, "moved": True, "buyer_use": False, "aligned": False, "site_kind": None, "for_sale": False, "suspended": False, "platform": False,
    "expiry_origin": False, "expiry_destination": False, "mandated": False, "registrar_origin": False, "prior_listing": False, "relisted": False, "lookup_failed": False, "statuses": ["ok"], "prev_statuses": ["ok"],
    "registrar_id": None, "prev_registrar_id": None, "registrar": None, "prev_registrar": None, "transfer_at": None, "checked_at": NOW - DAY, "observed_at": None, "prev_observed_at": None, "recorded_change_at": None, "reported_tier": None,
}
SCHEMA = """domain string, departure_day date, prev_day date, move_day date, last_changed date, prev_class string, today_class string, cohort int, kit_size int, seller_hosts int, today_hosts int, moved boolean, buyer_use boolean, aligned boolean,
site_kind string, for_sale boolean, suspended boolean, platform boolean, expiry_origin boolean, expiry_destination boolean, mandated boolean, registrar_origin boolean, prior_listing boolean, relisted boolean, lookup_failed boolean,
statuses array<string>, prev_statuses array<string>, registrar_id string, prev_registrar_id string, registrar string, prev_registrar string, transfer_at timestamp, checked_at timestamp, observed_at timestamp, prev_observed_at timestamp, recorded_change_at timestamp, reported_tier string"""
BUILT = {"buyer_use": True, "aligned": True, "site_kind": "operating"}
NEAR = {"transfer_at": dt.datetime(2024, 2, 22)}
CASES = [
    ({"reported_tier": "verified", "expiry_origin": True}, ("verified", "reported-sale", None)),
    ({"statuses": ["pendingdelete"], **NEAR}, ("excluded", "expiration", None)),
    ({"expiry_destination": True}, ("excluded", "expiration", None)),
    ({"suspended": True}, ("excluded", "registry-hold", None)),
    ({"cohort": 12, "today_class": "other"}, ("suspected", "portfolio-kit", None)),
    ({"cohort": 12, "today_class": "hosting", "departure_day": dt.date(2024, 2, 29)}, ("suspected", "seller-departure", None)),
    ({"kit_size": 3}, ("suspected", "portfolio-kit", None)),
    ({"statuses": ["pendingtransfer"]}, ("transfer", "transfer-in-progress", None)),
    ({"platform": True, **NEAR}, ("excluded", "platform-destination", None)),
    ({"for_sale": True}, ("excluded", "lander-migration", None)),
    ({"prev_class": "hosting", "mandated": True, **NEAR}, ("excluded", "owner-migration", None)),
    (NEAR, ("probable", "likely-sale", "transfer")),
    ({**NEAR, "relisted": True}, ("transfer", "transfer-completed", None)),
    ({"prev_class": "parking", **BUILT, **NEAR}, ("probable", "likely-sale", "built")),
    ({"departure_day": dt.date(2024, 2, 10)}, ("probable", "likely-sale", "off-market")),
    ({"departure_day": dt.date(2024, 2, 10), "relisted": True}, ("suspected", "unconfirmed-move", None)),
    ({"prev_class": "registrar", "registrar_origin": True, "prior_listing": True, **BUILT, **NEAR}, ("suspected", "transferred-and-built", None)),
    ({"prev_class": "parking", "registrar_id": "1", "prev_registrar_id": "2", "prev_observed_at": NOW - 5 * DAY}, ("transfer", "transfer-completed", None)),
    ({"prev_class": "parking", "prev_statuses": ["pendingtransfer"], "registrar": "B", "prev_registrar": "a", "prev_observed_at": NOW - 5 * DAY}, ("transfer", "transfer-completed", None)),
    ({"prev_class": "parking", "registrar": "A", "prev_registrar": "a", "prev_statuses": ["pendingtransfer"], "prev_observed_at": NOW - 5 * DAY}, ("suspected", "unconfirmed-move", None)),
    ({"prev_class": "parking", "recorded_change_at": dt.datetime(2024, 2, 1)}, ("transfer", "transfer-completed", None)),
    ({"prev_class": "parking", **BUILT}, ("suspected", "acquisition-candidate", None)),
    ({"prev_class": "parking", **BUILT, "checked_at": NOW - 5 * DAY}, ("suspected", "unconfirmed-move", None)),
    ({"departure_day": dt.date(2024, 2, 29)}, ("suspected", "seller-departure", None)),
    ({}, ("suspected", "unconfirmed-move", None)),
    ({"prev_class": "hosting", **BUILT}, ("excluded", "no-seller-origin", None)),
    ({"prev_class": None, "statuses": None, "checked_at": None, "departure_day": None, "seller_hosts": None}, ("suspected", "unconfirmed-move", None)),
]


def assessed(spark, changes):
    rows = [tuple((BASE | c | {"domain": f"n{i}.com"}).values()) for i, c in enumerate(changes)]
    found = assessment.assess(spark.createDataFrame(rows, SCHEMA), F.lit(NOW.isoformat(" ")).cast("timestamp"))
    return {int(r.domain[1:-4]): r for r in found.collect()}


def test_ladder(spark):
    found = assessed(spark, [c for c, _ in CASES])
    assert {i: (found[i].tier, found[i].classification, found[i].basis) for i in found} == {i: wanted for i, (_, wanted) in enumerate(CASES)}


def test_departure_is_dated_by_the_registry(spark):
    several = {"prev_day": dt.date(2024, 2, 16), "last_changed": dt.date(2024, 2, 18)}
    found = assessed(spark, [several, several | {"last_changed": dt.date(2024, 2, 16)}, {"last_changed": dt.date(2024, 2, 20)}])
    assert [found[i].departed for i in range(3)] == [dt.date(2024, 2, 18), dt.date(2024, 2, 20), dt.date(2024, 2, 20)]


@pytest.mark.parametrize(
    ("domain", "title", "heading", "host", "wanted"),
    [
        ("copperleaf.com", "Copper Leaf Garden", "", "copperleaf.com", {"title_aligned", "aligned"}),
        ("copperleaf.com", "copperleaf.com", "", "copperleaf.com", set()),
        ("copperleaf.com", "copperleaf.com - Shared Hosting", "Copperleaf", "copperleaf.com", {"template_title"}),
        ("copperleaf.com", "www.copperleaf.com | Copperleaf shoes", None, None, {"title_aligned", "aligned"}),
        ("copperleaf.com", "Copperleaf by Grand Hotels", "", "grandhotels.com", {"attributed"}),
        ("copperleaf.com", "Copperleaf by Grand Hotels", "", "copperleaf.com", {"title_aligned", "aligned"}),
        ("copperleaf.com", "Other", "", "copper-leaf.io", {"redirect_aligned", "aligned"}),
        ("copperleaf.com", "Other", "About Copperleaf", "x.com", {"heading_aligned", "aligned"}),
        ("abc.com", "abcdef", "", "", set()),
        ("abc.com", "The ABC shop", "", "", {"title_aligned", "aligned"}),
        ("a.com", "a", "", "a.net", set()),
        (None, None, None, None, set()),
    ],
)
def test_identity(spark, domain, title, heading, host, wanted):
    frame = spark.createDataFrame([(domain, title, heading, host)], "domain string, title string, heading string, final_host string")
    row = assessment.destination_identity(frame).first().asDict()
    assert {k for k, v in row.items() if v is True} == wanted


def test_learned_platforms(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("a", day(3))] * 5 + [("b", day(d)) for d in (1, 2, 3, 4)] + [("c", day(9))]
    found = assessment.learned_platforms(spark.createDataFrame(rows, "hosts_key string, day date"), daily=5, trailing=3, days=3)
    assert sorted(map(tuple, found.collect())) == [("a", day(3)), ("b", day(4))]


def test_views(spark):
    rows = [("a", "probable", "likely-sale", False, "alpha", False, 0), ("b", "probable", "likely-sale", False, "alpha", True, 0), ("c", "verified", "reported-sale", False, "alpha", False, 0), ("d", "excluded", "expiration", True, None, None, None), ("e", "suspected", "seller-departure", False, "weak", False, 5)]
    frame = spark.createDataFrame(rows, "domain string, tier string, classification string, expiration boolean, name_quality string, spam boolean, kit_size int")
    found = {}
    for r in assessment.views(frame).collect():
        found.setdefault(r.domain, set()).add(r.view)
    assert found == {"a": {"all", "leads", "alpha", "focus", "probable"}, "b": {"all", "leads", "focus", "probable"}, "d": {"all", "excluded"}, "e": {"all", "leads", "suspected"}}


def test_trending(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("redbolt", day(d), ["ai", "dev", "com"]) for d in (29, 30)] + [("redbolt", day(10), ["com"]), ("aaa1", day(30), ["com"]), ("zz9", day(30), ["xyz"]), ("12ab", day(30), ["com"])]
    cut = spark.createDataFrame([("redbolt", ["red", "bolt"]), ("aaa1", ["?"]), ("12ab", ["?"])], "label string, pieces array<string>")
    history = spark.createDataFrame(rows, "keyword string, day date, zones array<string>")
    options = {"groups": {"technical": ["ai", "dev"]}, "curated": ["technical"], "zero_weight": ["xyz"]}
    anchor = F.lit("2024-01-30").cast("date")
    found = {r.term: r for r in trending.trending_terms(history, cut, anchor, noise=True, **options).collect()}
    assert set(found) == {"redbolt", "aaa1", "12ab"}
    red = found["redbolt"]
    assert (red.window_n, red.baseline_n, red.low_confidence, red.momentum, red.spread, red.co_moving, red.worth_watching, red.signal, red.source_domains) == (2, 1, True, 4.0, 3, "technical", True, "quality", 3)
    assert red.quality_score == pytest.approx((3 + 2 * 2) * 4.0 * 1.5)
    assert found["aaa1"].signal == "noise" and found["12ab"].signal == "noise" and found["12ab"].co_moving is None
    assert {r.term for r in trending.trending_terms(history, cut, anchor, **options).collect()} == {"redbolt"}
    words = {r.term: r for r in trending.trending_terms(history, cut, anchor, words=True, **options).collect()}
    assert set(words) == {"red", "bolt"} and words["red"].quality_score == red.quality_score

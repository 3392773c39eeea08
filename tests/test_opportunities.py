"""Each gate of an opportunity fails once; what passes all has a score."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from namewake.operators import opportunities

NOW = dt.datetime(2024, 3, 1, 12)
GOOD = {
    "domain": "boltforge.com", **dict.fromkeys(opportunities.QUALITY, 9.0), "obvious_better_alternatives": 1.0, "ambiguity": 0.0, "confidence": 0.9, "price": 500.0, "max_price": 600.0, "substitute": "forge.com", "substitute_price": 9000.0, "retail_ceiling": 8000.0,
    "preference": "substitute", "substitute_confidence": 0.8, "substitution_strength": 0.7, "accelerating": True, "renewal": 10.0, "fee": 0.15, "probability": 0.2, "sale_price": 8000.0, "assumptions": "stated", "quote_status": "listed", "quote_provider": "acme",
    "quote_domain": "BoltForge.com", "quote_price": 500.0, "quoted_at": NOW - dt.timedelta(hours=5), "review_passed": True, "excluded": ["xyz"], "current_labels": 20, "distinct_labels": 50, "active_days": 7, "token": "forge",
}
SCHEMA = ", ".join(f"{k} {'timestamp' if k == 'quoted_at' else 'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in GOOD.items())
CASES = [
    ({"clarity": 5.0}, "quality", ["clarity"]),
    ({"clarity": None, "ambiguity": None}, "quality", ["missing:clarity", "missing:ambiguity"]),
    ({"ambiguity": 3.0}, "quality", ["ambiguity"]),
    ({"price": 700.0, "quote_price": 700.0}, "budget", ["above-maximum"]),
    ({"retail_ceiling": 9500.0}, "substitute", ["above-substitute"]),
    ({"retail_ceiling": 4000.0}, "substitute", ["upside"]),
    ({"preference": None}, "substitute", ["preference"]),
    ({"quoted_at": NOW - dt.timedelta(hours=30)}, "economics", ["quote"]),
    ({"quote_price": 400.0}, "economics", ["quote"]),
    ({"probability": 0.01}, "economics", ["profit"]),
    ({"assumptions": ""}, "economics", ["assumptions"]),
    ({"excluded": ["shop"]}, "registration", ["xyz"]),
    ({"active_days": 2}, "registration", ["one-off"]),
    ({"token": "other"}, "registration", ["vocabulary"]),
    ({"domain": "boltforge.xyz", "quote_domain": "boltforge.xyz"}, "registration", ["vocabulary"]),
]


def ranked(spark, changes, sources):
    rows = [tuple((GOOD | change).values()) for change in changes]
    given = [(d, "primary", "category", "a summary of some length", url, NOW - dt.timedelta(days=age)) for d, url, age in sources]
    frame = spark.createDataFrame(given, "domain string, kind string, scope string, summary string, url string, published_at timestamp")
    return opportunities.ranked_opportunities(spark.createDataFrame(rows, SCHEMA), frame, F.lit(NOW.isoformat(" ")).cast("timestamp"))


def test_gates(spark):
    names = [{"domain": f"n{i}forge.com", "quote_domain": f"n{i}forge.com"} | change for i, (change, *_) in enumerate(CASES)] + [{}]
    sources = [(n.get("domain", GOOD["domain"]), url, age) for n in names for url, age in (("https://www.one.example/a", 10), ("https://news.two.example/b", 170))]
    found = {r.domain: r for r in ranked(spark, names, sources).collect()}
    gates = ["quality", "budget", "substitute", "adoption", "economics", "registration"]
    for name, (_, gate, reasons) in zip(names, CASES, strict=False):
        row = found[name["domain"]]
        assert {g: row[f"{g}_reasons"] for g in gates if row[f"{g}_reasons"]} == {gate: reasons}, name
        assert not row.passed and row.score is None
    good = found["boltforge.com"]
    assert good.passed and good.upside == 16 and good.overall == 90
    trend, price, upside = 40 + 30 + 15, min(100, 100 - 18 * math.log2(0.5)), 25 * math.log2(8)
    assert good.score == pytest.approx(90 * 0.35 + trend * 0.25 + price * 0.15 + upside * 0.25, abs=0.01)


def test_adoption(spark):
    sources = [("boltforge.com", "https://www.one.example/a", 10), ("boltforge.com", "https://blog.one.example/b", 20), ("boltforge.com", "https://two.example/c", 181)]
    assert ranked(spark, [{}], sources).first().adoption_reasons == ["publishers"]
    sources = [("boltforge.com", "https://one.example/a", 100), ("boltforge.com", "https://two.example/b", 95)]
    assert ranked(spark, [{}], sources).first().adoption_reasons == ["acceleration"]
    assert ranked(spark, [{"accelerating": False}], sources).first().passed
    assert ranked(spark, [{}], []).first().adoption_reasons == ["publishers", "acceleration"]

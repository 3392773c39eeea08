"""Names worth buying: gates with all their reasons, and a score for those that pass every one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a name's quality (0 to 10) with their least value and their weight; two with a largest value; and the bounds of the other gates.
QUALITY = {
    "naturalness": (8, 0.10),
    "clarity": (6, 0.05),
    "memorability": (7, 0.10),
    "commercial_breadth": (7, 0.08),
    "morphology": (8, 0.08),
    "spoken_brandability": (7, 0.08),
    "emotional_resonance": (6, 0.05),
    "distinctiveness": (7, 0.08),
    "premium_lexical_strength": (8, 0.12),
    "founder_choice": (8, 0.10),
    "strategic_retention": (8, 0.08),
    "five_figure_conviction": (8, 0.08),
}
MOST = {"obvious_better_alternatives": 1, "ambiguity": 2}
OVERALL, CONFIDENCE, SUBSTITUTE_CONFIDENCE, SUBSTITUTE_STRENGTH, UPSIDE = 76, 0.8, 0.75, 0.6, 10


def _reasons(*tests: tuple[Column, str]) -> Column:
    """The names of the tests that hold; an unknown test does not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for test, name in tests]))


def _bounded(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def quality_gate(df: DataFrame) -> DataFrame:
    """Adds ``overall`` (0 to 100, two places; 0 if a field is missing) and ``quality_reasons``: ``missing:`` fields, or each bound that fails."""
    fields = [*QUALITY, *MOST, "confidence"]
    q = lambda f: _bounded(F.col(f), 0, 1 if f == "confidence" else 10)
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in fields]))
    total = F.lit(0.0)
    for field, (_, weight) in QUALITY.items():
        total = total + q(field) * weight
    out = df.withColumns({"_missing": missing, "overall": F.floor(total * 10 * 100 + 0.5) / 100})
    failed = _reasons(*[(q(f) < least, f) for f, (least, _) in QUALITY.items()], *[(q(f) > most, f) for f, most in MOST.items()], (q("confidence") < CONFIDENCE, "confidence"), (F.col("overall") < OVERALL, "overall"))
    told = F.when(F.size("_missing") > 0, F.transform("_missing", lambda f: F.concat(F.lit("missing:"), f))).otherwise(failed)
    return out.withColumns({"quality_reasons": told, "overall": F.when(F.size("_missing") > 0, 0.0).otherwise(F.col("overall"))}).drop("_missing")


def adoption(sources: DataFrame, now: Column) -> DataFrame:
    """(domain, publishers, newest): the independent publishers of dated primary sources on the category, not older than 180 days, and the time of the newest.

    ``sources`` are (domain, kind, scope, summary, url, published_at); a summary has 20 characters or more. A publisher is the last two labels of the url's host.
    """
    age = F.unix_micros(now) - F.unix_micros("published_at")
    fine = (F.col("kind") == "primary") & (F.col("scope") == "category") & (F.length(F.trim("summary")) >= 20) & F.col("url").rlike("^https?://") & age.between(0, 180 * 86_400_000_000)
    host = F.regexp_extract(F.lower("url"), r"^https?://(?:www\.)?([^/:?#]+)", 1)
    return sources.where(fine).groupBy("domain").agg(F.count_distinct(F.substring_index(host, ".", -2)).alias("publishers"), F.max("published_at").alias("newest"))


def ranked_opportunities(candidates: DataFrame, sources: DataFrame, now: Column, *, no_weight: Sequence[str] = ("xyz", "shop", "info"), quote_hours: int = 24) -> DataFrame:
    """Adds the reasons of six gates, and the parts of the score, to ``candidates``; ``passed`` tells whether no gate has a reason.

    quality (see ``quality_gate``); budget: a price, and none above max_price; substitutes: the best alternative's domain, price, ceiling and preference (candidate, substitute, equivalent), sure and strong enough, no
    ceiling above the price of an equal or preferred one, ten times the price as upside; adoption: two publishers, and a source within 90 days if ``accelerating``; economics: a fresh quote of the same name and price, stated
    assumptions, and an expected profit after four renewals; registrations: a reviewed pattern without xyz, on 3 weighted labels now, 10 in all and 3 days, whose token the name keeps.
    ``score`` is 35 % quality, 25 % trend, 15 % price and 25 % upside, null unless passed.

    Reads domain, the quality fields, price, max_price, substitute, substitute_price, retail_ceiling, preference, substitute_confidence, substitution_strength, accelerating, renewal, fee, probability, sale_price, assumptions, quote_status,
    quote_provider, quote_domain, quote_price, quoted_at, review_passed, excluded (zones), current_labels, distinct_labels, active_days, token. Nulls fail the gate that asks for them.
    """
    c = F.col
    rows = quality_gate(candidates).join(adoption(sources, now), "domain", "left").fillna(0, ["publishers"])
    absent = lambda v, test: v.isNull() | ~test
    price, substitute, ceiling = c("price"), c("substitute_price"), c("retail_ceiling")
    upside = F.when((price > 0) & (ceiling > 0), ceiling / price)
    cost, proceeds = price + 4 * c("renewal"), c("probability") * c("sale_price") * (1 - c("fee"))
    quote_age = F.unix_micros(now) - F.unix_micros("quoted_at")
    bad_quote = ~F.coalesce(c("quote_status").isin("available", "listed") & (F.trim("quote_provider") != "") & (F.lower("quote_domain") == F.lower("domain")) & quote_age.between(0, quote_hours * 3_600_000_000) & (c("quote_price") == price), F.lit(False))
    label, zone = F.substring_index(F.lower("domain"), ".", 1), F.substring_index(F.lower("domain"), ".", -1)
    rows = rows.withColumns({"upside": F.floor(upside * 100 + 0.5) / 100, "expected_profit": proceeds - cost, "expected_multiple": F.when(cost > 0, proceeds / cost)})
    rows = rows.withColumns(
        {
            "budget_reasons": _reasons((absent(price, price > 0), "price"), (c("max_price") <= 0, "maximum"), (price > c("max_price"), "above-maximum")),
            "substitute_reasons": _reasons(
                (F.coalesce(F.trim("substitute"), F.lit("")) == "", "substitute"),
                (absent(price, price > 0), "price"),
                (absent(substitute, substitute > 0), "substitute-price"),
                (absent(ceiling, ceiling > 0), "ceiling"),
                (absent(c("preference"), c("preference").isin("candidate", "substitute", "equivalent")), "preference"),
                (absent(c("substitute_confidence"), c("substitute_confidence") >= SUBSTITUTE_CONFIDENCE), "confidence"),
                (absent(c("substitution_strength"), c("substitution_strength") >= SUBSTITUTE_STRENGTH), "strength"),
                (c("preference").isin("substitute", "equivalent") & (ceiling > substitute), "above-substitute"),
                (upside < UPSIDE, "upside"),
            ),
            "adoption_reasons": _reasons((c("publishers") < 2, "publishers"), (c("accelerating") & ~F.coalesce(F.unix_micros(now) - F.unix_micros("newest") <= 90 * 86_400_000_000, F.lit(False)), "acceleration")),
            "economics_reasons": _reasons(
                (bad_quote, "quote"),
                (absent(c("renewal"), c("renewal") >= 0) | absent(c("fee"), (c("fee") >= 0) & (c("fee") < 1)) | absent(c("probability"), (c("probability") > 0) & (c("probability") < 1)) | absent(c("sale_price"), c("sale_price") > 0) | (F.coalesce("assumptions", F.lit("")) == ""), "assumptions"),
                (absent(c("expected_profit"), c("expected_profit") > 0), "profit"),
            ),
            "registration_reasons": _reasons(
                (absent(c("review_passed"), c("review_passed")), "review"),
                (absent(c("excluded"), F.array_contains("excluded", "xyz")), "xyz"),
                (absent(c("current_labels"), c("current_labels") >= 3) | absent(c("distinct_labels"), c("distinct_labels") >= 10) | absent(c("active_days"), c("active_days") >= 3), "one-off"),
                ((F.coalesce("token", F.lit("")) == "") | ~F.contains(label, F.coalesce("token", F.lit("?"))) | zone.isin(*no_weight), "vocabulary"),
            ),
        }
    )
    gates = ["quality", "budget", "substitute", "adoption", "economics", "registration"]
    count = F.lit(0)
    for gate in gates:
        count = count + F.size(f"{gate}_reasons")
    capped = lambda v, most: F.least(F.lit(1.0), F.coalesce(c(v), F.lit(0)) / most)
    trend = 40 * capped("active_days", 7) + 30 * capped("current_labels", 20) + 30 * capped("distinct_labels", 100)
    parts = c("overall") * 0.35 + trend * 0.25 + _bounded(100 - 18 * F.log2(price / 1000), 0, 100) * 0.15 + _bounded(25 * F.log2(c("upside") / 2), 0, 100) * 0.25
    rows = rows.withColumn("passed", count == 0)
    return rows.withColumn("score", F.when(c("passed"), F.floor(parts * 100 + 0.5) / 100))

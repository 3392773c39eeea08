"""Scores and classes of names, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points of the quality score.
ZONE_POINTS = {"com": 120, "ai": 95, "sh": 80, "io": 75, "net": 55, "org": 50, "bot": 45, "dev": 45, "app": 40, "co": 35}
LENGTH_POINTS = [(3, 170), (4, 150), (5, 130), (6, 110), (8, 85), (10, 60), (12, 35)]
# Words of terms that are noise: a short list of the library's own, which callers replace.
LEXICON = ["casino", "poker", "slots", "betting", "porn", "xxx", "escort"]


def _steps(value: Column, steps: Sequence[tuple[int, int]], rest: Column) -> Column:
    out = rest
    for limit, points in reversed(steps):
        out = F.when(value <= limit, points).otherwise(out)
    return out


def longest_consonants(label: Column) -> Column:
    runs = F.regexp_extract_all(F.regexp_replace(label, "[^a-z]", ""), F.lit("([^aeiouy]+)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def domain_quality(df: DataFrame) -> DataFrame:
    """Adds ``quality``: points for length, zone, clean spelling, taken zones, age and archive, less for unreadable labels; and ``reasons``, at most eight of them as text.

    Confirmed unavailable names have 0. Reads label, zone, zones_taken, age_years, archive, available; nulls count as nothing known.
    """
    label, size = F.col("label"), F.length("label")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    bare = df.withColumns({"_digits": label.rlike("[0-9]"), "_hyphens": F.contains(label, F.lit("-")), "_letters": F.regexp_replace(label, "[^a-z]", "")})
    letters = F.col("_letters")
    shape = bare.withColumns({"_vowels": F.length(F.regexp_replace(letters, "[^aeiouy]", "")) / F.length(letters), "_run": longest_consonants(label)})  # once a row, not once a use
    digits, hyphens, vowels, run = F.col("_digits"), F.col("_hyphens"), F.col("_vowels"), F.col("_run")
    zone = F.lit(20)
    for name, points in ZONE_POINTS.items():
        zone = F.when(F.col("zone") == name, points).otherwise(zone)
    unreadable = F.when(vowels < 0.18, 120).when(vowels < 0.27, 45).otherwise(0) + F.when(run >= 6, 120).when(run >= 5, 45).otherwise(0)
    parts = [
        F.when(size <= 0, 0).otherwise(_steps(size, LENGTH_POINTS, F.greatest(F.lit(0), 25 - (size - 12) * 5))),
        zone,
        F.when(digits, -35).otherwise(45),
        F.when(hyphens, -30).otherwise(40),
        F.when(count("zones_taken") > 0, F.least(F.lit(260), F.floor(F.log2(count("zones_taken") + 1) * 38 + 0.5))).otherwise(0),
        F.when(count("age_years") > 0, F.least(F.lit(110), count("age_years") * 6)).otherwise(0),
        F.when(count("archive") > 0, F.least(F.lit(120), F.floor(F.log10(count("archive") + 1) * 60 + 0.5))).otherwise(0),
        F.when(F.col("available"), 70).otherwise(0),
        F.when(size >= 14, -F.least(F.lit(80), (size - 13) * 8)).otherwise(0),
        F.when(F.length(letters) >= 4, -F.least(F.lit(220), unreadable)).otherwise(0),
    ]
    total = sum((p.cast("long") for p in parts[1:]), parts[0].cast("long"))
    unavailable = F.col("available") == F.lit(False)
    reasons = [
        F.when(F.col("available"), "confirmed available"),
        F.when(size > 0, F.format_string("%d chars", size)),
        F.when(F.col("zone") != "", F.format_string("%s priority", "zone")),
        F.when(digits, "has number"),
        F.when(hyphens, "has hyphen"),
        F.when(~digits & ~hyphens, "clean"),
        F.when(count("zones_taken") > 0, F.format_string("%d TLDs taken", "zones_taken")),
        F.when(count("age_years") > 0, F.format_string("%dy old", "age_years")),
        F.when(count("archive") > 0, F.format_string("%d Wayback", "archive")),
        F.when((F.length(letters) >= 4) & (unreadable > 0), "low readability"),
    ]
    why = F.array_join(F.slice(F.array_compact(F.array(*reasons)), 1, 8), "; ")
    quality = F.when(unavailable, 0).otherwise(F.greatest(F.lit(0), total)).cast("long")
    found = shape.withColumns({"quality": quality, "reasons": F.when(unavailable, "confirmed unavailable").otherwise(why)})
    return found.drop("_digits", "_hyphens", "_letters", "_vowels", "_run")


def gem_rank(df: DataFrame) -> DataFrame:
    """Adds ``bonus`` for taken zones (60), age (30) and archive (30), and ``gem`` = quality + bonus."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    zones = F.when(count("zones_taken") > 0, F.least(F.lit(60), F.floor(F.log2(count("zones_taken") + 1) * 12 + 0.5))).otherwise(0)
    age = F.when(count("age_years") > 0, F.least(F.lit(30), count("age_years") * 2)).otherwise(0)
    archive = F.when(count("archive") > 0, F.least(F.lit(30), F.floor(F.log10(count("archive") + 1) * 15 + 0.5))).otherwise(0)
    bonus = zones.cast("long") + age.cast("long") + archive.cast("long")
    return domain_quality(df).withColumn("bonus", bonus).withColumn("gem", F.col("quality") + F.col("bonus"))


def alpha_tier(df: DataFrame, zones: Sequence[str], zero_weight: Sequence[str], words: str = "words", length: tuple[int, int] = (3, 14)) -> DataFrame:
    """Adds ``tier``: weak for other characters, lengths or zones without weight; alpha for two dictionary words or a
    short readable label in an alpha zone; else standard. ``words`` is the number of dictionary words, null if the label is not made of words."""
    label, size = F.col("label"), F.length("label")
    weak = ~label.rlike("^[a-z]+$") | ~size.between(*length) | F.col("zone").isin(*zero_weight)
    short = (size <= 7) & (longest_consonants(label) <= 3) & label.rlike("[aeiouy]")
    good = F.coalesce(F.col(words) == 2, F.lit(False)) | short
    return df.withColumn("tier", F.when(weak, "weak").when(good & F.col("zone").isin(*zones), "alpha").otherwise("standard"))


def availability_gap(df: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Adds ``com_state``: confirmed-available or taken by evidence of the last hours, else unknown.

    Reads available with checked_at, and sibling with sibling_at.
    """
    fresh = lambda c: F.coalesce(F.col(c) >= now - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))
    free = fresh("checked_at") & F.coalesce(F.col("available"), F.lit(False))
    taken = (fresh("checked_at") & ~F.coalesce(F.col("available"), F.lit(True))) | (fresh("sibling_at") & F.coalesce(F.col("sibling") == "taken", F.lit(False)))
    return df.withColumn("com_state", F.when(free, "confirmed-available").when(taken, "taken").otherwise("unknown"))


def term_signal(df: DataFrame, zero_weight: Sequence[str], curated: Sequence[str], bulk_zones: int = 12, lexicon: Sequence[str] = LEXICON) -> DataFrame:
    """Adds ``signal`` to (term, zones): noise, mixed or quality.

    Noise: a word of the ``lexicon``, half digits, spread over many zones of which most are not curated, or digits in gibberish.
    """
    term = F.lower("term")
    digits = F.length(F.regexp_replace(term, "[^0-9]", "")) / F.greatest(F.length(term), F.lit(1))
    gibberish = (F.length(term) < 3) | term.rlike(r"(.)\1\1") | ~term.rlike("[aeiouy]")
    lexicon = F.exists(F.array(*[F.lit(w) for w in lexicon]), lambda w: F.contains(term, w))
    weighted = F.filter("zones", lambda z: ~z.isin(*zero_weight))
    others = F.size(F.filter(weighted, lambda z: ~z.isin(*curated)))
    bulk = (F.size(weighted) >= bulk_zones) & (others > F.size(weighted) / 2)
    noise = bulk | lexicon | (digits >= 0.5) | (gibberish & (digits > 0))
    return df.withColumn("signal", F.when(noise, "noise").when((digits >= 0.3) | gibberish, "mixed").otherwise("quality"))


def rank_opportunities(df: DataFrame, *, budget: float, least_quality: int = 250, substitutes: int = 10) -> DataFrame:
    """Adds ``gate`` (the first that fails, or ``pass``) and ``score``: whole points of a blend of quality, age, archive and price, 0 if a gate fails."""
    gate = F.when(F.col("quality") < least_quality, "quality").when(F.col("price").isNull() | (F.col("price") > budget), "budget").when(F.col("zones_taken") >= substitutes, "substitutes").when(F.coalesce("archive", F.lit(0)) == 0, "evidence").otherwise("pass")
    share = lambda c, top: F.least(F.col(c) / top, F.lit(1.0))
    blend = 0.35 * share("quality", 600.0) + 0.25 * share("age_years", 30.0) + 0.15 * share("archive", 50.0) + 0.25 * (1 - F.col("price") / budget)
    return df.withColumn("gate", gate).withColumn("score", F.when(F.col("gate") == "pass", F.floor(100 * blend + 1e-6)).otherwise(0).cast("long"))


def probe_priority(df: DataFrame) -> DataFrame:
    """Adds ``priority`` of a movement by its shape: departures of a seller first, then of parking, then going live, then the rest."""
    seller, parking = F.col("prev_class") == "seller", F.col("prev_class") == "parking"
    shape = F.when(seller & F.col("today_class").isin("hosting", "other"), 100).when(seller, 80).when(parking & (F.col("today_class") == "hosting"), 60).when(parking, 40).when(F.col("today_class") == "hosting", 20)
    return df.withColumn("priority", F.coalesce(shape, F.lit(0)))


def assess_sales(df: DataFrame) -> DataFrame:
    """Adds ``tier`` and ``basis`` by an ordered ladder over a movement with ``cohort`` (names that moved alike that day).

    Not from a seller: excluded. Gone: excluded. To another seller or parking: excluded as a transfer of the lander. A large cohort: a coordinated migration.
    To a registrar's default: suspected. To hosting: probable. Else suspected.
    """
    rules = [
        (~F.col("prev_class").isin("seller", "parking"), "excluded", "not-listed-before"),
        (F.col("kind") == "dropped", "excluded", "delegation-removed"),
        (F.col("today_class").isin("seller", "parking"), "excluded", "still-on-a-lander"),
        (F.col("cohort") >= 10, "excluded", "coordinated-migration"),
        (F.col("today_class") == "registrar", "suspected", "registrar-default"),
        (F.col("today_class") == "hosting", "probable", "live-destination"),
    ]
    tier, basis = F.lit("suspected"), F.lit("other-destination")
    for test, name, why in reversed(rules):
        test = F.coalesce(test, F.lit(False))
        tier, basis = F.when(test, name).otherwise(tier), F.when(test, why).otherwise(basis)
    return df.withColumn("tier", tier).withColumn("basis", basis)


def ledger_views(df: DataFrame) -> DataFrame:
    """One row for each view that an assessed row belongs to: all, leads (probable or suspected), and its tier."""
    views = F.array_compact(F.array(F.lit("all"), F.when(F.col("tier").isin("probable", "suspected"), F.lit("leads")), F.col("tier")))
    return df.withColumn("view", F.explode(views))

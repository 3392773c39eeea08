"""Queries of scores and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scores as ops
from ..operators import trends
from ..sources import market
from ..sources.market import LISTINGS, NAMES
from .registry import query
from .zone_queries import MOVEMENT, movement

_ZONE = "CASE zone " + " ".join(f"WHEN '{z}' THEN {p}" for z, p in ops.ZONE_POINTS.items()) + " ELSE 20 END"
_LENGTH = "CASE " + " ".join(f"WHEN length(label) <= {n} THEN {p}" for n, p in ops.LENGTH_POINTS) + " ELSE greatest(0, 25 - (length(label) - 12) * 5) END"
QUALITY = f"""letters AS (SELECT *, regexp_replace(label, '[^a-z]', '', 'g') AS a, coalesce(zones_taken, 0) AS zt, coalesce(age_years, 0) AS ay, coalesce(archive, 0) AS ar FROM listings),
shape AS (SELECT *, length(regexp_replace(a, '[^aeiouy]', '', 'g')) / length(a) AS vowels, coalesce(list_max(list_transform(regexp_extract_all(a, '[^aeiouy]+'), lambda x: length(x))), 0) AS run FROM letters),
quality AS (SELECT *, CAST(CASE WHEN available = false THEN 0 ELSE greatest(0, {_LENGTH} + {_ZONE}
  + CASE WHEN regexp_matches(label, '[0-9]') THEN -35 ELSE 45 END + CASE WHEN contains(label, '-') THEN -30 ELSE 40 END
  + CASE WHEN zt > 0 THEN least(260, floor(log2(zt + 1) * 38 + 0.5)) ELSE 0 END + CASE WHEN ay > 0 THEN least(110, ay * 6) ELSE 0 END + CASE WHEN ar > 0 THEN least(120, floor(log10(ar + 1) * 60 + 0.5)) ELSE 0 END
  + CASE WHEN available THEN 70 ELSE 0 END - CASE WHEN length(label) >= 14 THEN least(80, (length(label) - 13) * 8) ELSE 0 END
  - CASE WHEN length(a) >= 4 THEN least(220, CASE WHEN vowels < 0.18 THEN 120 WHEN vowels < 0.27 THEN 45 ELSE 0 END + CASE WHEN run >= 6 THEN 120 WHEN run >= 5 THEN 45 ELSE 0 END) ELSE 0 END) END AS BIGINT) AS quality FROM shape),
gems AS (SELECT *, CAST(CASE WHEN zt > 0 THEN least(60, floor(log2(zt + 1) * 12 + 0.5)) ELSE 0 END + CASE WHEN ay > 0 THEN least(30, ay * 2) ELSE 0 END + CASE WHEN ar > 0 THEN least(30, floor(log10(ar + 1) * 15 + 0.5)) ELSE 0 END AS BIGINT) AS bonus FROM quality)"""


REASONS = """SELECT listing_id, domain, quality, CASE WHEN available = false THEN 'confirmed unavailable' ELSE array_to_string(list_filter([CASE WHEN available THEN 'confirmed available' END,
  CASE WHEN length(label) > 0 THEN length(label) || ' chars' END, CASE WHEN zone <> '' THEN zone || ' priority' END, CASE WHEN regexp_matches(label, '[0-9]') THEN 'has number' END, CASE WHEN contains(label, '-') THEN 'has hyphen' END,
  CASE WHEN NOT regexp_matches(label, '[0-9-]') THEN 'clean' END, CASE WHEN zt > 0 THEN zt || ' TLDs taken' END, CASE WHEN ay > 0 THEN ay || 'y old' END, CASE WHEN ar > 0 THEN ar || ' Wayback' END,
  CASE WHEN length(a) >= 4 AND (vowels < 0.27 OR run >= 5) THEN 'low readability' END], lambda x: x IS NOT NULL)[1:8], '; ') END AS reasons FROM quality"""


@query("r1_domain_quality", f"WITH {LISTINGS}, {QUALITY} {REASONS}")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.domain_quality(market.listings(spark, sf_dir)).select("listing_id", "domain", "quality", "reasons")


@query("r3_gem_rank", f"WITH {LISTINGS}, {QUALITY} SELECT listing_id, quality, bonus, quality + bonus AS gem FROM gems")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.gem_rank(market.listings(spark, sf_dir)).select("listing_id", "quality", "bonus", "gem")


@query(
    "r2_alpha_tier",
    f"""WITH {NAMES}, n AS (SELECT DISTINCT label, zone, replace(label, '-', '') AS c FROM names), w AS (SELECT DISTINCT replace(p_name, ' ', '') AS joined FROM part)
SELECT label, zone, CASE WHEN NOT regexp_full_match(label, '[a-z]+') OR length(label) NOT BETWEEN 3 AND 14 OR zone IN ('xyz', 'shop', 'info') THEN 'weak'
WHEN (joined IS NOT NULL OR length(label) <= 7 AND coalesce(list_max(list_transform(regexp_extract_all(label, '[^aeiouy]+'), lambda x: length(x))), 0) <= 3 AND regexp_matches(label, '[aeiouy]')) AND zone IN ('com', 'ai', 'io') THEN 'alpha' ELSE 'standard' END AS tier
FROM n LEFT JOIN w ON joined = label""",
)
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = market.table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("label")).distinct().withColumn("words", F.lit(2))
    seen = market.names(spark, sf_dir).select("label", "zone").distinct().join(pairs, "label", "left")
    return ops.alpha_tier(seen, ["com", "ai", "io"], trends.ZERO_WEIGHT).select("label", "zone", "tier")


@query(
    "r4_availability_gap",
    f"WITH {LISTINGS} SELECT listing_id, CASE WHEN ends_at >= TIMESTAMP '1996-12-30' AND available THEN 'confirmed-available' WHEN ends_at >= TIMESTAMP '1996-12-30' AND available = false OR ends_at - INTERVAL 1 DAY >= TIMESTAMP '1996-12-30' AND zones_taken > 4 THEN 'taken' ELSE 'unknown' END AS com_state FROM listings WHERE zone = 'com' AND (ends_at <= TIMESTAMP '1997-01-01' OR ends_at IS NULL)",
)
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1997-01-01").cast("timestamp_ntz")
    rows = market.listings(spark, sf_dir).where((F.col("zone") == "com") & ((F.col("ends_at") <= now) | F.col("ends_at").isNull()))
    rows = rows.withColumns({"checked_at": F.col("ends_at"), "sibling_at": F.col("ends_at") - F.expr("INTERVAL 1 DAY"), "sibling": F.when(F.col("zones_taken") > 4, "taken").otherwise("free")})
    return ops.availability_gap(rows, now).select("listing_id", "com_state")


CURATED = sorted({z for zones in trends.GROUPS.values() for z in zones})


@query(
    "r5_term_signal",
    f"""WITH {NAMES}, t AS (SELECT label AS term, list(DISTINCT zone) AS zones, length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label) AS d, length(label) < 3 OR regexp_matches(label, '{"|".join(f"{c * 3}" for c in "abcdefghijklmnopqrstuvwxyz0123456789-")}') OR NOT regexp_matches(label, '[aeiouy]') AS g FROM names GROUP BY 1)
SELECT term, CASE WHEN regexp_matches(term, '{"|".join(ops.LEXICON)}') OR d >= 0.5 OR g AND d > 0 THEN 'noise' WHEN d >= 0.3 OR g THEN 'mixed' ELSE 'quality' END AS signal FROM t""",
)
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = market.names(spark, sf_dir).groupBy(F.col("label").alias("term")).agg(F.collect_set("zone").alias("zones"))
    return ops.term_signal(terms, trends.ZERO_WEIGHT, CURATED).select("term", "signal")


@query(
    "r6_rank_opportunities",
    f"""WITH {LISTINGS}, {QUALITY}, g AS (SELECT *, CASE WHEN quality < 250 THEN 'quality' WHEN price IS NULL OR price > 40000 THEN 'budget' WHEN zones_taken >= 8 THEN 'substitutes' WHEN ar = 0 THEN 'evidence' ELSE 'pass' END AS gate FROM quality)
SELECT listing_id, gate, CASE WHEN gate = 'pass' THEN CAST(floor(1e-6 + 100e0 * (35e-2 * least(quality / 6e2, 1e0) + 25e-2 * least(age_years / 3e1, 1e0) + 15e-2 * least(archive / 5e1, 1e0) + 25e-2 * (1 - price / 4e4))) AS BIGINT) ELSE 0 END AS score FROM g""",
)
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rank_opportunities(ops.domain_quality(market.listings(spark, sf_dir)), budget=40000.0, substitutes=8).select("listing_id", "gate", "score")


PRIORITY = "CASE WHEN prev_class = 'seller' AND today_class IN ('hosting', 'other') THEN 100 WHEN prev_class = 'seller' THEN 80 WHEN prev_class = 'parking' AND today_class = 'hosting' THEN 60 WHEN prev_class = 'parking' THEN 40 WHEN today_class = 'hosting' THEN 20 ELSE 0 END"


@query("r11_probe_priority", f"WITH {MOVEMENT} SELECT name, {PRIORITY} AS priority FROM movement")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.probe_priority(movement(spark, sf_dir)).select("name", "priority")


ASSESSED = f"""{MOVEMENT}, co AS (SELECT today_key, count(*) AS cohort FROM movement WHERE kind = 'changed' GROUP BY 1),
assessed AS (SELECT name, CASE WHEN prev_class IS NULL OR kind = 'dropped' THEN prev_class END AS x, prev_class, today_class, kind, cohort,
  CASE WHEN prev_class NOT IN ('seller', 'parking') THEN 'not-listed-before' WHEN kind = 'dropped' THEN 'delegation-removed' WHEN today_class IN ('seller', 'parking') THEN 'still-on-a-lander' WHEN cohort >= 10 THEN 'coordinated-migration'
    WHEN today_class = 'registrar' THEN 'registrar-default' WHEN today_class = 'hosting' THEN 'live-destination' ELSE 'other-destination' END AS basis FROM movement m LEFT JOIN co USING (today_key)),
tiers AS (SELECT *, CASE WHEN basis IN ('registrar-default', 'other-destination') THEN 'suspected' WHEN basis = 'live-destination' THEN 'probable' ELSE 'excluded' END AS tier FROM assessed)"""


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = movement(spark, sf_dir)
    cohorts = moves.where("kind = 'changed'").groupBy("today_key").agg(F.count("*").alias("cohort"))
    return ops.assess_sales(moves.join(cohorts, "today_key", "left"))


@query("r9_assess_sales", f"WITH {ASSESSED} SELECT name, tier, basis FROM tiers")
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("name", "tier", "basis")


@query("r12_ledger_views", f"WITH {ASSESSED} SELECT name, 'all' AS view FROM tiers UNION ALL SELECT name, 'leads' FROM tiers WHERE tier <> 'excluded' UNION ALL SELECT name, tier FROM tiers")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ledger_views(assessed(spark, sf_dir)).select("name", "view")

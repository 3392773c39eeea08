"""Queries of listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listings as ops
from ..sources import market
from ..sources.market import LISTINGS, NAMES, ZONES
from .registry import query

NOW = "1997-01-01 00:00:00"


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def L(select: str) -> str:
    return f"WITH {LISTINGS} {select}"


def counted_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of which a third have a lower bound of the count of zones only."""
    exact = F.col("listing_id") % 3 != 0
    return market.listings(spark, sf_dir).withColumn("zones_at_least", F.col("zones_taken") - 1).withColumn("zones_taken", F.when(exact, F.col("zones_taken")))


@query("b1_search_listings", L("SELECT listing_id, domain FROM listings WHERE stream = 'auction' AND zone IN ('com', 'io') AND (label LIKE '%ring%' OR label LIKE '%gear%') AND price BETWEEN 1000 AND 50000 AND length(label) <= 9 AND age_years BETWEEN 3 AND 27 AND coalesce(CASE WHEN listing_id % 3 <> 0 THEN zones_taken END, zones_taken - 1) >= 2 AND listing_id % 3 <> 0 AND zones_taken <= 7 AND NOT regexp_matches(label, '[0-9]') AND NOT contains(label, '-') AND bids > 0 AND archive > 0"))
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counted_listings(spark, sf_dir)
    found = ops.search_listings(counted, stream="auction", zones=["com", "io"], text="ring,gear", price=(1000, 50000), length=(None, 9), age=(3, 27), zone_count=(2, 7), no_digits=True, no_hyphens=True, has_bids=True, has_archive=True)
    return found.select("listing_id", "domain")


@query("b1_search_lower_bound", L("SELECT listing_id, domain FROM listings WHERE zone = 'com' AND CASE WHEN listing_id % 3 <> 0 THEN zones_taken ELSE zones_taken - 1 END >= 6"))
def b1_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.search_listings(counted_listings(spark, sf_dir), zones=["com"], zone_count=(6, None)).select("listing_id", "domain")


SUMMARY = f"{NAMES}, summary AS (SELECT label, list_sort(list(DISTINCT zone)) AS zones FROM names GROUP BY 1)"


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.names(spark, sf_dir).groupBy("label").agg(F.sort_array(F.collect_set("zone")).alias("zones"))


@query("b2_research", f"WITH {SUMMARY} SELECT label, array_to_string(zones, ',') AS zones FROM summary WHERE (label LIKE '%red%bolt%' OR label LIKE '%bolt%red%') AND NOT contains(label, '-') AND NOT contains(label, '7') AND NOT starts_with(label, 'xn--') AND len(zones) >= 2 AND list_contains(zones, 'com')")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.research(summary(spark, sf_dir), "red bolt -7", position="shuffle", no_hyphens=True, no_idn=True, zone="com", min_zones=2).select("label", F.array_join("zones", ",").alias("zones"))


@query("b3_search_names", f"WITH {NAMES} SELECT zone, count(*) AS n FROM names WHERE regexp_matches(label, '^(hot|cold).*[0-9]$') GROUP BY 1")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.search_names(market.names(spark, sf_dir), "^(hot|cold).*[0-9]$", "regex").groupBy("zone").agg(F.count("*").alias("n"))


@query("b4_prefix_corpus", f"WITH {NAMES} SELECT n.zone, count(DISTINCT label) AS n, bool_or(c.zone IS NOT NULL) AS complete FROM names n LEFT JOIN (SELECT DISTINCT zone FROM names WHERE kind = 'signup' AND day = DATE '2024-01-30') c ON n.zone = c.zone WHERE label LIKE 'blue%' GROUP BY 1")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    return ops.prefix_corpus(seen, "blue", seen.where("kind = 'signup' AND day = DATE '2024-01-30'"))


@query("b7_filter_drops", L("SELECT listing_id, domain FROM listings WHERE stream = 'dropped' AND length(label) BETWEEN 5 AND 12 AND label LIKE 'old%' AND NOT regexp_matches(label, '[0-9]') AND contains(label, '-') AND len(string_split(label, '-')) = 2"))
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.filter_drops(market.listings(spark, sf_dir).where("stream = 'dropped'"), length=(5, 12), keyword="old", position="starts", no_digits=True, words=2).select("listing_id", "domain")


@query("b8_expiring", L(f"SELECT listing_id, domain, stream FROM listings l WHERE ends_at > TIMESTAMP '{NOW}' AND ends_at <= TIMESTAMP '{NOW}' + INTERVAL 30 DAY AND NOT (stream = 'expiring' AND domain IN (SELECT domain FROM listings WHERE stream = 'dropped'))"))
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.expiring(market.listings(spark, sf_dir), 30, now()).select("listing_id", "domain", "stream")


@query("b9_strict_expired", L("SELECT listing_id, domain FROM listings WHERE stream = 'dropped' AND available AND domain IN (SELECT domain FROM listings WHERE stream = 'auction' AND ends_at >= TIMESTAMP '1996-12-01' AND ends_at < TIMESTAMP '1997-01-01')"))
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir)
    released = rows.where("stream = 'auction'").select("domain", F.col("ends_at").alias("released_at"))
    return ops.strict_expired(rows, released, F.lit("1996-12-01").cast("timestamp_ntz"), now()).select("listing_id", "domain")


@query(
    "b10_availability_due",
    L(f"SELECT listing_id, result FROM (SELECT listing_id, ends_at, CASE WHEN available THEN 'available' WHEN available = false THEN 'unavailable' ELSE 'unknown' END AS result FROM listings) WHERE ends_at IS NULL OR ends_at + CASE result WHEN 'available' THEN INTERVAL 24 HOUR WHEN 'unavailable' THEN INTERVAL 72 HOUR ELSE INTERVAL 6 HOUR END <= TIMESTAMP '{NOW}'"),
)
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("available"), "available").when(~F.col("available"), "unavailable").otherwise("unknown")
    rows = market.listings(spark, sf_dir).select("listing_id", result.alias("result"), F.col("ends_at").alias("checked_at"))
    return ops.availability_due(rows, now(), {"error": 1, "unknown": 6, "unavailable": 72, "available": 24}).select("listing_id", "result")


@query("b15_date_window", "SELECT event_id FROM events WHERE ts + INTERVAL 9 HOUR >= TIMESTAMP '2024-01-11' AND ts + INTERVAL 9 HOUR < TIMESTAMP '2024-01-12'")
def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.date_window(market.table(spark, sf_dir, "events"), "ts", "tomorrow", "Asia/Tokyo", datetime(2024, 1, 9, 16)).select("event_id")


@query("b16_name_parts", L("SELECT listing_id, split_part(domain, '.', 1) AS base, substr(domain, instr(domain, '.') + 1) AS rest FROM listings"))
def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.name_parts(market.listings(spark, sf_dir)).select("listing_id", "base", "rest")


@query("b17_listing_state", L(f"SELECT stream, CASE WHEN stream = 'dropped' THEN 'inactive' WHEN ends_at <= TIMESTAMP '{NOW}' THEN 'ended' ELSE 'active' END AS state, count(*) AS n FROM listings GROUP BY 1, 2"))
def b17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.listing_state(market.listings(spark, sf_dir), now()).groupBy("stream", "state").agg(F.count("*").alias("n"))


@query("b19_malformed", f"WITH {NAMES} SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '-' ELSE '' END || label || CASE WHEN event_id % 5 = 0 THEN '..' ELSE '.' END || zone AS domain FROM names WHERE event_id % 9 = 0 OR event_id % 5 = 0")
def b19(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, dots = F.when(F.col("event_id") % 9 == 0, "-").otherwise(""), F.when(F.col("event_id") % 5 == 0, "..").otherwise(".")
    return ops.malformed(market.names(spark, sf_dir).select("event_id", F.concat(start, "label", dots, "zone").alias("domain")))


@query("b20_known_values", L("SELECT DISTINCT stream FROM listings"))
def b20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.known_values(market.listings(spark, sf_dir), "stream")


@query(
    "c6_owner_matches",
    f"WITH {NAMES}, owned AS (SELECT DISTINCT label, zone FROM names WHERE user_id % 10 = 0) SELECT label, zone, CAST(min(day) AS VARCHAR) AS first_seen, string_agg(DISTINCT kind, ',' ORDER BY kind) AS sources FROM names n WHERE day >= DATE '2024-01-10' AND zone <> 'xyz' AND label IN (SELECT label FROM owned WHERE zone IN ('com', 'ai')) AND NOT EXISTS (SELECT 1 FROM owned o WHERE o.label = n.label AND o.zone = n.zone) GROUP BY 1, 2",
)
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    owned = seen.where("user_id % 10 = 0").select("label", "zone").distinct()
    found = ops.owner_matches(owned, seen.withColumn("source", F.col("kind")), F.lit("2024-01-10").cast("date"))
    return found.withColumn("first_seen", F.col("first_seen").cast("string"))


@query("c8_upgrade_targets", f"WITH {NAMES} SELECT label, t AS target FROM (SELECT DISTINCT label FROM names), (SELECT unnest(['com', 'ai', 'io']) AS t) WHERE (label, t) NOT IN (SELECT label, zone FROM names)")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.upgrade_targets(market.names(spark, sf_dir), ["com", "ai", "io", "xyz"])


@query("c9_taken_in_all", f"WITH {LISTINGS}, {NAMES} SELECT listing_id, label FROM listings WHERE label IN (SELECT label FROM names WHERE zone IN ('com', 'net') GROUP BY 1 HAVING count(DISTINCT zone) = 2)")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.taken_in(market.listings(spark, sf_dir), market.names(spark, sf_dir), ["com", "net"], "all").select("listing_id", "label")


@query("c10_sibling_candidates", L(f"SELECT DISTINCT label FROM listings WHERE zone IN ('com', 'net') AND ends_at >= TIMESTAMP '{NOW}' AND ends_at < TIMESTAMP '{NOW}' + INTERVAL 7 DAY"))
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sibling_candidates(market.listings(spark, sf_dir), ["com", "net"], now(), now() + F.expr("INTERVAL 7 DAYS"))


@query(
    "c11_zone_membership",
    f"WITH {SUMMARY}, {LISTINGS} SELECT l.label, CASE WHEN len(s.zones) >= 2 OR s.zones[1] <> 'com' THEN array_to_string(s.zones, ',') ELSE '' END AS zones, coalesce(len(s.zones) >= 2 OR s.zones[1] <> 'com', false) AS exact, CASE WHEN coalesce(len(s.zones) >= 2 OR s.zones[1] <> 'com', false) THEN '' ELSE 'com' END AS unresolved FROM (SELECT DISTINCT label FROM listings) l LEFT JOIN summary s USING (label)",
)
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = summary(spark, sf_dir)
    single = every.where(F.size("zones") == 1).select("label", F.col("zones")[0].alias("zone")).where("zone <> 'com'")
    return ops.zone_membership(market.listings(spark, sf_dir), every.where(F.size("zones") >= 2), single, ["com"])


QUOTES = "(SELECT domain, price * 2 AS live_price, bids + 1 AS live_bids, ends_at - INTERVAL 1 MINUTE * (listing_id % 40) AS quoted_at FROM listings WHERE stream = 'auction')"


@query(
    "c12_overlay",
    L(f"""SELECT l.listing_id, coalesce(q.v.live_price, l.price) AS price, coalesce(q.v.live_bids, l.bids) AS bids, q.v IS NOT NULL AS is_live FROM listings l LEFT JOIN
(SELECT domain, max_by({{'live_price': live_price, 'live_bids': live_bids}}, {{'t': quoted_at, 'p': coalesce(live_price, -1), 'b': live_bids}}) AS v FROM {QUOTES} WHERE quoted_at <= TIMESTAMP '{NOW}' AND quoted_at > TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE GROUP BY 1) q USING (domain) WHERE l.stream = 'auction'"""),
)
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir).where("stream = 'auction'")
    back = F.make_dt_interval(mins=(F.col("listing_id") % 40).cast("int"))
    live = rows.select("domain", (F.col("price") * 2).alias("live_price"), (F.col("bids") + 1).alias("live_bids"), (F.col("ends_at") - back).alias("quoted_at"))
    return ops.overlay(rows, live, now()).select("listing_id", "price", "bids", "is_live")


@query("c17_research_merge", f"WITH {NAMES}, {LISTINGS} SELECT label, array_to_string(list_sort(list(DISTINCT zone)), ',') AS zones, CAST(count(DISTINCT zone) AS INTEGER) AS n_zones FROM (SELECT label, zone FROM names UNION ALL SELECT label, zone FROM listings) GROUP BY 1")
def c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = market.listings(spark, sf_dir).groupBy("label").agg(F.collect_set("zone").alias("zones"))
    return ops.research_merge(summary(spark, sf_dir), offers).withColumn("zones", F.array_join("zones", ","))


@query(
    "c19_refresh_saved",
    L(f"""SELECT s.domain, coalesce(b.v.stream, s.stream) AS stream, CASE WHEN b.v IS NOT NULL THEN b.v.price ELSE s.price END AS price, b.v IS NOT NULL AS is_current FROM (SELECT * FROM listings WHERE listing_id % 97 = 0) s
LEFT JOIN (SELECT domain, min_by({{'stream': stream, 'price': price}}, {{'e': coalesce(ends_at, TIMESTAMP '9999-01-01'), 'i': listing_id}}) AS v FROM listings WHERE ends_at IS NULL OR ends_at > TIMESTAMP '{NOW}' GROUP BY 1) b USING (domain)"""),
)
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir)
    return ops.refresh_saved(rows.where("listing_id % 97 = 0").drop("listing_id"), rows, now()).drop("ends_at")


@query(
    "d11_stats",
    L("SELECT stream, zone, metric, n FROM (SELECT stream, zone, count(*) FILTER (WHERE ends_at <= TIMESTAMP '" + NOW + "') AS expired, count(*) FILTER (WHERE stream <> 'dropped' AND (ends_at IS NULL OR ends_at > TIMESTAMP '" + NOW + "')) AS active, " + ", ".join(f"count(*) FILTER (WHERE stream <> 'dropped' AND ends_at > TIMESTAMP '{NOW}' AND ends_at <= TIMESTAMP '{NOW}' + INTERVAL {d} DAY) AS expiring_{d}d" for d in (1, 7, 14, 30, 60, 90)) + " FROM listings GROUP BY 1, 2) UNPIVOT (n FOR metric IN (active, expired, expiring_1d, expiring_7d, expiring_14d, expiring_30d, expiring_60d, expiring_90d))"),
)
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stats(market.listings(spark, sf_dir), now())


@query(
    "d12_breakdowns",
    L("SELECT dim, item, n FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, item) AS r FROM (SELECT dim, item, count(*) AS n FROM (SELECT unnest(['stream', 'zone', 'archive']) AS dim, unnest([stream, zone, coalesce(CAST(archive AS VARCHAR), 'unknown')]) AS item FROM listings) GROUP BY 1, 2)) WHERE r <= 20"),
)
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.breakdowns(market.listings(spark, sf_dir), ["stream", "zone", "archive"])


@query("w1_kit_sample", L("SELECT listing_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY price DESC NULLS LAST, listing_id) AS r FROM listings) WHERE r <= 3"))
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.kit_sample(market.listings(spark, sf_dir), "label", [F.desc_nulls_last("price"), "listing_id"]).select("listing_id", "domain")


@query(
    "w2_select_due",
    L("""SELECT listing_id, lane FROM (SELECT listing_id, 'priority' AS lane FROM listings ORDER BY price DESC NULLS LAST, listing_id LIMIT 900)
UNION ALL SELECT listing_id, lane FROM (SELECT listing_id, 'oldest' AS lane FROM listings WHERE listing_id NOT IN (SELECT listing_id FROM listings ORDER BY price DESC NULLS LAST, listing_id LIMIT 900) ORDER BY ends_at NULLS FIRST, listing_id LIMIT 100)"""),
)
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.select_due(market.listings(spark, sf_dir), 1000, [F.desc_nulls_last("price"), "listing_id"], [F.asc_nulls_first("ends_at"), "listing_id"], "listing_id")
    return found.select("listing_id", "lane")


@query("w3_latest_per_key", L("SELECT domain, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY (bids > 0) DESC, ends_at DESC NULLS LAST, listing_id) AS r FROM listings) WHERE r = 1"))
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_per_key(market.listings(spark, sf_dir), ["domain"], [F.desc(F.col("bids") > 0), F.desc_nulls_last("ends_at"), "listing_id"]).select("domain", "listing_id")


@query("w4_keyset_page", L("SELECT listing_id, price FROM listings WHERE price < 20000 OR price = 20000 AND listing_id > 500 ORDER BY price DESC, listing_id LIMIT 100"))
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyset_page(market.listings(spark, sf_dir), (20000.0, 500), 100).select("listing_id", "price")


@query("w5_ranked_page", L("SELECT listing_id, count(*) OVER () AS total, count(*) OVER () > 150 AS has_more FROM listings WHERE stream = 'auction' QUALIFY row_number() OVER (ORDER BY price DESC NULLS LAST, listing_id) BETWEEN 101 AND 150"))
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir).where("stream = 'auction'")
    return ops.ranked_page(rows, [F.desc_nulls_last("price"), F.asc("listing_id")], 100, 50).select("listing_id", "total", "has_more")


@query("w8_round_robin", L("SELECT listing_id, zone FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY ends_at NULLS FIRST, listing_id) AS t FROM listings) ORDER BY t, zone LIMIT 100"))
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.round_robin(market.listings(spark, sf_dir), "zone", ["ends_at", "listing_id"], 100).select("listing_id", "zone")


@query(
    "w9_fair_order",
    L("SELECT listing_id, stream FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ends_at, listing_id) / CASE stream WHEN 'auction' THEN 3 ELSE 1 END AS t FROM (SELECT * FROM listings WHERE stream IN ('auction', 'expiring') AND ends_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ends_at, listing_id) = 1)) ORDER BY t, stream LIMIT 200"),
)
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fair_order(market.listings(spark, sf_dir), {"auction": 3, "expiring": 1}, 200).select("listing_id", "stream")


@query(
    "w10_eligible_topk",
    L("SELECT listing_id, cohort_size FROM (SELECT *, count(*) OVER (PARTITION BY label) AS cohort_size FROM listings) WHERE cohort_size < 10 AND domain NOT IN (SELECT domain FROM listings WHERE bids = 4) ORDER BY cohort_size, price DESC NULLS LAST, listing_id LIMIT 50"),
)
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir)
    return ops.eligible_topk(rows, rows.where("bids = 4").select("domain"), "label", ["cohort_size", F.desc_nulls_last("price"), "listing_id"], 50).select("listing_id", "cohort_size")


@query(
    "w11_diverse_examples",
    L("SELECT label, listing_id, CAST(row_number() OVER (PARTITION BY label ORDER BY t, listing_id) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY label, zone ORDER BY listing_id) AS t FROM listings) QUALIFY row_number() OVER (PARTITION BY label ORDER BY t, listing_id) <= 12"),
)
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.diverse_examples(market.listings(spark, sf_dir), "label", "zone", ["listing_id"]).select("label", "listing_id", "place")


@query("w12_day_sample", L("SELECT listing_id FROM listings ORDER BY md5('2024-01-01' || CAST(listing_id AS VARCHAR)), listing_id LIMIT 500"))
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.day_sample(market.listings(spark, sf_dir), "2024-01-01", 500, "listing_id").select("listing_id")


@query("w15_inventory_demand", L(f"SELECT label, CAST(min(CAST(ends_at AS DATE)) AS VARCHAR) AS first_end FROM listings WHERE ends_at IS NULL OR ends_at > TIMESTAMP '{NOW}' GROUP BY 1"))
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.inventory_demand(market.listings(spark, sf_dir), now()).select("label", F.to_date("first_end").cast("string").alias("first_end"))


@query(
    "d30_wider_counts",
    f"WITH {NAMES} SELECT d AS days, (SELECT count(*) FROM names WHERE contains(label, 'ring') AND day <= DATE '2024-01-30' AND day > DATE '2024-01-30' - d) AS n FROM (SELECT unnest([7, 14, 30]) AS d)",
)
def d30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.wider_counts(market.names(spark, sf_dir).where(F.contains("label", F.lit("ring"))), "day", F.lit("2024-01-30").cast("date"), [7, 14, 30])

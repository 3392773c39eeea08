"""Queries of coverage and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage as ops
from ..operators.trends import ZERO_WEIGHT
from ..sources import market
from ..sources.market import LISTINGS, NAMES, ZONES
from .registry import query

FIRST, LAST = "2024-01-01", "2024-01-30"
W = f"WITH {NAMES}"


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = market.names(spark, sf_dir).select("zone").distinct()
    return ops.expected_days(zones, F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))


SPINE = f"spine AS (SELECT zone, CAST(d AS DATE) AS day FROM (SELECT DISTINCT zone FROM names), (SELECT unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS d))"


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for each zone and day on which something was viewed."""
    seen = market.names(spark, sf_dir).where("kind = 'view'").groupBy("zone", "day").agg(F.count("*").alias("observed"), F.max("event_id").alias("m"))
    status = F.when(F.col("m") % 17 == 0, "partial").otherwise("complete")
    return seen.select("zone", "day", status.alias("status"), "observed", F.floor(F.col("observed") / 2).cast("long").alias("available"), (F.col("observed") - F.floor(F.col("observed") / 2) - (F.col("m") % 7 == 0).cast("int") - (F.col("m") % 5 == 0).cast("int")).alias("unavailable"), (F.col("m") % 7 == 0).cast("int").alias("unknown"))


RECEIPTS = "receipts AS (SELECT zone, day, CASE WHEN m % 17 = 0 THEN 'partial' ELSE 'complete' END AS status, observed, observed // 2 AS available, observed - observed // 2 - CAST(m % 7 = 0 AS INTEGER) - CAST(m % 5 = 0 AS INTEGER) AS unavailable, CAST(m % 7 = 0 AS INTEGER) AS unknown FROM (SELECT zone, day, count(*) AS observed, max(event_id) AS m FROM names WHERE kind = 'view' GROUP BY 1, 2))"


@query(
    "d9_drop_coverage",
    f"""{W}, {SPINE}, {RECEIPTS}, kept AS (SELECT zone, day, count(*) AS kept FROM names WHERE kind = 'view' AND event_id % 101 <> 0 GROUP BY 1, 2)
SELECT zone, CAST(day AS VARCHAR) AS day, reason, reason = 'ok' AS complete FROM (SELECT zone, day, CASE WHEN status IS NULL THEN 'missing' WHEN status <> 'complete' THEN 'not-complete' WHEN unknown > 0 THEN 'unknown' WHEN available + unavailable + unknown <> observed THEN 'unaccounted' WHEN coalesce(kept, 0) <> observed THEN 'events-differ' ELSE 'ok' END AS reason
FROM spine LEFT JOIN receipts USING (zone, day) LEFT JOIN kept USING (zone, day))""",
)
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = market.names(spark, sf_dir).where("kind = 'view' AND event_id % 101 <> 0")
    found = ops.drop_coverage(spine(spark, sf_dir), receipts(spark, sf_dir), events, ["zone", "day"])
    return found.select("zone", F.col("day").cast("string").alias("day"), "reason", "complete")


@query(
    "d9_window_end",
    f"{W}, s AS (SELECT zone, day, max(event_id) % 3 <> 0 AS ok FROM names WHERE kind = 'click' GROUP BY 1, 2), z AS (SELECT n.zone, newest FROM (SELECT DISTINCT zone FROM names) n LEFT JOIN (SELECT zone, max(day) AS newest FROM s WHERE ok GROUP BY 1) USING (zone)) SELECT CAST(CASE WHEN bool_and(newest IS NOT NULL) THEN min(newest) END AS VARCHAR) AS window_end FROM z",
)
def d9_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    status = seen.where("kind = 'click'").groupBy("zone", "day").agg(F.when(F.max("event_id") % 3 != 0, "ok").otherwise("stale").alias("status"))
    return ops.window_end(seen, status).select(F.col("window_end").cast("string").alias("window_end"))


@query(
    "d24_registration_coverage",
    f"""{W}, {SPINE}, r AS (SELECT zone, day, max(event_id) AS m FROM names WHERE kind = 'signup' GROUP BY 1, 2), x AS (SELECT s.day, s.zone, coalesce(m % 19 <> 0 AND NOT m % 23 = 0, false) AS good, CASE WHEN m IS NOT NULL THEN CASE WHEN m % 29 = 0 THEN 'sampled' ELSE 'full' END END AS methodology FROM spine s LEFT JOIN r USING (zone, day))
SELECT CAST(day AS VARCHAR) AS day, bool_and(good) AND count(DISTINCT methodology) = 1 AS complete, CASE WHEN count(DISTINCT methodology) = 1 THEN min(methodology) ELSE 'mixed' END AS methodology, coalesce(string_agg(DISTINCT zone, ',' ORDER BY zone) FILTER (WHERE NOT good), '') AS missing FROM x GROUP BY 1""",
)
def d24(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).where("kind = 'signup'").groupBy("zone", "day").agg(F.max("event_id").alias("m"))
    got = seen.select("zone", "day", (F.col("m") % 19 != 0).alias("complete"), (F.col("m") % 23 == 0).alias("capped"), F.when(F.col("m") % 29 == 0, "sampled").otherwise("full").alias("methodology"))
    return ops.registration_coverage(spine(spark, sf_dir), got).withColumn("day", F.col("day").cast("string"))


@query(
    "d25_movement_coverage",
    f"""{W}, m AS (SELECT day, user_id % 5 AS run, max(event_id) % 3 <> 0 AS complete, max(event_id) % 4 <> 0 AS retained, list(DISTINCT zone) AS zones FROM names WHERE day <> DATE '2024-01-12' GROUP BY 1, 2), b AS (SELECT day, max(run) AS run, max_by(zones, run) AS zones, max_by(retained, run) AS retained FROM m WHERE complete GROUP BY 1)
SELECT *, missing = '' AND consecutive AND retained AS whole FROM (SELECT CAST(day AS VARCHAR) AS day, run, retained, array_to_string(list_sort(list_filter([{", ".join(repr(z) for z in sorted(ZONES))}], lambda z: NOT list_contains(zones, z))), ',') AS missing, coalesce(date_diff('day', lag(day) OVER (ORDER BY day), day) = 1, false) AS consecutive FROM b)""",
)
def d25(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).where("day <> DATE '2024-01-12'").groupBy("day", (F.col("user_id") % 5).alias("run"))
    manifests = seen.agg((F.max("event_id") % 3 != 0).alias("complete"), (F.max("event_id") % 4 != 0).alias("retained"), F.collect_set("zone").alias("zones"))
    return ops.movement_coverage(manifests, ZONES).withColumn("day", F.col("day").cast("string"))


@query("d23_validate_snapshot", f"WITH {LISTINGS}, k AS (SELECT domain, stream, count(*) AS c, count(ends_at) AS t FROM listings GROUP BY 1, 2) SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c - 1) AS BIGINT) AS duplicates, round(sum(t) / sum(c), 6) AS timed, CASE WHEN sum(c) < 1000 THEN 'too-few' WHEN sum(c) < 0.8 * 1000 THEN 'dropped' WHEN sum(c - 1) > 0 THEN 'duplicates' WHEN sum(t) < 0.5 * sum(c) THEN 'untimed' ELSE 'ok' END AS verdict FROM k")
def d23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.validate_snapshot(market.listings(spark, sf_dir), ["domain", "stream"], "ends_at", least=1000, previous=1000)


@query(
    "d23_gate_observation",
    f"{W}, r AS (SELECT zone, CASE WHEN event_id % 23 = 0 THEN 'unknown' WHEN event_id % (3 + user_id % 5) = 0 THEN 'lost' ELSE 'seen' END AS result FROM names) SELECT zone, count(*) AS n, count(*) FILTER (WHERE result = 'unknown') AS unknown, count(*) FILTER (WHERE result = 'lost') AS lost, count(*) >= 50 AND count(*) FILTER (WHERE result = 'unknown') <= 0.05 * count(*) AND count(*) FILTER (WHERE result = 'lost') <= 0.2 * count(*) AS passed FROM r GROUP BY 1",
)
def d23_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("event_id") % 23 == 0, "unknown").when(F.col("event_id") % (3 + F.col("user_id") % 5) == 0, "lost").otherwise("seen")
    return ops.gate_observation(market.names(spark, sf_dir).select("zone", result.alias("result")), "zone")


@query(
    "d19_built_rate",
    f"{W}, s AS (SELECT DISTINCT label || '.' || zone AS name, zone FROM names), e AS (SELECT label || '.' || zone AS name, bool_or(kind = 'purchase') AS built FROM names WHERE kind IN ('purchase', 'error') GROUP BY 1) SELECT zone, count(built) AS known, count(*) FILTER (WHERE built) AS built, round(count(*) FILTER (WHERE built) / count(built), 6) AS rate FROM s LEFT JOIN e USING (name) GROUP BY 1",
)
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).withColumn("name", F.concat_ws(".", "label", "zone"))
    evidence = seen.where("kind IN ('purchase', 'error')").groupBy("name").agg(F.bool_or(F.col("kind") == "purchase").alias("built"))
    return ops.built_rate(seen.select("name", "zone").distinct(), evidence, "zone")


@query(
    "d27_intake_coverage",
    f"{W}, c AS (SELECT day, kind <> 'view' AS probed, CASE kind WHEN 'error' THEN 'timeout' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'refused' END END AS reason FROM names), g AS (SELECT day, reason, count(*) AS c, count(*) FILTER (WHERE probed) AS p, count(reason) AS f FROM c GROUP BY 1, 2) SELECT CAST(day AS VARCHAR) AS day, CAST(sum(c) AS BIGINT) AS candidates, CAST(sum(p) AS BIGINT) AS probed, CAST(sum(f) AS BIGINT) AS failed, string_agg(reason || ':' || CAST(c AS VARCHAR), ',' ORDER BY reason || ':' || CAST(c AS VARCHAR)) FILTER (WHERE reason IS NOT NULL) AS reasons FROM g GROUP BY 1",
)
def d27(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("kind") == "error", "timeout").when((F.col("kind") == "click") & (F.col("event_id") % 3 == 0), "refused")
    cands = market.names(spark, sf_dir).select("day", (F.col("kind") != "view").alias("probed"), reason.alias("reason"))
    return ops.intake_coverage(cands).withColumn("day", F.col("day").cast("string"))


@query(
    "d29_backlog",
    f"{W} SELECT CASE WHEN h < 0 THEN 'not-due' WHEN h < 24 THEN 'day' WHEN h < 168 THEN 'week' ELSE 'older' END AS bucket, zone, count(*) AS n FROM (SELECT zone, floor((epoch(TIMESTAMP '2024-01-25') - floor(epoch(ts))) / 3600) AS h FROM names) GROUP BY 1, 2",
)
def d29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.backlog(market.names(spark, sf_dir).withColumnRenamed("ts", "due_at"), F.lit("2024-01-25").cast("timestamp_ntz"))


@query(
    "c21_reconcile_cells",
    f"""{W}, p AS (SELECT label AS base, zone, max(ts) AS seen_at, bool_or(kind = 'purchase') AS registry FROM names WHERE kind IN ('purchase', 'view') GROUP BY 1, 2), n AS (SELECT label AS base, zone, max(ts) AS clear_at FROM names WHERE kind = 'error' GROUP BY 1, 2)
SELECT base, zone, CASE WHEN seen_at IS NULL OR clear_at > seen_at THEN 'free' WHEN registry THEN 'taken' ELSE 'unresolved' END AS verdict FROM p FULL JOIN n USING (base, zone)""",
)
def c21(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).select(F.col("label").alias("base"), "zone", F.col("ts").alias("at"), "kind")
    positive = seen.where("kind IN ('purchase', 'view')").withColumn("source", F.when(F.col("kind") == "purchase", "registry").otherwise("page"))
    return ops.reconcile_cells(positive, seen.where("kind = 'error'"))


@query(
    "c20_merge_ledger",
    f"""{W}, d AS (SELECT label || '.' || zone AS domain, day, value, kind FROM names WHERE zone NOT IN ({", ".join(repr(z) for z in ZERO_WEIGHT)})), u AS (SELECT domain, day, value, 'curated' AS source, 0 AS r FROM d WHERE kind = 'purchase' UNION ALL SELECT domain, day, value, 'discovery', 1 FROM d WHERE kind = 'click' UNION ALL SELECT domain, day, value, 'rebuilt', 2 FROM d WHERE kind = 'view')
SELECT domain, CAST(day AS VARCHAR) AS day, value, source FROM u QUALIFY row_number() OVER (PARTITION BY domain ORDER BY day DESC, r, value DESC) = 1""",
)
def c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).withColumn("domain", F.concat_ws(".", "label", "zone"))
    pick = lambda kind: seen.where(F.col("kind") == kind)
    return ops.merge_ledger(("curated", pick("purchase")), ("discovery", pick("click")), ("rebuilt", pick("view")), left_out=ZERO_WEIGHT).withColumn("day", F.col("day").cast("string"))


@query(
    "b12_sibling_evidence",
    f"{W}, t AS (SELECT DISTINCT label, zone FROM names), c AS (SELECT zone FROM names GROUP BY 1 HAVING max(event_id) % 2 = 0) SELECT l.label, z.zone, CASE WHEN t.label IS NOT NULL THEN 'taken' WHEN c.zone IS NOT NULL THEN 'not_taken' ELSE 'unknown' END AS state FROM (SELECT DISTINCT label FROM names) l CROSS JOIN (SELECT unnest(['com', 'net', 'ai', 'io']) AS zone) z LEFT JOIN t ON t.label = l.label AND t.zone = z.zone LEFT JOIN c ON c.zone = z.zone",
)
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    covered = seen.groupBy("zone").agg(F.max("event_id").alias("m")).where("m % 2 = 0")
    return ops.sibling_evidence(seen, seen, covered, ["com", "net", "ai", "io"])

"""Queries of zone scans, diffs and movement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import zones
from ..sources import market
from ..sources.market import CLASSES, NAMES, SPLIT_DAY
from .registry import query


def zone_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a zone file has them: relative and absolute owners, TTLs, other record types, the apex."""
    seen = market.names(spark, sf_dir)
    owner = F.when(F.col("event_id") % 2 == 0, F.col("label")).otherwise(F.concat("label", F.lit("."), "zone", F.lit(".")))
    middle = F.when(F.col("event_id") % 3 == 0, "\t86400\tIN\t").otherwise(" ")
    record = F.when(F.col("event_id") % 10 == 9, "A").otherwise("NS")
    line = F.concat(F.upper(owner), middle, record, F.lit(" "), "host", F.lit("."))
    return seen.select("zone", line.alias("value"))


ZONE_RECORDS = f"{NAMES}, records AS (SELECT label || '.' || zone AS name, host, zone FROM names WHERE event_id % 10 <> 9)"


@query("a1_zone_records", f"WITH {ZONE_RECORDS} SELECT name, host, count(*) AS n FROM records GROUP BY 1, 2")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zones.zone_records(zone_text(spark, sf_dir), F.col("zone"))
    return found.groupBy("name", "host").agg(F.count("*").alias("n"))


@query("a2_delegations", f"WITH {ZONE_RECORDS} SELECT name, array_to_string(list_sort(list(DISTINCT host)), ',') AS ns FROM records GROUP BY 1")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zones.delegations(zones.zone_records(zone_text(spark, sf_dir), F.col("zone")))
    return found.select("name", F.array_join("ns", ",").alias("ns"))


@query("a3_zone_labels", f"WITH {NAMES} SELECT DISTINCT label, zone FROM names")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    deep = seen.where("event_id % 5 = 0").select(F.concat(F.lit("www."), "label", F.lit("."), "zone").alias("name"), "zone")
    return zones.zone_labels(seen.select(F.concat_ws(".", "label", "zone").alias("name"), "zone").union(deep), F.col("zone"))


@query(
    "a4_seller_delegations",
    f"WITH {NAMES}, {CLASSES} SELECT name, f.host AS host, f.provider AS provider FROM (SELECT label || '.' || zone AS name, min({{'host': host, 'provider': provider}}) AS f FROM names JOIN classes ON class = 'seller' AND (host = provider OR ends_with(host, '.' || provider)) GROUP BY 1)",
)
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    sellers = market.host_classes(spark).where("class = 'seller'")
    return zones.seller_delegations(market.names(spark, sf_dir).select(F.concat_ws(".", "label", "zone").alias("name"), "host"), sellers)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Delegations seen until the split day and after it."""
    seen = market.names(spark, sf_dir).select(F.concat_ws(".", "label", "zone").alias("name"), "host", "day")
    return zones.delegations(seen.where(F.col("day") <= F.lit(SPLIT_DAY))), zones.delegations(seen.where(F.col("day") > F.lit(SPLIT_DAY)))


SNAPSHOTS = f"""{NAMES}, {CLASSES},
prev AS (SELECT label || '.' || zone AS name, array_to_string(list_sort(list(DISTINCT host)), ',') AS ns FROM names WHERE day <= DATE '{SPLIT_DAY}' GROUP BY 1),
today AS (SELECT label || '.' || zone AS name, array_to_string(list_sort(list(DISTINCT host)), ',') AS ns FROM names WHERE day > DATE '{SPLIT_DAY}' GROUP BY 1),
diff AS (SELECT coalesce(p.name, t.name) AS name, CASE WHEN p.name IS NULL THEN 'added' WHEN t.name IS NULL THEN 'dropped' WHEN p.ns = t.ns THEN 'unchanged' ELSE 'changed' END AS kind,
  p.ns AS prev, t.ns AS today FROM prev p FULL JOIN today t ON p.name = t.name)"""


@query("c1_snapshot_diff", f"WITH {SNAPSHOTS} SELECT name, kind, prev, today FROM diff")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zones.diff_snapshots(*snapshots(spark, sf_dir), "name", "ns")
    return found.select("name", "kind", F.array_join("prev", ",").alias("prev"), F.array_join("today", ",").alias("today"))


@query(
    "c2_dropped_names",
    f"WITH {SNAPSHOTS}, s AS (SELECT label, count(DISTINCT zone) AS n_zones FROM names GROUP BY 1) SELECT label, n_zones FROM (SELECT DISTINCT label FROM names WHERE day <= DATE '{SPLIT_DAY}') JOIN s USING (label) WHERE label NOT IN (SELECT label FROM names WHERE day > DATE '{SPLIT_DAY}')",
)
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    summary = seen.groupBy("label").agg(F.count_distinct("zone").alias("n_zones"))
    return zones.dropped(seen.where(F.col("day") <= F.lit(SPLIT_DAY)), seen.where(F.col("day") > F.lit(SPLIT_DAY)), "label", summary)


@query("c2_added_names", f"WITH {SNAPSHOTS} SELECT t.name FROM today t WHERE t.name NOT IN (SELECT name FROM prev)")
def c2_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.added(*snapshots(spark, sf_dir), "name")


@query("c3_set_moves", f"WITH {SNAPSHOTS} SELECT name, 'exit' AS move FROM diff WHERE kind = 'dropped' UNION ALL SELECT name, 'entry' FROM diff WHERE kind = 'added'")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.set_moves(*snapshots(spark, sf_dir), "name")


HOST_CLASS = "hc AS (SELECT host, coalesce(max(class), 'other') AS class FROM (SELECT DISTINCT host FROM names) n LEFT JOIN classes ON n.host = provider OR ends_with(n.host, '.' || provider) GROUP BY 1)"


@query("c4_classify_hosts", f"WITH {NAMES}, {CLASSES}, {HOST_CLASS} SELECT host, class FROM hc")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.classify_hosts(market.names(spark, sf_dir), market.host_classes(spark))


def _rank(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(zones.PRIORITY)) + " END"


@query(
    "c5_classify_ns",
    f"WITH {NAMES}, {CLASSES}, {HOST_CLASS} SELECT label || '.' || zone AS name, array_to_string(list_sort(list(DISTINCT host)), ',') AS ns_key, min_by(class, {_rank('class')}) AS class FROM names JOIN hc USING (host) GROUP BY 1",
)
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).select(F.concat_ws(".", "label", "zone").alias("name"), "host")
    return zones.classify_ns(zones.delegations(seen), zones.classify_hosts(seen, market.host_classes(spark)))


def movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, today = snapshots(spark, sf_dir)
    classes = zones.classify_hosts(market.names(spark, sf_dir), market.host_classes(spark))
    diff = zones.diff_snapshots(prev, today, "name", "ns").select("name", "kind")
    a = zones.classify_ns(prev, classes).select("name", F.col("ns_key").alias("prev_key"), F.col("class").alias("prev_class"))
    b = zones.classify_ns(today, classes).select("name", F.col("ns_key").alias("today_key"), F.col("class").alias("today_class"))
    return diff.join(a, "name", "left").join(b, "name", "left")


MOVEMENT = f"""{SNAPSHOTS}, {HOST_CLASS},
pc AS (SELECT label || '.' || zone AS name, min_by(class, {_rank("class")}) AS class FROM names JOIN hc USING (host) WHERE day <= DATE '{SPLIT_DAY}' GROUP BY 1),
tc AS (SELECT label || '.' || zone AS name, min_by(class, {_rank("class")}) AS class FROM names JOIN hc USING (host) WHERE day > DATE '{SPLIT_DAY}' GROUP BY 1),
movement AS (SELECT d.name, d.kind, d.prev AS prev_key, pc.class AS prev_class, d.today AS today_key, tc.class AS today_class FROM diff d LEFT JOIN pc USING (name) LEFT JOIN tc USING (name)),
marks AS (SELECT *, kind = 'changed' AND prev_class IN ('seller', 'parking') AND today_class IN ('hosting', 'registrar', 'other') AS dep, kind = 'changed' AND prev_class <> 'hosting' AND today_class = 'hosting' AS live,
  kind = 'changed' AND prev_class NOT IN ('seller', 'parking') AND today_class IN ('seller', 'parking') AS listed FROM movement),
selected AS (SELECT name, kind, prev_class, today_class, 'departures' AS selection FROM marks WHERE dep UNION ALL SELECT name, kind, prev_class, today_class, 'went-live' FROM marks WHERE live
  UNION ALL SELECT name, kind, prev_class, today_class, 'listed' FROM marks WHERE listed UNION ALL SELECT name, kind, prev_class, today_class, 'changed' FROM marks WHERE kind = 'changed' AND NOT dep AND NOT live AND NOT listed
  UNION ALL SELECT name, kind, prev_class, today_class, 'delegation-removed' FROM marks WHERE kind = 'dropped')"""


@query("b6_select_movement", f"WITH {MOVEMENT} SELECT * FROM selected")
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.select_movement(movement(spark, sf_dir)).select("name", "kind", "prev_class", "today_class", "selection")


@query("b5_filter_movement", f"WITH {MOVEMENT} SELECT * FROM selected WHERE selection = 'departures' AND prev_class = 'parking' AND contains(name, 'ring') AND ends_with(name, '.net')")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = zones.select_movement(movement(spark, sf_dir)).select("name", "kind", "prev_class", "today_class", "selection")
    return zones.filter_movement(rows, selection="departures", from_class="parking", contains="ring", zone="net")


@query(
    "d2_movement_summary",
    f"""WITH {MOVEMENT} SELECT 'kind' AS section, kind AS item, count(*) AS n FROM movement GROUP BY 2
UNION ALL SELECT 'transition', prev_class || '>' || today_class, count(*) FROM movement WHERE kind = 'changed' GROUP BY 2
UNION ALL (SELECT 'lost', prev_key, count(*) FROM movement WHERE kind = 'changed' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 40)
UNION ALL (SELECT 'gained', today_key, count(*) FROM movement WHERE kind = 'changed' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 40)""",
)
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.movement_summary(movement(spark, sf_dir))


@query("c18_recover_removed", f"WITH {SNAPSHOTS} SELECT name, prev AS ns FROM diff WHERE kind = 'dropped'")
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev, today = snapshots(spark, sf_dir)
    drops = zones.diff_snapshots(prev, today, "name", "ns").where("kind = 'dropped'")
    return zones.recover_removed(drops, prev).select("name", F.array_join("ns", ",").alias("ns"))


@query(
    "d1_universe_summary",
    f"WITH {NAMES}, u AS (SELECT label, list_sort(list(DISTINCT zone)) AS z FROM names GROUP BY 1) SELECT label, CAST(len(z) AS INTEGER) AS n_zones, array_to_string(z, ',') AS zones FROM u WHERE len(z) >= 2 OR z[1] <> 'com'",
)
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.universe_summary(market.names(spark, sf_dir)).select("label", "n_zones", F.array_join("zones", ",").alias("zones"))


@query(
    "s1_listed_universe",
    f"WITH {NAMES}, b AS (SELECT DISTINCT label, 'provider' AS s FROM names WHERE kind = 'purchase' UNION SELECT DISTINCT label, 'zone' FROM names WHERE kind = 'view') SELECT label, string_agg(s, ',' ORDER BY s) AS sources FROM b GROUP BY 1",
)
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    return zones.listed_universe(seen.where("kind = 'purchase'"), seen.where("kind = 'view'"), "label")


@query("s2_union_events", f"WITH {NAMES} SELECT label, zone, CAST(day AS VARCHAR) AS day, value, 'add' AS kind FROM names WHERE kind = 'signup' UNION ALL SELECT label, zone, CAST(day AS VARCHAR), NULL, 'drop' FROM names WHERE kind = 'error'")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    adds = seen.where("kind = 'signup'").select("label", "zone", "day", "value")
    return zones.union_events(adds, seen.where("kind = 'error'").select("label", "zone", "day")).withColumn("day", F.col("day").cast("string"))


@query(
    "s3_set_compare",
    f"WITH {SNAPSHOTS} SELECT CASE kind WHEN 'dropped' THEN 'left' WHEN 'added' THEN 'right' ELSE 'both' END AS part, count(*) AS n FROM diff GROUP BY 1",
)
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.set_compare(*snapshots(spark, sf_dir), ["name"])


@query(
    "c15_changed_since_previous",
    f"""WITH {NAMES}, l AS (SELECT *, lag(ts) OVER w AS pts, lag(host) OVER w AS ph FROM names WINDOW w AS (PARTITION BY label || '.' || zone ORDER BY ts, event_id))
SELECT event_id, host, CASE WHEN pts >= ts - INTERVAL 14 DAY THEN ph END AS previous, coalesce(CASE WHEN pts >= ts - INTERVAL 14 DAY THEN ph END <> host, false) AS changed FROM l""",
)
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).withColumn("name", F.concat_ws(".", "label", "zone"))
    return zones.changed_since_previous(seen, "name", "ts", "host").select("event_id", "host", "previous", "changed")

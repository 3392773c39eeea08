"""Queries of streaming jobs and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import market
from ..sources.market import NAMES, ZONES
from ..operators.ranking import shared_folder
from ..streaming import events as ops
from ..streaming import machines, reimport
from ..streaming.ordered import run_ordered
from .registry import query

W = f"WITH {NAMES}"


def name_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings as a stream: the event stream joined to the static part table."""
    events = ops.read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return name_rows(events, market.table(spark, sf_dir, "part"))


def name_rows(events: DataFrame, part: DataFrame) -> DataFrame:
    label = F.lower(F.replace("p_name", F.lit(" "), F.lit("")))
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), ((F.col("event_id") + F.col("user_id")) % 8 + 1).cast("int"))
    parts = part.agg(F.max("p_partkey") + 1).first()[0]  # one number
    joined = events.join(part, F.col("event_id") % parts == F.col("p_partkey"))
    return joined.select("event_id", "ts", F.col("event_type").alias("kind"), label.alias("label"), zone.alias("zone"))


STREAM = "st AS (SELECT event_id, ts, day, kind, zone, replace(regexp_replace(label, '[0-9]', '', 'g'), '-', '') AS label FROM names)"


@query("k10_window_counts", f"{W} SELECT event_type AS kind, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ops.drain(ops.window_counts(name_stream(spark, sf_dir), "day", "kind"), "complete")
    return counts.select("kind", F.unix_micros("start").alias("start_us"), "n")


@query("k2_dedupe_stream", f"{W}, {STREAM} SELECT label, zone, count(*) AS n FROM (SELECT DISTINCT label, zone FROM st) GROUP BY 1, 2")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = name_stream(spark, sf_dir).withColumn("name", F.concat_ws(".", "label", "zone"))
    return ops.drain(ops.dedupe_stream(stream, "name", keep="60 days")).groupBy("label", "zone").agg(F.count("*").alias("n"))


@query(
    "k1_launches",
    f"""{W}, {STREAM}, f AS (SELECT label, zone, min(ts) AS first_at FROM st GROUP BY 1, 2), a AS (SELECT label, zone, max(day) AS added FROM st WHERE kind = 'signup' GROUP BY 1, 2)
SELECT label, zone, epoch_us(first_at) AS first_us, CASE WHEN zone IN ('com', 'net') THEN coalesce(date_diff('day', added, CAST(first_at AS DATE)) BETWEEN 0 AND 14, false) ELSE first_at >= TIMESTAMP '2024-01-03' END AS launch FROM f LEFT JOIN a USING (label, zone)""",
)
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).where("kind = 'signup'")
    recent = seen.select(F.replace(F.regexp_replace("label", "[0-9]", ""), F.lit("-"), F.lit("")).alias("label"), "zone", "day")
    found = ops.drain(ops.launches(name_stream(spark, sf_dir), recent, zones_with_data=("com", "net"), warm_from="2024-01-03"))
    return found.select("label", "zone", F.unix_micros("first_at").alias("first_us"), "launch")


@query("k3_registrable", f"{W} SELECT event_id, label || '.' || zone AS registrable FROM names WHERE zone IN ('com', 'io', 'dev')")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = spark.createDataFrame([("com",), ("io",), ("dev",)], "suffix string")
    seen = market.names(spark, sf_dir)
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "*.").otherwise("www."), "label", F.lit("."), "zone")
    return ops.registrable(seen.select("event_id", name.alias("name")), suffixes).select("event_id", "registrable")


@query(
    "k5_roster",
    f"""{W}, e AS (SELECT label, ts, event_id, CASE kind WHEN 'error' THEN 'miss' WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'miss' ELSE 'ok' END AS result FROM names), l AS (SELECT label, max({{'t': ts, 'i': event_id}}) FILTER (WHERE result = 'ok') AS ok FROM e GROUP BY 1)
SELECT label, CAST(count(*) FILTER (WHERE result = 'miss' AND (ok IS NULL OR {{'t': ts, 'i': event_id}} > ok)) AS INTEGER) AS misses, CASE WHEN count(*) FILTER (WHERE result = 'miss' AND (ok IS NULL OR {{'t': ts, 'i': event_id}} > ok)) >= 3 THEN 'retired' ELSE 'active' END AS state FROM e JOIN l USING (label) GROUP BY 1""",
)
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("kind").isin("error", "click"), "miss").when(F.col("kind") == "view", "unknown").otherwise("ok")
    return ops.roster(market.names(spark, sf_dir).withColumn("result", result))


@query(
    "k6_candidate_state",
    f"""WITH RECURSIVE {NAMES}, e AS (SELECT label, kind, row_number() OVER (PARTITION BY label ORDER BY ts, event_id) AS n FROM names), f AS (
  SELECT DISTINCT label, CAST(0 AS BIGINT) AS n, '' AS state FROM e
  UNION ALL
  SELECT f.label, e.n, CASE WHEN kind = 'purchase' THEN 'exited' WHEN state = '' THEN '' WHEN kind = 'error' THEN 'dropped' WHEN state = 'exited' AND kind = 'view' THEN 'probing'
    WHEN state IN ('exited', 'probing') AND kind = 'click' THEN 'parked-watch' WHEN state IN ('exited', 'probing', 'parked-watch') AND kind = 'signup' THEN 'detected' ELSE state END
  FROM f JOIN e ON e.label = f.label AND e.n = f.n + 1)
SELECT label, arg_max(state, n) AS state, CAST(max(n) AS INTEGER) AS steps FROM f GROUP BY label""",
)
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.candidate_state(market.names(spark, sf_dir))


def _passed(days: int) -> str:
    """Of the sightings, those that the watermark has passed at the end of the stream."""
    return f"{W.replace('WITH', 'WITH RECURSIVE')}, {STREAM}, passed AS (SELECT *, epoch_us(ts) AS us FROM st WHERE epoch_us(ts) // 1000 < (SELECT epoch_us(max(ts)) // 1000 - {days} * 86400000 FROM st))"


def _one_of(values: list[str], by: str = "event_id") -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def _one_of_sql(values: list[str]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(event_id % {len(values)} + 1 AS INTEGER)]"


FACTS = {
    "purchase": ["departure", "movement", "movement"],
    "view": ["transfer", "probable", "suspected", "nothing"],
    "click": ["parking", "parking", "suspected", "hold", "expiration"],
    "error": ["gone", "nothing", "nothing", "nothing", "nothing"],
    "signup": ["resolved", "probable", "abandoned", "nothing", "expired"],
}
FACTS_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_one_of_sql(v)}" for k, v in FACTS.items()) + " END"


def lifecycle_facts() -> F.Column:
    """What a sighting tells about a candidate, by its kind and number."""
    fact = F.lit(None).cast("string")
    for kind, values in FACTS.items():
        fact = F.when(F.col("kind") == kind, _one_of(values)).otherwise(fact)
    return fact


@query(
    "k6_lifecycle",
    _passed(1)
    + f""", e AS (SELECT label, us, event_id, {FACTS_SQL} AS fact, row_number() OVER (PARTITION BY label ORDER BY us, event_id) AS n FROM passed), f AS (
  SELECT DISTINCT label, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS us, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS fact, CAST(NULL AS VARCHAR) AS state, 0 AS probes, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS hours, false AS told FROM e
  UNION ALL
  SELECT f.label, e.n, e.us, e.event_id, e.fact,
    CASE WHEN e.fact = 'departure' THEN 'exited' WHEN NOT coalesce(state IN ('exited', 'probing', 'parked-watch', 'detected', 'transferring'), false) THEN state
      WHEN e.fact = 'movement' THEN CASE WHEN state IN ('probing', 'parked-watch') THEN 'exited' ELSE state END WHEN e.fact IN ('resolved', 'abandoned', 'expired') THEN e.fact
      WHEN e.fact = 'transfer' THEN 'transferring' WHEN e.fact = 'probable' THEN 'detected' WHEN e.fact IN ('suspected', 'nothing') THEN 'probing' WHEN e.fact IN ('parking', 'hold', 'expiration') THEN 'parked-watch' ELSE 'dropped' END,
    probes + CASE WHEN coalesce(state IN ('exited', 'probing', 'parked-watch', 'detected', 'transferring'), false) AND e.fact NOT IN ('departure', 'movement', 'resolved', 'abandoned', 'expired') THEN 1 ELSE 0 END,
    CASE WHEN e.fact = 'departure' THEN NULL WHEN NOT coalesce(state IN ('exited', 'probing', 'parked-watch', 'detected', 'transferring'), false) THEN outcome WHEN e.fact IN ('movement', 'resolved', 'abandoned', 'expired') THEN outcome
      WHEN e.fact = 'transfer' THEN 'registrar-transfer' WHEN e.fact = 'probable' THEN 'likely-sale' WHEN e.fact = 'suspected' THEN 'unconfirmed-move' WHEN e.fact = 'expiration' THEN 'expiration' WHEN e.fact = 'hold' THEN 'registry-hold'
      WHEN e.fact = 'gone' THEN 'dropped' WHEN e.fact = 'parking' AND probes >= 4 THEN 'sale-or-parking-destination' WHEN e.fact = 'nothing' AND probes >= 4 THEN 'no-evidence' END,
    CASE WHEN e.fact IN ('departure', 'movement') THEN 0 WHEN e.fact = 'transfer' THEN 6 WHEN e.fact = 'probable' THEN CASE WHEN probes < 7 THEN 24 ELSE 72 END WHEN e.fact = 'suspected' THEN ([24, 72, 168, 336, 720])[least(probes, 4) + 1]
      WHEN e.fact IN ('hold', 'expiration') THEN 1080 WHEN e.fact = 'parking' THEN ([168, 552, 720, 720, 720])[least(probes, 4) + 1] WHEN e.fact = 'nothing' THEN ([168, 552, 720, 720, NULL])[least(probes, 4) + 1] END,
    e.fact = 'departure' OR coalesce(state IN ('exited', 'probing', 'parked-watch', 'detected', 'transferring'), false)
  FROM f JOIN e ON e.label = f.label AND e.n = f.n + 1
), t AS (SELECT label, us, event_id AS id, fact, state, probes, outcome, (us // 1000 + hours * 3600000) * 1000 AS next_us, lead(us) OVER (PARTITION BY label ORDER BY n) AS following FROM f WHERE told)
SELECT label, us, id, fact, state, probes, outcome, next_us FROM t
UNION ALL SELECT label, next_us, NULL, 'check', state, probes, outcome, NULL FROM t WHERE next_us // 1000 < coalesce(following // 1000, (SELECT epoch_us(max(ts)) // 1000 - 86400000 FROM st))""",
)
def k6_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drain(run_ordered(name_stream(spark, sf_dir), machines.Lifecycle(), key="label", fact=lifecycle_facts()))


@query(
    "k4_second_look",
    _passed(1)
    + """, e AS (SELECT label || '.' || zone AS name, us, event_id, CASE WHEN kind IN ('purchase', 'signup') THEN 'built' ELSE kind END AS fact, row_number() OVER (PARTITION BY label, zone ORDER BY us, event_id) AS n FROM passed),
l AS (SELECT a.name, a.us, a.event_id, a.fact, b.us AS us2, b.event_id AS id2, b.fact AS fact2 FROM e a LEFT JOIN e b ON b.name = a.name AND b.n = 2 WHERE a.n = 1)
SELECT name, us, event_id AS id, fact AS what, 1 AS looks FROM l WHERE fact = 'built'
UNION ALL SELECT name, us2, id2, fact2, 2 FROM l WHERE fact <> 'built' AND us2 IS NOT NULL
UNION ALL SELECT name, (us // 1000 + 1200000) * 1000, NULL, 'recheck', 1 FROM l WHERE fact <> 'built' AND us // 1000 + 1200000 < coalesce(us2 // 1000, (SELECT epoch_us(max(ts)) // 1000 - 86400000 FROM st))""",
)
def k4_second_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = name_stream(spark, sf_dir).withColumn("name", F.concat_ws(".", "label", "zone"))
    fact = F.when(F.col("kind").isin("purchase", "signup"), "built").otherwise(F.col("kind"))
    return ops.drain(run_ordered(stream, machines.SecondLook(), key="name", fact=fact))


ROSTER_FACTS = {"purchase": "fresh", "view": "unknown", "click": "missing", "error": "missing", "signup": "taken"}
SNAPSHOT_DAY = "2024-01-12"


def roster_events(events: DataFrame) -> DataFrame:
    fact = F.lit(None).cast("string")
    for kind, value in ROSTER_FACTS.items():
        fact = F.when(F.col("kind") == kind, value).otherwise(fact)
    return events.withColumn("fact", fact).withColumn("detail", F.concat(F.lit("ns"), (F.col("event_id") % 3).cast("string")))


@query(
    "k5_roster_stream",
    _passed(1)
    + f""", e AS (SELECT label, us, event_id, ts, CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROSTER_FACTS.items())} END AS fact, 'ns' || CAST(event_id % 3 AS VARCHAR) AS detail, row_number() OVER (PARTITION BY label ORDER BY us, event_id) AS n FROM passed), f AS (
  SELECT DISTINCT label, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS us, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS fact, -1 AS misses, CAST(NULL AS VARCHAR) AS hosts, false AS told FROM e
  UNION ALL
  SELECT f.label, e.n, e.us, e.event_id, e.fact,
    CASE WHEN misses >= 3 AND e.fact <> 'fresh' THEN misses WHEN e.fact = 'taken' THEN 0 WHEN e.fact = 'missing' THEN greatest(misses, 0) + 1 WHEN e.fact = 'fresh' AND misses >= 3 THEN 0 ELSE greatest(misses, 0) END,
    CASE WHEN misses >= 3 AND e.fact <> 'fresh' THEN hosts WHEN e.fact = 'taken' THEN e.detail WHEN e.fact = 'missing' THEN NULL WHEN e.fact = 'fresh' AND misses >= 3 THEN NULL ELSE hosts END,
    misses < 3 OR e.fact = 'fresh'
  FROM f JOIN e ON e.label = f.label AND e.n = f.n + 1)
SELECT label, us, id, fact, misses, misses >= 3 AS retired, hosts FROM f WHERE told AND us >= epoch_us(TIMESTAMP '{SNAPSHOT_DAY}')""",
)
def k5_roster_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = market.table(spark, sf_dir, "part")
    old = name_rows(market.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), part)
    snapshot = ops.roster_snapshot(roster_events(old.where(F.col("ts") < F.lit(SNAPSHOT_DAY).cast("timestamp"))))
    stream = roster_events(name_stream(spark, sf_dir).where(F.col("ts") >= F.lit(SNAPSHOT_DAY).cast("timestamp")))
    return ops.drain(run_ordered(stream, machines.Roster(), key="label", fact=F.col("fact"), detail=F.col("detail"), initial=snapshot))


@query(
    "k8_error_share_stream",
    _passed(1) + " SELECT zone, us, event_id AS id, round(avg(CASE WHEN kind = 'error' THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY zone ORDER BY us, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS error_share FROM passed",
)
def k8_error_share_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = ops.drain(run_ordered(name_stream(spark, sf_dir), machines.ErrorShare(rows=100), key="zone", fact=F.col("kind")))
    return shares.select("zone", "us", "id", F.round("error_share", 6).alias("error_share"))


@query("k8_error_share", f"{W} SELECT event_id, round(avg(CASE WHEN kind = 'error' THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY zone ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 6) AS error_share FROM names")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.error_share(market.names(spark, sf_dir)).select("event_id", "error_share")


@query(
    "k9_refine_day",
    f"{W}, s AS (SELECT label, max(day) AS day FROM names WHERE kind = 'purchase' GROUP BY 1), l AS (SELECT label, day AS late_day FROM names WHERE kind = 'view') SELECT s.label, CAST(coalesce(min(late_day) FILTER (WHERE date_diff('day', late_day, day) BETWEEN 1 AND 3), day) AS VARCHAR) AS day FROM s LEFT JOIN l USING (label) GROUP BY s.label, day",
)
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    stored = seen.where("kind = 'purchase'").groupBy("label").agg(F.max("day").alias("day"))
    return ops.refine_day(stored, seen.where("kind = 'view'")).withColumn("day", F.col("day").cast("string"))


@query(
    "k9_late_correction",
    f"{W}, {STREAM}, s AS (SELECT DISTINCT label, day FROM st WHERE kind = 'purchase'), l AS (SELECT DISTINCT label, day AS late_day FROM st WHERE kind = 'view') SELECT s.label, CAST(day AS VARCHAR) AS day, CAST(coalesce(min(late_day) FILTER (WHERE date_diff('day', late_day, day) BETWEEN 1 AND 3), day) AS VARCHAR) AS refined FROM s LEFT JOIN l USING (label) GROUP BY s.label, day",
)
def k9_late_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    departures, sightings = (name_stream(spark, sf_dir).where(F.col("kind") == kind) for kind in ("purchase", "view"))
    corrections = ops.drain(ops.earlier_days(departures, sightings))
    rows = name_rows(market.table(spark, sf_dir, "events"), market.table(spark, sf_dir, "part"))
    stored = rows.where("kind = 'purchase'").select("label", F.to_date("ts").alias("day")).distinct()
    return ops.refined(stored, corrections).select("label", F.col("day").cast("string").alias("day"), F.col("refined").cast("string").alias("refined"))


@query(
    "k7_reimport",
    f"{W}, c AS (SELECT CAST(day AS VARCHAR) AS day, kind, count(*) AS n FROM names WHERE day <> DATE '2024-01-03' OR kind <> 'error' GROUP BY 1, 2) SELECT day, kind, n, CASE WHEN day = '2024-01-03' THEN 2 ELSE 1 END AS imports FROM c",
)
def k7_reimport(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/days-{uuid.uuid4()}"
    source, target, manifest = (f"{folder}/{name}" for name in ("source", "target", "manifest"))
    seen = market.names(spark, sf_dir).select("event_id", "label", "zone", "kind", "day")
    seen.repartition("day").write.partitionBy("day").parquet(source)
    reimport.reimport(spark, source, target, manifest)
    changed = seen.where("day = DATE '2024-01-03' AND kind <> 'error'")
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(source)
    reimport.reimport(spark, source, target, manifest)
    runs = reimport.imported(spark, manifest)
    counts = spark.read.parquet(target).groupBy(F.col("day").cast("string").alias("day"), "kind").agg(F.count("*").alias("n"))
    return counts.join(runs.select("day", F.col("imports").cast("int").alias("imports")), "day")


@query("k10_sliding_weeks", f"{W}, d AS (SELECT event_type AS kind, CAST(unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS TIMESTAMP) AS start FROM events) SELECT kind, epoch_us(start) AS start_us, count(*) AS n FROM d GROUP BY 1, 2")
def k10_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ops.drain(ops.window_counts(name_stream(spark, sf_dir), "week", "kind"), "complete")
    return counts.select("kind", F.unix_micros("start").alias("start_us"), "n")


@query(
    "k10_bursts",
    f"{W}, {STREAM}, g AS (SELECT label, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY label ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM st), i AS (SELECT label, ts, sum(fresh) OVER (PARTITION BY label ORDER BY ts) AS burst FROM g) SELECT label, epoch_us(min(ts)) AS start_us, count(*) AS n FROM i GROUP BY label, burst",
)
def k10_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ops.drain(ops.window_counts(name_stream(spark, sf_dir), "burst", "label"), "complete")
    return counts.select("label", F.unix_micros("start").alias("start_us"), "n")


@query("k3_registrable_stream", f"{W}, {STREAM} SELECT event_id, label || '.' || zone AS registrable FROM st WHERE zone IN ('com', 'io', 'dev')")
def k3_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = spark.createDataFrame([("com",), ("io",), ("dev",)], "suffix string")
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "*.").otherwise("www."), "label", F.lit("."), "zone")
    seen = name_stream(spark, sf_dir).select("event_id", name.alias("name"))
    return ops.drain(ops.registrable(seen, suffixes).select("event_id", "registrable"))

"""Queries of trends over days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trends as ops
from ..sources import market
from ..sources.market import NAMES, SPLIT_DAY
from .registry import query

LAST = "2024-01-30"
W = f"WITH {NAMES}"
ZERO = ", ".join(f"'{z}'" for z in ops.ZERO_WEIGHT)


def last() -> F.Column:
    return F.lit(LAST).cast("date")


@query("b11_weighted_labels", f"{W} SELECT CAST(day AS VARCHAR) AS day, CAST(sum(w) AS BIGINT) AS labels FROM (SELECT day, label, max(CASE WHEN zone IN ({ZERO}) THEN 0 ELSE 1 END) AS w FROM names GROUP BY 1, 2) GROUP BY 1")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.weighted_labels(market.names(spark, sf_dir), ["day"]).withColumn("day", F.col("day").cast("string"))


@query(
    "d3_zone_trends",
    f"{W}, s AS (SELECT zone, day, count(*) AS n FROM names GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER (PARTITION BY zone ORDER BY day) AS previous FROM s) SELECT zone, CAST(day AS VARCHAR) AS day, n, previous, round(100.0 * (n - previous) / previous, 2) AS growth FROM l QUALIFY row_number() OVER (PARTITION BY zone ORDER BY day DESC) = 1",
)
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = market.names(spark, sf_dir).groupBy("zone", "day").agg(F.count("*").alias("n"))
    return ops.zone_trends(stats).withColumn("day", F.col("day").cast("string"))


@query("d4_keyword_trends", f"{W} SELECT label, CAST(count(DISTINCT zone) AS INTEGER) AS n_zones, array_to_string(list_sort(list(DISTINCT zone)), ',') AS zones FROM names WHERE day = DATE '2024-01-20' GROUP BY 1 HAVING count(DISTINCT zone) >= 2 ORDER BY 2 DESC, 1 LIMIT 5000")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyword_trends(market.names(spark, sf_dir), F.lit("2024-01-20").cast("date")).withColumn("zones", F.array_join("zones", ","))


@query("d4_keyword_history", f"{W} SELECT label AS keyword, CAST(day AS VARCHAR) AS day, array_to_string(list_sort(list(DISTINCT zone)), ',') AS zones, CAST(count(DISTINCT zone) AS INTEGER) AS n_zones FROM names GROUP BY 1, 2")
def d4_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyword_history(market.names(spark, sf_dir)).withColumn("zones", F.array_join("zones", ",")).withColumn("day", F.col("day").cast("string"))


@query(
    "d5_daily_tokens",
    f"{W}, t AS (SELECT DISTINCT zone, day, label, unnest(list_distinct(list_filter(string_split_regex(label, '[-0-9]+'), lambda x: x <> ''))) AS token FROM names) SELECT zone, CAST(day AS VARCHAR) AS day, token, count(*) AS n, CAST(len(string_split(token, ' ')) AS INTEGER) AS words FROM t GROUP BY 1, 2, 3",
)
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.filter(F.split("label", "[-0-9]+"), lambda t: t != "")
    return ops.daily_tokens(market.names(spark, sf_dir), tokens).withColumn("day", F.col("day").cast("string"))


@query(
    "d5_token_totals",
    f"{W}, t AS (SELECT DISTINCT zone, day, label, unnest(list_distinct(list_filter(string_split_regex(label, '[-0-9]+'), lambda x: x <> ''))) AS token FROM names), c AS (SELECT zone, day, token, count(*) AS n FROM t WHERE zone IN ('com', 'ai') AND contains(token, 'bo') GROUP BY 1, 2, 3) SELECT zone, CAST(day AS VARCHAR) AS day, count(*) AS tokens, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2",
)
def d5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ops.daily_tokens(market.names(spark, sf_dir), F.filter(F.split("label", "[-0-9]+"), lambda t: t != ""))
    return ops.token_totals(counts, zones=["com", "ai"], contains="bo").withColumn("day", F.col("day").cast("string"))


@query("d6_observed_zone_trends", f"{W} SELECT zone, count(*) AS total, count(*) FILTER (WHERE f > DATE '{LAST}' - 7) AS recent FROM (SELECT zone, label, min(day) AS f FROM names GROUP BY 1, 2) GROUP BY 1")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.observed_zone_trends(market.names(spark, sf_dir), last(), 7)


@query(
    "d6_observed_keyword_trends",
    f"{W}, f AS (SELECT label, zone, min(day) AS first FROM names GROUP BY 1, 2), m AS (SELECT label, max(first) AS newest, count(*) AS n_zones FROM f GROUP BY 1) SELECT m.label, n_zones, CAST(newest AS VARCHAR) AS newest, string_agg(zone, ',' ORDER BY zone) AS new_zones FROM m JOIN f ON f.label = m.label AND f.first = m.newest GROUP BY 1, 2, 3",
)
def d6_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.observed_keyword_trends(market.names(spark, sf_dir))
    return found.withColumn("new_zones", F.array_join("new_zones", ",")).withColumn("newest", F.col("newest").cast("string"))


@query(
    "d7_token_movement",
    f"""{W}, e AS (SELECT label AS token, day, CASE WHEN kind = 'signup' THEN 1 ELSE -1 END AS step FROM names WHERE kind IN ('signup', 'error') AND day BETWEEN DATE '2024-01-17' AND DATE '{LAST}'),
t AS (SELECT token, count(*) FILTER (WHERE day >= DATE '2024-01-24' AND step = 1) AS added, count(*) FILTER (WHERE day >= DATE '2024-01-24' AND step = -1) AS dropped, CAST(coalesce(sum(step) FILTER (WHERE day >= DATE '2024-01-24'), 0) AS BIGINT) AS net,
  coalesce(sum(step) FILTER (WHERE day < DATE '2024-01-24'), 0) AS before, count(*) FILTER (WHERE day < DATE '2024-01-24') AS seen FROM e GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY net DESC, token) AS rank, CASE WHEN seen > 0 THEN row_number() OVER (ORDER BY seen > 0 DESC, before DESC, token) END AS previous_rank FROM t),
d AS (SELECT token, unnest(range(7)) AS i FROM (SELECT DISTINCT token FROM e WHERE day >= DATE '2024-01-24')),
s AS (SELECT d.token, string_agg(CAST(coalesce(v, 0) AS VARCHAR), ',' ORDER BY i) AS series FROM d LEFT JOIN (SELECT token, day, sum(step) AS v FROM e GROUP BY 1, 2) x ON x.token = d.token AND x.day = DATE '2024-01-24' + CAST(i AS INTEGER) GROUP BY 1)
SELECT r.token, added, dropped, net, CAST(rank AS INTEGER) AS rank, CAST(coalesce(previous_rank, 0) AS INTEGER) AS previous_rank, CAST(coalesce(previous_rank - rank, 0) AS INTEGER) AS rank_change, series FROM r LEFT JOIN s USING (token)""",
)
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("kind") == "signup", "add").otherwise("drop")
    events = market.names(spark, sf_dir).where("kind IN ('signup', 'error')").select(F.col("label").alias("token"), "day", kind.alias("kind"))
    return ops.token_movement(events, F.lit("2024-01-24").cast("date"), last(), 7).fillna(0, ["previous_rank", "rank_change"])


CURATED = ", ".join(f"'{z}'" for zones in ops.GROUPS.values() for z in zones)


@query(
    "d8_trending",
    f"""{W}, h AS (SELECT label AS keyword, day, zone FROM names WHERE zone NOT IN ({ZERO})), d AS (SELECT keyword, day, date_diff('day', day, DATE '{LAST}') AS age FROM h GROUP BY 1, 2),
a AS (SELECT keyword, count(*) FILTER (WHERE age BETWEEN 0 AND 6) AS days, count(*) FILTER (WHERE age BETWEEN 7 AND 34) AS base FROM d GROUP BY 1),
z AS (SELECT keyword, string_agg(DISTINCT zone, ',' ORDER BY zone) AS zones, CAST(sum(CASE WHEN zone IN ({CURATED}) THEN 3 ELSE 1 END) AS INTEGER) AS weight FROM (SELECT DISTINCT keyword, zone FROM h WHERE date_diff('day', day, DATE '{LAST}') BETWEEN 0 AND 6) GROUP BY 1)
SELECT a.keyword, days, base AS baseline_days, round((days / 7.0) / (CASE WHEN base < 3 THEN base + 1 ELSE base END / 28.0), 3) AS momentum, zones, weight FROM a JOIN z USING (keyword) WHERE days > 0""",
)
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.trending(ops.keyword_history(market.names(spark, sf_dir)), last())
    return found.withColumn("zones", F.array_join("zones", ","))


@query(
    "d28_history_lexicon",
    f"""{W}, d AS (SELECT label AS term, day, count(*) AS n FROM names GROUP BY 1, 2), s AS (SELECT min(day) AS low, max(day) AS high, count(DISTINCT day) AS covered FROM d)
SELECT term, CAST(sum(n) AS BIGINT) AS total, count(*) AS days, CAST(min(day) AS VARCHAR) AS first, round((sum(CASE WHEN date_diff('day', low, day) * 2 >= date_diff('day', low, high) THEN n ELSE 0 END) + 0.5) / (sum(CASE WHEN date_diff('day', low, day) * 2 >= date_diff('day', low, high) THEN 0 ELSE n END) + 0.5), 6) AS growth, round(count(*) / max(covered), 6) AS presence FROM d, s GROUP BY 1""",
)
def d28(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = market.names(spark, sf_dir).groupBy(F.col("label").alias("term"), "day").agg(F.count("*").alias("n"))
    return ops.history_lexicon(daily).withColumn("first", F.col("first").cast("string"))


@query(
    "w13_day_series",
    f"{W}, k AS (SELECT zone, unnest(range(10)) AS i FROM (SELECT DISTINCT zone FROM names)) SELECT k.zone, string_agg(CAST(coalesce(v, 0) AS VARCHAR), ',' ORDER BY i) AS series FROM k LEFT JOIN (SELECT zone, day, count(*) AS v FROM names GROUP BY 1, 2) x ON x.zone = k.zone AND x.day = DATE '2024-01-21' + CAST(i AS INTEGER) GROUP BY 1",
)
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.day_series(market.names(spark, sf_dir).withColumn("one", F.lit(1)), "zone", "day", "one", F.lit("2024-01-21").cast("date"), last())


@query(
    "t23_keyword_rise",
    f"""{W}, seen AS (SELECT DISTINCT label AS term, user_id AS op, day FROM names), daily AS (SELECT day, count(DISTINCT op) AS ops FROM seen GROUP BY 1),
c AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS age FROM daily WHERE ops >= greatest(3.0, (SELECT quantile_cont(ops, 0.5) * 0.2 FROM daily))), r AS (SELECT seen.*, age <= 3 AS now FROM seen JOIN c USING (day) WHERE age <= 10),
t AS (SELECT count(DISTINCT op) FILTER (WHERE now) AS an, count(DISTINCT op) FILTER (WHERE NOT now) AS ap FROM r)
SELECT term, count(DISTINCT op) FILTER (WHERE now) AS recent_ops, count(DISTINCT op) FILTER (WHERE NOT now) AS prior_ops, round(((count(DISTINCT op) FILTER (WHERE now) + 1) / (max(an) + 1)) / ((count(DISTINCT op) FILTER (WHERE NOT now) + 1) / (max(ap) + 1)), 6) AS rise FROM r, t GROUP BY 1""",
)
def t23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyword_rise(market.names(spark, sf_dir).select(F.col("label").alias("term"), F.col("user_id").alias("op"), "day").distinct())


@query(
    "t19_span_delta",
    f"""{W}, a AS (SELECT label, count(*) AS n FROM names WHERE day <= DATE '{SPLIT_DAY}' GROUP BY 1), b AS (SELECT label, count(*) AS n FROM names WHERE day > DATE '{SPLIT_DAY}' GROUP BY 1),
x AS (SELECT label, coalesce(a.n, 0) AS old_n, coalesce(b.n, 0) AS new_n FROM a FULL JOIN b USING (label)), y AS (SELECT *, ((new_n + 1) / (SELECT sum(n) FROM b)) / ((old_n + 1) / (SELECT sum(n) FROM a)) AS q FROM x)
SELECT label, old_n, new_n, round(q, 6) AS ratio, CASE WHEN old_n = 0 THEN 'new' WHEN q >= 1.5 THEN 'rising' WHEN q <= 0.6 THEN 'fading' ELSE 'stable' END AS trend FROM y""",
)
def t19(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, split = market.names(spark, sf_dir), F.lit(SPLIT_DAY)
    return ops.span_delta(seen.where(F.col("day") <= split), seen.where(F.col("day") > split), "label")


@query(
    "t15_emergent_types",
    f"""{W}, d AS (SELECT label, day, count(*) AS n FROM names GROUP BY 1, 2), b AS (SELECT count(DISTINCT day) FILTER (WHERE day > DATE '2024-01-23') AS l, count(DISTINCT day) FILTER (WHERE day <= DATE '2024-01-23') AS e FROM names)
SELECT label, round(sum(CASE WHEN day <= DATE '2024-01-23' THEN n ELSE 0 END) / max(e), 6) AS base_rate, round(sum(CASE WHEN day > DATE '2024-01-23' THEN n ELSE 0 END) / max(l), 6) AS recent_rate, round(max(n) / sum(n), 6) AS burst, count(*) AS active_days FROM d, b GROUP BY 1""",
)
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.emergent_types(market.names(spark, sf_dir).select("label", "day"), "label", F.lit("2024-01-23").cast("date"))


_ARRIVALS = "count(DISTINCT label) AS n, count(DISTINCT label) FILTER (WHERE event_id % 4 = 0) AS expired, count(DISTINCT label) FILTER (WHERE user_id % 3 = 0) AS pending"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.when(F.col("event_id") % 4 == 0, "expiry").otherwise("seller")
    return market.names(spark, sf_dir).where("kind = 'purchase'").withColumns({"origin": origin, "pending": F.col("user_id") % 3 == 0})


@query("d14_destination_cohorts", f"{W} SELECT CAST(day AS VARCHAR) AS day, host, {_ARRIVALS}, count(DISTINCT label) >= 10 AS large FROM names WHERE kind = 'purchase' GROUP BY 1, 2")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.destination_cohorts(arrivals(spark, sf_dir), "host").withColumn("day", F.col("day").cast("string"))


@query("d14_window_cohorts", f"{W} SELECT host, {_ARRIVALS}, count(DISTINCT day) AS days, count(DISTINCT label) >= 10 AS large FROM names WHERE kind = 'purchase' AND day BETWEEN DATE '2024-01-10' AND DATE '2024-01-16' GROUP BY 1")
def d14_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.window_cohorts(arrivals(spark, sf_dir), "host", F.lit("2024-01-10").cast("date"), F.lit("2024-01-16").cast("date"))


@query(
    "d15_learned_platforms",
    f"{W}, d AS (SELECT day, host, count(DISTINCT label) AS n FROM names WHERE kind = 'purchase' GROUP BY 1, 2), w AS (SELECT *, n + coalesce((SELECT sum(n) FROM d p WHERE p.host = d.host AND p.day < d.day AND p.day >= d.day - 7), 0) AS week FROM d) SELECT CAST(day AS VARCHAR) AS day, host, n, CAST(week AS BIGINT) AS week FROM w WHERE n >= 10 OR week >= 25",
)
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = market.names(spark, sf_dir).where("kind = 'purchase'").groupBy("day", "host").agg(F.count_distinct("label").alias("n"))
    return ops.learned_platforms(daily, "host").withColumn("day", F.col("day").cast("string"))


@query(
    "c14_near_in_time",
    f"{W}, a AS (SELECT DISTINCT label, day FROM names WHERE kind = 'error'), b AS (SELECT DISTINCT label, day FROM names WHERE kind = 'purchase') SELECT a.label, CAST(a.day AS VARCHAR) AS day, CAST(b.day AS VARCHAR) AS right_day FROM a JOIN b USING (label) WHERE abs(date_diff('day', a.day, b.day)) <= 3",
)
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    pick = lambda kind: seen.where(F.col("kind") == kind).select("label", "day").distinct()
    found = ops.near_in_time(pick("error"), pick("purchase"), "label", 3)
    return found.select("label", F.col("day").cast("string").alias("day"), F.col("right_day").cast("string").alias("right_day"))


@query(
    "d16_buyer_stats",
    f"{W}, c AS (SELECT label, host, count(*) AS n FROM names WHERE kind = 'purchase' GROUP BY 1, 2), s AS (SELECT label, n / sum(n) OVER (PARTITION BY label) AS p FROM c) SELECT label, count(*) AS buyers, round(max(p), 6) AS top_share, round(1 - sum(p * p), 6) AS independence FROM s GROUP BY 1",
)
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.buyer_stats(market.names(spark, sf_dir).where("kind = 'purchase'"), "label", "host")

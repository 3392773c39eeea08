"""Queries of freshness, theme tapes, emerging terms, brand families and insight cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import insights as ops
from ..operators.trends import ZERO_WEIGHT
from ..sources import market
from ..sources.market import LISTINGS, NAMES
from .name_queries import SEGMENTS, dictionary, segments
from .registry import query

W = f"WITH {NAMES}"
WR = f"WITH RECURSIVE {NAMES}, {SEGMENTS}"
NOW = "2024-01-28 06:00:00"


def date(text: str) -> F.Column:
    return F.lit(text).cast("date")


@query(
    "d31_freshness",
    f"""{W}, i AS (SELECT day, max(ts) + INTERVAL 30 HOUR AS imported_at FROM names WHERE kind = 'view' AND day_of_month <> 19 GROUP BY 1), e AS (SELECT CAST(TIMESTAMP '{NOW}' AS DATE) - 1 AS expected),
a AS (SELECT unnest(generate_series(CAST(least(greatest((SELECT min(day) FROM i), expected - 6), expected) AS TIMESTAMP), CAST(expected AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM e), m AS (SELECT count(*) AS n FROM a, e WHERE a.day NOT IN (SELECT day FROM i) AND (a.day < expected OR (SELECT max(day) FROM i) < expected)),
d AS (SELECT names.day, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 90 HOUR END AS admitted_at FROM names WHERE kind = 'purchase' AND event_id % 3 = 0 AND day >= CAST(TIMESTAMP '{NOW}' AS DATE) - 14 AND ts <= TIMESTAMP '{NOW}'),
b AS (SELECT count(*) AS n, max(CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(greatest(CAST(d.day AS TIMESTAMP), imported_at, admitted_at))) / 6e7) AS BIGINT)) AS oldest FROM d LEFT JOIN i ON i.day = d.day),
c AS (SELECT count(*) AS n, max(CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 6e7) AS BIGINT)) AS oldest FROM names WHERE kind = 'error' AND event_id % 50 = 0 AND ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 100 MINUTE AND TIMESTAMP '{NOW}'),
p AS (SELECT 'movement' AS part, CASE WHEN n > 0 THEN 'stale' ELSE 'ok' END AS status, n, -1 AS oldest_minutes FROM m UNION ALL SELECT 'backlog', CASE WHEN oldest > 360 THEN 'stale' WHEN oldest > 120 THEN 'degraded' ELSE 'ok' END, n, coalesce(oldest, -1) FROM b UNION ALL SELECT 'assessments', CASE WHEN oldest > 60 THEN 'stale' ELSE 'ok' END, n, coalesce(oldest, -1) FROM c)
SELECT * FROM p UNION ALL SELECT 'verdict', CASE WHEN bool_or(status = 'stale') THEN 'stale' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'ok' END, count(*) FILTER (WHERE status <> 'ok'), -1 FROM p""".replace("day_of_month", "day(day)"),
)
def d31(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, now = market.names(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")
    imports = seen.where("kind = 'view' AND dayofmonth(day) <> 19").groupBy("day").agg((F.max("ts") + F.expr("INTERVAL 30 HOURS")).alias("imported_at"))
    left = seen.where(F.col("ts") <= now)
    departures = left.where("kind = 'purchase'").select("event_id", "day", (F.col("event_id") % 3 != 0).alias("checked"), F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 90 HOURS")).alias("admitted_at"))
    dirty = left.where("kind = 'error' AND event_id % 50 = 0").where(F.col("ts") >= now - F.expr("INTERVAL 100 MINUTES")).select(F.col("ts").alias("dirty_at"))
    return ops.freshness(imports, departures, dirty, now).fillna(-1, ["oldest_minutes"])


ENTRIES = "e AS (SELECT listing_id, domain, CAST(ends_at AS DATE) AS report_day, price, stream <> 'dropped' AND price IS NOT NULL AS likely FROM listings WHERE ends_at IS NOT NULL)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir).where("ends_at IS NOT NULL")
    return rows.select("listing_id", "domain", F.to_date("ends_at").alias("report_day"), "price", F.expr("stream <> 'dropped' AND price IS NOT NULL").alias("likely"))


@query("t21_sales_tape", f"WITH {LISTINGS}, {ENTRIES} SELECT split_part(domain, '.', 1) AS label, split_part(domain, '.', 2) AS zone, CAST(report_day AS VARCHAR) AS day FROM e WHERE likely AND report_day BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'")
def t21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sales_tape(entries(spark, sf_dir), date("1995-01-01"), date("1997-12-31")).withColumn("day", F.col("day").cast("string"))


@query("t21_tape_facts", f"WITH {LISTINGS}, {ENTRIES} SELECT split_part(domain, '.', 1) AS label, max({{'d': report_day, 'i': listing_id}}).i AS listing_id, arg_max(price, {{'d': report_day, 'i': listing_id}}) AS price FROM e WHERE likely GROUP BY 1")
def t21_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tape_facts(entries(spark, sf_dir), ["listing_id", "price"], "listing_id")


@query("t21_candidate_tape", f"{W} SELECT label, zone, CAST(day AS VARCHAR) AS day FROM names WHERE kind = 'purchase' AND event_id % 4 <> 0")
def t21_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.names(spark, sf_dir).where("kind = 'purchase'")
    rows = rows.select(F.concat(F.lit(" "), F.upper("label"), F.lit("."), "zone").alias("domain"), F.when(F.col("event_id") % 4 != 0, F.col("day")).alias("departure_day"))
    return ops.candidate_tape(rows).withColumn("day", F.col("day").cast("string"))


TERMS = f"""k AS (SELECT n.user_id, n.zone, n.day, n.kind, s.label, list_filter(pieces, lambda p: p <> '?') AS w FROM names n JOIN segments s USING (label)), t AS (SELECT user_id, zone, day, kind, unnest(w) AS term, w FROM k UNION ALL SELECT user_id, zone, day, kind, array_to_string(w, ' '), w FROM k WHERE len(w) = 2),
f AS (SELECT term, count(DISTINCT user_id) AS operators, 1e6 * count(*) / (SELECT count(*) FROM names) AS per_million, count(DISTINCT day) / (SELECT count(DISTINCT day) FROM names) AS presence, count(DISTINCT kind) AS roles, count(DISTINCT array_to_string(w, ' ')) AS partners, count(DISTINCT zone) AS zones, count(*) FILTER (WHERE zone IN ('ai', 'io')) / count(*) AS frontier_share FROM t GROUP BY 1),
c AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) * 100 AS rank FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, word) <= 10),
lx AS (SELECT term, exp(sum(ln(CASE WHEN word IN ('ring', 'rod', 'new') THEN 0.02 WHEN rank IS NULL THEN 1e0 ELSE least(1e0, 0.02 + pow(rank / 10000, 1.5)) END))) AS product, bool_and(word IN ('ring', 'rod', 'new')) AS old, count(*) AS n FROM (SELECT term, unnest(string_split(term, ' ')) AS word FROM f) LEFT JOIN c USING (word) GROUP BY 1)"""


@query(
    "t25_emerging",
    f"""{WR}, {TERMS}, x AS (SELECT *, (1 / (1 + log10(1 + per_million))) * (1 - 0.7 * presence) * CASE WHEN n = 1 THEN product ELSE sqrt(product) END AS novelty FROM f JOIN lx USING (term))
SELECT term, round(novelty, 6) AS novelty, CASE WHEN operators < 2 OR old OR presence >= 0.99 THEN 0e0 ELSE round(novelty * log2(1 + operators) * (1 + CASE WHEN roles >= 2 THEN 0.4 ELSE 0 END + least(partners, 10) * 0.05 + CASE WHEN zones >= 2 THEN 0.3 ELSE 0 END) * (1 + 1.5 * frontier_share), 4) END AS score FROM x""",
)
def t25(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    held = segments(spark, sf_dir).select("label", F.filter("pieces", lambda p: p != "?").alias("w"))
    both = F.when(F.size("w") == 2, F.concat("w", F.array(F.array_join("w", " ")))).otherwise(F.col("w"))
    each = seen.join(held, "label").select("user_id", "zone", "day", "kind", "w", F.explode(both).alias("term"))
    totals = seen.agg(F.count("*").alias("all"), F.count_distinct("day").alias("days"))
    facts = each.groupBy("term").agg(
        F.count_distinct("user_id").alias("operators"), F.count("*").alias("n"), F.count_distinct("day").alias("active"), F.count_distinct("kind").alias("roles"), F.count_distinct(F.array_join("w", " ")).alias("partners"),
        F.count_distinct("zone").alias("zones"), (F.count_if(F.col("zone").isin("ai", "io")) / F.count("*")).alias("frontier_share"),
    )
    facts = facts.join(F.broadcast(totals)).withColumns({"per_million": 1e6 * F.col("n") / F.col("all"), "presence": F.col("active") / F.col("days"), "established": F.col("active") / F.col("days") >= 0.99})  # one row
    words = market.table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    common = words.orderBy(F.desc("n"), "word").limit(10).select("word", (F.row_number().over(ops.Window.orderBy(F.desc("n"), "word")) * 100).alias("rank"))
    return ops.emerging(facts, common, ["ring", "rod", "new"])


@query("t16_brand_families")
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    return ops.brand_families(seen.where("day > DATE '2024-01-10'"), seen.where("day <= DATE '2024-01-10' AND kind = 'error'"), dictionary(spark, sf_dir))


def cards_sql(period: int, baseline: int, day: str) -> str:
    return f"""{WR}, r AS (SELECT label, zone, day FROM names WHERE zone NOT IN ({', '.join(f"'{z}'" for z in ZERO_WEIGHT)})), cur AS (SELECT label, zone, min(day) AS day FROM r WHERE date_diff('day', day, DATE '{day}') BETWEEN 0 AND {period - 1} GROUP BY 1, 2), old AS (SELECT DISTINCT label, zone, day FROM r WHERE date_diff('day', day, DATE '{day}') BETWEEN {period} AND {period + baseline - 1}),
v AS (SELECT entry AS word FROM dict WHERE length(entry) >= 3), pc AS (SELECT label, word FROM (SELECT label, unnest(list_distinct(pieces)) AS word FROM segments) JOIN v USING (word)), used AS (SELECT cur.*, word FROM cur JOIN pc USING (label)),
cn AS (SELECT word, count(DISTINCT label) AS labels, count(*) AS names FROM used GROUP BY 1 ORDER BY round(count(*) * least(1e0, pow(length(word) / 6, 2)), 9) DESC, word LIMIT 400), raw AS (SELECT word, count(*) AS raw FROM (SELECT DISTINCT label FROM cur) l JOIN v ON contains(l.label, v.word) GROUP BY 1),
kept AS (SELECT word, labels, names FROM cn JOIN raw USING (word) WHERE labels >= 3 AND labels >= 0.4 * raw), cards AS (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept p WHERE p.word <> k.word AND contains(k.word, p.word) AND k.labels >= 0.5 * p.labels)),
pr AS (SELECT word, count(*) AS prior_names FROM old JOIN pc USING (label) GROUP BY 1), z AS (SELECT word, string_agg(zone || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, zone) AS extensions FROM (SELECT word, zone, count(*) AS n FROM used GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT c.word, string_agg(CAST(coalesce(x.n, 0) AS VARCHAR), ',' ORDER BY c.i) AS history FROM (SELECT word, unnest(range({period})) AS i FROM cards) c LEFT JOIN (SELECT word, day, count(*) AS n FROM used GROUP BY 1, 2) x ON x.word = c.word AND x.day = DATE '{day}' - CAST({period - 1} - c.i AS INTEGER) GROUP BY 1),
ex AS (SELECT word, string_agg(label || '.' || zone, ',' ORDER BY p) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY zone = 'com' DESC, regexp_matches(label, '[^a-z]'), length(label), label, zone) AS p FROM used) WHERE p <= 4 GROUP BY 1),
q AS (SELECT c.*, coalesce(prior_names, 0) AS prior_names, CASE WHEN prior_names > 0 THEN (names / (SELECT count(*) FROM cur)) / (prior_names / (SELECT count(*) FROM old)) END AS ratio, extensions, history, examples FROM cards c LEFT JOIN pr USING (word) JOIN z USING (word) JOIN h USING (word) JOIN ex USING (word))
SELECT word, labels, names, prior_names, coalesce(round(ratio, 6), -1) AS ratio, CASE WHEN (SELECT count(*) FROM old) = 0 THEN 'snapshot' WHEN prior_names = 0 THEN 'new' WHEN ratio >= 1.25 THEN 'gained' WHEN ratio <= 0.8 THEN 'lost' ELSE 'similar' END AS direction, extensions, history, examples FROM q"""


def cards(spark: SparkSession, sf_dir: str, period: int, baseline: int, day: str) -> DataFrame:
    return ops.insight_cards(market.names(spark, sf_dir), segments(spark, sf_dir), dictionary(spark, sf_dir), date(day), period=period, baseline=baseline).fillna(-1, ["ratio"])


@query("t12_daily_insights", cards_sql(1, 7, "2024-01-25"))
def t12_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir, 1, 7, "2024-01-25")


@query("t12_weekly_insights", cards_sql(7, 7, "2024-01-25"))
def t12_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir, 7, 7, "2024-01-25")


@query("t12_monthly_insights", cards_sql(15, 15, "2024-01-30"))
def t12_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a month against the other: the events span thirty days."""
    return cards(spark, sf_dir, 15, 15, "2024-01-30")

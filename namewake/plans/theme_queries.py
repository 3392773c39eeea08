"""Queries of themes, keywords and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, trends
from ..operators import themes as ops
from ..operators.trends import keyword_rise
from ..sources import market
from ..sources.market import LISTINGS, NAMES
from .name_queries import SEGMENTS, dictionary, segments
from .registry import query

W = f"WITH {NAMES}"
WR = f"WITH RECURSIVE {NAMES}, {SEGMENTS}"


def date(text: str) -> F.Column:
    return F.lit(text).cast("date")


@query("a5_read_adds", f"{W} SELECT label, zone, CAST(day AS VARCHAR) AS day FROM names WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-06' AND event_id % 9 <> 0")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = ledger.shared_path(spark, "adds")
    label = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("xn--"), "label")).otherwise(F.col("label"))
    market.names(spark, sf_dir).select(label.alias("label"), "zone", F.col("day").alias("window_start"), "day").write.partitionBy("day").option("sep", "\t").csv(path)
    return ops.read_adds(spark, path, "2024-01-03", "2024-01-06").select("label", "zone", F.col("day").cast("string").alias("day"))


@query("a9_scan_inventory", f"WITH {LISTINGS} SELECT domain, price FROM listings WHERE zone IN ('com', 'ai')")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scan_inventory(market.listings(spark, sf_dir), ["domain", "price"], ["com", "ai"])


@query(
    "b18_evidence_keys",
    f"{W} SELECT event_id, event_id % 8 <> 0 AS valid, event_id % 8 <> 0 AND CASE WHEN event_id % 3 = 0 THEN kind = 'purchase' ELSE user_id % 7 = 0 END AS likely, event_id % 8 <> 0 AND (user_id % 2 = 0 AND kind = 'view' OR CASE WHEN event_id % 3 = 0 THEN kind = 'purchase' ELSE user_id % 7 = 0 END) AS signal, event_id % 8 <> 0 AND user_id % 2 = 0 AS from_seller, CASE WHEN event_id % 8 <> 0 THEN zone ELSE '' END AS kit, CASE WHEN event_id % 8 <> 0 THEN CAST(day AS VARCHAR) ELSE '' END AS checked_at FROM names",
)
def b18(spark: SparkSession, sf_dir: str) -> DataFrame:
    move = F.struct(F.when(F.col("user_id") % 2 == 0, "seller").otherwise("parking").alias("from"), F.when(F.col("kind") == "view", "hosting").otherwise("seller").alias("to"))
    own = F.when(F.col("event_id") % 3 == 0, F.when(F.col("kind") == "purchase", "likely-sale").otherwise("acquisition-candidate")).alias("classification")
    assessed = F.struct(F.when(F.col("user_id") % 7 == 0, "likely-sale").otherwise("portfolio-kit").alias("classification")).alias("assessment")
    body = F.to_json(F.struct(own, assessed, move.alias("movement"), F.struct(F.col("zone").alias("kit")).alias("homepage"), F.struct(F.col("day").cast("string").alias("checked")).alias("registry")))
    rows = market.names(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 8 == 0, "{").otherwise(body).alias("evidence"))
    return ops.evidence_keys(rows).drop("evidence")


@query("t2_segment_mincost")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.segment_mincost(market.names(spark, sf_dir), dictionary(spark, sf_dir)).select("label", F.array_join("pieces", "|").alias("pieces"), "cost")


@query(
    "t3_name_words",
    f"{W}, d AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS e FROM part), p AS (SELECT DISTINCT a.e || b.e AS stem FROM d a, d b), l AS (SELECT DISTINCT label FROM names) SELECT label, CAST(CASE WHEN p.stem IS NOT NULL THEN 2 ELSE 0 END AS INTEGER) AS n_words, regexp_extract(label, '([0-9]*)$', 1) AS tail, p.stem IS NULL AS invented FROM l LEFT JOIN p ON p.stem = replace(regexp_replace(label, '[0-9]*$', ''), '-', '')",
)
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.name_words(market.names(spark, sf_dir), dictionary(spark, sf_dir))


@query("t5_coined_terms")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.coined_terms(segments(spark, sf_dir))


@query(
    "t11_daily_signals",
    f"""{W}, d AS (SELECT label AS token, day, count(*) AS n FROM names GROUP BY 1, 2), c AS (SELECT label AS token, count(DISTINCT zone) AS contexts FROM names GROUP BY 1),
a AS (SELECT token, coalesce(sum(n) FILTER (WHERE day = DATE '2024-01-25'), 0) AS n, coalesce(sum(n) FILTER (WHERE day BETWEEN DATE '2024-01-18' AND DATE '2024-01-24'), 0) AS total, coalesce(sum(n * n) FILTER (WHERE day BETWEEN DATE '2024-01-18' AND DATE '2024-01-24'), 0) AS squares, count(*) FILTER (WHERE day BETWEEN DATE '2024-01-18' AND DATE '2024-01-25') AS days FROM d GROUP BY 1),
m AS (SELECT *, total / 7e0 AS mean, sqrt(greatest((squares - 7 * (total / 7e0) * (total / 7e0)) / 6e0, 0e0)) AS sd FROM a JOIN c USING (token) WHERE n > 0)
SELECT token, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(sd, 6) AS sd, contexts, CASE WHEN days < 4 THEN 'inactive' WHEN n < 1.5e0 * mean THEN 'flat' WHEN n < mean + 2 * sd THEN 'within-noise' WHEN contexts < 3 THEN 'one-context' ELSE 'signal' END AS reason FROM m""",
)
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).withColumnRenamed("label", "token")
    return ops.daily_signals(seen.groupBy("token", "day").agg(F.count("*").alias("n")), seen.groupBy("token").agg(F.count_distinct("zone").alias("contexts")), date("2024-01-25"))


@query(
    "t13_pattern_evidence",
    f"""{W}, r AS (SELECT *, CASE WHEN zone IN ('xyz', 'shop', 'info') THEN 0 ELSE 1 END AS w FROM names WHERE contains(label, 'bolt') AND day BETWEEN DATE '2024-01-16' AND DATE '2024-01-25'),
l AS (SELECT label, max(w) AS w, max(CASE WHEN day = DATE '2024-01-25' THEN w ELSE 0 END) AS today, max(CASE WHEN regexp_matches(label, '[0-9]') THEN 1 ELSE 0 END) AS numeric FROM r GROUP BY 1),
o AS (SELECT CAST(coalesce(sum(today), 0) AS BIGINT) AS today, CAST(coalesce(sum(w), 0) AS BIGINT) AS in_window, coalesce(round(avg(numeric), 6), 0e0) AS numeric_share FROM l), x AS (SELECT count(DISTINCT day) AS active_days, count(DISTINCT string_split(label, 'bolt')[-1]) AS suffixes FROM r)
SELECT *, today >= 3 AND in_window >= 10 AND active_days >= 3 AND numeric_share <= 0.5 AS review FROM o, x""",
)
def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pattern_evidence(market.names(spark, sf_dir), "bolt", date("2024-01-25"))


THEMED = "tw AS (SELECT label, list_filter(pieces, lambda p: p <> '?') AS w FROM segments), th AS (SELECT names.*, w[1] || ' ' || w[2] AS theme, w[1] AS root FROM names JOIN tw USING (label) WHERE len(w) >= 2)"


def themed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of labels of two known words or more; the theme is the first two, the root the first."""
    words = segments(spark, sf_dir).select("label", F.filter("pieces", lambda p: p != "?").alias("w")).where("size(w) >= 2")
    pairs = words.select("label", F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("theme"), F.get("w", F.lit(0)).alias("root"))
    return market.names(spark, sf_dir).join(pairs, "label")


@query(
    "t17_theme_convergence",
    f"""{WR}, {THEMED}, a AS (SELECT theme, count(DISTINCT label) AS labels, count(DISTINCT root) AS roots, count(DISTINCT zone) AS zones, count(*) AS n FROM th WHERE day > DATE '2024-01-23' GROUP BY 1 HAVING count(DISTINCT label) >= 5), b AS (SELECT theme, count(*) AS was FROM th WHERE day <= DATE '2024-01-23' GROUP BY 1),
r AS (SELECT *, (n / (SELECT count(*) FROM th WHERE day > DATE '2024-01-23')) / (was / (SELECT count(*) FROM th WHERE day <= DATE '2024-01-23')) AS ratio FROM a LEFT JOIN b USING (theme))
SELECT theme, labels, roots, zones, round(log2(labels + 1) * log2(roots + 1) * log2(zones + 1), 6) AS score, CASE WHEN was IS NULL THEN 'new' WHEN ratio >= 1.3e0 THEN 'rising' WHEN ratio <= 0.6e0 THEN 'fading' ELSE 'stable' END AS bucket FROM r""",
)
def t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = themed(spark, sf_dir)
    return ops.theme_convergence(rows.where("day > DATE '2024-01-23'"), rows.where("day <= DATE '2024-01-23'"), "theme")


@query("t20_theme_targets", f"{WR}, {THEMED} SELECT theme, label, zone FROM (SELECT DISTINCT theme, label, zone FROM th WHERE theme IN ('small ring', 'blue bolt', 'small gizmo')) QUALIFY row_number() OVER (PARTITION BY theme ORDER BY zone = 'com' DESC, label, zone) <= 30 UNION ALL (SELECT 'sample', label, CASE WHEN bool_or(zone = 'com') THEN 'com' ELSE min(zone) END FROM th GROUP BY label ORDER BY md5(label), label LIMIT 50)")
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = themed(spark, sf_dir)
    return ops.theme_targets(rows, rows.where("theme IN ('small ring', 'blue bolt', 'small gizmo')"), 30, "com", sample=50)


def seen_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.names(spark, sf_dir).select(F.col("label").alias("term"), F.col("user_id").alias("op"), "day", "zone")


@query(
    "t24_keyword_stages",
    f"{W}, a AS (SELECT label AS term, count(DISTINCT user_id) AS ops, count(DISTINCT day) AS days, count(DISTINCT zone) AS zones FROM names GROUP BY 1) SELECT *, CASE WHEN ops >= 8 AND days >= 5 AND zones >= 2 THEN 'confirmed' WHEN ops >= 3 AND days >= 2 THEN 'forming' ELSE 'watch' END AS stage FROM a",
)
def t24(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = seen_terms(spark, sf_dir)
    return ops.keyword_metrics(seen, keyword_rise(seen.select("term", "op", "day").distinct()).select("term", "rise")).drop("rise")


@query("t26_keyword_lists")
def t26(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = seen_terms(spark, sf_dir)
    return ops.keyword_lists(ops.keyword_metrics(seen, keyword_rise(seen.select("term", "op", "day").distinct()).select("term", "rise")), 30)


@query("t27_keyword_clusters")
def t27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyword_clusters(seen_terms(spark, sf_dir))


@query(
    "d17_candidate_stats",
    f"""{WR}, {THEMED}, h AS (SELECT theme, label, day, kind = 'purchase' AS built, CASE WHEN event_id % 12 = 0 THEN '' ELSE host END AS host FROM th), b AS (SELECT day, host FROM h GROUP BY 1, 2 HAVING count(DISTINCT label) >= 10)
SELECT theme, count(DISTINCT label) AS names, count(DISTINCT CASE WHEN b.day IS NOT NULL THEN CAST(h.day AS VARCHAR) || '|' || h.host ELSE h.host || '|' || label END) FILTER (WHERE h.host <> '') AS buyers, count(DISTINCT label) FILTER (WHERE built) AS built, count(*) FILTER (WHERE h.host = '') AS without_destination FROM h LEFT JOIN b ON b.day = h.day AND b.host = h.host GROUP BY 1""",
)
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = themed(spark, sf_dir).select("theme", "label", "day", (F.col("kind") == "purchase").alias("built"), F.when(F.col("event_id") % 12 == 0, "").otherwise(F.col("host")).alias("host"))
    return ops.candidate_stats(rows, trends.destination_cohorts(rows, "host"), "theme")


@query(
    "k4_recheck",
    f"{W}, f AS (SELECT label || '.' || zone AS name, min({{'ts': ts, 'i': event_id, 'b': kind = 'purchase'}}) AS f, max(ts) AS last FROM names GROUP BY 1) SELECT name, epoch_us(f.ts + INTERVAL 20 MINUTE) AS due_us, last >= f.ts + INTERVAL 20 MINUTE AS looked_again FROM f WHERE NOT f.b",
)
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = market.names(spark, sf_dir).select(F.concat_ws(".", "label", "zone").alias("name"), "ts", "event_id", (F.col("kind") == "purchase").alias("built"))
    return ops.recheck(looks).select("name", F.unix_micros(F.col("due_at").cast("timestamp")).alias("due_us"), "looked_again")


THEMES = {"colour": ["red", "blue"], "heat": ["hot", "cold"]}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = market.names(spark, sf_dir).groupBy("label").agg(F.sort_array(F.collect_set("kind")).alias("site"))
    return ops.search_docs(segments(spark, sf_dir), THEMES, site)


DOCS = "sd AS (SELECT label, list_filter(pieces, lambda p: p <> '?') AS name, list_concat(CASE WHEN list_has_any(pieces, ['red', 'blue']) THEN ['colour'] ELSE [] END, CASE WHEN list_has_any(pieces, ['hot', 'cold']) THEN ['heat'] ELSE [] END) AS theme FROM segments)"


@query("t29_search_docs", f"{WR}, {DOCS}, k AS (SELECT label, string_agg(DISTINCT kind, ',' ORDER BY kind) AS site FROM names GROUP BY 1) SELECT label, array_to_string(name, ',') AS name, site, array_to_string(theme, ',') AS theme FROM sd JOIN k USING (label)")
def t29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("label", *[F.array_join(c, ",").alias(c) for c in ("name", "site", "theme")])


@query("r13_naming_profile", f"{WR}, {DOCS} SELECT label, CASE WHEN len(theme) > 0 THEN 'themed' WHEN len(name) > 0 THEN 'worded' ELSE 'invented' END AS status FROM sd")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.naming_profile(docs(spark, sf_dir)).select("label", "status")

"""Queries of ledgers: extraction, reconciliation, evidence joins, queues and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as ops
from ..operators.names import segment_greedy
from ..sources import market
from ..sources.market import LISTINGS, NAMES
from .name_queries import SEGMENTS, dictionary, segments
from .registry import query
from .score_queries import ASSESSED, assessed

W = f"WITH {NAMES}"
WR = f"WITH RECURSIVE {NAMES}, {SEGMENTS}"


def date(text: str) -> F.Column:
    return F.lit(text).cast("date")


@query("a6_movement_tape", f"{W} SELECT kind, label AS name, CASE WHEN event_id % 2 = 0 THEN host || ',x.example' ELSE '' END AS prev, host AS today, CAST(day AS VARCHAR) AS day FROM names WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev = F.when(F.col("event_id") % 2 == 0, F.array("host", F.lit("x.example"))).otherwise(F.array().cast("array<string>"))
    path = ops.shared_path(spark, "movement")
    ops.write_movement(market.names(spark, sf_dir).select("kind", F.col("label").alias("name"), prev.alias("prev_ns"), F.array("host").alias("today_ns"), "day"), path)
    rows = ops.read_movement(spark, path, "2024-01-05", "2024-01-09")
    return rows.select("kind", "name", F.array_join("prev_ns", ",").alias("prev"), F.array_join("today_ns", ",").alias("today"), F.col("day").cast("string").alias("day"))


@query("a13_load_day", f"{W} SELECT CAST(day AS VARCHAR) AS day, label, count(*) AS n FROM names WHERE day <> DATE '2024-01-05' OR kind = 'view' GROUP BY 1, 2")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, seen = ops.shared_path(spark, "days"), market.names(spark, sf_dir).select("day", "label", "kind")
    ops.load_day(path, seen)
    for _ in range(2):  # the same day again, and again
        ops.load_day(path, seen.where("day = DATE '2024-01-05' AND kind = 'view'"))
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "label").agg(F.count("*").alias("n"))


@query(
    "a13_receive",
    f"""{W}, t AS (SELECT * FROM names WHERE NOT (day = DATE '2024-01-05' AND kind = 'view')), r AS (SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM names WHERE day <= DATE '2024-01-15' GROUP BY 1)
SELECT CAST(t.day AS VARCHAR) AS day, count(*) AS n, CASE WHEN t.day > DATE '2024-01-15' THEN 'new' WHEN count(*) = max(r.n) THEN 'same' ELSE 'refused' END AS verdict, coalesce(max(r.n), count(*)) AS held FROM t LEFT JOIN r ON r.day = CAST(t.day AS VARCHAR) GROUP BY t.day""",
)
def a13_receive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, receipts, seen = ops.shared_path(spark, "days"), ops.shared_path(spark, "receipts"), market.names(spark, sf_dir).select("day", "label", "zone", "kind")
    for _ in range(2):  # the same days again
        ops.receive(spark, path, receipts, seen.where("day <= DATE '2024-01-15'"), ["label", "zone"])
    told = ops.receive(spark, path, receipts, seen.where("NOT (day = DATE '2024-01-05' AND kind = 'view')"), ["label", "zone"])
    held = spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("held"))
    return told.join(held, "day").select(F.col("day").cast("string").alias("day"), "n", "verdict", "held")


@query("a13_receipt", f"{W} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(label || chr(31) || zone), 1, 12) AS BIGINT)) AS BIGINT) AS digest FROM names GROUP BY 1")
def a13_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.receipt(market.names(spark, sf_dir), ["label", "zone"]).withColumn("day", F.col("day").cast("string"))


@query("a15_prune", f"{W} SELECT event_id FROM names WHERE day > DATE '2024-01-30' - 7")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.prune(market.names(spark, sf_dir), date("2024-01-30"), 7).select("event_id")


@query("a16_export", f"WITH {LISTINGS} SELECT CAST(listing_id AS VARCHAR) AS listing_id, domain FROM listings WHERE stream = 'auction'")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = ops.shared_path(spark, "export")
    market.listings(spark, sf_dir).where("stream = 'auction'").select("listing_id", "domain").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("listing_id string, domain string").csv(path)


RECORDS = """r AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE '{"status":["' || CASE WHEN event_id % 3 = 0 THEN 'pending Transfer' ELSE 'ok' END || '","client transfer prohibited"],"events":[{"action":"transfer","date":"' || CAST(day AS VARCHAR) || '"},{"action":"transfer","date":"2023-05-05"},{"action":"expiration","date":"2030-01-01"}],"registrar":"' || host || '"}' END AS body FROM names)"""


@query(
    "a10_registry_facts",
    f"""{W} SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 'clienttransferprohibited,pendingtransfer' ELSE 'clienttransferprohibited,ok' END ELSE '' END AS statuses, CASE WHEN event_id % 10 <> 0 THEN CAST(day AS VARCHAR) ELSE '' END AS transferred, CASE WHEN event_id % 10 <> 0 THEN host ELSE '' END AS registrar, event_id % 10 <> 0 AND event_id % 3 = 0 AS pending, event_id % 10 <> 0 AS locked FROM names""",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.array(F.when(F.col("event_id") % 3 == 0, "pending Transfer").otherwise("ok"), F.lit("client transfer prohibited"))
    event = lambda action, day: F.struct(F.lit(action).alias("action"), day.alias("date"))
    moves = F.array(event("transfer", F.col("day").cast("string")), event("transfer", F.lit("2023-05-05")), event("expiration", F.lit("2030-01-01")))
    body = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.to_json(F.struct(status.alias("status"), moves.alias("events"), F.col("host").alias("registrar"))))
    found = ops.registry_facts(market.names(spark, sf_dir).select("event_id", body.alias("body")), "body").drop("body")
    return found.fillna("", ["statuses", "transferred", "registrar"]).fillna(False, ["pending", "locked"])


@query(
    "a11_extract_sales",
    f"{W} SELECT event_id AS page_id, label || '.' || zone AS domain, CAST(user_id * 1000 + 5 AS DOUBLE) AS price, CASE WHEN event_id % 2 = 0 THEN 'GoAuction' ELSE 'Week of ' || zone END AS venue, CASE WHEN event_id % 2 = 0 THEN 'auction' ELSE 'enduser' END AS side FROM names WHERE NOT contains(label, '_')",
)
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td class='c'>"), c, F.lit("</td>"))
    price = F.concat(F.lit("<b>$"), F.format_number(F.col("user_id") * 1000 + 5, 0), F.lit("</b>"))
    row = F.concat(F.lit("<h2>Week of "), "zone", F.lit("</h2><table><tr><th>x</th></tr>\n<tr>"), cell(F.lit("1")), cell(F.concat(F.upper("label"), F.lit("."), "zone")), cell(price), cell(F.when(F.col("event_id") % 2 == 0, "GoAuction").otherwise("#12")), F.lit("</tr></table>"))
    pages = market.names(spark, sf_dir).select(F.col("event_id").alias("page_id"), row.alias("html"))
    return ops.extract_sales(pages, ["goauction"])


@query(
    "a17_archive_ended",
    f"WITH {LISTINGS}, e AS (SELECT DISTINCT domain, ends_at FROM listings WHERE stream = 'auction' AND ends_at <= TIMESTAMP '1997-01-01') SELECT domain, epoch_us(ends_at) AS ended_us FROM e WHERE (domain, ends_at) NOT IN (SELECT domain, ends_at FROM listings WHERE stream = 'auction' AND ends_at IS NOT NULL AND listing_id % 4 = 0)",
)
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir)
    kept = rows.where("stream = 'auction' AND listing_id % 4 = 0").select("domain", F.col("stream").alias("source"), F.col("ends_at").alias("ended_at"))
    found = ops.archive_ended(rows, kept, F.lit("1997-01-01").cast("timestamp_ntz"))
    return found.select("domain", F.unix_micros(F.col("ended_at").cast("timestamp")).alias("ended_us"))


@query(
    "a18_reported_sales",
    f"{W} SELECT sha256(label || '|' || CAST(day AS VARCHAR) || '|' || CAST(event_id AS VARCHAR)) AS id, label AS domain, coalesce(CASE WHEN event_id % 3 <> 0 AND user_id % 2 = 0 THEN value END, -1) AS price_usd, coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, -1) AS amount FROM names WHERE kind <> 'error' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
)
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.names(spark, sf_dir).select(F.col("label").alias("domain"), "day", F.col("event_id").alias("report_id"), F.col("value").alias("amount"), F.when(F.col("kind") == "error", "internal").otherwise("public").alias("visibility"), (F.col("event_id") % 3 != 0).alias("verified"), F.when(F.col("user_id") % 2 == 0, "USD").otherwise("EUR").alias("currency"))
    return ops.reported_sales(rows, date("2024-01-05"), date("2024-01-20")).drop("day").fillna(-1, ["price_usd", "amount"])


MEMBERS = "m AS (SELECT DISTINCT zone AS cluster, label AS domain FROM names), li AS (SELECT DISTINCT label AS domain FROM names WHERE kind = 'click' AND day = DATE '2024-01-20'), sa AS (SELECT label AS domain, min(day) AS d FROM names WHERE kind = 'purchase' AND event_id % 5 = 0 GROUP BY 1), fj AS (SELECT cluster, m.domain, CASE WHEN m.domain < 'd' THEN DATE '2024-01-02' WHEN li.domain IS NOT NULL THEN DATE '2024-01-20' END AS listed_on, sa.d AS sold_on FROM m LEFT JOIN li USING (domain) LEFT JOIN sa USING (domain))"


def joined_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    members = seen.select(F.col("zone").alias("cluster"), F.col("label").alias("domain")).distinct()
    members = members.withColumns({"listed_on": F.when(F.col("domain") < "d", date("2024-01-02")), "sold_on": F.lit(None).cast("date")})
    listed = seen.where("kind = 'click' AND day = DATE '2024-01-20'").select(F.col("label").alias("domain"))
    sales = seen.where("kind = 'purchase' AND event_id % 5 = 0").select(F.col("label").alias("domain"), "day")
    return ops.forward_join(members, listed, sales, date("2024-01-20"))


@query("c7_forward_join", f"{W}, {MEMBERS} SELECT cluster, domain, CAST(listed_on AS VARCHAR) AS listed_on, CAST(sold_on AS VARCHAR) AS sold_on FROM fj")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_members(spark, sf_dir).select("cluster", "domain", F.col("listed_on").cast("string").alias("listed_on"), F.col("sold_on").cast("string").alias("sold_on"))


@query("d20_cluster_outcomes", f"{W}, {MEMBERS} SELECT cluster, count(*) AS members, count(listed_on) AS listed, count(sold_on) AS sold, CAST(greatest(max(listed_on), max(sold_on)) AS VARCHAR) AS latest FROM fj GROUP BY 1")
def d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cluster_outcomes(joined_members(spark, sf_dir)).withColumn("latest", F.col("latest").cast("string"))


@query(
    "c13_term_sales",
    f"""WITH RECURSIVE {LISTINGS}, {SEGMENTS.replace("FROM names", "FROM listings")}, t AS (SELECT label, unnest(list_distinct(pieces)) AS term FROM segments)
SELECT term, CASE WHEN stream = 'auction' THEN 'auction' ELSE 'enduser' END AS side, count(*) AS n, round(sum(price), 2) AS total FROM listings JOIN t USING (label) WHERE price IS NOT NULL AND term IN (SELECT entry FROM dict) GROUP BY 1, 2""",
)
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = market.listings(spark, sf_dir).where("price IS NOT NULL").withColumn("side", F.when(F.col("stream") == "auction", "auction").otherwise("enduser"))
    words = dictionary(spark, sf_dir)
    return ops.term_sales(words.withColumnRenamed("entry", "term"), sales, segment_greedy(sales, words))


@query("c16_merge_zone_trends", f"{W}, z AS (SELECT zone, day, count(*) AS n FROM names WHERE kind = 'view' GROUP BY 1, 2), f AS (SELECT zone, day, count(*) AS n FROM names WHERE kind = 'click' GROUP BY 1, 2) SELECT zone, CAST(day AS VARCHAR) AS day, n, 'zone' AS source FROM z UNION ALL SELECT zone, CAST(day AS VARCHAR), n, 'feed' FROM f WHERE (zone, day) NOT IN (SELECT zone, day FROM z)")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: market.names(spark, sf_dir).where(F.col("kind") == kind).groupBy("zone", "day").agg(F.count("*").alias("n"))
    return ops.merge_zone_trends(count("view"), count("click")).withColumn("day", F.col("day").cast("string"))


@query(
    "d10_reconcile_drops",
    f"{W}, s AS (SELECT zone, day, count(*) AS dropped, count(*) + CAST(max(event_id) % 11 = 0 AS INTEGER) AS candidates FROM names WHERE kind = 'error' GROUP BY 1, 2), k AS (SELECT zone, day, count(*) AS events, count(*) FILTER (WHERE event_id % 40 <> 0) AS decided FROM names WHERE kind = 'error' AND event_id % 91 <> 0 GROUP BY 1, 2) SELECT zone, CAST(day AS VARCHAR) AS day, CASE WHEN dropped <> candidates OR dropped <> coalesce(events, 0) THEN 'error' WHEN decided < events THEN 'pending' ELSE 'complete' END AS status FROM s LEFT JOIN k USING (zone, day)",
)
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    drops = market.names(spark, sf_dir).where("kind = 'error'")
    stats = drops.groupBy("zone", "day").agg(F.count("*").alias("dropped"), (F.count("*") + (F.max("event_id") % 11 == 0).cast("int")).alias("candidates"))
    events = drops.where("event_id % 91 <> 0").withColumn("decided", F.col("event_id") % 40 != 0)
    return ops.reconcile_drops(stats, events).withColumn("day", F.col("day").cast("string"))


@query(
    "d13_sold_words",
    f"{WR}, k AS (SELECT list_filter(pieces, lambda p: p <> '?') AS w FROM segments), c AS (SELECT 'word' AS kind, unnest(list_distinct(w)) AS item FROM k UNION ALL SELECT 'pair', unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM k WHERE len(w) >= 2), n AS (SELECT kind, item, count(*) AS n FROM c GROUP BY 1, 2) SELECT kind, item, n FROM n QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, item) <= 50",
)
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sold_words(segments(spark, sf_dir))


def _decoded(text: str) -> str:
    for reference, char in ops.ENTITIES.items():
        text = "replace({}, '{}', '{}')".format(text, reference, char.replace("'", "''"))
    return text


_RESIDUE = _decoded("CASE WHEN length(label) >= 4 THEN replace(replace(lower(title), name, ' '), label, ' ') ELSE replace(lower(title), name, ' ') END")
_GENERIC = ", ".join(f"'{r}'" for r in ops.GENERIC_RESIDUES)


@query(
    "d22_adoption_kits",
    f"""{W}, c AS (SELECT event_id, day, label, label || '.' || zone AS name, CASE WHEN event_id % 5 = 0 THEN 'Welcome | ' || label || '.' || zone WHEN event_id % 5 = 1 THEN 'www.' || kind || ' shop: ' || upper(label) ELSE upper(label) || '.' || zone || ' &ndash; ' || kind || CAST(user_id % 40 AS VARCHAR) END AS title FROM names),
r AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({_RESIDUE}, '^www\\.', ''), '{ops.EDGES}', '', 'g'), '\\s+', ' ', 'g'), ' ') AS r FROM c), k AS (SELECT event_id, name, CASE WHEN length(r) >= 6 AND regexp_matches(r, '[a-z0-9]') AND r NOT IN ({_GENERIC}) AND date_diff('day', day, DATE '2024-02-10') <= 30 THEN r END AS r FROM r),
s AS (SELECT r, count(DISTINCT name) AS kit_size FROM k WHERE r IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) >= 3) SELECT event_id, coalesce(substr(sha1(s.r), 1, 12), '') AS kit, coalesce(kit_size, 0) AS kit_size FROM k LEFT JOIN s ON s.r = k.r""",
)
def d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, turn = F.concat_ws(".", "label", "zone"), F.col("event_id") % 5
    other = F.concat(F.upper("label"), F.lit("."), "zone", F.lit(" &ndash; "), "kind", (F.col("user_id") % 40).cast("string"))
    title = F.when(turn == 0, F.concat(F.lit("Welcome | "), name)).when(turn == 1, F.concat(F.lit("www."), "kind", F.lit(" shop: "), F.upper("label"))).otherwise(other)
    cands = market.names(spark, sf_dir).select("event_id", "day", name.alias("name"), title.alias("title"))
    return ops.adoption_kits(cands, F.lit("2024-02-10").cast("date")).select("event_id", "kit", "kit_size").fillna("", ["kit"]).fillna(0, ["kit_size"])


@query("d26_verified_counts", f"WITH {LISTINGS}, {NAMES} SELECT stream, count(DISTINCT label) AS labels, count(DISTINCT label) FILTER (WHERE label IN (SELECT label FROM names WHERE kind = 'view' AND day > DATE '2024-01-15')) AS verified FROM listings GROUP BY 1")
def d26(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = market.names(spark, sf_dir).select("label", (F.col("kind") == "view").alias("complete"), (F.col("day") > date("2024-01-15")).alias("current"))
    return ops.verified_counts(market.listings(spark, sf_dir), receipts)


@query("d32_extension_evidence", f"WITH {LISTINGS}, {NAMES}, u AS (SELECT label, zone FROM names UNION SELECT label, zone FROM listings) SELECT label, string_agg(zone, ',' ORDER BY zone) AS zones, count(*) AS n FROM u GROUP BY 1")
def d32(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = lambda df: df.groupBy("label").agg(F.collect_list("zone").alias("zones"))
    return ops.extension_evidence(zones(market.names(spark, sf_dir)), zones(market.listings(spark, sf_dir))).withColumn("zones", F.array_join("zones", ","))


@query("d33_taken_index", f"{W} SELECT DISTINCT zone, label FROM names WHERE kind = 'view' OR event_id % 2 = 0 AND kind = 'click'")
def d33(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    state = F.when(F.col("event_id") % 2 == 0, "taken").otherwise("free")
    receipts = seen.where("kind = 'click'").select("label", F.to_json(F.create_map("zone", state)).alias("body"))
    return ops.taken_index(receipts, seen.where("kind = 'view'"))


@query("w6_sort_listings", f"WITH {LISTINGS} SELECT listing_id, CAST(row_number() OVER (ORDER BY price NULLS LAST, listing_id) AS INTEGER) AS place FROM listings")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sort_listings(market.listings(spark, sf_dir), "price", False).select("listing_id", "place")


@query("w7_feed_order", f"WITH {LISTINGS} SELECT label, stream AS class, CAST(row_number() OVER (ORDER BY CASE stream WHEN 'auction' THEN 1 WHEN 'expiring' THEN 2 ELSE 3 END, CASE WHEN regexp_full_match(label, '[a-z]+') THEN 0 WHEN NOT contains(label, '-') THEN 1 ELSE 2 END, length(label), label, stream) AS INTEGER) AS place FROM (SELECT DISTINCT label, stream FROM listings)")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir).select("label", F.col("stream").alias("class")).distinct()
    return ops.feed_order(rows, ["auction", "expiring"]).select("label", "class", "place")


@query("w14_pending_queue", f"{W} SELECT event_id FROM names WHERE event_id NOT IN (SELECT event_id FROM names WHERE kind = 'view') ORDER BY day DESC, value DESC, event_id LIMIT 400")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).withColumn("priority", F.col("value"))
    return ops.pending_queue(seen, seen.where("kind = 'view'"), "event_id", 400).select("event_id")


@query(
    "w16_select_recheck",
    f"{W}, c AS (SELECT event_id AS name, day, CASE WHEN event_id % 3 <> 0 THEN ts END AS checked_at FROM names) SELECT name FROM c WHERE day >= DATE '2024-01-10' AND (checked_at IS NULL OR checked_at < TIMESTAMP '2024-01-25') ORDER BY checked_at IS NULL DESC, CASE WHEN checked_at IS NULL THEN -date_diff('day', DATE '1970-01-01', day) END NULLS FIRST, checked_at NULLS FIRST, name LIMIT 3000",
)
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.names(spark, sf_dir).select(F.col("event_id").alias("name"), "day", F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("checked_at"))
    return ops.select_recheck(rows, date("2024-01-10"), F.lit("2024-01-25").cast("timestamp_ntz"), 3000).select("name")


@query(
    "t6_domain_terms",
    f"{WR}, k AS (SELECT label, list_filter(pieces, lambda p: p <> '?' AND length(p) >= 3) AS w FROM segments) SELECT label, 'head' AS role, w[-1] AS term FROM k WHERE len(w) > 0 UNION SELECT label, 'modifier', unnest(w[1:-2]) FROM k WHERE len(w) >= 2 UNION SELECT label, 'pair', unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM k WHERE len(w) >= 2",
)
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.domain_terms(segments(spark, sf_dir))


@query(
    "t10_fragment_lift",
    f"""{WR}, fw AS (SELECT label, unnest(list_distinct(list_filter(pieces, lambda p: p <> '?'))) AS token FROM segments), d AS (SELECT zone, token, day, count(*) AS n FROM names JOIN fw USING (label) GROUP BY 1, 2, 3), s AS (SELECT zone, day, count(*) AS size FROM names GROUP BY 1, 2), x AS (SELECT zone, token, n FROM d WHERE day = DATE '2024-01-25'),
e AS (SELECT x.zone, x.token, avg(coalesce(p.n, 3e0) * t.size / s.size) AS expected FROM x JOIN s ON s.zone = x.zone AND s.day BETWEEN DATE '2024-01-18' AND DATE '2024-01-24' JOIN s t ON t.zone = x.zone AND t.day = DATE '2024-01-25' LEFT JOIN d p ON p.zone = x.zone AND p.token = x.token AND p.day = s.day GROUP BY 1, 2)
SELECT zone, token, n, round(expected, 6) AS expected, round(n / expected, 6) AS lift FROM x JOIN e USING (zone, token)""",
)
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    words = segments(spark, sf_dir).select("label", F.explode(F.array_distinct(F.filter("pieces", lambda p: p != "?"))).alias("token"))
    daily = seen.join(words, "label").groupBy("zone", "token", "day").agg(F.count("*").alias("n"))
    return ops.fragment_lift(daily, seen.groupBy("zone", "day").agg(F.count("*").alias("size")), date("2024-01-25"))


@query("t18_theme_trajectory", f"{WR}, th AS (SELECT names.*, w[1] || ' ' || w[2] AS theme FROM names JOIN (SELECT label, list_filter(pieces, lambda p: p <> '?') AS w FROM segments) USING (label) WHERE len(w) >= 2), d AS (SELECT day, count(*) AS total, count(*) FILTER (WHERE zone = 'com') = 0 AS partial FROM th GROUP BY 1), t AS (SELECT theme, day, count(*) AS n FROM th GROUP BY 1, 2) SELECT theme, CAST(day AS VARCHAR) AS day, n, round(1000e0 * n / total, 6) AS share, partial FROM t JOIN d USING (day)")
def t18(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = segments(spark, sf_dir).select("label", F.filter("pieces", lambda p: p != "?").alias("w")).where("size(w) >= 2")
    rows = market.names(spark, sf_dir).join(pairs.select("label", F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("theme")), "label")
    return ops.theme_trajectory(rows, "theme").withColumn("day", F.col("day").cast("string"))


@query(
    "t30_search",
    f"{WR}, s AS (SELECT label, list_filter(pieces, lambda p: p <> '?') AS name, ['old', 'bolt'] AS site FROM segments) SELECT label, CASE WHEN list_has_all(name, ['old', 'bolt']) THEN 'name' WHEN list_has_all(site, ['old', 'bolt']) AND label < 'h' THEN 'site' END AS match FROM s WHERE list_has_all(name, ['old', 'bolt']) OR label < 'h'",
)
def t30(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    site = F.when(F.col("label") < "h", F.array(F.lit("old"), F.lit("bolt"))).otherwise(none)
    docs = segments(spark, sf_dir).select("label", F.filter("pieces", lambda p: p != "?").alias("name"), site.alias("site"), none.alias("theme"))
    return ops.search(docs, "old bolt").select("label", "match")


@query("t31_literal_search", r"SELECT doc_id, 'text' AS match FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])of[^A-Za-z0-9]+the([^A-Za-z0-9_]|$)')")
def t31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.literal_search(market.table(spark, sf_dir, "documents"), "of the", {"text": "text"}).select("doc_id", "match")


@query(
    "r7_auction_score",
    f"""WITH {LISTINGS}, dict AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS entry FROM part), a AS (SELECT * FROM listings WHERE stream = 'auction'), c AS (SELECT label, unnest(range(2, greatest(length(label) - 2, 2) + 1)) AS cut FROM (SELECT DISTINCT label FROM a)),
h AS (SELECT label, min(substr(label, 1, cut) || ' ' || substr(label, cut + 1)) AS halves FROM c WHERE substr(label, 1, cut) IN (SELECT entry FROM dict) AND substr(label, cut + 1) IN (SELECT entry FROM dict) GROUP BY 1)
SELECT listing_id, CAST(CASE WHEN halves IS NOT NULL THEN 40 ELSE 0 END - CASE WHEN regexp_matches(label, '[0-9]') THEN 20 ELSE 0 END - CASE WHEN contains(label, '-') THEN 15 ELSE 0 END + least(bids, 10) * 3 + least(age_years, 20) - greatest(length(label) - 10, 0) * 4 AS INTEGER) AS points, coalesce(halves, '') AS halves, array_to_string(list_filter([CASE WHEN regexp_matches(label, '[0-9]') THEN 'number' END, CASE WHEN contains(label, '-') THEN 'hyphen' END, CASE WHEN list_bool_or(list_transform(range(1, length(label) - 1), lambda i: label[i] = label[i + 1] AND label[i] = label[i + 2])) THEN 'repeated letters' END, CASE WHEN regexp_matches(label, '[^aeiou]{{6,}}') THEN 'hard consonant run' END], lambda x: x IS NOT NULL), ', ') AS warnings FROM a LEFT JOIN h USING (label)""",
)
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir).where("stream = 'auction'")
    return ops.auction_score(rows, dictionary(spark, sf_dir)).select("listing_id", "points", "halves", "warnings").fillna("", ["halves"])


@query("r10_derived_rows", f"WITH {ASSESSED} SELECT name, CASE WHEN tier = 'excluded' THEN 'noise' WHEN today_class = 'hosting' THEN 'builder' ELSE 'aftermarket' END AS tape, CASE WHEN n <= 4 THEN '1-4' WHEN n <= 8 THEN '5-8' WHEN n <= 12 THEN '9-12' ELSE '13+' END AS length_band FROM (SELECT *, length(split_part(name, '.', 1)) AS n FROM tiers)")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.derived_rows(assessed(spark, sf_dir)).select("name", "tape", "length_band")


@query("k7_ingest_days", f"{W} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM names GROUP BY 1")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target, progress = (ops.shared_path(spark, n) for n in ("source", "target", "progress"))
    seen = market.names(spark, sf_dir).select("day", "label")
    seen.where("day <= DATE '2024-01-15' AND length(label) % 3 <> 0").write.parquet(source)
    ops.ingest_days(spark, source, "day date, label string", target, progress)
    seen.where("day > DATE '2024-01-15' OR length(label) % 3 = 0").write.mode("append").parquet(source)  # more of the days taken in, and later ones
    ops.ingest_days(spark, source, "day date, label string", target, progress)
    return spark.read.parquet(target).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))

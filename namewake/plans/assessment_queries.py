"""Queries of assessed departures, their views and the identity of destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assessment as ops
from ..operators import coverage, derived, ledger, opportunities, trends
from ..operators import zones as zone_ops
from ..operators.ranking import saved
from ..operators.themes import name_words
from ..sources import market
from ..sources.market import LISTINGS, NAMES
from .name_queries import dictionary
from .registry import query

NOW = "2024-01-30 12:00:00"


def _h(i: int) -> F.Column:
    """A number from 0 to 65535 that follows from the name, another one for each ``i``."""
    return F.conv(F.substring(F.md5(F.concat("domain", F.lit(str(i // 8)))), 4 * (i % 8) + 1, 4), 16, 10).cast("int")


def _h_sql(i: int) -> str:
    return f"CAST('0x' || substr(md5(domain || '{i // 8}'), {4 * (i % 8) + 1}, 4) AS INTEGER)"


CLASSES = ["seller", "parking", "registrar", "hosting", "other", "seller"]


def _pick(values: list, i: int) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), _h(i) % len(values) + 1)


def _pick_sql(values: list, i: int) -> str:
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[{_h_sql(i)} % {len(values)} + 1]"


TITLES = ["label", "label by Other Works", "domain - Other Works", "domain | label guides", "Other Works", None]
STATUSES = [["pendingtransfer", "ok"], ["redemptionperiod"], ["ok"], ["ok", "clienttransferprohibited"], ["ok"], ["ok"], ["ok"], ["ok"]]
KINDS = ["operating", "operating", "operating", "placeholder", "unavailable", None]


def departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that left sale infrastructure, with what a first look found; all follows from the name and its sightings."""
    seen = market.names(spark, sf_dir).withColumn("domain", F.concat_ws(".", "label", "zone"))
    gone = seen.groupBy("domain").agg(F.min(F.when(F.col("kind") == "purchase", F.col("day"))).alias("departure_day"), F.max("day").alias("last_day")).where("departure_day is not null")
    day, label = F.col("departure_day"), F.substring_index("domain", ".", 1)
    at = lambda i, span: (F.timestamp_seconds(F.unix_date(day).cast("long") * 86400) + F.make_dt_interval(hours=_h(i) % (24 * span) - 12 * span))
    title = F.replace(F.replace(_pick(TITLES, 0), F.lit("domain"), F.col("domain")), F.lit("label"), label)
    rows = gone.select(
        "domain",
        "departure_day",
        F.date_sub(day, 1 + _h(1) % 4).alias("prev_day"),
        day.alias("move_day"),
        F.when(_h(2) % 3 == 0, F.date_sub(day, _h(2) % 5)).alias("last_changed"),
        _pick(CLASSES, 3).alias("prev_class"),
        _pick(CLASSES, 4).alias("today_class"),
        (_h(5) % 24 - 8).alias("cohort"),
        (_h(6) % 8 - 4).alias("kit_size"),
        (_h(7) % 5).alias("seller_hosts"),
        (_h(8) % 3).alias("today_hosts"),
        *[(_h(i) % n != 0).alias(name) for i, n, name in ((9, 8, "moved"), (10, 4, "buyer_use"))],
        *[(_h(i) % n == 0).alias(name) for i, n, name in ((11, 12, "for_sale"), (12, 20, "suspended"), (13, 12, "platform"), (14, 20, "expiry_origin"), (15, 20, "expiry_destination"), (16, 2, "mandated"), (17, 4, "registrar_origin"), (18, 3, "prior_listing"), (19, 10, "relisted"), (20, 9, "lookup_failed"), (21, 15, "spam"))],
        F.element_at(F.array(*[F.array(*[F.lit(s) for s in x]) for x in STATUSES]), _h(22) % 8 + 1).alias("statuses"),
        F.element_at(F.array(*[F.array(*[F.lit(s) for s in x]) for x in STATUSES]), _h(23) % 8 + 1).alias("prev_statuses"),
        _pick(["1", "2", "3", None], 24).alias("registrar_id"),
        _pick(["1", "2", "3", None], 25).alias("prev_registrar_id"),
        _pick(["Acme", "acme", "Bolt"], 26).alias("registrar"),
        _pick(["Acme", "Bolt", None], 27).alias("prev_registrar"),
        F.when(_h(28) % 3 == 0, at(28, 60)).alias("transfer_at"),
        at(29, 60).alias("checked_at"),
        F.when(_h(30) % 2 == 0, F.lit(NOW).cast("timestamp") - F.make_dt_interval(hours=_h(30) % 120)).alias("observed_at"),
        at(31, 60).alias("prev_observed_at"),
        F.when(_h(32) % 6 == 0, at(32, 90)).alias("recorded_change_at"),
        F.when(_h(33) % 25 == 0, "verified").alias("reported_tier"),
        _pick(KINDS, 34).alias("site_kind"),
        _pick(["alpha", "standard", "weak"], 35).alias("name_quality"),
        title.alias("title"),
        F.when(_h(36) % 5 == 0, F.concat(label, F.lit(" at Market Hall"))).otherwise("Welcome").alias("heading"),
        F.when(_h(37) % 4 == 0, F.concat(label, F.lit(".example"))).when(_h(37) % 4 == 1, "elsewhere.example").otherwise(F.col("domain")).alias("final_host"),
    )
    return ops.destination_identity(saved(rows))  # a table, as departures are on file


def _at_sql(i: int, span: int) -> str:
    return f"(CAST(departure_day AS TIMESTAMP) + to_hours({_h_sql(i)} % {24 * span} - {12 * span}))"


_STATUS = "([" + ", ".join(str(x) for x in STATUSES) + "])"
_FLAGS = ", ".join(f"{_h_sql(i)} % {n} {op} 0 AS {name}" for i, n, op, name in ((9, 8, "<>", "moved"), (10, 4, "<>", "buyer_use"), (11, 12, "=", "for_sale"), (12, 20, "=", "suspended"), (13, 12, "=", "platform"), (14, 20, "=", "expiry_origin"), (15, 20, "=", "expiry_destination"), (16, 2, "=", "mandated"), (17, 4, "=", "registrar_origin"), (18, 3, "=", "prior_listing"), (19, 10, "=", "relisted"), (20, 9, "=", "lookup_failed"), (21, 15, "=", "spam")))
DEPARTURES = f"""WITH {NAMES}, gone AS (SELECT label || '.' || zone AS domain, min(day) FILTER (WHERE kind = 'purchase') AS departure_day FROM names GROUP BY 1 HAVING min(day) FILTER (WHERE kind = 'purchase') IS NOT NULL),
rows0 AS (SELECT domain, departure_day, split_part(domain, '.', 1) AS lab, departure_day - 1 - {_h_sql(1)} % 4 AS prev_day, CASE WHEN {_h_sql(2)} % 3 = 0 THEN departure_day - {_h_sql(2)} % 5 END AS last_changed, {_pick_sql(CLASSES, 3)} AS prev_class, {_pick_sql(CLASSES, 4)} AS today_class,
  {_h_sql(5)} % 24 - 8 AS cohort, {_h_sql(6)} % 8 - 4 AS kit_size, {_h_sql(7)} % 5 AS seller_hosts, {_h_sql(8)} % 3 AS today_hosts, {_FLAGS}, {_STATUS}[{_h_sql(22)} % 8 + 1] AS statuses, {_STATUS}[{_h_sql(23)} % 8 + 1] AS prev_statuses,
  {_pick_sql(["1", "2", "3", None], 24)} AS registrar_id, {_pick_sql(["1", "2", "3", None], 25)} AS prev_registrar_id, {_pick_sql(["Acme", "acme", "Bolt"], 26)} AS registrar, {_pick_sql(["Acme", "Bolt", None], 27)} AS prev_registrar,
  CASE WHEN {_h_sql(28)} % 3 = 0 THEN {_at_sql(28, 60)} END AS transfer_at, {_at_sql(29, 60)} AS checked_at, CASE WHEN {_h_sql(30)} % 2 = 0 THEN TIMESTAMP '{NOW}' - to_hours({_h_sql(30)} % 120) END AS observed_at, {_at_sql(31, 60)} AS prev_observed_at, CASE WHEN {_h_sql(32)} % 6 = 0 THEN {_at_sql(32, 90)} END AS recorded_change_at,
  CASE WHEN {_h_sql(33)} % 25 = 0 THEN 'verified' END AS reported_tier, {_pick_sql(KINDS, 34)} AS site_kind, {_pick_sql(["alpha", "standard", "weak"], 35)} AS name_quality, {_h_sql(0)} % 6 AS ti, {_h_sql(36)} % 5 = 0 AS at_hall, {_h_sql(37)} % 4 AS fh FROM gone),
ident AS (SELECT *, regexp_replace(lab, '[^a-z0-9]', '', 'g') AS cl, fh = 0 AS redirect_aligned, ti = 2 AS template_title, fh = 1 AND (ti = 1 OR at_hall) AND NOT contains(lab, '-') OR fh = 1 AND contains(lab, '-') AND false AS attributed FROM rows0),
aligned AS (SELECT *, NOT template_title AND NOT attributed AND ti IN (0, 1, 3) AND length(cl) >= 2 AS title_aligned, NOT template_title AND NOT attributed AND at_hall AND length(cl) >= 2 AS heading_aligned FROM ident)"""


@query("r14_destination_identity", f"{DEPARTURES} SELECT domain, template_title, attributed, redirect_aligned, title_aligned, heading_aligned, title_aligned OR heading_aligned OR redirect_aligned AS aligned FROM aligned")
def r14_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return departures(spark, sf_dir).select("domain", "template_title", "attributed", "redirect_aligned", "title_aligned", "heading_aligned", "aligned")


def _near_sql(a: str, b: str, days: int) -> str:
    return f"coalesce(abs(epoch_us({a}) - epoch_us({b})) <= {days} * 86400000000, false)"


LADDER = f"""{DEPARTURES}, f0 AS (SELECT *, title_aligned OR heading_aligned OR redirect_aligned AS ok, CAST(CASE WHEN departure_day - prev_day > 1 AND last_changed > prev_day AND last_changed <= departure_day THEN last_changed ELSE departure_day END AS TIMESTAMP) AS dep, epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(observed_at, checked_at)) AS age FROM aligned),
f1 AS (SELECT *, list_contains(statuses, 'pendingtransfer') AS pending, expiry_origin OR expiry_destination OR list_contains(statuses, 'redemptionperiod') AS expiration, {_near_sql("transfer_at", "dep", 7)} AS recent, {_near_sql("transfer_at", "dep", 14)} AS recent14, {_near_sql("recorded_change_at", "dep", 30)} AS recorded,
  NOT lookup_failed AND {_near_sql("prev_observed_at", "checked_at", 14)} AND CASE WHEN registrar_id IS NOT NULL AND prev_registrar_id IS NOT NULL THEN registrar_id <> prev_registrar_id ELSE list_contains(prev_statuses, 'pendingtransfer') AND NOT list_contains(statuses, 'pendingtransfer') AND coalesce(lower(registrar) <> lower(prev_registrar), false) END AS rchanged,
  age > 3 * 86400000000 OR age < -86400000000 AS stale, cohort >= 10 AND today_class NOT IN ('registrar', 'hosting') AS bm, kit_size >= 3 AS ba, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(dep)) / 86400000000) AS BIGINT) AS since FROM f0),
f2 AS (SELECT *, rchanged OR recorded OR recent AS hands, recent14 OR pending OR rchanged OR recorded AS near, NOT (for_sale OR expiration OR suspended OR platform OR bm OR ba) AS clean, moved AND buyer_use AND ok AND coalesce(site_kind = 'operating', false) AND NOT for_sale AND NOT expiration AND NOT suspended AS in_use FROM f1),
f3 AS (SELECT *, CASE WHEN reported_tier IS NOT NULL THEN 'reported-sale' WHEN expiration THEN 'expiration' WHEN suspended THEN 'registry-hold' WHEN (bm OR ba) AND NOT stale THEN 'portfolio-kit' WHEN pending AND NOT stale THEN 'transfer-in-progress' WHEN platform THEN 'platform-destination' WHEN for_sale THEN 'lander-migration'
  WHEN moved AND prev_class IN ('registrar', 'hosting') AND seller_hosts > 0 AND mandated AND near AND NOT prior_listing THEN 'owner-migration' WHEN prev_class = 'seller' AND moved AND near AND clean AND NOT relisted THEN 'likely-sale:transfer' WHEN moved AND seller_hosts > 0 AND NOT registrar_origin AND in_use AND NOT bm AND NOT ba AND hands AND NOT relisted THEN 'likely-sale:built'
  WHEN prev_class = 'seller' AND moved AND clean AND today_class IN ('registrar', 'hosting', 'other') AND since >= 14 AND NOT relisted THEN 'likely-sale:off-market' WHEN registrar_origin AND moved AND in_use AND hands AND NOT bm AND NOT ba AND NOT stale THEN 'transferred-and-built' WHEN moved AND hands AND NOT ba AND NOT stale THEN 'transfer-completed'
  WHEN in_use AND NOT registrar_origin AND NOT stale THEN 'acquisition-candidate' WHEN moved AND prev_class = 'seller' AND today_hosts > 0 AND NOT bm AND NOT stale AND {_near_sql("dep", f"TIMESTAMP '{NOW}'", 3)} THEN 'seller-departure' ELSE 'unconfirmed-move' END AS rung FROM f2),
f4 AS (SELECT *, split_part(rung, ':', 1) AS c0, CASE WHEN reported_tier IS NOT NULL THEN reported_tier WHEN rung IN ('expiration', 'registry-hold', 'platform-destination', 'lander-migration', 'owner-migration') THEN 'excluded' WHEN rung IN ('transfer-in-progress', 'transfer-completed') THEN 'transfer' WHEN starts_with(rung, 'likely') THEN 'probable' ELSE 'suspected' END AS t0 FROM f3),
judged AS (SELECT *, reported_tier IS NULL AND t0 IN ('probable', 'suspected') AND seller_hosts > 0 AND NOT expiry_origin AND NOT (prior_listing OR prev_class IN ('seller', 'parking')) AS own FROM f4),
assessed AS (SELECT domain, CASE WHEN own THEN 'excluded' ELSE t0 END AS tier, CASE WHEN own THEN 'no-seller-origin' ELSE c0 END AS classification, CASE WHEN own THEN '' ELSE split_part(rung, ':', 2) END AS basis, CAST(dep AS DATE) AS departed, stale, expiration, name_quality, spam, kit_size FROM judged)"""


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.assess(departures(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query("r9_assessment_ladder", f"{LADDER} SELECT domain, tier, classification, basis, CAST(departed AS VARCHAR) AS departed, stale FROM assessed")
def r9_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("domain", "tier", "classification", F.coalesce("basis", F.lit("")).alias("basis"), F.col("departed").cast("string").alias("departed"), "stale")


@query(
    "r12_views",
    f"""{LADDER}, v AS (SELECT domain, unnest(['all', CASE WHEN classification IN ('likely-sale', 'acquisition-candidate', 'seller-departure', 'transfer-in-progress', 'transfer-completed', 'transferred-and-built') AND NOT expiration THEN 'leads' END,
  CASE WHEN classification IN ('likely-sale', 'acquisition-candidate') AND name_quality = 'alpha' AND NOT spam AND kit_size < 3 THEN 'alpha' END, CASE WHEN classification IN ('likely-sale', 'acquisition-candidate', 'transfer-in-progress', 'transfer-completed', 'transferred-and-built') THEN 'focus' END,
  CASE WHEN tier IN ('transfer', 'probable', 'suspected', 'excluded') THEN tier END]) AS view FROM assessed WHERE classification <> 'reported-sale') SELECT domain, view FROM v WHERE view IS NOT NULL""",
)
def r12_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.views(assessed(spark, sf_dir)).select("domain", "view")


VENUES = ["resale marketplace or reseller", "registrar default parking", "hosting", None]
PAGES_OF = [(38, 5, "<>", "page_checked"), (39, 8, "=", "page_for_sale"), (40, 8, "=", "page_parked"), (41, 8, "=", "page_placeholder"), (42, 3, "<>", "page_active"), (43, 3, "=", "transfer_after"), (44, 9, "=", "parking"), (45, 6, "=", "page_error")]
_SHOWN = ", ".join(f"{_h_sql(i)} % {n} {op} 0 AS {name}" for i, n, op, name in PAGES_OF)


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessed departures with what is known of their venue, registration and page."""
    flags = [(_h(i) % n != 0 if op == "<>" else _h(i) % n == 0).alias(name) for i, n, op, name in PAGES_OF]
    facts = assessed(spark, sf_dir)
    rows = facts.select("*", *flags, _pick(VENUES, 46).alias("venue_class"), (_h(47) % 40 - 2).alias("other_extensions"), F.when(_h(48) % 4 != 0, F.date_sub("departed", _h(49) % 12000)).alias("registered"), F.when(_h(50) % 4 != 0, 200 + _h(50) % 300).alias("page_status"))
    return rows


SHOWN = f"""{LADDER}, shown AS (SELECT a.*, j.relisted, j.in_use, j.bm, j.ti, j.buyer_use, j.suspended, j.today_class, j.prev_class, j.cohort, {_SHOWN}, {_pick_sql(VENUES, 46)} AS venue_class, {_h_sql(47)} % 40 - 2 AS other_extensions, CASE WHEN {_h_sql(48)} % 4 <> 0 THEN a.departed - {_h_sql(49)} % 12000 END AS registered, CASE WHEN {_h_sql(50)} % 4 <> 0 THEN 200 + {_h_sql(50)} % 300 END AS page_status
  FROM assessed a JOIN judged j USING (domain)),
taped AS (SELECT *, CASE WHEN venue_class = 'registrar default parking' THEN CASE WHEN transfer_after THEN 'aftermarket' ELSE 'builder' END WHEN departed - registered <= 90 THEN 'builder' WHEN venue_class = 'resale marketplace or reseller' THEN 'aftermarket' ELSE 'noise' END AS tape FROM shown)"""


@query(
    "r10_derived_rows",
    f"""{SHOWN} SELECT domain, tape, CASE WHEN registered IS NULL THEN '' WHEN year(registered) < 2000 THEN 'before 2000' WHEN year(registered) < 2010 THEN '2000-2009' WHEN year(registered) < 2020 THEN '2010-2019' ELSE '2020 or later' END AS year_band,
  CASE WHEN other_extensions < 0 THEN '' WHEN other_extensions = 0 THEN '0 other' WHEN other_extensions <= 4 THEN '1-4 other' WHEN other_extensions <= 19 THEN '5-19 other' ELSE '20+ other' END AS extension_band,
  CASE WHEN length(split_part(domain, '.', 1)) <= 4 THEN '1-4' WHEN length(split_part(domain, '.', 1)) <= 6 THEN '5-6' WHEN length(split_part(domain, '.', 1)) <= 8 THEN '7-8' WHEN length(split_part(domain, '.', 1)) <= 11 THEN '9-11' ELSE '12+' END AS length_band,
  CASE WHEN NOT page_checked THEN 'site not checked' WHEN page_for_sale THEN 'for sale' WHEN page_parked THEN 'parked' WHEN page_placeholder THEN 'no site yet' WHEN page_active AND (page_status IS NULL OR page_status < 400) THEN 'live site' ELSE 'no site yet' END AS page_state,
  coalesce(CASE WHEN kit_size >= 3 OR bm THEN NULL WHEN classification = 'likely-sale' THEN CASE basis WHEN 'built' THEN 'transfer + branded site' WHEN 'transfer' THEN 'marketplace exit + registrar transfer' WHEN 'off-market' THEN 'off market 14+ days' END
    WHEN classification = 'transfer-completed' THEN CASE WHEN in_use THEN 'transfer + branded site' ELSE 'marketplace exit + registrar transfer' END WHEN classification = 'transfer-in-progress' AND venue_class = 'resale marketplace or reseller' THEN 'transfer pending'
    WHEN classification = 'acquisition-candidate' AND (tape = 'builder' OR tape = 'aftermarket' AND venue_class = 'resale marketplace or reseller') AND in_use AND NOT relisted AND NOT expiration AND NOT parking THEN 'branded site launched' END, '') AS lead_reason FROM taped""",
)
def r10_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.derive(shown(spark, sf_dir)).select("domain", "tape", *[F.coalesce(c, F.lit("")).alias(c) for c in ("year_band", "extension_band", "length_band", "page_state", "lead_reason")])


@query(
    "r10_timelines",
    f"""WITH {NAMES}, m AS (SELECT label || '.' || zone AS domain, min(epoch_us(ts)) AS w FROM names WHERE kind = 'purchase' GROUP BY 1), o AS (SELECT label || '.' || zone AS domain, epoch_us(ts) AS w, CASE WHEN kind <> 'view' THEN kind END AS kind, CASE WHEN kind <> 'click' THEN host END AS detail FROM names WHERE kind <> 'purchase'),
r AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY domain ORDER BY w DESC, kind DESC NULLS LAST, detail DESC NULLS LAST) <= 11),
t AS (SELECT domain, 0 AS f, w, 'movement' AS kind, 'left' AS detail FROM m UNION ALL SELECT domain, 1, w, coalesce(kind, 'probe'), coalesce(nullif(detail, ''), 'observed') FROM r)
SELECT domain, string_agg(CAST(w AS VARCHAR) || ' ' || kind || ' ' || detail, '; ' ORDER BY f, w) AS timeline FROM t GROUP BY 1""",
)
def r10_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).select(F.concat_ws(".", "label", "zone").alias("domain"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "kind", "host")
    moves = seen.where("kind = 'purchase'").groupBy("domain").agg(F.min("at").alias("at")).withColumn("detail", F.lit("left"))
    rest = seen.where("kind <> 'purchase'").select("domain", "at", F.when(F.col("kind") != "view", F.col("kind")).alias("kind"), F.when(F.col("kind") != "click", F.col("host")).alias("detail"))
    shown_ = F.array_join(F.transform("timeline", lambda e: F.concat_ws(" ", e["at"].cast("string"), e["kind"], e["detail"])), "; ")
    return derived.timelines(moves, rest).select("domain", shown_.alias("timeline"))


STATES = ["exited", "probing", "transferring", "parked-watch"]
KITS = [None, None, None, "k1", "k2", "k3"]


@query(
    "r11_probe_order",
    f"""{SHOWN}, p0 AS (SELECT *, {_pick_sql(STATES, 51)} AS state, {_h_sql(52)} % 3 AS probe_count, {_pick_sql(KITS, 53)} AS kit, {_h_sql(54)} % 3 AS alpha_rank, {_h_sql(55)} % 2 AS theme_rank, CASE WHEN {_h_sql(56)} % 4 <> 0 THEN today_class END AS moved_to, prev_class = 'seller' AS left_seller FROM taped),
p AS (SELECT *, coalesce(classification IN ('expiration', 'registry-hold'), false) OR expiration OR suspended AS deferred, CASE WHEN state = 'transferring' THEN 0 ELSE 1 + 2 * alpha_rank + theme_rank END AS score FROM p0),
q AS (SELECT domain FROM p WHERE kit IS NOT NULL AND probe_count = 0 AND NOT deferred QUALIFY row_number() OVER (PARTITION BY kit ORDER BY score, domain) <= 3)
SELECT domain, CAST(CASE WHEN probe_count = 0 AND NOT deferred THEN CASE WHEN kit IS NULL OR domain IN (SELECT domain FROM q) THEN -100 ELSE -50 END + score WHEN probe_count = 0 THEN 6 WHEN state = 'transferring' THEN 0 WHEN deferred OR parking THEN 5 WHEN classification = 'likely-sale' THEN -1
  WHEN buyer_use AND NOT page_error THEN 1 WHEN cohort < 10 AND moved_to = 'hosting' THEN 1 WHEN cohort < 10 AND moved_to = 'other' THEN 2 WHEN cohort < 100 AND moved_to = 'hosting' THEN 2 WHEN moved_to IS NOT NULL AND cohort >= 100 THEN 4 WHEN moved_to IS NULL AND left_seller THEN 4 ELSE 3 END AS INTEGER) AS priority FROM p""",
)
def r11_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shown(spark, sf_dir).select(
        "domain", "classification", "expiration", "suspended", "parking", "buyer_use", "page_error", "cohort", _pick(STATES, 51).alias("state"), (_h(52) % 3).alias("probe_count"), _pick(KITS, 53).alias("kit"),
        (_h(54) % 3).alias("alpha_rank"), (_h(55) % 2).alias("theme_rank"), F.when(_h(56) % 4 != 0, F.col("today_class")).alias("moved_to"), (F.col("prev_class") == "seller").alias("left_seller"),
    )
    return derived.probe_order(rows).select("domain", "priority")


@query(
    "c12_better_sales",
    f"""WITH {LISTINGS}, o AS (SELECT label, zone, listing_id % 3 <> 0 AS checked, bids > 2 AS live, stream = 'auction' OR price IS NOT NULL AS for_sale, price, ends_at, CAST(listing_id AS VARCHAR) AS url FROM listings)
SELECT label, zone, url, coalesce(price, -1) AS price FROM o QUALIFY row_number() OVER (PARTITION BY label, zone ORDER BY checked OR for_sale DESC, live DESC, for_sale DESC, price IS NOT NULL DESC, coalesce(price, 0), ends_at NULLS LAST, url) = 1""",
)
def c12_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.listings(spark, sf_dir)
    offers = rows.select("label", "zone", (F.col("listing_id") % 3 != 0).alias("checked"), (F.col("bids") > 2).alias("live"), ((F.col("stream") == "auction") | F.col("price").isNotNull()).alias("for_sale"), "price", "ends_at", F.col("listing_id").cast("string").alias("url"))
    return derived.better_sales(offers).select("label", "zone", "url", F.coalesce("price", F.lit(-1.0)).alias("price"))


@query(
    "c16_keyword_merge",
    f"""WITH {NAMES}, ob AS (SELECT upper(label) || ' ' AS keyword, day, count(DISTINCT zone) AS n_zones, count(*) AS new_zones, string_agg(DISTINCT zone, ',' ORDER BY zone) AS zones, 'observed' AS source FROM names WHERE kind = 'signup' GROUP BY label, day),
zo AS (SELECT label AS keyword, day, count(DISTINCT zone) AS n_zones, count(*) AS new_zones, string_agg(DISTINCT zone, ',' ORDER BY zone) AS zones, CASE WHEN length(label) % 2 = 0 THEN 'daily-diff' ELSE 'observed' END AS source FROM names WHERE kind IN ('purchase', 'click') GROUP BY label, day),
al AS (SELECT *, 0 AS f FROM ob UNION ALL SELECT *, 1 FROM zo), k AS (SELECT lower(trim(keyword)) AS keyword, day, n_zones, new_zones, zones, source, f FROM al)
SELECT keyword, CAST(max(day) AS VARCHAR) AS day, max(n_zones) AS n_zones, max(new_zones) AS new_zones, arg_max(zones, {{'d': day, 'f': -f}}) AS zones, CASE WHEN count(DISTINCT source) = 1 THEN min(source) ELSE 'observed+daily-diff' END AS source FROM k GROUP BY keyword ORDER BY max(day) DESC, max(new_zones) DESC, max(n_zones) DESC, keyword LIMIT 200""",
)
def c16_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    daily = lambda rows: rows.groupBy("label", "day").agg(F.count_distinct("zone").alias("n_zones"), F.count("*").alias("new_zones"), F.array_join(F.sort_array(F.collect_set("zone")), ",").alias("zones"))
    observed = daily(seen.where("kind = 'signup'")).select(F.concat(F.upper("label"), F.lit(" ")).alias("keyword"), "day", "n_zones", "new_zones", "zones", F.lit("observed").alias("source"))
    zones = daily(seen.where("kind IN ('purchase', 'click')")).select(F.col("label").alias("keyword"), "day", "n_zones", "new_zones", "zones", F.when(F.length("label") % 2 == 0, "daily-diff").otherwise("observed").alias("source"))
    return derived.merged_trends(observed, zones, 200).withColumn("day", F.col("day").cast("string"))


FIELDS = [*opportunities.QUALITY, *opportunities.MOST]
_ALLOWED = ["candidate", "substitute", "equivalent", None]


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sighted names as candidates, with their assessed quality, offers and evidence, and the sources that speak of their category; all follows from the names."""
    seen = market.names(spark, sf_dir).groupBy(F.concat_ws(".", "label", "zone").alias("domain")).agg(F.count("*").alias("current_labels"), F.count_distinct("day").alias("active_days"))
    now = F.lit(NOW).cast("timestamp")
    rows = seen.select(
        "domain",
        "current_labels",
        "active_days",
        *[F.when(_h(60 + i) % 40 != 0, (9 + _h(60 + i) % 12 / 10 - F.when(_h(60 + i) % 17 == 0, 3).otherwise(0)) if f not in opportunities.MOST else _h(60 + i) % 10 / 4).alias(f) for i, f in enumerate(FIELDS)],
        (F.lit(0.7) + _h(75) % 30 / 100).alias("confidence"),
        F.when(_h(76) % 20 != 0, (_h(76) % 9 + 1) * 100.0).alias("price"),
        F.when(_h(77) % 3 == 0, 800.0).alias("max_price"),
        F.when(_h(78) % 10 != 0, "other.example").alias("substitute"),
        (_h(79) % 20 * 1000.0).alias("substitute_price"),
        (_h(80) % 12 * 1000.0).alias("retail_ceiling"),
        _pick(_ALLOWED, 81).alias("preference"),
        (_h(82) % 40 / 100 + 0.6).alias("substitute_confidence"),
        (_h(83) % 60 / 100 + 0.4).alias("substitution_strength"),
        (_h(84) % 3 == 0).alias("accelerating"),
        (_h(85) % 30 * 1.0).alias("renewal"),
        (_h(86) % 110 / 100).alias("fee"),
        (_h(87) % 100 / 100).alias("probability"),
        (_h(88) % 30 * 1000.0).alias("sale_price"),
        _pick(["stated", "stated", "stated", ""], 89).alias("assumptions"),
        _pick(["available", "listed", "sold"], 90).alias("quote_status"),
        _pick(["acme", "acme", " "], 91).alias("quote_provider"),
        F.when(_h(92) % 8 == 0, "x.com").otherwise(F.upper("domain")).alias("quote_domain"),
        F.when(_h(76) % 20 != 0, (_h(76) % 9 + 1) * 100.0 + F.when(_h(93) % 9 == 0, 1.0).otherwise(0.0)).alias("quote_price"),
        (now - F.make_dt_interval(hours=_h(94) % 30 - 2)).alias("quoted_at"),
        (_h(95) % 6 != 0).alias("review_passed"),
        F.when(_h(96) % 7 == 0, F.array(F.lit("shop"))).otherwise(F.array(F.lit("shop"), F.lit("xyz"))).alias("excluded"),
        (_h(97) % 40).alias("distinct_labels"),
        F.when(_h(98) % 9 == 0, "absent").otherwise(F.substring("domain", 1, 3)).alias("token"),
    )
    each = rows.select("domain", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    h = lambda i: F.conv(F.substring(F.md5(F.concat("domain", F.col("k").cast("string"))), i, 4), 16, 10).cast("int")
    sources = each.select(
        "domain", F.when(h(1) % 5 == 0, "blog").otherwise("primary").alias("kind"), F.when(h(5) % 6 == 0, "vendor").otherwise("category").alias("scope"), F.when(h(9) % 7 == 0, "short").otherwise("a summary that is long enough").alias("summary"),
        F.concat(F.when(h(13) % 9 == 0, "ftp").otherwise("https"), F.lit("://www.site"), (h(17) % 3).cast("string"), F.lit(".press.example/a")).alias("url"), (now - F.make_dt_interval(days=h(21) % 220)).alias("published_at"),
    )
    return rows, sources.withColumn("url", F.replace("url", F.lit(".press.example"), F.lit(".example")))


def _field_sql(i: int, f: str) -> str:
    value = f"{_h_sql(60 + i)} % 10 / 4" if f in opportunities.MOST else f"9 + {_h_sql(60 + i)} % 12 / 10 - CASE WHEN {_h_sql(60 + i)} % 17 = 0 THEN 3 ELSE 0 END"
    return f"CASE WHEN {_h_sql(60 + i)} % 40 <> 0 THEN CAST({value} AS DOUBLE) END AS {f}"


def _array_sql(*tests: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in tests) + "], lambda x: x IS NOT NULL)"


_OVERALL = "floor((" + " + ".join(f"least({f}, 10) * {w}" for f, (_, w) in opportunities.QUALITY.items()) + ") * 10 * 100 + 0.5) / 100"
_QUALITY = _array_sql(*[(f"{f} < {least}", f) for f, (least, _) in opportunities.QUALITY.items()], *[(f"{f} > {most}", f) for f, most in opportunities.MOST.items()], ("confidence < 0.8", "confidence"), ("o < 76", "overall"))
_MISSING = "list_filter([" + ", ".join(f"CASE WHEN {f} IS NULL THEN 'missing:{f}' END" for f in [*FIELDS, "confidence"]) + "], lambda x: x IS NOT NULL)"
OPPORTUNITIES = f"""WITH {NAMES}, s0 AS (SELECT label || '.' || zone AS domain, count(*) AS current_labels, count(DISTINCT day) AS active_days FROM names GROUP BY 1), ca AS (SELECT *, {", ".join(_field_sql(i, f) for i, f in enumerate(FIELDS))}, 0.7 + CAST({_h_sql(75)} % 30 AS DOUBLE) / 100 AS confidence,
  CASE WHEN {_h_sql(76)} % 20 <> 0 THEN ({_h_sql(76)} % 9 + 1) * 100e0 END AS price, CASE WHEN {_h_sql(77)} % 3 = 0 THEN 800e0 END AS max_price, {_h_sql(78)} % 10 <> 0 AS has_sub, {_h_sql(79)} % 20 * 1000e0 AS sub, {_h_sql(80)} % 12 * 1000e0 AS ceil_, {_pick_sql(_ALLOWED, 81)} AS preference, {_h_sql(82)} % 40 AS sc, {_h_sql(83)} % 60 AS ss, {_h_sql(84)} % 3 = 0 AS accelerating,
  {_h_sql(85)} % 30 * 1e0 AS renewal, {_h_sql(86)} % 110 / 100 AS fee, {_h_sql(87)} % 100 / 100 AS probability, {_h_sql(88)} % 30 * 1000e0 AS sale, {_h_sql(89)} % 4 < 3 AS stated, {_h_sql(90)} % 3 < 2 AND {_h_sql(91)} % 3 < 2 AND {_h_sql(92)} % 8 <> 0 AND {_h_sql(76)} % 20 <> 0 AND {_h_sql(93)} % 9 <> 0 AND {_h_sql(94)} % 30 - 2 BETWEEN 0 AND 24 AS quoted,
  {_h_sql(95)} % 6 <> 0 AS review, {_h_sql(96)} % 7 <> 0 AS no_xyz, {_h_sql(97)} % 40 AS distinct_labels, {_h_sql(98)} % 9 <> 0 AS has_token FROM s0),
so AS (SELECT domain, k, md5(domain || CAST(k AS VARCHAR)) AS m FROM s0, range(4) r(k)), sn AS (SELECT domain, CAST('0x' || m[1:4] AS INTEGER) % 5 <> 0 AND CAST('0x' || m[5:8] AS INTEGER) % 6 <> 0 AND CAST('0x' || m[9:12] AS INTEGER) % 7 <> 0 AND CAST('0x' || m[13:16] AS INTEGER) % 9 <> 0 AS fine, CAST('0x' || m[17:20] AS INTEGER) % 3 AS site, CAST('0x' || m[21:24] AS INTEGER) % 220 AS age FROM so),
ad AS (SELECT domain, count(DISTINCT site) AS publishers, min(age) AS newest FROM sn WHERE fine AND age <= 180 GROUP BY 1),
x AS (SELECT *, {_OVERALL} AS o, {_MISSING} AS missing, CASE WHEN price > 0 AND ceil_ > 0 THEN ceil_ / price END AS up, probability * sale * (1 - fee) - (price + 4 * renewal) AS profit FROM ca LEFT JOIN ad USING (domain)),
g AS (SELECT domain, CASE WHEN len(missing) > 0 THEN 0 ELSE o END AS overall, CASE WHEN len(missing) > 0 THEN missing ELSE {_QUALITY} END AS q, {_array_sql(("price IS NULL OR price <= 0", "price"), ("max_price <= 0", "maximum"), ("price > max_price", "above-maximum"))} AS b,
  {_array_sql(("NOT has_sub", "substitute"), ("price IS NULL", "price"), ("sub <= 0", "substitute-price"), ("ceil_ <= 0", "ceiling"), ("preference IS NULL", "preference"), ("sc / 100 + 0.6 < 0.75", "confidence"), ("ss / 100 + 0.4 < 0.6", "strength"), ("preference IN ('substitute', 'equivalent') AND ceil_ > sub", "above-substitute"), ("up < 10", "upside"))} AS s,
  {_array_sql(("coalesce(publishers, 0) < 2", "publishers"), ("accelerating AND NOT coalesce(newest <= 90, false)", "acceleration"))} AS a, {_array_sql(("NOT quoted", "quote"), ("fee >= 1 OR probability <= 0 OR sale <= 0 OR NOT stated", "assumptions"), ("profit IS NULL OR profit <= 0", "profit"))} AS e,
  {_array_sql(("NOT review", "review"), ("NOT no_xyz", "xyz"), ("current_labels < 3 OR distinct_labels < 10 OR active_days < 3", "one-off"), ("NOT has_token OR split_part(domain, '.', 2) IN ('xyz', 'shop', 'info')", "vocabulary"))} AS r, floor(up * 100 + 0.5) / 100 AS upside, profit, price, active_days, current_labels, distinct_labels FROM x)"""


@query("r6_opportunity_gates", f"{OPPORTUNITIES} SELECT domain, round(overall, 2) AS overall, array_to_string(q, ',') AS quality_reasons, array_to_string(b, ',') AS budget_reasons, array_to_string(s, ',') AS substitute_reasons, array_to_string(a, ',') AS adoption_reasons, array_to_string(e, ',') AS economics_reasons, array_to_string(r, ',') AS registration_reasons, len(q) + len(b) + len(s) + len(a) + len(e) + len(r) = 0 AS passed FROM g")
def r6_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources = candidates(spark, sf_dir)
    found = opportunities.ranked_opportunities(saved(rows), sources, F.lit(NOW).cast("timestamp"))
    return found.select("domain", F.round("overall", 2).alias("overall"), *[F.array_join(f"{g}_reasons", ",").alias(f"{g}_reasons") for g in ("quality", "budget", "substitute", "adoption", "economics", "registration")], "passed")


EVIDENCE = "t AS (SELECT DISTINCT label, zone FROM names), c AS (SELECT zone FROM names GROUP BY 1 HAVING max(event_id) % 2 = 0), e AS (SELECT l.label, z.zone, CASE WHEN t.label IS NOT NULL THEN 'taken' WHEN c.zone IS NOT NULL THEN 'not_taken' ELSE 'unknown' END AS state FROM (SELECT DISTINCT label FROM names) l CROSS JOIN (SELECT unnest(['com', 'net', 'ai', 'io']) AS zone) z LEFT JOIN t ON t.label = l.label AND t.zone = z.zone LEFT JOIN c ON c.zone = z.zone)"


@query(
    "b12_sibling_matches",
    f"WITH {NAMES}, {EVIDENCE}, g AS (SELECT label, count(*) FILTER (WHERE state = 'taken') AS t, count(*) FILTER (WHERE state = 'not_taken') AS n, count(*) FILTER (WHERE state <> 'unknown') AS k FROM e WHERE zone IN ('com', 'ai') GROUP BY 1) SELECT label, 'all taken' AS rule FROM g WHERE t = 2 UNION ALL SELECT label, 'any taken' FROM g WHERE t >= 1 UNION ALL SELECT label, 'all free' FROM g WHERE n = 2 UNION ALL SELECT label, 'any free' FROM g WHERE n >= 1 UNION ALL SELECT label, 'known' FROM g WHERE k = 2",
)
def b12_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    covered = seen.groupBy("zone").agg(F.max("event_id").alias("m")).where("m % 2 = 0")
    evidence = saved(coverage.sibling_evidence(seen, seen, covered, ["com", "net", "ai", "io"]))
    rules = {"all taken": ("taken", "all"), "any taken": ("taken", "any"), "all free": ("not_taken", "all"), "any free": ("not_taken", "any"), "known": ("any", "all")}
    found = [coverage.sibling_matches(evidence, ["com", "ai"], mode=mode, match=match).withColumn("rule", F.lit(rule)) for rule, (mode, match) in rules.items()]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


@query("d1_universe_totals", f"WITH {NAMES}, o AS (SELECT DISTINCT label, zone FROM names), s AS (SELECT label, count(*) AS n FROM o GROUP BY 1) SELECT zone, count(*) AS labels, count(*) FILTER (WHERE n >= 2) AS shared, count(*) FILTER (WHERE n = 1) AS alone FROM o JOIN s USING (label) GROUP BY 1")
def d1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_ops.universe_totals(market.names(spark, sf_dir))


@query(
    "d7_token_sources",
    f"WITH {NAMES}, o AS (SELECT DISTINCT label AS token, label || '.' || zone AS domain, host AS source FROM names WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-30'), s AS (SELECT token, source, count(*) AS n FROM o GROUP BY 1, 2) SELECT token, count(DISTINCT domain) AS domains, (SELECT string_agg(source, ',' ORDER BY source) FROM s WHERE s.token = o.token) AS sources, (SELECT arg_min(source, {{'d': -n, 's': source}}) FROM s WHERE s.token = o.token) AS busiest FROM o GROUP BY 1",
)
def d7_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = market.names(spark, sf_dir).select(F.col("label").alias("token"), F.concat_ws(".", "label", "zone").alias("domain"), F.col("host").alias("source"), "day")
    return trends.token_sources(events, F.lit("2024-01-10").cast("date"), F.lit("2024-01-30").cast("date"))


@query("d13_facet_counts", f"{SHOWN}, v AS (SELECT unnest([{{'facet': 'day', 'value': CAST(departed AS VARCHAR)}}, {{'facet': 'class', 'value': classification}}, {{'facet': 'tape', 'value': tape}}, {{'facet': 'basis', 'value': nullif(basis, '')}}]) AS x FROM taped) SELECT x.facet AS facet, x.value AS value, count(*) AS n FROM v WHERE x.value IS NOT NULL GROUP BY 1, 2")
def d13_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.derive(shown(spark, sf_dir))
    return derived.facet_counts(rows, {"day": F.col("departed"), "class": F.col("classification"), "tape": F.col("tape"), "basis": F.col("basis")})


@query(
    "d13_split_counts",
    f"WITH {NAMES}, d AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS e FROM part), p AS (SELECT DISTINCT a.e || b.e AS stem FROM d a, d b), l AS (SELECT DISTINCT label FROM names), k AS (SELECT CASE WHEN p.stem IS NOT NULL THEN '2' ELSE 'invented' END AS words FROM l LEFT JOIN p ON p.stem = replace(regexp_replace(label, '[0-9]*$', ''), '-', '')) SELECT words, count(*) AS n, round(count(*) / (SELECT count(*) FROM k), 6) AS share FROM k GROUP BY 1",
)
def d13_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.split_counts(name_words(market.names(spark, sf_dir), dictionary(spark, sf_dir)))


@query(
    "t31_ranked_search",
    r"WITH d AS (SELECT doc_id, source AS name, left(text, 60) AS title, lang AS description, text AS body, doc_id % 5 = 0 AS junk FROM documents), m AS (SELECT doc_id, junk, [regexp_matches(coalesce(name, ''), p), regexp_matches(coalesce(title, ''), p), regexp_matches(coalesce(description, ''), p), regexp_matches(coalesce(body, ''), p)] AS h FROM d, (SELECT '(?i)(^|[^A-Za-z0-9_])of[^A-Za-z0-9]+the([^A-Za-z0-9_]|$)' AS p)) SELECT doc_id, CASE WHEN h[1] THEN 'name' WHEN h[2] THEN 'title' WHEN h[3] THEN 'description' ELSE 'body' END AS match, CASE WHEN h[1] THEN 0 WHEN h[2] THEN 1 WHEN h[3] THEN 2 ELSE 3 END AS rank FROM m WHERE h[1] OR NOT junk AND (h[2] OR h[3] OR h[4])",
)
def t31_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = market.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), F.substring("text", 1, 60).alias("title"), F.col("lang").alias("description"), F.col("text").alias("body"), (F.col("doc_id") % 5 == 0).alias("junk"))
    return ledger.ranked_literal_search(docs, "of the", {"name": "name", "title": "title", "description": "description", "body": "body"}, junk="junk").select("doc_id", "match", "rank")


@query(
    "d23_snapshot_health",
    f"WITH {NAMES}, m AS (SELECT zone, CASE WHEN zone <> 'xyz' THEN max(ts) END AS g, CASE WHEN length(zone) = 2 THEN max(ts) + INTERVAL 5 HOUR END AS v, count(*) FILTER (WHERE kind = 'purchase' AND zone <> 'net') AS n FROM names GROUP BY zone), a AS (SELECT zone, g, n, greatest(0, (epoch_us(TIMESTAMP '2024-01-31 00:30:00') - epoch_us(coalesce(v, g))) / 3600000000) AS age FROM m) SELECT zone, CASE WHEN g IS NULL THEN 'missing' WHEN n < 1 THEN 'invalid' WHEN age > 1 THEN 'stale' ELSE 'current' END AS status, coalesce(CASE WHEN g IS NOT NULL THEN round(age, 6) END, -1) AS age_hours FROM a",
)
def d23_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    meta = seen.groupBy("zone").agg(F.max("ts").alias("last"), F.count_if((F.col("kind") == "purchase") & (F.col("zone") != "net")).alias("count"))
    meta = meta.select("zone", F.when(F.col("zone") != "xyz", F.col("last")).alias("generated_at"), F.when(F.length("zone") == 2, F.col("last") + F.expr("INTERVAL 5 HOURS")).alias("verified_at"), "count")
    found = coverage.snapshot_health(meta, F.lit("2024-01-31 00:30:00").cast("timestamp"))
    return found.select("zone", "status", F.coalesce("age_hours", F.lit(-1.0)).alias("age_hours"))


@query("d16_built_counts", f"WITH {NAMES}, e AS (SELECT regexp_extract(label, '^[a-z]{{4}}') AS theme, label, bool_or(kind = 'signup') AS b FROM names GROUP BY label) SELECT theme, count(*) AS labels, count(*) FILTER (WHERE b) AS built FROM e GROUP BY 1")
def d16_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = market.names(spark, sf_dir).select(F.regexp_extract("label", "^[a-z]{4}", 0).alias("theme"), "label", "kind")
    return trends.built_counts(members, "theme", F.col("kind") == "signup")

"""Queries of converging themes, name types, operators' networks, coined terms, the lexicon and the search index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import containment, lexicon, networks, search_index, themes
from ..operators import miners as ops
from ..operators.names import segment_greedy
from ..operators.ranking import shared_folder
from ..operators.sites import page_features
from ..sources import market
from ..sources.market import LISTINGS, NAMES, SPLIT_DAY
from .name_queries import SEGMENTS, dictionary, segments
from .registry import query
from .site_queries import PAGES

WR = f"WITH RECURSIVE {NAMES}, {SEGMENTS}"
GENERIC, PLACES, PRODUCT, JUNK = ["small", "large"], ["cold", "widget"], ["com", "io", "ai", "dev"], "oldrod|rodold"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _windows_sql(text: str, size: int, without: str) -> str:
    return f"list_distinct(list_filter(list_transform(range(1, greatest(length({text}) - {size - 1}, 1) + 1), lambda i: substr({text}, i, {size})), lambda w: w <> '' AND NOT regexp_matches(w, '[{without}]')))"


def _used_sql(junk: str) -> str:
    """``now`` and ``past``: labels and zones of the two spans; ``kw`` and ``kp``: their labels of two known words or more."""
    fine = "regexp_matches(label, '^[a-z0-9-]{4,40}$') AND NOT starts_with(label, 'xn--')" + (f" AND NOT regexp_matches(label, '{junk}')" if junk else "")
    words = "SELECT label, list_filter(pieces, lambda p: p <> '?') AS w FROM segments"
    whole = "len(w) >= 2 AND length(array_to_string(w, '')) >= 0.75 * length(replace(label, '-', ''))"
    return f"""now AS (SELECT DISTINCT label, zone FROM names WHERE {fine} AND day > DATE '{SPLIT_DAY}'), past AS (SELECT DISTINCT label, zone FROM names WHERE {fine} AND day <= DATE '{SPLIT_DAY}'),
kw AS (SELECT * FROM ({words}) WHERE {whole} AND label IN (SELECT label FROM now)), kp AS (SELECT * FROM ({words}) WHERE {whole} AND label IN (SELECT label FROM past))"""


def _members_sql(words: str) -> str:
    place = "CASE WHEN i = 1 THEN 'prefix' WHEN i = len(w) THEN 'suffix' ELSE 'mid' END"
    return f"""(SELECT theme, label, {place} || ':' || CAST(len(w) AS VARCHAR) || CASE WHEN len(list_filter(o, lambda x: x NOT IN {_in(GENERIC)})) = 0 THEN 'w:gen' ELSE 'w:spec' END AS shape, list_filter(o[1:2], lambda x: x NOT IN {_in(GENERIC + PLACES)}) AS others
  FROM (SELECT label, w, theme, i, w[1:i - 1] || w[i + 1:] AS o FROM (SELECT label, w, w[i] AS theme, min(i) AS i FROM (SELECT label, w, unnest(range(1, len(w) + 1)) AS i FROM {words}) GROUP BY 1, 2, 3))
  WHERE length(theme) >= 4 AND theme NOT IN {_in(GENERIC + PLACES)} AND NOT regexp_matches(theme, '^[0-9]+$'))"""


THEMES = f"""{_used_sql(JUNK)}, m0 AS {_members_sql("kw")}, cn AS (SELECT theme, count(*) AS labels FROM m0 GROUP BY 1 HAVING count(*) >= 12), m AS (SELECT m0.* FROM m0 JOIN cn USING (theme)),
mk AS (SELECT theme, label, {_windows_sql("mask", 7, "|-")} AS runs FROM (SELECT theme, label, replace(label, theme, '|') AS mask FROM m)), rt AS (SELECT theme, count(*) FILTER (WHERE n <= 3) AS independent_roots, max(n) AS top_root FROM (SELECT theme, root, count(*) AS n FROM (SELECT theme, unnest(CASE WHEN len(runs) > 0 THEN runs ELSE [label] END) AS root FROM mk) GROUP BY 1, 2) GROUP BY 1),
sh AS (SELECT theme, count(DISTINCT shape) AS constructions, count(DISTINCT CASE WHEN contains(label, '-') THEN 'h' WHEN regexp_matches(label, '[0-9]') THEN 'd' ELSE 'p' END) AS styles FROM m GROUP BY 1),
co AS (SELECT theme, count(*) AS co_tokens, max(n) AS top_other FROM (SELECT theme, other, count(*) AS n FROM (SELECT theme, unnest(others) AS other FROM m) GROUP BY 1, 2) GROUP BY 1),
zn AS (SELECT theme, count(DISTINCT zone) AS zones, count(*) FILTER (WHERE zone IN {_in(PRODUCT)}) / count(*) AS product_share FROM m JOIN now USING (label) GROUP BY 1),
ks AS (SELECT theme, run, count(*) AS n FROM (SELECT theme, label, unnest({_windows_sql("label", 8, "-")}) AS run FROM m) WHERE run <> theme AND NOT (length(theme) >= 8 AND contains(theme, run)) GROUP BY 1, 2),
kr AS (SELECT theme, list(run) AS runs FROM (SELECT theme, run FROM ks JOIN cn USING (theme) WHERE n >= 12 AND n >= 0.2 * labels QUALIFY row_number() OVER (PARTITION BY theme ORDER BY n DESC, run) <= 4) GROUP BY 1),
kd AS (SELECT theme, label, coalesce(len(list_filter(runs, lambda r: contains(label, r))) > 0, false) AS swept FROM m LEFT JOIN kr USING (theme)), kc AS (SELECT theme, count(*) FILTER (WHERE swept) AS swept, count(*) FILTER (WHERE NOT swept) AS kept, count(*) FILTER (WHERE NOT swept AND contains(label, 'widget')) AS grid FROM kd GROUP BY 1),
pr AS (SELECT theme, count(*) AS was FROM {_members_sql("kp")} GROUP BY 1),
al AS (SELECT *, 1000e0 * labels / (SELECT count(DISTINCT label) FROM now) AS s, 1000e0 * coalesce(was, 0) / (SELECT greatest(count(DISTINCT label), 1) FROM past) AS r, swept / labels AS kit, top_root / labels AS top, coalesce(top_other, 0) / labels AS cos, grid / greatest(kept, 1) AS gs FROM cn JOIN rt USING (theme) JOIN sh USING (theme) JOIN zn USING (theme) JOIN kc USING (theme) LEFT JOIN co USING (theme) LEFT JOIN pr USING (theme) WHERE kept >= 12),
themes AS (SELECT theme, labels, independent_roots, constructions, coalesce(co_tokens, 0) AS co_tokens, zones, styles, round(s, 6) AS share, round(r, 6) AS ref_share, round((s + 0.02) / (r + 0.02), 6) AS rise, round(kit, 6) AS kit_share, round(top, 6) AS top_root_share, round(cos, 6) AS co_share, round(gs, 6) AS grid_share, round(product_share, 6) AS product_share,
  round(ln(1 + independent_roots) * ln(1 + constructions) * ln(1 + least(coalesce(co_tokens, 0), 60)) * ln(1 + zones) * (1 - top) * (1 - least(0.9, cos)) * (1 - kit) * CASE WHEN product_share < 0.5 THEN 0.3 ELSE 1 END * CASE WHEN gs > 0.5 THEN 0.5 ELSE 1 END, 6) AS convergence,
  concat_ws(',', CASE WHEN (s + 0.02) / (r + 0.02) >= 1.3 AND independent_roots >= 10 THEN 'rising' END, CASE WHEN r < 0.01 AND independent_roots >= 8 THEN 'new' END, CASE WHEN (s + 0.02) / (r + 0.02) >= 0.8 AND (s + 0.02) / (r + 0.02) < 1.3 THEN 'stable' END, CASE WHEN (s + 0.02) / (r + 0.02) <= 0.6 AND r >= 0.1 THEN 'fading' END) AS buckets FROM al)"""


def spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = market.names(spark, sf_dir)
    return seen.where(F.col("day") > F.lit(SPLIT_DAY).cast("date")), seen.where(F.col("day") <= F.lit(SPLIT_DAY).cast("date"))


def converging(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, past = spans(spark, sf_dir)
    return ops.converging_themes(now, past, segments(spark, sf_dir), generic=GENERIC, cities=PLACES, product_zones=PRODUCT, junk=JUNK)


@query("t17_converging_themes", f"{WR}, {THEMES} SELECT * FROM themes")
def t17_converging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converging(spark, sf_dir)


@query(
    "t20_targets_of_themes",
    f"""{WR}, {THEMES}, w AS (SELECT theme FROM themes ORDER BY buckets IN ('rising', 'rising,new', 'new') DESC, convergence DESC, theme LIMIT 5), tz AS (SELECT theme, label, zone FROM m JOIN now USING (label))
SELECT theme, label, zone FROM tz WHERE theme IN (SELECT theme FROM w) QUALIFY row_number() OVER (PARTITION BY theme ORDER BY zone = 'com' DESC, label, zone) <= 30
UNION ALL (SELECT 'sample', label, CASE WHEN bool_or(zone = 'com') THEN 'com' ELSE min(zone) END FROM tz GROUP BY label ORDER BY md5(label), label LIMIT 50)""",
)
def t20_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the five foremost themes: rising and new ones first, by convergence."""
    foremost = converging(spark, sf_dir).orderBy(F.desc(F.col("buckets").isin("rising", "rising,new", "new")), F.desc("convergence"), "theme").limit(5)
    now = ops.usable_labels(spans(spark, sf_dir)[0], JUNK)
    members = ops.theme_members(ops.known_words(now, segments(spark, sf_dir)), generic=GENERIC, cities=PLACES)
    counts = members.groupBy("theme").agg(F.count("*").alias("labels")).where("labels >= 12").select("theme")
    return themes.theme_targets(members.join(counts, "theme").join(now, "label").select("theme", "label", "zone"), foremost, 30, "com", sample=50)


def _kinds_sql(words: str) -> str:
    return f"""(SELECT DISTINCT label, 'suffix:*' || w[-1] AS kind FROM {words} WHERE length(w[-1]) >= 2 AND w[-1] NOT IN ('new') UNION SELECT label, 'prefix:' || w[1] || '*' FROM {words} WHERE length(w[1]) >= 2 AND w[1] NOT IN ('new')
  UNION SELECT label, 'theme:' || w[i] || ' ' || w[i + 1] FROM (SELECT label, w, unnest(range(1, len(w))) AS i FROM {words}) WHERE length(w[i]) >= 3 AND length(w[i + 1]) >= 3 AND w[i] NOT IN ('new') AND w[i + 1] NOT IN ('new')
  UNION SELECT label, 'grid:{{city}}+' || array_to_string(w[2:], '') FROM {words} WHERE w[1] IN {_in(PLACES)} UNION SELECT label, 'grid:' || array_to_string(w[:len(w) - 1], '') || '+{{city}}' FROM {words} WHERE w[-1] IN {_in(PLACES)})"""


@query(
    "t14_ranked_types",
    f"""{WR}, {_used_sql("")}, e0 AS {_kinds_sql("kw")}, cn AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE contains(label, '-')) AS hy, count(*) FILTER (WHERE regexp_matches(label, '[0-9]')) AS dg FROM e0 GROUP BY 1 HAVING count(*) >= 8), e AS (SELECT e0.* FROM e0 JOIN cn USING (kind)),
pr AS (SELECT kind, count(*) AS was FROM {_kinds_sql("kp")} GROUP BY 1), zn AS (SELECT kind, count(DISTINCT zone) AS zones, count(*) FILTER (WHERE zone IN {_in(PRODUCT)}) / count(*) AS product_share FROM e JOIN now USING (label) GROUP BY 1),
kt AS (SELECT kind, count(*) FILTER (WHERE z >= 3) AS kits FROM e JOIN (SELECT label, count(*) AS z FROM now GROUP BY 1) USING (label) GROUP BY 1),
mk AS (SELECT kind, list_reduce(list_prepend(label, regexp_extract_all(replace(regexp_replace(kind, '^[a-z]+:', ''), '{{city}}', ''), '[a-z0-9]+')), lambda m, x: replace(m, x, '|')) AS mask FROM e),
rt AS (SELECT kind, max(n) AS top_n, arg_min(root, {{'d': -n, 'r': root}}) AS dominant FROM (SELECT kind, root, count(*) AS n FROM (SELECT kind, unnest({_windows_sql("mask", 7, "|-")}) AS root FROM mk) GROUP BY 1, 2) GROUP BY 1),
al AS (SELECT *, 1000e0 * n / (SELECT count(DISTINCT label) FROM now) AS s, 1000e0 * coalesce(was, 0) / (SELECT greatest(count(DISTINCT label), 1) FROM past) AS r, coalesce(top_n, 0) / n AS conc, regexp_matches(regexp_replace(kind, '^[a-z]+:', ''), 'aaa|bbb|ccc|ddd|eee|ggg|lll|ooo|rrr|ttt') OR product_share < 0.35 OR regexp_matches(regexp_replace(kind, '^[a-z]+:', ''), '{JUNK}') AS junk FROM cn JOIN zn USING (kind) JOIN kt USING (kind) LEFT JOIN rt USING (kind) LEFT JOIN pr USING (kind))
SELECT kind, n, round(s, 6) AS share, round(r, 6) AS ref_share, round((s + 0.05) / (r + 0.05), 6) AS acceleration, round(product_share, 6) AS product_share, round(conc, 6) AS concentration, zones, kits, coalesce(dominant, '') AS dominant, junk,
  round(CASE WHEN regexp_matches(kind, '^(theme|grid):') THEN 1.6 ELSE 1 END * ln(1 + n) * least((s + 0.05) / (r + 0.05), 8) * (1 - conc) * CASE WHEN conc > 0.5 THEN 0.25 ELSE 1 END * CASE WHEN junk THEN 0.15 ELSE 1 END * (1 - 0.6 * hy / n) * (1 - 0.6 * dg / n), 6) AS score FROM al""",
)
def t14_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, past = spans(spark, sf_dir)
    return ops.ranked_types(now, past, segments(spark, sf_dir), stop=["new"], cities=PLACES, product_zones=PRODUCT, junk=JUNK)


SITE_STOP = ["the", "and", "of", "for", "get"]
SITES = """si AS (SELECT page_id AS site, DATE '2024-01-01' + CAST(page_id * 7 % 60 AS INTEGER) AS day, split_part(regexp_replace(host, '^(m|blog)\\.', ''), '.', 1) || CASE WHEN page_id % 4 = 0 THEN CAST(page_id AS VARCHAR) ELSE '' END AS label, title AS own, heading, page_id FROM f),
sites AS (SELECT site, day, label, CASE page_id % 3 WHEN 0 THEN 'Get ' || label || ' mod v' || CAST(page_id AS VARCHAR) || ' free latest build' WHEN 1 THEN own || ' ' || CAST(page_id AS VARCHAR) ELSE own END AS title, CASE WHEN page_id % 2 = 0 THEN 'a' ELSE CAST(page_id AS VARCHAR) END AS skeleton, [label] || list_filter(string_split(label, '-'), lambda x: length(x) >= 3) AS brand FROM si)"""


def observed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sites of some days: every third has a download page's title, with its label and number."""
    n = F.col("page_id")
    rows = page_features(market.table(spark, sf_dir, "pages")).select("page_id", "host", "title")
    label = F.concat(F.substring_index(F.regexp_replace("host", r"^(m|blog)\.", ""), ".", 1), F.when(n % 4 == 0, n.cast("string")).otherwise(""))
    rows = rows.withColumns({"label": label, "day": F.date_add(F.lit("2024-01-01").cast("date"), (n * 7 % 60).cast("int"))})
    title = F.when(n % 3 == 0, F.concat(F.lit("Get "), "label", F.lit(" mod v"), n.cast("string"), F.lit(" free latest build"))).when(n % 3 == 1, F.concat_ws(" ", "title", n.cast("string"))).otherwise(F.col("title"))
    brand = F.concat(F.array("label"), F.filter(F.split("label", "-"), lambda x: F.length(x) >= 3))
    return rows.select(n.alias("site"), "day", "label", title.alias("title"), F.when(n % 2 == 0, "a").otherwise(n.cast("string")).alias("skeleton"), brand.alias("brand"))


_LETTERS = "regexp_replace(CASE WHEN length(label) >= 3 THEN replace(strip_accents(lower(title)), label, ' ') ELSE strip_accents(lower(title)) END, '[^a-z0-9]+', '', 'g')"
_BARE = "regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '', 'g')"
_CONTENT = "len(list_filter({0}, lambda x: x NOT IN ('#', '*', 'the', 'and', 'of', 'for', 'get') AND length(x) >= 2))"
NETWORKS = f"""{PAGES}, {SITES},
k AS (SELECT site, 'l:' || label AS key FROM sites UNION SELECT site, 'n:' || regexp_replace(label, '[0-9]+', '#', 'g') FROM sites WHERE regexp_matches(label, '[0-9]') AND length(regexp_replace(label, '[0-9-]', '', 'g')) >= 2
  UNION SELECT site, 't:' || {_LETTERS} FROM sites WHERE length({_LETTERS}) >= 6 UNION SELECT site, 'f:' || {_BARE} || '|' || skeleton FROM sites WHERE length({_BARE}) >= 4),
tk AS (SELECT site, day, brand, list_transform(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+'), lambda x: CASE WHEN regexp_matches(x, '\\p{{N}}') THEN '#' ELSE x END) AS w0 FROM sites), tw AS (SELECT site, day, brand, list_filter(w0, lambda x, i: NOT (x = '#' AND i > 1 AND w0[i - 1] = '#')) AS w FROM tk),
ts AS (SELECT *, list_transform(w, lambda x: CASE WHEN list_contains(brand, x) THEN '*' ELSE x END) AS s0 FROM tw), tt AS (SELECT *, list_filter(s0, lambda x, i: NOT (x IN ('*', '#') AND i > 1 AND s0[i - 1] = x)) AS s FROM ts),
tp AS (SELECT DISTINCT site, day, 'g:' || array_to_string(w[i:i + 3], ' ') AS key FROM (SELECT site, day, w, unnest(range(1, len(w) - 2)) AS i FROM tt WHERE len(w) >= 4) WHERE {_CONTENT.format("w[i:i + 3]")} >= 2 UNION SELECT site, day, 's:' || array_to_string(s, ' ') FROM tt WHERE {_CONTENT.format("s")} >= 3),
dn AS (SELECT key, day, count(*) AS n, day - CAST(row_number() OVER (PARTITION BY key ORDER BY day) AS INTEGER) AS run FROM tp GROUP BY 1, 2), dr AS (SELECT key, run, min(day) AS start FROM dn GROUP BY 1, 2 HAVING sum(n) >= 8), tr AS (SELECT site, tp.key, start FROM tp JOIN dn USING (key, day) JOIN dr USING (key, run)),
ed AS (SELECT site, key FROM k UNION SELECT site, 'T@' || key || '@' || CAST(start AS VARCHAR) FROM tr), r(a, b) AS (SELECT site, site FROM sites UNION SELECT r.a, y.site FROM r JOIN ed x ON x.site = r.b JOIN ed y ON y.key = x.key), op AS (SELECT a AS site, min(b) AS operator FROM r GROUP BY 1)"""


@query("t22_site_operators", f"WITH RECURSIVE {NETWORKS} SELECT site, operator FROM op")
def t22_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.resolve_networks(observed_sites(spark, sf_dir), SITE_STOP)[0]


@query(
    "t22_networks",
    f"""WITH RECURSIVE {NETWORKS}, g AS (SELECT operator, count(*) AS sites, min(day) AS first_day, max(day) AS last_day FROM sites JOIN op USING (site) GROUP BY 1 HAVING count(*) >= 8), tm AS (SELECT operator, min(key) AS key FROM tr JOIN op USING (site) GROUP BY 1)
SELECT operator, sites, coalesce(substr(key, 3), '') AS template, CASE WHEN key IS NULL THEN 'key' WHEN starts_with(key, 'g:') THEN 'shingle' ELSE 'skeleton' END AS via, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, sites >= 25 AS spam_kit FROM g LEFT JOIN tm USING (operator)""",
)
def t22_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = networks.resolve_networks(observed_sites(spark, sf_dir), SITE_STOP)[1]
    return found.fillna("", ["template"]).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


COINED = ["boltg", "otan", "dgear", "llri", "tbolt", "wpla"]  # no words of the labels, but inside them


@query(
    "c13_coined_sales",
    f"""{WR.replace(NAMES, LISTINGS).replace("l AS (SELECT DISTINCT label FROM names)", "l AS (SELECT DISTINCT label FROM listings)")}, terms AS (SELECT entry AS term FROM dict UNION SELECT 'hot anvil' UNION SELECT 'old ring' UNION SELECT unnest({COINED})), s AS (SELECT DISTINCT domain, label, price, CASE WHEN stream = 'auction' THEN 'auction' ELSE 'enduser' END AS side FROM listings WHERE price IS NOT NULL),
h AS (SELECT label, term, list_contains(pieces, term) OR term = label OR contains(term, ' ') AND (label IN (SELECT label FROM (SELECT label, pieces, unnest(range(1, len(pieces))) AS i FROM segments) x WHERE x.label = segments.label AND pieces[i] || ' ' || pieces[i + 1] = term) OR replace(label, '-', '') = replace(term, ' ', '')) OR replace(label, '-', '') = term AS word,
  length(term) >= 4 AND NOT contains(term, ' ') AND term NOT IN (SELECT entry FROM dict) AND contains(label, term) AS inside FROM segments, terms)
SELECT term, domain, price, side, CASE WHEN word THEN 'word' ELSE 'inside' END AS basis FROM s JOIN h USING (label) WHERE side = 'enduser' AND (word OR inside)""",
)
def c13_coined(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = dictionary(spark, sf_dir)
    terms = entries.select(F.col("entry").alias("term")).union(spark.createDataFrame([(t,) for t in ["hot anvil", "old ring", *COINED]], "term string"))
    sales = market.listings(spark, sf_dir).where("price is not null").select("domain", "label", "price", F.when(F.col("stream") == "auction", "auction").otherwise("enduser").alias("side")).distinct()
    return containment.coined_sales(terms, sales, segment_greedy(sales, entries), entries)


LEXICON = f"""WITH {LISTINGS}, d AS (SELECT regexp_extract(label, '^[a-z]+') AS term, CAST(ends_at AS DATE) AS day, count(*) AS n FROM listings WHERE ends_at IS NOT NULL GROUP BY 1, 2), z AS (SELECT day, sum(n) AS size FROM d GROUP BY 1), m AS (SELECT strftime(day, '%Y-%m') AS month, sum(size) AS size FROM z GROUP BY 1),
e AS (SELECT min(month) AS early, max(month) AS late, arg_min(size, month) AS es, arg_max(size, month) AS ls, (SELECT count(*) FROM z) AS folded FROM m), t AS (SELECT term, strftime(day, '%Y-%m') AS month, sum(n) AS n, count(*) AS days, min(day) AS first FROM d GROUP BY 1, 2)
SELECT term, CAST(sum(n) AS BIGINT) AS total, CAST(sum(days) AS BIGINT) AS days, CAST(min(first) AS VARCHAR) AS first, round((coalesce(sum(n) FILTER (WHERE month = late), 0) + 0.5) / greatest(1, max(ls)) / ((coalesce(sum(n) FILTER (WHERE month = early), 0) + 0.5) / greatest(1, max(es))), 6) AS growth, round(sum(days) / max(folded), 6) AS presence, string_agg(month || ':' || CAST(n AS VARCHAR), ',' ORDER BY month) AS months FROM t, e GROUP BY 1"""


@query("d28_lexicon_state", LEXICON)
def d28_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings' words by month, folded in three parts of their days that overlap."""
    days = market.listings(spark, sf_dir).where("ends_at is not null").select(F.regexp_extract("label", "^[a-z]+", 0).alias("term"), F.to_date("ends_at").alias("day"))
    daily = days.groupBy("term", "day").agg(F.count("*").alias("n"))
    folder = f"{shared_folder(spark)}/lexicon-{uuid.uuid4()}"
    for part in ("year(day) % 3 = 0", "year(day) % 3 < 2", "true"):
        rows = daily.where(part)
        lexicon.fold(spark, folder, rows, rows.groupBy("day").agg(F.sum("n").alias("total")))
    return lexicon.lexicon(spark, folder).withColumn("first", F.col("first").cast("string"))


QUERY = "old bolts"


@query(
    "t30_search_index",
    f"""{WR}, s AS (SELECT label, list_filter(pieces, lambda p: p <> '?') || CASE WHEN length(label) % 2 = 0 THEN ['bolts'] ELSE [] END AS name, CASE WHEN label < 'g' THEN ['old', 'bolts'] ELSE [] END AS site, CASE WHEN label > 's' THEN ['oldbolts'] ELSE [] END AS theme FROM segments),
m AS (SELECT label, CASE WHEN list_has_any(name, ['old']) AND list_has_any(name, ['bolts', 'boltss', 'boltses', 'boltsed', 'boltsing']) THEN 'name' WHEN len(site) > 0 THEN 'site' WHEN len(theme) > 0 THEN 'theme' END AS match, len(site) > 0 OR len(theme) > 0 AS about FROM s),
f AS (SELECT label, bool_or(kind = 'signup') AS built, length(label) <= 8 AS alpha, count(DISTINCT zone) >= 4 AS batch FROM names GROUP BY label)
SELECT label, match, CAST(CASE WHEN batch THEN 3 WHEN built AND about THEN 0 WHEN alpha THEN 1 ELSE 2 END * 3 + CASE match WHEN 'name' THEN 0 WHEN 'site' THEN 1 ELSE 2 END AS INTEGER) AS rank FROM m JOIN f USING (label) WHERE match IS NOT NULL""",
)
def t30_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, label = F.array().cast("array<string>"), F.col("label")
    name = F.concat(F.filter("pieces", lambda p: p != "?"), F.when(F.length(label) % 2 == 0, F.array(F.lit("bolts"))).otherwise(none))
    site, theme = F.when(label < "g", F.array(F.lit("old"), F.lit("bolts"))).otherwise(none), F.when(label > "s", F.array(F.lit("oldbolts"))).otherwise(none)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4()}"
    search_index.write_index(segments(spark, sf_dir).select("label", name.alias("name"), site.alias("site"), theme.alias("theme")), "label", path)
    facts = market.names(spark, sf_dir).groupBy("label").agg(F.bool_or(F.col("kind") == "signup").alias("built"), (F.count_distinct("zone") >= 4).alias("batch")).withColumn("alpha", F.length("label") <= 8)
    return search_index.search(spark, path, QUERY, "label", facts)

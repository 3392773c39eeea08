"""Queries of text analytics on labels and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names as ops
from ..sources import market
from ..sources.market import LISTINGS, NAMES, ZONES
from .registry import query
from .site_queries import PAGES

W = f"WITH {NAMES}"
WR = f"WITH RECURSIVE {NAMES}"

FEED = "feed AS (SELECT CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '-' || label || '.' || zone ELSE upper(label) || '.' || zone || CASE WHEN event_id % 2 = 0 THEN '.' ELSE '' END END AS value, event_id FROM names)"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 6
    name = F.concat(F.upper("label"), F.lit("."), "zone", F.when(F.col("event_id") % 2 == 0, ".").otherwise(""))
    value = F.when(n == 0, "").when(n == 1, F.concat(F.lit("-"), "label", F.lit("."), "zone")).otherwise(name)
    return market.names(spark, sf_dir).select(value.alias("value"))


@query("a7_normalize_feed", f"{W}, {FEED} SELECT DISTINCT lower(rtrim(value, '.')) AS name FROM feed WHERE event_id % 6 > 1")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.normalize_feed(feed(spark, sf_dir))[0]


@query("a7_feed_accounting", f"{W}, {FEED} SELECT count(*) AS input, count(*) FILTER (WHERE event_id % 6 = 0) AS empty, count(*) FILTER (WHERE event_id % 6 = 1) AS invalid, count(*) FILTER (WHERE event_id % 6 > 1) - count(DISTINCT lower(rtrim(value, '.'))) FILTER (WHERE event_id % 6 > 1) AS duplicate, count(DISTINCT lower(rtrim(value, '.'))) FILTER (WHERE event_id % 6 > 1) AS accepted FROM feed")
def a7_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.normalize_feed(feed(spark, sf_dir))[1]


@query("a8_flatten_dropped", f"{W} SELECT DISTINCT label || '.' || zone AS name, zone FROM names WHERE zone IN ('com', 'io', 'dev')")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(".", "label", "zone")
    n = F.col("event_id") % 3
    payload = F.when(n == 0, F.to_json(F.array(F.upper(name)))).when(n == 1, F.to_json(F.struct(F.array(name, name).alias("results")))).otherwise(F.concat_ws(",", name, F.lit("2024-01-01")))
    return ops.flatten_dropped(market.names(spark, sf_dir).select(payload.alias("payload")), "payload", ["com", "io", "dev"])


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("entry")).distinct()


SEGMENTS = """dict AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS entry FROM part), l AS (SELECT DISTINCT label FROM names),
places AS (SELECT label, unnest(range(1, length(label) + 1)) AS i FROM l), spans AS (SELECT label, i, unnest(range(2, least(18, length(label) - i + 1) + 1)) AS n FROM places),
hits AS (SELECT s.* FROM spans s JOIN dict d ON substr(label, i, n) = entry), best AS (SELECT label, i, max(n) AS n FROM hits WHERE n >= 4 OR i + n - 1 = length(label) GROUP BY 1, 2),
nxt AS (SELECT c.label, c.i, coalesce(min(h.i), length(c.label) + 1) AS j FROM places c LEFT JOIN (SELECT DISTINCT label, i FROM hits WHERE n >= 3) h ON h.label = c.label AND h.i > c.i GROUP BY 1, 2, length(c.label)),
walk AS (SELECT label, CAST(1 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS pieces FROM l UNION ALL
  SELECT w.label, CASE WHEN b.n IS NOT NULL THEN w.i + b.n ELSE x.j END, list_append(w.pieces, CASE WHEN b.n IS NOT NULL THEN substr(w.label, w.i, b.n) ELSE '?' END)
  FROM walk w JOIN nxt x ON x.label = w.label AND x.i = w.i LEFT JOIN best b ON b.label = w.label AND b.i = w.i),
segments AS (SELECT label, pieces FROM walk WHERE i > length(label))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.segment_greedy(market.names(spark, sf_dir), dictionary(spark, sf_dir))


@query("t1_segment_greedy", f"{WR}, {SEGMENTS} SELECT label, array_to_string(pieces, '|') AS pieces FROM segments")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("label", F.array_join("pieces", "|").alias("pieces"))


GRAMS = """k AS (SELECT label, list_filter(pieces, lambda p: p <> '?') AS w FROM segments),
g AS (SELECT label, array_to_string(w[i:i + n - 1], ' ') AS token FROM (SELECT label, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n) UNION SELECT label, replace(label, '-', '') FROM k)"""


@query("t4_label_ngrams", f"{WR}, {SEGMENTS}, {GRAMS} SELECT label, token FROM g")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.label_ngrams(segments(spark, sf_dir))


@query(
    "t14_name_types",
    f"""{WR}, {SEGMENTS}, k AS (SELECT label, list_filter(pieces, lambda p: p <> '?') AS w FROM segments), c AS (SELECT * FROM k WHERE len(w) >= 2 AND length(array_to_string(w, '')) >= 0.75 * length(replace(label, '-', ''))),
e AS (SELECT DISTINCT label, 'suffix:*' || w[-1] AS kind FROM c UNION SELECT label, 'prefix:' || w[1] || '*' FROM c UNION SELECT label, 'theme:' || w[i] || ' ' || w[i + 1] FROM (SELECT label, w, unnest(range(1, len(w))) AS i FROM c) WHERE length(w[i]) >= 3 AND length(w[i + 1]) >= 3)
SELECT kind, count(*) AS n, round(1000e0 * count(*) / (SELECT count(*) FROM segments), 6) AS share FROM e GROUP BY 1 HAVING count(*) >= 8""",
)
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.name_types(segments(spark, sf_dir))


@query(
    "t9_mine_fragments",
    f"""{W}, l AS (SELECT DISTINCT label FROM names), s AS (SELECT label, i, unnest(range(4, least(12, length(label) - i + 1) + 1)) AS n FROM (SELECT label, unnest(range(1, length(label) - 2)) AS i FROM l)),
f AS (SELECT substr(label, i, n) AS fragment, count(DISTINCT label) AS support FROM s GROUP BY 1 HAVING count(DISTINCT label) >= 4), a AS (SELECT fragment, max(above) AS above FROM (SELECT substr(fragment, 1, length(fragment) - 1) AS fragment, support AS above FROM f UNION ALL SELECT substr(fragment, 2), support FROM f) GROUP BY 1)
SELECT fragment, support, count(DISTINCT regexp_replace(substr(label, 1, i - 1) || '|' || substr(label, i + n), '[0-9]+', '#', 'g')) AS contexts FROM f LEFT JOIN a USING (fragment) JOIN s ON substr(label, i, n) = fragment WHERE above IS NULL OR above < 0.7 * support GROUP BY 1, 2""",
)
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mine_fragments(market.names(spark, sf_dir))


STOP = ["the", "and", "for", "with", "that", "les", "des", "que", "pour", "dans", "der", "die", "und", "das", "nicht", "los", "las", "una", "por", "con"]
_STOP = ", ".join(f"'{w}'" for w in STOP)


@query(
    "t7_text_terms",
    f"""WITH p AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}'' ]+'), lambda x: trim(x, ' ') <> '') AS ph FROM documents), q AS (SELECT doc_id, unnest(range(len(ph))) AS p, unnest(ph) AS phrase FROM p),
w AS (SELECT doc_id, p, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, p, string_split_regex(trim(phrase, ' '), ' +') AS ws FROM q)), m AS (SELECT *, lead(w) OVER (PARTITION BY doc_id, p ORDER BY i) AS nx FROM w),
t AS (SELECT doc_id, w AS term, p, i, 1 AS words FROM m WHERE w NOT IN ({_STOP}) AND length(w) >= 3 UNION ALL SELECT doc_id, w || ' ' || nx, p, i, 2 FROM m WHERE w NOT IN ({_STOP}) AND length(w) >= 3 AND nx NOT IN ({_STOP}) AND length(nx) >= 3),
o AS (SELECT doc_id, term, words, min({{'p': p, 'i': i}}) AS spot FROM t GROUP BY 1, 2, 3)
SELECT doc_id, term, CAST(row_number() OVER (PARTITION BY doc_id, words ORDER BY spot) AS INTEGER) AS place, words FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, words ORDER BY spot) <= CASE words WHEN 1 THEN 60 ELSE 40 END""",
)
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.text_terms(market.table(spark, sf_dir, "documents"), STOP, key="doc_id")


STOP_WORDS = [("the", "en"), ("of", "en"), ("and", "en"), ("le", "fr"), ("la", "fr"), ("des", "fr"), ("que", "fr"), ("der", "de"), ("und", "de"), ("das", "de"), ("el", "es"), ("la", "es"), ("los", "es"), ("que", "es")]
_STOPS = "sw AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{c}')" for w, c in STOP_WORDS) + ") v(token, lang))"


ALPHABETS = [("abdegiklmnoprstu", "αβδεγικλμνοπρστυ"), ("abdegiklmnoprstu", "абдегиклмнопрсту")]  # for the texts of one document in ten each
_MOVED = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN translate(lower(text), '{a}', '{b}')" for i, (a, b) in enumerate(ALPHABETS)) + " ELSE lower(text) END"
_SCRIPT = "CASE " + " ".join(f"WHEN regexp_matches(token, '\\p{{{name}}}') THEN '{lang}'" for name, lang in ops.SCRIPTS) + " END"


@query(
    "t8_page_language",
    f"""WITH {_STOPS}, s AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY token) AS weight FROM sw), t AS (SELECT doc_id, unnest(string_split({_MOVED}, ' ')) AS token FROM documents), c AS (SELECT doc_id, lang, round(sum(weight), 6) AS score FROM t JOIN s USING (token) GROUP BY 1, 2),
w AS (SELECT doc_id, max({{'score': score, 'lang': lang}}) AS b FROM c GROUP BY 1), m AS (SELECT *, CASE WHEN NOT latin THEN {_SCRIPT} END AS lang FROM (SELECT *, regexp_matches(token, '^[\\p{{Latin}}\\p{{M}}\\p{{N}}]+$') AS latin FROM t)), n AS (SELECT doc_id, latin, lang, CAST(sum(length(token)) AS BIGINT) AS n FROM m GROUP BY 1, 2, 3),
g AS (SELECT doc_id, max({{'kana': lang = 'ja', 'n': n, 'lang': lang}}) FILTER (WHERE lang IS NOT NULL) AS b FROM n GROUP BY 1 HAVING sum(n) FILTER (WHERE NOT latin) > coalesce(sum(n) FILTER (WHERE latin), 0))
SELECT doc_id, CASE WHEN g.b IS NULL THEN w.b.lang ELSE g.b.lang END AS lang, CASE WHEN g.b IS NULL THEN w.b.score ELSE CAST(g.b.n AS DOUBLE) END AS score FROM w FULL JOIN (FROM g WHERE b IS NOT NULL) g USING (doc_id)""",
)
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("text")
    for i, (old, new) in enumerate(ALPHABETS):
        text = F.when(F.col("doc_id") % 10 == i, F.translate(F.lower("text"), old, new)).otherwise(text)
    tokens = market.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(text, " ")).alias("token"))
    return ops.page_language(tokens, spark.createDataFrame(STOP_WORDS, "token string, lang string"), "doc_id")


@query(
    "t22_resolve_operators",
    f"""WITH RECURSIVE {PAGES}, e AS (SELECT page_id AS site, 't:' || lower(title) AS key FROM f UNION SELECT page_id, 's:' || substr(url, length(url) - 3) || host FROM f JOIN pages USING (page_id)),
r(a, b) AS (SELECT site, site FROM e UNION SELECT r.a, y.site FROM r JOIN e x ON x.site = r.b JOIN e y ON y.key = x.key)
SELECT a AS site, min(b) AS operator FROM r GROUP BY 1""",
)
def t22(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import sites

    pages = market.table(spark, sf_dir, "pages")
    rows = sites.page_features(pages).select("page_id", "title", "host").join(pages.select("page_id", "url"), "page_id")
    return ops.resolve_operators(rows, "page_id", {"t": F.lower("title"), "s": F.concat(F.expr("substr(url, length(url) - 3)"), "host")})


TOKEN = "regexp_extract(label, '^([a-z]+-?[a-z]+)', 1)"


@query("t28_kit_clusters", f"{W} SELECT CAST(day AS VARCHAR) AS day, {TOKEN} AS token, count(DISTINCT label) AS n FROM names WHERE zone = 'com' AND length({TOKEN}) >= 8 GROUP BY 1, 2 HAVING count(DISTINCT label) >= 3")
def t28_kits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(F.regexp_extract("label", "^([a-z]+-?[a-z]+)", 1))
    return ops.kit_clusters(market.names(spark, sf_dir), tokens, least=3, token_length=8).withColumn("day", F.col("day").cast("string"))


@query("t28_kit_members", f"{W}, e AS (SELECT DISTINCT day, {TOKEN} AS token, label FROM names WHERE zone = 'com' AND length({TOKEN}) >= 8) SELECT CAST(day AS VARCHAR) AS day, token, label FROM e QUALIFY count(*) OVER (PARTITION BY day, token) >= 3 AND row_number() OVER (PARTITION BY day, token ORDER BY label) <= 4")
def t28_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, seen = F.array(F.regexp_extract("label", "^([a-z]+-?[a-z]+)", 1)), market.names(spark, sf_dir)
    return ops.kit_members(seen, ops.kit_clusters(seen, tokens, least=3, token_length=8), tokens, most=4).withColumn("day", F.col("day").cast("string"))


@query("t28_family_clusters", f"{W} SELECT CAST(day AS VARCHAR) AS day, label, count(DISTINCT zone) AS n FROM names GROUP BY 1, 2 HAVING count(DISTINCT zone) >= 3")
def t28_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.family_clusters(market.names(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(
    "t28_sweep_clusters",
    f"{W}, k AS (SELECT DISTINCT day, {TOKEN} AS token FROM names WHERE zone = 'com' AND length({TOKEN}) >= 8 GROUP BY 1, 2 HAVING count(DISTINCT label) >= 2), d AS (SELECT a.token, a.day, count(*) AS days FROM k a JOIN k b ON a.token = b.token AND b.day BETWEEN a.day - 20 AND a.day GROUP BY 1, 2) SELECT token, max(days) AS days FROM d GROUP BY 1 HAVING max(days) >= 3",
)
def t28_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(F.regexp_extract("label", "^([a-z]+-?[a-z]+)", 1))
    return ops.sweep_clusters(ops.kit_clusters(market.names(spark, sf_dir), tokens, least=2, token_length=8))


@query(
    "d18_sales_comps",
    f"""WITH {LISTINGS}, o AS (SELECT DISTINCT CASE WHEN stream = 'auction' THEN 'auction' ELSE 'enduser' END AS side, CAST(length(regexp_replace(label, '[^0-9]', '', 'g')) > 0 AS INTEGER) AS numbered, zone, domain, price, stream FROM listings WHERE price IS NOT NULL AND ends_at >= TIMESTAMP '1993-01-01' AND regexp_matches(label, '^[a-z]') AND price BETWEEN 1000 AND 60000),
e AS (SELECT side, numbered, zone, string_agg(domain, ',' ORDER BY p) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY side, numbered, zone ORDER BY price DESC, domain, stream) AS p FROM o) WHERE p <= 8 GROUP BY 1, 2, 3)
SELECT side, numbered, zone, n, p25, median, p75, examples FROM (SELECT side, numbered, zone, count(*) AS n, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS median, round(quantile_cont(price, 0.75), 4) AS p75 FROM o GROUP BY 1, 2, 3) JOIN e USING (side, numbered, zone)""",
)
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("stream") == "auction", "auction").otherwise("enduser")
    sales = market.listings(spark, sf_dir).withColumns({"side": side, "numbered": F.col("label").rlike("[0-9]").cast("int"), "venue": F.col("stream"), "day": F.col("ends_at")})
    return ops.sales_comps(sales, ["side", "numbered", "zone"], since=F.lit("1993-01-01").cast("timestamp_ntz"), theme="^[a-z]", band=(1000.0, 60000.0))


@query(
    "a14_upsert",
    f"{W}, t AS (SELECT label, min(event_id) AS first_id, max(value) AS peak, max(user_id) AS owner FROM names WHERE day <= DATE '2024-01-15' GROUP BY 1), s AS (SELECT label, min(event_id) AS first_id, max(value) AS peak, max(user_id) AS owner FROM names WHERE day > DATE '2024-01-15' GROUP BY 1) SELECT coalesce(t.label, s.label) AS label, coalesce(t.first_id, s.first_id) AS first_id, greatest(t.peak, s.peak) AS peak, coalesce(s.owner, t.owner) AS owner FROM t FULL JOIN s ON t.label = s.label",
)
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = market.names(spark, sf_dir)
    facts = lambda rows: rows.groupBy("label").agg(F.min("event_id").alias("first_id"), F.max("value").alias("peak"), F.max("user_id").alias("owner"))
    return ops.upsert(facts(seen.where("day <= DATE '2024-01-15'")), facts(seen.where("day > DATE '2024-01-15'")), "label", {"first_id": "old", "peak": "max", "owner": "new"})

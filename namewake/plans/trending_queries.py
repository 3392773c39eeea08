"""Queries of trending terms and words in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constructions, keywords
from ..operators import trending as ops
from ..operators.ranking import saved
from ..operators.trends import keyword_history
from ..sources import market
from ..sources.market import NAMES
from .name_queries import SEGMENTS, dictionary, segments
from .registry import query

LAST = "2024-01-30"
GROUPS = {"technical": ["dev", "io", "ai"], "commerce": ["shop", "net"]}
CURATED, ZERO, LEXICON = ["technical"], ["xyz"], ["oldrod", "hotring"]
_GROUP = "CASE WHEN {0} IN ('dev', 'io', 'ai') THEN 'technical' WHEN {0} IN ('shop', 'net') THEN 'commerce' ELSE 'other' END"


def trending_sql(words: bool, noise: bool) -> str:
    term = "k AS (SELECT r.*, p.term FROM r JOIN (SELECT label AS keyword, unnest(list_distinct(list_filter(pieces, lambda p: p <> '?'))) AS term FROM segments) p USING (keyword))" if words else "k AS (SELECT *, keyword AS term FROM r)"
    share = "1e0" if words else "(SELECT len(list_filter(pieces, lambda p: p <> '?')) / len(pieces) FROM segments WHERE label = term)"
    return f"""WITH RECURSIVE {NAMES}, {SEGMENTS}, r AS (SELECT label AS keyword, day, zone, day > DATE '{LAST}' - 7 AS inside FROM names WHERE zone <> 'xyz' AND day > DATE '{LAST}' - 35 AND day <= DATE '{LAST}' GROUP BY ALL), {term},
c AS (SELECT term, count(DISTINCT keyword || '|' || CAST(day AS VARCHAR)) FILTER (WHERE inside) AS n, count(DISTINCT keyword || '|' || CAST(day AS VARCHAR)) FILTER (WHERE NOT inside) AS base FROM k GROUP BY 1),
z AS (SELECT term, list(DISTINCT zone ORDER BY zone) AS zones, count(DISTINCT keyword || '.' || zone) AS source_domains FROM k WHERE inside GROUP BY 1),
g AS (SELECT *, list_transform(zones, lambda z: {_GROUP.format("z")}) AS gs, round((n / 7) / (CASE WHEN base < 3 THEN base + 1 ELSE base END / 28), 2) AS momentum, length(regexp_replace(term, '[^0-9]', '', 'g')) / length(term) AS dg,
  length(term) < 3 OR list_bool_or(list_transform(range(1, greatest(length(term) - 1, 2)), lambda i: length(term) >= 3 AND term[i] = term[i + 1] AND term[i] = term[i + 2])) OR length(regexp_replace(term, '[^a-z]', '', 'g')) >= 3 AND NOT regexp_matches(term, '[aeiou]') AS odd FROM c JOIN z USING (term) WHERE n > 0),
m AS (SELECT *, list_filter(zones, lambda z: z IN ('dev', 'io', 'ai')) AS cz, CASE WHEN len(list_filter(gs, lambda x: x = gs[1])) >= 2 THEN gs[1] ELSE list_filter(gs, lambda x: len(list_filter(gs, lambda y: y = x)) >= 2)[1] END AS co, {share} AS sh FROM g),
o AS (SELECT *, CASE WHEN len(zones) >= 12 AND len(zones) - len(cz) > len(zones) / 2 OR regexp_matches(term, 'oldrod|hotring') OR dg >= 0.5 OR odd AND dg > 0 THEN 'noise' WHEN dg >= 0.3 OR odd THEN 'mixed' ELSE 'quality' END AS signal FROM m)
SELECT term, n AS window_n, base AS baseline_n, base < 3 AS low_confidence, momentum, CAST(len(zones) AS INTEGER) AS spread, array_to_string(zones, ',') AS zones, array_to_string(list_sort(list_distinct(gs)), ',') AS groups, coalesce(co, '') AS co_moving, source_domains, signal,
  round((len(zones) + 2 * len(cz)) * greatest(0.1, momentum) * CASE WHEN sh IS NULL THEN 0.4 WHEN sh = 1 THEN 1.5 WHEN sh >= 0.5 THEN 1.1 WHEN NOT odd THEN 0.9 ELSE 0.4 END, 3) AS quality_score, co IS NOT NULL AND momentum >= 1.5 AND n >= 2 AS worth_watching FROM o{"" if noise else " WHERE signal <> 'noise'"}"""


def trending(spark: SparkSession, sf_dir: str, words: bool, noise: bool) -> DataFrame:
    history = keyword_history(market.names(spark, sf_dir))
    found = ops.trending_terms(history, segments(spark, sf_dir), F.lit(LAST).cast("date"), groups=GROUPS, curated=CURATED, zero_weight=ZERO, lexicon=LEXICON, words=words, noise=noise)
    return found.fillna("", ["co_moving"])


@query("d8_trending_terms", trending_sql(False, False))
def d8_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending(spark, sf_dir, words=False, noise=False)


@query("d8_trending_words", trending_sql(True, True))
def d8_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending(spark, sf_dir, words=True, noise=True)


USES = f"""WITH RECURSIVE {NAMES}, {SEGMENTS}, w AS (SELECT entry AS word FROM dict WHERE length(entry) >= 4 UNION SELECT 'pla' UNION SELECT 'r' UNION SELECT 'bol'), p AS (SELECT DISTINCT label, unnest(list_filter(pieces, lambda p: p <> '?')) AS piece FROM segments),
u AS (SELECT DISTINCT word, label FROM p JOIN w ON piece IN (word, word || 's', word || 'es', word || 'ed', word || 'ing'))"""


def sought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the dictionary, and stems of which words are inflections (``r`` of red and ring)."""
    entries = dictionary(spark, sf_dir).where(F.length("entry") >= 4).select(F.col("entry").alias("word"))
    return entries.union(spark.createDataFrame([("pla",), ("r",), ("bol",)], "word string"))


@query(
    "t12_constructions",
    f"""{USES}, c AS (SELECT word, count(*) AS labels, count(*) FILTER (WHERE starts_with(label, word)) AS prefix, count(*) FILTER (WHERE ends_with(label, word)) AS suffix, count(*) FILTER (WHERE NOT starts_with(label, word) AND NOT ends_with(label, word)) AS internal FROM u GROUP BY 1),
s AS (SELECT word, 'numbered' AS kind, regexp_replace(label, '[0-9]+', '#', 'g') AS text, count(*) AS n FROM u GROUP BY 1, 3), z AS (SELECT word, label, unnest(range(length(word) + 3, length(label))) AS size FROM u), d AS (SELECT word, label, 'prefix' AS kind, label[:size] AS text FROM z UNION ALL SELECT word, label, 'suffix', right(label, size) FROM z),
k AS (SELECT 0 AS r, * FROM s UNION ALL SELECT 1, word, kind, text, count(*) FROM d WHERE contains(text, word) GROUP BY word, kind, text),
b AS (SELECT k.* FROM k JOIN c USING (word) WHERE n >= greatest(3, 0.4 * labels) QUALIFY row_number() OVER (PARTITION BY word ORDER BY r, CASE r WHEN 1 THEN -length(text) ELSE 0 END, n DESC, kind, text) = 1)
SELECT c.*, coalesce(kind, '') AS kind, coalesce(text, '') AS text, coalesce(n, 0) AS n FROM c LEFT JOIN b USING (word)""",
)
def t12_constructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = constructions.constructions(constructions.word_uses(segments(spark, sf_dir), sought(spark, sf_dir)))
    return found.fillna("", ["kind", "text"]).fillna(0, ["n"])


@query(
    "t12_family_patterns",
    f"""{USES}, a AS (SELECT label, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM segments), t AS (SELECT label, pieces, i, pieces[i] AS word FROM a WHERE pieces[i] IN (SELECT word FROM w)), f AS (SELECT label, word, pieces, i, unnest(range(1, i + 1)) AS a FROM t), g AS (SELECT label, word, a, pieces, unnest(range(i, len(pieces) + 1)) AS b FROM f),
n AS (SELECT word, array_to_string(pieces[a:b], '') AS pattern, count(DISTINCT label) AS labels FROM g WHERE b > a AND NOT list_contains(pieces[a:b], '?') GROUP BY 1, 2 HAVING count(DISTINCT label) >= 2)
SELECT word, pattern, labels, CAST(row_number() OVER (PARTITION BY word ORDER BY labels DESC, length(pattern) DESC, pattern) AS INTEGER) AS place FROM n QUALIFY row_number() OVER (PARTITION BY word ORDER BY labels DESC, length(pattern) DESC, pattern) <= 8""",
)
def t12_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constructions.family_patterns(segments(spark, sf_dir), sought(spark, sf_dir))


KEYWORDS = f"""WITH RECURSIVE {NAMES}, {SEGMENTS}, w AS (SELECT label, list_filter(pieces, lambda p: p <> '?') AS w FROM segments), base AS (SELECT label, label || '.' || zone AS site, user_id % 40 AS op, day, zone, event_id % 3 <> 0 AS described, CASE user_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS lang FROM names WHERE day > DATE '{LAST}' - 14 AND day <= DATE '{LAST}'),
uses AS (SELECT label AS term, site, op, day, zone, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS partner, described, lang FROM base UNION ALL SELECT w[i], site, op, day, zone, CASE WHEN i = len(w) THEN 'head' ELSE 'modifier' END, CASE WHEN len(w) > 1 THEN w[CASE WHEN i = 1 THEN 2 ELSE i - 1 END] END, described, lang FROM (SELECT base.*, w, unnest(range(1, len(w) + 1)) AS i FROM base JOIN w USING (label))),
regs AS (SELECT term, day, count(*) AS n FROM (SELECT label AS term, day FROM names WHERE kind = 'signup' UNION ALL SELECT w[i], day FROM (SELECT day, w, unnest(range(1, len(w) + 1)) AS i FROM names JOIN w USING (label) WHERE kind = 'signup')) WHERE day_of_month % 10 <> 5 GROUP BY 1, 2),
dd AS (SELECT day, count(DISTINCT op) AS ops FROM uses GROUP BY 1), fl AS (SELECT greatest(3, ceil(list_sort(list(ops))[(count(*) + 1) // 2] * 0.2)) AS f FROM dd), pa AS (SELECT day, CASE WHEN age <= 3 THEN 0 ELSE 1 END AS part FROM (SELECT day, row_number() OVER (ORDER BY day DESC) AS age FROM dd, fl WHERE ops >= f) WHERE age <= 10),
al AS (SELECT count(DISTINCT op) FILTER (WHERE part = 0) AS ar, count(DISTINCT op) FILTER (WHERE part = 1) AS ap FROM uses JOIN pa USING (day)), nd AS (SELECT count(*) FILTER (WHERE part = 0) AS nr, count(*) FILTER (WHERE part = 1) AS np FROM pa), rd AS (SELECT count(*) FILTER (WHERE part = 0) AS r, count(*) FILTER (WHERE part = 1) AS p FROM pa WHERE day IN (SELECT day FROM regs)),
u AS (SELECT uses.*, date_diff('day', uses.day, DATE '{LAST}') AS age, part FROM uses LEFT JOIN pa USING (day) WHERE term IN (SELECT term FROM uses GROUP BY 1 HAVING count(DISTINCT site) >= 2)),
o AS (SELECT term, count(DISTINCT op) FILTER (WHERE age < 7) AS operators, count(DISTINCT op) FILTER (WHERE age >= 7) AS ops_first, count(DISTINCT op) AS ops_span, count(DISTINCT op) FILTER (WHERE part = 0) AS recent, count(DISTINCT op) FILTER (WHERE part = 1) AS prior, count(DISTINCT op) FILTER (WHERE described) AS described,
  count(DISTINCT day) FILTER (WHERE age < 7) AS days_active, count(DISTINCT day) FILTER (WHERE age >= 7) AS days_first, count(DISTINCT zone) AS zones, count(DISTINCT role) AS roles, count(DISTINCT partner) AS partners FROM u GROUP BY 1),
s AS (SELECT term, day, part, count(DISTINCT op) AS n FROM u GROUP BY 1, 2, 3), b AS (SELECT term, coalesce(sum(n) FILTER (WHERE part = 0), 0) AS built, coalesce(sum(n) FILTER (WHERE part = 0 AND day IN (SELECT day FROM regs)), 0) AS b3, coalesce(sum(n) FILTER (WHERE part = 1 AND day IN (SELECT day FROM regs)), 0) AS b7 FROM s GROUP BY 1),
g AS (SELECT term, coalesce(sum(n) FILTER (WHERE part = 0), 0) AS r3, coalesce(sum(n) FILTER (WHERE part = 1), 0) AS r7 FROM regs JOIN pa USING (day) GROUP BY 1),
tg AS (SELECT term, count(*) FILTER (WHERE n >= 2 AND r >= 1) AS strong, string_agg(lang || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, lang) AS languages FROM (SELECT term, lang, count(DISTINCT op) AS n, count(DISTINCT op) FILTER (WHERE part = 0) AS r FROM u WHERE lang IS NOT NULL AND age < 7 GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT o.*, built, b3, b7, coalesce(r3, 0) AS r3, coalesce(r7, 0) AS r7, coalesce(strong, 0) AS strong, coalesce(languages, '') AS languages, CASE WHEN nr >= 2 AND np >= 3 AND ar >= 10 AND ap >= 10 THEN floor((recent / ar) / ((prior + 1) / (ap + 1)) * 100 + 0.5) / 100 END AS rise_raw, rd.r AS rr, rd.p AS rp FROM o JOIN b USING (term) LEFT JOIN g USING (term) LEFT JOIN tg USING (term), al, nd, rd WHERE operators >= 1),
q AS (SELECT *, rr > 0 AND rp > 0 AND r3 + r7 > 0 AND b7 / (r7 + 1) > 0 AND b3 / (r3 + 1) < 0.7 * (b7 / (r7 + 1)) AS share_falling, rr > 0 AND rp > 0 AND r3 >= 6 AND r3 / greatest(rr, 1) >= 1.5 * ((r7 + 1) / greatest(rp, 1)) AS regs_rise, strong >= 2 AND regexp_matches(term, '^[\\p{{Latin}}\\p{{N}} ]+$') AS is_global FROM m),
profiles AS (SELECT *, CASE WHEN recent >= 4 THEN rise_raw END AS rise, regs_rise AND coalesce(rise_raw <= 1.1, false) AS speculative, built >= 3 AND coalesce(rise_raw > 1.2, false) AS organic, CASE WHEN is_global THEN least(1.75, 1 + 0.25 * (strong - 1)) ELSE 1e0 END AS boost,
  CASE WHEN share_falling OR coalesce(rise_raw < 0.7, false) THEN 'watch' WHEN least(ops_first, operators) >= 2 AND least(days_first, days_active) >= 2 AND ops_span >= 8 AND zones >= 2 AND described >= 5 THEN 'confirmed' WHEN operators >= 3 AND days_active >= 3 AND (roles >= 2 OR partners >= 3 OR zones >= 2) AND coalesce(rise_raw >= 1, true) THEN 'forming' ELSE 'watch' END AS stage FROM q)"""
KEYWORDS = KEYWORDS.replace("day_of_month % 10 <> 5", "extract('day' FROM day) % 10 <> 5")


def keyword_uses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels and their words as used by sites, and as registered on the days that don't end in 5."""
    seen = market.names(spark, sf_dir)
    words = segments(spark, sf_dir).select("label", F.filter("pieces", lambda p: p != "?").alias("w"))
    lang = F.when(F.col("user_id") % 3 == 0, "en").when(F.col("user_id") % 3 == 1, "de")
    base = seen.select("label", F.concat_ws(".", "label", "zone").alias("site"), (F.col("user_id") % 40).alias("op"), "day", "zone", (F.col("event_id") % 3 != 0).alias("described"), lang.alias("lang"), "kind")
    each = base.join(words, "label").select("*", F.posexplode("w").alias("i", "term"))
    partner = F.when(F.size("w") > 1, F.element_at("w", F.when(F.col("i") == 0, 2).otherwise(F.col("i"))))
    columns = ["term", "site", "op", "day", "zone", "role", "partner", "described", "lang", "kind"]
    whole = base.withColumns({"term": F.col("label"), "role": F.lit(None).cast("string"), "partner": F.lit(None).cast("string")}).select(*columns)
    uses = whole.union(each.withColumns({"role": F.when(F.col("i") == F.size("w") - 1, "head").otherwise("modifier"), "partner": partner}).select(*columns))
    regs = uses.where((F.col("kind") == "signup") & (F.dayofmonth("day") % 10 != 5)).groupBy("term", "day").agg(F.count("*").alias("n"))
    return uses.drop("kind"), regs


@query("t24_keyword_profiles", f"{KEYWORDS} SELECT term, operators, ops_first, ops_span, recent, prior, described, days_active, days_first, zones, roles, partners, languages, coalesce(rise_raw, -1) AS rise_raw, coalesce(rise, -1) AS rise, share_falling, speculative, organic, is_global, boost, stage FROM profiles")
def t24_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keywords.keyword_profiles(*keyword_uses(spark, sf_dir), F.lit(LAST).cast("date"))
    return found.drop("ops_last", "days_last").fillna(-1, ["rise_raw", "rise"])


@query(
    "t26_ranked_keywords",
    f"""{KEYWORDS}, nv AS (SELECT term, round(least(1, length(term) / 12), 6) AS score, length(term) <= 4 AS common FROM profiles WHERE operators >= 1),
bi AS (SELECT term, CAST(operators AS DOUBLE) AS score, row_number() OVER (ORDER BY operators DESC, days_active DESC, term) AS place FROM profiles), tr AS (SELECT term, round(rise * log2(1 + operators) * (days_active / 7) * boost, 4) AS score FROM profiles WHERE rise >= 1.5),
em AS (SELECT term, nv.score, operators FROM profiles JOIN nv USING (term) WHERE operators >= 2 AND NOT regexp_matches(term, '^[0-9]') AND nv.score > 0 AND term NOT IN (SELECT term FROM bi JOIN nv USING (term) WHERE place <= 30 AND common))
SELECT 'biggest' AS list, CAST(place AS INTEGER) AS place, term, score FROM bi WHERE place <= 30
UNION ALL SELECT 'trending', CAST(row_number() OVER (ORDER BY score DESC, term) AS INTEGER), term, score FROM tr QUALIFY row_number() OVER (ORDER BY score DESC, term) <= 30
UNION ALL SELECT 'emerging', CAST(row_number() OVER (ORDER BY score DESC, operators DESC, term) AS INTEGER), term, score FROM em QUALIFY row_number() OVER (ORDER BY score DESC, operators DESC, term) <= 30""",
)
def t26_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = saved(keywords.keyword_profiles(*keyword_uses(spark, sf_dir), F.lit(LAST).cast("date")))
    novelty = profiles.select("term", F.round(F.least(F.lit(1.0), F.length("term") / 12), 6).alias("score"), (F.length("term") <= 4).alias("common"))
    return keywords.ranked_keywords(profiles, 30, novelty=novelty)

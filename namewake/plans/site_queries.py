"""Queries of observed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sites as ops
from ..sources.market import table
from .registry import query


def _text_sql(html: str) -> str:
    out = f"regexp_replace({html}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->|<[^>]*>', ' ', 'g')"
    for name, char in (("&amp;", "&"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")):
        out = f"replace({out}, '{name}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'), ' ')"


def _tag_sql(tag: str) -> str:
    return f"regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>', 1)"


HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"
PAGES = f"f AS (SELECT page_id, {HOST} AS host, {_text_sql(_tag_sql('title'))} AS title, {_text_sql(_tag_sql('h1'))} AS heading, {_text_sql('html')} AS text FROM pages)"


@query("a12_page_features", f"WITH {PAGES} SELECT page_id, host, title, heading, CAST(length(text) AS INTEGER) AS text_length, CAST(len(regexp_extract_all(lower(html), '<[a-z][a-z0-9]*')) AS INTEGER) AS tags FROM f JOIN pages USING (page_id)")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page_features(table(spark, sf_dir, "pages")).select("page_id", "host", "title", "heading", "text_length", "tags")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as observed: the day, status and final host follow from the page's number."""
    pages = table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]*)", 1))
    n = F.col("page_id")
    return ops.page_features(pages).select("page_id", "title", "skeleton").join(pages, "page_id").select(
        "page_id",
        (n % 7).alias("day"),
        host.alias("host"),
        F.when(n % 11 != 0, F.when(n % 13 == 0, 404).otherwise(200)).alias("status"),
        F.when(n % 17 == 0, "elsewhere.example").otherwise(host).alias("final_host"),
        "title",
        ops._text(F.col("html")).alias("text"),
        "skeleton",
    )


OBS = f"{PAGES}, o AS (SELECT page_id, page_id % 7 AS day, host, CASE WHEN page_id % 11 <> 0 THEN CASE WHEN page_id % 13 = 0 THEN 404 ELSE 200 END END AS status, CASE WHEN page_id % 17 = 0 THEN 'elsewhere.example' ELSE host END AS final_host, title, text, sha1(array_to_string(list_filter(tags, lambda t, i: i = 1 OR tags[i - 1] <> t), ' ')) AS skeleton FROM f JOIN (SELECT page_id, regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1) AS tags FROM pages) USING (page_id))"
CLASS = f"c AS (SELECT *, CASE WHEN status IS NULL OR status >= 400 THEN 'error' WHEN final_host <> host THEN 'redirect_offsite' WHEN regexp_matches(title || ' ' || text, '{ops.FOR_SALE}') THEN 'for_sale' WHEN regexp_matches(title || ' ' || text, '{ops.PARKED}') THEN 'parked' WHEN regexp_matches(title || ' ' || text, '{ops.PLACEHOLDER}') OR regexp_matches(title, '{ops.GENERIC_TITLE}') AND length(text) < 200 THEN 'placeholder' ELSE 'built' END AS class FROM o)"
KITS = f"""{OBS}, {CLASS}, ct AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(title), lower(host), '{{name}}'), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'), ' ') AS tt FROM c), t1 AS (SELECT day, tt, skeleton, count(DISTINCT page_id) AS a FROM ct GROUP BY 1, 2, 3), t2 AS (SELECT day, tt, count(DISTINCT page_id) AS b FROM ct GROUP BY 1, 2),
k AS (SELECT ct.*, CASE WHEN a >= 5 THEN 'template' WHEN length(regexp_replace(tt, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) >= 4 AND b >= 8 THEN 'title' END AS basis, a, b FROM ct JOIN t1 USING (day, tt, skeleton) JOIN t2 USING (day, tt)),
kits AS (SELECT *, CASE basis WHEN 'template' THEN a WHEN 'title' THEN b END AS kit_size, substr(sha1_hex, 1, 12) AS kit FROM (SELECT *, CASE basis WHEN 'template' THEN sha1('template|' || tt || '|' || skeleton) WHEN 'title' THEN sha1('title|' || tt) END AS sha1_hex FROM k))"""


@query("r8_classify_sites", f"WITH {OBS}, {CLASS} SELECT page_id, class FROM c")
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.classify_sites(observations(spark, sf_dir)).select("page_id", "class")


def kits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.collapse_kits(ops.classify_sites(observations(spark, sf_dir)).withColumn("site", F.col("page_id")))


@query("d21_collapse_kits", f"WITH {KITS} SELECT page_id, coalesce(kit, '') AS kit, coalesce(kit_size, 0) AS kit_size, coalesce(basis, '') AS basis FROM kits")
def d21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kits(spark, sf_dir).select("page_id", "kit", "kit_size", "basis").fillna("", ["kit", "basis"]).fillna(0, ["kit_size"])


@query("b13_publishable", f"WITH {KITS} SELECT page_id, title FROM (SELECT *, count(*) OVER (PARTITION BY day, lower(title)) AS same FROM kits) WHERE class = 'built' AND NOT regexp_matches(title, '{ops.GENERIC_TITLE}') AND kit IS NULL AND same < 8")
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.publishable(kits(spark, sf_dir)).select("page_id", "title")


@query("b14_feed", f"WITH {OBS} SELECT page_id, substr(title || ' ' || text, greatest(instr(lower(title || ' ' || text), 'tion') - 40, 1), 84) AS snippet FROM o WHERE regexp_extract(host, '[^.]*$') = (SELECT max(regexp_extract(host, '[^.]*$')) FROM o) AND day > 4 - 2 AND day <= 4 AND contains(lower(title || ' ' || text), 'tion') AND NOT contains(lower(title || ' ' || text), 'thewh')")
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    zone = obs.select(F.max(F.substring_index("host", ".", -1))).first()[0]
    return ops.feed(obs, q="tion", exclude="thewh", zone=zone, days=(F.lit(4), 2)).select("page_id", "snippet")


IDENTITY = f"{PAGES}, i AS (SELECT page_id, host AS name, title, regexp_replace(split_part(host, '.', 1), '[^a-z0-9]', '', 'g') AS label, replace(lower(title), host, ' ') AS t FROM f)"


@query("r14_identity_match", f"WITH {IDENTITY} SELECT page_id, CASE WHEN label = '' THEN false WHEN length(label) >= 4 THEN contains(regexp_replace(t, '[^a-z0-9]', '', 'g'), label) ELSE contains(' ' || regexp_replace(t, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || label || ' ') END AS match FROM i")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.page_features(table(spark, sf_dir, "pages")).select("page_id", F.col("host").alias("name"), "title", F.substring_index("host", ".", 1).alias("label"))
    return ops.identity_match(rows).select("page_id", "match")

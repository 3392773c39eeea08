"""URL filters by a temporal list join: every capture is judged by the list entries that were active when it was fetched.

A list is a log of dated entries: a pattern is listed with an action, and the newest entry of a pattern holds until the
next. Entries become validity intervals. A capture asks for its host, every parent domain and its first path segment; an
as-of join finds the interval of each that covers the fetch time, and the most specific pattern decides.

The join is by pattern and time bucket, so a busy host is spread over its buckets; within a bucket captures and intervals are put
in one order of time and each capture takes the interval before it, so nothing grows with captures times entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def patterns_of(url: Column) -> Column:
    """Structs (pattern, weight) that apply to a url, the weight larger for the more specific."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"), (F.size(labels) - i + 1).alias("weight")),
    )
    segment = F.regexp_extract(url, SEGMENT, 1)
    path = F.array(F.struct(F.concat_ws("/", host, segment).alias("pattern"), F.lit(1000).alias("weight")))
    return F.when(segment == "", suffixes).otherwise(F.concat(suffixes, path))


def intervals(entries: DataFrame, asked: DataFrame, bucket: Column) -> DataFrame:
    """(pattern, bucket, action, valid_from): the intervals of dated entries (pattern, action, listed_at) that reach into each asked (pattern, bucket).

    An interval holds from ``valid_from`` - null for one that began before the bucket - until the next one's. Of entries for one pattern at
    one time, ``block`` wins. Entries with a null anywhere are ignored.

    The entries of a bucket are first reduced to the last one; only these, one a bucket, are put in order to find what each bucket begins with, so
    the entries of a busy pattern never meet in one task.
    """
    known = entries.select("pattern", "action", "listed_at").dropna()
    once = known.groupBy("pattern", "listed_at").agg(F.max("action").alias("action")).withColumn("bucket", bucket)  # "block" sorts after "allow"
    last = once.groupBy("pattern", "bucket").agg(F.max_by("action", "listed_at").alias("last"))
    spine = last.join(asked, ["pattern", "bucket"], "full")
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = spine.withColumn("action", F.last("last", ignorenulls=True).over(before)).where("action is not null").select("pattern", "bucket", "action", F.lit(None).cast(entries.schema["listed_at"].dataType).alias("valid_from"))
    return begun.unionByName(once.withColumnRenamed("listed_at", "valid_from"))


def judge(captures: DataFrame, entries: DataFrame, *, bucket_seconds: int = 3600) -> DataFrame:
    """(capture_id, url, fetched_at, verdict, pattern) for every row of ``captures`` (capture_id, url, fetched_at).

    ``entries`` has pattern (a domain, or a host and first path segment), action (``allow`` or ``block``) and listed_at.
    ``verdict`` is the action of the most specific pattern active at fetch time, ``none`` if none is, ``unknown`` if the url is
    null or has no host or the fetch time is null. An interval holds from its first moment until just before its end.
    Repeated captures are judged each; null or repeated ids keep their rows. Without entries every known capture is ``none``;
    without captures there are no rows. Other columns are not read.
    """
    asked = captures.select("capture_id", F.col("url").cast("string").alias("url"), F.col("fetched_at")).groupBy("capture_id", "url", "fetched_at").agg(F.count("*").alias("copies"))
    asked = asked.withColumn("known", F.col("fetched_at").isNotNull() & (F.coalesce(host_of(F.col("url")), F.lit("")) != ""))
    bucket = lambda at: F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)).cast("long")
    wanted = asked.where("known").select("capture_id", "url", "fetched_at", bucket("fetched_at").alias("bucket"), F.explode(patterns_of(F.col("url"))).alias("p")).select("*", "p.*").drop("p")

    valid = intervals(entries, wanted.select("pattern", "bucket").distinct(), bucket("listed_at"))
    # as-of join: captures and intervals of a pattern and bucket in one order of time, an interval before the captures of its first moment
    question = F.struct("capture_id", "url", "fetched_at", "weight").alias("question")
    line = wanted.select("pattern", "bucket", F.col("fetched_at").alias("at"), F.lit(None).cast("string").alias("action"), question)
    line = line.unionByName(valid.select("pattern", "bucket", F.col("valid_from").alias("at"), "action"), allowMissingColumns=True)
    until = Window.partitionBy("pattern", "bucket").orderBy(F.col("at").asc_nulls_first(), F.col("question").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    hits = line.withColumn("action", F.last("action", ignorenulls=True).over(until)).where("question is not null AND action is not null").select("question.*", "pattern", "action")
    best = hits.groupBy("capture_id", "url", "fetched_at").agg(F.max(F.struct("weight", "pattern", "action")).alias("best"))
    a, b = asked.alias("a"), best.alias("b")
    same = F.col("a.capture_id").eqNullSafe(F.col("b.capture_id")) & (F.col("a.url") == F.col("b.url")) & (F.col("a.fetched_at") == F.col("b.fetched_at"))
    verdict = F.when(~F.col("a.known"), "unknown").otherwise(F.coalesce("b.best.action", F.lit("none")))
    judged = a.join(b, same, "left").select("a.capture_id", "a.url", "a.fetched_at", "a.copies", verdict.alias("verdict"), F.col("b.best.pattern").alias("pattern"))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "copy")


def captures_and_entries(pages: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and a dated list from the supplied tables.

    A page is fetched at the time of the event with its number. Each event of a user lists the page with the user's number: errors
    block its host and purchases allow it, clicks block its first path segment and views allow it, signups block its domain.
    """
    at = events.select(F.col("event_id").alias("capture_id"), F.col("ts").alias("fetched_at"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url").join(at, "capture_id", "left")
    host = host_of(F.col("url"))
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    kind = F.col("event_type")
    path = F.concat_ws("/", host, F.regexp_extract("url", SEGMENT, 1))
    pattern = F.when(kind.isin("error", "purchase"), host).when(kind.isin("click", "view"), path).otherwise(domain)
    action = F.when(kind.isin("error", "click", "signup"), "block").otherwise("allow")
    listed = events.select(F.col("user_id").alias("page_id"), "ts", "event_type").join(pages.select("page_id", "url"), "page_id")
    return captures, listed.select(pattern.alias("pattern"), action.alias("action"), F.col("ts").alias("listed_at"))


ORACLE = rf"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_extract(url, '{SEGMENT}', 1) AS segment FROM pages
), q AS (
  SELECT *, string_split(host, '.') AS labels FROM p
), c AS (
  SELECT q.page_id AS capture_id, q.url, q.host, q.segment, q.labels, e.ts AS fetched_at FROM q LEFT JOIN events e ON e.event_id = q.page_id
), l AS (
  SELECT CASE WHEN event_type IN ('error', 'purchase') THEN host WHEN event_type IN ('click', 'view') THEN host || '/' || segment
    ELSE array_to_string(labels[greatest(len(labels) - 1, 1):], '.') END AS pattern,
    CASE WHEN event_type IN ('error', 'click', 'signup') THEN 'block' ELSE 'allow' END AS action, ts AS listed_at
  FROM events e JOIN q ON q.page_id = e.user_id
), o AS (
  SELECT pattern, listed_at, max(action) AS action FROM l WHERE pattern IS NOT NULL AND listed_at IS NOT NULL GROUP BY 1, 2
), v AS (
  SELECT pattern, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS valid_to FROM o
), w AS (
  SELECT capture_id, url, fetched_at, unnest(list_transform(range(1, greatest(len(labels), 2)), lambda i: array_to_string(labels[i:], '.'))) AS pattern,
    unnest(list_transform(range(1, greatest(len(labels), 2)), lambda i: len(labels) - i + 1)) AS weight FROM c WHERE host <> ''
  UNION ALL SELECT capture_id, url, fetched_at, host || '/' || segment, 1000 FROM c WHERE host <> '' AND segment <> ''
), b AS (
  SELECT capture_id, url, fetched_at, max({{'weight': weight, 'pattern': pattern, 'action': action}}) AS best
  FROM w JOIN v USING (pattern) WHERE fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY 1, 2, 3
)
SELECT c.capture_id, c.url, epoch_us(c.fetched_at) AS fetched_us,
  CASE WHEN c.url IS NULL OR c.host = '' OR c.fetched_at IS NULL THEN 'unknown' ELSE coalesce(b.best.action, 'none') END AS verdict, coalesce(b.best.pattern, '') AS pattern
FROM c LEFT JOIN b ON b.capture_id = c.capture_id AND b.url = c.url AND b.fetched_at = c.fetched_at
"""

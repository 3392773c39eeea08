"""Market tables derived by Spark from the supplied ones, and the same derivations as SQL.

``names`` are sightings of labels in zones (events named after parts), with the name servers seen; ``listings`` are
offers (line items named after parts). Both grow with the tables they come from, and so do their distinct labels: parts have few names,
but every fifth part's labels end in a number of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Zones, and hosts of name servers with their class.
ZONES = ["com", "net", "org", "io", "ai", "shop", "xyz", "dev"]
HOSTS = ["parkingcrew.net", "sedoparking.com", "dan.com", "cloudflare.com", "registrar-servers.com", "unlisted.example"]
HOST_CLASSES = [
    ("parkingcrew.net", "parking"),
    ("sedoparking.com", "parking"),
    ("dan.com", "seller"),
    ("afternic.com", "seller"),
    ("cloudflare.com", "hosting"),
    ("registrar-servers.com", "registrar"),
]
SPLIT_DAY = "2024-01-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, day, user_id, kind, value, label, zone, host)."""
    events, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    turn = events.withColumn("turn", F.col("event_id") % part.select(F.max("p_partkey") + 1).scalar())
    joined = turn.join(part.select("p_partkey", "p_name"), F.col("turn") == F.col("p_partkey"))
    glue = F.when(F.col("event_id") % 7 == 0, "-").otherwise("")
    own = F.when(F.col("p_partkey") % 5 == 0, F.floor(F.col("p_partkey") / 40).cast("string")).otherwise("")
    tail = F.when(F.col("event_id") % 4 == 0, (F.col("user_id") % 10).cast("string")).otherwise(own)
    label = F.concat(F.lower(F.replace("p_name", F.lit(" "), glue)), tail)
    host = F.concat(F.lit("ns"), (F.col("event_id") % 3 + 1).cast("string"), F.lit("."), _pick(HOSTS, F.col("user_id")))
    return joined.select("event_id", "ts", F.to_date("ts").alias("day"), "user_id", F.col("event_type").alias("kind"), "value", label.alias("label"), _pick(ZONES, F.col("event_id") + F.col("user_id")).alias("zone"), host.alias("host"))


def _pick_sql(values: list[str], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({index} % {len(values)} + 1 AS INTEGER)]"


NAMES = f"""names AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type AS kind, value,
    lower(replace(p_name, ' ', CASE WHEN event_id % 7 = 0 THEN '-' ELSE '' END)) || CASE WHEN event_id % 4 = 0 THEN CAST(user_id % 10 AS VARCHAR) WHEN p_partkey % 5 = 0 THEN CAST(p_partkey // 40 AS VARCHAR) ELSE '' END AS label,
    {_pick_sql(ZONES, "(event_id + user_id)")} AS zone,
    'ns' || CAST(event_id % 3 + 1 AS VARCHAR) || '.' || {_pick_sql(HOSTS, "user_id")} AS host
  FROM (SELECT *, event_id % (SELECT max(p_partkey) + 1 FROM part) AS turn FROM events) JOIN part ON turn = p_partkey
)"""


def host_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOST_CLASSES, "host string, class string")


CLASSES = "classes AS (SELECT * FROM (VALUES " + ", ".join(f"('{h}', '{c}')" for h, c in HOST_CLASSES) + ") v(provider, class))"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(listing_id, domain, label, zone, stream, price, ends_at, bids, age_years, archive, zones_taken, available)."""
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = items.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    glue = F.when(F.col("l_orderkey") % 11 == 0, "-").otherwise("")
    tail = F.when(F.col("l_orderkey") % 3 == 0, (F.col("l_orderkey") % 100).cast("string")).otherwise("")
    label = F.concat(F.lower(F.replace("p_name", F.lit(" "), glue)), tail)
    zone = _pick(ZONES, F.col("l_linenumber") + F.col("l_suppkey"))
    stream = F.when(F.col("l_returnflag") == "A", "auction").when(F.col("l_returnflag") == "N", "expiring").otherwise("dropped")
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"),
        F.concat_ws(".", label, zone).alias("domain"),
        label.alias("label"),
        zone.alias("zone"),
        stream.alias("stream"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_orderkey") % 13 != 0, F.col("l_shipdate")).alias("ends_at"),
        (F.col("l_quantity").cast("int") % 5).alias("bids"),
        (F.col("l_orderkey") % 30).cast("int").alias("age_years"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 50).cast("int").alias("archive"),
        (F.col("l_partkey") % 9).cast("int").alias("zones_taken"),
        F.when(F.col("l_linestatus") == "O", True).when(F.col("l_quantity") < 10, False).alias("available"),
    )


LISTINGS = f"""listings AS (
  SELECT l_orderkey * 10 + l_linenumber AS listing_id, label || '.' || zone AS domain, label, zone, stream, price, ends_at, bids, age_years, archive, zones_taken, available
  FROM (
    SELECT *, lower(replace(p_name, ' ', CASE WHEN l_orderkey % 11 = 0 THEN '-' ELSE '' END)) || CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_orderkey % 100 AS VARCHAR) ELSE '' END AS label,
      {_pick_sql(ZONES, "(l_linenumber + l_suppkey)")} AS zone,
      CASE WHEN l_returnflag = 'A' THEN 'auction' WHEN l_returnflag = 'N' THEN 'expiring' ELSE 'dropped' END AS stream,
      CASE WHEN l_suppkey % 5 <> 0 THEN l_extendedprice END AS price,
      CASE WHEN l_orderkey % 13 <> 0 THEN l_shipdate END AS ends_at,
      CAST(trunc(l_quantity) AS INTEGER) % 5 AS bids, CAST(l_orderkey % 30 AS INTEGER) AS age_years,
      CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_suppkey % 50 AS INTEGER) END AS archive, CAST(l_partkey % 9 AS INTEGER) AS zones_taken,
      CASE WHEN l_linestatus = 'O' THEN true WHEN l_quantity < 10 THEN false END AS available
    FROM lineitem JOIN part ON l_partkey = p_partkey
  )
)"""

"""Search by an inverted index: the postings of a query's words are all that is read of the documents."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("name", "site", "theme")
VOWELS = "aeiou"


def inflections(word: str, shortest: int = 4) -> list[str]:
    """The plain forms of a word: plurals, past and -ing, with the spelling rules for a final e, for y after a consonant, and for a doubled last letter.
    Words of fewer letters stand for themselves alone."""
    if len(word) < shortest:
        return [word]
    stems = {word + end for end in ("", "s", "es", "ed", "ing")}
    if word[-1] == "e":
        stems |= {word + "d", word[:-1] + "ing"}
    if word[-1] == "y" and word[-2] not in VOWELS:
        stems |= {word[:-1] + "ies", word[:-1] + "ied"}
    if len(word) >= 3 and word[-1] not in VOWELS + "wxy" and word[-2] in VOWELS and word[-3] not in VOWELS:
        stems |= {word + word[-1] + end for end in ("ed", "ing")}
    return sorted(stems)


def write_index(docs: DataFrame, key: str, path: str, *, buckets: int = 64) -> None:
    """The postings (term, field, key) of ``docs`` (key, name, site, theme: arrays of terms), in folders by a hash of the term."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in FIELDS])
    each = docs.select(key, F.explode(fields).alias("f")).select(key, "f.field", F.explode(F.array_distinct("f.terms")).alias("term")).where("term is not null and term <> ''")
    placed = each.distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # a term that most documents hold is spread over the tasks; each writes to few folders
    placed.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("term").write.partitionBy("bucket").parquet(path)


def postings(spark: SparkSession, path: str, places: Sequence[tuple[str, int]], *, buckets: int = 64) -> DataFrame:
    """The index rows of the terms of ``places`` (term, place), with their places; folders and row groups of other terms are not read."""
    wanted = spark.createDataFrame(list(places), "term string, place int").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    folders = sorted({r.bucket for r in wanted.select("bucket").collect()})  # a few for each word of the query
    rows = spark.read.parquet(path).where(F.col("bucket").isin(folders) & F.col("term").isin(sorted({t for t, _ in places})))
    return rows.join(F.broadcast(wanted.select("term", "place")), "term").drop("bucket")


def search(spark: SparkSession, path: str, q: str, key: str, facts: DataFrame, *, buckets: int = 64) -> DataFrame:
    """(key, match, rank): documents that have all words of ``q``, or plain forms of them, in their name, else in their site, else the query as a theme.

    The rank, lower first, is three times the tier and the field's number: sites that are built and speak of the query (tier 0), names of the first quality (1), the rest (2), batches (3).
    ``facts`` (key, built, alpha, batch) is met with the found documents only. A query without letters or digits finds nothing.
    """
    words = re.findall(r"[a-z0-9]+", q.lower())
    theme = "".join(words)
    places = [(form, i) for i, word in enumerate(words) for form in inflections(word)] + [(theme, -1)]
    rows = postings(spark, path, places, buckets=buckets)
    hit = rows.groupBy(key).agg(
        *[F.count_distinct(F.when((F.col("field") == f) & (F.col("place") >= 0), F.col("place"))).alias(f) for f in FIELDS[:2]],
        F.bool_or((F.col("field") == "theme") & (F.col("place") < 0)).alias("theme"),
    )
    match = F.when(F.col("name") == len(words), "name").when(F.col("site") == len(words), "site").when(F.col("theme"), "theme")
    found = hit.withColumn("match", match).where("match is not null" if words else "false")
    ranked = found.join(facts.select(key, "built", "alpha", "batch"), key, "left").fillna(False, ["built", "alpha", "batch"])
    about = F.col("theme") | (F.col("site") == len(words))
    tier = F.when(F.col("batch"), 3).when(F.col("built") & about, 0).when(F.col("alpha"), 1).otherwise(2)
    number = F.when(F.col("match") == "name", 0).when(F.col("match") == "site", 1).otherwise(2)
    return ranked.select(key, "match", (tier * 3 + number).alias("rank"))

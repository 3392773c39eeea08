"""Ledgers of drops, sales and movements: extraction, reconciliation, joins to evidence, queues and exports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import global_rank, saved


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    saved(spark.range(1))  # makes sure of one
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def write_movement(df: DataFrame, path: str) -> None:
    """The movement tape: tab-separated, name servers as comma lists, a folder for each day."""
    flat = df.withColumns({c: F.array_join(c, ",") for c in ("prev_ns", "today_ns")})
    flat.write.partitionBy("day").option("sep", "\t").option("emptyValue", "").csv(path)


def read_movement(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The tape's rows of a span of days; other days' folders are not read."""
    rows = spark.read.option("sep", "\t").schema("kind string, name string, prev_ns string, today_ns string, day date").csv(path)
    rows = rows.where(F.col("day").between(first, last))
    hosts = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    return rows.withColumns({"prev_ns": hosts("prev_ns"), "today_ns": hosts("today_ns")})


def load_day(table: str, df: DataFrame, *, day: str = "day") -> None:
    """Replace whole days of a partitioned table by the days in ``df``; loading the same rows again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(table)


def receive(spark: SparkSession, table: str, receipts: str, df: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """(day, n, digest, verdict): takes in the days of ``df`` that have no receipt yet (``new``); a day whose rows have the digest of its
    receipt is skipped (``same``), one with another digest is refused (``refused``) and leaves the table as it is.

    Rows are written before their receipts, so a job that dies between takes the day in again and replaces it.
    """
    got = receipt(df, keys, day)
    spark.createDataFrame([], got.schema).write.mode("append").parquet(receipts)  # makes sure of a table
    known = saved(spark.read.schema(got.schema).parquet(receipts)).select(day, F.col("digest").alias("known"))
    verdict = F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("digest"), "same").otherwise("refused")
    told = saved(got.join(known, day, "left").withColumn("verdict", verdict).drop("known"))
    fresh = told.where("verdict = 'new'").select(day, "n", "digest")
    load_day(table, df.join(fresh.select(day), day, "left_semi"), day=day)
    fresh.write.mode("append").parquet(receipts)
    return told


def receipt(df: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """(day, n, digest): a digest of a day's rows that does not depend on their order; equal rows count each.

    It is the sum of a 48-bit hash of each row modulo 2**64, as a signed number: the plain sum while that fits into a long, whatever the number of rows.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")
    full, half = (F.lit(str(2**bits)).cast("decimal(38,0)") for bits in (64, 63))
    digest = F.pmod(F.col("total") + half, full) - half
    return df.groupBy(day).agg(F.count("*").alias("n"), F.sum(part).alias("total")).select(day, "n", digest.cast("long").alias("digest"))


def prune(df: DataFrame, today: Column, keep_days: int, day: str = "day") -> DataFrame:
    return df.where(F.col(day) > F.date_sub(today, keep_days))


def registry_facts(df: DataFrame, column: str) -> DataFrame:
    """Adds statuses, transferred (latest), registrar, pending and locked from a registry record in JSON; malformed JSON gives nulls."""
    shape = "struct<status: array<string>, events: array<struct<action: string, date: string>>, registrar: string>"
    rows = df.withColumn("_r", F.from_json(column, shape))
    status = F.transform("_r.status", lambda s: F.lower(F.replace(s, F.lit(" "), F.lit(""))))
    moved = F.array_max(F.transform(F.filter("_r.events", lambda e: e["action"] == "transfer"), lambda e: e["date"]))
    rows = rows.withColumns({"statuses": F.array_join(F.sort_array(F.array_distinct(status)), ","), "transferred": moved, "registrar": F.col("_r.registrar")})
    return rows.withColumns({"pending": F.exists(status, lambda s: s.startswith("pending")), "locked": F.array_contains(status, "clienttransferprohibited")}).drop("_r")


def extract_sales(pages: DataFrame, auction_venues: Sequence[str]) -> DataFrame:
    """(page_id, domain, price, venue, side) from the table rows of archived pages.

    A row's first domain cell and first price cell; the venue is the cell after the price unless that is a number, a domain or a price,
    else the last heading above.
    """
    units = F.regexp_extract_all("html", F.lit(r"(?is)(<tr\b.*?</tr>|<h[1-6]\b.*?</h[1-6]>)"), 1)
    each = pages.select("page_id", F.posexplode(units).alias("at", "unit"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    heading = F.when(F.lower("unit").startswith("<h"), clean(F.col("unit")))
    above = F.last(heading, ignorenulls=True).over(Window.partitionBy("page_id").orderBy("at"))
    cells = F.transform(F.regexp_extract_all("unit", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1), clean)
    rows = each.withColumns({"above": above, "cells": cells}).where(F.size("cells") > 0)
    is_domain = lambda c: c.rlike(r"(?i)^[a-z0-9-]+(\.[a-z]{2,})+$")
    is_price = lambda c: c.rlike(r"^\$[0-9][0-9,]*(\.[0-9]+)?$")
    at = F.get(F.filter(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: is_price(F.get("cells", i))), F.lit(0))
    rows = rows.withColumns({"domain": F.lower(F.get(F.filter("cells", is_domain), F.lit(0))), "price_at": at}).where("domain is not null and price_at is not null")
    after = F.get("cells", F.col("price_at") + 1)
    venue = F.when(after.isNull() | (after == "") | after.rlike(r"^#?[0-9]+$") | is_domain(after) | is_price(after), F.col("above")).otherwise(after)
    price = F.regexp_replace(F.get("cells", F.col("price_at")), r"[$,]", "").cast("double")
    return rows.select("page_id", "domain", price.alias("price"), F.coalesce(venue, F.lit("")).alias("venue")).withColumn("side", F.when(F.lower("venue").isin(*auction_venues), "auction").otherwise("enduser"))


def archive_ended(listings: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """(domain, source, ended_at, evidence): ended auctions that the drop events don't have yet, once each."""
    ended = listings.where((F.col("stream") == "auction") & (F.col("ends_at") <= now))
    evidence = F.to_json(F.struct("age_years", "archive"))
    rows = ended.groupBy("domain", F.col("stream").alias("source"), F.col("ends_at").alias("ended_at")).agg(F.min(evidence).alias("evidence"))
    return rows.join(events.select("domain", "source", "ended_at"), ["domain", "source", "ended_at"], "left_anti")


def reported_sales(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """(id, domain, day, price_usd, amount): published reports of the span; a price only where it is verified, in dollars only where it was."""
    rows = df.where((F.col("visibility") != "internal") & F.col("day").between(first, last))
    price = F.when(F.col("verified") & (F.col("currency") == "USD"), F.col("amount"))
    key = F.sha2(F.concat_ws("|", "domain", F.col("day").cast("string"), F.col("report_id").cast("string")), 256)
    return rows.select(key.alias("id"), "domain", "day", price.alias("price_usd"), F.when(F.col("verified"), F.col("amount")).alias("amount"))


def forward_join(members: DataFrame, listed: DataFrame, sales: DataFrame, day: Column) -> DataFrame:
    """Members (cluster, domain, listed_on, sold_on) with the days filled from today's listed set and from sales; a day once set stays."""
    a = listed.select("domain").distinct().withColumn("on_list", F.lit(True))
    b = sales.groupBy("domain").agg(F.min("day").alias("sale_day"))
    rows = members.join(a, "domain", "left").join(b, "domain", "left")
    return rows.select("cluster", "domain", F.coalesce("listed_on", F.when(F.col("on_list"), day)).alias("listed_on"), F.coalesce("sold_on", "sale_day").alias("sold_on"))


def cluster_outcomes(members: DataFrame) -> DataFrame:
    """(cluster, members, listed, sold, latest)."""
    return members.groupBy("cluster").agg(F.count("*").alias("members"), F.count("listed_on").alias("listed"), F.count("sold_on").alias("sold"), F.greatest(F.max("listed_on"), F.max("sold_on")).alias("latest"))


def term_sales(terms: DataFrame, sales: DataFrame, segments: DataFrame) -> DataFrame:
    """(term, side, n, total) over sales (listing_id, label, price, side) whose label's ``segments`` (label, pieces) hold the term.

    Labels are cut once each, however often they are sold."""
    held = segments.select("label", F.explode(F.array_distinct("pieces")).alias("term")).join(terms.select("term").distinct(), "term")
    return sales.join(held, "label").groupBy("term", "side").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


def merge_zone_trends(zone_rows: DataFrame, feed_rows: DataFrame) -> DataFrame:
    """(zone, day, n, source): rows of zone data, and of the feed where zone data has none."""
    feed = feed_rows.join(zone_rows.select("zone", "day"), ["zone", "day"], "left_anti")
    return zone_rows.withColumn("source", F.lit("zone")).unionByName(feed.withColumn("source", F.lit("feed")))


def reconcile_drops(stats: DataFrame, events: DataFrame) -> DataFrame:
    """(zone, day, status): complete if dropped = candidates = events and all are decided, pending while undecided, else error."""
    kept = events.groupBy("zone", "day").agg(F.count("*").alias("events"), F.count_if("decided").alias("decided"))
    rows = stats.join(kept, ["zone", "day"], "left").fillna(0, ["events", "decided"])
    status = F.when((F.col("dropped") != F.col("candidates")) | (F.col("dropped") != F.col("events")), "error").when(F.col("decided") < F.col("events"), "pending").otherwise("complete")
    return rows.select("zone", "day", status.alias("status"))


def sold_words(segments: DataFrame, top: int = 50) -> DataFrame:
    """(kind, item, n): the most frequent words and neighbouring pairs of sold labels; unknown pieces don't count."""
    known = segments.select(F.filter("pieces", lambda p: p != "?").alias("w"))
    words = known.select(F.explode(F.array_distinct("w")).alias("item")).withColumn("kind", F.lit("word"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    two = known.where("size(w) >= 2").select(F.explode(F.array_distinct(pairs)).alias("item")).withColumn("kind", F.lit("pair"))
    counts = words.union(two).groupBy("kind", "item").agg(F.count("*").alias("n"))
    return counts.withColumn("_place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "item"))).where(F.col("_place") <= top).drop("_place")


# References that titles hold, and residues of titles that name no template.
ENTITIES = {"&ndash;": "–", "&mdash;": "—", "&amp;": "&", "&nbsp;": " ", "&#8211;": "–", "&#8212;": "—", "&#39;": "'", "&quot;": '"'}
GENERIC_RESIDUES = ["home", "homepage", "welcome", "index", "official site", "official website", "coming soon", "under construction", "untitled", "new site", "my site", "site"]
_EDGE = r"[\s\p{Pd}|/\\•·~:.,]"  # white space, dashes, bars, slashes, bullets and stops
EDGES = f"^{_EDGE}+|{_EDGE}+$"


def adoption_kits(cands: DataFrame, now: Column, *, days: int = 30, least: int = 3) -> DataFrame:
    """Adds kit and kit_size: titles without the name and its label (of four letters or more), on ``least`` names or more of the last ``days``.

    References are decoded and separators at the ends dropped. A residue of under six characters, without a letter or digit, or a generic one is no kit; nor is an older row in one.
    """
    label = F.substring_index(F.lower("name"), ".", 1)
    residue = F.replace(F.lower("title"), F.lower("name"), F.lit(" "))
    residue = F.when(F.length(label) >= 4, F.replace(residue, label, F.lit(" "))).otherwise(residue)
    for reference, char in ENTITIES.items():
        residue = F.replace(residue, F.lit(reference), F.lit(char))
    residue = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(residue, r"^www\.", ""), EDGES, ""), r"\s+", " "))
    fine = (F.length("_key") >= 6) & F.col("_key").rlike("[a-z0-9]") & ~F.col("_key").isin(GENERIC_RESIDUES) & (F.date_diff(now, F.col("day")) <= days)
    keyed = cands.withColumn("_key", residue).withColumn("_key", F.when(fine, F.col("_key")))
    sizes = keyed.where("_key is not null").groupBy("_key").agg(F.count_distinct("name").alias("kit_size")).where(F.col("kit_size") >= least)
    return keyed.join(sizes, "_key", "left").withColumn("kit", F.when(F.col("kit_size").isNotNull(), F.substring(F.sha1("_key"), 1, 12))).drop("_key")


def verified_counts(df: DataFrame, receipts: DataFrame) -> DataFrame:
    """(stream, labels, verified): distinct labels, and those with a complete and current receipt."""
    good = receipts.where("complete and current").select("label").distinct().withColumn("ok", F.lit(True))
    return df.select("stream", "label").distinct().join(good, "label", "left").groupBy("stream").agg(F.count("*").alias("labels"), F.count("ok").alias("verified"))


def extension_evidence(*sources: DataFrame) -> DataFrame:
    """(label, zones, n): the union of the zones that any source (label, zones) knows."""
    every = sources[0].select("label", "zones")
    for more in sources[1:]:
        every = every.unionByName(more.select("label", "zones"))
    each = every.select("label", F.explode("zones").alias("zone")).where("zone is not null").distinct()
    return each.groupBy("label").agg(F.sort_array(F.collect_list("zone")).alias("zones"), F.count("*").alias("n"))


def taken_index(receipts: DataFrame, checks: DataFrame) -> DataFrame:
    """(zone, label): names taken by JSON receipts (label, body: zone -> state) or by single checks (zone, label)."""
    cells = receipts.select("label", F.explode(F.from_json("body", "map<string,string>")).alias("zone", "state")).where("state = 'taken'")
    return cells.select("zone", "label").union(checks.select("zone", "label")).distinct()


def sort_listings(df: DataFrame, field: str, descending: bool, tie: str = "listing_id") -> DataFrame:
    """Adds ``place`` in a total order, nulls last either way."""
    return global_rank(df, [F.desc_nulls_last(field) if descending else F.asc_nulls_last(field), F.asc(tie)], "place")


def feed_order(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Adds class and name ranks, and ``place`` by them, then by length, name and class."""
    kind = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    name = F.when(F.col("label").rlike("^[a-z]+$"), 0).when(~F.contains("label", F.lit("-")), 1).otherwise(2)
    ranked = df.withColumns({"class_rank": F.when(kind == 0, len(classes) + 1).otherwise(kind), "name_rank": name})
    return global_rank(ranked, [F.asc("class_rank"), F.asc("name_rank"), F.length("label").asc(), F.asc("label"), F.asc("class")], "place")


def pending_queue(df: DataFrame, labelled: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows that nobody has labelled, newest day first, then by priority and name."""
    return df.join(labelled.select(key).distinct(), key, "left_anti").orderBy(F.desc("day"), F.desc("priority"), key).limit(limit)


def select_recheck(df: DataFrame, cutoff: Column, before: Column, limit: int) -> DataFrame:
    """Departures since the cutoff: unchecked ones first, the newest first, then those whose last check is longest ago and before ``before``."""
    due = df.where((F.col("day") >= cutoff) & (F.col("checked_at").isNull() | (F.col("checked_at") < before)))
    fresh = F.col("checked_at").isNull()
    return due.orderBy(F.desc(fresh), F.when(fresh, -F.unix_date("day")), "checked_at", "name").limit(limit)


def domain_terms(segments: DataFrame) -> DataFrame:
    """(label, role, term): the last known piece is the head, those before it are modifiers, neighbours are pairs."""
    rows = segments.select("label", F.filter("pieces", lambda p: (p != "?") & (F.length(p) >= 3)).alias("w")).where("size(w) > 0")
    struct = lambda role, term: F.struct(F.lit(role).alias("role"), term.alias("term"))
    head = F.array(struct("head", F.element_at("w", -1)))
    several = F.size("w") >= 2
    modifiers = F.when(several, F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(1))), lambda t: struct("modifier", t))).otherwise(F.slice(head, 1, 0))
    pairs = F.when(several, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: struct("pair", F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1))))).otherwise(F.slice(head, 1, 0))
    return rows.select("label", F.explode(F.array_distinct(F.concat(head, modifiers, pairs))).alias("x")).select("label", "x.*")


def fragment_lift(daily: DataFrame, sizes: DataFrame, day: Column, *, window: int = 7, absent: float = 3.0) -> DataFrame:
    """(zone, token, n, expected, lift): a day's count against the window before, scaled to the day's size; an absent day counts as ``absent``."""
    number = F.date_diff(day, "day")
    days = sizes.where(number.between(1, window))
    today = sizes.where(F.col("day") == day).select("zone", F.col("size").alias("today_size"))
    now = daily.where(F.col("day") == day).select("zone", "token", "n")
    spine = now.select("zone", "token").join(days, "zone").join(today, "zone")
    past = spine.join(daily.select("zone", "token", "day", F.col("n").alias("was")), ["zone", "token", "day"], "left")
    scaled = F.coalesce("was", F.lit(absent)) * F.col("today_size") / F.col("size")
    expected = past.groupBy("zone", "token").agg(F.avg(scaled).alias("expected"))
    return now.join(expected, ["zone", "token"]).select("zone", "token", "n", F.round("expected", 6).alias("expected"), F.round(F.col("n") / F.col("expected"), 6).alias("lift"))


def theme_trajectory(rows: DataFrame, theme: str, full: str = "com") -> DataFrame:
    """(theme, day, n, share, partial): a theme's rows of each day and per 1000 of the day's; a day without the anchor zone is partial."""
    days = rows.groupBy("day").agg(F.count("*").alias("total"), (F.count_if(F.col("zone") == full) == 0).alias("partial"))
    return rows.groupBy(theme, "day").agg(F.count("*").alias("n")).join(days, "day").select(theme, "day", "n", F.round(1000.0 * F.col("n") / F.col("total"), 6).alias("share"), "partial")


def search(docs: DataFrame, q: str) -> DataFrame:
    """Adds ``match`` (name, site or theme: where all words of the query are first found) to docs of token arrays name, site, theme."""
    words = F.array(*[F.lit(w) for w in q.lower().split()])
    inside = lambda c: F.size(F.array_except(words, F.col(c))) == 0
    return docs.withColumn("match", F.when(inside("name"), "name").when(inside("site"), "site").when(inside("theme"), "theme")).where("match is not null")


def literal_search(docs: DataFrame, q: str, columns: Mapping[str, str], around: int = 30) -> DataFrame:
    """Adds ``match`` and ``excerpt``: the words in order with any separators between, on word edges, in the first column that has them."""
    special = r"\.^$*+?{}[]|()"
    words = ["".join("\\" + c if c in special else c for c in w) for w in q.lower().split()]
    last = words[-1] + (r"\w*" if len(words[-1]) >= 5 else "")  # a long last word may be the start of one
    pattern = r"(?i)(?<![A-Za-z0-9_])" + r"[\W_]+".join([*words[:-1], last]) + r"(?![A-Za-z0-9_])"
    match, excerpt = F.lit(None).cast("string"), F.lit("")
    for name, column in reversed(columns.items()):
        hit = F.col(column).rlike(pattern)
        place = F.length(F.regexp_extract(F.col(column), "(?s)^(.*?)" + pattern, 1)) + 1
        cut = F.substring(F.col(column), F.greatest(place - around, F.lit(1)), F.lit(2 * around))
        match, excerpt = F.when(hit, name).otherwise(match), F.when(hit, cut).otherwise(excerpt)
    return docs.withColumns({"match": match, "excerpt": excerpt}).where("match is not null")


def ranked_literal_search(docs: DataFrame, q: str, columns: Mapping[str, str], *, junk: str, around: int = 30) -> DataFrame:
    """``literal_search`` with ``rank``, the number of the first of ``columns`` that has the words; rows with ``junk`` set are found by the first column only."""
    hidden = F.coalesce(F.col(junk), F.lit(False))
    first, *rest = columns.items()
    seen = docs.withColumns({f"_{name}": F.when(~hidden, F.col(column)) for name, column in rest})
    found = literal_search(seen, q, {first[0]: first[1], **{name: f"_{name}" for name, _ in rest}}, around)
    rank = F.array_position(F.array(*[F.lit(name) for name in columns]), F.col("match")) - 1
    return found.withColumn("rank", rank.cast("int")).drop(*[f"_{name}" for name, _ in rest])


WARNINGS = {"number": "[0-9]", "hyphen": "-", "repeated letters": r"(.)\1\1", "hard consonant run": "[^aeiou]{6,}"}


def auction_score(df: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``points``, ``halves`` and ``warnings``: labels of two dictionary words get points, digits, hyphens and length cost some, bids and age add some.

    The warnings name digits, hyphens, a character three times in a row and six consonants in a row.
    """
    cuts = F.explode(F.sequence(F.lit(2), F.greatest(F.length("label") - 2, F.lit(2))))
    split = df.select("label").distinct().select("label", cuts.alias("cut")).select("label", F.expr("substr(label, 1, cut)").alias("a"), F.expr("substr(label, cut + 1)").alias("b"))
    entries = words.select("entry").distinct()
    found = split.join(entries, split["a"] == entries["entry"], "left_semi").join(entries, split["b"] == entries["entry"], "left_semi")
    best = found.groupBy("label").agg(F.min(F.concat_ws(" ", "a", "b")).alias("halves"))
    rows = df.join(best, "label", "left")
    points = F.when(F.col("halves").isNotNull(), 40).otherwise(0) - F.when(F.col("label").rlike("[0-9]"), 20).otherwise(0) - F.when(F.contains("label", F.lit("-")), 15).otherwise(0)
    points = points + F.least(F.col("bids"), F.lit(10)) * 3 + F.least(F.col("age_years"), F.lit(20)) - F.greatest(F.length("label") - 10, F.lit(0)) * 4
    found = [F.when(F.col("label").rlike(pattern), name) for name, pattern in WARNINGS.items()]
    return rows.withColumns({"points": points, "warnings": F.array_join(F.array_compact(F.array(*found)), ", ")})


def derived_rows(df: DataFrame) -> DataFrame:
    """Adds tape (aftermarket, builder, noise) and length_band to assessed movements."""
    tape = F.when(F.col("tier") == "excluded", "noise").when(F.col("today_class") == "hosting", "builder").otherwise("aftermarket")
    size = F.length(F.substring_index("name", ".", 1))
    band = F.when(size <= 4, "1-4").when(size <= 8, "5-8").when(size <= 12, "9-12").otherwise("13+")
    return df.withColumns({"tape": tape, "length_band": band})


def ingest_days(spark: SparkSession, source: str, schema: str, target: str, progress: str) -> None:
    """Take in files of a folder that have not been taken yet, under ``day=.../batch=...``.

    A day may come in any number of batches; a batch that is run again replaces only what it wrote itself.
    """

    def take(df: DataFrame, batch: int) -> None:
        rows = df.withColumn("batch", F.lit(batch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()

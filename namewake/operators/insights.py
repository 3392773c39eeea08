"""Freshness of what is published, tapes of themes, emerging terms, brand families and insight cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import saved
from .trends import ZERO_WEIGHT

def freshness(
    imports: DataFrame,
    departures: DataFrame,
    dirty: DataFrame,
    now: Column,
    *,
    gap_days: int = 7,
    backlog_days: int = 14,
    backlog_degraded: int = 120,
    backlog_stale: int = 360,
    dirty_stale: int = 60,
) -> DataFrame:
    """(part, status, n, oldest_minutes): how fresh the ledger is at ``now``: ok, degraded or stale for each part, and the worst as ``verdict``.

    ``imports`` (day, imported_at): yesterday and every day of the last ``gap_days`` since the first import must be there. ``departures`` (name, day,
    checked, admitted_at): an unchecked one of the last ``backlog_days`` arrived at the latest of its day, its day's import and its admission; the
    oldest arrival's age in minutes decides. ``dirty`` (name, dirty_at): assessments to be made anew. Without any import movement is stale.
    """
    expected = F.date_sub(F.to_date(now), 1)
    have = imports.groupBy("day").agg(F.max("imported_at").alias("imported_at"))
    span = have.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = F.sequence(F.least(F.greatest("first", F.date_sub(expected, gap_days - 1)), expected), expected, F.expr("INTERVAL 1 DAY"))
    asked = span.select(F.explode(F.when(F.col("first").isNull(), F.array(expected)).otherwise(days)).alias("day"), "last")  # ``gap_days`` rows
    missing = asked.join(have, "day", "left_anti").where((F.col("day") < expected) | F.col("last").isNull() | (F.col("last") < expected))
    movement = missing.agg(F.count("*").alias("n")).select(F.lit("movement").alias("part"), F.when(F.col("n") > 0, "stale").otherwise("ok").alias("status"), "n", F.lit(None).cast("long").alias("oldest_minutes"))

    minutes = lambda at: F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60_000_000)
    waiting = departures.where(~F.col("checked") & (F.col("day") >= F.date_sub(F.to_date(now), backlog_days))).join(have, "day", "left")
    arrived = F.greatest(F.col("day").cast("timestamp_ntz"), "imported_at", "admitted_at")
    age = F.col("oldest_minutes")
    backlog = waiting.agg(F.count("*").alias("n"), F.max(minutes(arrived)).alias("oldest_minutes"))
    backlog = backlog.select(F.lit("backlog").alias("part"), F.when(age > backlog_stale, "stale").when(age > backlog_degraded, "degraded").otherwise("ok").alias("status"), "n", "oldest_minutes")
    again = dirty.agg(F.count("*").alias("n"), F.max(minutes(F.col("dirty_at"))).alias("oldest_minutes"))
    again = again.select(F.lit("assessments").alias("part"), F.when(age > dirty_stale, "stale").when(age.isNull() & (F.col("n") > 0), "degraded").otherwise("ok").alias("status"), "n", "oldest_minutes")

    parts = saved(movement.union(backlog).union(again))  # three rows
    rank = F.when(F.col("status") == "stale", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    worst = parts.agg(F.max(rank).alias("worst"), F.count_if(rank > 0).alias("n"))
    verdict = worst.select(F.lit("verdict").alias("part"), F.when(F.col("worst") == 2, "stale").when(F.col("worst") == 1, "degraded").otherwise("ok").alias("status"), "n", F.lit(None).cast("long").alias("oldest_minutes"))
    return parts.union(verdict)


def _parts(domain: Column) -> tuple[Column, Column, Column]:
    """Label and zone of a domain, and whether both are well formed."""
    clean = F.lower(F.trim(domain))
    label, zone = F.substring_index(clean, ".", 1), F.regexp_extract(clean, r"^[^.]*\.(.+)$", 1)
    return label, zone, label.rlike("^[a-z0-9-]{1,63}$") & (zone != "")


def sales_tape(entries: DataFrame, first: Column, last: Column) -> DataFrame:
    """(label, zone, day): the likely sales of a span from entries (domain, report_day, likely), one row each; malformed domains are left out."""
    label, zone, good = _parts(F.col("domain"))
    return entries.where("likely").where(F.col("report_day").between(first, last) & good).select(label.alias("label"), zone.alias("zone"), F.col("report_day").alias("day"))


def candidate_tape(rows: DataFrame) -> DataFrame:
    """(label, zone, day) from candidates (domain, departure_day) that have a day."""
    label, zone, good = _parts(F.col("domain"))
    return rows.where(F.col("departure_day").isNotNull() & good).select(label.alias("label"), zone.alias("zone"), F.col("departure_day").alias("day"))


def tape_facts(entries: DataFrame, facts: list[str], tie: str) -> DataFrame:
    """(label, facts): for each label of the tape its latest entry, of one day the one with the largest ``tie``."""
    label, _, good = _parts(F.col("domain"))
    best = F.max_by(F.struct(*facts), F.struct("report_day", tie))
    return entries.where("likely").where(good).groupBy(label.alias("label")).agg(best.alias("f")).select("label", "f.*")


def emerging(terms: DataFrame, common: DataFrame, established: Sequence[str] = ()) -> DataFrame:
    """(term, novelty, score): novelty x adoption x widening x frontier of terms (term, operators, per_million, presence, established, roles,
    partners, zones, frontier_share).

    ``common`` (word, rank) are the words of common language; a word outside it is wholly new. Terms of under two operators, established ones and
    phrases of ``established`` words only score 0. A null per_million is a term that registrations have never had.
    """
    words = terms.select("term", F.explode(F.split("term", " ")).alias("word")).join(common, "word", "left")
    known = F.col("word").isin(*established, "")
    one = F.when(known, 0.02).when(F.col("rank").isNull(), 1.0).otherwise(F.least(F.lit(1.0), 0.02 + F.pow(F.col("rank") / 10000, F.lit(1.5))))
    lexical = words.groupBy("term").agg(F.exp(F.sum(F.log(one))).alias("product"), F.count("*").alias("n_words"), F.bool_and(known).alias("old"))
    rows = terms.join(lexical, "term")
    seldom = F.coalesce(1 / (1 + F.log10(1 + F.col("per_million"))), F.lit(1.0)) * (1 - 0.7 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), "presence")))
    novelty = seldom * F.when(F.col("n_words") == 1, F.col("product")).otherwise(F.sqrt("product"))
    widening = 1 + F.when(F.col("roles") >= 2, 0.4).otherwise(0.0) + F.least("partners", F.lit(10)) * 0.05 + F.when(F.col("zones") >= 2, 0.3).otherwise(0.0)
    frontier = 1 + 1.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), "frontier_share"))
    out = (F.col("operators") < 2) | F.col("established") | F.col("old")
    score = F.when(out, 0.0).otherwise(F.round(novelty * F.log2(1 + F.col("operators")) * widening * frontier, 4))
    return rows.select("term", F.round(novelty, 6).alias("novelty"), score.alias("score"))


def brand_families(labels: DataFrame, reference: DataFrame, words: DataFrame, *, size: int = 9, least: int = 6, top: int = 4000) -> DataFrame:
    """(root, label): families of labels that share a run of ``size`` characters which is no dictionary word and not usual in the reference.

    The ``top`` runs by labels (then by text) are candidates. Each takes, in that order, the labels that none before it has; one that is left with under
    ``least`` takes none. The order is kept without a sequential pass: a candidate is settled once it comes first among the open
    candidates of every label it can still take, so all that don't compete settle in one round of joins.
    """
    runs = lambda rows: rows.where(F.length("label") >= size).select("label", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("label") - size + 1), lambda i: F.substring("label", i, F.lit(size))))).alias("root"))
    each = saved(runs(labels.select("label").distinct()))
    counted = each.groupBy("root").agg(F.count("*").alias("n")).where((F.col("n") >= least) & ~F.col("root").rlike(r"(.)\1\1"))
    best = saved(counted.orderBy(F.desc("n"), "root").limit(top))  # a bounded list
    usual = runs(reference.select("label").distinct()).join(best.select("root"), "root").groupBy("root").agg(F.count("*").alias("seen"))
    sizes = labels.agg(F.count_distinct("label").alias("all")).join(reference.agg(F.count_distinct("label").alias("all_ref")))  # one row each
    entries = words.select("entry").distinct()
    inside = entries.where(F.length("entry") >= size).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("entry") - size + 1), lambda i: F.substring("entry", i, F.lit(size)))).alias("root"))
    cuts = best.select("root", F.explode(F.sequence(F.lit(3), F.lit(min(6, size - 3)))).alias("at")).select("root", F.expr("substr(root, 1, at)").alias("a"), F.expr("substr(root, at + 1)").alias("b"))
    split = cuts.join(entries.withColumnRenamed("entry", "a"), "a").join(entries.withColumnRenamed("entry", "b"), "b").select("root")
    plain = inside.union(split).distinct()
    good = best.join(plain, "root", "left_anti").join(usual, "root", "left").join(F.broadcast(sizes))
    limit = 0.3 * F.col("n") / F.greatest("all", F.lit(1)) + 3 / F.greatest("all_ref", F.lit(1))
    good = good.where(F.coalesce("seen", F.lit(0)) / F.greatest("all_ref", F.lit(1)) <= limit)
    order = saved(good.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "root"))).select("root", "place"))  # at most ``top`` rows
    open_, taken = saved(each.join(order, "root")), None
    while not open_.isEmpty():
        first = open_.groupBy("label").agg(F.min("place").alias("first"))
        state = open_.join(first, "label").groupBy("place").agg(F.bool_and(F.col("place") == F.col("first")).alias("ready"), F.count("*").alias("n"))
        state = saved(state.where("ready"))
        won = saved(open_.join(state.where(F.col("n") >= least).select("place"), "place").select("root", "label"))
        taken = won if taken is None else saved(taken.union(won))
        open_ = saved(open_.join(state.select("place"), "place", "left_anti").join(won.select("label"), "label", "left_anti"))
    return taken if taken is not None else each.select("root", "label").limit(0)


def insight_cards(adds: DataFrame, segments: DataFrame, words: DataFrame, day: Column, *, period: int = 1, baseline: int = 7, comparable: bool = True, least: int = 3, aligned_share: float = 0.4, top: int = 400) -> DataFrame:
    """(word, labels, names, prior_names, ratio, direction, extensions, history, examples): what words the new names of a period are made of.

    ``adds`` (label, zone, day) of zones that carry weight; a name counts once. A label counts for a word that is a piece of its ``segments``.
    Of the ``top`` words by names and length, those with ``least`` labels and ``aligned_share`` of all labels that hold the word as text
    stay; a word around another one with half of that one's labels or more is part of its card. Shares are compared with the ``baseline`` days before,
    if the sources are ``comparable``: gained from 1.25, lost to 0.8. Extensions by names, history by day of the period, four examples.
    """
    age = F.date_diff(day, "day")
    rows = adds.where(~F.col("zone").isin(*ZERO_WEIGHT))
    now = saved(rows.where(age.between(0, period - 1)).groupBy("label", "zone").agg(F.min("day").alias("day")))
    before = rows.where(age.between(period, period + baseline - 1)).groupBy("label", "zone", "day").agg(F.lit(1).alias("one"))
    entries = words.select(F.col("entry").alias("word")).distinct().where(F.length("word") >= 3)
    pieces = segments.select("label", F.explode(F.array_distinct("pieces")).alias("word")).join(entries, "word")
    used = saved(now.join(pieces, "label"))
    counts = used.groupBy("word").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("names"))
    weight = F.col("names") * F.least(F.lit(1.0), F.pow(F.length("word") / 6, F.lit(2)))
    counts = counts.orderBy(F.desc(F.round(weight, 9)), "word").limit(top)
    inside = lambda at: F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.lit(18), F.length("label") - at + 1))), lambda n: F.substring("label", at, n))
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("label")), inside)))  # a label is one row, so no pair comes twice
    texts = now.select("label").distinct().select(F.explode(runs).alias("word"))
    raw = texts.join(entries, "word").groupBy("word").agg(F.count("*").alias("raw"))
    kept = saved(counts.join(raw, "word", "left").where((F.col("labels") >= least) & (F.col("labels") >= aligned_share * F.coalesce("raw", "labels"))).drop("raw"))
    spans = kept.select("word", "labels", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    spans = spans.select("word", "labels", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("at") + 1), lambda n: F.substring("word", F.col("at"), n))).alias("inner"))
    parents = kept.select(F.col("word").alias("inner"), F.col("labels").alias("of"))
    nested = spans.where("inner <> word").join(parents, "inner").where(F.col("labels") >= 0.5 * F.col("of")).select("word").distinct()
    cards = kept.join(nested, "word", "left_anti")

    old = before.join(pieces, "label").groupBy("word").agg(F.count("*").alias("prior_names"))
    totals = now.agg(F.count("*").alias("all")).join(before.agg(F.count("*").alias("all_before")))  # one row each
    zones = used.groupBy("word", "zone").agg(F.count("*").alias("n")).groupBy("word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "zone"))), lambda z: F.concat(z["zone"], F.lit(":"), (-z["n"]).cast("string"))), ",").alias("extensions"))
    days = F.sequence(F.date_sub(day, period - 1), day, F.expr("INTERVAL 1 DAY"))
    daily = used.groupBy("word", "day").agg(F.count("*").alias("n")).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("m"))
    history = daily.select("word", F.array_join(F.transform(days, lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0)).cast("string")), ",").alias("history"))
    order = Window.partitionBy("word").orderBy(F.desc(F.col("zone") == "com"), F.col("label").rlike("[^a-z]"), F.length("label"), "label", "zone")
    best = used.join(cards.select("word"), "word").withColumn("place", F.row_number().over(order)).where("place <= 4")
    examples = best.groupBy("word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(".", "label", "zone").alias("name")))), lambda e: e["name"]), ",").alias("examples"))
    found = cards.join(old, "word", "left").fillna(0, ["prior_names"]).join(F.broadcast(totals)).join(zones, "word").join(history, "word").join(examples, "word")
    ratio = F.when(F.lit(comparable) & (F.col("prior_names") > 0), (F.col("names") / F.col("all")) / (F.col("prior_names") / F.col("all_before")))
    direction = F.when(~F.lit(comparable), "observed").when(F.col("all_before") == 0, "snapshot").when(F.col("prior_names") == 0, "new").when(ratio >= 1.25, "gained").when(ratio <= 0.8, "lost").otherwise("similar")
    return found.select("word", "labels", "names", "prior_names", F.round(ratio, 6).alias("ratio"), direction.alias("direction"), "extensions", "history", "examples")

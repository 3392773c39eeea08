"""Counts over days: zones, keywords, tokens, and what rises against a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import global_rank

# Zones whose registrations carry no signal, and zone groups that carry more.
ZERO_WEIGHT = ("xyz", "shop", "info")
GROUPS = {"technical": ("dev", "io", "ai"), "commerce": ("shop", "store"), "media": ("tv", "fm")}


def signal_weight(zone: Column) -> Column:
    return F.when(zone.isin(*ZERO_WEIGHT), 0).otherwise(1)


def weighted_labels(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, labels): distinct labels, each with the largest weight of its zones."""
    once = df.groupBy(*by, "label").agg(F.max(signal_weight(F.col("zone"))).alias("weight"))
    return once.groupBy(*by).agg(F.sum("weight").alias("labels"))


def zone_trends(stats: DataFrame) -> DataFrame:
    """(zone, day, n, previous, growth): each zone's newest day against the one before; growth in percent, null for a first day."""
    order = Window.partitionBy("zone").orderBy("day")
    rows = stats.withColumn("previous", F.lag("n").over(order)).withColumn("place", F.row_number().over(Window.partitionBy("zone").orderBy(F.desc("day"))))
    return rows.where("place = 1").select("zone", "day", "n", "previous", F.round(100.0 * (F.col("n") - F.col("previous")) / F.col("previous"), 2).alias("growth"))


def keyword_trends(adds: DataFrame, day: Column, *, min_zones: int = 2, top: int = 5000) -> DataFrame:
    """(label, n_zones, zones): labels new in several zones on a day."""
    seen = adds.where(F.col("day") == day).groupBy("label").agg(F.sort_array(F.collect_set("zone")).alias("zones"))
    return seen.withColumn("n_zones", F.size("zones")).where(F.col("n_zones") >= min_zones).orderBy(F.desc("n_zones"), "label").limit(top)


def keyword_history(adds: DataFrame) -> DataFrame:
    """(keyword, day, zones, n_zones): every day's exact zone list of each label."""
    return adds.groupBy(F.col("label").alias("keyword"), "day").agg(F.sort_array(F.collect_set("zone")).alias("zones")).withColumn("n_zones", F.size("zones"))


def daily_tokens(names: DataFrame, tokens: Column) -> DataFrame:
    """(zone, day, token, words, n): names by token; a token counts once in a name."""
    each = names.select("zone", "day", "label", F.explode(F.array_distinct(tokens)).alias("token")).distinct()
    return each.groupBy("zone", "day", "token").agg(F.count("*").alias("n")).withColumn("words", F.size(F.split("token", " ")))


def token_totals(counts: DataFrame, *, zones: Sequence[str] = (), words: tuple[int, int] = (1, 3), contains: str | None = None) -> DataFrame:
    """(zone, day, tokens, n): how many of the daily token counts pass the filters, and their sum."""
    rows = counts.where(F.col("words").between(*words))
    rows = rows.where(F.col("zone").isin(*zones)) if zones else rows
    rows = rows.where(F.contains("token", F.lit(contains.lower()))) if contains else rows
    return rows.groupBy("zone", "day").agg(F.count("*").alias("tokens"), F.sum("n").alias("n"))


def observed_zone_trends(sightings: DataFrame, day: Column, days: int) -> DataFrame:
    """(zone, total, recent): names by zone, and those first seen there in the last ``days``."""
    first = sightings.groupBy("zone", "label").agg(F.min("day").alias("first"))
    return first.groupBy("zone").agg(F.count("*").alias("total"), F.count_if(F.col("first") > F.date_sub(day, days)).alias("recent"))


def observed_keyword_trends(sightings: DataFrame) -> DataFrame:
    """(label, n_zones, newest, new_zones): zones of each label, its newest day of first sights, and the zones of that day."""
    first = sightings.groupBy("label", "zone").agg(F.min("day").alias("first"))
    by_day = first.groupBy("label", "first").agg(F.sort_array(F.collect_set("zone")).alias("zones"))
    return by_day.groupBy("label").agg(F.sum(F.size("zones")).alias("n_zones"), F.max("first").alias("newest"), F.max_by("zones", "first").alias("new_zones"))


def token_movement(events: DataFrame, start: Column, end: Column, days: int, token: str = "token") -> DataFrame:
    """(token, added, dropped, net, rank, previous_rank, rank_change, series): a range against the equally long one before.

    ``series`` is the net of each day of the range as text, days without events as 0. Ranks go by net, then token.
    """
    signed = events.withColumn("step", F.when(F.col("kind") == "add", 1).otherwise(-1)).where(F.col("day").between(F.date_sub(start, days), end))
    now = F.col("day") >= start
    totals = signed.groupBy(token).agg(
        F.count_if(now & (F.col("step") == 1)).alias("added"),
        F.count_if(now & (F.col("step") == -1)).alias("dropped"),
        F.coalesce(F.sum(F.when(now, F.col("step"))), F.lit(0)).alias("net"),
        F.coalesce(F.sum(F.when(~now, F.col("step"))), F.lit(0)).alias("before"),
        F.count_if(~now).alias("seen_before"),
    )
    ranked = global_rank(totals, [F.desc("net"), F.asc(token)], "rank")
    ranked = global_rank(ranked, [F.desc(F.col("seen_before") > 0), F.desc("before"), F.asc(token)], "previous_rank")
    ranked = ranked.withColumn("previous_rank", F.when(F.col("seen_before") > 0, F.col("previous_rank")))
    spine = day_series(signed.where(now), token, "day", "step", start, end)
    return ranked.join(spine, token, "left").select(token, "added", "dropped", "net", "rank", "previous_rank", (F.col("previous_rank") - F.col("rank")).alias("rank_change"), "series")


def day_series(df: DataFrame, key: str, day: str, value: str, start: Column, end: Column) -> DataFrame:
    """(key, series): the sum of each day from start to end, days without rows as 0, joined by commas."""
    sums = df.groupBy(key, day).agg(F.sum(value).alias("v"))
    maps = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(day, "v"))).alias("m"))
    days = F.sequence(start, end, F.expr("INTERVAL 1 DAY"))
    return maps.select(key, F.array_join(F.transform(days, lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0)).cast("string")), ",").alias("series"))


def trending(history: DataFrame, anchor: Column, *, window: int = 7, baseline: int = 28, min_sample: int = 3) -> DataFrame:
    """(keyword, days, baseline_days, momentum, zones, weight): window rate over the baseline rate.

    ``history`` has keyword, day, zones. Zones without weight don't count. A baseline of under ``min_sample`` occurrences gets one more.
    """
    weighted = history.withColumn("zones", F.filter("zones", lambda z: ~z.isin(*ZERO_WEIGHT))).where(F.size("zones") > 0)
    age = F.date_diff(anchor, "day")
    inside, before = age.between(0, window - 1), age.between(window, window + baseline - 1)
    found = weighted.where(age.between(0, window + baseline - 1)).groupBy("keyword").agg(
        F.count_if(inside).alias("n"),
        F.count_if(before).alias("base"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(inside, F.col("zones")))))).alias("zones"),
    )
    guarded = F.when(F.col("base") < min_sample, F.col("base") + 1).otherwise(F.col("base"))
    curated = [z for zones in GROUPS.values() for z in zones]
    weight = F.aggregate("zones", F.lit(0), lambda total, z: total + F.when(z.isin(*curated), 3).otherwise(1))
    momentum = (F.col("n") / window) / (guarded / baseline)
    return found.where("n > 0").select("keyword", F.col("n").alias("days"), F.col("base").alias("baseline_days"), F.round(momentum, 3).alias("momentum"), "zones", weight.alias("weight"))


def history_lexicon(daily: DataFrame) -> DataFrame:
    """(term, total, days, first, growth, presence) from (term, day, n): growth of the rate from the first half to the second, smoothed by one half."""
    span = daily.agg(F.min("day").alias("low"), F.max("day").alias("high"), F.count_distinct("day").alias("covered"))
    rows = daily.join(F.broadcast(span))  # one row
    late = F.date_diff("day", "low") * 2 >= F.date_diff("high", "low")
    out = rows.groupBy("term").agg(F.sum("n").alias("total"), F.count_distinct("day").alias("days"), F.min("day").alias("first"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("late"), F.sum(F.when(late, 0).otherwise(F.col("n"))).alias("early"), F.max("covered").alias("covered"))
    return out.select("term", "total", "days", "first", F.round((F.col("late") + 0.5) / (F.col("early") + 0.5), 6).alias("growth"), F.round(F.col("days") / F.col("covered"), 6).alias("presence"))


def keyword_rise(seen: DataFrame, *, recent: int = 3, prior: int = 7, least: int = 3) -> DataFrame:
    """(term, recent_ops, prior_ops, rise) from (term, op, day): share of operators in the newest covered days over the days before.

    A day is covered if its operators are at least ``least`` and a fifth of the median day. The rise is null without
    ``recent`` + ``prior`` covered days; shares are smoothed by one operator.
    """
    daily = seen.groupBy("day").agg(F.count_distinct("op").alias("ops"))
    median = daily.agg((F.percentile("ops", F.lit(0.5)) * 0.2).alias("floor"))
    covered = daily.join(F.broadcast(median)).where(F.col("ops") >= F.greatest(F.lit(float(least)), "floor"))  # one row
    ranked = covered.select("day", F.row_number().over(Window.orderBy(F.desc("day"))).alias("age")).where(F.col("age") <= recent + prior)
    counted = ranked.withColumn("have", F.max("age").over(Window.partitionBy()))
    rows = seen.join(counted, "day").withColumn("now", F.col("age") <= recent)
    totals = rows.groupBy().agg(F.count_distinct(F.when(F.col("now"), F.col("op"))).alias("all_now"), F.count_distinct(F.when(~F.col("now"), F.col("op"))).alias("all_prior"), F.max("have").alias("have"))
    terms = rows.groupBy("term").agg(F.count_distinct(F.when(F.col("now"), F.col("op"))).alias("recent_ops"), F.count_distinct(F.when(~F.col("now"), F.col("op"))).alias("prior_ops"))
    rise = ((F.col("recent_ops") + 1) / (F.col("all_now") + 1)) / ((F.col("prior_ops") + 1) / (F.col("all_prior") + 1))
    return terms.join(F.broadcast(totals)).select("term", "recent_ops", "prior_ops", F.when(F.col("have") >= recent + prior, F.round(rise, 6)).alias("rise"))


def token_sources(events: DataFrame, start: Column, end: Column, token: str = "token") -> DataFrame:
    """(token, domains, sources, busiest): the different domains of a token's events in a range, the sources that tell of them, and the source with most domains (the first by name of equals)."""
    once = events.where(F.col("day").between(start, end)).select(token, "domain", "source").distinct()
    by_source = once.groupBy(token, "source").agg(F.count("*").alias("n")).groupBy(token).agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"), F.min(F.struct((-F.col("n")).alias("down"), "source"))["source"].alias("busiest"))
    return once.groupBy(token).agg(F.count_distinct("domain").alias("domains")).join(by_source, token)


def span_delta(old: DataFrame, new: DataFrame, key: str, *, rising: float = 1.5, fading: float = 0.6) -> DataFrame:
    """(key, old_n, new_n, ratio, trend): shares per thousand of two spans compared; one occurrence is added to either count."""
    a, b = old.groupBy(key).agg(F.count("*").alias("old_n")), new.groupBy(key).agg(F.count("*").alias("new_n"))
    totals = old.agg(F.count("*").alias("old_all")).join(new.agg(F.count("*").alias("new_all")))  # one row each
    rows = a.join(b, key, "full").fillna(0, ["old_n", "new_n"]).join(F.broadcast(totals))
    ratio = ((F.col("new_n") + 1) / F.col("new_all")) / ((F.col("old_n") + 1) / F.col("old_all"))
    trend = F.when(F.col("old_n") == 0, "new").when(ratio >= rising, "rising").when(ratio <= fading, "fading").otherwise("stable")
    return rows.select(key, "old_n", "new_n", F.round(ratio, 6).alias("ratio"), trend.alias("trend"))


def emergent_types(days: DataFrame, key: str, split: Column) -> DataFrame:
    """(key, base_rate, recent_rate, burst, active_days): rows a day before and after ``split``, and the share of the busiest day."""
    late = F.col("day") > split
    bounds = days.agg(F.count_distinct(F.when(late, F.col("day"))).alias("late_days"), F.count_distinct(F.when(~late, F.col("day"))).alias("early_days"))
    daily = days.groupBy(key, "day").agg(F.count("*").alias("n"))
    found = daily.groupBy(key).agg(F.sum(F.when(~late, F.col("n")).otherwise(0)).alias("early"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("late"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("active_days"))
    rated = found.join(F.broadcast(bounds))  # one row
    return rated.select(key, F.round(F.col("early") / F.greatest("early_days", F.lit(1)), 6).alias("base_rate"), F.round(F.col("late") / F.greatest("late_days", F.lit(1)), 6).alias("recent_rate"), F.round(F.col("most") / F.col("n"), 6).alias("burst"), "active_days")


def destination_cohorts(df: DataFrame, by: str, least: int = 10) -> DataFrame:
    """(day, by, n, expired, pending, large): names that reached a destination on a day, those that came from expiry, those not yet resolved, and whether they are a batch.

    Reads label, origin, pending; without the last two it only counts names.
    """
    return df.groupBy("day", by).agg(*_arrivals(df)).withColumn("large", F.col("n") >= least)


def _arrivals(df: DataFrame) -> list[Column]:
    if not {"origin", "pending"} <= {*df.columns}:
        return [F.count_distinct("label").alias("n")]
    expired, pending = F.when(F.col("origin") == "expiry", F.col("label")), F.when(F.col("pending"), F.col("label"))
    return [F.count_distinct("label").alias("n"), F.count_distinct(expired).alias("expired"), F.count_distinct(pending).alias("pending")]


def window_cohorts(df: DataFrame, by: str, start: Column, end: Column, least: int = 10) -> DataFrame:
    """(by, n, expired, pending, days, large): the destinations of the days from start to end, each name once, and on how many days names arrived."""
    inside = df.where(F.col("day").between(start, end))
    return inside.groupBy(by).agg(*_arrivals(df), F.count_distinct("day").alias("days")).withColumn("large", F.col("n") >= least)


def learned_platforms(daily: DataFrame, by: str, *, same_day: int = 10, trailing: int = 25) -> DataFrame:
    """(day, by, n, week): days on which a destination counts as a platform, by its own day or with the seven days before."""
    number = F.date_diff("day", F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy(by).orderBy("number").rangeBetween(-7, -1)
    rows = daily.withColumn("number", number).withColumn("week", F.col("n") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.where((F.col("n") >= same_day) | (F.col("week") >= trailing)).select("day", by, "n", "week")


def near_in_time(left: DataFrame, right: DataFrame, key: str, days: int) -> DataFrame:
    """Pairs of rows of one key whose days are at most ``days`` apart: left and right meet in buckets of that width."""
    bucket = F.floor(F.unix_date("day") / (days + 1))
    a = left.withColumn("bucket", bucket)
    b = right.withColumnRenamed("day", "right_day").withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.unix_date("right_day") / (days + 1)) + d)))
    return a.join(b, [key, "bucket"]).where(F.abs(F.date_diff("day", "right_day")) <= days).drop("bucket")


def buyer_stats(members: DataFrame, theme: str, buyer: str) -> DataFrame:
    """(theme, buyers, top_share, independence): independence is one less the sum of squared shares."""
    counts = members.groupBy(theme, buyer).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(theme))
    return counts.withColumn("share", share).groupBy(theme).agg(F.count("*").alias("buyers"), F.round(F.max("share"), 6).alias("top_share"), F.round(1 - F.sum(F.col("share") * F.col("share")), 6).alias("independence"))


def built_counts(members: DataFrame, theme: str, built: Column) -> DataFrame:
    """(theme, labels, built): a theme's different members and how many of them are built upon, by any of their rows."""
    each = members.groupBy(theme, "label").agg(F.max(F.coalesce(built, F.lit(False))).alias("built"))
    return each.groupBy(theme).agg(F.count("*").alias("labels"), F.count_if("built").alias("built"))

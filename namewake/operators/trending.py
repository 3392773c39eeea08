"""Terms and words that move across zones: momentum, groups that move together, the class of their signal, and a quality score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import saved


def gibberish(term: Column) -> Column:
    """Under three characters, one character three times in a row, or three letters and more without a vowel."""
    letters = F.regexp_replace(F.lower(term), "[^a-z]", "")
    return (F.length(term) < 3) | term.rlike(r"(.)\1\1") | ((F.length(letters) >= 3) & ~letters.rlike("[aeiou]"))


def group_of(zone: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    out = F.lit("other")
    for name, zones in groups.items():
        out = F.when(zone.isin(*zones), name).otherwise(out)
    return out


def trending_terms(
    history: DataFrame,
    segments: DataFrame,
    anchor: Column,
    *,
    groups: Mapping[str, Sequence[str]],
    curated: Sequence[str],
    zero_weight: Sequence[str] = (),
    lexicon: Sequence[str] = (),
    words: bool = False,
    window: int = 7,
    baseline: int = 28,
    least_sample: int = 3,
    bulk: int = 12,
    noise: bool = False,
) -> DataFrame:
    """A row for each term of ``history`` (keyword, day, zones) in the ``window`` days to ``anchor``; with ``words``, for each known piece of its ``segments`` (label, pieces).

    ``momentum`` compares occurrences a day with the ``baseline`` days before; a baseline of under ``least_sample`` gets one more (``low_confidence``). Zones without weight don't count.
    ``groups`` of zones: those hit, and ``co_moving``, the first (in order of zones) with two zones or more; a term with one is worth watching from a momentum of 1.5 and two occurrences.
    ``signal`` is noise for spread over ``bulk`` zones mostly outside ``curated`` groups, words of ``lexicon``, half digits, or digits in gibberish; mixed for 30 % digits or
    gibberish; else quality. ``quality_score`` is the spread (curated zones count three times) times the momentum times the share of known pieces, as a factor. Noise is left out unless asked for.
    """
    kept = history.select("keyword", "day", F.filter("zones", lambda z: ~z.isin(*zero_weight, "")).alias("zones")).where(F.size("zones") > 0)
    age = F.date_diff(anchor, "day")
    kept = kept.where(age.between(0, window + baseline - 1)).withColumn("inside", age < window)
    if words:
        pieces = segments.select(F.col("label").alias("keyword"), F.explode(F.array_distinct(F.filter("pieces", lambda p: p != "?"))).alias("term"))
        kept = kept.join(pieces, "keyword")
    else:
        kept = kept.withColumn("term", F.col("keyword"))
    kept = saved(kept)
    counts = kept.groupBy("term").agg(F.count_if("inside").alias("n"), F.count_if(~F.col("inside")).alias("base")).where("n > 0")
    spread = kept.where("inside").select("term", "keyword", F.explode("zones").alias("zone")).groupBy("term", "zone", "keyword").agg(F.count("*").alias("days"))
    by_zone = spread.groupBy("term", "zone").agg(F.sum("days").alias("days"), F.count("*").alias("sources")).groupBy("term")
    by_zone = by_zone.agg(F.sort_array(F.collect_list("zone")).alias("zones"), F.sum("sources").alias("source_domains"))  # as many as there are zones

    share = F.size(F.filter("pieces", lambda p: p != "?")) / F.size("pieces")
    known = segments.where(F.size("pieces") > 0).select(F.col("label").alias("term"), share.alias("known_share"))
    rows = counts.join(by_zone, "term")
    rows = rows.withColumn("known_share", F.lit(1.0)) if words else rows.join(known, "term", "left")

    guarded = F.when(F.col("base") < least_sample, F.col("base") + 1).otherwise(F.col("base"))
    named = F.transform("zones", lambda z: group_of(z, groups))
    rows = rows.withColumns({"momentum": F.round((F.col("n") / window) / (guarded / baseline), 2), "_groups": named})
    moving = F.filter(F.array_distinct("_groups"), lambda g: F.size(F.filter("_groups", lambda x: x == g)) >= 2)
    inside = F.filter("zones", lambda z: group_of(z, groups).isin(*curated))
    digits = F.length(F.regexp_replace("term", "[^0-9]", "")) / F.length("term")
    odd = gibberish(F.col("term"))
    listed = F.lit(False)
    for word in lexicon:
        listed = listed | F.contains(F.lower("term"), F.lit(word))
    blast = (F.size("zones") >= bulk) & (F.size("zones") - F.size(inside) > F.size("zones") / 2)
    signal = F.when(blast | listed | (digits >= 0.5) | (odd & (digits > 0)), "noise").when((digits >= 0.3) | odd, "mixed").otherwise("quality")
    factor = F.when(F.col("known_share").isNull(), 0.4).when(F.col("known_share") == 1, 1.5).when(F.col("known_share") >= 0.5, 1.1).when(~odd, 0.9).otherwise(0.4)
    weight = F.size("zones") + 2 * F.size(inside)
    found = rows.select(
        "term",
        F.col("n").alias("window_n"),
        F.col("base").alias("baseline_n"),
        (F.col("base") < least_sample).alias("low_confidence"),
        "momentum",
        F.size("zones").alias("spread"),
        F.array_join("zones", ",").alias("zones"),
        F.array_join(F.array_sort(F.array_distinct("_groups")), ",").alias("groups"),
        F.try_element_at(moving, F.lit(1)).alias("co_moving"),
        "source_domains",
        signal.alias("signal"),
        F.round(weight * F.greatest(F.lit(0.1), "momentum") * factor, 3).alias("quality_score"),
    )
    found = found.withColumn("worth_watching", F.col("co_moving").isNotNull() & (F.col("momentum") >= 1.5) & (F.col("window_n") >= 2))
    return found if noise else found.where("signal <> 'noise'")

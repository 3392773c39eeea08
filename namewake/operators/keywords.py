"""Keywords of a span of days in full: who uses them where and how, whether their share rises, what stage they are in, and the lists that rank them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import saved


def rise_windows(uses: DataFrame, *, recent: int = 3, prior: int = 7, least: int = 3, fraction: float = 0.2) -> DataFrame:
    """(day, part): the newest ``recent`` covered days (0) and the ``prior`` ones before them (1) of ``uses`` (op, day).

    A day is covered with ``least`` operators or more and ``fraction`` (rounded up) of the median day, the lower one of two. A row for each day is ranked.
    """
    daily = uses.groupBy("day").agg(F.count_distinct("op").alias("ops"))
    middle = F.element_at(F.sort_array(F.collect_list("ops")), F.floor((F.count("*") + 1) / 2).cast("int"))
    floor = daily.agg(F.greatest(F.lit(least), F.ceil(middle * fraction)).alias("floor"))
    covered = daily.join(F.broadcast(floor), F.col("ops") >= F.col("floor"))  # one row
    placed = covered.withColumn("age", F.row_number().over(Window.orderBy(F.desc("day"))))
    return placed.where(F.col("age") <= recent + prior).select("day", F.when(F.col("age") <= recent, 0).otherwise(1).alias("part"))


def _listed(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy("term").agg(F.count_distinct(key).alias(name))


def keyword_profiles(
    uses: DataFrame,
    registrations: DataFrame,
    anchor: Column,
    *,
    span: int = 14,
    window: int = 7,
    least_sites: int = 2,
    least_recent: int = 4,
    least_window: int = 10,
    least_covered: tuple[int, int] = (2, 3),
    registration_rise: int = 6,
    language_operators: int = 2,
    languages: int = 2,
    boost: float = 0.25,
    most_boost: float = 1.75,
) -> DataFrame:
    """A row for each term of ``uses`` (term, site, op, day, zone, role, partner, described, lang) in the ``span`` days to ``anchor`` that ``least_sites`` sites use.

    Operators of the ``window``, the last and the first seven days and the span; days on which it is used; zones, roles, partners, and operators that describe themselves. ``rise`` compares the share of the operators of the recent covered
    days with that of the ones before (plus one each), null without enough days, operators in all, or ``least_recent`` of the term; ``rise_raw`` has no such floor for the term. ``share_falling``: operators for each registration (``registrations``: term, day, n; days
    it does not hold are unknown) fell below 70 %. ``speculative``: registrations rise while operators do not; ``organic``: operators rise. ``is_global`` terms, in Latin letters, have ``language_operators`` and a recent one in ``languages`` languages, and get a ``boost`` for each beyond the first.
    Stages: confirmed (both weeks, 8 operators, 2 zones, 5 described), forming (3 operators on 3 days, several roles, partners or zones), else watch; a falling share bars both.
    """
    age = F.date_diff(anchor, "day")
    rows = uses.where(age.between(0, span - 1)).withColumn("age", age)
    known = rows.groupBy("term").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= least_sites)
    parts = saved(rise_windows(rows))
    rows = saved(rows.join(known.select("term"), "term").join(F.broadcast(parts), "day", "left"))  # a row for each day

    every = uses.where(age.between(0, span - 1)).join(F.broadcast(parts), "day").groupBy("op").agg(F.max((F.col("part") == 0).cast("int")).alias("r"), F.max((F.col("part") == 1).cast("int")).alias("p"))
    totals = every.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("all_recent"), F.coalesce(F.sum("p"), F.lit(0)).alias("all_prior"))
    days = parts.agg(F.count_if(F.col("part") == 0).alias("n_recent"), F.count_if(F.col("part") == 1).alias("n_prior"))

    flag = lambda test: F.max(F.coalesce(test, F.lit(False)).cast("int"))
    by_op = rows.groupBy("term", "op").agg(
        flag(F.col("age") < window).alias("in_window"), flag(F.col("age") < 7).alias("last7"), flag(F.col("age") >= 7).alias("first7"), flag(F.col("part") == 0).alias("recent"), flag(F.col("part") == 1).alias("prior"), flag(F.col("described")).alias("told")
    )
    ops = by_op.groupBy("term").agg(F.sum("in_window").alias("operators"), F.sum("last7").alias("ops_last"), F.sum("first7").alias("ops_first"), F.count("*").alias("ops_span"), F.sum("recent").alias("recent"), F.sum("prior").alias("prior"), F.sum("told").alias("described"))
    series = rows.groupBy("term", "day", "age", "part").agg(F.count_distinct("op").alias("n"))
    active = series.groupBy("term").agg(
        F.count_if(F.col("age") < window).alias("days_active"), F.count_if(F.col("age") < 7).alias("days_last"), F.count_if(F.col("age") >= 7).alias("days_first"), F.coalesce(F.sum(F.when(F.col("part") == 0, F.col("n"))), F.lit(0)).alias("built_recent")
    )

    told_days = registrations.groupBy("day").agg(F.lit(1).alias("told")).join(parts, "day")
    told = told_days.agg(F.count_if(F.col("part") == 0).alias("reg_days"), F.count_if(F.col("part") == 1).alias("reg_prior_days"))
    inside = lambda p, c: F.coalesce(F.sum(F.when(F.col("part") == p, F.col(c))), F.lit(0))
    regs = registrations.join(F.broadcast(parts), "day").groupBy("term").agg(inside(0, "n").alias("r3"), inside(1, "n").alias("r7"))
    prior_built = series.join(F.broadcast(told_days.select("day")), "day", "left_semi").groupBy("term").agg(inside(0, "n").alias("b3"), inside(1, "n").alias("b7"))

    tongues = rows.where(F.col("lang").isNotNull() & (F.col("age") < window)).groupBy("term", "lang", "op").agg(flag(F.col("part") == 0).alias("recent")).groupBy("term", "lang").agg(F.count("*").alias("n"), F.sum("recent").alias("recent"))
    strong = tongues.groupBy("term").agg(
        F.count_if((F.col("n") >= language_operators) & (F.col("recent") >= 1)).alias("strong"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("down"), "lang", "n"))), lambda x: F.concat_ws(":", x["lang"], x["n"].cast("string"))), ",").alias("languages"),
    )

    found = ops.join(active, "term")
    for key, name in (("zone", "zones"), ("role", "roles"), ("partner", "partners")):
        found = found.join(_listed(rows, key, name), "term", "left")
    found = found.join(regs, "term", "left").join(prior_built, "term", "left").join(strong, "term", "left").fillna(0, ["zones", "roles", "partners", "r3", "r7", "b3", "b7", "strong"]).fillna("", ["languages"])
    found = found.join(F.broadcast(totals)).join(F.broadcast(days)).join(F.broadcast(told))  # one row each
    enough = (F.col("n_recent") >= least_covered[0]) & (F.col("n_prior") >= least_covered[1]) & (F.col("all_recent") >= least_window) & (F.col("all_prior") >= least_window)
    raw = F.when(enough, F.floor((F.col("recent") / F.col("all_recent")) / ((F.col("prior") + 1) / (F.col("all_prior") + 1)) * 100 + 0.5) / 100)
    compared = (F.col("reg_days") > 0) & (F.col("reg_prior_days") > 0)
    share = F.col("b7") / (F.col("r7") + 1)
    falling = compared & (F.col("r3") + F.col("r7") > 0) & (share > 0) & (F.col("b3") / (F.col("r3") + 1) < 0.7 * share)
    out = found.withColumns({"rise_raw": raw, "share_falling": falling})
    regs_rise = compared & (F.col("r3") >= registration_rise) & (F.col("r3") / F.greatest("reg_days", F.lit(1)) >= 1.5 * ((F.col("r7") + 1) / F.greatest("reg_prior_days", F.lit(1))))
    wide = (F.col("strong") >= languages) & F.col("term").rlike(r"^[\p{IsLatin}\p{N} ]+$")
    out = out.withColumns(
        {
            "rise": F.when(F.col("recent") >= least_recent, F.col("rise_raw")),
            "speculative": regs_rise & F.coalesce(F.col("rise_raw") <= 1.1, F.lit(False)),
            "organic": (F.col("built_recent") >= 3) & F.coalesce(F.col("rise_raw") > 1.2, F.lit(False)),
            "is_global": wide,
            "boost": F.when(wide, F.least(F.lit(most_boost), 1 + boost * (F.col("strong") - 1))).otherwise(1.0),
        }
    )
    sinking = F.col("share_falling") | F.coalesce(F.col("rise_raw") < 0.7, F.lit(False))
    steady = (F.least("ops_first", "ops_last") >= 2) & (F.least("days_first", "days_last") >= 2) & (F.col("ops_span") >= 8) & (F.col("zones") >= 2) & (F.col("described") >= 5)
    widening = (F.col("ops_last") >= 3) & (F.col("days_last") >= 3) & ((F.col("roles") >= 2) | (F.col("partners") >= 3) | (F.col("zones") >= 2)) & F.coalesce(F.col("rise_raw") >= 1, F.lit(True))
    out = out.withColumn("stage", F.when(steady & ~sinking, "confirmed").when(widening & ~sinking, "forming").otherwise("watch"))
    return out.where(F.col("operators") >= 1).drop("r3", "r7", "b3", "b7", "strong", "all_recent", "all_prior", "n_recent", "n_prior", "reg_days", "reg_prior_days", "built_recent")


def ranked_keywords(profiles: DataFrame, limit: int, *, window: int = 7, least_rise: float = 1.5, novelty: DataFrame | None = None) -> DataFrame:
    """(list, place, term, score): the ``limit`` terms of most operators (``biggest``, then days, then term), of rising share (``trending``, from ``least_rise``: the rise times the log of operators, the share of active
    days and the boost), and with ``novelty`` (term, score) the ``emerging`` ones: two operators, a positive score, no digit in front, and none of the biggest that is common."""
    picked = lambda rows, name, order: rows.orderBy(*order).limit(limit).select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*order)).alias("place"), "term", "score")
    most = [F.desc("operators"), F.desc("days_active"), F.col("term")]
    biggest = picked(profiles.withColumn("score", F.col("operators").cast("double")), "biggest", most)
    score = F.round(F.col("rise") * F.log2(1 + F.col("operators")) * (F.col("days_active") / window) * F.col("boost"), 4)
    out = biggest.union(picked(profiles.where(F.col("rise") >= least_rise).withColumn("score", score), "trending", [F.desc("score"), F.col("term")]))
    if novelty is None:
        return out
    top = profiles.orderBy(*most).limit(max(25, limit)).select("term")
    common = novelty.where("common").select("term").join(top, "term")
    fresh = profiles.where((F.col("operators") >= 2) & ~F.col("term").rlike("^[0-9]")).join(common, "term", "left_anti").join(novelty.where("score > 0").select("term", "score"), "term")
    return out.union(picked(fresh, "emerging", [F.desc("score"), F.desc("operators"), F.col("term")]))

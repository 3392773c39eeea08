"""What the new names of a span are made of: themes that many independent labels converge on, and types of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import saved


def windows(text: Column, size: int, without: str) -> Column:
    """The different runs of ``size`` letters of a text (the text itself, if shorter) that hold none of the characters of the class ``without``."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.array_distinct(F.filter(every, lambda w: (w != "") & ~F.rlike(w, F.lit(f"[{without}]"))))


def usable_labels(adds: DataFrame, junk: str | None = None) -> DataFrame:
    """(label, zone), once each: plain labels of 4 to 40 characters without the ``junk`` pattern."""
    rows = adds.where(F.col("label").rlike("^(?!xn--)[a-z0-9-]{4,40}$"))
    return (rows.where(~F.col("label").rlike(junk)) if junk else rows).select("label", "zone").distinct()


def known_words(labels: DataFrame, segments: DataFrame, least: int = 2) -> DataFrame:
    """(label, w): the known pieces of labels that have ``least`` or more of them, over three quarters of their letters."""
    rows = labels.select("label").distinct().join(segments, "label").select("label", F.filter("pieces", lambda p: p != "?").alias("w"))
    covered = F.aggregate("w", F.lit(0), lambda n, p: n + F.length(p)) >= 0.75 * F.length(F.replace("label", F.lit("-"), F.lit("")))
    return rows.where(covered & (F.size("w") >= least))


def theme_members(words: DataFrame, *, generic: Sequence[str], cities: Sequence[str], short: Sequence[str] = (), fragments: Sequence[str] = ()) -> DataFrame:
    """(theme, label, shape, others): the words of (label, w) that can be a theme, each once a label, with the shape of their use and the first two other words."""
    at = words.select("label", "w", F.posexplode("w").alias("i", "theme")).groupBy("label", "w", "theme").agg(F.min("i").alias("i"))
    fine = ((F.length("theme") >= 4) | F.col("theme").isin(*short, "")) & ~F.col("theme").isin(*generic, *cities, *fragments, "") & ~F.col("theme").rlike("^[0-9]+$")
    others = F.filter("w", lambda _, j: j != F.col("i"))
    place = F.when(F.col("i") == 0, "prefix").when(F.col("i") == F.size("w") - 1, "suffix").otherwise("mid")
    plain = F.forall(others, lambda x: x.isin(*generic, ""))
    shape = F.concat(place, F.lit(":"), F.size("w").cast("string"), F.when(plain, "w:gen").otherwise("w:spec"))
    return at.where(fine).select("theme", "label", shape.alias("shape"), F.filter(F.slice(others, 1, 2), lambda x: ~x.isin(*generic, *cities, "")).alias("others"))


def kit_members(members: DataFrame, counts: DataFrame, *, size: int = 8, least: int = 12, share: float = 0.2, most: int = 4) -> DataFrame:
    """(theme, label, swept): whether a member holds one of the ``most`` commonest runs of ``size`` letters besides its theme, if these are in ``least``
    members and in ``share`` of them: one actor's sweep of modifiers."""
    runs = members.select("theme", "label", F.explode(windows(F.col("label"), size, "-")).alias("run")).where((F.col("run") != F.col("theme")) & ~((F.length("theme") >= size) & F.contains("theme", "run")))
    common = runs.groupBy("theme", "run").agg(F.count("*").alias("n")).join(counts, "theme").where((F.col("n") >= least) & (F.col("n") >= share * F.col("labels")))
    order = Window.partitionBy("theme").orderBy(F.desc("n"), "run")  # at most a few runs are in so many members
    first = common.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).groupBy("theme").agg(F.collect_list("run").alias("runs"))
    swept = F.coalesce(F.exists("runs", lambda r: F.contains("label", r)), F.lit(False))
    return members.select("theme", "label").join(first, "theme", "left").select("theme", "label", swept.alias("swept"))


def converging_themes(
    adds: DataFrame,
    reference: DataFrame,
    segments: DataFrame,
    *,
    generic: Sequence[str],
    cities: Sequence[str],
    product_zones: Sequence[str],
    junk: str | None = None,
    excluded: DataFrame | None = None,
    short: Sequence[str] = (),
    fragments: Sequence[str] = (),
    least: int = 12,
    least_members: int = 12,
    least_words: int = 2,
    rising_roots: int = 10,
    new_roots: int = 8,
) -> DataFrame:
    """A row for each word that ``least`` labels of ``adds`` (label, zone) carry: how independent its uses are, and how its share moved against ``reference``.

    ``roots`` are the runs of seven letters beside the word (those on up to three labels count as independent), ``constructions`` its places among the words of a label,
    ``co_tokens`` the words beside it. Labels swept by one actor are taken out (``kit_share``), and those of ``excluded`` (label, families of one
    brand) before anything is counted. ``convergence`` is the product of the logs of the breadths, less for a dominant root or companion, a kit, zones that aren't
    ``product_zones`` and city grids. ``buckets`` names all that hold: rising, new, stable, fading; empty for none.
    """
    options = {"generic": generic, "cities": cities, "short": short, "fragments": fragments}
    now, before = usable_labels(adds, junk), usable_labels(reference, junk)
    if excluded is not None:
        now, before = (rows.join(excluded.select("label").distinct(), "label", "left_anti") for rows in (now, before))
    members = saved(theme_members(known_words(now, segments, least_words), **options))
    counts = members.groupBy("theme").agg(F.count("*").alias("labels")).where(F.col("labels") >= least)
    members = saved(members.join(counts.select("theme"), "theme"))  # many counts follow

    masked = F.replace("label", F.col("theme"), F.lit("|"))
    runs = windows(masked, 7, "|-")
    roots = members.select("theme", F.explode(F.when(F.size(runs) > 0, runs).otherwise(F.array("label"))).alias("root")).groupBy("theme", "root").agg(F.count("*").alias("n"))
    roots = roots.groupBy("theme").agg(F.count_if(F.col("n") <= 3).alias("independent_roots"), F.max("n").alias("top_root"))
    shapes = members.groupBy("theme").agg(F.count_distinct("shape").alias("constructions"))
    beside = members.select("theme", F.explode("others").alias("other")).groupBy("theme", "other").agg(F.count("*").alias("n")).groupBy("theme").agg(F.count("*").alias("co_tokens"), F.max("n").alias("top_other"))
    zones = members.select("theme", "label").join(now, "label").groupBy("theme", "zone").agg(F.count("*").alias("n"))
    zones = zones.groupBy("theme").agg(F.count("*").alias("zones"), (F.sum(F.when(F.col("zone").isin(*product_zones), F.col("n")).otherwise(0)) / F.sum("n")).alias("product_share"))
    grid = F.lit(False)
    for city in cities:
        grid = grid | F.contains("label", F.lit(city)) if len(city) >= 6 else grid
    kept = kit_members(members, counts).groupBy("theme").agg(F.count_if("swept").alias("swept"), F.count_if(~F.col("swept")).alias("kept"), F.count_if(~F.col("swept") & grid).alias("grid"))
    style = F.when(F.contains("label", F.lit("-")), "hyphen").when(F.col("label").rlike("[0-9]"), "digit").otherwise("plain")
    styles = members.groupBy("theme").agg(F.count_distinct(style).alias("styles"))
    past = theme_members(known_words(before, segments, least_words), **options).groupBy("theme").agg(F.count("*").alias("was"))
    sizes = now.agg(F.count_distinct("label").alias("all_now")).join(before.agg(F.count_distinct("label").alias("all_before")))  # one row each

    rows = counts.join(roots, "theme").join(shapes, "theme").join(zones, "theme").join(styles, "theme").join(kept.where(F.col("kept") >= least_members), "theme")
    rows = rows.join(beside, "theme", "left").join(past, "theme", "left").fillna(0, ["co_tokens", "top_other", "was"]).join(F.broadcast(sizes))
    rows = rows.withColumns(
        {
            "share": 1000 * F.col("labels") / F.col("all_now"),
            "ref_share": 1000 * F.col("was") / F.greatest("all_before", F.lit(1)),
            "kit_share": F.col("swept") / F.col("labels"),
            "top_root_share": F.col("top_root") / F.col("labels"),
            "co_share": F.col("top_other") / F.col("labels"),
            "grid_share": F.col("grid") / F.greatest("kept", F.lit(1)),
        }
    ).withColumn("rise", (F.col("share") + 0.02) / (F.col("ref_share") + 0.02))
    breadth = F.log1p("independent_roots") * F.log1p("constructions") * F.log1p(F.least("co_tokens", F.lit(60))) * F.log1p("zones")
    penalties = (1 - F.col("top_root_share")) * (1 - F.least(F.lit(0.9), "co_share")) * (1 - F.col("kit_share")) * F.when(F.col("product_share") < 0.5, 0.3).otherwise(1.0) * F.when(F.col("grid_share") > 0.5, 0.5).otherwise(1.0)
    enough = F.col("independent_roots")
    buckets = F.concat_ws(
        ",",
        F.when((F.col("rise") >= 1.3) & (enough >= rising_roots), "rising"),
        F.when((F.col("ref_share") < 0.01) & (enough >= new_roots), "new"),
        F.when(F.col("rise").between(0.8, 1.3) & (F.col("rise") < 1.3), "stable"),
        F.when((F.col("rise") <= 0.6) & (F.col("ref_share") >= 0.1), "fading"),
    )
    shares = ["share", "ref_share", "rise", "kit_share", "top_root_share", "co_share", "grid_share", "product_share"]
    whole = ["labels", "independent_roots", "constructions", "co_tokens", "zones", "styles"]
    return rows.select("theme", *whole, *[F.round(c, 6).alias(c) for c in shares], F.round(breadth * penalties, 6).alias("convergence"), buckets.alias("buckets"))


def name_kinds(words: DataFrame, *, stop: Sequence[str], cities: Sequence[str]) -> DataFrame:
    """(label, kind): suffix, prefix and word-pair kinds of (label, w), and grids: a frame whose first or last word is a place."""
    fine = lambda w, n: ~w.isin(*stop, "") & (F.length(w) >= n)
    first, final, size = F.element_at("w", 1), F.element_at("w", -1), F.size("w")
    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.when(fine(F.element_at("w", i), 3) & fine(F.element_at("w", i + 1), 3), F.concat(F.lit("theme:"), F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1))))
    ends = F.array(
        F.when(fine(final, 2), F.concat(F.lit("suffix:*"), final)),
        F.when(fine(first, 2), F.concat(F.lit("prefix:"), first, F.lit("*"))),
        F.when(first.isin(*cities, ""), F.concat(F.lit("grid:{city}+"), F.array_join(F.slice("w", F.lit(2), size - 1), ""))),
        F.when(final.isin(*cities, ""), F.concat(F.lit("grid:"), F.array_join(F.slice("w", F.lit(1), size - 1), ""), F.lit("+{city}"))),
    )
    return words.where(size >= 2).select("label", F.explode(F.array_distinct(F.array_compact(F.concat(ends, pairs)))).alias("kind"))


def ranked_types(adds: DataFrame, reference: DataFrame, segments: DataFrame, *, stop: Sequence[str] = (), cities: Sequence[str] = (), product_zones: Sequence[str], junk: str | None = None, least: int = 8) -> DataFrame:
    """A row for each kind that ``least`` labels of ``adds`` (label, zone) have: its share per 1000 labels against ``reference``, its zones, and a score.

    ``concentration`` is the share of labels with the commonest run of seven letters beside the kind's own words, ``dominant``: one actor's root. A kind is
    ``junk`` if under 35 % of its names are in ``product_zones``, if it repeats a letter three times or holds the pattern. The score is the log of the count times the acceleration
    (at most 8), more for pairs and grids, less for one actor, junk, hyphens and digits. Labels in three or more zones are counted as ``kits``.
    """
    now, before = usable_labels(adds), usable_labels(reference)
    options = {"stop": stop, "cities": cities}
    each = saved(name_kinds(known_words(now, segments), **options))
    counts = each.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.contains("label", F.lit("-"))).alias("hyphens"), F.count_if(F.col("label").rlike("[0-9]")).alias("digits")).where(F.col("n") >= least)
    each = saved(each.join(counts.select("kind"), "kind"))
    past = name_kinds(known_words(before, segments), **options).groupBy("kind").agg(F.count("*").alias("was"))

    spread = now.groupBy("label").agg(F.count("*").alias("in_zones"))
    kits = each.join(spread, "label").groupBy("kind").agg(F.count_if(F.col("in_zones") >= 3).alias("kits"))
    zones = each.join(now, "label").groupBy("kind", "zone").agg(F.count("*").alias("n")).groupBy("kind")
    zones = zones.agg(F.count("*").alias("zones"), (F.sum(F.when(F.col("zone").isin(*product_zones), F.col("n")).otherwise(0)) / F.sum("n")).alias("product_share"))
    token = F.regexp_replace("kind", "^[a-z]+:", "")
    own = F.regexp_extract_all(F.replace(token, F.lit("{city}"), F.lit("")), F.lit("([a-z0-9]+)"), 1)
    masked = F.aggregate(own, F.col("label"), lambda m, x: F.replace(m, x, F.lit("|")))
    roots = each.select("kind", masked.alias("masked")).select("kind", F.explode(windows(F.col("masked"), 7, "|-")).alias("root")).groupBy("kind", "root").agg(F.count("*").alias("n"))
    roots = roots.groupBy("kind").agg(F.min(F.struct((-F.col("n")).alias("down"), "root")).alias("top")).select("kind", (-F.col("top.down")).alias("top_n"), F.col("top.root").alias("dominant"))
    sizes = now.agg(F.count_distinct("label").alias("all_now")).join(before.agg(F.count_distinct("label").alias("all_before")))  # one row each

    rows = counts.join(kits, "kind").join(zones, "kind").join(roots, "kind", "left").join(past, "kind", "left").fillna(0, ["was", "top_n"]).fillna("", ["dominant"]).join(F.broadcast(sizes))
    rows = rows.withColumns({"share": 1000 * F.col("n") / F.col("all_now"), "ref_share": 1000 * F.col("was") / F.greatest("all_before", F.lit(1)), "concentration": F.col("top_n") / F.col("n")})
    bad = token.rlike(r"(.)\1\1") | (F.col("product_share") < 0.35)
    rows = rows.withColumns({"acceleration": (F.col("share") + 0.05) / (F.col("ref_share") + 0.05), "junk": bad | token.rlike(junk) if junk else bad})
    score = F.when(F.col("kind").rlike("^(theme|grid):"), 1.6).otherwise(1.0) * F.log1p("n") * F.least("acceleration", F.lit(8.0)) * (1 - F.col("concentration"))
    score = score * F.when(F.col("concentration") > 0.5, 0.25).otherwise(1.0) * F.when(F.col("junk"), 0.15).otherwise(1.0) * (1 - 0.6 * F.col("hyphens") / F.col("n")) * (1 - 0.6 * F.col("digits") / F.col("n"))
    shares = ["share", "ref_share", "acceleration", "product_share", "concentration"]
    return rows.select("kind", "n", *[F.round(c, 6).alias(c) for c in shares], "zones", "kits", "dominant", "junk", F.round(score, 6).alias("score"))

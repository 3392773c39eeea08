"""Themes and keywords: segmentation by least cost, naming patterns, convergence, metrics, lists and clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_adds(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The adds tape (label, zone, window start; tab-separated, a folder for each day) of a span; malformed labels are left out."""
    rows = spark.read.option("sep", "\t").schema("label string, zone string, window_start date, day date").csv(path)
    return rows.where(F.col("day").between(first, last) & F.col("label").rlike(r"^(?!xn--)[a-z0-9-]{1,63}$"))


def scan_inventory(df: DataFrame, fields: Sequence[str], zones: Sequence[str] = ()) -> DataFrame:
    """Chosen fields of a snapshot, of some zones: columns and filter reach the scan."""
    return (df.where(F.col("zone").isin(*zones)) if zones else df).select(*fields)


def segment_mincost(labels: DataFrame, words: DataFrame, *, short: int = 4, penalty: int = 1) -> DataFrame:
    """(label, pieces, cost): the split of a whole label into dictionary words with the least cost; labels that have none are left out.

    A word costs 2, one of under ``short`` letters ``penalty`` more. Of equal costs the split with the longer last words, from the end, stays.
    """
    distinct = labels.select("label").distinct().where("label <> ''")
    spans = distinct.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("at"))
    spans = spans.select("label", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(18), F.length("label") - F.col("at") + 1))).alias("size"))
    hits = spans.withColumn("entry", F.expr("substr(label, at, size)")).join(words.select("entry").distinct(), "entry")
    stop = (F.col("at") + F.col("size") - 1).alias("stop")
    ends = hits.groupBy("label", stop).agg(F.sort_array(F.collect_list("size")).alias("sizes"))
    table = ends.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("stop", "sizes"))).alias("ends"))
    rows = distinct.join(table, "label")
    none, start = F.lit(1_000_000), F.array(F.struct(F.lit(0).alias("cost"), F.lit(0).alias("size")))

    def step(best: Column, i: Column) -> Column:
        ways = F.transform(F.coalesce(F.try_element_at("ends", i), F.array().cast("array<int>")), lambda n: F.struct((F.element_at(best, i - n + 1)["cost"] + 2 + F.when(n < short, penalty).otherwise(0)).alias("cost"), (-n).alias("size")))
        least = F.array_min(ways)
        return F.concat(best, F.array(F.struct(F.coalesce(least["cost"], none).cast("int").alias("cost"), F.coalesce(-least["size"], F.lit(0)).cast("int").alias("size"))))

    solved = rows.withColumn("best", F.aggregate(F.sequence(F.lit(1), F.length("label")), start.cast("array<struct<cost:int,size:int>>"), step))
    state = F.struct(F.length("label").alias("stop"), F.array().cast("array<string>").alias("pieces"))

    def back(acc: Column, _: Column) -> Column:
        size = F.element_at("best", acc["stop"] + 1)["size"]
        piece = F.substring("label", acc["stop"] - size + 1, size)
        return F.when(acc["stop"] > 0, F.struct((acc["stop"] - size).alias("stop"), F.concat(F.array(piece), acc["pieces"]).alias("pieces"))).otherwise(acc)

    good = solved.withColumn("cost", F.element_at("best", -1)["cost"]).where(F.col("cost") < none)
    return good.select("label", F.aggregate(F.sequence(F.lit(1), F.length("label")), state, back)["pieces"].alias("pieces"), "cost")


def name_words(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, n_words, tail, invented): one to three words and a tail of digits; anything else is invented."""
    rows = labels.select("label").distinct().withColumns({"tail": F.regexp_extract("label", "([0-9]*)$", 1), "stem": F.regexp_replace(F.regexp_replace("label", "[0-9]*$", ""), "-", "")})
    cut = segment_mincost(rows.select(F.col("stem").alias("label")), words).select(F.col("label").alias("stem"), F.size("pieces").alias("n_words"))
    known = rows.join(cut.where("n_words <= 3"), "stem", "left")
    return known.select("label", F.coalesce("n_words", F.lit(0)).alias("n_words"), "tail", F.col("n_words").isNull().alias("invented"))


def coined_terms(segments: DataFrame) -> DataFrame:
    """(label, term): what stands at the unknown pieces of a label, alone and joined to the known word before it."""
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("last"), F.array().cast("array<string>").alias("terms"))

    def step(acc: Column, i: Column) -> Column:
        piece = F.element_at("pieces", i)
        nxt = F.try_element_at("pieces", i + 1)
        rest = F.substring("label", acc["at"], F.length("label"))
        found = F.when(nxt.isNull() | (nxt == "?"), F.regexp_extract(rest, "^([^-]+)", 1)).otherwise(F.substring(rest, F.lit(1), F.greatest(F.instr(rest, nxt) - 1, F.lit(0))))
        joined = F.when(acc["last"] != "", F.concat(acc["terms"], F.array(found, F.concat(acc["last"], found)))).otherwise(F.concat(acc["terms"], F.array(found)))
        unknown = F.struct((acc["at"] + F.length(found)).alias("at"), F.lit("").alias("last"), joined.alias("terms"))
        return F.when(piece == "?", unknown).otherwise(F.struct((acc["at"] + F.length(piece)).alias("at"), piece.alias("last"), acc["terms"].alias("terms")))

    terms = F.aggregate(F.sequence(F.lit(1), F.size("pieces")), state, step)["terms"]
    return segments.where("size(pieces) > 0").select("label", F.explode(F.array_distinct(terms)).alias("term")).where(F.length("term") >= 2)


def daily_signals(daily: DataFrame, contexts: DataFrame, day: Column, *, window: int = 7, active: int = 4, rise: float = 1.5, least_contexts: int = 3) -> DataFrame:
    """(token, n, mean, sd, contexts, reason): tokens of a day against the window before, and why they are rejected, or ``signal``."""
    age = F.date_diff(day, "day")
    rows = daily.groupBy("token").agg(
        F.coalesce(F.sum(F.when(age == 0, F.col("n"))), F.lit(0)).alias("n"),
        F.sum(F.when(age.between(1, window), F.col("n")).otherwise(0)).alias("total"),
        F.sum(F.when(age.between(1, window), F.col("n") * F.col("n")).otherwise(0)).alias("squares"),
        F.count_if(age.between(0, window)).alias("days"),
    )
    mean = F.col("total") / window
    spread = F.sqrt(F.greatest((F.col("squares") - window * mean * mean) / (window - 1), F.lit(0.0)))
    rows = rows.where("n > 0").withColumns({"mean": mean, "sd": spread}).join(contexts, "token", "left").fillna(0, ["contexts"])
    reason = F.when(F.col("days") < active, "inactive").when(F.col("n") < rise * F.col("mean"), "flat").when(F.col("n") < F.col("mean") + 2 * F.col("sd"), "within-noise").when(F.col("contexts") < least_contexts, "one-context").otherwise("signal")
    return rows.select("token", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "contexts", reason.alias("reason"))


def pattern_evidence(names: DataFrame, token: str, day: Column, *, window: int = 10) -> DataFrame:
    """One row of evidence for a token: weighted labels today and in the window, active days, suffixes, numeric share and the gate's verdict."""
    rows = names.where(F.contains("label", F.lit(token)) & F.date_diff(day, "day").between(0, window - 1))
    weight = F.when(F.col("zone").isin("xyz", "shop", "info"), 0).otherwise(1)
    labels = rows.groupBy("label").agg(F.max(weight).alias("w"), F.max(F.when(F.col("day") == day, weight).otherwise(0)).alias("today"), F.max(F.col("label").rlike("[0-9]").cast("int")).alias("numeric"))
    one = labels.agg(F.coalesce(F.sum("today"), F.lit(0)).alias("today"), F.coalesce(F.sum("w"), F.lit(0)).alias("in_window"), F.coalesce(F.round(F.avg("numeric"), 6), F.lit(0.0)).alias("numeric_share"))
    other = rows.agg(F.count_distinct("day").alias("active_days"), F.count_distinct(F.split_part("label", F.lit(token), F.lit(-1))).alias("suffixes"))
    gate = (F.col("today") >= 3) & (F.col("in_window") >= 10) & (F.col("active_days") >= 3) & (F.col("numeric_share") <= 0.5)
    return one.join(F.broadcast(other)).withColumn("review", gate)  # one row each


def theme_convergence(recent: DataFrame, base: DataFrame, theme: str, *, least: int = 5) -> DataFrame:
    """(theme, labels, roots, zones, score, bucket): independent use of a theme and how its share moved against the base span.

    The score is the product of the logs of labels, roots and zones; buckets: new, rising from 1.3, fading to 0.6, else stable.
    """
    stats = recent.groupBy(theme).agg(F.count_distinct("label").alias("labels"), F.count_distinct("root").alias("roots"), F.count_distinct("zone").alias("zones"), F.count("*").alias("n")).where(F.col("labels") >= least)
    before = base.groupBy(theme).agg(F.count("*").alias("was"))
    totals = recent.agg(F.count("*").alias("all")).join(base.agg(F.count("*").alias("all_before")))  # one row each
    rows = stats.join(before, theme, "left").fillna(0, ["was"]).join(F.broadcast(totals))
    ratio = (F.col("n") / F.col("all")) / (F.col("was") / F.col("all_before"))
    bucket = F.when(F.col("was") == 0, "new").when(ratio >= 1.3, "rising").when(ratio <= 0.6, "fading").otherwise("stable")
    score = F.log2(F.col("labels") + 1) * F.log2(F.col("roots") + 1) * F.log2(F.col("zones") + 1)
    return rows.select(theme, "labels", "roots", "zones", F.round(score, 6).alias("score"), bucket.alias("bucket"))


def theme_targets(members: DataFrame, themes: DataFrame, cap: int, prefer: str, sample: int = 0) -> DataFrame:
    """(theme, label, zone): at most ``cap`` names of each wanted theme, those of the preferred zone first.

    ``sample`` labels of all members, drawn by a hash and each in its preferred or else first zone, follow under the theme ``sample``.
    """
    order = Window.partitionBy("theme").orderBy(F.desc(F.col("zone") == prefer), "label", "zone")
    named = members.select("theme", "label", "zone").distinct().join(themes.select("theme").distinct(), "theme").withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= cap).drop("_p")
    each = members.groupBy("label").agg(F.min_by("zone", F.struct(F.col("zone") != prefer, "zone")).alias("zone"))
    drawn = each.orderBy(F.md5("label"), "label").limit(sample).select(F.lit("sample").alias("theme"), "label", "zone")
    return named.union(drawn) if sample else named


def keyword_metrics(seen: DataFrame, rise: DataFrame) -> DataFrame:
    """(term, ops, days, zones, rise, stage) from (term, op, day, zone): confirmed from 8 operators on 5 days in 2 zones, forming from 3 on 2, else watch."""
    rows = seen.groupBy("term").agg(F.count_distinct("op").alias("ops"), F.count_distinct("day").alias("days"), F.count_distinct("zone").alias("zones")).join(rise, "term", "left")
    stage = F.when((F.col("ops") >= 8) & (F.col("days") >= 5) & (F.col("zones") >= 2), "confirmed").when((F.col("ops") >= 3) & (F.col("days") >= 2), "forming").otherwise("watch")
    return rows.withColumn("stage", stage)


def keyword_lists(metrics: DataFrame, covered_days: int, top: int = 50) -> DataFrame:
    """(list, term, place): the biggest by operators; trending by rise times log of operators times share of active days; emerging by
    novelty, adoption and widening, without the biggest and without terms that start with a digit."""
    share = F.col("days") / covered_days
    place = lambda column: F.row_number().over(Window.orderBy(F.desc(column), "term"))

    def best(rows: DataFrame, score: Column, name: str) -> DataFrame:
        found = rows.withColumn("_score", F.round(score, 9)).orderBy(F.desc("_score"), "term").limit(top)
        return found.select(F.lit(name).alias("list"), "term", place("_score").alias("place"))  # at most ``top`` rows

    biggest = best(metrics, F.col("ops").cast("double"), "biggest")
    trending = best(metrics.where("rise >= 1.5"), F.col("rise") * F.log2(1 + F.col("ops")) * share, "trending")
    fresh = metrics.where(~F.col("term").rlike("^[0-9]") & (F.col("days") < covered_days)).join(biggest.select("term"), "term", "left_anti")
    emerging = best(fresh, (1 - share) * F.log2(1 + F.col("ops")) * F.col("zones"), "emerging")
    return biggest.union(trending).union(emerging)


def keyword_clusters(op_terms: DataFrame, *, least_cosine: float = 0.3, least_ops: int = 2, most: int = 10, top: int = 300) -> DataFrame:
    """(cluster, term): terms that the same operators use, joined by falling cosine, clusters of at most ``most``.

    Pairs are counted by Spark over the ``top`` terms by operators; the merge runs on the pairs of these, whose number is bounded by ``top``.
    """
    counts = op_terms.groupBy("term").agg(F.count_distinct("op").alias("n")).orderBy(F.desc("n"), "term").limit(top)
    rows = op_terms.select("term", "op").distinct().join(F.broadcast(counts), "term")  # ``top`` rows
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.op") == F.col("b.op")) & (F.col("a.term") < F.col("b.term"))).groupBy(F.col("a.term").alias("x"), F.col("b.term").alias("y"), F.col("a.n").alias("nx"), F.col("b.n").alias("ny")).agg(F.count("*").alias("both"))
    strong = pairs.withColumn("cosine", F.col("both") / F.sqrt(F.col("nx") * F.col("ny"))).where((F.col("cosine") >= least_cosine) & (F.col("both") >= least_ops))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(cosine=group["cosine"].round(9)).sort_values(["cosine", "x", "y"], ascending=[False, True, True])
        home: dict[str, str] = {}
        members: dict[str, list[str]] = {}
        for x, y in zip(group["x"], group["y"], strict=True):
            for term in (x, y):
                if term not in home:
                    home[term], members[term] = term, [term]
            p, q = home[x], home[y]
            if p != q and len(members[p]) + len(members[q]) <= most:
                for term in members.pop(q):
                    home[term] = p
                    members[p].append(term)
        found = [(min(terms), t) for terms in members.values() if len(terms) > 1 for t in sorted(terms)]
        return pd.DataFrame(found, columns=["cluster", "term"])

    return strong.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(merge, "cluster string, term string")


def evidence_keys(cands: DataFrame, column: str = "evidence") -> DataFrame:
    """Adds valid, likely, signal, from_seller, kit and checked_at from evidence in JSON, parsed once; malformed JSON is not valid.

    ``likely``: the classification, or else the assessment's, is a likely sale. Such a row is a signal too.
    """
    shape = "struct<classification: string, assessment: struct<classification: string>, movement: struct<from: string, to: string>, homepage: struct<kit: string>, registry: struct<checked: string>>"
    rows = cands.withColumn("_e", F.from_json(column, shape))
    seller = F.coalesce(F.col("_e.movement.from") == "seller", F.lit(False))
    moved = F.coalesce(F.col("_e.movement.to").isin("hosting", "registrar", "other"), F.lit(False))
    likely = F.coalesce(F.coalesce("_e.classification", "_e.assessment.classification") == "likely-sale", F.lit(False))
    return rows.withColumns({"valid": F.col("_e.movement").isNotNull() | F.col("_e.registry").isNotNull(), "likely": likely, "signal": (seller & moved) | likely, "from_seller": seller, "kit": F.coalesce("_e.homepage.kit", F.lit("")), "checked_at": F.coalesce("_e.registry.checked", F.lit(""))}).drop("_e")


def candidate_stats(members: DataFrame, batches: DataFrame, theme: str) -> DataFrame:
    """(theme, names, buyers, built, without_destination): a batch of names at one destination on one day counts as one buyer."""
    rows = members.join(batches.where("large").select("day", "host", F.lit(True).alias("batch")), ["day", "host"], "left")
    buyer = F.when(F.col("batch"), F.concat_ws("|", "day", "host")).otherwise(F.concat_ws("|", "host", "label"))
    return rows.groupBy(theme).agg(F.count_distinct("label").alias("names"), F.count_distinct(F.when(F.col("host") != "", buyer)).alias("buyers"), F.count_distinct(F.when(F.col("built"), F.col("label"))).alias("built"), F.count_if(F.col("host") == "").alias("without_destination"))


def recheck(looks: DataFrame, minutes: int = 20, key: str = "name") -> DataFrame:
    """(name, due_at, looked_again): names whose first look was not built, due once more after some minutes, and whether a later look came.

    The batch twin of the recheck timer."""
    first = looks.groupBy(key).agg(F.min(F.struct("ts", "event_id", "built")).alias("f"), F.max("ts").alias("last"))
    due = F.col("f.ts") + F.expr(f"INTERVAL {minutes} MINUTES")
    return first.where(~F.col("f.built")).select(key, due.alias("due_at"), (F.col("last") >= due).alias("looked_again"))


def search_docs(segments: DataFrame, themes: Mapping[str, Sequence[str]], site_words: DataFrame) -> DataFrame:
    """(label, name, site, theme): token arrays for search: known pieces, words of the site, and theme families with a trigger among the pieces."""
    pairs = [F.struct(F.lit(name).alias("family"), F.array(*[F.lit(w) for w in sorted(words)]).alias("triggers")) for name, words in sorted(themes.items())]
    known = F.filter("pieces", lambda p: p != "?")
    hit = F.transform(F.filter(F.array(*pairs), lambda t: F.arrays_overlap(t["triggers"], F.col("name"))), lambda t: t["family"])
    return segments.select("label", known.alias("name")).join(site_words, "label", "left").select("label", "name", F.coalesce("site", F.array().cast("array<string>")).alias("site"), hit.alias("theme"))


def naming_profile(docs: DataFrame) -> DataFrame:
    """Adds status to search documents: themed, worded or invented."""
    return docs.withColumn("status", F.when(F.size("theme") > 0, "themed").when(F.size("name") > 0, "worded").otherwise("invented"))

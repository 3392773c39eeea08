"""Coverage: what was expected, what arrived, and whether a result may be read as complete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expected_days(catalog: DataFrame, start: Column, end: Column) -> DataFrame:
    """The catalog's rows for every day from start to end."""
    return catalog.withColumn("day", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))))


def drop_coverage(expected: DataFrame, receipts: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``complete`` and ``reason`` to the expected rows: a receipt is there, has no unknown names, accounts for all it observed,
    and as many events were kept as it says. Receipts: keys, status, observed, available, unavailable, unknown."""
    kept = events.groupBy(*keys).agg(F.count("*").alias("kept"))
    rows = expected.join(receipts, list(keys), "left").join(kept, list(keys), "left")
    accounted = F.col("available") + F.col("unavailable") + F.col("unknown")
    reason = (
        F.when(F.col("status").isNull(), "missing")
        .when(F.col("status") != "complete", "not-complete")
        .when(F.col("unknown") > 0, "unknown")
        .when(accounted != F.col("observed"), "unaccounted")
        .when(F.coalesce("kept", F.lit(0)) != F.col("observed"), "events-differ")
        .otherwise("ok")
    )
    return rows.withColumn("reason", reason).withColumn("complete", F.col("reason") == "ok")


def window_end(zones: DataFrame, status: DataFrame) -> DataFrame:
    """One row (window_end): the oldest of the zones' newest days with a good status; null if a zone has none. Status: zone, day, status."""
    newest = status.where("status = 'ok'").groupBy("zone").agg(F.max("day").alias("newest"))
    return zones.select("zone").distinct().join(newest, "zone", "left").agg(F.when(F.count("*") == F.count("newest"), F.min("newest")).alias("window_end"))


def registration_coverage(expected: DataFrame, receipts: DataFrame) -> DataFrame:
    """(day, complete, methodology, missing): a day is complete if every zone has a complete, uncapped receipt of one methodology."""
    rows = expected.join(receipts, ["day", "zone"], "left")
    good = F.coalesce(F.col("complete") & ~F.col("capped"), F.lit(False))
    by_day = rows.groupBy("day").agg(
        F.bool_and(good).alias("all_good"),
        F.count_distinct("methodology").alias("methods"),
        F.min("methodology").alias("methodology"),
        F.array_join(F.sort_array(F.collect_set(F.when(~good, F.col("zone")))), ",").alias("missing"),
    )
    return by_day.select("day", (F.col("all_good") & (F.col("methods") == 1)).alias("complete"), F.when(F.col("methods") == 1, F.col("methodology")).otherwise("mixed").alias("methodology"), "missing")


def movement_coverage(manifests: DataFrame, expected_zones: Sequence[str]) -> DataFrame:
    """(day, run, missing, consecutive, retained, whole): each day's newest complete manifest, the zones it lacks, whether the day before has one too, and whether
    it kept all movements; ``whole`` if nothing is wanting.

    Manifests: day, run, complete, zones, retained."""
    newest = manifests.where("complete").groupBy("day").agg(F.max_by(F.struct("run", "zones", "retained"), "run").alias("m"))
    missing = F.array_except(F.array(*[F.lit(z) for z in sorted(expected_zones)]), F.col("m.zones"))
    order = Window.orderBy("day")  # a row for each day
    rows = newest.select("day", F.col("m.run").alias("run"), F.array_join(missing, ",").alias("missing"), F.coalesce("m.retained", F.lit(False)).alias("retained"))
    rows = rows.withColumn("consecutive", F.coalesce(F.date_diff("day", F.lag("day").over(order)) == 1, F.lit(False)))
    return rows.withColumn("whole", (F.col("missing") == "") & F.col("consecutive") & F.col("retained"))


def validate_snapshot(df: DataFrame, key: Sequence[str], time: str, *, least: int, previous: int, most_drop: float = 0.2, time_share: float = 0.5) -> DataFrame:
    """One row (n, duplicates, timed, verdict): enough rows, not too few against the last snapshot, unique keys, and times for enough rows."""
    keys = df.groupBy(*key).agg(F.count("*").alias("c"), F.count(time).alias("t"))
    total = keys.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("t"), F.lit(0)).alias("t"))
    n = F.col("n")
    verdict = F.when(n < least, "too-few").when(n < (1 - most_drop) * previous, "dropped").when(F.col("duplicates") > 0, "duplicates").when(F.col("t") < time_share * n, "untimed").otherwise("ok")
    return total.select("n", "duplicates", F.round(F.col("t") / F.greatest(n, F.lit(1)), 6).alias("timed"), verdict.alias("verdict"))


def snapshot_health(meta: DataFrame, now: Column, *, most_hours: float = 1.0, least: int = 1) -> DataFrame:
    """Adds ``status`` (missing, invalid, stale, current) and ``age_hours`` to snapshots (generated_at, verified_at, count).

    Missing without a time, invalid under ``least`` rows, stale once its time is over ``most_hours`` ago: that of the newest proof that it is unchanged, else that of its making. A time in
    the future has the age 0; a null count is 0.
    """
    seen = F.coalesce("verified_at", "generated_at")
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(seen)) / 3_600_000_000)
    status = F.when(F.col("generated_at").isNull(), "missing").when(F.coalesce("count", F.lit(0)) < least, "invalid").when(age > most_hours, "stale").otherwise("current")
    return meta.withColumns({"status": status, "age_hours": F.when(F.col("generated_at").isNotNull(), F.round(age, 6))})


def gate_observation(df: DataFrame, by: str, *, least: int = 50, most_unknown: float = 0.05, most_lost: float = 0.2) -> DataFrame:
    """(by, n, unknown, lost, passed) from rows with ``result``."""
    rows = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("result") == "unknown").alias("unknown"), F.count_if(F.col("result") == "lost").alias("lost"))
    return rows.withColumn("passed", (F.col("n") >= least) & (F.col("unknown") <= most_unknown * F.col("n")) & (F.col("lost") <= most_lost * F.col("n")))


def built_rate(sample: DataFrame, evidence: DataFrame, by: str) -> DataFrame:
    """(by, known, built, rate): the rate is null where nothing is known. Evidence: name, built."""
    rows = sample.join(evidence, "name", "left")
    return rows.groupBy(by).agg(F.count("built").alias("known"), F.count_if("built").alias("n_built")).select(by, "known", F.col("n_built").alias("built"), F.round(F.try_divide(F.col("n_built"), F.col("known")), 6).alias("rate"))


def intake_coverage(cands: DataFrame, day: str = "day") -> DataFrame:
    """(day, candidates, probed, failed, reasons): by departure day; reasons as text, sorted."""
    counted = cands.groupBy(day, "reason").agg(F.count("*").alias("c"), F.count_if("probed").alias("p"), F.count("reason").alias("f"))
    text = F.array_join(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws(":", "reason", F.col("c").cast("string"))))), ",")
    return counted.groupBy(day).agg(F.sum("c").alias("candidates"), F.sum("p").alias("probed"), F.sum("f").alias("failed"), text.alias("reasons"))


def backlog(df: DataFrame, now: Column) -> DataFrame:
    """(bucket, zone, n): due rows by how long they have been due."""
    hours = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("due_at").cast("timestamp"))) / 3600)
    bucket = F.when(hours < 0, "not-due").when(hours < 24, "day").when(hours < 168, "week").otherwise("older")
    return df.groupBy(bucket.alias("bucket"), "zone").agg(F.count("*").alias("n"))


def reconcile_cells(observations: DataFrame, negatives: DataFrame) -> DataFrame:
    """(base, zone, verdict): a fresh negative beats older positives, a registry positive wins otherwise, any other positive is unresolved.

    Observations: base, zone, source, at; negatives: base, zone, at."""
    positive = observations.groupBy("base", "zone").agg(F.max("at").alias("seen_at"), F.max(F.col("source") == "registry").alias("registry"))
    negative = negatives.groupBy("base", "zone").agg(F.max("at").alias("clear_at"))
    rows = positive.join(negative, ["base", "zone"], "full")
    verdict = F.when(F.col("seen_at").isNull() | (F.col("clear_at") > F.col("seen_at")), "free").when(F.col("registry"), "taken").otherwise("unresolved")
    return rows.select("base", "zone", verdict.alias("verdict"))


def merge_ledger(*sources: tuple[str, DataFrame], key: str = "domain", left_out: Sequence[str] = ()) -> DataFrame:
    """One row of each key over named sources (key, day, value): the most recent, and of one day the source named first. Names in the zones ``left_out`` don't enter."""
    entering = ~F.substring_index(key, ".", -1).isin(*left_out) if left_out else F.lit(True)
    parts = [df.where(entering).select(key, "day", "value").withColumns({"source": F.lit(name), "_rank": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = F.max_by(F.struct("day", "value", "source"), F.struct("day", -F.col("_rank"), "value")).alias("best")
    return every.groupBy(key).agg(best).select(key, "best.*")


def sibling_evidence(df: DataFrame, taken: DataFrame, covered: DataFrame, zones: Sequence[str]) -> DataFrame:
    """(label, zone, state): taken if seen, not_taken if not seen and the zone's coverage is complete, else unknown."""
    wanted = df.select("label").distinct().select("label", F.explode(F.array(*[F.lit(z) for z in zones])).alias("zone"))
    rows = wanted.join(taken.select("label", "zone", F.lit(True).alias("seen")).distinct(), ["label", "zone"], "left").join(covered.select("zone", F.lit(True).alias("whole")).distinct(), "zone", "left")
    return rows.select("label", "zone", F.when(F.col("seen"), "taken").when(F.col("whole"), "not_taken").otherwise("unknown").alias("state"))


def sibling_matches(evidence: DataFrame, zones: Sequence[str], *, mode: str = "taken", match: str = "all") -> DataFrame:
    """(label) of ``evidence`` (label, zone, state) whose states in ``zones`` fit: ``mode`` taken or not_taken in ``all`` or ``any`` of them, or ``any`` for none unknown. Labels without a state for each zone don't fit; no zones fit all."""
    if not zones:
        return evidence.select("label").distinct()
    wanted = F.col("state") != "unknown" if mode == "any" else F.col("state") == mode
    once = evidence.where(F.col("zone").isin(*zones)).groupBy("label", "zone").agg(F.max(wanted).alias("fits"))
    counts = once.groupBy("label").agg(F.count("*").alias("n"), F.count_if("fits").alias("hits")).where(F.col("n") == len(set(zones)))
    return counts.where(F.col("hits") >= (1 if match == "any" and mode != "any" else F.col("n"))).select("label")

"""Snapshots of the name universe: scans of zone data, diffs between days, and where names have moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAME = r"^[a-z0-9_](?:[a-z0-9_.-]*[a-z0-9_])?$"
PRIORITY = ["seller", "parking", "hosting", "registrar", "other", "none"]


def zone_records(lines: DataFrame, zone: Column, value: str = "value") -> DataFrame:
    """(name, host) from lines of zone text; ``zone`` is the line's apex.

    Owner, optional TTL and class, then type NS and the host. Names are lower-cased without the last dot, relative ones get the apex.
    Apex rows, ``@``, directives, comments, other types and names with other characters are dropped.
    """
    parts = F.regexp_extract_all(F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))), F.lit(r"^(\S+)(?: \d+)?(?: in)?(?: \d+)? ns (\S+)$"), 0)
    row = lines.withColumn("apex", F.lower(zone)).withColumn("line", F.get(parts, F.lit(0))).where("line is not null").where(~F.col("line").rlike(r"^[;$@]"))

    def absolute(name: Column) -> Column:
        return F.when(F.endswith(name, F.lit(".")), F.regexp_replace(name, r"\.$", "")).otherwise(F.concat_ws(".", name, F.col("apex")))

    owner, host = F.split_part("line", F.lit(" "), F.lit(1)), F.split_part("line", F.lit(" "), F.lit(-1))
    out = row.select(absolute(owner).alias("name"), absolute(host).alias("host"), "apex")
    return out.where((F.col("name") != F.col("apex")) & F.col("name").rlike(NAME) & F.col("host").rlike(NAME)).select("name", "host")


def delegations(records: DataFrame) -> DataFrame:
    """(name, ns): the distinct hosts of each name, sorted."""
    return records.groupBy("name").agg(F.sort_array(F.collect_set("host")).alias("ns"))


def zone_labels(records: DataFrame, zone: Column) -> DataFrame:
    """(label): names directly under their zone, once each."""
    apex = F.concat(F.lit("."), zone)
    under = records.where(F.endswith("name", apex)).select(F.expr("name").alias("name"), F.substring_index("name", ".", 1).alias("label"), zone.alias("zone"))
    return under.where(F.col("name") == F.concat_ws(".", "label", "zone")).select("label", "zone").distinct()


def diff_snapshots(prev: DataFrame, today: DataFrame, key: str, value: str) -> DataFrame:
    """(key, kind, prev, today): added, dropped, changed or unchanged between two snapshots of (key, value)."""
    a, b = prev.select(F.col(key), F.col(value).alias("prev"), F.lit(True).alias("in_prev")), today.select(F.col(key), F.col(value).alias("today"), F.lit(True).alias("in_today"))
    kind = F.when(F.col("in_prev").isNull(), "added").when(F.col("in_today").isNull(), "dropped").when(F.col("prev").eqNullSafe(F.col("today")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, kind.alias("kind"), "prev", "today")


def added(prev: DataFrame, today: DataFrame, key: str) -> DataFrame:
    return today.select(key).distinct().join(prev.select(key), key, "left_anti")


def dropped(prev: DataFrame, today: DataFrame, key: str, summary: DataFrame) -> DataFrame:
    """Names gone today with the zone count of ``summary`` (key, n_zones), largest first."""
    gone = prev.select(key).distinct().join(today.select(key), key, "left_anti").join(summary, key, "left")
    return gone.orderBy(F.desc_nulls_last("n_zones"), F.length(key), key)


def set_moves(prev: DataFrame, today: DataFrame, key: str) -> DataFrame:
    """(key, move): ``exit`` for what is only in ``prev``, ``entry`` for what is only in ``today``."""
    gone = prev.select(key).distinct().join(today.select(key), key, "left_anti").withColumn("move", F.lit("exit"))
    new = today.select(key).distinct().join(prev.select(key), key, "left_anti").withColumn("move", F.lit("entry"))
    return gone.unionByName(new)


def classify_hosts(hosts: DataFrame, providers: DataFrame, rules: list[tuple[str, str]] = ()) -> DataFrame:
    """(host, class): the class of the longest suffix of each host that is in ``providers`` (host, class); then the first of the
    ``rules`` (pattern, class) that fits; then ``other``. A provider with several classes has the first by PRIORITY.

    ``providers`` is a dictionary kept by hand; Spark broadcasts it by its size or shuffles it.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in ["parking", "seller", "hosting", "registrar"]]), F.col("class"))
    once = providers.groupBy(F.lower("host").alias("suffix")).agg(F.min_by("class", F.when(rank == 0, 99).otherwise(rank)).alias("class"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = hosts.select("host").distinct()
    found = distinct.select("host", F.explode(suffixes).alias("suffix")).join(once, "suffix").groupBy("host").agg(F.max_by("class", F.length("suffix")).alias("class"))
    other = F.lit("other")
    for pattern, name in reversed(list(rules)):
        other = F.when(F.col("host").rlike(pattern), name).otherwise(other)
    return distinct.join(found, "host", "left").select("host", F.coalesce("class", other).alias("class"))


def classify_ns(names: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, ns_key, class): each delegation's hosts as one key and its class by priority; no hosts give ``none``."""
    rank = F.array_position(F.array(*[F.lit(c) for c in PRIORITY]), F.col("class"))
    each = names.select("name", F.explode_outer("ns").alias("host")).join(classes, "host", "left")
    key = F.array_join(F.sort_array(F.collect_set("host")), ",")
    return each.groupBy("name").agg(key.alias("ns_key"), F.coalesce(F.min_by("class", rank), F.lit("none")).alias("class"))


def select_movement(diff: DataFrame) -> DataFrame:
    """One row for each selection of a diff row with ``kind``, ``prev_class`` and ``today_class``.

    ``departures``: from seller or parking to hosting, registrar or other; ``went-live``: to hosting from anything else; ``listed``: to
    seller or parking from neither; ``changed``: changed and none of these; ``delegation-removed``: dropped.
    """
    changed, was, now = F.col("kind") == "changed", F.col("prev_class"), F.col("today_class")
    departures = changed & was.isin("seller", "parking") & now.isin("hosting", "registrar", "other")
    live = changed & (was != "hosting") & (now == "hosting")
    listed = changed & ~was.isin("seller", "parking") & now.isin("seller", "parking")
    marks = [(departures, "departures"), (live, "went-live"), (listed, "listed"), (changed & ~departures & ~live & ~listed, "changed"), (F.col("kind") == "dropped", "delegation-removed")]
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in marks]))
    return diff.select("*", F.explode(found).alias("selection"))


def filter_movement(rows: DataFrame, *, selection: str | None = None, from_class: str | None = None, to_class: str | None = None, contains: str | None = None, zone: str | None = None) -> DataFrame:
    tests = {"selection": selection, "prev_class": from_class, "today_class": to_class}
    for column, wanted in tests.items():
        rows = rows if wanted is None else rows.where(F.col(column) == wanted)
    rows = rows if contains is None else rows.where(F.contains("name", F.lit(contains)))
    return rows if zone is None else rows.where(F.endswith("name", F.lit(f".{zone}")))


def movement_summary(diff: DataFrame, top: int = 40) -> DataFrame:
    """(section, item, n): counts by kind, by class transition, and the ``top`` providers that changed names left or reached."""
    item = lambda section, value: F.struct(F.lit(section).alias("section"), value.alias("item"))
    changed = F.col("kind") == "changed"
    moves = [("transition", F.concat_ws(">", "prev_class", "today_class")), ("lost", F.col("prev_key")), ("gained", F.col("today_key"))]
    each = F.array_compact(F.array(item("kind", F.col("kind")), *[F.when(changed, item(section, value)) for section, value in moves]))
    counts = diff.select(F.explode(each).alias("x")).groupBy("x.section", "x.item").agg(F.count("*").alias("n"))
    order = Window.partitionBy("section").orderBy(F.desc("n"), "item")
    leading = counts.where("section IN ('lost', 'gained')").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")
    return counts.where("section IN ('kind', 'transition')").union(leading)


def recover_removed(drops: DataFrame, baseline: DataFrame) -> DataFrame:
    """The delegations that dropped names had in ``baseline`` (name, ns); raises if a drop is missing there."""
    wanted = drops.select("name").distinct()
    if not wanted.join(baseline, "name", "left_anti").isEmpty():
        raise ValueError("the baseline lacks names of the drops list")
    return wanted.join(baseline, "name")


def universe_summary(labels: DataFrame, *, min_zones: int = 2, anchors: tuple[str, ...] = ("com",)) -> DataFrame:
    """(label, n_zones, zones): labels in ``min_zones`` zones or more, and single-zone labels outside the anchor zones."""
    every = labels.groupBy("label").agg(F.sort_array(F.collect_set("zone")).alias("zones")).withColumn("n_zones", F.size("zones"))
    single = (F.col("n_zones") == 1) & ~F.col("zones")[0].isin(*anchors)
    return every.where((F.col("n_zones") >= min_zones) | single).select("label", "n_zones", "zones")


def universe_totals(labels: DataFrame, *, min_zones: int = 2) -> DataFrame:
    """(zone, labels, shared, alone): the different labels of each zone, those in ``min_zones`` zones or more, and those of this zone only."""
    once = labels.select("label", "zone").distinct()
    spread = once.groupBy("label").agg(F.count("*").alias("n"))
    return once.join(spread, "label").groupBy("zone").agg(F.count("*").alias("labels"), F.count_if(F.col("n") >= min_zones).alias("shared"), F.count_if(F.col("n") == 1).alias("alone"))


def seller_delegations(records: DataFrame, providers: DataFrame) -> DataFrame:
    """(name, host, provider): the first host of each name, in order, that is a provider's or below it."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = records.select("name", "host", F.explode(suffixes).alias("provider")).join(providers.select(F.col("host").alias("provider")).distinct(), "provider")
    return hit.groupBy("name").agg(F.min(F.struct("host", "provider")).alias("first")).select("name", "first.host", "first.provider")


def listed_universe(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, sources): names listed by either source, with the sources that list them."""
    both = a.select(key).withColumn("source", F.lit("provider")).union(b.select(key).withColumn("source", F.lit("zone")))
    return both.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def union_events(adds: DataFrame, drops: DataFrame) -> DataFrame:
    return adds.withColumn("kind", F.lit("add")).unionByName(drops.withColumn("kind", F.lit("drop")), allowMissingColumns=True)


def set_compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(part, n): how many distinct keys are only in the first, only in the second, or in both."""
    x, y = a.select(*keys).distinct().withColumn("a", F.lit(1)), b.select(*keys).distinct().withColumn("b", F.lit(1))
    part = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("both")
    return x.join(y, keys, "full").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def first_seen(sightings: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    return sightings.groupBy(*keys).agg(F.min(day).alias("first_seen"))


def changed_since_previous(observations: DataFrame, key: str, time: str, value: str, days: int = 14) -> DataFrame:
    """Each observation with the previous value of its key, if that was seen within ``days``, and whether it changed."""
    order = Window.partitionBy(key).orderBy(time, "event_id")
    recent = F.lag(time).over(order) >= F.col(time) - F.expr(f"INTERVAL {days} DAYS")
    previous = F.when(recent, F.lag(value).over(order))
    return observations.withColumn("previous", previous).withColumn("changed", F.coalesce(F.col("previous") != F.col(value), F.lit(False)))

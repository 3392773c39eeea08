"""Listings: search, lifecycle, pages and fair selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def text_match(column: str, text: str, position: str = "contains") -> Column:
    """Whether a column contains, starts or ends with one of the comma-separated words of ``text``."""
    test = {"contains": F.contains, "starts": F.startswith, "ends": F.endswith}[position]
    return _any([test(F.col(column), F.lit(word.strip().lower())) for word in text.split(",") if word.strip()])


def search_listings(
    df: DataFrame,
    *,
    stream: str | None = None,
    zones: Sequence[str] = (),
    text: str | None = None,
    position: str = "contains",
    suffixes: Sequence[str] = (),
    price: tuple[float | None, float | None] = (None, None),
    length: tuple[int | None, int | None] = (None, None),
    age: tuple[int | None, int | None] = (None, None),
    zone_count: tuple[int | None, int | None] = (None, None),
    no_digits: bool = False,
    no_hyphens: bool = False,
    has_bids: bool = False,
    has_archive: bool = False,
    available: bool | None = None,
) -> DataFrame:
    """Rows that pass every given filter; a null never passes one, so a price bound drops rows without a price.

    A least count of zones is also met by the lower bound ``zones_at_least``, if there is such a column; a largest one needs the exact ``zones_taken``.
    """
    tests = []
    if stream:
        tests.append(F.col("stream") == stream)
    if zones:
        tests.append(F.col("zone").isin(*zones))
    if text:
        tests.append(text_match("label", text, position))
    if suffixes:
        tests.append(_any([F.endswith("label", F.lit(s)) for s in suffixes]))
    for column, (low, high) in ((F.col("price"), price), (F.length("label"), length), (F.col("age_years"), age)):
        tests += [column >= low] if low is not None else []
        tests += [column <= high] if high is not None else []
    fewest, most = zone_count
    if fewest is not None:
        known = F.coalesce("zones_taken", "zones_at_least") if "zones_at_least" in df.columns else F.col("zones_taken")
        tests.append(known >= fewest)
    if most is not None:
        tests.append(F.col("zones_taken") <= most)
    if no_digits:
        tests.append(~F.col("label").rlike("[0-9]"))
    if no_hyphens:
        tests.append(~F.contains("label", F.lit("-")))
    if has_bids:
        tests.append(F.col("bids") > 0)
    if has_archive:
        tests.append(F.col("archive") > 0)
    if available is not None:
        tests.append(F.col("available") == available)
    return reduce(lambda d, t: d.where(t), tests, df)


def research(summary: DataFrame, q: str, *, position: str = "any", no_digits: bool = False, no_hyphens: bool = False, no_idn: bool = False, length: tuple[int, int] = (1, 63), zone: str | None = None, min_zones: int = 1) -> DataFrame:
    """Labels for a query of one to six terms; ``-term`` excludes.

    ``beginning``, ``end`` and ``any`` want the terms in order, with gaps between; ``shuffle`` takes up to 24 orders.
    """
    terms = [t for t in q.lower().split() if not t.startswith("-")][:6]
    excluded = [t[1:] for t in q.lower().split() if t.startswith("-") and len(t) > 1]
    if not terms:
        raise ValueError("a query needs a term")
    orders = list(permutations(terms))[:24] if position == "shuffle" else [tuple(terms)]

    def like(order: Sequence[str]) -> str:
        body = "%".join(t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for t in order)
        return {"beginning": f"{body}%", "end": f"%{body}"}.get(position, f"%{body}%")

    test = _any([F.col("label").like(like(o)) for o in orders])
    for word in excluded:
        test = test & ~F.contains("label", F.lit(word))
    out = summary.where(test & F.length("label").between(*length))
    out = out.where(~F.col("label").rlike("[0-9]")) if no_digits else out
    out = out.where(~F.contains("label", F.lit("-"))) if no_hyphens else out
    out = out.where(~F.startswith("label", F.lit("xn--"))) if no_idn else out
    out = out.where(F.size("zones") >= min_zones) if min_zones > 1 else out
    return out.where(F.array_contains("zones", zone)) if zone else out


def search_names(df: DataFrame, q: str, mode: str, column: str = "label", zone: str | None = None) -> DataFrame:
    """Names that contain, start with, end with, equal or match ``q``."""
    tests = {"contains": F.contains, "prefix": F.startswith, "suffix": F.endswith, "exact": lambda a, b: a == b, "regex": lambda a, b: a.rlike(q)}
    out = df.where(tests[mode](F.col(column), F.lit(q)))
    return out.where(F.col("zone") == zone) if zone else out


def prefix_corpus(labels: DataFrame, prefix: str, complete: DataFrame) -> DataFrame:
    """(zone, n, complete): labels with the prefix by zone, and whether ``complete`` (zone) knows that zone as complete."""
    hits = labels.where(F.startswith("label", F.lit(prefix))).groupBy("zone").agg(F.count_distinct("label").alias("n"))
    return hits.join(complete.select("zone").distinct().withColumn("complete", F.lit(True)), "zone", "left").fillna(False, ["complete"])


def filter_drops(df: DataFrame, *, length: tuple[int, int] = (1, 63), keyword: str | None = None, position: str = "contains", no_hyphens: bool = False, no_digits: bool = False, zone: str | None = None, words: int | None = None) -> DataFrame:
    """Dropping names; the number of words is known only where hyphens separate them."""
    out = df.where(F.length("label").between(*length))
    out = out.where(text_match("label", keyword, position)) if keyword else out
    out = out.where(~F.contains("label", F.lit("-"))) if no_hyphens else out
    out = out.where(~F.col("label").rlike(r"\d")) if no_digits else out
    out = out.where(F.col("zone") == zone) if zone else out
    return out.where(F.contains("label", F.lit("-")) & (F.size(F.split("label", "-+")) == words)) if words else out


def name_parts(df: DataFrame, column: str = "domain") -> DataFrame:
    """Adds base (before the first dot) and rest (after it)."""
    return df.withColumn("base", F.substring_index(column, ".", 1)).withColumn("rest", F.when(F.contains(column, F.lit(".")), F.expr(f"substr({column}, instr({column}, '.') + 1)")).otherwise(""))


def malformed(df: DataFrame, column: str = "domain") -> DataFrame:
    """Rows whose name is null, has a label that starts or ends with a hyphen, is too long or has other characters."""
    good = r"^(?!-)[a-z0-9-]{1,63}(?<!-)(\.(?!-)[a-z0-9-]{1,63}(?<!-))+$"
    return df.where(F.col(column).isNull() | ~F.col(column).rlike(good))


def known_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def listing_state(df: DataFrame, now: Column) -> DataFrame:
    """``ended`` for an auction or expiring name whose end has passed, ``inactive`` for a dropped one, else ``active``; no end is active."""
    state = F.when(F.col("stream") == "dropped", "inactive").when(F.col("ends_at") <= now, "ended").otherwise("active")
    return df.withColumn("state", state)


def expiring(df: DataFrame, days: int, now: Column) -> DataFrame:
    """Names that end within the window; an expiring one is left out if the same name is also dropped."""
    window = (F.col("ends_at") > now) & (F.col("ends_at") <= now + F.expr(f"INTERVAL {days} DAYS"))
    gone = df.where("stream = 'dropped'").select("domain").distinct().withColumn("suppressed", F.lit("expiring"))
    soon = df.where(window)
    return soon.join(gone, (soon["domain"] == gone["domain"]) & (soon["stream"] == gone["suppressed"]), "left_anti")


def strict_expired(df: DataFrame, events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Dropped and available listings with a release event (domain, released_at) inside the window."""
    released = events.where((F.col("released_at") >= start) & (F.col("released_at") < end)).select("domain")
    return df.where("stream = 'dropped' AND available").join(released, "domain", "left_semi")


def availability_due(df: DataFrame, now: Column, hours: Mapping[str, int]) -> DataFrame:
    """Rows (result, checked_at) never checked, or checked longer ago than the interval of their last result."""
    wait = F.lit(None)
    for result, n in hours.items():
        wait = F.when(F.col("result") == result, F.expr(f"INTERVAL {n} HOURS")).otherwise(wait) if n else wait
    return df.where(F.col("checked_at").isNull() | (F.col("checked_at") + wait <= now))


def date_window(times: DataFrame, column: str, kind: str, zone: str, now: datetime) -> DataFrame:
    """Rows whose UTC time falls on the local ``today`` or ``tomorrow`` of a time zone, or in the next ``hours:N``."""
    here = F.lit(now).cast("timestamp_ntz")
    if kind.startswith("hours:"):
        return times.where((F.col(column) >= here) & (F.col(column) < here + F.expr(f"INTERVAL {int(kind[6:])} HOURS")))
    local = F.date_trunc("day", F.convert_timezone(F.lit("UTC"), F.lit(zone), here)).cast("timestamp_ntz")
    start = local + F.expr(f"INTERVAL {int(kind == 'tomorrow')} DAYS")
    mine = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(column))
    return times.where((mine >= start) & (mine < start + F.expr("INTERVAL 1 DAYS")))


def owner_matches(owned: DataFrame, seen: DataFrame, since: Column) -> DataFrame:
    """(label, zone, first_seen, sources): owned labels seen since ``since`` in zones that the owner does not hold.

    Only labels held in com or ai count, and never the xyz zone.
    """
    held = owned.where(F.col("zone").isin("com", "ai")).select("label").distinct()
    found = seen.where((F.col("day") >= since) & (F.col("zone") != "xyz")).join(held, "label").join(owned.select("label", "zone"), ["label", "zone"], "left_anti")
    return found.groupBy("label", "zone").agg(F.min("day").alias("first_seen"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def upgrade_targets(seen: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(label, target): labels seen in one zone, offered in the target zones where they have not been seen; never xyz, shop or info."""
    wanted = [t for t in targets if t not in ("xyz", "shop", "info")]
    offers = seen.select("label").distinct().select("label", F.explode(F.array(*[F.lit(t) for t in wanted])).alias("target"))
    return offers.join(seen.select("label", F.col("zone").alias("target")).distinct(), ["label", "target"], "left_anti")


def taken_in(df: DataFrame, names: DataFrame, zones: Sequence[str], match: str = "any") -> DataFrame:
    """Rows whose label is registered in any or in all of the zones."""
    have = names.where(F.col("zone").isin(*zones)).groupBy("label").agg(F.count_distinct("zone").alias("n"))
    return df.join(have.where(F.col("n") >= (len(set(zones)) if match == "all" else 1)).select("label"), "label", "left_semi")


def sibling_candidates(df: DataFrame, zones: Sequence[str], start: Column, end: Column) -> DataFrame:
    """(label): names of the zones that end inside the window, once each."""
    return df.where(F.col("zone").isin(*zones) & (F.col("ends_at") >= start) & (F.col("ends_at") < end)).select("label").distinct()


def overlay(df: DataFrame, live: DataFrame, now: Column, max_minutes: int = 15) -> DataFrame:
    """Price and bids of ``live`` (domain, live_price, live_bids, quoted_at) replace the feed's where the newest quote is young enough."""
    fresh = live.where((F.col("quoted_at") <= now) & (F.col("quoted_at") > now - F.expr(f"INTERVAL {max_minutes} MINUTES")))
    newest = fresh.groupBy("domain").agg(F.max_by(F.struct("live_price", "live_bids"), F.struct("quoted_at", "live_price", "live_bids")).alias("quote"))
    merged = df.join(newest, "domain", "left")
    return merged.withColumn("price", F.coalesce("quote.live_price", "price")).withColumn("bids", F.coalesce("quote.live_bids", "bids")).withColumn("is_live", F.col("quote").isNotNull()).drop("quote")


def research_merge(*sources: DataFrame) -> DataFrame:
    """(label, zones, n_zones) over sources of (label, zones): the union of the zones of each label."""
    every = reduce(DataFrame.unionByName, [s.select("label", "zones") for s in sources])
    zones = F.sort_array(F.array_distinct(F.flatten(F.collect_list("zones"))))
    return every.groupBy("label").agg(zones.alias("zones")).withColumn("n_zones", F.size("zones"))


def zone_membership(names: DataFrame, summary: DataFrame, single: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """(label, zones, exact): from the multi-zone summary, the single-zone table, or absent with the anchor zones unresolved."""
    many = summary.select("label", F.array_join("zones", ",").alias("many"))
    one = single.select("label", F.col("zone").alias("one"))
    found = names.select("label").distinct().join(many, "label", "left").join(one, "label", "left")
    return found.select("label", F.coalesce("many", "one", F.lit("")).alias("zones"), (F.col("many").isNotNull() | F.col("one").isNotNull()).alias("exact"), F.when(F.col("many").isNull() & F.col("one").isNull(), ",".join(anchors)).otherwise("").alias("unresolved"))


def refresh_saved(saved: DataFrame, listings: DataFrame, now: Column) -> DataFrame:
    """Saved rows with stream, price and end of the current listing of the name, the one that ends first."""
    current = listings.where(F.col("ends_at").isNull() | (F.col("ends_at") > now))
    best = current.groupBy("domain").agg(F.min_by(F.struct("stream", "price", "ends_at"), F.struct(F.coalesce("ends_at", F.lit("9999-01-01").cast("timestamp_ntz")), "listing_id")).alias("now"))
    out = saved.join(best, "domain", "left")
    return out.select("domain", F.coalesce("now.stream", "stream").alias("stream"), F.when(F.col("now").isNotNull(), F.col("now.price")).otherwise(F.col("price")).alias("price"), F.when(F.col("now").isNotNull(), F.col("now.ends_at")).otherwise(F.col("ends_at")).alias("ends_at"), F.col("now").isNotNull().alias("is_current"))


def stats(df: DataFrame, now: Column, windows: Sequence[int] = (1, 7, 14, 30, 60, 90), *, complete: bool = True) -> DataFrame:
    """(stream, zone, metric, n) in one pass: active rows, rows that have ended (0 unless coverage is ``complete``), and rows that end within each window of days."""
    ahead = (F.col("ends_at") > now) & (F.col("stream") != "dropped")
    counts = [F.count_if((F.col("stream") != "dropped") & (F.col("ends_at").isNull() | (F.col("ends_at") > now))).alias("active"), (F.count_if(F.col("ends_at") <= now) if complete else F.lit(0)).cast("long").alias("expired")]
    counts += [F.count_if(ahead & (F.col("ends_at") <= now + F.expr(f"INTERVAL {d} DAYS"))).alias(f"expiring_{d}d") for d in windows]
    wide = df.groupBy("stream", "zone").agg(*counts)
    return wide.unpivot(["stream", "zone"], [c for c in wide.columns if c not in ("stream", "zone")], "metric", "n")


def breakdowns(df: DataFrame, dims: Sequence[str], top: int = 20) -> DataFrame:
    """(dim, item, n): the most frequent values of each dimension."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("item")) for d in dims])).alias("x")).select("x.*")
    counts = long.groupBy("dim", "item").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "item"))).where(F.col("place") <= top).drop("place")


def kit_sample(df: DataFrame, key: str, order: Sequence[Column | str], n: int = 3) -> DataFrame:
    """At most ``n`` rows of each key, the first in order; rows without a key all stay."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keyed = df.where(F.col(key).isNotNull()).withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
    return keyed.unionByName(df.where(F.col(key).isNull()))


def select_due(df: DataFrame, limit: int, order: Sequence[Column | str], age: Sequence[Column | str], key: str, share: float = 0.9) -> DataFrame:
    """``limit`` rows: the given share by priority, the rest those that have waited longest."""
    first = df.orderBy(*order).limit(int(limit * share)).withColumn("lane", F.lit("priority"))
    rest = df.join(first.select(key), key, "left_anti").orderBy(*age).limit(limit - int(limit * share)).withColumn("lane", F.lit("oldest"))
    return first.unionByName(rest)


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def keyset_page(df: DataFrame, after: tuple[float, int] | None, limit: int) -> DataFrame:
    """The next page by price, highest first, then listing_id; ``after`` is the last row's pair, so every row comes exactly once."""
    rows = df.where("price IS NOT NULL")
    if after:
        price, last = after
        rows = rows.where((F.col("price") < price) | ((F.col("price") == price) & (F.col("listing_id") > last)))
    return rows.orderBy(F.desc("price"), "listing_id").limit(limit)


def ranked_page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page with the total number of rows and whether more follow."""
    total = df.agg(F.count("*").alias("total"))
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def round_robin(df: DataFrame, key: str, order: Sequence[Column | str], limit: int) -> DataFrame:
    """Rows taken in turn from each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("turn", place).where(F.col("turn") <= limit).orderBy("turn", key).limit(limit)


def fair_order(df: DataFrame, shares: Mapping[str, int], limit: int) -> DataFrame:
    """Streams in proportion to their shares, soonest end first, each name once."""
    once = latest_per_key(df.where(F.col("stream").isin(*shares) & F.col("ends_at").isNotNull()), ["domain"], ["ends_at", "listing_id"])
    place = F.row_number().over(Window.partitionBy("stream").orderBy("ends_at", "listing_id"))
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("stream")]
    first = once.withColumn("place", place).where(F.col("place") <= limit)  # no stream gives more, so each task keeps only so many
    return first.withColumn("time", F.col("place") / share).drop("place").orderBy("time", "stream").limit(limit)


def diverse_examples(df: DataFrame, group: str, signature: str, order: Sequence[Column | str], n: int = 12) -> DataFrame:
    """``n`` rows of each group: the first of each signature before any second one. A signature's first ``n`` are all that can be among them, so no
    more of a busy group comes together."""
    inner = F.row_number().over(Window.partitionBy(group, signature).orderBy(*order))
    return df.withColumn("turn", inner).where(F.col("turn") <= n).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("turn", *order))).where(F.col("place") <= n).drop("turn")


def day_sample(df: DataFrame, day: str, n: int, key: str) -> DataFrame:
    """``n`` rows in an order fixed by the day."""
    return df.orderBy(F.md5(F.concat(F.lit(day), F.col(key).cast("string"))), key).limit(n)


def inventory_demand(df: DataFrame, now: Column) -> DataFrame:
    """(label, first_end): names still on offer with their earliest known end."""
    open_ = df.where(F.col("ends_at").isNull() | (F.col("ends_at") > now))
    return open_.groupBy("label").agg(F.min("ends_at").alias("first_end"))


def eligible_topk(df: DataFrame, seen: DataFrame, cohort: str, order: Sequence[Column | str], k: int, limit: int = 10) -> DataFrame:
    """The first ``k`` unseen rows of cohorts of under ``limit`` rows."""
    size = F.count("*").over(Window.partitionBy(cohort))
    return df.withColumn("cohort_size", size).where(F.col("cohort_size") < limit).join(seen, "domain", "left_anti").orderBy(*order).limit(k)


def wider_counts(df: DataFrame, day: str, end: Column, windows: Sequence[int]) -> DataFrame:
    """(days, n): matches in each window of days before ``end``."""
    wide = df.agg(*[F.count_if((F.col(day) <= end) & (F.col(day) > F.date_sub(end, d))).alias(str(d)) for d in windows])
    return wide.unpivot([], [str(d) for d in windows], "days", "n").select(F.col("days").cast("int").alias("days"), "n")

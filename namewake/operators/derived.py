"""What is shown of an assessed departure: its tape, bands, the state of its page, the reason that makes it a lead, its timeline, and when it is looked at."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Classes of venues, and words in titles that tell a template from a site.
RESALE, REGISTRAR_PARKING = "resale marketplace or reseller", "registrar default parking"
TEMPLATE = r"(?i)\b(?:parked|for sale|buy this domain|coming soon|under construction|welcome to nginx|default (?:web )?page|index of|just another wordpress|website builder|launching soon|placeholder|this domain)\b"


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def band(value: Column, steps: Mapping[int, str], rest: str) -> Column:
    """The name of the first step that the value does not exceed; null stays null."""
    out = F.lit(rest)
    for most in sorted(steps, reverse=True):
        out = F.when(value <= most, steps[most]).otherwise(out)
    return F.when(value.isNotNull(), out)


def derive(df: DataFrame, *, young: int = 90) -> DataFrame:
    """Adds tape, year_band, extension_band, length_band, page_state and lead_reason to assessed departures.

    ``tape``: from a registrar's own parking, aftermarket with a transfer after the departure (``transfer_after``), else builder; registered ``young`` days or less before it left: builder; from a
    resale venue: aftermarket; else noise. ``page_state`` reads page_checked, page_for_sale, page_parked, page_placeholder, page_active and page_status. ``lead_reason`` is null for what is
    no lead: kits of three or more and bulk moves, transfers in progress from elsewhere than a resale venue, and built sites that are relisted, templates, expiring or still parked.

    Reads also domain, venue_class, registered, departed, other_extensions, classification, basis, in_use, kit_size, bulk_migration, relisted, title, expiration, parking. Nulls are unknown.
    """
    flag = lambda c: _true(F.col(c))
    venue, kind = F.col("venue_class"), F.col("classification")
    age = F.date_diff("departed", "registered")
    tape = F.when(_true(venue == REGISTRAR_PARKING), F.when(flag("transfer_after"), "aftermarket").otherwise("builder")).when(_true(age <= young), "builder").when(_true(venue == RESALE), "aftermarket").otherwise("noise")
    state = (
        F.when(~flag("page_checked"), "site not checked")
        .when(flag("page_for_sale"), "for sale")
        .when(flag("page_parked"), "parked")
        .when(flag("page_placeholder"), "no site yet")
        .when(flag("page_active") & F.coalesce(F.col("page_status") < 400, F.lit(True)), "live site")
        .otherwise("no site yet")
    )
    out = df.withColumns(
        {
            "tape": tape,
            "year_band": band(F.year("registered"), {1999: "before 2000", 2009: "2000-2009", 2019: "2010-2019"}, "2020 or later"),
            "extension_band": F.when(F.col("other_extensions") >= 0, band(F.col("other_extensions"), {0: "0 other", 4: "1-4 other", 19: "5-19 other"}, "20+ other")),
            "length_band": band(F.length(F.substring_index("domain", ".", 1)), {4: "1-4", 6: "5-6", 8: "7-8", 11: "9-11"}, "12+"),
            "page_state": state,
        }
    )
    branded = F.when(flag("in_use"), "transfer + branded site").otherwise("marketplace exit + registrar transfer")
    by_basis = F.when(F.col("basis") == "built", "transfer + branded site").when(F.col("basis") == "transfer", "marketplace exit + registrar transfer").when(F.col("basis") == "off-market", "off market 14+ days").otherwise(branded)
    launched = (F.col("tape") == "builder") | ((F.col("tape") == "aftermarket") & _true(venue == RESALE))
    launched = launched & flag("in_use") & ~flag("relisted") & ~_true(F.col("title").rlike(TEMPLATE)) & ~flag("expiration") & ~flag("parking")
    reason = (
        F.when((F.coalesce("kit_size", F.lit(0)) >= 3) | flag("bulk_migration"), F.lit(None).cast("string"))
        .when(kind == "likely-sale", by_basis)
        .when(kind == "transfer-completed", branded)
        .when((kind == "transfer-in-progress") & _true(venue == RESALE), "transfer pending")
        .when((kind == "acquisition-candidate") & launched, "branded site launched")
    )
    return out.withColumn("lead_reason", reason)


def timelines(movements: DataFrame, observations: DataFrame, *, last: int = 11) -> DataFrame:
    """(domain, timeline): a domain's movement (domain, at, detail), then its ``last`` observations (domain, at, kind, detail), oldest first, as an array of structs.

    Observations beyond the last ones are cut by rank before anything is gathered; those without a detail say ``observed``, those without a kind are probes.
    """
    order = Window.partitionBy("domain").orderBy(F.desc("at"), F.desc("kind"), F.desc("detail"))
    told = F.when(F.coalesce("detail", F.lit("")) == "", "observed").otherwise(F.col("detail"))
    recent = observations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= last)
    entry = F.struct("first", (-F.col("place")).alias("order"), "at", "kind", "detail")
    rows = movements.select("domain", F.lit(0).alias("first"), F.lit(0).alias("place"), "at", F.lit("movement").alias("kind"), "detail")
    rows = rows.union(recent.select("domain", F.lit(1).alias("first"), "place", "at", F.coalesce("kind", F.lit("probe")).alias("kind"), told.alias("detail")))
    found = rows.groupBy("domain").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    return found.select("domain", F.transform("all", lambda e: F.struct(e["at"].alias("at"), e["kind"].alias("kind"), e["detail"].alias("detail"))).alias("timeline"))


def probe_order(df: DataFrame, *, sample: int = 3) -> DataFrame:
    """Adds ``priority``, lower first: unprobed departures, then unprobed members of kits, then the rest by the shape of their move.

    An unprobed one has -100 plus a score (0 if transferring, else 1 + twice ``alpha_rank`` + ``theme_rank``); members of a kit (``kit``, null for none) have -50 plus it, but the first ``sample`` of each
    kit by score and domain count as if in none. What expires or is suspended waits behind all (6 unprobed, 5 after). Of the others transfers are first (0), a likely sale is looked at again before them
    (-1), then sites in use and small moves to hosting (1), small moves elsewhere and middling ones to hosting (2), the unknown (3), and bulk moves (4).

    Reads domain, state, classification, probe_count, expiration, suspended, parking, buyer_use, page_error, moved_to (class, null without a movement), cohort, left_seller, kit, alpha_rank, theme_rank.
    """
    flag = lambda c: _true(F.col(c))
    cohort, to = F.coalesce("cohort", F.lit(0)), F.col("moved_to")
    gone = _true(F.col("classification").isin("expiration", "registry-hold"))
    shape = (
        F.when(F.col("state") == "transferring", 0)
        .when(gone | flag("expiration") | flag("suspended") | flag("parking"), 5)
        .when(_true(F.col("classification") == "likely-sale"), -1)
        .when(flag("buyer_use") & ~flag("page_error"), 1)
        .when(_true((cohort < 10) & (to == "hosting")), 1)
        .when(_true((cohort < 10) & (to == "other")), 2)
        .when(_true((cohort < 100) & (to == "hosting")), 2)
        .when(to.isNotNull() & (cohort >= 100), 4)
        .when(to.isNull() & flag("left_seller"), 4)
        .otherwise(3)
    )
    score = F.when(F.col("state") == "transferring", 0).otherwise(1 + 2 * F.coalesce("alpha_rank", F.lit(0)) + F.coalesce("theme_rank", F.lit(0)))
    deferred = gone | flag("expiration") | flag("suspended")
    unprobed = (F.coalesce("probe_count", F.lit(0)) == 0) & ~deferred
    scored = df.withColumns({"_score": score, "_waits": unprobed})
    order = Window.partitionBy("kit").orderBy("_score", "domain")
    first = scored.where(F.col("kit").isNotNull() & F.col("_waits")).select("kit", "domain", "_score").withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= sample).select("domain", F.lit(True).alias("_lifted"))
    lifted = scored.join(first, "domain", "left")
    tier = F.when(F.col("kit").isNull() | F.col("_lifted"), -100).otherwise(-50)
    unseen = F.coalesce("probe_count", F.lit(0)) == 0
    return lifted.withColumn("priority", F.when(F.col("_waits"), tier + F.col("_score")).when(unseen & deferred, 6).otherwise(shape)).drop("_score", "_waits", "_lifted")


def better_sales(offers: DataFrame) -> DataFrame:
    """(label, zone, ...): the one of the ``offers`` (label, zone, checked, live, for_sale, price, ends_at, url) for a name that research shows.

    Checked ones and those for sale come before others, then live ones, those for sale, those with a price, the lower price, the earlier end (none last), and the url. The choice
    is a minimum and combines before the shuffle.
    """
    off = lambda c: ~_true(F.col(c))
    order = F.struct(
        (off("checked") & off("for_sale")).alias("a"), off("live").alias("b"), off("for_sale").alias("c"), F.col("price").isNull().alias("d"), F.coalesce("price", F.lit(0.0)).alias("e"), F.col("ends_at").isNull().alias("f"), F.col("ends_at").alias("g"), F.col("url").alias("h")
    )
    rest = [c for c in offers.columns if c not in ("label", "zone")]
    return offers.groupBy("label", "zone").agg(F.min_by(F.struct(*rest), order).alias("best")).select("label", "zone", "best.*")


def merged_trends(observed: DataFrame, zones: DataFrame, limit: int) -> DataFrame:
    """(keyword, day, n_zones, new_zones, zones, source): keywords of two sources, (keyword, day, n_zones, new_zones, zones, source) each.

    Keywords are compared without case and outer blanks. Counts are the largest of either; day and zones are those of the newest row, of the ``observed`` source among equals; sources are named in that order. The
    ``limit`` newest and widest stay.
    """
    rows = observed.withColumn("_from", F.lit(0)).unionByName(zones.withColumn("_from", F.lit(1)))
    rows = rows.withColumn("keyword", F.lower(F.trim("keyword"))).where("keyword <> ''")
    newest = F.struct("day", (-F.col("_from")).alias("first"))
    own = F.struct("_from", "source")
    found = rows.groupBy("keyword").agg(F.max("day").alias("day"), F.max("n_zones").alias("n_zones"), F.max("new_zones").alias("new_zones"), F.max_by("zones", newest).alias("zones"), F.sort_array(F.collect_set(own)).alias("sources"))
    named = found.select("keyword", "day", "n_zones", "new_zones", "zones", F.array_join(F.array_distinct(F.transform("sources", lambda s: s["source"])), "+").alias("source"))
    return named.orderBy(F.desc("day"), F.desc("new_zones"), F.desc("n_zones"), "keyword").limit(limit)


def facet_counts(rows: DataFrame, facets: Mapping[str, Column]) -> DataFrame:
    """(facet, value, n): how many rows have each value of each facet, in one pass; unknown values are left out."""
    each = F.array_compact(F.array(*[F.when(value.isNotNull(), F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"))) for name, value in facets.items()]))
    return rows.select(F.explode(each).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def split_counts(words: DataFrame, most: int = 3) -> DataFrame:
    """(words, n, share): how many labels (label, n_words; 0 or null for invented ones) are made of one word, two ... up to ``most``, and of none."""
    made = F.when(F.coalesce("n_words", F.lit(0)).between(1, most), F.col("n_words").cast("string")).otherwise("invented")
    counts = words.groupBy(made.alias("words")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("words", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # a row for each number

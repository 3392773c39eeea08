"""What a departure from sale infrastructure means: facts about the move, and an ordered ladder of rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of name servers, statuses of a registry, and the classifications that make up the views of the ledger.
SALE_CLASSES, ORDINARY_CLASSES = ["seller", "parking"], ["registrar", "hosting"]
DELETION = ["redemptionperiod", "pendingdelete"]
LEADS = ["likely-sale", "acquisition-candidate", "seller-departure", "transfer-in-progress", "transfer-completed", "transferred-and-built"]
FOCUS = ["likely-sale", "acquisition-candidate", "transfer-in-progress", "transfer-completed", "transferred-and-built"]
ALPHA = ["likely-sale", "acquisition-candidate"]
TIERS = ["transfer", "probable", "suspected", "excluded"]


def _within(a: Column, b: Column, days: int) -> Column:
    """Whether two times are known and at most some days apart."""
    return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) <= days * 86_400_000_000, F.lit(False))


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def destination_identity(df: DataFrame) -> DataFrame:
    """Adds ``title_aligned``, ``heading_aligned``, ``redirect_aligned``, ``template_title``, ``attributed`` and ``aligned`` to (domain, title, heading, final_host).

    A label of four or more letters and digits is looked for anywhere in the title or heading without the full name, a shorter one (of two or more) as a word. A title of
    the name, a separator and something without the label is a template and proves nothing; nor does "label by, at, from or inside ..." on another host. A
    redirect to another host with the same label does. Nulls count as empty.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    compact = lambda text: F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    domain, title, heading, final = low("domain"), F.trim(low("title")), low("heading"), low("final_host")
    label = compact(F.substring_index(domain, ".", 1))
    words = lambda text: F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9]+", " "), F.lit(" "))
    holds = lambda text: F.when(F.length(label) >= 4, F.contains(compact(text), label)).when(F.length(label) >= 2, F.contains(words(text), F.concat(F.lit(" "), label, F.lit(" ")))).otherwise(False)
    bare = F.when(F.startswith(title, F.lit("www.")), F.substring(title, F.lit(5), F.length(title))).otherwise(title)
    rest = F.when(F.startswith(bare, domain), F.substring(bare, F.length(domain) + 1, F.length(bare)))
    after = F.regexp_extract(rest, r"^(?: - | \| | — | – |: )(.*)$", 1)
    template = _true(rest.rlike(r"^(?: - | \| | — | – |: )") & ~holds(after)) & (domain != "")
    without = lambda text: F.when(domain != "", F.replace(text, domain, F.lit(""))).otherwise(text)
    elsewhere = (final != "") & (final != F.regexp_replace(domain, r"^www\.", ""))
    redirect = elsewhere & (compact(F.substring_index(final, ".", 1)) == label) & (F.length(label) >= 2)
    shown = F.trim(F.regexp_replace(F.substring_index(domain, ".", 1), "[-_]+", " "))
    by = lambda text: (shown != "") & F.startswith(text, F.concat(shown, F.lit(" "))) & F.substring(text, F.length(shown) + 1, F.length(text)).rlike(r"^\s+(?:by|at|from|inside)\s+")
    attributed = ~redirect & elsewhere & (by(title) | by(F.trim(heading)))
    told = ~template & ~attributed
    out = df.withColumns({"template_title": template, "attributed": attributed, "redirect_aligned": redirect})
    out = out.withColumns({"title_aligned": told & holds(without(title)), "heading_aligned": told & holds(without(heading))})
    return out.withColumn("aligned", F.col("title_aligned") | F.col("heading_aligned") | F.col("redirect_aligned"))


def learned_platforms(departures: DataFrame, *, daily: int, trailing: int, days: int) -> DataFrame:
    """(hosts_key, day) of destinations that take in ``daily`` departures on a day, or ``trailing`` over the ``days`` before it: an operator that is in no catalogue.

    ``departures`` are (hosts_key, day), counted by day first.
    """
    counts = departures.groupBy("hosts_key", "day").agg(F.count("*").alias("n"))
    past = counts.select("hosts_key", F.col("day").alias("on"), F.col("n").alias("was")).alias("p")
    near = counts.alias("c").join(past, (F.col("c.hosts_key") == F.col("p.hosts_key")) & F.date_diff("c.day", "p.on").between(1, days), "left")
    sums = near.groupBy("c.hosts_key", "c.day", "c.n").agg(F.coalesce(F.sum("was"), F.lit(0)).alias("before"))
    return sums.where((F.col("n") >= daily) | (F.col("before") >= trailing)).select("hosts_key", "day")


def sale_facts(df: DataFrame, now: Column) -> DataFrame:
    """Adds what the ladder asks about a departure. Flags that are null or unknown times make a fact false.

    Reads departure_day, prev_day, move_day, last_changed (days); prev_class, today_class, cohort, kit_size, seller_hosts and today_hosts (numbers of name servers);
    moved, buyer_use, aligned, site_kind, for_sale, suspended, platform, expiry_origin, expiry_destination, mandated, registrar_origin, prior_listing, relisted; statuses,
    registrar_id, registrar, transfer_at, checked_at, observed_at, lookup_failed and their prev_ values from the look before (prev_statuses, prev_registrar_id, prev_registrar,
    prev_observed_at); recorded_change_at, the time of a change of registrar that is on file.

    A move seen over several days is dated by the registry's last change if that lies in them. A change of registrar counts if both looks have numbers that differ,
    or a pending transfer has ended under another name, within 14 days. What was seen more than three days ago, or after ``now``, is stale.
    """
    flag = lambda c: _true(F.col(c))
    pending = lambda c: _true(F.array_contains(c, "pendingtransfer"))
    several = F.date_diff("move_day", "prev_day") > 1
    dated = several & (F.col("last_changed") > F.col("prev_day")) & (F.col("last_changed") <= F.col("move_day"))
    out = df.withColumn("departed", F.when(_true(dated), F.col("last_changed")).otherwise(F.col("departure_day")))
    day = F.col("departed").cast("timestamp")
    numbers = F.col("prev_registrar_id").isNotNull() & F.col("registrar_id").isNotNull()
    ended = pending("prev_statuses") & ~pending("statuses") & (F.lower("prev_registrar") != F.lower("registrar"))
    changed = F.when(numbers, F.col("prev_registrar_id") != F.col("registrar_id")).otherwise(_true(ended))
    seen = F.coalesce("observed_at", "checked_at")
    age = F.unix_micros(now) - F.unix_micros(seen)
    out = out.withColumns(
        {
            "pending": pending("statuses"),
            "expiration": flag("expiry_origin") | flag("expiry_destination") | _true(F.arrays_overlap(F.col("statuses"), F.array(*[F.lit(s) for s in DELETION]))),
            "recent_transfer": _within(F.col("transfer_at"), day, 7),
            "transfer_14": _within(F.col("transfer_at"), day, 14),
            "registrar_changed": ~flag("lookup_failed") & changed & _within(F.col("prev_observed_at"), F.col("checked_at"), 14),
            "recorded_change": _within(F.col("recorded_change_at"), day, 30),
            "stale": F.coalesce((age > 3 * 86_400_000_000) | (age < -86_400_000_000), F.lit(True)),
            "bulk_migration": (F.coalesce("cohort", F.lit(0)) >= 10) & ~_true(F.col("today_class").isin(ORDINARY_CLASSES)),
            "bulk_adoption": F.coalesce("kit_size", F.lit(0)) >= 3,
            "seller_origin": flag("prior_listing") | _true(F.col("prev_class").isin(SALE_CLASSES) & (F.col("seller_hosts") > 0)),
            "days_since": F.coalesce(F.floor((F.unix_micros(now) - F.unix_micros(day)) / F.lit(86_400_000_000)), F.lit(0)),
        }
    )
    changes = F.col("registrar_changed") | F.col("recorded_change")
    clean = ~flag("for_sale") & ~F.col("expiration") & ~flag("suspended") & ~flag("platform") & ~F.col("bulk_migration") & ~F.col("bulk_adoption")
    ordinary = _true(F.col("prev_class").isin(ORDINARY_CLASSES) & (F.col("seller_hosts") > 0))
    near = F.col("transfer_14") | F.col("pending") | changes
    market = _true(F.col("prev_class") == "seller")
    return out.withColumns(
        {
            "changed_hands": changes | F.col("recent_transfer"),
            "near_transfer": near,
            "clean": clean,
            "in_use": flag("moved") & flag("buyer_use") & flag("aligned") & _true(F.col("site_kind") == "operating") & ~flag("for_sale") & ~F.col("expiration") & ~flag("suspended"),
            "owner_migration": flag("moved") & ordinary & flag("mandated") & near & ~flag("prior_listing"),
            "off_market": market & flag("moved") & clean & _true(F.col("today_class").isin("registrar", "hosting", "other")) & (F.col("days_since") >= 14) & ~flag("relisted"),
            "just_left": flag("moved") & market & (F.coalesce("today_hosts", F.lit(0)) > 0) & ~F.col("bulk_migration") & ~F.col("stale") & _within(day, now, 3),
        }
    )


def assess(df: DataFrame, now: Column) -> DataFrame:
    """Adds ``tier``, ``classification`` and ``basis`` (of a likely sale; null else) by the first rule that holds, with the facts of ``sale_facts``.

    A reported sale (``reported_tier``) stays what it is. A lead from ordinary name servers, with no listing on file, is the owner's own move and excluded.
    """
    flag = lambda c: _true(F.col(c))
    facts = sale_facts(df, now)
    c = F.col
    fresh, market = ~c("stale"), _true(c("prev_class") == "seller")
    bulk = c("bulk_migration") | c("bulk_adoption")
    rules = [
        (c("expiration"), "excluded", "expiration", None),
        (flag("suspended"), "excluded", "registry-hold", None),
        (bulk & fresh, "suspected", "portfolio-kit", None),
        (c("pending") & fresh, "transfer", "transfer-in-progress", None),
        (flag("platform"), "excluded", "platform-destination", None),
        (flag("for_sale"), "excluded", "lander-migration", None),
        (c("owner_migration"), "excluded", "owner-migration", None),
        (market & flag("moved") & c("near_transfer") & c("clean") & ~flag("relisted"), "probable", "likely-sale", "transfer"),
        (flag("moved") & _true(c("seller_hosts") > 0) & ~flag("registrar_origin") & c("in_use") & ~bulk & c("changed_hands") & ~flag("relisted"), "probable", "likely-sale", "built"),
        (c("off_market"), "probable", "likely-sale", "off-market"),
        (flag("registrar_origin") & flag("moved") & c("in_use") & c("changed_hands") & ~bulk & fresh, "suspected", "transferred-and-built", None),
        (flag("moved") & c("changed_hands") & ~c("bulk_adoption") & fresh, "transfer", "transfer-completed", None),
        (c("in_use") & ~flag("registrar_origin") & fresh, "suspected", "acquisition-candidate", None),
        (c("just_left"), "suspected", "seller-departure", None),
    ]
    tier, kind, basis = F.lit("suspected"), F.lit("unconfirmed-move"), F.lit(None).cast("string")
    for test, *values in reversed(rules):
        tier, kind, basis = (F.when(test, F.lit(value).cast("string")).otherwise(rest) for value, rest in zip(values, (tier, kind, basis), strict=True))
    reported = c("reported_tier").isNotNull()
    judged = facts.withColumns({"tier": F.when(reported, c("reported_tier")).otherwise(tier), "classification": F.when(reported, "reported-sale").otherwise(kind), "basis": F.when(~reported, basis)})
    own_move = ~reported & c("tier").isin("probable", "suspected") & _true(c("seller_hosts") > 0) & ~flag("expiry_origin") & ~c("seller_origin")
    last = {"tier": F.when(own_move, "excluded").otherwise(c("tier")), "classification": F.when(own_move, "no-seller-origin").otherwise(c("classification")), "basis": F.when(~own_move, c("basis"))}
    return judged.select(*[last[x].alias(x) if x in last else c(x) for x in judged.columns])


def views(df: DataFrame) -> DataFrame:
    """A row for each ``view`` that an assessed row (tier, classification, expiration, name_quality, spam, kit_size) belongs to: all, leads, alpha, focus and its tier.

    Reported sales are in none. Alpha are likely sales and acquisition candidates of names of the first quality, without spam, that are in no kit of three or more.
    """
    kind = F.col("classification")
    good = kind.isin(ALPHA) & _true(F.col("name_quality") == "alpha") & ~_true(F.col("spam")) & (F.coalesce("kit_size", F.lit(0)) < 3)
    names = F.array(F.lit("all"), F.when(kind.isin(LEADS) & ~_true(F.col("expiration")), "leads"), F.when(good, "alpha"), F.when(kind.isin(FOCUS), "focus"), F.when(F.col("tier").isin(TIERS), F.col("tier")))
    return df.where(kind != "reported-sale").withColumn("view", F.explode(F.array_compact(names)))

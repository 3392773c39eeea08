"""Sites that one operator runs: shared keys, title templates over runs of days, and the networks that result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import stored

# Latin letters with marks and those without.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def linked(sites: DataFrame, links: DataFrame) -> DataFrame:
    """(site, operator): ``sites`` (site) that share a key of ``links`` (site, key), directly or over others, named by the smallest of them.

    Sites and keys form a bipartite graph; the smallest site is passed over keys, pre-aggregated, until nothing changes. A key that all sites have is
    a hub like any other. Null keys link nothing. Tables of a round are merged by sorting, so that none of them passes through the driver.
    """
    edges = stored(links.where("key is not null").select("site", "key").distinct())
    labels = stored(sites.select("site").distinct().withColumn("operator", F.col("site")))
    while True:
        by_key = edges.join(labels.hint("merge"), "site").groupBy("key").agg(F.min("operator").alias("least"))
        by_site = edges.join(by_key.hint("merge"), "key").groupBy("site").agg(F.min("least").alias("least"))
        step = labels.join(by_site.hint("merge"), "site", "left").select("site", F.col("operator").alias("old"), F.least("operator", F.coalesce("least", "operator")).alias("operator"))
        root = labels.select(F.col("site").alias("operator"), F.col("operator").alias("root"))
        new = stored(step.join(root.hint("merge"), "operator", "left").select("site", "old", F.least("operator", F.coalesce("root", "operator")).alias("operator")))
        labels = new.select("site", "operator")
        if new.where("operator <> old").isEmpty():
            return labels


def title_letters(title: Column, label: Column) -> Column:
    """A title's letters and digits, without marks and without the site's own label of three or more letters."""
    plain = F.translate(F.lower(F.coalesce(title, F.lit(""))), MARKED, PLAIN)
    return F.regexp_replace(F.when(F.length(label) >= 3, F.replace(plain, label, F.lit(" "))).otherwise(plain), "[^a-z0-9]+", "")


def site_keys(sites: DataFrame, generic: Sequence[str] = ()) -> DataFrame:
    """(site, key) of ``sites`` (site, label, title, skeleton): the label, a numbered label with its numbers as one mark, the title, and a title with the page's skeleton.

    Titles of under six letters (four, with a skeleton) and ``generic`` ones are no keys.
    """
    series = F.regexp_replace("label", "[0-9]+", "#")
    numbered = F.col("label").rlike("[0-9]") & (F.length(F.regexp_replace(series, "[#-]", "")) >= 2)
    title, bare = title_letters(F.col("title"), F.col("label")), title_letters(F.col("title"), F.lit(""))
    keys = F.array(
        F.concat(F.lit("l:"), "label"),
        F.when(numbered, F.concat(F.lit("n:"), series)),
        F.when((F.length(title) >= 6) & ~title.isin(*generic, ""), F.concat(F.lit("t:"), title)),
        F.when((F.length(bare) >= 4) & ~bare.isin(*generic, ""), F.concat(F.lit("f:"), bare, F.lit("|"), "skeleton")),
    )
    return sites.select("site", F.explode(F.array_compact(keys)).alias("key"))


def template_keys(sites: DataFrame, stop: Sequence[str], *, run: int = 4) -> DataFrame:
    """(site, day, key) of ``sites`` (site, day, label, title, brand): what titles of one template share, with numbers as one mark.

    Keys are runs of ``run`` words with two or more that carry meaning, and the whole title with the words of ``brand`` (an array) as one mark, if three carry meaning.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    marked = F.transform(words, lambda w: F.when(F.rlike(w, F.lit(r"\p{N}")), "#").otherwise(w))

    def once(marks: Sequence[str]):
        return lambda all_: F.filter(all_, lambda w, i: ~(w.isin(*marks) & (i > 0) & (w == F.get(all_, i - 1))))

    content = lambda ws: F.size(F.filter(ws, lambda w: ~w.isin("#", "*", *stop) & (F.length(w) >= 2)))
    rows = sites.withColumn("_w", marked).withColumn("_w", once(["#"])(F.col("_w")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - run + 1, F.lit(1))), lambda i: F.slice("_w", i, run))
    grams = F.transform(F.filter(runs, lambda g: (F.size(g) == run) & (content(g) >= 2)), lambda g: F.concat(F.lit("g:"), F.array_join(g, " ")))
    rows = rows.withColumn("_s", F.transform("_w", lambda w: F.when(F.array_contains("brand", w), "*").otherwise(w))).withColumn("_s", once(["*", "#"])(F.col("_s")))
    whole = F.when(content(F.col("_s")) >= 3, F.array(F.concat(F.lit("s:"), F.array_join("_s", " ")))).otherwise(F.array().cast("array<string>"))
    return rows.select("site", "day", F.explode(F.array_distinct(F.concat(grams, whole))).alias("key"))


def template_runs(keys: DataFrame, least: int = 8) -> DataFrame:
    """(site, key, start): members of a template over a run of consecutive days with ``least`` sites or more; ``start`` is the run's first day.

    Days are counted first, so that what is ordered by key are its days, not its sites.
    """
    days = keys.groupBy("key", "day").agg(F.count_distinct("site").alias("n"))
    order = Window.partitionBy("key").orderBy("day")
    island = F.date_add("day", -F.row_number().over(order))  # the same for consecutive days
    runs = days.withColumn("_run", island)
    big = runs.groupBy("key", "_run").agg(F.sum("n").alias("sites"), F.min("day").alias("start")).where(F.col("sites") >= least)
    return keys.join(runs.join(big, ["key", "_run"]).select("key", "day", "start"), ["key", "day"]).select("site", "key", "start")


def resolve_networks(sites: DataFrame, stop: Sequence[str], *, generic: Sequence[str] = (), least: int = 8, kit: int = 25) -> tuple[DataFrame, DataFrame]:
    """Operators (site, operator) of ``sites`` (site, day, label, title, skeleton, brand), and the networks among them.

    Networks (operator, sites, template, via, first_day, last_day, spam_kit) have ``least`` sites or more; ``via`` tells whether runs of words, whole titles or
    only keys tie them, ``template`` is the first in order; from ``kit`` sites on they are spam kits.
    """
    runs = stored(template_runs(template_keys(sites, stop), least))
    links = site_keys(sites, generic).union(runs.select("site", F.concat_ws("@", F.lit("T"), "key", F.col("start").cast("string")).alias("key")))
    operators = linked(sites, links)
    templates = runs.join(operators, "site").groupBy("operator").agg(F.min("key").alias("key"))
    groups = sites.join(operators, "site").groupBy("operator").agg(F.count_distinct("site").alias("sites"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).where(F.col("sites") >= least)
    via = F.when(F.col("key").isNull(), "key").when(F.startswith("key", F.lit("g:")), "shingle").otherwise("skeleton")
    named = groups.join(templates, "operator", "left")
    return operators, named.select("operator", "sites", F.substring("key", 3, 1 << 20).alias("template"), via.alias("via"), "first_day", "last_day", (F.col("sites") >= kit).alias("spam_kit"))

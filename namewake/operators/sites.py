"""Observed web pages: features, classes, kits and the public feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Phrases that class a page, in the order of the rules.
FOR_SALE = r"(?i)(domain (name )?(is |may be )?for sale|buy this domain|make an offer)"
PARKED = r"(?i)(parked (free|domain)|related searches|sponsored listings)"
PLACEHOLDER = r"(?i)(coming soon|under construction|default web page|welcome to nginx)"
GENERIC_TITLE = r"(?i)^(home|index|untitled|welcome|default|page|new page|site)?$"


def _tag(html: Column, tag: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)


def _text(html: Column) -> Column:
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for name, char in (("&amp;", "&"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def page_features(pages: DataFrame) -> DataFrame:
    """(page_id, host, title, heading, text_length, tags, skeleton, fingerprint) from url and html.

    The skeleton is the hash of the sequence of opened tags, runs of one tag made one; the fingerprint that of title and skeleton.
    """
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]*)", 1))
    tags = F.regexp_extract_all(F.lower("html"), F.lit(r"<([a-z][a-z0-9]*)"), 1)
    joined = F.regexp_replace(F.array_join(tags, " "), r"\b(\w+)( \1\b)+", "$1")
    title = _text(_tag(F.col("html"), "title"))
    out = pages.select("page_id", host.alias("host"), title.alias("title"), _text(_tag(F.col("html"), "h1")).alias("heading"), F.length(_text(F.col("html"))).alias("text_length"), F.size(tags).alias("tags"), F.sha1(joined).alias("skeleton"))
    return out.withColumn("fingerprint", F.sha1(F.concat_ws("|", F.lower("title"), "skeleton")))


def template_title(title: Column, name: Column) -> Column:
    """A title with the site's name taken out and digits made one mark, for comparing sites of one kit."""
    without = F.replace(F.lower(title), F.lower(name), F.lit("{name}"))
    return F.trim(F.regexp_replace(F.regexp_replace(without, r"\d+", "#"), r"\s+", " "))


def classify_sites(obs: DataFrame) -> DataFrame:
    """Adds ``class``: error, redirect_offsite, for_sale, parked, placeholder or built, by the first rule that fits (status, final_host, host, title, text)."""
    text = F.concat_ws(" ", "title", "text")
    offsite = F.col("final_host").isNotNull() & (F.col("final_host") != F.col("host"))
    rules = [
        (F.col("status").isNull() | (F.col("status") >= 400), "error"),
        (offsite, "redirect_offsite"),
        (text.rlike(FOR_SALE), "for_sale"),
        (text.rlike(PARKED), "parked"),
        (text.rlike(PLACEHOLDER) | F.coalesce(F.col("title").rlike(GENERIC_TITLE), F.lit(True)) & (F.length("text") < 200), "placeholder"),
    ]
    out = F.lit("built")
    for test, name in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return obs.withColumn("class", out)


def collapse_kits(obs: DataFrame, *, template: int = 5, title: int = 8) -> DataFrame:
    """Adds kit, kit_size and basis to (day, site, host, title, skeleton): one title and skeleton on ``template`` sites of a day, else one real
    title on ``title`` sites. Titles are compared as ``template_title``. Null where neither holds."""
    obs = obs.withColumn("_t", template_title(F.col("title"), F.col("host")))
    by_template = obs.groupBy("day", "_t", "skeleton").agg(F.count_distinct("site").alias("n_template"))
    by_title = obs.groupBy("day", "_t").agg(F.count_distinct("site").alias("n_title"))
    real = F.length(F.regexp_replace("_t", r"[^\p{L}\p{N}]+", "")) >= 4
    rows = obs.join(by_template, ["day", "_t", "skeleton"], "left").join(by_title, ["day", "_t"], "left")
    basis = F.when(F.col("n_template") >= template, "template").when(real & (F.col("n_title") >= title), "title")
    rows = rows.withColumn("basis", basis)
    key = F.when(F.col("basis") == "template", F.concat_ws("|", F.lit("template"), "_t", "skeleton")).when(F.col("basis") == "title", F.concat_ws("|", F.lit("title"), "_t"))
    size = F.when(F.col("basis") == "template", F.col("n_template")).when(F.col("basis") == "title", F.col("n_title"))
    return rows.withColumn("kit", F.substring(F.sha1(key), 1, 12)).withColumn("kit_size", size).drop("n_template", "n_title", "_t")


def publishable(obs: DataFrame, repeats: int = 8) -> DataFrame:
    """Built pages with a real title that fewer than ``repeats`` pages of the day have, and no kit."""
    same = F.count("*").over(Window.partitionBy("day", F.lower("title")))
    return obs.withColumn("_same", same).where((F.col("class") == "built") & ~F.col("title").rlike(GENERIC_TITLE) & F.col("kit").isNull() & (F.col("_same") < repeats)).drop("_same")


def feed(obs: DataFrame, *, q: str, exclude: str | None = None, zone: str | None = None, days: tuple[Column, int] | None = None, snippet: int = 40) -> DataFrame:
    """Rows whose title or text holds ``q`` but not ``exclude``, with the text around the first place.

    ``zone`` asks for hosts that end in it, ``days`` (the last day, how many) for rows of the days up to that one; days are numbers.
    """
    obs = obs.where(F.substring_index("host", ".", -1) == zone) if zone else obs
    obs = obs.where((F.col("day") <= days[0]) & (F.col("day") > days[0] - days[1])) if days else obs
    text = F.lower(F.concat_ws(" ", "title", "text"))
    out = obs.where(F.contains(text, F.lit(q.lower())))
    out = out.where(~F.contains(text, F.lit(exclude.lower()))) if exclude else out
    at = F.instr(text, q.lower())
    return out.withColumn("snippet", F.substring(F.concat_ws(" ", "title", "text"), F.greatest(at - snippet, F.lit(1)), F.lit(2 * snippet + len(q))))


def identity_match(df: DataFrame) -> DataFrame:
    """Adds ``match``: the label, of four letters or digits or more, stands in the title without the full name; a shorter one must be a word."""
    label = F.regexp_replace(F.lower("label"), "[^a-z0-9]", "")
    title = F.replace(F.lower("title"), F.lower("name"), F.lit(" "))
    packed = F.regexp_replace(title, "[^a-z0-9]", "")
    words = F.concat(F.lit(" "), F.regexp_replace(title, "[^a-z0-9]+", " "), F.lit(" "))
    short = F.contains(words, F.concat(F.lit(" "), label, F.lit(" ")))
    return df.withColumn("match", F.when(label == "", False).when(F.length(label) >= 4, F.contains(packed, label)).otherwise(short))

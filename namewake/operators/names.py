"""Text analytics of labels and pages as corpus jobs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .networks import linked
from .ranking import saved

LABEL = r"^(?!-)[a-z0-9_-]{1,63}(?<!-)$"


def normalize_feed(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Accepted names of a feed, once each, and one accounting row (input, empty, invalid, duplicate, accepted)."""
    name = F.regexp_replace(F.lower(F.trim(column)), r"\.$", "")
    valid = F.forall(F.split(name, r"\."), lambda x: x.rlike(LABEL)) & F.contains(name, F.lit(".")) & (F.length(name) <= 253)
    rows = lines.select(name.alias("name"), (F.coalesce(name, F.lit("")) == "").alias("empty"), F.coalesce(valid, F.lit(False)).alias("valid"))
    good = rows.where("valid").groupBy("name").agg(F.count("*").alias("times"))
    first = rows.agg(F.count("*").alias("input"), F.count_if("empty").alias("empty"), F.count_if(~F.col("empty") & ~F.col("valid")).alias("invalid"))
    second = good.agg(F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("duplicate"), F.count("*").alias("accepted"))
    return good.select("name"), first.crossJoin(second)  # one row each


def flatten_dropped(payloads: DataFrame, column: str, zones: Sequence[str]) -> DataFrame:
    """(name, zone): names from JSON arrays, from objects with an array under a known key, or from the first cell of a CSV line; the zone
    is the longest of ``zones`` that ends the name."""
    keys = ["domains", "data", "results", "items", "records"]
    arrays = [F.from_json(F.get_json_object(column, f"$.{k}"), "array<string>") for k in keys]
    listed = F.coalesce(F.from_json(F.when(F.ltrim(column).startswith("["), F.col(column)), "array<string>"), *arrays, F.array(F.split_part(F.col(column), F.lit(","), F.lit(1))))
    name = F.regexp_replace(F.lower(F.trim("item")), r"\.$", "")
    names = payloads.select(F.explode(listed).alias("item")).select(name.alias("name")).where(F.col("name").rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$")).distinct()
    fits = F.filter(F.array(*[F.lit(z) for z in sorted(zones, key=lambda z: (-len(z), z))]), lambda z: F.endswith("name", F.concat(F.lit("."), z)))
    return names.select("name", F.get(fits, F.lit(0)).alias("zone")).where("zone is not null")


def segment_greedy(labels: DataFrame, words: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(label, pieces): the longest dictionary word at each place, up to 18 letters; an unknown run is ``?``.

    Words of under four letters count only at the end of a label or when in ``extra``. A run ends where any word of three letters or more starts.
    """
    distinct = labels.select("label").distinct()
    ends = F.explode(F.sequence(F.lit(2), F.least(F.lit(18), F.length("label") - F.col("at") + 1)))
    starts = distinct.where(F.length("label") >= 2).select("label", F.explode(F.sequence(F.lit(1), F.length("label") - 1)).alias("at"))
    spans = starts.select("label", "at", ends.alias("size")).withColumn("entry", F.expr("substr(label, at, size)"))
    hits = spans.join(words.select("entry").distinct(), "entry")
    usable = (F.col("size") >= 4) | (F.col("at") + F.col("size") - 1 == F.length("label")) | F.col("entry").isin(*extra, "")
    best = hits.where(usable).groupBy("label", "at").agg(F.max("size").alias("size"))
    best_map = best.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("best"))
    any_start = hits.where(F.col("size") >= 3).groupBy("label").agg(F.sort_array(F.collect_set("at")).alias("starts"))
    rows = distinct.join(best_map, "label", "left").join(any_start, "label", "left")
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(acc: Column, i: Column) -> Column:
        size = F.try_element_at("best", i)
        after = F.coalesce(F.get(F.filter("starts", lambda s: s > i), F.lit(0)), F.length("label") + 1)
        word = F.struct((i + size).alias("at"), F.concat(acc["pieces"], F.array(F.substring("label", i, size))).alias("pieces"))
        unknown = F.struct(after.alias("at"), F.concat(acc["pieces"], F.array(F.lit("?"))).alias("pieces"))
        return F.when(i < acc["at"], acc).when(size.isNotNull(), word).otherwise(unknown)

    walked = F.aggregate(F.sequence(F.lit(1), F.length("label")), state, step)
    return rows.where("label <> ''").select("label", walked["pieces"].alias("pieces"))


def label_ngrams(segments: DataFrame, longest: int = 3) -> DataFrame:
    """(label, token): the runs of one to three words of a label, without unknown pieces, and the label without hyphens."""
    known = F.filter("pieces", lambda p: (p != "?") & (p != "-"))
    rows = segments.select("label", known.alias("w"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))))
    sized = F.when(F.size("w") > 0, F.filter(grams, lambda g: g != "")).otherwise(F.array().cast("array<string>"))
    return rows.select("label", F.explode(F.array_distinct(F.concat(sized, F.array(F.replace("label", F.lit("-"), F.lit("")))))).alias("token"))


def name_types(segments: DataFrame, *, stop: Sequence[str] = (), least: int = 8) -> DataFrame:
    """(kind, n, share): suffix, prefix and word-pair types of labels made of two known words or more, on at least ``least`` labels; share per 1000 labels."""
    known = F.filter("pieces", lambda p: p != "?")
    covered = F.aggregate(known, F.lit(0), lambda n, p: n + F.length(p)) >= 0.75 * F.length(F.replace("label", F.lit("-"), F.lit("")))
    rows = segments.select("label", known.alias("w"), covered.alias("covered")).where("covered AND size(w) >= 2").select("label", "w")
    fine = lambda w, n: ~w.isin(*stop, "") & (F.length(w) >= n)
    first, final = F.element_at("w", 1), F.element_at("w", -1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.when(fine(F.element_at("w", i), 3) & fine(F.element_at("w", i + 1), 3), F.concat(F.lit("theme:"), F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1))))
    kinds = F.concat(F.array(F.when(fine(final, 2), F.concat(F.lit("suffix:*"), final)), F.when(fine(first, 2), F.concat(F.lit("prefix:"), first, F.lit("*")))), pairs)
    total = segments.agg(F.count("*").alias("total"))
    counts = rows.select(F.explode(F.array_distinct(F.array_compact(kinds))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(F.broadcast(total)).select("kind", "n", F.round(1000.0 * F.col("n") / F.col("total"), 6).alias("share"))  # one row


def mine_fragments(labels: DataFrame, *, least: int = 4, shortest: int = 4, longest: int = 12, nested: float = 0.7) -> DataFrame:
    """(fragment, support, contexts): substrings on ``least`` labels or more, level by level: a fragment is only extended where it is frequent.

    A fragment is left out if one a letter longer has ``nested`` of its support. ``contexts`` counts the different surroundings, runs of digits taken as one.
    """
    distinct = labels.select("label").distinct()
    places = distinct.where(F.length("label") >= shortest).select("label", F.explode(F.sequence(F.lit(1), F.length("label") - shortest + 1)).alias("at"))
    level, levels, size = places, [], shortest
    while size <= longest:
        cut = level.where(F.col("at") + size - 1 <= F.length("label")).withColumn("fragment", F.expr(f"substr(label, at, {size})"))
        frequent = cut.groupBy("fragment").agg(F.count_distinct("label").alias("support")).where(F.col("support") >= least)
        kept = saved(cut.join(frequent, "fragment"))
        if kept.isEmpty():
            break
        around = F.concat(F.expr("substr(label, 1, at - 1)"), F.lit("|"), F.expr(f"substr(label, at + {size})"))
        levels.append(kept.withColumn("around", F.regexp_replace(around, "[0-9]+", "#")).groupBy("fragment", "support").agg(F.count_distinct("around").alias("contexts")))
        level, size = kept.select("label", "at"), size + 1
    if not levels:
        return distinct.select(F.col("label").alias("fragment"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("contexts")).limit(0)
    every = levels[0]
    for more in levels[1:]:
        every = every.union(more)
    grown = every.where(F.length("fragment") > shortest)
    covers = grown.select(F.explode(F.array(F.expr("substr(fragment, 1, length(fragment) - 1)"), F.expr("substr(fragment, 2)"))).alias("fragment"), F.col("support").alias("above"))
    above = covers.groupBy("fragment").agg(F.max("above").alias("above"))
    return every.join(above, "fragment", "left").where(F.col("above").isNull() | (F.col("above") < nested * F.col("support"))).select("fragment", "support", "contexts")


def first_terms(phrases: Sequence[str], stop: frozenset[str], most: Sequence[int]) -> list[tuple[int, str, int, int]]:
    """(words, term, phrase, place in it) of a text's first distinct words and word pairs, at most ``most`` of each; what follows them is not looked at."""
    found: tuple[dict, dict] = {}, {}
    for p, phrase in enumerate(phrases):
        last = None
        for i, word in enumerate(filter(None, phrase.split(" "))):
            word_or_none = word if len(word) >= 3 and word not in stop else None
            for terms, limit, term, at in ((found[0], most[0], word_or_none, i), (found[1], most[1], last and word_or_none and f"{last} {word}", i - 1)):
                if term and len(terms) < limit:
                    terms.setdefault(term, (p, at))
            last = word_or_none
        if all(len(terms) >= limit for terms, limit in zip(found, most, strict=True)):
            break
    return [(n, term, *at) for n, terms in enumerate(found, 1) for term, at in terms.items()]


def text_terms(pages: DataFrame, stop: Sequence[str], *, key: str, unigrams: int = 60, bigrams: int = 40) -> DataFrame:
    """(key, term, place, words): the first distinct words and word pairs of a text, in order; pairs don't reach over stop words or punctuation.

    A text is cut to its first terms before anything is shuffled; rows of one key are one text, and its first terms are among those of its rows.
    """
    stops, most, kind = frozenset(stop), (unigrams, bigrams), dict(pages.dtypes)[key]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # what a task holds as Python objects
                part = batch.slice(at, 256)
                found = [(row, *term) for row, phrases in enumerate(part.column(1).to_pylist()) for term in first_terms(phrases, stops, most)]
                rows, *columns = zip(*found, strict=True) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, columns, types)], names=[key, "words", "term", "p", "i"])

    types = [pa.int32(), pa.string(), pa.int32(), pa.int32()]
    phrases = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}' ]+"), lambda p: F.trim(p) != "")
    cut = pages.where("text is not null").select(key, phrases).mapInArrow(first, f"{key} {kind}, words int, term string, p int, i int")
    once = cut.repartition(key).groupBy(key, "words", "term").agg(F.min(F.struct("p", "i")).alias("at"))
    place = F.row_number().over(Window.partitionBy(key, "words").orderBy("at"))
    limit = F.when(F.col("words") == 1, unigrams).otherwise(bigrams)
    return once.select(key, "term", place.alias("place"), "words").where(F.col("place") <= limit)


# Scripts, as regular expressions name them, that tell a language.
SCRIPTS = [("Hiragana", "ja"), ("Katakana", "ja"), ("Hangul", "ko"), ("Han", "zh"), ("Thai", "th"), ("Arabic", "ar"), ("Hebrew", "he"), ("Greek", "el"), ("Devanagari", "hi"), ("Cyrillic", "ru")]


def script_language(tokens: DataFrame, key: str) -> DataFrame:
    """(key, lang, score): for keys with more letters in other tokens than in Latin ones, the language of the script that most letters are in; any kana is Japanese."""
    script = F.lit(None).cast("string")
    for name, lang in reversed(SCRIPTS):
        script = F.when(F.col("token").rlike(rf"\p{{Is{name}}}"), lang).otherwise(script)
    latin = F.col("token").rlike(r"^[\p{IsLatin}\p{M}\p{N}]+$")
    sizes = tokens.groupBy(key, F.when(~latin, script).alias("lang"), latin.alias("latin")).agg(F.sum(F.length("token")).alias("n"))
    best = F.max(F.when(F.col("lang").isNotNull(), F.struct((F.col("lang") == "ja").alias("kana"), "n", "lang")))
    rows = sizes.groupBy(key).agg(F.sum(F.when(F.col("latin"), F.col("n")).otherwise(0)).alias("in_latin"), F.sum("n").alias("letters"), best.alias("best"))
    return rows.where("best is not null and letters - in_latin > in_latin").select(key, "best.lang", F.col("best.n").cast("double").alias("score"))


def page_language(tokens: DataFrame, stop_words: DataFrame, key: str) -> DataFrame:
    """(key, lang, score): by script, or else the language whose stop words weigh most, each hit weighing one over the number of its languages."""
    spread = stop_words.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("token")))
    scores = tokens.join(spread, "token").groupBy(key, "lang").agg(F.round(F.sum("weight"), 6).alias("score"))
    by_words = scores.groupBy(key).agg(F.max(F.struct("score", "lang")).alias("by_words"))
    both = by_words.join(script_language(tokens, key).select(key, F.struct("score", "lang").alias("by_script")), key, "full")
    return both.select(key, F.coalesce("by_script", "by_words").alias("best")).select(key, "best.lang", "best.score")


def resolve_operators(sites: DataFrame, site: str, keys: Mapping[str, Column]) -> DataFrame:
    """(site, operator): sites that share a key, directly or over others, are one operator, named by its smallest site.

    Sites and keys form a bipartite graph; the smallest site is passed over keys until nothing changes.
    """
    links = [sites.select(F.col(site).alias("site"), F.concat(F.lit(f"{name}:"), column.cast("string")).alias("key")) for name, column in keys.items()]
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return linked(sites.select(F.col(site).alias("site")), every)


def kit_clusters(names: DataFrame, tokens: Column, *, least: int = 15, token_length: int = 9, zone: str = "com") -> DataFrame:
    """(day, token, n): two-word tokens of enough letters on ``least`` names of a day in the zone."""
    each = names.where(F.col("zone") == zone).select("day", "label", F.explode(F.array_distinct(tokens)).alias("token")).where(F.length("token") >= token_length)
    return each.groupBy("day", "token").agg(F.count_distinct("label").alias("n")).where(F.col("n") >= least)


def kit_members(names: DataFrame, kits: DataFrame, tokens: Column, *, most: int = 400, zone: str = "com") -> DataFrame:
    """(day, token, label): the members of each kit, the first ``most`` by label."""
    each = names.where(F.col("zone") == zone).select("day", "label", F.explode(F.array_distinct(tokens)).alias("token")).distinct()
    place = F.row_number().over(Window.partitionBy("day", "token").orderBy("label"))
    return each.join(kits.select("day", "token"), ["day", "token"]).withColumn("place", place).where(F.col("place") <= most).drop("place")


def family_clusters(names: DataFrame, least: int = 3) -> DataFrame:
    """(day, label, n): labels registered in several zones on one day."""
    return names.groupBy("day", "label").agg(F.count_distinct("zone").alias("n")).where(F.col("n") >= least)


def sweep_clusters(kits: DataFrame, *, least: int = 3, span: int = 21) -> DataFrame:
    """(token, days): kits seen on ``least`` days within ``span`` days."""
    number = F.unix_date("day")
    window = Window.partitionBy("token").orderBy(number).rangeBetween(-(span - 1), 0)
    rows = kits.select("token", "day").distinct().withColumn("days", F.count("*").over(window))
    return rows.groupBy("token").agg(F.max("days").alias("days")).where(F.col("days") >= least)


def sales_comps(df: DataFrame, by: Sequence[str], *, since: Column | None = None, theme: str | None = None, band: tuple[float, float] | None = None, examples: int = 8) -> DataFrame:
    """(by, n, p25, median, p75, examples) of prices of sales (domain, label, price, venue, day): reports of one domain, price and venue once.

    ``since`` leaves out older reports, ``theme`` (a pattern) other labels, ``band`` other prices. Quartiles are exact, interpolated between neighbours; the
    examples are the dearest sales, of equal prices by domain.
    """
    rows = df.where("price is not null")
    rows = rows.where(F.col("day") >= since) if since is not None else rows
    rows = rows.where(F.col("label").rlike(theme)) if theme else rows
    rows = rows.where(F.col("price").between(*band)) if band else rows
    once = rows.groupBy(*by, "domain", "price", "venue").agg(F.count("*").alias("reports"))
    q = lambda p: F.round(F.percentile("price", F.lit(p)), 4)
    quartiles = once.groupBy(*by).agg(F.count("*").alias("n"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("price"), "domain", "venue"))
    best = once.withColumn("place", place).where(F.col("place") <= examples)
    named = best.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "domain"))), lambda e: e["domain"]), ",").alias("examples"))
    return quartiles.join(named, list(by))


def upsert(target: DataFrame, source: DataFrame, key: str, rules: Mapping[str, str]) -> DataFrame:
    """Rows of either side by key; for both, each column by its rule: ``new``, ``old``, ``max`` or ``min``; nulls never win."""
    a, b = target.alias("t"), source.alias("s")
    pick = {"new": lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")), "old": lambda c: F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")), "max": lambda c: F.greatest(F.col(f"t.{c}"), F.col(f"s.{c}")), "min": lambda c: F.least(F.col(f"t.{c}"), F.col(f"s.{c}"))}
    return a.join(b, F.col(f"t.{key}") == F.col(f"s.{key}"), "full").select(F.coalesce(f"t.{key}", f"s.{key}").alias(key), *[pick[rule](c).alias(c) for c, rule in rules.items()])

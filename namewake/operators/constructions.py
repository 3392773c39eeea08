"""How a word stands in the labels that use it: in which forms and places, in which repeated constructions and with which neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENDINGS = ("s", "es", "ed", "ing")


def word_uses(segments: DataFrame, words: DataFrame, endings: Sequence[str] = ENDINGS) -> DataFrame:
    """(word, label): labels of ``segments`` (label, pieces) in which a piece is one of the ``words`` (word) or it with an ending: inflections, but no longer words."""
    pieces = segments.select("label", F.explode(F.array_distinct(F.filter("pieces", lambda p: p != "?"))).alias("piece"))
    stems = F.array("piece", *[F.when(F.endswith("piece", F.lit(e)), F.substring(F.col("piece"), F.lit(1), F.length("piece") - len(e))) for e in endings])
    return pieces.select("label", F.explode(F.array_compact(stems)).alias("word")).join(words.select("word").distinct(), "word").select("word", "label").distinct()


def constructions(uses: DataFrame, *, least: int = 3, share: float = 0.4, longer: int = 3) -> DataFrame:
    """(word, labels, prefix, suffix, internal, kind, text, n): the places of a word in its labels, and the construction that explains many of them.

    ``prefix`` and ``suffix`` count labels that begin and end with the word, ``internal`` those that do neither. A construction is on ``least`` labels and ``share`` of them: one
    shape with its numbers as one mark (``numbered``), else the longest beginning or end of labels, ``longer`` letters or more beyond the word, that holds it; null for none.
    """
    begins, ends = F.startswith("label", F.col("word")), F.endswith("label", F.col("word"))
    counts = uses.groupBy("word").agg(F.count("*").alias("labels"), F.count_if(begins).alias("prefix"), F.count_if(ends).alias("suffix"), F.count_if(~begins & ~ends).alias("internal"))
    enough = F.col("n") >= F.greatest(F.lit(float(least)), F.col("labels") * share)

    shapes = uses.groupBy("word", F.regexp_replace("label", "[0-9]+", "#").alias("text")).agg(F.count("*").alias("n")).join(counts.select("word", "labels"), "word").where(enough)
    numbered = shapes.select("word", F.lit(0).alias("rank"), F.lit(0).alias("down"), (-F.col("n")).alias("less"), F.lit("numbered").alias("kind"), "text", "n")
    sizes = F.sequence(F.length("word") + longer, F.length("label") - 1)
    cut = uses.where(F.length("label") > F.length("word") + longer).select("word", "label", F.explode(sizes).alias("size"))
    sides = F.array(F.struct(F.lit("prefix").alias("kind"), F.substring("label", F.lit(1), F.col("size")).alias("text")), F.struct(F.lit("suffix").alias("kind"), F.substring(F.col("label"), F.length("label") - F.col("size") + 1, F.col("size")).alias("text")))
    parts = cut.select("word", "label", F.explode(sides).alias("x")).select("word", "label", "x.*").where(F.contains("text", F.col("word")))
    parts = parts.groupBy("word", "kind", "text").agg(F.count("*").alias("n")).join(counts.select("word", "labels"), "word").where(enough)
    longest = parts.select("word", F.lit(1).alias("rank"), (-F.length("text")).alias("down"), (-F.col("n")).alias("less"), "kind", "text", "n")
    best = numbered.union(longest).groupBy("word").agg(F.min(F.struct("rank", "down", "less", "kind", "text", "n")).alias("b")).select("word", "b.kind", "b.text", "b.n")
    return counts.join(best, "word", "left")


def family_patterns(segments: DataFrame, words: DataFrame, *, least: int = 2, top: int = 8) -> DataFrame:
    """(word, pattern, labels, place): runs of whole known pieces around a word that ``least`` labels share, the ``top`` commonest, longer ones first among equals."""
    at = segments.select("label", "pieces", F.posexplode("pieces").alias("i", "word")).join(words.select("word").distinct(), "word")
    starts = at.select("word", "label", "pieces", "i", F.explode(F.sequence(F.lit(0), F.col("i"))).alias("a"))
    runs = starts.select("word", "label", "i", "a", F.explode(F.transform(F.sequence(F.col("i"), F.size("pieces") - 1), lambda b: F.slice("pieces", F.col("a") + 1, b - F.col("a") + 1))).alias("run"))
    whole = runs.where((F.size("run") > 1) & ~F.array_contains("run", "?")).select("word", "label", F.array_join("run", "").alias("pattern")).distinct()
    counts = whole.groupBy("word", "pattern").agg(F.count("*").alias("labels")).where(F.col("labels") >= least)
    order = Window.partitionBy("word").orderBy(F.desc("labels"), F.desc(F.length("pattern")), "pattern")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)

"""Texts that hold terms, by an index of the terms' rarest runs of letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))


def containing(texts: DataFrame, text: str, terms: DataFrame, term: str, *, size: int = 4) -> DataFrame:
    """(text, term): the different ``texts`` that hold a term of ``size`` letters or more.

    Each term is looked up by one run of ``size`` letters, that of its runs that the fewest texts hold; only texts with that run are compared. So the work grows with texts and hits,
    not with texts times terms, and a run that many texts share is used only by terms that have no other. Shorter terms are left out.
    """
    every = texts.select(F.col(text).alias("_text")).distinct().where(F.length("_text") >= size).select("_text", F.explode(grams(F.col("_text"), size)).alias("_gram"))
    wanted = terms.select(F.col(term).alias("_term")).distinct().where(F.length("_term") >= size).select("_term", F.explode(grams(F.col("_term"), size)).alias("_gram"))
    times = every.join(wanted.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = wanted.join(times, "_gram", "left").groupBy("_term").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_best"))
    keys = rarest.where("_best.n > 0").select("_term", F.col("_best._gram").alias("_gram"))
    return every.join(keys, "_gram").where(F.contains("_text", "_term")).select(F.col("_text").alias(text), F.col("_term").alias(term))


def coined_sales(terms: DataFrame, sales: DataFrame, segments: DataFrame, known: DataFrame, *, longest: int = 4) -> DataFrame:
    """(term, domain, price, side, basis): sales to end users (domain, label, price, side) that show a demand for a term.

    A term is found as a word of the label's ``segments``, as two neighbouring words, or as the whole label; coined words, of ``longest`` letters or more that
    are no ``known`` entries, also anywhere inside it.
    """
    wanted = terms.select("term").distinct()
    words = segments.select("label", F.filter("pieces", lambda p: p != "?").alias("w"))
    single = words.select("label", F.explode(F.array_distinct("w")).alias("term"))
    pieces = F.col("pieces")
    neighbours = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: F.when(F.try_element_at(pieces, i + 1).isNotNull() & (F.element_at(pieces, i) != "?") & (F.element_at(pieces, i + 1) != "?"), F.concat_ws(" ", F.element_at(pieces, i), F.element_at(pieces, i + 1))))
    pairs = segments.where("size(pieces) > 1").select("label", F.explode(F.array_distinct(F.array_compact(neighbours))).alias("term"))
    labels = sales.select("label").distinct()
    joined = wanted.select("term", F.replace("term", F.lit(" "), F.lit("")).alias("flat"))
    whole = labels.join(joined, F.replace("label", F.lit("-"), F.lit("")) == F.col("flat")).select("label", "term")
    by_word = labels.join(single.union(pairs), "label").join(wanted, "term", "left_semi").select("label", "term").union(whole).distinct().withColumn("basis", F.lit("word"))
    coined = wanted.where(~F.contains("term", F.lit(" ")) & (F.length("term") >= longest)).join(known.select(F.col("entry").alias("term")), "term", "left_anti")
    inside = containing(labels, "label", coined, "term", size=longest).join(by_word, ["label", "term"], "left_anti").withColumn("basis", F.lit("inside"))
    hits = by_word.unionByName(inside)
    return sales.where(F.col("side") == "enduser").join(hits, "label").select("term", "domain", "price", "side", "basis")

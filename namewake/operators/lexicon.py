"""The history of terms, kept as partial aggregates by month that days are folded into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import stored
from .versions import advance, latest

#: Rows of terms, and a row without a term for each folded day and its size: one table, so that a fold takes effect as a whole.
STATE = "term string, month string, n long, days long, first date, total long"


def _terms(state: DataFrame) -> DataFrame:
    return state.where("term is not null").drop("total")


def _days(state: DataFrame) -> DataFrame:
    return state.where("term is null").select(F.col("first").alias("day"), "total")


def month_partials(daily: DataFrame) -> DataFrame:
    """(term, month, n, days, first) of counts (term, day, n), a row for each term and day."""
    return daily.where("term is not null").groupBy("term", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n"), F.count_distinct("day").alias("days"), F.min("day").alias("first"))


def fold(spark: SparkSession, folder: str, daily: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fold the days of ``sizes`` (day, total) that the state in ``folder`` does not hold yet, with their counts ``daily`` (term, day, n); returns these days.

    What is kept of a term is a row for each month, whatever the number of its days; folding day by day, in any order, equals one pass. Counts of days that are held already
    are left out, so a repeated fold changes nothing. Null terms are not counted. A fold takes effect as a whole, by a new version of the table.
    """
    state = latest(spark, folder, STATE)
    days = _days(state)
    new = stored(sizes.select("day", F.col("total").cast("long")).join(days, "day", "left_anti"))
    parts = month_partials(daily.join(new.select("day"), "day", "left_semi"))
    merged = _terms(state).unionByName(parts).groupBy("term", "month").agg(F.sum("n").alias("n"), F.sum("days").alias("days"), F.min("first").alias("first"))
    both = merged.withColumn("total", F.lit(None).cast("long")).unionByName(days.unionByName(new).select(F.lit(None).cast("string").alias("term"), F.col("day").alias("first"), "total"), allowMissingColumns=True)
    advance(both, folder)
    return new


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """(term, total, days, first, growth, presence, months): a term's whole history.

    Growth compares the rates of the last and the first month, with half an occurrence added to each; it is null with fewer than two months. Presence is the
    share of the folded days. ``months`` lists the counts of the term's months.
    """
    state = latest(spark, folder, STATE)
    terms, days = _terms(state), _days(state)
    months = days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("total").alias("size"))
    ends = months.agg(F.min_by("month", "month").alias("early"), F.max_by("month", "month").alias("late"), F.min_by("size", "month").alias("early_size"), F.max_by("size", "month").alias("late_size"))
    rows = terms.join(F.broadcast(ends.join(days.agg(F.count("*").alias("folded")))))  # one row
    found = rows.groupBy("term").agg(
        F.sum("n").alias("total"),
        F.sum("days").alias("days"),
        F.min("first").alias("first"),
        F.sum(F.when(F.col("month") == F.col("late"), F.col("n")).otherwise(0)).alias("n_late"),
        F.sum(F.when(F.col("month") == F.col("early"), F.col("n")).otherwise(0)).alias("n_early"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("month", "n"))), lambda m: F.concat_ws(":", m["month"], m["n"].cast("string"))), ",").alias("months"),
        *[F.first(c).alias(c) for c in ("early", "late", "early_size", "late_size", "folded")],
    )
    rate = lambda n, size: (F.col(n) + 0.5) / F.greatest(F.lit(1), F.col(size))
    growth = F.when(F.col("early") != F.col("late"), rate("n_late", "late_size") / rate("n_early", "early_size"))
    return found.select("term", "total", "days", "first", F.round(growth, 6).alias("growth"), F.round(F.col("days") / F.col("folded"), 6).alias("presence"), "months")

"""Ordered folds of small state machines as grouped aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank


def folded(events: DataFrame, key: str, order: Sequence[str], step: Column, states: int, *, stretch: int = 4096) -> DataFrame:
    """(key, state): where each key's events, in order, lead from state 0; ``step`` gives an event's array of next states, one for each of ``states``.

    Steps compose, so stretches of one global order are folded apart, for every state that they may begin in, and then joined: a key with most of the
    events is many tasks' work, and no task holds more than a stretch of it.
    """
    placed = global_rank(events.select(key, *order, step.alias("_step")), [key, *order], "_place")
    ordered = F.sort_array(F.collect_list(F.struct("_place", "_step")))
    parts = placed.groupBy(key, F.floor(F.col("_place") / stretch).alias("_part")).agg(ordered.alias("_all"))
    every = F.sequence(F.lit(0), F.lit(states - 1))
    through = F.aggregate("_all", every, lambda at, e: F.transform(at, lambda s: F.element_at(e["_step"], s + 1)))
    joined = parts.select(key, "_part", through.alias("_step")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_part", "_step"))).alias("_all"))
    return joined.select(key, F.aggregate("_all", F.lit(0), lambda s, e: F.element_at(e["_step"], s + 1)).alias("state"))

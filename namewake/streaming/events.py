"""Structured Streaming jobs over event streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import folded
from ..operators.ranking import global_rank, saved, shared_folder


def read_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A table's Parquet files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote; output and progress lie in the shared folder, state is kept in RocksDB.

    ``update`` and ``complete`` outputs are kept by batch, so a restarted batch replaces its own rows.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out") if mode == "append" else spark.read.parquet(f"{folder}/out")


def window_counts(stream: DataFrame, kind: str, by: str, *, time: str = "ts", late: str = "1 day") -> DataFrame:
    """(by, start, n): counts of calendar days, of sliding seven days, or of bursts with gaps under six hours."""
    window = {"day": F.window(time, "1 day"), "week": F.window(time, "7 days", "1 day"), "burst": F.session_window(time, "6 hours")}[kind]
    counts = stream.withWatermark(time, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(by, F.col("w.start").alias("start"), "n")


def dedupe_stream(stream: DataFrame, key: str, *, time: str = "ts", keep: str = "30 days") -> DataFrame:
    """Each key once within the time kept."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def registrable(stream: DataFrame, suffixes: DataFrame, name: str = "name") -> DataFrame:
    """Adds the registrable name: one label more than the longest of the public ``suffixes`` (suffix) that ends the name."""
    clean = F.regexp_replace(F.lower(name), r"^\*\.", "")
    labels = F.split("clean", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("suffix"), F.array_join(F.slice(labels, i - 1, F.size(labels)), ".").alias("registrable")))
    rows = stream.withColumn("clean", clean).where(F.contains("clean", F.lit("."))).select("*", F.explode(tails).alias("t")).select("*", "t.*").drop("t", "clean")
    found = rows.join(suffixes.select("suffix").distinct(), "suffix")
    return found


def launches(stream: DataFrame, recent: DataFrame, *, key: str = "label", zones_with_data: tuple[str, ...], warm_from: str) -> DataFrame:
    """(key, zone, first_at, launch): the first sight of each name. It is a launch if the name is in ``recent`` (key, zone, day) by 14 days at
    most; in zones without zone data, if the first sight is after the warm-up."""

    newest = recent.groupBy(key, "zone").agg(F.max("day").alias("added"))
    joined = stream.select(key, "zone", "ts").join(newest, [key, "zone"], "left").select(key, "zone", "ts", F.unix_date("added").alias("added"))

    def first_sight(keys: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        least = min(part["ts"].min() for part in parts)
        if not state.exists:
            state.update((least.value // 1000,))
            added = parts[0]["added"].iloc[0]
            yield pd.DataFrame({key: [keys[0]], "zone": [keys[1]], "first_at": [least], "added": [-1 if pd.isna(added) else int(added)]})

    shape = f"{key} string, zone string, first_at timestamp, added int"
    first = joined.groupBy(key, "zone").applyInPandasWithState(first_sight, shape, "at long", "append", GroupStateTimeout.NoTimeout)
    age = F.unix_date(F.to_date("first_at")) - F.col("added")
    added = (F.col("added") >= 0) & age.between(0, 14)
    return first.select(key, "zone", "first_at", F.when(F.col("zone").isin(*zones_with_data), added).otherwise(F.col("first_at") >= F.lit(warm_from).cast("timestamp")).alias("launch"))


def roster(events: DataFrame, *, key: str = "label", retire_after: int = 3) -> DataFrame:
    """(key, misses, state): the miss streak at the end of a stream of results (ok, miss, unknown); names retire after some misses in
    a row, only fresh evidence revives them, unknown changes nothing. The batch twin: misses after a key's last ok, by two aggregations that combine
    before the shuffle, so that no key's history is gathered."""
    place = F.struct("ts", "event_id")
    last = saved(events.groupBy(key).agg(F.max(F.when(F.col("result") == "ok", place)).alias("ok")))
    missed = (F.col("result") == "miss") & (F.col("ok").isNull() | (place > F.col("ok")))
    counts = events.join(last, key).groupBy(key).agg(F.count_if(missed).cast("int").alias("misses"))
    return counts.withColumn("state", F.when(F.col("misses") >= retire_after, "retired").otherwise("active"))


def error_share(events: DataFrame, rows: int = 1000, by: str = "zone") -> DataFrame:
    """Each event with the share of errors among the last ``rows`` of its group, itself included.

    Events are numbered in order over all ranges; stretches of that order are windows of their own, each with the ``rows`` before it as well, so that
    a group with most of the events is many tasks' work.
    """
    from pyspark.sql.window import Window

    stretch = 16 * rows
    placed = global_rank(events, [F.asc(by), F.asc("ts"), F.asc("event_id")], "_place")
    own = F.floor(F.col("_place") / stretch)
    tail = F.when(F.col("_place") % stretch > stretch - rows, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_own", own).withColumn("_part", F.explode(tail))
    frame = Window.partitionBy("_part", by).orderBy("_place").rowsBetween(-(rows - 1), 0)
    shared = spread.withColumn("error_share", F.round(F.avg((F.col("kind") == "error").cast("double")).over(frame), 6))
    return shared.where(F.col("_part") == F.col("_own")).drop("_place", "_own", "_part")


def refine_day(stored: DataFrame, late: DataFrame, *, key: str = "label", gap: int = 3) -> DataFrame:
    """(key, day): a late, earlier day of the same key replaces the stored one if it lies within the gap before it."""
    near = late.select(key, F.col("day").alias("late_day"))
    rows = stored.join(near, key, "left")
    fits = F.date_diff("day", "late_day").between(1, gap)
    return rows.groupBy(key, "day").agg(F.min(F.when(fits, F.col("late_day"))).alias("better")).select(key, F.coalesce("better", "day").alias("day"))


def candidate_state(events: DataFrame, key: str = "label") -> DataFrame:
    """(key, state, steps) of a short lifecycle, folded in order: a departure (purchase) starts or resets it as ``exited``; a probe
    (view) moves exited to probing; a park (click) to parked-watch; a signup to detected; an error drops it. Before a departure nothing counts."""
    names = ["", "exited", "probing", "parked-watch", "detected", "dropped"]
    moves = {"purchase": [1, 1, 1, 1, 1, 1], "error": [0, 5, 5, 5, 5, 5], "view": [0, 2, 2, 3, 4, 5], "click": [0, 3, 3, 3, 4, 5], "signup": [0, 4, 4, 4, 4, 5]}
    step = F.lit(None)
    for kind, to in moves.items():
        step = F.when(F.col("kind") == kind, F.array(*[F.lit(i) for i in to])).otherwise(step)
    stay = F.array(*[F.lit(i) for i in range(len(names))])
    found = folded(events, key, ["ts", "event_id"], F.coalesce(step, stay), len(names))
    steps = events.groupBy(key).agg(F.count("*").cast("int").alias("steps"))
    return found.join(steps, key).select(key, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("state") + 1).alias("state"), "steps")


def roster_snapshot(events: DataFrame, *, key: str = "label", retire_after: int = 3) -> DataFrame:
    """(key, misses, hosts): the batch twin of the roster machine, for events (key, ts, event_id, fact, detail), and a table it can start from."""
    n = retire_after
    retired = n + 2  # state 0: not seen; 1 and 2: no miss, without and with hosts; s + 2: s misses in a row
    stay = list(range(n + 3))
    to = {"taken": [2] * (n + 2) + [retired], "missing": [3, 3, *[min(i + 1, retired) for i in stay[2:]]], "fresh": [1, *stay[1:-1], 1], "unknown": [1, *stay[1:]]}
    step = F.array(*[F.lit(i) for i in stay])
    for fact, states in to.items():
        step = F.when(F.col("fact") == fact, F.array(*[F.lit(i) for i in states])).otherwise(step)
    found = folded(events, key, ["ts", "event_id"], step, n + 3)
    last = events.where("fact = 'taken'").groupBy(key).agg(F.max(F.struct("ts", "event_id", F.col("detail").alias("hosts")))["hosts"].alias("hosts"))
    return found.join(last, key, "left").select(key, (F.greatest(F.col("state"), F.lit(2)) - 2).alias("misses"), F.when(F.col("state") == 2, F.col("hosts")).alias("hosts"))


def earlier_days(departures: DataFrame, sightings: DataFrame, *, key: str = "label", gap: int = 3, late: str = "2 days") -> DataFrame:
    """(key, day, late_day): sightings of a key up to ``gap`` days before the day of its departure, as a join of two streams (key, ts). Either side waits
    in state only as long as the other may still bring a match. Of a key's departures or sightings of one day the first to come stands for all: they have
    the same matches by day, and a busy key would otherwise meet itself in all pairs. A day's later rows come within the delay or are too late for the join as well."""
    once = lambda rows: rows.withWatermark("ts", late).withColumn("_day", F.to_date("ts")).dropDuplicatesWithinWatermark([key, "_day"])
    gone = once(departures).select(F.col(key), F.col("ts").alias("gone_at"))
    seen = once(sightings).select(F.col(key).alias("_key"), F.col("ts").alias("seen_at"))
    near = (F.col("seen_at") >= F.col("gone_at") - F.expr(f"INTERVAL {gap + 1} DAYS")) & (F.col("seen_at") <= F.col("gone_at"))
    fits = F.date_diff(F.to_date("gone_at"), F.to_date("seen_at")).between(1, gap)
    found = gone.join(seen, (F.col(key) == F.col("_key")) & near & fits)
    return found.select(key, F.to_date("gone_at").alias("day"), F.to_date("seen_at").alias("late_day"))


def refined(stored: DataFrame, corrections: DataFrame, *, key: str = "label") -> DataFrame:
    """(key, day, refined): stored days with the earliest correction of each; a correction never makes an event of its own."""
    best = corrections.groupBy(key, "day").agg(F.min("late_day").alias("late_day"))
    return stored.join(best, [key, "day"], "left").select(key, "day", F.coalesce("late_day", "day").alias("refined"))

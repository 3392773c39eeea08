"""Keyed machines on replays that come in many files and out of order, restarts from snapshots, changed days."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from namewake.streaming import events, machines, reimport
from namewake.streaming.ordered import Ordered, run_ordered

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "event_id long, ts timestamp, label string, fact string, detail string"
HOUR = machines.HOUR


def at(hours):
    return START + dt.timedelta(hours=hours)


def as_stream(spark, tmp_path, rows, files):
    """Rows as a stream of ``files`` files in the order given, one a batch."""
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={i}")
    return spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("part")


def run(spark, tmp_path, rows, machine, files=1, late="3 days", initial=None):
    stream = as_stream(spark, tmp_path, rows, files)
    found = events.drain(run_ordered(stream, machine, key="label", fact=F.col("fact"), detail=F.col("detail"), late=late, initial=initial))
    return [tuple(r) for r in found.orderBy("us", F.col("id").asc_nulls_last()).collect()]


def shuffled_near(rng, rows, span):
    """Rows out of order, but none later than ``span`` hours."""
    return sorted(rows, key=lambda r: (r[1] - START).total_seconds() / 3600 + rng.uniform(0, span))


def history(facts, label="a"):
    return [(i, at(h), label, fact, None) for i, (h, fact) in enumerate(facts)]


END = (10_000, at(24 * 300), "end", "nothing", None)


def states(found, label="a"):
    return [(f[3], f[4], f[5], f[6], None if f[7] is None else (f[7] - f[1]) // 1000 / HOUR) for f in found if f[0] == label]


def test_lifecycle_by_hand(spark, tmp_path):
    """All states, their next checks, terminal ones and what reopens them."""
    facts = [(0, "movement"), (1, "departure"), (2, "transfer"), (3, "probable"), (4, "movement"), (5, "suspected"), (6, "movement"), (7, "parking"), (8, "gone"), (9, "probable"), (10, "departure"), (11, "nothing"), (12, "resolved"), (13, "movement"), (14, "departure"), (15, "hold"), (16, "expired"), (17, "departure"), (18, "abandoned"), (19, "departure"), (20, "expiration"), (21, "other")]
    got = states(run(spark, tmp_path, [*history(facts), END], machines.Lifecycle()))
    assert [g for g in got if g[0] != "check"] == [
        ("departure", "exited", 0, None, 0),
        ("transfer", "transferring", 1, "registrar-transfer", 6),
        ("probable", "detected", 2, "likely-sale", 24),
        ("movement", "detected", 2, "likely-sale", 0),
        ("suspected", "probing", 3, "unconfirmed-move", 168),
        ("movement", "exited", 3, "unconfirmed-move", 0),
        ("parking", "parked-watch", 4, None, 720),
        ("gone", "dropped", 5, "dropped", None),
        ("departure", "exited", 5, None, 0),
        ("nothing", "probing", 6, "no-evidence", None),
        ("resolved", "resolved", 6, "no-evidence", None),
        ("departure", "exited", 6, None, 0),
        ("hold", "parked-watch", 7, "registry-hold", 1080),
        ("expired", "expired", 7, "registry-hold", None),
        ("departure", "exited", 7, None, 0),
        ("abandoned", "abandoned", 7, None, None),
        ("departure", "exited", 7, None, 0),
        ("expiration", "parked-watch", 8, "expiration", 1080),
    ]
    # a departure and a movement are due at once; the last check is the one after 45 days
    assert [g[1] for g in got if g[0] == "check"] == ["exited", "detected", "exited", "exited", "exited", "exited", "exited", "parked-watch"]


def test_lifecycle_ladder(spark, tmp_path):
    facts = [(0, "departure"), *[(1 + i, "nothing") for i in range(6)]]
    got = states(run(spark, tmp_path, [*history(facts), END], machines.Lifecycle()))
    assert [g[4] for g in got if g[0] == "nothing"] == [168, 552, 720, 720, None, None]
    assert [g[3] for g in got if g[0] == "nothing"] == [None] * 4 + ["no-evidence"] * 2


@pytest.mark.parametrize("files", [1, 7])
def test_replay_does_not_depend_on_files_or_order(spark, tmp_path, files):
    rng = random.Random(files)
    kinds = ["departure", "movement", *machines.PROBES, *machines.ENDS]
    rows = [(i, at(rng.randrange(24 * 40)), rng.choice("abcde"), rng.choice(kinds), None) for i in range(400)]
    got = run(spark, tmp_path, [*shuffled_near(rng, rows, 48), END], machines.Lifecycle(), files)
    machine, wanted = machines.Lifecycle(), []
    for label in "abcde":
        held, due = None, None
        for i, ts, _, fact, _ in sorted((r for r in rows if r[2] == label), key=lambda r: (r[1], r[0])):
            ms = int(ts.timestamp() * 1000)
            if due is not None and due < ms:
                held, due, words = machine.due(held, asked := due)
                wanted.append((label, asked * 1000, None, *words))
            held, due, words = machine.row(held, due, ms, fact, None)
            if words:
                wanted.append((label, ms * 1000, i, *words))
        if due is not None:
            wanted.append((label, due * 1000, None, *machine.due(held, due)[2]))
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_second_look(spark, tmp_path):
    rows = [(0, at(0), "a", "built", None), (1, at(1), "a", "error", None), (2, at(0), "b", "parked", None), (3, at(0.2), "b", "built", None), (4, at(0), "c", "error", None), (5, at(3), "c", "parked", None), (6, at(4), "c", "built", None), (7, at(2), "d", "error", None)]
    got = run(spark, tmp_path, [*rows, END], machines.SecondLook(20))
    minute = lambda us: (us // 60_000_000) - int(START.timestamp()) // 60
    assert sorted((f[0], minute(f[1]), f[2], f[3], f[4]) for f in got) == [("a", 0, 0, "built", 1), ("b", 12, 3, "built", 2), ("c", 20, None, "recheck", 1), ("c", 180, 5, "parked", 2), ("d", 140, None, "recheck", 1)]


def roster_rows(rng, n):
    facts = ["taken", "missing", "missing", "unknown", "fresh"]
    return [(i, at(i), rng.choice("abcdef"), rng.choice(facts), f"ns{i % 4}") for i in range(n)]


def test_roster_goes_on_from_a_snapshot(spark, tmp_path):
    rows = roster_rows(random.Random(5), 300)
    snapshot = events.roster_snapshot(spark.createDataFrame(rows[:150], SCHEMA))
    whole = run(spark, f"{tmp_path}/whole", [*rows, END], machines.Roster(3), 3)
    rest = run(spark, f"{tmp_path}/rest", [*rows[150:], END], machines.Roster(3), 3, initial=snapshot)
    assert rest == [w for w in whole if w[2] is None or w[2] >= 150]
    last = {w[0]: (w[4], w[6]) for w in run(spark, f"{tmp_path}/first", [*rows[:150], END], machines.Roster(3)) if w[0] != "end"}
    assert {r.label: (r.misses, r.hosts) for r in snapshot.collect()} == last
    assert any(w[5] for w in whole) and any(w[3] == "unknown" and w[6] for w in whole)


def test_roster_by_hand(spark, tmp_path):
    facts = [("taken", "n1"), ("unknown", "x"), ("missing", "x"), ("unknown", "x"), ("missing", "x"), ("missing", "x"), ("taken", "n2"), ("fresh", "x"), ("taken", "n3")]
    rows = [(i, at(i), "a", fact, detail) for i, (fact, detail) in enumerate(facts)]
    got = [w[3:] for w in run(spark, tmp_path, [*rows, END], machines.Roster(3)) if w[0] == "a"]
    assert got == [("taken", 0, False, "n1"), ("unknown", 0, False, "n1"), ("missing", 1, False, None), ("unknown", 1, False, None), ("missing", 2, False, None), ("missing", 3, True, None), ("fresh", 0, False, None), ("taken", 0, False, "n3")]


def test_error_share_and_limit(spark, tmp_path):
    kinds = ["ok"] * 6 + ["error"] * 4 + ["ok"] * 10 + ["error"] * 12
    rows = [(i, at(i), "a", kind, None) for i, kind in enumerate(kinds)]
    got = [w for w in run(spark, tmp_path, [*rows, END], machines.ErrorShare(10, 0.3, 48, 20), 4) if w[0] == "a"]
    assert [w[3] for w in got] == [kinds[max(0, i - 9) : i + 1].count("error") / min(10, i + 1) for i in range(len(kinds))]
    assert got[8][4] == 48 and got[9][4] == 24 and got[-1][4] == 20  # four of ten halve it; the floor holds


def test_late_days_refine(spark, tmp_path):
    rows = [(0, at(24 * 10 + 5), "a", "gone", None), (1, at(24 * 8 + 1), "a", "seen", None), (2, at(24 * 7), "a", "seen", None), (3, at(24 * 6 + 23), "a", "seen", None), (4, at(24 * 10 + 1), "a", "seen", None), (5, at(24 * 11), "a", "seen", None), (6, at(24 * 10), "b", "gone", None)]
    stream = as_stream(spark, tmp_path, rows, 3)
    found = events.drain(events.earlier_days(stream.where("fact = 'gone'"), stream.where("fact = 'seen'"), late="9 days"))
    stored = spark.createDataFrame(rows, SCHEMA).where("fact = 'gone'").select("label", F.to_date("ts").alias("day"))
    got = {r.label: (str(r.day), str(r.refined)) for r in events.refined(stored, found).collect()}
    assert got == {"a": ("2024-01-11", "2024-01-08"), "b": ("2024-01-11", "2024-01-11")}


def test_only_changed_days_are_taken_anew(spark, tmp_path):
    source, target, manifest = (f"{tmp_path}/{x}" for x in ("source", "target", "manifest"))
    days = spark.range(60).select("id", F.concat(F.lit("2024-01-0"), (F.col("id") % 4 + 1).cast("string")).alias("day"))
    days.write.partitionBy("day").parquet(source)
    first = {r.day for r in reimport.reimport(spark, source, target, manifest).collect()}
    assert first == {f"2024-01-0{i}" for i in range(1, 5)}
    assert reimport.reimport(spark, source, target, manifest).count() == 0
    files = lambda: {r.f for r in spark.read.parquet(target).select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    days.where("day = '2024-01-02' and id < 30").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(source)
    days.limit(3).select("id", F.lit("2024-01-09").alias("day")).write.mode("append").partitionBy("day").parquet(source)
    assert {r.day for r in reimport.reimport(spark, source, target, manifest).collect()} == {"2024-01-02", "2024-01-09"}
    assert {f for f in before if "day=2024-01-02" not in f} <= files()
    assert spark.read.parquet(target).where("day = '2024-01-02'").count() == 8
    assert {r.day: r.imports for r in reimport.imported(spark, manifest).collect()} == {"2024-01-01": 1, "2024-01-02": 2, "2024-01-03": 1, "2024-01-04": 1, "2024-01-09": 1}


@pytest.mark.parametrize("files", [1, 4])
def test_a_busy_key_meets_itself_once_a_day(spark, tmp_path, files):
    rows = [(i, at(24 * day + i % 24), "a", fact, None) for i in range(48) for day, fact in ((8, "seen"), (9, "seen"), (10, "gone"))]
    stream = as_stream(spark, tmp_path, rows, files)
    found = events.drain(events.earlier_days(stream.where("fact = 'gone'"), stream.where("fact = 'seen'"), late="9 days"))
    assert sorted((str(r.day), str(r.late_day)) for r in found.collect()) == [("2024-01-11", "2024-01-09"), ("2024-01-11", "2024-01-10")]


class Kept:
    """A value or a map in state, without Spark."""

    def __init__(self):
        self.all = {}

    exists = lambda self: () in self.all
    get = lambda self: self.all[()]
    update = lambda self, value: self.all.update({(): value})
    keys = lambda self: iter(list(self.all))
    getValue = lambda self, at: self.all[at]
    updateValue = lambda self, at, value: self.all.update({at: value})
    removeKey = lambda self, at: self.all.pop(at)


def test_a_busy_key_is_never_held_whole(monkeypatch):
    """What waits of a key is stored and read in pieces, and what it writes leaves the worker before the rest is read."""
    from types import SimpleNamespace

    import pandas as pd

    seen = []

    class Watched(machines.ErrorShare):
        def row(self, held, due, ms, fact, detail):
            seen.append(ms)
            return super().row(held, due, ms, fact, detail)

    monkeypatch.setattr(Ordered, "run", 1000)
    monkeypatch.setattr(Ordered, "piece", 100)
    waiting, held, timers = Kept(), Kept(), []
    handle = SimpleNamespace(getMapState=lambda *_: waiting, getValueState=lambda *_: held, registerTimer=timers.append, deleteTimer=timers.remove)
    job = Ordered(Watched(10), "zone")
    job.init(handle)
    rng = random.Random(1)
    times = [rng.randrange(10_000) for _ in range(5000)]
    frames = (pd.DataFrame({"us": [1000 * t for t in times[i : i + 250]], "id": [str(j) for j in range(i, i + 250)], "fact": "error", "detail": None}) for i in range(0, 5000, 250))
    assert not list(job.handleInputRows(("com",), frames, None)) and timers == [min(times)]
    assert len(waiting.all) == 50 and max(len(v[0]) for v in waiting.all.values()) == 100
    written = job.handleExpiredTimer(("com",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 6000), None)
    first = next(written)
    assert len(first) == len(seen) == 100
    out = pd.concat([first, *written])
    assert list(zip(out["us"], out["id"], strict=True)) == sorted((1000 * t, i) for i, t in enumerate(times) if t < 6000)
    assert sum(len(v[0]) for v in waiting.all.values()) == sum(t >= 6000 for t in times) and timers[-1] == min(t for t in times if t >= 6000)

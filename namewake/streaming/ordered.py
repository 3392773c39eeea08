"""Keyed state machines over streams that arrive out of order.

Rows wait in a key's state, as sorted runs, until the watermark has passed them and are then given to a machine in the order of their time, so that a
replay ends as a fold over the ordered table does, however its files were cut. A machine may also ask to be called at a later time, if
no row comes before. Timers are event-time timers, at most one for each key; what waits is bounded by the watermark's delay.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Machine:
    """What is kept for a key (``state``) and written (``output``), both as DDL; the rest of a row's values come as ``fact`` and ``detail``."""

    state: str
    output: str

    def row(self, held: tuple | None, due: int | None, ms: int, fact: str, detail: str | None) -> tuple[tuple | None, int | None, tuple | None]:
        """The new state, when to be called if no row comes before (milliseconds, or None; ``due`` is what was asked for before), and what to write, if anything."""
        raise NotImplementedError

    def due(self, held: tuple, ms: int) -> tuple[tuple, int | None, tuple | None]:
        """The same for a time that was asked for."""
        raise NotImplementedError


class Ordered(StatefulProcessor):
    """Runs a machine for each key. Of the stored values, ``due`` is the time that the machine asked for, ``timer`` the one timer that is set.

    What waits lies in state as sorted runs, each cut into pieces, and is merged when its time has come: of a busy key the worker holds one run while rows
    come, then one piece of each run, and what is written leaves it in frames of one piece's size.
    """

    run, piece = 50_000, 1_000

    def __init__(self, machine: Machine, key: str):
        self.machine, self.key = machine, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "run long, first long", "rows array<struct<us: bigint, id: bigint, fact: string, detail: string>>")
        self.held = handle.getValueState("held", f"{self.machine.state}, known boolean, due long, timer long, runs long")
        self.fields = [part.split()[0] for part in self.machine.state.split(",")]
        self.written = [self.key, "us", "id", *[part.split()[0] for part in self.machine.output.split(",")]]

    def _read(self) -> tuple[tuple | None, int | None, int | None, int]:
        values = tuple(self.held.get()) if self.held.exists() else None
        if values is None:
            return None, None, None, 0
        *state, known, due, timer, runs = values
        return (tuple(state) if known else None), due, timer, runs

    def _write(self, state: tuple | None, due: int | None, timer: int | None, runs: int) -> None:
        self.held.update((*(state or (None,) * len(self.fields)), state is not None, due, timer, runs))

    def _keep(self, run: int, rows: list[tuple]) -> None:
        for i in range(0, len(rows), self.piece):
            self.waiting.updateValue((run, i), (rows[i : i + self.piece],))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, due, timer, runs = self._read()
        least, new = None, []

        def keep() -> None:
            nonlocal least, new, runs
            new.sort(key=_order)
            least = new[0][0] if least is None else min(least, new[0][0])
            self._keep(runs, new)
            runs, new = runs + 1, []

        for frame in rows:
            ids = [None if i is None else int(i) for i in frame["id"]]
            new.extend(zip(frame["us"].tolist(), ids, frame["fact"], frame["detail"], strict=True))
            if len(new) >= self.run:
                keep()
        if new:
            keep()
        if least is not None:
            if timer is None or least // 1000 < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                timer = least // 1000
                self.handle.registerTimer(timer)
            self._write(state, due, timer, runs)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        state, due, _, count = self._read()
        runs: dict[int, list[int]] = {}
        for run, first in self.waiting.keys():
            runs.setdefault(run, []).append(first)
        late: list[int] = []  # when the first of the rows that go on waiting comes, by run
        out: list[tuple] = []

        def ready(run: int) -> Iterator[tuple]:
            for first in sorted(runs[run]):
                rows = [tuple(r) for r in self.waiting.getValue((run, first))[0]]
                n = sum(r[0] // 1000 < now for r in rows)
                if n:
                    self.waiting.removeKey((run, first))
                yield from rows[:n]
                if n < len(rows):
                    if n:
                        self.waiting.updateValue((run, first + n), (rows[n:],))
                    late.append(rows[n][0])
                    return

        def called(until: int) -> None:
            nonlocal state, due
            while due is not None and due < until:
                at = due
                state, due, words = self.machine.due(state, at)
                if words is not None:
                    out.append((*key, at * 1000, None, *words))

        for us, event, fact, detail in heapq.merge(*[ready(run) for run in runs], key=_order):
            called(us // 1000)
            state, due, words = self.machine.row(state, due, us // 1000, fact, detail)
            if words is not None:
                out.append((*key, us, event, *words))
            if len(out) >= self.piece:
                yield pd.DataFrame(out, columns=self.written, dtype=object)
                out.clear()
        called(now)
        times = [t for t in (min(late) // 1000 if late else None, due) if t is not None]
        timer = min(times) if times else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self._write(state, due, timer, count if late else 0)
        if out:
            yield pd.DataFrame(out, columns=self.written, dtype=object)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """A key's state from a table with the machine's columns."""
        values = (initialState[f].iloc[0] for f in self.fields)
        self._write(tuple(None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for v in values), None, None, 0)


def _order(row: tuple) -> tuple:
    us, event, fact, detail = row
    return us, event is None, event or 0, fact or "", detail or ""


def run_ordered(stream: DataFrame, machine: Machine, *, key: str, fact: Column, detail: Column | None = None, time: str = "ts", event: str = "event_id", late: str = "1 day", initial: DataFrame | None = None) -> DataFrame:
    """(key, us, id, ...) as the machine writes it for a stream of (key, time, event); ``us`` and ``id`` are the row's time in microseconds and its
    number, which orders rows of one time; rows that a time has caused have no ``id``. Rows with a null key or time are left out. ``initial`` (key and
    the machine's state columns, a row for each key) is the state that the stream starts from."""
    kept = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    kept = kept.select(key, time, F.unix_micros(time).alias("us"), F.col(event).cast("long").cast("string").alias("id"), fact.alias("fact"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
    kind = dict(stream.dtypes)[key]
    start = None if initial is None else initial.groupBy(key)
    return kept.groupBy(key).transformWithStateInPandas(Ordered(machine, key), f"{key} {kind}, us long, id long, {machine.output}", "Append", "EventTime", initialState=start)

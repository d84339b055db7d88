"""Tracking on a live stream, with timers: bursts of changes, cycles that they start, and returns to the foreground.

The folds of ``events`` are used as they are. A stream's rows wait in its state until the watermark has passed their time, and are then folded in
order, whatever order and whichever micro-batch they came in; a fold that wants to be woken, as a burst does when it has been quiet for long
enough, gets a timer. So the results are those of the batch functions over the same events, without the ones that came too late. A stream's
state is what waits within the watermark and one small record; it needs the RocksDB state store.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming import events

#: What a session needs for these functions.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
TICK = "tick"


class Ordered(StatefulProcessor):
    """Folds the rows (micros, kind, place) of a stream in order, each when the watermark has passed it.

    ``step(state, (micros, kind, place))`` changes the state and gives rows, ``due(state)`` tells when it wants a ``tick``, in microseconds.
    """

    def __init__(self, names: tuple[str, ...], start: Callable[[], object], step: Callable[[object, tuple], list[tuple]], due: Callable[[object], int | None]):
        self.names, self.start, self.step, self.due = names, start, step, due

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, kind string, place int")
        self.held = handle.getValueState("held", "state binary")

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))  # timers are whole milliseconds; an earlier one would be too early

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new = [(r["micros"], r["kind"], r["place"]) for r in rows]
        self.waiting.appendList(new)
        for micros in {m for m, _, _ in new}:
            self._wake(micros)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[2]))
        ready = [r for r in rows if r[0] <= now]
        if len(ready) == len(rows):
            self.waiting.clear()
        elif ready:
            self.waiting.put(rows[len(ready) :])
        state = pickle.loads(bytes(self.held.get()[0])) if self.held.exists() else self.start()
        out = [found for r in [*ready, (now, TICK, 9)] for found in self.step(state, r)]
        wanted = self.due(state)
        if wanted is not None and wanted > now:
            self._wake(wanted)
        self.held.update((pickle.dumps(state),))
        return iter([Row(**dict(zip(self.names, (key[0], *r), strict=True))) for r in out])

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, schema: str, start: Callable, step: Callable, due: Callable, late: str) -> DataFrame:
    """``rows`` is a stream of (stream_key, ts, kind, place)."""
    names = tuple(f.split()[0] for f in schema.split(", "))
    marked = rows.withWatermark("ts", late).select("stream_key", "ts", F.unix_micros("ts").alias("micros"), "kind", F.col("place").cast("int").alias("place"))
    return marked.groupBy("stream_key").transformWithState(statefulProcessor=Ordered(names, start, step, due), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class Burst:
    """The burst that is open: its first and last time, and how many events it has."""

    first = last = None
    n = 0


def burst_step(gap: int, state: Burst, row: tuple) -> list[tuple]:
    """An event ``gap`` or more after the last one, or a timer then, closes the burst."""
    micros, kind, _ = row
    out = []
    if state.n and micros - state.last >= gap:
        out.append((state.first, state.last, state.n))
        state.n = 0
    if kind != TICK:
        state.first = micros if not state.n else state.first
        state.last, state.n = micros, state.n + 1
    return out


def burst_due(gap: int, state: Burst) -> int | None:
    return state.last + gap if state.n else None


def bursts(stream: DataFrame, gap_seconds: int = 5, late: str = "10 minutes") -> DataFrame:
    """(stream_key, first, last, n) in microseconds: ``events.bursts``, each told once it has been quiet for the gap."""
    gap = gap_seconds * 1_000_000
    rows = stream.select("stream_key", "ts", F.lit("event").alias("kind"), F.lit(0).alias("place"))
    return _folded(rows, "stream_key string, first long, last long, n long", Burst, partial(burst_step, gap), partial(burst_due, gap), late)


def cycles(requests: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(stream_key, micros, n): ``events.cycles`` on a stream of (stream_key, ts, kind)."""
    rows = requests.select("stream_key", "ts", "kind", F.when(F.col("kind") == "change", 1).otherwise(2).alias("place"))
    return _folded(rows, "stream_key string, micros long, n long", events.Running, partial(events.cycle_step, seconds * 1_000_000), events.cycle_due, late)


def foreground_triggers(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(stream_key, micros): ``events.foreground_triggers`` on a stream of (stream_key, ts, kind)."""
    rows = stream.select("stream_key", "ts", "kind", events.foreground_place().alias("place"))
    return _folded(rows, "stream_key string, micros long", events.Foreground, events.foreground_step, events.never_due, late)

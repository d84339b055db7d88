"""Change tracking over event streams. Each function takes a batch or a streaming DataFrame unless it says otherwise.

Events are (ts, stream_key, kind, path, old_path). State is kept per stream key, so one busy stream bounds a task, never the whole feed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

#: Fixed values.
DEBOUNCE, COOLDOWN_MS = "5 seconds", 60_000


def dirty_paths(events: DataFrame, keep=None) -> DataFrame:
    """(stream_key, path, ts) that events touch. Both ends of a rename are dirty; an end that ``keep`` leaves out degrades the rename to a mark of the other."""
    ends = events.select("stream_key", "ts", F.explode(F.array_compact(F.array("path", "old_path"))).alias("path"))
    return ends if keep is None else ends.filter(keep)


def distinct_dirty(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The dirty set of a stream, each path once while the watermark holds it."""
    return dirty_paths(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["stream_key", "path"])


def debounce(events: DataFrame, gap: str = DEBOUNCE, late: str = "10 minutes") -> DataFrame:
    """(stream_key, first, fires_at, n): one row a burst. Events at exactly one gap's distance share a burst here."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("stream_key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("stream_key", F.col("w.start").alias("first"), F.col("w.end").alias("fires_at"), "n")


def bursts(events: DataFrame, gap_seconds: int = 5) -> DataFrame:
    """The batch form with a timer's meaning: an event exactly one gap after the last begins a new burst."""
    along = Window.partitionBy("stream_key").orderBy("ts")
    new = F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(along)) >= gap_seconds * 1_000_000, F.lit(True))
    numbered = events.withColumn("burst", F.sum(new.cast("int")).over(along.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("stream_key", "burst").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


def rename_chains(renames: DataFrame) -> DataFrame:
    """Streaming only: (stream_key, new_path, old_path) after each micro-batch, chains collapsed; ``old_path`` is null for a target whose chain has gone on or come back.

    ``renames`` is (stream_key, seq, old_path, new_path). A stream's open chains are its state.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pairs = dict(zip(*state.get, strict=True)) if state.exists else {}
        before = dict(pairs)
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            source = pairs.pop(r.old_path, r.old_path)
            if source != r.new_path:
                pairs[r.new_path] = source
        state.update((list(pairs), list(pairs.values())))
        changed = {n: pairs.get(n) for n in {*before, *pairs} if before.get(n) != pairs.get(n)}
        yield pd.DataFrame({"stream_key": [key[0]] * len(changed), "new_path": list(changed), "old_path": list(changed.values())})

    return renames.groupBy("stream_key").applyInPandasWithState(fold, "stream_key string, new_path string, old_path string", "new_paths array<string>, old_paths array<string>", "update", "NoTimeout")


def in_order(events: DataFrame, order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], list[tuple]], columns: list[str]) -> DataFrame:
    """Fold the rows of each stream in order, a batch at a time: ``step`` changes the state of a stream and gives the rows that follow.

    Rows are dealt by stream and sorted, so that a task holds one batch of rows and one stream's state, however long a stream is.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if state is None or row[0] != key:
                    key, state = row[0], start()
                out += [(key, *r) for r in step(state, row[1:])]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=target)

    names = [f.split()[0] for f in schema.split(", ")]
    target = to_arrow_schema(_parse_datatype_string(schema))
    rows = events.select("stream_key", *columns).repartition("stream_key").sortWithinPartitions("stream_key", *order)
    return rows.mapInArrow(fold, schema)


class Foreground:
    """Whether a departure waits for its return, and when the last cycle began."""

    departed, last = False, None


def foreground_step(state: Foreground, row: tuple) -> list[tuple]:
    micros, kind, _ = row
    if kind == "departed":
        state.departed = True
    elif kind == "cycle":
        state.last = micros
    elif kind == "returned" and state.departed and (state.last is None or micros - state.last >= COOLDOWN_MS * 1000):
        state.departed, state.last = False, micros
        return [(micros,)]
    return []


def never_due(state: object) -> None:
    return None


def foreground_place() -> Column:
    """At one time cycles come first, then departures, then returns."""
    return F.array_position(F.array(*map(F.lit, ("cycle", "departed", "returned"))), F.col("kind")).cast("int")


def foreground_triggers(events: DataFrame) -> DataFrame:
    """(stream_key, ts) of cycles that coming back to the foreground starts.

    ``events`` has ``kind`` departed, returned or cycle. A return counts once after a departure, and not within the cooldown after a
    cycle; a return in the cooldown keeps the departure for the next one. Works in batch; ``live`` has the form for streams.
    """
    timed = events.withColumn("micros", F.unix_micros("ts")).withColumn("place", foreground_place())
    found = in_order(timed, ["micros", "place"], "stream_key string, micros long", Foreground, foreground_step, ["micros", "kind", "place"])
    return found.select("stream_key", F.timestamp_micros("micros").alias("ts"))


class Running:
    """When the cycle that runs will end, and the changes that came meanwhile."""

    until, again = None, 0


def cycle_step(length: int, state: Running, row: tuple) -> list[tuple]:
    """A request starts a cycle of ``length`` if none runs; a change that comes while one runs has another one follow it."""
    micros, kind, _ = row
    out = []
    if state.until is not None and micros >= state.until and state.again:
        out.append((state.until, state.again))
        state.until, state.again = state.until + length, 0
    if kind in ("signal", "change") and (state.until is None or micros >= state.until):
        out.append((micros, int(kind == "change")))
        state.until, state.again = micros + length, 0
    elif kind == "change":
        state.again += 1
    return out


def cycle_due(state: Running) -> int | None:
    return state.until if state.again else None


def cycles(requests: DataFrame, seconds: int) -> DataFrame:
    """(stream_key, micros, n): the start of each cycle that requests (ts, kind) cause, where a cycle takes ``seconds``.

    A ``signal`` that comes while a cycle runs is dropped, as that cycle looks at everything anyway. A ``change`` that comes then is
    remembered, and one more cycle follows at once, whatever the number of changes. ``n`` counts the changes that it answers. Works in batch;
    ``live`` has the form for streams.
    """
    # after the last request of a stream comes a row that only lets what is remembered run
    far = requests.select("stream_key").distinct().select("stream_key", F.lit(1 << 60).alias("micros"), F.lit("end").alias("kind"), F.lit(3).alias("place"))
    timed = requests.select("stream_key", F.unix_micros("ts").alias("micros"), "kind", F.when(F.col("kind") == "change", 1).otherwise(2).alias("place"))
    return in_order(timed.unionByName(far), ["micros", "place"], "stream_key string, micros long, n long", Running, partial(cycle_step, seconds * 1_000_000), ["micros", "kind", "place"])


def velocity(deletions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Sliding hourly sums of deletions by stream, every five minutes."""
    marked = deletions.withWatermark("ts", late) if deletions.isStreaming else deletions
    return marked.groupBy("stream_key", F.window("ts", "1 hour", "5 minutes").alias("w")).agg(F.sum("n").alias("n")).select("stream_key", F.col("w.end").alias("until"), "n")

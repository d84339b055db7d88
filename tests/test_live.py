"""Tracking on live streams with timers gives what the batch functions give over the same events."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import events, live

EVENTS = "stream_key string, s double, kind string"
FAR = 100_000.0


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(live.STATE_STORE[0])
    spark.conf.set(*live.STATE_STORE)
    yield spark
    spark.conf.set(live.STATE_STORE[0], before)


def drained(spark, tmp_path, rows, run, files=4):
    """The rows as several micro-batches, out of order within what is late, and far later ones that let all timers run."""
    folder = str(tmp_path / "in")
    timed = lambda r: spark.createDataFrame(r, EVENTS).select("stream_key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "kind")
    rng = random.Random(2)
    near = sorted(rows, key=lambda r: r[1] + rng.random() * 30)
    size = -(-len(near) // files)
    parts = [near[i : i + size] for i in range(0, len(near), size)] + [[("far", FAR, rows[0][2])], [("far", FAR + 1, rows[0][2])]]
    for part in parts:
        timed(part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(timed(rows[:1]).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    query = run(stream).writeStream.outputMode("append").format("memory").queryName(f"q{rng.randrange(10**9)}_{tmp_path.name.replace('-', '_')}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return [tuple(r) for r in spark.table(query.name).filter("stream_key <> 'far'").collect()], timed(rows)


def rows_of(kinds, seed, n=150):
    rng = random.Random(seed)
    return [(rng.choice("abc"), float(rng.randrange(400)), rng.choice(kinds)) for _ in range(n)]


def test_bursts(rocks, tmp_path):
    got, batch = drained(rocks, tmp_path, rows_of(["event"], 1, 60), lambda s: live.bursts(s, 5))
    wanted = [(r["stream_key"], r["first"], r["last"], r["n"]) for r in events.bursts(batch, 5).select("stream_key", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n").collect()]
    assert sorted(got) == sorted(wanted) and len(got) > 10


def test_cycles(rocks, tmp_path):
    got, batch = drained(rocks, tmp_path, rows_of(["signal", "change"], 2), lambda s: live.cycles(s, 10))
    assert sorted(got) == sorted(map(tuple, events.cycles(batch, 10).collect())) and len(got) > 20


def test_a_path_is_told_once_while_the_watermark_holds_it(rocks, tmp_path):
    rows = [(k, float(s), "event") for k, s in zip("aabbabca", (0, 1, 2, 2, 30, 31, 40, 300), strict=True)]
    with_path = lambda s: s.withColumns({"path": F.lit("p"), "old_path": F.when(F.col("stream_key") == "c", "q")})
    got, batch = drained(rocks, tmp_path, rows, lambda s: events.distinct_dirty(with_path(s)).select("stream_key", "path"), files=2)
    assert sorted(got) == [("a", "p"), ("b", "p"), ("c", "p"), ("c", "q")]
    assert sorted(set(got)) == sorted({(r["stream_key"], r["path"]) for r in events.dirty_paths(with_path(batch)).collect()})


def test_foreground(rocks, tmp_path):
    got, batch = drained(rocks, tmp_path, rows_of(["departed", "returned", "cycle"], 3), lambda s: live.foreground_triggers(s))
    assert sorted(got) == sorted(map(tuple, events.foreground_triggers(batch).select("stream_key", F.unix_micros("ts")).collect())) and got

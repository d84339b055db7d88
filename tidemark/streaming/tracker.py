"""The set of local changes that waits for a cycle, as tables: marked by events, frozen for a cycle, acknowledged after it.

Live state is (kind, key, value): ``dirty`` keys are paths, ``rename`` and ``folder_rename`` keys are new paths with the old path as
value. All of it can be built from a stream's micro-batches; one that comes late simply belongs to the next cycle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import rename, stages

STATE = "kind string, key string, value string"


@dataclass(frozen=True)
class Routed:
    """Marks (path), and renames of files and of folders (stream_key, seq, old_path, new_path)."""

    dirty: DataFrame
    renames: DataFrame
    folder_renames: DataFrame


def route(events: DataFrame, keep: Column | None = None) -> Routed:
    """Split vault events (stream_key, seq, path, old_path, is_folder). ``keep`` is a condition on ``path``.

    A rename both of whose ends are in scope is a rename; one with an end out of scope only marks the other one dirty.
    """
    inside = F.lit(True) if keep is None else keep
    events = stages.cut(events.select("stream_key", "seq", "path", "old_path", "is_folder"))
    ends = events.select("stream_key", "seq", F.explode(F.array_compact(F.array("path", "old_path"))).alias("path"))
    scoped = ends.filter(inside)
    both = events.filter("old_path is not null").join(scoped.select("stream_key", "seq", "path"), ["stream_key", "seq", "path"], "left_semi")
    both = both.join(scoped.select("stream_key", "seq", F.col("path").alias("old_path")), ["stream_key", "seq", "old_path"], "left_semi")
    lone = scoped.join(both.select("stream_key", "seq"), ["stream_key", "seq"], "left_anti").select("path").distinct()
    pairs = both.select("stream_key", "seq", "old_path", F.col("path").alias("new_path"), F.coalesce("is_folder", F.lit(False)).alias("is_folder"))
    return Routed(lone, pairs.filter("not is_folder").drop("is_folder"), pairs.filter("is_folder").drop("is_folder"))


def live(routed: Routed) -> DataFrame:
    """The state after all marks. Chains of renames are one pair and mark both ends of each step's chain; folder renames mark nothing."""
    renames = stages.cut(routed.renames)
    steps = rename.chain_steps(renames)
    files, folders = rename.open_chains(renames, steps), rename.collapse_chains(routed.folder_renames)
    marks = routed.dirty.select("path").union(steps.filter("source <> new_path").select(F.explode(F.array("source", "new_path")))).distinct()
    pair = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), F.col("new_path").alias("key"), F.col("old_path").alias("value"))
    return marks.select(F.lit("dirty").alias("kind"), F.col("path").alias("key"), F.lit(None).cast("string").alias("value")).unionByName(pair(files, "rename")).unionByName(pair(folders, "folder_rename"))


def acknowledge(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """What is left of ``state`` after a cycle that worked on ``snapshot``: paths leave by their key, pairs only if they still are what was captured."""
    seen = snapshot.select("kind", "key", F.col("value").alias("was")).withColumn("seen", F.lit(True))
    judged = state.join(seen, ["kind", "key"], "left")
    done = F.coalesce(F.col("seen"), F.lit(False)) & ((F.col("kind") == "dirty") | F.col("value").eqNullSafe(F.col("was")))
    return judged.filter(~done).select("kind", "key", "value")


def acknowledge_paths(state: DataFrame, pulled: DataFrame) -> DataFrame:
    """After pulls of single files: their marks and file renames leave; folder renames stay."""
    gone = pulled.select(F.col("path").alias("key")).distinct()
    return state.filter("kind = 'folder_rename'").unionByName(state.filter("kind <> 'folder_rename'").join(gone, "key", "left_anti").select("kind", "key", "value"))


def pullable(opened: DataFrame, mixed: DataFrame) -> DataFrame:
    """(path, remote) of opened files that should be pulled at once: known, a file on the remote that changed, and not changed locally."""
    from tidemark.operators import predicates as p

    local, remote, prev = F.col("local"), F.col("remote"), F.col("prev")
    good = prev.isNotNull() & remote.isNotNull() & ~F.coalesce(remote["is_directory"], F.lit(False)) & p.remote_changed(remote, prev) & (local.isNull() | ~p.local_changed(local, prev))
    return opened.select("path").distinct().join(mixed, "path").filter(good).select("path", "remote", "prev")

"""Rewriting delete-plus-transfer pairs of a plan into renames.

Four passes in a fixed order, each on the plan that the one before leaves: local folders, local files that are left, remote folders,
remote files that are left. Local passes need equal hashes; remote passes trust the report. Folder prefixes are found by expanding a
path's ancestors and joining on equality, so no pass has a nested loop. A pass returns a ``Rewrite``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import paths
from tidemark.operators import stages
from tidemark.operators.predicates import has_hash

EXTRA = "old_path string, is_folder boolean, descendants bigint, needs_pull boolean"


@dataclass(frozen=True)
class Rewrite:
    """The plan after a pass, the pairs left for the next one, and what became of each pair: (old_path, new_path, is_folder, reason), reason null if applied.

    ``moved`` (old_path, new_path) has a row for each file below a renamed folder; the plan's row of the folder has their number.
    """

    plan: DataFrame
    remaining: DataFrame
    outcome: DataFrame
    moved: DataFrame | None = None


def widen(plan: DataFrame) -> DataFrame:
    """Add the columns that only renames fill."""
    have = set(plan.columns)
    for name, kind in (x.split(" ", 1) for x in EXTRA.split(", ")):
        if name not in have:
            plan = plan.withColumn(name, F.lit(None).cast(kind))
    return plan


def _ends(pairs: DataFrame, plan: DataFrame) -> DataFrame:
    """Each pair with the actions at its ends, null structs if there are none."""
    action = plan.select("path", F.struct("action", "local", "remote", "prev").alias("it"))
    at_old = action.select(F.col("path").alias("old_path"), F.col("it").alias("del"))
    at_new = action.select(F.col("path").alias("new_path"), F.col("it").alias("put"))
    return pairs.join(at_old, "old_path", "left").join(at_new, "new_path", "left")


def _replace(plan: DataFrame, consumed: DataFrame, added: DataFrame) -> DataFrame:
    return widen(plan).join(consumed.select("path").distinct(), "path", "left_anti").unionByName(added, allowMissingColumns=True)


def _local_reason() -> Column:
    """Null if the pair is a pure rename."""
    d, u = F.col("del"), F.col("put")
    typed = (d["action"] == "delete_remote") & (u["action"] == "push")
    return F.when(~F.coalesce(typed, F.lit(False)), "action_type_mismatch").when(~(has_hash(d["prev"]) & has_hash(u["local"])), "hash_missing").when(d["prev"]["hash"] != u["local"]["hash"], "hash_mismatch")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("old_path", "new_path")).alias("path"))


def local_files(plan: DataFrame, pairs: DataFrame) -> Rewrite:
    judged = stages.cut(_ends(pairs, plan).withColumn("reason", _local_reason()))
    good = judged.filter("reason is null")
    added = good.select(F.col("new_path").alias("path"), F.lit("rename_remote").alias("action"), F.col("put.local").alias("local"), F.col("del.remote").alias("remote"), F.col("del.prev").alias("prev"), "old_path", F.lit(False).alias("is_folder"))
    return Rewrite(_replace(plan, _both(good), added), pairs.limit(0), judged.select("old_path", "new_path", F.lit(False).alias("is_folder"), "reason"))


def _by_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """File pairs that a folder pair explains: both ends under its ends, with the same rest of the path."""
    above = files.withColumn("folder", F.explode(paths.ancestors(F.col("old_path"))))
    pair = folders.select(F.col("old_path").alias("folder"), F.col("new_path").alias("new_folder"), F.col("ordinal"))
    return above.join(pair, "folder").filter(F.col("new_path") == paths.rebase(F.col("old_path"), F.col("folder"), F.col("new_folder")))


def _numbered(pairs: DataFrame) -> DataFrame:
    """Without an ``ordinal``, pairs come in the order of their old paths, which every job and layout sees alike."""
    return pairs if "ordinal" in pairs.columns else pairs.withColumn("ordinal", F.col("old_path"))


def local_folders(plan: DataFrame, folders: DataFrame, files: DataFrame) -> Rewrite:
    """A folder pair replaces the renames of all files below it if every one of them is pure; else the first that isn't gives the reason."""
    folders, files = _numbered(folders), _numbered(files)
    inside = _by_folder(files.withColumnRenamed("ordinal", "file_ordinal"), folders)
    judged = _ends(inside, plan).withColumn("reason", _local_reason())
    grouped = judged.groupBy("folder", "new_folder").agg(
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("file_ordinal"))).alias("reason"),
        F.count(F.lit(1)).alias("descendants"),
    )
    of_pair = folders.select("old_path", "new_path").join(grouped.select(F.col("folder").alias("old_path"), F.col("new_folder").alias("new_path"), "reason", "descendants"), ["old_path", "new_path"], "left")
    outcome = stages.cut(of_pair.withColumn("reason", F.when(F.col("descendants").isNull(), "no_descendants").otherwise(F.col("reason"))))
    good = outcome.filter("reason is null")
    taken = good.select(F.col("old_path").alias("folder"), F.col("new_path").alias("new_folder"))
    moved = inside.join(taken, ["folder", "new_folder"], "left_semi").select("old_path", "new_path").distinct()
    added = good.select(F.col("new_path").alias("path"), F.lit("rename_remote").alias("action"), "old_path", F.lit(True).alias("is_folder"), "descendants")
    left = files.join(moved.select("new_path").distinct(), "new_path", "left_anti").select(files.columns)
    return Rewrite(_replace(plan, _both(moved), added), left, outcome.select("old_path", "new_path", F.lit(True).alias("is_folder"), "reason"), moved)


def remote_files(plan: DataFrame, pairs: DataFrame, literal: bool = False) -> Rewrite:
    """No hash proof. A rename whose content changed too is marked ``needs_pull``, so that the edit isn't lost; ``literal`` leaves the mark out."""
    ends = _ends(pairs, plan)
    typed = (F.col("del.action") == "delete_local") & (F.col("put.action") == "pull")
    judged = stages.cut(ends.withColumn("reason", F.when(~F.coalesce(typed, F.lit(False)), "action_type_mismatch")))
    good = judged.filter("reason is null")
    new, old = F.col("put.remote.remote_checksum"), F.col("del.prev.remote_checksum")
    edited = ~F.coalesce((new["algo"] == old["algo"]) & (new["value"] == old["value"]), F.lit(False))
    added = good.select(F.col("new_path").alias("path"), F.lit("rename_local").alias("action"), F.col("del.local").alias("local"), F.col("put.remote").alias("remote"), F.col("del.prev").alias("prev"), "old_path", F.lit(False).alias("is_folder"), (F.lit(False) if literal else edited).alias("needs_pull"))
    return Rewrite(_replace(plan, _both(good), added), pairs.limit(0), judged.select("old_path", "new_path", F.lit(False).alias("is_folder"), "reason"))


def remote_folders(plan: DataFrame, pairs: DataFrame) -> Rewrite:
    """``pairs`` has folders and files. Every deletion below the old folder is absorbed, whether or not something is pulled in its place."""
    folders = pairs.filter(F.coalesce("is_folder", F.lit(False))).select("old_path", "new_path")
    files = pairs.filter(~F.coalesce("is_folder", F.lit(False)))
    below = plan.select("path", "action", F.col("local").isNotNull().alias("held"), F.explode(paths.ancestors(F.col("path"))).alias("folder"))
    occupied = below.filter("held").select(F.col("folder").alias("new_path")).distinct().withColumn("occupied", F.lit(True))
    gone = below.filter(F.col("action") == "delete_local").select(F.col("folder").alias("old_path"), "path")
    inside = folders.join(gone, "old_path")
    counted = inside.groupBy("old_path", "new_path").agg(F.count(F.lit(1)).alias("descendants"))
    outcome = folders.join(occupied, "new_path", "left").join(counted, ["old_path", "new_path"], "left")
    crossing = paths.is_hidden(F.col("old_path")) != paths.is_hidden(F.col("new_path"))
    outcome = stages.cut(outcome.withColumn("reason", F.when(crossing, "cross_regime").when(F.col("occupied"), "destination_occupied").when(F.col("descendants").isNull(), "no_descendants")))
    good = outcome.filter("reason is null")
    absorbed = inside.join(good.select("old_path", "new_path"), ["old_path", "new_path"], "left_semi")
    moved = absorbed.select(F.col("path").alias("old_path"), paths.rebase(F.col("path"), F.col("old_path"), F.col("new_path")).alias("new_path")).distinct()
    consumed = _both(moved).distinct()
    added = good.select(F.col("new_path").alias("path"), F.lit("rename_local").alias("action"), "old_path", F.lit(True).alias("is_folder"), "descendants")
    # an end of a file pair that a folder took is gone for the file pass
    left = files.join(consumed.select(F.col("path").alias("old_path")), "old_path", "left_anti").join(consumed.select(F.col("path").alias("new_path")), "new_path", "left_anti").select(files.columns)
    return Rewrite(_replace(plan, consumed, added), left, outcome.select("old_path", "new_path", F.lit(True).alias("is_folder"), "reason"), moved)


def refine(plan: DataFrame, local_file_pairs: DataFrame, local_folder_pairs: DataFrame, remote_pairs: DataFrame, literal: bool = False) -> Rewrite:
    """All four passes. ``outcome`` has a ``side`` too.

    A pass reads its plan three times, so each gets one that is written; else the last would work out the first one 81 times.
    """
    remote_pairs = stages.kept(remote_pairs)
    a = local_folders(stages.kept(plan), local_folder_pairs, local_file_pairs)
    b = local_files(stages.cut(a.plan), a.remaining)
    c = remote_folders(stages.cut(b.plan), remote_pairs)
    d = remote_files(stages.cut(c.plan), c.remaining, literal)
    outcome = None
    for r, side in ((a, "local"), (b, "local"), (c, "remote"), (d, "remote")):
        rows = r.outcome.withColumn("side", F.lit(side))
        outcome = rows if outcome is None else outcome.unionByName(rows)
    return Rewrite(d.plan, d.remaining, outcome, a.moved.unionByName(c.moved))


def chain_steps(events: DataFrame) -> DataFrame:
    """(stream_key, seq, new_path, source) after each rename of (stream_key, seq, old_path, new_path): where its chain began.

    A rename goes on the chain of the last earlier one that ended at its source, unless another rename took that end in between. Links
    are found by one window over the places of a path in a stream, then followed by doubling, so long chains and busy streams need no task
    of their own.
    """
    ends = events.select("stream_key", F.col("new_path").alias("at"), "seq", F.lit(1).alias("makes")).unionByName(events.select("stream_key", F.col("old_path").alias("at"), "seq", F.lit(0).alias("makes")))
    # at one rename a path is taken before one is made
    along = Window.partitionBy("stream_key", "at").orderBy("seq", "makes")
    before = ends.withColumn("before", F.when(F.lag("makes").over(along) == 1, F.lag("seq").over(along))).filter("makes = 0").select("stream_key", "seq", "before")
    state = stages.cut(events.join(before, ["stream_key", "seq"]).select("stream_key", "seq", "new_path", F.col("old_path").alias("source"), F.col("before").alias("up")))
    # a rename that ends where its chain began closes the chain: what follows begins anew
    while True:
        above = state.select("stream_key", F.col("seq").alias("up"), F.col("source").alias("source_above"), F.col("up").alias("next"))
        joined = state.join(above, ["stream_key", "up"], "left")
        state = stages.cut(joined.select("stream_key", "seq", "new_path", F.coalesce("source_above", "source").alias("source"), F.col("next").alias("up")))
        if state.filter("up is not null").isEmpty():
            return state.select("stream_key", "seq", "new_path", "source")


def collapse_chains(events: DataFrame) -> DataFrame:
    """(stream_key, new_path, old_path) after following chains of renames in each stream; a chain that comes back to its start is none.

    ``events`` is (stream_key, seq, old_path, new_path). Only the last rename to a path that no later one took is an open chain.
    """
    events = stages.cut(events.select("stream_key", "seq", "old_path", "new_path"))
    return open_chains(events, chain_steps(events))


def open_chains(events: DataFrame, steps: DataFrame) -> DataFrame:
    """The chains of ``events`` that are open, from their ``chain_steps``."""
    last = steps.groupBy("stream_key", "new_path").agg(F.max("seq").alias("seq"), F.max_by("source", "seq").alias("old_path"))
    taken = events.groupBy("stream_key", F.col("old_path").alias("new_path")).agg(F.max("seq").alias("taken"))
    open_ = last.join(taken, ["stream_key", "new_path"], "left").filter(F.col("taken").isNull() | (F.col("taken") < F.col("seq")))
    return open_.filter("old_path <> new_path").select("stream_key", "new_path", "old_path")

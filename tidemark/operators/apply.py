"""Applying a plan to the listings as they are now: phases, refusals, failed calls and retries, and what is committed of it.

Phase 1 moves contents (push, pull) and settles what both sides agree on; phase 2 resolves conflicts; phase 3 renames, then pulls what a renamed
file needs, then deletes; phase 4 deletes the folders that became empty. Each phase is a few joins of its actions with the listings that
the one before left. An action ends with a status:

``done``, with the number of attempts; ``failed``, with the kind of error of its last call; ``refused``, with what was in its way; ``blocked``, if an
earlier action on its path or below it didn't end well, so nothing is deleted or moved that should have been copied first; ``aborted``, after a
phase in which a call had no authority; ``left``, a conflict for which no resolution was given.

Only what is done changes the listings and the baseline, so the next cycle plans the rest anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import errors, paths
from tidemark.operators import rename, stages, state, tree
from tidemark.operators.schema import ENTITY, ENTITY_FIELDS

#: Lane and phase of each action: transfers and what only changes state first, then conflicts, renames, deletions.
LANES = {"push": "upload", "pull": "download", "match": "state", "cleanup": "state", "conflict": "conflict", "rename_local": "local", "rename_remote": "remote", "delete_local": "local", "delete_remote": "remote"}
PHASES = {"push": 1, "pull": 1, "match": 1, "cleanup": 1, "conflict": 2, "rename_local": 3, "rename_remote": 3, "delete_local": 4, "delete_remote": 4}
#: Fixed value: calls of an action at most; what can't be repeated safely is called once.
MOST_ATTEMPTS = 3
#: What takes files out of folders.
TAKING = {"delete_local", "delete_remote", "rename_local", "rename_remote"}
ONCE = ("rename_local", "rename_remote", "conflict")
FAULTS = "path string, action string, attempt int, kind string, retry_after_ms bigint"
OUTCOME = ("path", "action", "old_path", "is_folder", "status", "reason", "attempts")


@dataclass(frozen=True)
class Applied:
    """What became of each action (``OUTCOME``), both listings and the baseline."""

    outcomes: DataFrame
    local: DataFrame
    remote: DataFrame
    baseline: DataFrame


def _mapped(column: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[column]


def with_phases(plan: DataFrame) -> DataFrame:
    return plan.withColumn("lane", _mapped(F.col("action"), LANES)).withColumn("phase", _mapped(F.col("action"), PHASES))


def call_results(faults: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """(path, action, attempts, error) of the actions with failed calls (``FAULTS``): the call that succeeded, or the error after which no other was made."""
    limit = F.when(F.col("action").isin(*ONCE), 1).otherwise(most)
    decided = errors.decide_retry(F.col("kind"), F.col("attempt"), limit, F.col("retry_after_ms"), F.lit(0.5))["action"]
    calls = faults.withColumn("stops", decided != "retry")
    seen = calls.groupBy("path", "action").agg(F.collect_set("attempt").alias("failed"), F.min(F.when(F.col("stops"), F.struct("attempt", "kind"))).alias("stop"))
    clear = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(most + 1)), "failed"))
    stopped = F.coalesce(F.col("stop.attempt") < clear, F.lit(False))
    return seen.select("path", "action", F.when(stopped, F.col("stop.attempt")).otherwise(clear).alias("attempts"), F.when(stopped, F.col("stop.kind")).alias("error"))


def _judged(actions: DataFrame, refusal: Column, blocked: Column | None = None) -> DataFrame:
    """Add status, reason and attempts; ``actions`` has the results of its calls."""
    blocked = F.lit(False) if blocked is None else blocked
    status = F.when(blocked, "blocked").when(refusal.isNotNull(), "refused").when(F.col("error").isNotNull(), "failed").otherwise("done")
    reason = F.when(blocked, "earlier_failure").otherwise(F.coalesce(refusal, F.col("error")))
    attempts = F.when(blocked | refusal.isNotNull(), 0).otherwise(F.coalesce("attempts", F.lit(1)))
    return actions.withColumns({"status": status, "reason": reason, "attempts": attempts.cast("int")}).drop("error")


def _row(listing: DataFrame, name: str) -> DataFrame:
    return listing.select("path", F.struct(*ENTITY_FIELDS).alias(name))


def _is_folder(side: str) -> Column:
    return F.coalesce(F.col(side)["is_directory"], F.lit(False))


def _below_files(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(path) of the targets that would stand below a file."""
    above = targets.select("path", F.explode(paths.ancestors(F.col("path"))).alias("above"))
    return above.join(files.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct().withColumn("below_file", F.lit(True))


def transfer(plan: DataFrame, local: DataFrame, remote: DataFrame, results: DataFrame, present: set[str], reserved: tuple[str, ...] = ()) -> DataFrame:
    """Phase 1, judged: pushes and pulls with ``source``, the row that is copied, and what only settles.

    A push to a reserved path is refused, as is a file where the other side has a folder, a folder where it has a file, anything below a file, and a file that isn't
    there any more or is a folder now. ``present`` are the actions that the plan has.
    """
    settled = plan.filter(F.col("action").isin("match", "cleanup")).join(results, ["path", "action"], "left")
    out = _judged(settled, F.lit(None).cast("string")).withColumn("source", F.lit(None).cast(f"struct<{_struct(ENTITY)}>"))
    for action, planned, mine, theirs in (("push", "local", local, remote), ("pull", "remote", remote, local)):
        if action not in present:
            continue
        actions = plan.filter(F.col("action") == action).withColumn("folder", _is_folder(planned))
        arriving = actions.filter(~F.col("folder")).select("path")
        files = theirs.filter(~F.col("is_directory")).select("path").union(arriving)
        rows = actions.join(_row(mine, "source"), "path", "left").join(_row(theirs, "there"), "path", "left").join(_below_files(actions.select("path"), files), "path", "left").join(results, ["path", "action"], "left")
        folder, there = F.col("folder"), F.col("there").isNotNull()
        refusal = (
            F.when(F.col("path").isin(*reserved) if reserved and action == "push" else F.lit(False), "reserved_path")
            .when(~folder & F.col("source").isNull(), "source_missing")
            .when(~folder & _is_folder("source"), "source_is_folder")
            .when(F.col("below_file"), "parent_is_file")
            .when(~folder & there & _is_folder("there"), "folder_in_the_way")
            .when(folder & there & ~_is_folder("there"), "file_in_the_way")
        )
        source = F.when(folder, F.coalesce(F.col("source"), F.col(planned))).otherwise(F.col("source"))
        out = out.unionByName(_judged(rows.withColumn("source", source), refusal).drop("folder", "there", "below_file"))
    return out


def _struct(schema: str) -> str:
    """A row type as the fields of a struct type; ``path string, ...`` is ``path:string, ...``."""
    return ", ".join(":".join(x.split(" ", 1)) for x in schema.split(", "))


def conflict_writes(conflicts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, to_local, to_remote) rows that resolutions write, siblings on both sides; null where a side stays.

    A merged text is as new as the newer side. Of a duplicated pair the remote becomes the sibling, on both sides, and the local one stays; where
    one side is left, it is restored on the other.
    """
    rows = conflicts.select("path", "local", "remote").join(resolved.select("path", "outcome", "duplicate_path", "merged"), "path")
    a, b, outcome = F.col("local"), F.col("remote"), F.col("outcome")
    sha = F.sha2("merged", 256)
    text = F.struct(
        F.col("path"), F.lit(False).alias("is_directory"), F.octet_length("merged").cast("bigint").alias("size"), F.greatest(a["mtime"], b["mtime"]).alias("mtime"), sha.alias("hash"),
        F.struct(F.lit("sha256").alias("algo"), sha.alias("value")).alias("remote_checksum"), b["backend_meta"].alias("backend_meta"),
    )
    none = F.lit(None).cast(f"struct<{_struct(ENTITY)}>")
    to_local = F.when(outcome == "merged", text).when((outcome == "kept_remote") | ((outcome == "duplicated") & a.isNull()), b).otherwise(none)
    to_remote = F.when(outcome == "merged", text).when(outcome.isin("kept_local", "duplicated"), a).otherwise(none)
    own = rows.select("path", to_local.alias("to_local"), to_remote.alias("to_remote"))
    twin = b.withField("path", F.col("duplicate_path"))
    twins = rows.filter("duplicate_path is not null").select(F.col("duplicate_path").alias("path"), twin.alias("to_local"), twin.alias("to_remote"))
    return own.unionByName(twins)


def _written(listing: DataFrame, rows: DataFrame) -> DataFrame:
    """``listing`` with ``rows`` (entities) in place of what stood at their paths."""
    return listing.join(rows.select("path"), "path", "left_anti").unionByName(rows.select(*listing.columns))


def unfinished(outcomes: DataFrame) -> DataFrame:
    """(path) of the ends of actions that didn't end well, and of all folders above them."""
    ends = outcomes.filter(F.col("status") != "done").select(F.explode(F.array("path", "old_path")).alias("path")).filter("path is not null")
    return ends.select(F.explode(F.array_append(paths.ancestors(F.col("path")), F.col("path"))).alias("path")).distinct()


def _blocked(actions: DataFrame, open_: DataFrame) -> DataFrame:
    """``actions`` with ``blocked``: whether one of its ends is, or holds, the path of an unfinished action."""
    marked = open_.withColumn("open", F.lit(True))
    at_path = actions.join(marked, "path", "left").withColumnRenamed("open", "open_new")
    both = at_path.join(marked.withColumnRenamed("path", "old_path"), "old_path", "left")
    return both.withColumn("blocked", F.coalesce("open_new", F.lit(False)) | F.coalesce("open", F.lit(False))).drop("open_new", "open")


def renamed(actions: DataFrame, listing: DataFrame, results: DataFrame, open_: DataFrame) -> DataFrame:
    """The renames of one lane, judged.

    A rename is refused if its source isn't there, if something stands at its target or, for a folder, below it, if the target is its
    own inside or below a file, or if another rename takes the same source or target. A target that another rename moves away is free once that
    one is done: such chains run from their ends, by doubling, and renames in a circle are all refused.
    """
    nodes = listing.select("path", "is_directory", F.lit(True).alias("itself")).unionByName(listing.select(F.explode(paths.ancestors(F.col("path"))).alias("path"), F.lit(True).alias("is_directory"), F.lit(False).alias("itself")))
    held = nodes.groupBy("path").agg(F.bool_or("itself").alias("itself"), F.bool_or(~F.col("itself")).alias("below"))
    rows = _blocked(actions, open_).join(results, ["path", "action"], "left")
    rows = rows.join(held.select(F.col("path").alias("old_path"), F.lit(True).alias("source")), "old_path", "left").join(held.select("path", F.col("itself").alias("taken"), F.col("below").alias("filled")), "path", "left")
    rows = rows.join(_below_files(actions.select("path"), listing.filter(~F.col("is_directory"))), "path", "left")
    rows = rows.join(actions.select(F.col("old_path").alias("path"), F.col("path").alias("up")).groupBy("path").agg(F.min("up").alias("up")), "path", "left")
    rows = rows.withColumns({"of_target": F.row_number().over(Window.partitionBy("path").orderBy("old_path")), "of_source": F.row_number().over(Window.partitionBy("old_path").orderBy("path"))})
    inside = (F.col("path") == F.col("old_path")) | F.startswith(F.col("path"), F.concat(F.col("old_path"), F.lit("/")))
    taken, filled = F.coalesce("taken", F.lit(False)), F.coalesce("filled", F.lit(False))
    refusal = (
        F.when(F.col("source").isNull() | (F.col("of_source") > 1), "source_missing")
        .when(inside, "into_itself")
        .when(F.col("below_file"), "parent_is_file")
        .when((F.col("of_target") > 1) | ((taken | filled) & F.col("up").isNull()), "target_exists")
    )
    waits = F.when(taken | filled, F.col("up"))
    judged = stages.cut(_judged(rows.withColumn("waits", waits), refusal, F.col("blocked")))
    chain = judged.filter("of_target = 1 and of_source = 1").select("path", F.col("waits").alias("up"), (F.col("status") == "done").alias("well"))
    while not chain.filter("up is not null and well").isEmpty():
        above = chain.select(F.col("path").alias("up"), F.col("up").alias("next"), F.col("well").alias("above"))
        step = chain.join(above, "up", "left").select("path", F.when(F.col("well") & F.coalesce("above", F.lit(False)), F.col("next")).alias("to"), (F.col("well") & F.coalesce("above", F.col("up").isNull())).alias("well"))
        size, chain = chain.filter("up is not null and well").count(), stages.cut(step.withColumnRenamed("to", "up"))
        if chain.filter("up is not null and well").count() == size:  # only circles are left
            chain = chain.withColumn("well", F.col("well") & F.col("up").isNull())
            break
    ends = chain.select("path", F.col("well").alias("free"))
    stuck = (F.col("status") == "done") & ~F.coalesce("free", F.lit(True))
    out = judged.join(ends, "path", "left").withColumns({"reason": F.when(stuck, "target_exists").otherwise(F.col("reason")), "attempts": F.when(stuck, 0).otherwise(F.col("attempts")), "status": F.when(stuck, "refused").otherwise(F.col("status"))})
    return out.drop("free", "waits", "of_target", "of_source", "up", "below_file", "source", "taken", "filled", "blocked")


def _aborts(outcomes: DataFrame) -> bool:
    return not outcomes.filter("status = 'failed' and reason = 'auth'").isEmpty()


def _not_run(actions: DataFrame, status: str) -> DataFrame:
    return actions.withColumns({"status": F.lit(status), "reason": F.lit(None).cast("string"), "attempts": F.lit(0)})


def _with_parents(listing: DataFrame, arrived: DataFrame) -> DataFrame:
    """The listing with the folders that ``arrived`` paths need, as folders are made along with what is put in them."""
    made = tree.missing_folders(arrived, listing).select("path")
    row = {"is_directory": F.lit(True), "size": F.lit(0).cast("bigint"), "mtime": F.lit(0).cast("bigint"), "hash": F.lit("")}
    return listing.unionByName(made.withColumns(row), allowMissingColumns=True)


def _unmoved(moved: DataFrame, failed: DataFrame) -> DataFrame:
    """``moved`` (old_path, new_path) of files without those below folders whose renames, ``failed``, didn't run."""
    at = moved.select("old_path", "new_path", F.explode(paths.ancestors(F.col("old_path"))).alias("folder"))
    kept_back = at.join(failed.select(F.col("old_path").alias("folder"), F.col("path").alias("new_folder")), "folder").filter(F.col("new_path") == paths.rebase(F.col("old_path"), F.col("folder"), F.col("new_folder")))
    return moved.join(kept_back.select("old_path", "new_path"), ["old_path", "new_path"], "left_anti")


def apply_plan(
    plan: DataFrame, local: DataFrame, remote: DataFrame, baseline: DataFrame, synced_at: int = 0, *, faults: DataFrame | None = None, resolved: DataFrame | None = None,
    moved: DataFrame | None = None, reserved: tuple[str, ...] = (), folders: bool = False, pull_renamed: bool = True,
) -> Applied:
    """Run a plan against the listings ``local`` and ``remote`` as they are now.

    ``faults`` are the calls that failed, ``resolved`` what ``conflict.resolve`` says of the conflicts (none are run without it), ``moved`` the files
    below renamed folders. With ``folders`` the listings have rows for folders: parents of what arrives are made and emptied ones deleted. A file that was
    renamed remotely and edited too is pulled after its rename; without ``pull_renamed``, or if that fails, the baseline keeps the remote's old
    checksum and no time, so the next cycle sees a changed remote and pulls it.
    """
    spark = plan.sparkSession
    plan, local, remote = stages.cut(rename.widen(plan)), stages.kept(local), stages.kept(remote)
    present = {r["action"] for r in plan.select("action").distinct().collect()}  # a phase without actions costs nothing
    results = stages.cut(call_results(faults if faults is not None else spark.createDataFrame([], FAULTS)))
    outcomes, sides = [], {"local": local, "remote": remote}

    def ended(judged: DataFrame) -> DataFrame:
        outcomes.append(judged.select(*OUTCOME))
        return judged

    def all_outcomes() -> DataFrame:
        out = outcomes[0]
        for more in outcomes[1:]:
            out = out.unionByName(more)
        return out

    def settle(side: str, listing: DataFrame, arrived: DataFrame | None = None) -> None:
        sides[side] = stages.cut(_with_parents(listing, arrived) if folders and arrived is not None else listing)

    first = ended(stages.cut(transfer(plan, local, remote, results, present, reserved)))
    for side, action in (("remote", "push"), ("local", "pull")):
        if action not in present:
            continue
        copied = first.filter((F.col("action") == action) & (F.col("status") == "done")).select("source.*")
        settle(side, _written(sides[side], copied), copied)
    aborted = _aborts(first)

    conflicts = plan.filter("action = 'conflict'").join(results, ["path", "action"], "left")
    siblings = None
    if "conflict" not in present:
        pass
    elif aborted or resolved is None:
        ended(_not_run(conflicts.drop("error", "attempts"), "aborted" if aborted else "left"))
    else:
        judged = ended(stages.cut(_judged(conflicts, F.lit(None).cast("string"))))
        kept = resolved.join(judged.filter("status = 'done'").select("path"), "path", "left_semi")
        writes = stages.cut(conflict_writes(plan.filter("action = 'conflict'"), kept))
        for side in sides:
            rows = writes.filter(F.col(f"to_{side}").isNotNull()).select(f"to_{side}.*")
            settle(side, _written(sides[side], rows), rows)
        siblings = kept.filter("duplicate_path is not null").select(F.col("duplicate_path").alias("path"))
        aborted = _aborts(judged)

    unpulled = None
    for side in sides:
        moves = plan.filter(F.col("action") == f"rename_{side}")
        if f"rename_{side}" not in present:
            continue
        if aborted:
            ended(_not_run(moves, "aborted"))
            continue
        judged = ended(stages.cut(renamed(moves, sides[side], results, unfinished(all_outcomes()))))
        done = judged.filter("status = 'done'")
        settle(side, tree.rewrite_subtrees(sides[side], done.select("old_path", F.col("path").alias("new_path"))), done.select("path"))
        if side == "local":
            wanting = done.filter(F.coalesce("needs_pull", F.lit(False))).select("path", F.lit("pull").alias("action"), F.lit(None).cast("string").alias("old_path"), F.lit(False).alias("is_folder"), "local", "remote", "prev")
            if pull_renamed and not wanting.isEmpty():
                pulls = ended(stages.cut(transfer(wanting, sides["local"], sides["remote"], results, {"pull"})))
                copied = pulls.filter("status = 'done'").select("source.*")
                settle("local", _written(sides["local"], copied))
                wanting = wanting.join(copied.select("path"), "path", "left_anti")
            unpulled = stages.cut(wanting.select("path"))
    aborted = aborted or _aborts(all_outcomes())

    open_ = unfinished(all_outcomes())
    for side in sides:
        deletions = plan.filter(F.col("action") == f"delete_{side}")
        if f"delete_{side}" not in present:
            continue
        if aborted:
            ended(_not_run(deletions, "aborted"))
            continue
        judged = stages.cut(_judged(_blocked(deletions, open_).join(results, ["path", "action"], "left"), F.lit(None).cast("string"), F.col("blocked")).drop("blocked"))
        settle(side, tree.remove_subtrees(sides[side], ended(judged).filter("status = 'done'").select("path")))

    told = stages.cut(all_outcomes())
    if folders and not aborted and present & TAKING:
        for side in sides:
            settle(side, sides[side].join(emptied(sides[side], told.filter("status = 'done'")), "path", "left_anti"))
    return Applied(told, sides["local"], sides["remote"], _committed(plan, told, sides, baseline, synced_at, moved, siblings, unpulled))


def emptied(listing: DataFrame, done: DataFrame) -> DataFrame:
    """(path) of the folders of a side that deletions and renames left empty, and with them those above.

    A folder of one side is made on the other before what is in it is deleted, so both sides look at what either deleted.
    """
    touched = done.filter(F.col("action").isin(*TAKING)).select(F.coalesce("old_path", "path").alias("path"))
    return tree.prunable_folders(listing.select("path", "is_directory"), touched)


def _committed(plan: DataFrame, told: DataFrame, sides: dict[str, DataFrame], baseline: DataFrame, synced_at: int, moved: DataFrame | None, siblings: DataFrame | None, unpulled: DataFrame | None) -> DataFrame:
    """The baseline after what is done, from what both sides have then."""
    # the pull after a rename is no action of the plan: its rename settles the path
    done = told.filter("status = 'done'").join(plan.select("path", "action", "prev"), ["path", "action"]).select("path", "action", "old_path", "is_folder", "prev")
    if siblings is not None:
        more = siblings.select("path", F.lit("match").alias("action"), F.lit(None).cast("string").alias("old_path"), F.lit(False).alias("is_folder"))
        done = done.unionByName(more, allowMissingColumns=True)
    both = done.join(_row(sides["local"], "local"), "path", "left").join(_row(sides["remote"], "remote"), "path", "left")
    if unpulled is not None:
        before = F.struct(
            F.col("path"), F.lit(False).alias("is_directory"), F.col("prev.remote_size").alias("size"), F.lit(0).cast("bigint").alias("mtime"), F.lit("").alias("hash"),
            F.col("prev.remote_checksum").alias("remote_checksum"), F.col("prev.backend_meta").alias("backend_meta"),
        )
        both = both.join(unpulled.withColumn("old_state", F.lit(True)), "path", "left").withColumn("remote", F.when(F.col("old_state") & F.col("prev").isNotNull(), before).otherwise(F.col("remote")))
    if moved is not None:
        moved = _unmoved(moved, told.filter(F.col("action").isin("rename_local", "rename_remote") & F.coalesce("is_folder", F.lit(False)) & (F.col("status") != "done")))
    return state.commit(baseline, both, synced_at, moved)

"""One whole cycle: detect, guard, plan, rewrite, hold, apply, commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tidemark.operators import apply, conflict, detect, guards, rename, stages


@dataclass(frozen=True)
class Settings:
    """Fixed defaults of a cycle. Without a ``strategy`` ("auto_merge" or "duplicate") conflicts stay in the plan."""

    deletion_limit: int | None = guards.DELETION_LIMIT
    most_bytes: int | None = None
    keep: Column | None = None
    strategy: str | None = None
    reserved: tuple[str, ...] = ()
    folders: bool = False


@dataclass(frozen=True)
class Calls:
    """What a cycle meets when it runs: calls that failed, (path, base, local_text, remote_text) for merges, and the listings if they have changed since the plan."""

    faults: DataFrame | None = None
    texts: DataFrame | None = None
    local: DataFrame | None = None
    remote: DataFrame | None = None


@dataclass(frozen=True)
class Cycle:
    """The plan, the deletions held back, what became of rename pairs, of the actions (``told``) and of conflicts (``resolved``), and both listings and the baseline after it."""

    plan: DataFrame
    held: DataFrame
    outcome: DataFrame
    local: DataFrame
    remote: DataFrame
    baseline: DataFrame
    told: DataFrame
    resolved: DataFrame | None = None


def run(mixed: DataFrame, local: DataFrame, remote: DataFrame, baseline: DataFrame, renames: tuple[DataFrame, DataFrame, DataFrame] | None = None, settings: Settings = Settings(), synced_at: int = 0, velocity_tripped: bool = False, calls: Calls = Calls()) -> Cycle:
    """The cycle from the keys that were found on: plan, rewrite, hold, resolve, apply, commit."""
    if settings.most_bytes is not None:
        mixed = detect.within_size(mixed, settings.most_bytes)
    plan, outcome, moved = stages.cut(rename.widen(detect.plan(mixed))), None, None
    if renames:
        rewritten = rename.refine(plan, *renames)
        plan, outcome, moved = rewritten.plan, rewritten.outcome, rewritten.moved
    split = guards.quarantine(stages.kept(plan), settings.deletion_limit, velocity_tripped)
    local, remote = calls.local if calls.local is not None else local, calls.remote if calls.remote is not None else remote
    resolved = None
    if settings.strategy:
        taken = local.select("path").union(remote.select("path"))
        resolved = stages.cut(conflict.resolve(split.safe.filter("action = 'conflict'"), taken, calls.texts, settings.strategy, synced_at))
    now = apply.apply_plan(split.safe, local, remote, baseline, synced_at, faults=calls.faults, resolved=resolved, moved=moved, reserved=settings.reserved, folders=settings.folders)
    return Cycle(split.safe, split.held, outcome, now.local, now.remote, now.baseline, now.outcomes, resolved)


def cold_cycle(local: DataFrame, remote: DataFrame, baseline: DataFrame, renames: tuple[DataFrame, DataFrame, DataFrame] | None = None, settings: Settings = Settings(), synced_at: int = 0, velocity_tripped: bool = False, calls: Calls = Calls()) -> Cycle:
    """A full reconciliation. ``renames`` is (local files, local folders, remote pairs).

    A listing that is too short, against the baseline, raises before anything is planned. Listings are read once and written, as the
    phases of a cycle read them many times.
    """
    local, remote, baseline = (stages.kept(x) for x in (local, remote, baseline))
    mixed = detect.cold(local, remote, baseline, settings.keep)
    guards.check_listings(mixed)
    return run(mixed, local, remote, baseline, renames, settings, synced_at, velocity_tripped, calls)


def warm_cycle(local: DataFrame, remote: DataFrame, baseline: DataFrame, told: DataFrame, renames: tuple[DataFrame, DataFrame, DataFrame] | None = None, settings: Settings = Settings(), synced_at: int = 0, velocity_tripped: bool = False, calls: Calls = Calls()) -> Cycle:
    """Local rows against the baseline, and the remote only where its feed ``told`` (path) of changes."""
    moved = local.sparkSession.createDataFrame([], "old_path string, new_path string") if renames is None else renames[2].select("old_path", "new_path")
    return run(detect.warm(local, remote, baseline, told, moved, settings.keep), local, remote, baseline, renames, settings, synced_at, velocity_tripped, calls)


def hot_cycle(local: DataFrame, remote: DataFrame, baseline: DataFrame, dirty: DataFrame, told: DataFrame, renames: tuple[DataFrame, DataFrame, DataFrame] | None = None, settings: Settings = Settings(), synced_at: int = 0, velocity_tripped: bool = False, calls: Calls = Calls()) -> Cycle:
    """Only the keys of ``dirty`` (path) and those that the remote feed ``told`` of."""
    return run(detect.hot(local, remote, baseline, dirty, told, settings.keep), local, remote, baseline, renames, settings, synced_at, velocity_tripped, calls)


def approve_held(now: Cycle, synced_at: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(local, remote, baseline) after the deletions that a cycle held were approved: all of them run. Their counts start anew with the next cycle."""
    done = apply.apply_plan(now.held, now.local, now.remote, stages.cut(now.baseline), synced_at)
    return done.local, done.remote, done.baseline

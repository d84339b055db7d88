"""What becomes of single actions: refusals, failed calls, what they block, aborts, and what the next cycle finds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import apply, conflict, detect, rename
from tidemark.operators.schema import BASELINE, ENTITY
from tidemark.plans import cycle, fixtures

PLAN = f"path string, action string, old_path string, is_folder boolean, needs_pull boolean, local struct<{apply._struct(ENTITY)}>, remote struct<{apply._struct(ENTITY)}>, prev struct<{apply._struct(BASELINE)}>"


def file(path: str, size: int = 1, mtime: int = 5, folder: bool = False, md5: str | None = None) -> tuple:
    return (path, folder, size, mtime, "", ("md5", md5) if md5 else None, None)


def listing(spark, *rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else file(r) for r in rows], ENTITY)


def known(path: str, md5: str | None = None) -> tuple:
    return (path, "", 5, 5, 1, 1, ("md5", md5) if md5 else None, None, 1)


def action(kind: str, path: str, old: str | None = None, folder: bool = False, pull: bool = False) -> tuple:
    row = file(path, folder=folder)
    return (path, kind, old, folder, pull, row, row, known(old or path, "x"))


def run(spark, plan, local, remote, faults=(), baseline=(), **more):
    done = apply.apply_plan(spark.createDataFrame(plan, PLAN), local, remote, spark.createDataFrame(list(baseline), BASELINE), 9, faults=spark.createDataFrame([(*f, None) for f in faults], apply.FAULTS), **more)
    told = {(r["action"], r["path"]): (r["status"], r["reason"], r["attempts"]) for r in done.outcomes.collect()}
    names = lambda rows: {r["path"] for r in rows.collect()}
    return told, names(done.local), names(done.remote), names(done.baseline), done


def test_refusals_of_transfers(spark):
    local = listing(spark, "a", "b/c", file("d", folder=True), "e", "f", "meta", file("dir", folder=True), "up/x")
    remote = listing(spark, "b", file("e", folder=True), file("g", folder=True), "dir")
    plan = [action("push", p) for p in ("a", "b/c", "d", "e", "gone", "meta")] + [action("push", "dir", folder=True), action("push", "new", folder=True), action("pull", "f/x"), action("pull", "b"), action("pull", "b/deep")]
    told, left, right, base, _ = run(spark, plan, local, remote, reserved=("meta",))
    assert told == {
        ("push", "a"): ("done", None, 1),
        ("push", "b/c"): ("refused", "parent_is_file", 0),
        ("push", "d"): ("refused", "source_is_folder", 0),
        ("push", "e"): ("refused", "folder_in_the_way", 0),
        ("push", "gone"): ("refused", "source_missing", 0),
        ("push", "meta"): ("refused", "reserved_path", 0),
        ("push", "dir"): ("refused", "file_in_the_way", 0),
        ("push", "new"): ("done", None, 1),
        ("pull", "f/x"): ("refused", "source_missing", 0),
        ("pull", "b"): ("done", None, 1),
        ("pull", "b/deep"): ("refused", "source_missing", 0),
    }
    assert "a" in right and "new" in right and "b" in left and base == {"a", "b"}


@pytest.mark.parametrize(
    ("kinds", "expected"),
    [
        (["transient"], ("done", None, 2)),
        (["transient", "rateLimit"], ("done", None, 3)),
        (["transient"] * 3, ("failed", "transient", 3)),
        (["transient", "notFound"], ("failed", "notFound", 2)),
        (["permission"], ("failed", "permission", 1)),
        (["storageFull"], ("failed", "storageFull", 1)),
    ],
)
def test_calls_are_repeated_while_that_can_help(spark, kinds, expected):
    faults = [("a", "push", i + 1, kind) for i, kind in enumerate(kinds)]
    told, _, right, base, _ = run(spark, [action("push", "a")], listing(spark, "a"), listing(spark), faults)
    assert told == {("push", "a"): expected}
    assert (right, base) == (({"a"}, {"a"}) if expected[0] == "done" else (set(), set()))


def test_a_rename_is_called_once(spark):
    told, left, *_ = run(spark, [action("rename_local", "b", "a")], listing(spark, "a"), listing(spark, "b"), [("b", "rename_local", 1, "transient")])
    assert told == {("rename_local", "b"): ("failed", "transient", 1)} and left == {"a"}


def test_what_failed_keeps_its_folder_from_being_deleted_or_moved(spark):
    plan = [action("pull", "f/a"), action("delete_local", "f", folder=True), action("delete_local", "f2"), action("push", "g/x"), action("rename_remote", "h", "g", folder=True), action("delete_remote", "z")]
    local, remote = listing(spark, "f/b", "f2", "g/x", "h/y"), listing(spark, "f/a", "g/y", "z")
    told, left, right, _, _ = run(spark, plan, local, remote, [("f/a", "pull", 1, "notFound"), ("g/x", "push", 1, "permission")])
    assert told[("delete_local", "f")] == ("blocked", "earlier_failure", 0) and told[("rename_remote", "h")][0] == "blocked"
    assert told[("delete_local", "f2")][0] == told[("delete_remote", "z")][0] == "done"
    assert left == {"f/b", "g/x", "h/y"} and right == {"f/a", "g/y"}


def test_without_authority_later_phases_do_not_run(spark):
    plan = [action("push", "a"), action("push", "b"), action("rename_local", "d", "c"), action("delete_local", "e"), action("conflict", "k")]
    told, left, right, base, _ = run(spark, plan, listing(spark, "a", "b", "c", "e"), listing(spark), [("a", "push", 1, "auth")], [known("e"), known("c")])
    assert told[("push", "a")] == ("failed", "auth", 1) and told[("push", "b")][0] == "done"
    assert {told[x][0] for x in (("rename_local", "d"), ("delete_local", "e"), ("conflict", "k"))} == {"aborted"}
    assert left == {"a", "b", "c", "e"} and right == {"b"} and base == {"b", "c", "e"}


def test_parents_are_made_and_emptied_folders_go(spark):
    local = listing(spark, file("x", folder=True), file("x/y", folder=True), "x/y/old", file("keep", folder=True))
    remote = listing(spark, "p/q/new")
    told, left, right, _, _ = run(spark, [action("pull", "p/q/new"), action("delete_local", "x/y/old")], local, remote, folders=True)
    assert {s for s, *_ in told.values()} == {"done"}
    assert left == {"keep", "p", "p/q", "p/q/new"}


def sides(spark, *rows):
    return [spark.createDataFrame(list(r), ENTITY) for r in rows]


@pytest.mark.parametrize("fails", [False, True])
def test_an_edit_that_came_with_a_remote_rename_is_not_lost(spark, fails):
    local, remote = sides(spark, [file("a.md", 10, 5)], [file("b.md", 25, 7, md5="new")])
    baseline = spark.createDataFrame([("a.md", "", 5, 5, 10, 10, ("md5", "old"), None, 1)], BASELINE)
    none = spark.createDataFrame([], "old_path string, new_path string, ordinal bigint")
    pairs = spark.createDataFrame([("a.md", "b.md", False)], "old_path string, new_path string, is_folder boolean")
    faults = spark.createDataFrame([("b.md", "pull", 1, "notFound", None)] if fails else [], apply.FAULTS)
    done = cycle.cold_cycle(local, remote, baseline, (none, none, pairs), calls=cycle.Calls(faults=faults))
    assert [r["size"] for r in done.local.collect()] == [10 if fails else 25]
    plan = detect.plan(detect.cold(done.local, done.remote, done.baseline)).select("path", "action").collect()
    assert [tuple(r) for r in plan] == ([("b.md", "pull")] if fails else [])
    if fails:
        again = cycle.cold_cycle(done.local, done.remote, done.baseline)
        assert [r["size"] for r in again.local.collect()] == [25]
        assert detect.plan(detect.cold(again.local, again.remote, again.baseline)).isEmpty()


def test_files_below_a_folder_whose_rename_failed_keep_their_baseline(spark):
    local, remote = listing(spark, "f/a", "f/b", "g/c"), listing(spark, "F/a", "F/b", "G/c")
    plan = [action("rename_local", "F", "f", folder=True), action("rename_local", "G", "g", folder=True)]
    moved = spark.createDataFrame([("f/a", "F/a"), ("f/b", "F/b"), ("g/c", "G/c")], "old_path string, new_path string")
    told, left, _, base, _ = run(spark, plan, local, remote, [("F", "rename_local", 1, "transient")], [known("f/a"), known("f/b"), known("g/c")], moved=moved)
    assert told[("rename_local", "F")][0] == "failed" and told[("rename_local", "G")][0] == "done"
    assert left == {"f/a", "f/b", "G/c"} and base == {"f/a", "f/b", "G/c"}


def test_resolved_conflicts_are_written_to_both_sides(spark):
    local = [file("merge.md", 3, 5), file("twin.bin", 3, 0), file("mine.bin", 3, 9), file("theirs.bin", 3, 5), file("only.bin", 3, 9), file("broken.bin", 4, 9)]
    remote = [file("merge.md", 4, 6, md5="r1"), file("twin.bin", 4, 6, md5="r2"), file("mine.bin", 4, 6, md5="r3"), file("theirs.bin", 4, 8, md5="r4"), file("gone.bin", 4, 8, md5="r5"), file("broken.bin", 7, 3, md5="r6"), file("twin.conflict.bin", 9, 9, md5="z")]
    base = [known(p, "x") for p in ("merge.md", "twin.bin", "mine.bin", "theirs.bin", "only.bin", "gone.bin", "broken.bin")]
    texts = spark.createDataFrame([("merge.md", "a\nb\nc", "x\nb\nc", "a\nb\nz")], "path string, base string, local_text string, remote_text string")
    a, b = sides(spark, local, remote)
    settings = cycle.Settings(strategy="auto_merge", deletion_limit=None)
    faults = spark.createDataFrame([("broken.bin", "conflict", 1, "transient", None)], apply.FAULTS)
    done = cycle.cold_cycle(a, b, spark.createDataFrame(base, BASELINE), settings=settings, synced_at=9, calls=cycle.Calls(texts=texts, faults=faults))
    sizes = [{r["path"]: r["size"] for r in rows.collect()} for rows in (done.local, done.remote)]
    assert sizes[0] == {"merge.md": 5, "twin.bin": 3, "twin.conflict-2.bin": 4, "mine.bin": 3, "theirs.bin": 4, "only.bin": 3, "gone.bin": 4, "broken.bin": 4, "twin.conflict.bin": 9}
    assert sizes[1] == sizes[0] | {"broken.bin": 7}
    left = detect.plan(detect.cold(done.local, done.remote, done.baseline)).select("path", "action").collect()
    # a copy whose time nobody knows can't be shown unchanged
    assert {tuple(r) for r in left} - {("twin.bin", "conflict")} == {("broken.bin", "conflict")}


def test_the_other_strategy_keeps_both(spark):
    a, b = sides(spark, [file("n.md", 3, 5)], [file("n.md", 4, 6, md5="r")])
    done = cycle.cold_cycle(a, b, spark.createDataFrame([known("n.md", "x")], BASELINE), settings=cycle.Settings(strategy="duplicate"), synced_at=9)
    for rows in (done.local, done.remote):
        assert {r["path"]: r["size"] for r in rows.collect()} == {"n.md": 3, "n.conflict.md": 4}
    assert detect.plan(detect.cold(done.local, done.remote, done.baseline)).isEmpty()


def test_an_empty_plan_changes_nothing(spark):
    told, left, right, base, _ = run(spark, [], listing(spark, "a"), listing(spark, "b"), baseline=[known("c")])
    assert (told, left, right, base) == ({}, {"a"}, {"b"}, {"c"})
    assert rename.widen(spark.createDataFrame([], "path string")).columns and conflict.NAMES == 100


def test_passes_of_renames_do_not_repeat_those_before(spark):
    local, remote, baseline, pairs = fixtures.remote_moves(spark, "/root/testdata/sf0.001")
    none = spark.createDataFrame([], "old_path string, new_path string, ordinal bigint")
    rewritten = rename.refine(detect.plan(detect.cold(local, remote, baseline)), none, none, pairs)
    assert rewritten.plan._jdf.queryExecution().analyzed().toString().count("Relation ") <= 8
    assert rewritten.plan.filter("action = 'rename_local'").count() == pairs.filter("cast(regexp_extract(old_path, 'doc-([0-9]+)', 1) as bigint) % 10 < 8").count()

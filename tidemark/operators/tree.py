"""Operators on hierarchies that are addressed by id or by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators import stages


def relevant_parent(nodes: DataFrame, root: str) -> DataFrame:
    """Add ``parent_id``: the root if it is a parent, else the first parent that is a node, else null. ``nodes`` has (id, parent_ids)."""
    listed = nodes.select("id", F.posexplode_outer("parent_ids").alias("at", "parent"))
    known = listed.join(stages.many(nodes.select(F.col("id").alias("parent"))), "parent", "left_semi")
    first = known.groupBy("id").agg(F.min_by("parent", "at").alias("known_parent"))
    at_root = F.coalesce(F.array_contains("parent_ids", root), F.lit(False))
    return nodes.join(stages.many(first), "id", "left").withColumn("parent_id", F.when(at_root, F.lit(root)).otherwise(F.col("known_parent"))).drop("known_parent")


def _doubled(state: DataFrame, rounds: int = 2) -> DataFrame:
    """Let every open node take the path of the node that it points at, and point where that one does. Each round doubles the levels that are done."""
    for _ in range(rounds):
        above = state.select(F.col("id").alias("up"), F.col("path").alias("above"), F.col("up").alias("next"))
        path = F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat_ws("/", "above", "path"))
        state = state.join(stages.many(above), "up", "left").select("id", path.alias("path"), F.col("next").alias("up"))
    return state


def _closed(state: DataFrame) -> DataFrame:
    """``state`` (id, path, up) once nothing changes: what still points upwards then is in a cycle or below one.

    While a chain to the top is open, a round closes some of its nodes, however long it is.
    """
    before = None
    while before != 0:
        state = stages.cut(_doubled(state))
        now = state.filter("up is not null").count()
        if now == before:
            break
        before = now
    return state


def cycle_members(links: DataFrame) -> DataFrame:
    """(id) of the nodes of ``links`` (id, up) that reach themselves. Each node has one link, and every link leads to a node of ``links``.

    The nodes that others reach in 1, 2, 4, ... steps become fewer until only the cycles are left, each of whose nodes is reached.
    """
    size, reached = None, links
    while True:
        now = reached.agg(F.count_distinct("up")).first()[0]
        if now == size:
            return reached.select(F.col("up").alias("id")).distinct()
        size = now
        step = reached.select(F.col("id").alias("up"), F.col("up").alias("next"))
        reached = stages.cut(reached.join(stages.many(step), "up").select("id", F.col("next").alias("up")))


def resolve_paths(nodes: DataFrame, root: str = "root") -> DataFrame:
    """(id, path) of each node (id, parent_ids, name), of any depth.

    A node whose chain ends outside of the tree has the path from there on. A member of a cycle is its name alone, whatever the input's
    order, and what hangs below a cycle has the path from the member on.
    """
    linked = stages.cut(relevant_parent(nodes.select("id", "parent_ids", "name"), root))
    up = F.when(F.col("parent_id") == root, None).otherwise(F.col("parent_id"))
    state = _closed(linked.select("id", F.col("name").alias("path"), up.alias("up")))
    looped = state.filter("up is not null").select("id")
    if looped.isEmpty():
        return state.select("id", "path")
    again = linked.join(looped, "id", "left_semi").select("id", F.col("name").alias("path"), F.col("parent_id").alias("up"))
    members = cycle_members(again.select("id", "up")).withColumn("member", F.lit(True))
    again = again.join(members, "id", "left").select("id", "path", F.when(F.col("member"), None).otherwise(F.col("up")).alias("up"))
    return state.filter("up is null").select("id", "path").unionByName(_closed(again).select("id", "path"))


def reaching(nodes: DataFrame, tops: DataFrame, root: str = "root") -> DataFrame:
    """(id) of the nodes that are one of ``tops`` or below one, by the relevant parent, in rounds that double."""
    linked = relevant_parent(nodes.select("id", "parent_ids"), root)
    marked = linked.join(stages.many(tops.select("id").distinct().withColumn("hit", F.lit(True))), "id", "left")
    state = marked.select("id", F.when(F.col("parent_id") == root, None).otherwise(F.col("parent_id")).alias("up"), F.coalesce("hit", F.lit(False)).alias("hit"))
    levels = 1
    while True:
        for _ in range(2):
            above = state.select(F.col("id").alias("up"), F.col("hit").alias("hit_above"), F.col("up").alias("next"))
            joined = state.join(stages.many(above), "up", "left").withColumn("hit", F.col("hit") | F.coalesce("hit_above", F.lit(False)))
            state = joined.select("id", F.when(~F.col("hit"), F.col("next")).alias("up"), "hit")
            levels *= 2
        state = stages.cut(state)
        # a chain, one that runs into a cycle too, has no more levels than there are nodes
        if state.filter("up is not null").count() < levels:
            return state.filter("hit").select("id")


def children(nodes: DataFrame, folder: str) -> DataFrame:
    return nodes.filter(paths.parent(F.col("path")) == folder)


def descendants(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, path) of the rows below each folder, by equality on expanded ancestors."""
    above = rows.select("path", F.explode(paths.ancestors(F.col("path"))).alias("folder"))
    return above.join(folders.select(F.col("path").alias("folder")).distinct(), "folder")


def rewrite_subtrees(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Put each row under the new place of the nearest moved ancestor, or of itself. ``moves`` is (old_path, new_path)."""
    at = F.array_append(paths.ancestors(F.col("path")), F.col("path"))
    hit = rows.select("path", F.explode(at).alias("old_path")).distinct().join(moves, "old_path").groupBy("path").agg(F.max_by(F.struct("old_path", "new_path"), F.char_length("old_path")).alias("move"))
    moved = paths.rebase(F.col("path"), F.col("move.old_path"), F.col("move.new_path"))
    columns = [F.when(F.col("move").isNotNull(), moved).otherwise(F.col("path")).alias("path") if c == "path" else F.col(c) for c in rows.columns]
    return rows.join(hit, "path", "left").select(*columns)


def remove_subtrees(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Leave out each folder and all below it."""
    gone = folders.select(F.col("path").alias("gone")).distinct()
    inside = rows.select("path", F.explode(F.array_append(paths.ancestors(F.col("path")), F.col("path"))).alias("gone")).join(gone, "gone", "left_semi").select("path").distinct()
    return rows.join(inside, "path", "left_anti")


def prunable_folders(listing: DataFrame, touched: DataFrame) -> DataFrame:
    """(path) of folders to delete: ancestors of ``touched`` paths with no file below. ``listing`` is (path, is_directory) after the change.

    A folder that isn't an ancestor of a touched path stays and so keeps the folders above it.
    """
    candidates = touched.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    folders = listing.filter("is_directory").select("path").join(candidates, "path", "left_semi")
    keeps = listing.filter(~F.col("is_directory")).select("path").union(listing.filter("is_directory").select("path").join(candidates, "path", "left_anti"))
    kept = keeps.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return folders.join(kept, "path", "left_anti")


def missing_folders(new_paths: DataFrame, listing: DataFrame) -> DataFrame:
    """(path) of ancestors that must be made, the shallowest first by ``depth``; an ancestor that is a file is an error."""
    needed = new_paths.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    found = needed.join(listing.select("path", "is_directory"), "path", "left")
    checked = F.when(F.col("is_directory") == F.lit(False), F.raise_error(F.concat(F.lit("not a folder: "), F.col("path")))).otherwise(F.col("path"))
    return found.withColumn("path", checked).filter("is_directory is null").select("path", paths.depth(F.col("path")).alias("depth"))


def shallow_first(is_folder: Column, path: Column) -> list[Column]:
    """The order in which a page's entries apply: folders before files, by depth."""
    return [(~is_folder).cast("int"), F.greatest(paths.depth(path), F.lit(1))]

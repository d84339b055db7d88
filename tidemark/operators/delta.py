"""Applying change feeds to an id-addressed cache, and comparing two states of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import paths
from tidemark.operators import stages, tree


@dataclass(frozen=True)
class Applied:
    """The nodes with paths after a batch, and what it changed: (path, kind) and rename pairs."""

    nodes: DataFrame
    changed: DataFrame
    renames: DataFrame


def latest(delta: DataFrame) -> DataFrame:
    """The last entry of each id by (page, seq). A tombstone before an upsert of the same id is so forgotten."""
    return delta.groupBy("id").agg(F.max_by(F.struct(*delta.columns), F.struct("page", "seq")).alias("e")).select("e.*")


def apply_delta(nodes: DataFrame, delta: DataFrame, root: str = "root", reserved: tuple[str, ...] = ()) -> Applied:
    """Merge a batch of entries (page, seq, id, tombstone, parent_ids, name, is_folder, payload) into nodes (id, parent_ids, name, is_folder, payload).

    Set-based: the batch's last word on each id, then paths anew, then a comparison of both states by id. Where two ids claim one path,
    the one that the batch touched last stays, and the other goes with all below it. What moves out of the tree, or onto the root or a
    reserved path, is no longer tracked.
    """
    last = latest(delta)
    kept = nodes.join(stages.many(last.select("id")), "id", "left_anti").withColumn("at", F.lit(None).cast("struct<page:int,seq:int>"))
    put = last.filter(~F.col("tombstone")).select(*nodes.columns, F.struct(F.col("page").cast("int").alias("page"), F.col("seq").cast("int").alias("seq")).alias("at"))
    merged = stages.cut(kept.unionByName(put))
    inside = stages.cut(_inside(merged, root))
    resolved = inside.join(stages.many(tree.resolve_paths(inside, root)), "id")
    claim = Window.partitionBy("path").orderBy(F.col("at").desc_nulls_last(), "id")
    ranked = stages.cut(resolved.withColumn("claim", F.row_number().over(claim)))
    losers = ranked.filter("claim > 1").select("id")
    after = ranked.join(stages.many(tree.reaching(inside, losers, root)), "id", "left_anti")
    for r in reserved:
        after = after.filter((F.col("path") != r) & ~F.startswith("path", F.lit(f"{r}/")))
    after = after.filter("path <> ''").select(*nodes.columns, "path")
    before = nodes.join(stages.many(tree.resolve_paths(nodes, root)), "id")
    compared = compare_by_id(before, after, touched=put.select("id"))
    return Applied(after, compared.changed, compared.renames)


def _inside(nodes: DataFrame, root: str) -> DataFrame:
    """Nodes whose chain of parents reaches the root; orphans at the top are kept, as their parents may come later."""
    linked = tree.relevant_parent(nodes, root)
    outside = linked.filter(F.col("parent_id").isNull() & (F.size("parent_ids") > 0) & F.col("at").isNotNull()).select("id")
    return nodes.join(stages.many(tree.reaching(nodes, outside, root)), "id", "left_anti")


@dataclass(frozen=True)
class Compared:
    changed: DataFrame
    renames: DataFrame


def compare_by_id(before: DataFrame, after: DataFrame, touched: DataFrame | None = None) -> Compared:
    """One full join on the id. Paths that appear or change are ``modified``, paths that nothing has any more ``deleted``; moves are pairs.

    With payloads of both states, a changed payload is a modification too, so edits in place survive an expired cursor.
    """
    a = before.select("id", F.col("path").alias("old_path"), F.col("payload").alias("old_payload"), F.col("is_folder").alias("was_folder"))
    b = after.select("id", F.col("path").alias("new_path"), F.col("payload").alias("new_payload"), "is_folder")
    both = a.join(stages.many(b), "id", "full")
    if touched is not None:
        both = both.join(stages.many(touched.select("id").distinct().withColumn("touched", F.lit(True))), "id", "left")
    else:
        both = both.withColumn("touched", F.lit(False))
    moved = F.col("old_path") != F.col("new_path")
    edited = ~F.col("old_payload").eqNullSafe(F.col("new_payload"))
    fresh = F.col("new_path").isNotNull() & (F.col("old_path").isNull() | moved | edited | F.coalesce("touched", F.lit(False)))
    left = F.col("old_path").isNotNull() & (F.col("new_path").isNull() | moved)
    put = both.filter(fresh).select(F.col("new_path").alias("path"))
    gone = both.filter(left).select(F.col("old_path").alias("path")).join(stages.many(after.select("path")), "path", "left_anti")
    changed = put.withColumn("kind", F.lit("modified")).union(gone.withColumn("kind", F.lit("deleted"))).distinct()
    renames = both.filter(moved).select("old_path", "new_path", F.coalesce("is_folder", F.lit(False)).alias("is_folder"))
    return Compared(changed, renames)


def classify(changed: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, kind): a changed path that the cache has is modified, else deleted."""
    return changed.select("path").distinct().join(cache.select("path").withColumn("there", F.lit(True)), "path", "left").select("path", F.when(F.col("there"), "modified").otherwise("deleted").alias("kind"))


def untrackable(path, reserved: tuple[str, ...] = ()):
    """Outside of the root (null), the root itself, or reserved."""
    return path.isNull() | (path == "") | path.isin(*reserved)


def apply_path_delta(cache: DataFrame, entries: DataFrame, reserved: tuple[str, ...] = ()) -> Applied:
    """A whole drained batch of path-addressed entries (seq, tag, id, path, payload) on a cache (path, id, is_directory, payload).

    Tags are file, folder or deleted; deleted entries have no id, and others may have none. Upserts come first, then deletions, whatever
    their order, so a move is one rename. An id that the cache has at another path moves there with all below it, each row with the
    nearest folder that moved; whatever else stood at the target gives way with all below it. A deletion takes its path and all below,
    unless an upsert claims the path. An id that moves to a path that isn't tracked is dropped with all below it. ``changed`` tells what
    the cache has after the batch, and what it has no longer.
    """
    kept_columns = ["path", "id", "is_directory", "payload"]
    last = Window.partitionBy("path").orderBy(F.col("seq").desc())
    cache, entries = stages.cut(cache.select(*kept_columns)), stages.cut(entries.select("seq", "tag", "id", "path", "payload"))
    upserts = entries.filter("tag <> 'deleted'")
    lost_ids = upserts.filter(untrackable(F.col("path"), reserved) & F.col("id").isNotNull()).select("id").distinct()
    puts = upserts.filter(~untrackable(F.col("path"), reserved)).withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n")
    puts = stages.cut(puts.select("path", "id", (F.col("tag") == "folder").alias("is_directory"), "payload"))
    was = cache.filter("id is not null").select("id", F.col("path").alias("old_path"), F.col("is_directory").alias("was_folder"))
    renames = stages.cut(puts.filter("id is not null").select("id", F.col("path").alias("new_path")).join(was, "id").filter("old_path <> new_path").select("old_path", "new_path", F.col("was_folder").alias("is_folder")))
    # each step is read more than once by those after it
    left = tree.remove_subtrees(cache, cache.join(lost_ids, "id", "left_semi").select("path"))
    # moved rows are told from those that stand at a target already
    moved = stages.cut(tree.rewrite_subtrees(stages.cut(left).withColumn("was", F.col("path")), renames.select("old_path", "new_path")))
    same_place = (F.col("path") == F.col("was")) & F.col("path").isNotNull()
    targets = puts.select("path", F.col("id").alias("put_id"))
    evicted = moved.filter(same_place).join(targets, "path").filter(~F.col("id").eqNullSafe(F.col("put_id")) & F.col("id").isNotNull() & F.col("put_id").isNotNull()).select("path")
    evicted = stages.cut(evicted.distinct())
    gone_below = moved.filter(same_place).select("path", F.explode(F.array_append(paths.ancestors(F.col("path")), F.col("path"))).alias("top")).join(evicted.select(F.col("path").alias("top")), "top", "left_semi").select("path").distinct().withColumn("evicted", F.lit(True))
    standing = moved.join(gone_below, "path", "left").filter(F.col("evicted").isNull() | ~same_place).drop("evicted", "was")
    placed = stages.cut(standing.join(puts.select("path"), "path", "left_anti").dropDuplicates(["path"]).select(*kept_columns).unionByName(puts.select(*kept_columns)))
    deletions = entries.filter("tag = 'deleted'").filter(~untrackable(F.col("path"), reserved)).select("path").join(puts.select("path"), "path", "left_anti")
    after = stages.cut(tree.remove_subtrees(placed, deletions.join(placed.select("path"), "path", "left_semi")))
    before, now = cache.select("path", F.struct("id", "is_directory", "payload").alias("a")), after.select("path", F.struct("id", "is_directory", "payload").alias("b"))
    touched = puts.select("path").withColumn("put", F.lit(True))
    both = before.join(now, "path", "full").join(touched, "path", "left").filter(F.col("b").isNull() | F.col("a").isNull() | F.col("put") | ~F.col("a").eqNullSafe(F.col("b")))
    changed = classify(both, after)
    return Applied(after, changed, renames)


def drain_keys(tag, path) -> list:
    """What one-by-one appliers order a batch by: upserts before deletions, folders first, then by depth."""
    return [(tag == "deleted").cast("int"), (tag != "folder").cast("int"), paths.depth(path)]

"""What becomes of conflicts: strategy, outcome, names of duplicates, and the audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import paths
from tidemark.operators import predicates as p
from tidemark.operators import stages
from tidemark.operators.merge import merge_texts

#: Fixed value: what marks a conflict in a merged text.
MARKER = "[!sync-conflict]"
#: Fixed value: names that are tried before a time is put in.
NAMES = 100


def keep_newer(conflicts: DataFrame) -> DataFrame:
    """Add ``outcome``: kept_local, kept_remote or duplicated. A missing side loses; the later known time wins; equal content keeps local."""
    a, b = F.col("local"), F.col("remote")
    known = F.coalesce((a["mtime"] > 0) & (b["mtime"] > 0), F.lit(False))
    outcome = (
        F.when(a.isNull() & b.isNotNull(), "kept_remote")
        .when(b.isNull(), "kept_local")
        .when(known & (a["mtime"] > b["mtime"]), "kept_local")
        .when(known & (a["mtime"] < b["mtime"]), "kept_remote")
        .when(p.same_content(a, b), "kept_local")
        .otherwise("duplicated")
    )
    return conflicts.withColumn("outcome", outcome)


def duplicate(conflicts: DataFrame) -> DataFrame:
    """The other strategy: whatever is left of a pair is restored, and of two sides the remote one becomes a sibling."""
    return conflicts.withColumn("outcome", F.when(F.col("local").isNull() & F.col("remote").isNull(), "kept_local").otherwise("duplicated"))


def sibling_names(wanted: DataFrame, taken: DataFrame, now_ms: int = 0) -> DataFrame:
    """(path, duplicate_path): for each path that needs a sibling, the first free name on both sides.

    The number is read from each taken name, so one row a name meets the paths; the least gap among a path's numbers is free. Different
    paths can't want one name, as a name keeps its path's stem, extension and number.
    """
    found = F.regexp_extract(F.col("path"), r"^(.*)\.conflict(?:-([0-9]{1,9}))?(\.[^./]*)?$", 1)
    number = F.regexp_extract(F.col("path"), r"\.conflict-([0-9]{1,9})(\.[^./]*)?$", 1)
    rest = F.regexp_extract(F.col("path"), r"\.conflict(?:-[0-9]{1,9})?(\.[^./]*)?$", 1)
    marked = taken.select("path").filter(F.contains("path", F.lit(".conflict"))).distinct()
    numbers = marked.select(F.concat(found, rest).alias("of"), F.when(number == "", 1).otherwise(number.try_cast("int")).alias("n"), F.col("path").alias("name"))
    numbers = numbers.filter(F.col("n").between(1, NAMES) & (paths.conflict_name(F.col("of"), F.col("n")) == F.col("name"))).select(F.col("of").alias("path"), "n")
    held = wanted.select("path").distinct().join(numbers, "path", "left").groupBy("path").agg(F.collect_set("n").alias("held"))  # at most NAMES
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(NAMES)), "held"))
    return held.select("path", F.coalesce(paths.conflict_name(F.col("path"), free), paths.conflict_name(F.col("path"), F.lit(now_ms))).alias("duplicate_path"))


def resolve(conflicts: DataFrame, taken: DataFrame, texts: DataFrame | None = None, strategy: str = "auto_merge", now_ms: int = 0) -> DataFrame:
    """(path, outcome, duplicate_path, merged, has_markers) of each conflict.

    ``texts`` is (path, base, local_text, remote_text); a null base means that none is stored, an empty one is usable.
    """
    sized = F.greatest(F.col("local.size"), F.col("remote.size"))
    ready = F.col("local").isNotNull() & F.col("remote").isNotNull() & F.col("prev").isNotNull() & p.can_merge(F.col("path"), sized)
    none = F.lit(None).cast("string")
    if strategy == "auto_merge" and texts is not None:
        candidates = conflicts.filter(ready).select("path").join(texts.filter("base is not null").select("path", "base", F.col("local_text").alias("local"), F.col("remote_text").alias("remote")), "path")
        merged = merge_texts(candidates).select("path", "merged", "usable")
    else:
        merged = conflicts.select("path").limit(0).select("path", F.lit(None).cast("struct<success:boolean,content:string,has_conflicts:boolean,json_ok:boolean>").alias("merged"), F.lit(None).cast("boolean").alias("usable"))
    fallen = keep_newer(conflicts) if strategy == "auto_merge" else duplicate(conflicts)
    joined = fallen.join(merged, "path", "left")
    outcome = F.when(F.col("usable"), "merged").when(F.col("usable").isNotNull(), "duplicated").otherwise(F.col("outcome"))
    decided = joined.withColumn("outcome", outcome)
    twins = decided.filter((F.col("outcome") == "duplicated") & F.col("local").isNotNull() & F.col("remote").isNotNull())
    named = sibling_names(twins, taken, now_ms)
    has_markers = F.col("outcome").eqNullSafe(F.lit("merged")) & F.coalesce(F.col("merged.has_conflicts"), F.lit(False))
    return decided.join(named, "path", "left").select("path", "outcome", "duplicate_path", F.when(F.col("outcome") == "merged", F.col("merged.content")).otherwise(none).alias("merged"), has_markers.alias("has_markers"))


def audit_rows(resolved: DataFrame, at: int, first_seq: int = 0) -> DataFrame:
    """Rows for the history, numbered in order of the paths: by range, each range after the rows of those before it."""
    ranged = stages.cut(resolved.repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    numbered = ranged.withColumn("place", place).join(F.broadcast(starts), "part")
    return numbered.select((F.col("before") + F.col("place") - 1 + first_seq).cast("bigint").alias("seq"), "path", F.col("outcome").alias("action"), "duplicate_path", "has_markers", F.lit(at).cast("bigint").alias("at"))


def tracked_paths(index: DataFrame) -> DataFrame:
    """(path) from the ``- [[path]]`` lines of an index text in column ``text``."""
    return index.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^- \[\[(.+?)\]\]"), F.lit(1))).alias("path")).distinct()


def update_index(tracked: DataFrame, new: DataFrame, content: DataFrame) -> DataFrame:
    """Paths, old and new, that exist and still hold a marker. ``content`` is (path, text)."""
    return tracked.select("path").union(new.select("path")).distinct().join(content, "path").filter(F.contains("text", F.lit(MARKER))).select("path")


def index_text(tracked: DataFrame) -> DataFrame:
    """One row: the index as sorted lines, or that all is resolved."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_set("path")), lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")
    return tracked.agg(lines.alias("text")).withColumn("text", F.when(F.col("text") == "", "All conflicts are resolved.").otherwise(F.col("text")))

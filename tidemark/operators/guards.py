"""What keeps a plan from deleting too much, and the audit of a cycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import stages
from tidemark.operators.schema import HISTORY

#: Fixed values.
DELETION_LIMIT, VELOCITY_LIMIT, VELOCITY_WINDOW = 20, 100, "1 hour"
LEAST_BASELINE, LEAST_SHARE, HISTORY_CAP = 10, 0.5, 500
DELETIONS = ("delete_local", "delete_remote")


class IncompleteListing(Exception):
    """A listing has so few files, against the baseline, that absence in it can't mean deletion."""


@dataclass(frozen=True)
class Split:
    safe: DataFrame
    held: DataFrame


def with_hold(plan: DataFrame, limit: int | None, velocity_tripped: bool = False) -> DataFrame:
    """Add ``held``: all deletions, if there are more than ``limit`` of them or the rolling limit has tripped; else none. None is no limit."""
    deletion = F.col("action").isin(*DELETIONS)
    if velocity_tripped:
        return plan.withColumn("held", deletion)
    if limit is None:
        return plan.withColumn("held", F.lit(False))
    total = plan.filter(deletion).agg(F.count(F.lit(1)).alias("deletions"))  # one row
    return plan.join(F.broadcast(total)).withColumn("held", deletion & (F.col("deletions") > int(limit))).drop("deletions")


def quarantine(plan: DataFrame, limit: int | None = DELETION_LIMIT, velocity_tripped: bool = False, strict: bool = False) -> Split:
    marked = with_hold(plan, limit, velocity_tripped)
    held = marked.filter("held").drop("held")
    if strict and not held.isEmpty():
        raise ValueError("the plan has more deletions than the limit")
    return Split(marked.filter(~F.col("held")).drop("held"), held)


def listing_counts(mixed: DataFrame) -> DataFrame:
    """One row: baseline rows and files of each side, and the first side that is incomplete, local before remote."""
    is_file = lambda side: F.col(side).isNotNull() & ~F.coalesce(F.col(f"{side}.is_directory"), F.lit(False))
    counts = mixed.agg(F.count_if(F.col("prev").isNotNull()).alias("baseline"), F.count_if(is_file("local")).alias("local_files"), F.count_if(is_file("remote")).alias("remote_files"))
    least = F.floor(F.col("baseline") * LEAST_SHARE)
    enough = F.col("baseline") < LEAST_BASELINE
    return counts.withColumn("incomplete", F.when(enough, None).when(F.col("local_files") < least, "local").when(F.col("remote_files") < least, "remote"))


def check_listings(mixed: DataFrame) -> None:
    row = listing_counts(mixed).first()
    if row["incomplete"]:
        raise IncompleteListing(f"{row['incomplete']} listing: {row['local_files']} local and {row['remote_files']} remote files, {row['baseline']} in the baseline")


HOUR = 3_600_000_000
#: Rows of a key that one task sums in a window; beyond that, sums go by blocks.
MOST_KEY_ROWS = 500_000


def deletion_velocity(deletions: DataFrame, limit: int = VELOCITY_LIMIT) -> DataFrame:
    """``deletions`` is (key, ts, n). Adds ``total`` over the hour up to each row, its start included, and ``tripped``.

    A key of some hundred thousand rows is a window of its own. With a key of more, all go by ``block_totals``, where no task has all rows of a key.
    """
    hot = deletions.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > MOST_KEY_ROWS)
    if hot.isEmpty():
        hour = Window.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(-HOUR, 0)
        totals = deletions.withColumn("total", F.sum("n").over(hour))
    else:
        totals = block_totals(deletions)
    return totals.withColumn("tripped", F.col("total") > limit)


def block_totals(deletions: DataFrame, blocks: int | None = None) -> DataFrame:
    """``deletions`` with ``total`` as the difference of two running sums, one up to each row's time and one up to an hour before.

    Rows and the two places that each asks about are sorted into ranges by key and time. Each range sums its own, the sums of the ranges of a key,
    which are few, are summed before it, and so each row costs as much in a key of many rows as in one of few.
    """
    spark = deletions.sparkSession
    rows = stages.cut(deletions.withColumn("row_", F.monotonically_increasing_id()))
    at = F.unix_micros("ts")
    entry = lambda time, asks, n: F.struct(time.alias("at"), F.lit(asks).alias("asks"), n.cast("bigint").alias("n"))
    # at one time what is added comes first: the hour ends with the row's time and what else has it, and begins with what is exactly an hour before
    asked = rows.filter("ts is not null").select("key", "row_", F.explode(F.array(entry(at, 0, F.coalesce("n", F.lit(0))), entry(at, 1, F.lit(0)), entry(at - HOUR - 1, -1, F.lit(0)))).alias("e")).select("key", "row_", "e.*")
    places = asked.withColumn("late", F.abs("asks"))
    order = ["key", "at", "late", "row_"]
    ranged = stages.cut(places.repartitionByRange(blocks or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("block", F.spark_partition_id()))
    sums = ranged.groupBy("key", "block").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "block").orderBy("at", "late", "row_").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("run", F.sum("n").over(inside)).join(starts.withColumnRenamed("key", "key_"), F.col("key").eqNullSafe(F.col("key_")) & (ranged["block"] == starts["block"]))
    total = running.filter("asks <> 0").groupBy("row_").agg(F.sum(F.col("asks") * (F.col("run") + F.col("start"))).alias("total"))
    return rows.join(total, "row_", "left").drop("row_")


def action_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def detection_profile(mixed: DataFrame) -> DataFrame:
    """One row of counts: keys with a local side only, a remote side only, both, neither, and hashed on both sides."""
    left, right = F.col("local").isNotNull(), F.col("remote").isNotNull()
    hashed = (F.col("local.hash") != "") & (F.col("remote.hash") != "")
    return mixed.agg(*[F.count_if(c).alias(n) for n, c in (("local_only", left & ~right), ("remote_only", right & ~left), ("both", left & right), ("neither", ~left & ~right), ("enriched", hashed))])


def summary(outcomes: DataFrame, key: str | None = None) -> DataFrame:
    """Counts by what a user sees, and one line of text; with ``key``, one row for each burst of cycles."""
    groups = {"pushed": ("push",), "pulled": ("pull",), "matched": ("match",), "deleted": DELETIONS, "renamed": ("rename_local", "rename_remote"), "conflicts": ("conflict",)}
    counts = [F.count_if(F.col("action").isin(*actions) & ~F.coalesce("failed", F.lit(False))).alias(n) for n, actions in groups.items()] + [F.count_if(F.coalesce("failed", F.lit(False))).alias("errors")]
    rows = outcomes.groupBy(*([key] if key else [])).agg(*counts)
    said = F.filter(F.array(*[F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {n}"))) for n in (*groups, "errors")]), lambda s: s.isNotNull())
    return rows.withColumn("message", F.when(F.size(said) == 0, "nothing to do").otherwise(F.array_join(said, ", ")))


def append_history(history: DataFrame, new: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """The last ``cap`` rows by ``seq``."""
    return history.unionByName(new).orderBy(F.desc("seq")).limit(cap)


def load_history(spark, path: str) -> DataFrame:
    """The stored audit; a history that isn't there, or can't be read, is an empty one."""
    try:
        rows = spark.read.schema(HISTORY).json(path)
        return rows.filter("seq is not null") if not rows.isEmpty() else rows
    except (AnalysisException, SparkRuntimeException):
        return spark.createDataFrame([], HISTORY)


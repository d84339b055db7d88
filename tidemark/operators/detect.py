"""The three-way pivot and its incremental forms. All give rows (path, local, remote, prev), null structs for absent sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fingerprint
from tidemark.operators import predicates as p
from tidemark.operators import stages
from tidemark.operators.schema import BASELINE_FIELDS, ENTITY_FIELDS
from tidemark.operators.snapshots import SnapshotStore

SIDES = {"local": ENTITY_FIELDS, "remote": ENTITY_FIELDS, "prev": BASELINE_FIELDS}


def last_of_each(rows: DataFrame, order: str, key: str = "path") -> DataFrame:
    """The row with the greatest ``order`` for each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("row")).select("row.*")


def pivot(local: DataFrame, remote: DataFrame, baseline: DataFrame) -> DataFrame:
    """One shuffle on the path: a union of tagged rows and a grouped first non-null, where two chained full joins would shuffle twice."""
    given = {"local": local, "remote": remote, "prev": baseline}
    tagged = None
    for name, fields in SIDES.items():
        sides = [(F.struct(*fields) if n == name else F.lit(None)).alias(n) for n in SIDES]
        rows = given[name].select("path", *sides)
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy("path").agg(*[F.first(n, ignorenulls=True).alias(n) for n in SIDES])


def cold(local: DataFrame, remote: DataFrame, baseline: DataFrame, keep: Column | None = None) -> DataFrame:
    """Everything. ``keep`` is a filter on ``path`` and is put on each input, below the shuffle."""
    inputs = [x.filter(keep) if keep is not None else x for x in (local, remote, baseline)]
    return pivot(*inputs)


def _looked_up(keys: DataFrame, local: DataFrame, remote: DataFrame, baseline: DataFrame) -> DataFrame:
    """The sides of some keys, which are written. A few keys are sent to the listings, so of these only the rows that are asked for are shuffled."""
    wanted, out = stages.few(keys), keys
    for name, rows in (("local", local), ("remote", remote), ("prev", baseline)):
        found = rows.join(wanted, "path", "left_semi").select("path", F.struct(*SIDES[name]).alias(name))
        out = out.join(found, "path", "left")
    return out.select("path", *SIDES)


def warm(local: DataFrame, remote: DataFrame, baseline: DataFrame, remote_paths: DataFrame, renames: DataFrame, keep: Column | None = None) -> DataFrame:
    """Keys that changed: local rows against the baseline, baseline rows without a local one, what the remote reports, and ends of renames.

    The first two come from one full join of local rows and baseline, which also is the result's local and baseline side; the remote
    is looked up for the changed keys alone.
    """
    both = local.select("path", F.struct(*SIDES["local"]).alias("local")).join(baseline.select("path", F.struct(*SIDES["prev"]).alias("prev")), "path", "full")
    touched = F.col("local").isNull() | F.col("prev").isNull() | p.local_changed(F.col("local"), F.col("prev"))
    told = remote_paths.select("path").union(renames.select(F.explode(F.array("old_path", "new_path")).alias("path"))).distinct().withColumn("told", F.lit(True))
    rows = both.join(told, "path", "full").filter(F.coalesce("told", F.lit(False)) | touched)
    rows = rows if keep is None else rows.filter(keep)
    return rows.join(remote.select("path", F.struct(*SIDES["remote"]).alias("remote")), "path", "left").select("path", *SIDES)


def hot(local: DataFrame, remote: DataFrame, baseline: DataFrame, dirty: DataFrame, remote_paths: DataFrame, keep: Column | None = None, drop_remote_deletions: bool = False) -> DataFrame:
    """Only dirty keys and those that the remote reports, without the ones that need nothing."""
    rows = _looked_up(stages.cut(_hot_keys(dirty, remote_paths, keep)), local, remote, baseline)
    return rows.filter(p.worth_a_look(F.col("local"), F.col("remote"), F.col("prev"), drop_remote_deletions))


def _hot_keys(dirty: DataFrame, remote_paths: DataFrame, keep: Column | None) -> DataFrame:
    keys = dirty.select("path").union(remote_paths.select("path")).distinct()
    return keys if keep is None else keys.filter(keep)


def hot_stored(store: SnapshotStore, dirty: DataFrame, remote_paths: DataFrame, keep: Column | None = None, drop_remote_deletions: bool = False) -> DataFrame:
    """``hot`` over the stored listings ``local``, ``remote`` and ``baseline``: only the buckets that hold the keys are read."""
    keys = stages.cut(_hot_keys(dirty, remote_paths, keep))
    rows = _looked_up(keys, *store.narrow(("local", "remote", "baseline"), keys))
    return rows.filter(p.worth_a_look(F.col("local"), F.col("remote"), F.col("prev"), drop_remote_deletions))


def confirm_deletions(mixed: DataFrame, authoritative: DataFrame, side: str) -> DataFrame:
    """Fill ``side`` where the baseline has a key that the listing missed but an authoritative listing has."""
    found = authoritative.select("path", F.struct(*ENTITY_FIELDS).alias("found"))
    missing = F.col(side).isNull() & F.col("prev").isNotNull()
    return mixed.join(found, "path", "left").withColumn(side, F.when(missing, F.col("found")).otherwise(F.col(side))).drop("found")


def enrich_initial_match(mixed: DataFrame, content: DataFrame) -> DataFrame:
    """Give both sides of a new pair the sha256 of the local content if it has the remote's checksum.

    ``content`` is (path, content). Only pairs of equal size with a checksum that can be computed are joined to it, so nothing else
    is read or hashed.
    """
    local, remote = F.col("local"), F.col("remote")
    algo = remote["remote_checksum"]["algo"]
    wanted = F.coalesce(local.isNotNull() & remote.isNotNull() & F.col("prev").isNull() & ~p.has_hash(local) & ~p.has_hash(remote) & (local["size"] == remote["size"]) & fingerprint.is_computable(algo), F.lit(False))
    candidates = mixed.filter(wanted).select("path", algo.alias("algo"), remote["remote_checksum"]["value"].alias("value"))
    proved = candidates.join(content, "path").filter(fingerprint.digest(F.col("content"), F.col("algo")) == F.col("value")).select("path", F.sha2("content", 256).alias("sha"))
    out = mixed.join(proved, "path", "left")
    for side in ("local", "remote"):
        out = out.withColumn(side, F.when(F.col("sha").isNotNull(), F.col(side).withField("hash", F.col("sha"))).otherwise(F.col(side)))
    return out.drop("sha")


def enrich_rename_targets(mixed: DataFrame, renames: DataFrame, hashes: DataFrame) -> DataFrame:
    """Give targets of renames the hash from (path, hash), where the listing has none."""
    wanted = renames.select(F.col("new_path").alias("path")).distinct().join(hashes.select("path", F.col("hash").alias("found")), "path")
    fill = F.col("local").isNotNull() & ~p.has_hash(F.col("local")) & (F.col("found") != "")
    return mixed.join(wanted, "path", "left").withColumn("local", F.when(fill, F.col("local").withField("hash", F.col("found"))).otherwise(F.col("local"))).drop("found")


def within_size(mixed: DataFrame, most: int) -> DataFrame:
    return mixed.filter(F.greatest(F.coalesce("local.size", F.lit(0)), F.coalesce("remote.size", F.lit(0))) <= most)


def plan(mixed: DataFrame) -> DataFrame:
    """(path, action, local, remote, prev) for the keys with an action."""
    return mixed.withColumn("action", p.decide(F.col("local"), F.col("remote"), F.col("prev"))).filter(F.col("action").isNotNull()).select("path", "action", "local", "remote", "prev")


def temperature(tracker_ready: bool, has_dirty: bool, forced: bool, has_baseline: bool) -> str:
    if tracker_ready and has_dirty:
        return "hot"
    return "cold" if forced or not has_baseline else "warm"

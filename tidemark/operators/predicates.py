"""Change predicates and the decision table, as columns over (local, remote, prev) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import paths

#: What may be merged as text.
MERGE_EXTENSIONS = (".md", ".txt", ".json", ".canvas", ".base", ".css", ".js", ".ts", ".html", ".xml", ".yaml", ".yml", ".csv", ".svg", ".tex", ".bib", ".org", ".rst", ".adoc", ".toml", ".ini", ".cfg", ".conf", ".log", ".sh", ".bash", ".zsh", ".fish", ".py", ".rb", ".lua", ".sql", ".graphql", ".env", ".gitignore")
MERGE_BYTES = 1_048_576


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def has_hash(side: Column) -> Column:
    return _yes(side["hash"] != "")


def local_changed(local: Column, prev: Column) -> Column:
    """Hashes decide if both are known, else times and sizes; with neither, it counts as changed."""
    return (
        F.when(_yes(local["is_directory"]), False)
        .when(has_hash(local) & has_hash(prev), local["hash"] != prev["hash"])
        .when(_yes((local["mtime"] > 0) & (prev["local_mtime"] > 0)), (local["mtime"] != prev["local_mtime"]) | (local["size"] != prev["local_size"]))
        .otherwise(True)
    )


def remote_changed(remote: Column, prev: Column) -> Column:
    """Agreeing time and size mean no change. Else checksums of one algorithm decide; without them it counts as changed."""
    a, b = remote["remote_checksum"], prev["remote_checksum"]
    by_checksum = F.when(a["algo"] == b["algo"], a["value"] != b["value"])
    by_hash = F.when(has_hash(remote) & has_hash(prev), remote["hash"] != prev["hash"])
    timed = _yes((remote["mtime"] > 0) & (prev["remote_mtime"] > 0))
    agree = _yes((remote["mtime"] == prev["remote_mtime"]) & (remote["size"] == prev["remote_size"]))
    return (
        F.when(_yes(remote["is_directory"]), False)
        .when(timed & agree, F.coalesce(by_hash, F.lit(False)))
        .when(timed, F.coalesce(by_checksum, F.lit(True)))
        .otherwise(F.coalesce(by_checksum, by_hash, F.lit(True)))
    )


def content_key(side: Column) -> Column:
    """The sha256 if known, else the backend's checksum, else null."""
    return F.when(has_hash(side), F.struct(F.lit("sha256").alias("algo"), side["hash"].alias("value"))).otherwise(side["remote_checksum"])


def same_content(a: Column, b: Column) -> Column:
    ka, kb = content_key(a), content_key(b)
    return _yes((ka["algo"] == kb["algo"]) & (ka["value"] == kb["value"]))


def decide(local: Column, remote: Column, prev: Column) -> Column:
    """The action for a key; null where there is nothing to do."""
    left, right, base = local.isNotNull(), remote.isNotNull(), prev.isNotNull()
    lc, rc = local_changed(local, prev), remote_changed(remote, prev)
    matched = _yes(local["is_directory"] & remote["is_directory"]) | (same_content(local, remote) & _yes(local["size"] == remote["size"]))
    known_both = F.when(lc & rc, "conflict").when(lc, "push").when(rc, "pull")
    known = F.when(left & right, known_both).when(left, F.when(lc, "conflict").otherwise("delete_local")).when(right, F.when(rc, "conflict").otherwise("delete_remote")).otherwise("cleanup")
    new = F.when(left & right, F.when(matched, "match").otherwise("conflict")).when(left, "push").when(right, "pull")
    return F.when(base, known).otherwise(new)


def worth_a_look(local: Column, remote: Column, prev: Column, drop_remote_deletions: bool = False) -> Column:
    """Whether a key of the hot path can need an action.

    A key that only the remote lost counts, as the decision table deletes it; ``drop_remote_deletions`` leaves it out.
    """
    left, right, base = local.isNotNull(), remote.isNotNull(), prev.isNotNull()
    remote_gone = F.lit(False) if drop_remote_deletions else left & ~right
    return F.when(~left & ~right, base).otherwise(~base | (~left & right) | remote_gone | (left & local_changed(local, prev)) | (right & remote_changed(remote, prev)))


def can_merge(path: Column, size: Column) -> Column:
    return (size <= MERGE_BYTES) & paths.extension(path).isin(*MERGE_EXTENSIONS)

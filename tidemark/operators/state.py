"""What a cycle does to the baseline and to stored contents; ``snapshots`` keeps them."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidemark.functions import batches, paths
from tidemark.operators import predicates as p
from tidemark.operators.schema import ENTITY_FIELDS


#: Actions after which a key is agreed on, and those after which it is gone.
SETTLED = ("push", "pull", "match", "conflict", "rename_local", "rename_remote")
DROPPED = ("delete_local", "delete_remote", "cleanup")


def build_records(sides: DataFrame, synced_at: int) -> DataFrame:
    """Baseline rows from (path, local, remote) after an action: the hash of either side, and 0 for what is missing."""
    a, b = F.col("local"), F.col("remote")
    number = lambda side, f: F.coalesce(side[f], F.lit(0)).cast("bigint")
    return sides.select(
        "path",
        F.coalesce(F.when(p.has_hash(a), a["hash"]), F.when(p.has_hash(b), b["hash"]), F.lit("")).alias("hash"),
        number(a, "mtime").alias("local_mtime"),
        number(b, "mtime").alias("remote_mtime"),
        number(a, "size").alias("local_size"),
        number(b, "size").alias("remote_size"),
        b["remote_checksum"].alias("remote_checksum"),
        b["backend_meta"].alias("backend_meta"),
        F.lit(synced_at).cast("bigint").alias("synced_at"),
    )


def commit(baseline: DataFrame, done: DataFrame, synced_at: int, moved: DataFrame | None = None) -> DataFrame:
    """The next baseline after the actions ``done`` (path, action, old_path, is_folder, local, remote).

    Old rows of touched keys leave by an anti-join, new ones are added. ``moved`` (old_path, new_path) rewrites the paths of files below
    renamed folders.
    """
    settled = done.filter(F.col("action").isin(*SETTLED) & ~F.coalesce("is_folder", F.lit(False)))
    files = settled.filter(~(F.coalesce("local.is_directory", F.lit(False)) | F.coalesce("remote.is_directory", F.lit(False))) & (F.col("local").isNotNull() | F.col("remote").isNotNull()))
    fresh = build_records(files, synced_at)
    touched = done.select(F.explode(F.array("path", "old_path")).alias("path")).filter("path is not null").distinct()
    kept = baseline.join(touched, "path", "left_anti")
    kept = kept if moved is None else rewrite_paths(kept, moved)
    return kept.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)


def rewrite_paths(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rename rows by (old_path, new_path); a row that stood at a new path gives way."""
    moved = pairs.select(F.col("old_path").alias("path"), "new_path")
    displaced = pairs.select(F.col("new_path").alias("path")).join(pairs.select(F.col("old_path").alias("path")), "path", "left_anti")
    joined = rows.join(displaced, "path", "left_anti").join(moved, "path", "left")
    return joined.select(*[F.coalesce("new_path", "path").alias("path") if c == "path" else F.col(c) for c in rows.columns])


def get_many(baseline: DataFrame, keys: DataFrame) -> DataFrame:
    return baseline.join(keys.select("path").distinct(), "path", "left_semi")


def stat(wanted: DataFrame, listing: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """Each wanted path in its normal form with what the listing has there, null if nothing.

    With ``content`` (path, content) the bytes decide: a file's ``size`` and sha256 ``hash`` are those of what is stored now.
    """
    keys = wanted.select(paths.normalize(F.col("path")).alias("path")).distinct()
    found = keys.join(listing.select("path", F.struct(*[c for c in listing.columns if c != "path"]).alias("found")), "path", "left")
    if content is None:
        return found
    stored = found.join(content.select("path", F.col("content").cast("binary").alias("content")), "path", "left")
    file = F.col("content").isNotNull() & F.col("found").isNotNull() & ~F.col("found.is_directory")
    filled = F.col("found").withField("size", F.octet_length("content").cast("bigint")).withField("hash", F.sha2("content", 256))
    return stored.select("path", F.when(file, filled).otherwise(F.col("found")).alias("found"))


def read_content(wanted: DataFrame, listing: DataFrame, content: DataFrame) -> DataFrame:
    """(path, content) of wanted files; one that isn't there, or is a folder, is an error."""
    found = stat(wanted, listing).join(content.select("path", "content"), "path", "left")
    missing = F.col("found").isNull() | F.col("found.is_directory") | F.col("content").isNull()
    return found.select("path", F.when(missing, F.raise_error(F.concat(F.lit("not a file: "), F.col("path")))).otherwise(F.col("content")).alias("content"))


def merge_bases(content: DataFrame, done: DataFrame, texts: DataFrame) -> DataFrame:
    """The stored (path, content) after a cycle: kept for what stays and can be merged, replaced for what settled."""
    settled = done.filter(F.col("action").isin(*SETTLED)).select("path", F.coalesce("local.size", F.lit(0)).alias("size")).filter(p.can_merge(F.col("path"), F.col("size")))
    fresh = texts.join(settled.select("path"), "path", "left_semi").select("path", "content")
    gone = done.filter(F.col("action").isin(*DROPPED)).select("path").union(fresh.select("path")).distinct()
    return content.join(gone, "path", "left_anti").unionByName(fresh)


def reconcile_cache(touched: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upserts, deletes): touched paths that the live cache has, and those that it lacks."""
    keys = touched.select("path").distinct()
    return cache.join(keys, "path", "left_semi"), keys.join(cache.select("path"), "path", "left_anti")


def codec_encode(content: Column) -> Column:
    """One byte of format and the content: deflated where that is shorter, else as it is."""
    batches.bound()
    return _encoded(content)


def codec_decode(stored: Column) -> Column:
    """The content behind ``codec_encode``; another format is an error."""
    batches.bound()
    return _decoded(stored)


@F.pandas_udf(BinaryType())
def _encoded(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else _pack(bytes(c)))


def _pack(raw: bytes) -> bytes:
    packer = zlib.compressobj(wbits=-15)
    short = packer.compress(raw) + packer.flush()
    return b"\1" + short if len(short) < len(raw) else b"\0" + raw


@F.pandas_udf(BinaryType())
def _decoded(stored: pd.Series) -> pd.Series:
    def unpack(b: bytes | None) -> bytes | None:
        if b is None:
            return None
        if b[:1] == b"\1":
            return zlib.decompress(b[1:], wbits=-15)
        if b[:1] == b"\0":
            return bytes(b[1:])
        raise ValueError(f"unknown content format {b[:1]!r}")

    return stored.map(unpack)


def after_pull(baseline: DataFrame, pulled: DataFrame, synced_at: int) -> DataFrame:
    """The baseline after files (path, remote) were written locally with the remote's time."""
    both = pulled.select("path", F.struct(*[F.lit("").alias(f) if f == "hash" else F.col(f"remote.{f}").alias(f) for f in ENTITY_FIELDS]).alias("local"), "remote")
    return baseline.join(pulled.select("path"), "path", "left_anti").unionByName(build_records(both, synced_at))

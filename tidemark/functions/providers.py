"""Rows of three storage services as entities. Schemas are declared; a row without its required fields fails the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths

DRIVE = "id string, name string, mimeType string, size string, modifiedTime string, parents array<string>, trashed boolean, md5Checksum string"
DRIVE_CHANGE = f"type string, fileId string, removed boolean, file struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in DRIVE.split(', ')))}>"
DROPBOX = "`.tag` string, id string, name string, path_lower string, path_display string, rev string, size bigint, client_modified string, server_modified string, content_hash string"
ONEDRIVE = "id string, name string, size bigint, parentReference struct<id:string,path:string>, file struct<hashes:struct<quickXorHash:string,sha256Hash:string,sha1Hash:string>>, folder struct<childCount:bigint>, fileSystemInfo struct<lastModifiedDateTime:string>, lastModifiedDateTime string, deleted struct<state:string>"
#: Fixed value: the type of a folder.
FOLDER_TYPE = "application/vnd.google-apps.folder"


def required(row: DataFrame, *columns: str) -> DataFrame:
    """Fail on a null in any of these columns."""
    checks = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)).alias(c) for c in columns]
    return row.select(*[c for c in (F.col(f"`{n}`") for n in row.columns if n not in columns)], *checks)


def millis(time: Column) -> Column:
    """Epoch milliseconds of an ISO time; 0 if it can't be read."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(time)), F.lit(0)).cast("bigint")


def checksum(algo: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(algo).alias("algo"), value.alias("value")))


def _entity(path: Column, folder: Column, size: Column, mtime: Column, fingerprint: Column, meta: Column) -> list[Column]:
    file_only = lambda c, other: F.when(folder, F.lit(other)).otherwise(c)
    return [path.alias("path"), folder.alias("is_directory"), file_only(F.coalesce(size, F.lit(0)), 0).cast("bigint").alias("size"), file_only(mtime, 0).cast("bigint").alias("mtime"), F.lit("").alias("hash"), F.when(~folder, fingerprint).alias("remote_checksum"), meta.alias("backend_meta")]


def drive_entities(nodes: DataFrame) -> DataFrame:
    """``nodes`` has the API's columns and the resolved ``path``."""
    folder = F.col("mimeType") == FOLDER_TYPE
    return nodes.select(*_entity(F.col("path"), folder, F.col("size").try_cast("bigint"), millis(F.col("modifiedTime")), checksum("md5", F.col("md5Checksum")), F.create_map(F.lit("id"), F.col("id"))))


def dropbox_entities(entries: DataFrame, root: str = "") -> DataFrame:
    folder = F.col("`.tag`") == "folder"
    path = paths.relativize(F.col("path_lower"), F.col("path_display"), root)
    time = F.coalesce("server_modified", "client_modified")
    return entries.select(*_entity(path, folder, F.col("size"), millis(time), checksum("dropbox", F.col("content_hash")), F.create_map(F.lit("rev"), F.col("rev")))).filter(F.col("path").isNotNull() & (F.col("path") != ""))


def onedrive_entities(items: DataFrame) -> DataFrame:
    folder = F.col("folder").isNotNull()
    h = F.col("file.hashes")
    fingerprint = F.coalesce(checksum("quickxor", h["quickXorHash"]), checksum("sha256", F.lower(h["sha256Hash"])), checksum("sha1", F.lower(h["sha1Hash"])))
    time = F.coalesce("fileSystemInfo.lastModifiedDateTime", "lastModifiedDateTime")
    return items.select(*_entity(F.col("path"), folder, F.col("size"), millis(time), fingerprint, F.create_map(F.lit("id"), F.col("id"))))

"""Versioned snapshots of tables, whole or as increments, addressed by key, with commits that see each other.

A version has Parquet tables and a manifest with their places and the feed's cursor. The manifest is written last and by a name that only one
writer can take, so a writer that dies before it has changed nothing, the cursor is never ahead of the rows, and of two writers of one version
the second one finds that it came second. It then puts its change on top of the other's, if they don't touch each other, or raises ``CommitConflict``.

A table with a key lies in buckets of the key's hash, sorted by key inside, and the manifest names the buckets that have rows. A reader of
some keys opens their buckets alone, in the table and in its increments, and lists no other folder, so what it reads grows with the keys.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import stages

#: Rows of a bucket that are aimed at, and buckets of a table at most.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 4096
#: Keys that are put into the scan's filter, so that it skips row groups.
MOST_LITERALS = 10
#: Times that a commit is put on top of another one before it gives up.
MOST_TRIES = 20


class CommitConflict(Exception):
    """Another writer has committed something that this commit would undo."""


class _Keep:
    """The cursor stays as it is."""


KEEP = _Keep()


@dataclass(frozen=True)
class Version:
    """A manifest: its number, the cursor, and for each table where its rows are."""

    number: int = 0
    cursor: str | None = None
    tables: dict = field(default_factory=dict)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class SnapshotStore:
    """Snapshots under one folder, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests

    def versions(self) -> list[int]:
        """The numbers of the versions that there are, in ascending order."""
        at = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self, number: int) -> Version:
        stream = self._files.open(self._path(self._manifest(number)))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, found["cursor"], found["tables"])

    def current(self) -> Version | None:
        found = self.versions()
        return self.version(found[-1]) if found else None

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/manifests/{number:020}.json"

    def _take(self, version: Version) -> bool:
        """Write a manifest under its number; False if another writer has it. The content is complete before the name is taken."""
        draft, name = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}"), self._path(self._manifest(version.number))
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps({"cursor": version.cursor, "tables": version.tables}).encode()))
        out.close()
        self._files.mkdirs(name.getParent())
        if self._files.getUri().getScheme() == "file":
            # a rename would replace what is there; a link is refused
            try:
                os.link(*(unquote(urlsplit(self._files.makeQualified(x).toUri().toString()).path) for x in (draft, name)))
            except FileExistsError:
                return False
            finally:
                self._files.delete(draft, False)
            return True
        taken = not self._files.exists(name) and self._files.rename(draft, name)
        if not taken:
            self._files.delete(draft, False)
        return taken

    def _commit(self, base: Version, change: dict, cursor: str | None | _Keep, dropped: tuple[str, ...] = ()) -> Version:
        """Take the next number with ``change``: for each table a whole new place, or a step to be put on its last one."""
        for _ in range(MOST_TRIES):
            now = self.current() or Version()
            if now.number > base.number:
                self._check(base, now, change, cursor, dropped)
            tables = {k: v for k, v in now.tables.items() if k not in dropped}
            for name, (kind, place) in change.items():
                tables[name] = place if kind == "whole" else {**tables[name], "key": place["key"], "steps": [*tables[name]["steps"], place["step"]]}
            version = Version(now.number + 1, now.cursor if isinstance(cursor, _Keep) else cursor, tables)
            if self._take(version):
                return version
        raise CommitConflict(f"{MOST_TRIES} other commits came first")

    def _check(self, base: Version, now: Version, change: dict, cursor: str | None | _Keep, dropped: tuple[str, ...]) -> None:
        """Whether ``change``, made from ``base``, can be put on ``now``."""
        if not isinstance(cursor, _Keep) and now.cursor != base.cursor:
            raise CommitConflict("the cursor has moved")
        for name in (*change, *dropped):
            old, new = base.tables.get(name), now.tables.get(name)
            if old == new:
                continue
            kind, place = change.get(name, ("dropped", None))
            if kind != "step" or old is None or new is None or new["base"] != old["base"] or new["steps"][: len(old["steps"])] != old["steps"]:
                raise CommitConflict(f"{name} has been changed")
            key = place["key"]
            mine = self._read(place["step"], None, new["schema"]).select(key)
            for step in new["steps"][len(old["steps"]) :]:
                if not mine.join(self._read(step, None, new["schema"]).select(key), key, "left_semi").isEmpty():
                    raise CommitConflict(f"keys of {name} have been changed")

    # Rows

    def _write(self, rows: DataFrame, name: str, key: str | None, buckets: int | None) -> dict:
        path = f"{self.folder}/data/{uuid.uuid4().hex}/{name}"
        if key is None:
            rows.write.parquet(path)
            return {"path": path, "filled": None}
        placed = rows.withColumn("bucket_", bucket_of(F.col(key), buckets))
        placed.repartition(min(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket_").sortWithinPartitions("bucket_", key).write.partitionBy("bucket_").option("parquet.block.size", 4 << 20).parquet(path)
        at = self._path(path)
        filled = sorted(int(s.getPath().getName().removeprefix("bucket_=")) for s in self._files.listStatus(at) if s.getPath().getName().startswith("bucket_="))  # at most MOST_BUCKETS
        return {"path": path, "filled": filled}

    def _read(self, part: dict, wanted: list[int] | None, schema: str) -> DataFrame:
        """The rows of one written part, of the ``wanted`` buckets if there are such."""
        if part["filled"] is None:
            return self.spark.read.schema(schema).parquet(part["path"])
        buckets = part["filled"] if wanted is None else sorted({*wanted} & {*part["filled"]})
        if not buckets:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", part["path"]).schema(f"{schema}, bucket_ int").parquet(*[f"{part['path']}/bucket_={b}" for b in buckets]).drop("bucket_")

    def save(self, tables: dict[str, DataFrame], cursor: str | None | _Keep = KEEP, *, keys: dict[str, str] | None = None, buckets: int | None = None, based_on: Version | None = None, increments: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> int:
        """Write whole tables and, of tables that have a key, increments (upserts, deletes), then the manifest.

        Tables that aren't given stay as they are; those with a key in ``keys`` are put in buckets.
        """
        base = based_on or self.current() or Version()
        change = {}
        for name, rows in tables.items():
            key = (keys or {}).get(name)
            count = None if key is None else buckets or max(1, min(MOST_BUCKETS, rows.count() // BUCKET_ROWS))
            change[name] = ("whole", {"base": self._write(rows, name, key, count), "steps": [], "key": key, "buckets": count, "schema": rows._jdf.schema().toDDL()})
        for name, (upserts, deletes) in (increments or {}).items():
            change[name] = self._step(base, name, upserts, deletes, base.tables[name]["key"])
        version = self._commit(base, change, cursor)
        for name in increments or {}:
            version = self._compacted(version, name)
        return version.number

    def _step(self, base: Version, table: str, upserts: DataFrame, deletes: DataFrame, key: str) -> tuple[str, dict]:
        place = base.tables[table]
        rows = upserts.withColumn("gone_", F.lit(False)).unionByName(deletes.select(key).join(stages.many(upserts.select(key)), key, "left_anti").withColumn("gone_", F.lit(True)), allowMissingColumns=True)
        return "step", {"key": key, "step": self._write(rows, table, key if place["buckets"] else None, place["buckets"])}

    def _compacted(self, version: Version, table: str, most_steps: int = 20) -> Version:
        """The version with a table written whole that has had ``most_steps`` increments."""
        place = version.tables[table]
        if len(place["steps"]) < most_steps:
            return version
        try:
            keys = {table: place["key"]} if place["buckets"] else None
            return self.version(self.save({table: self.load(table, version)}, keys=keys, buckets=place["buckets"], based_on=version))
        except CommitConflict:  # the next one does it
            return version

    def commit_increment(self, table: str, upserts: DataFrame, deletes: DataFrame, cursor: str | None | _Keep = KEEP, key: str = "path", most_steps: int = 20, based_on: Version | None = None) -> int:
        """Write only what changed in a table and then the manifest with the cursor. After ``most_steps`` of them the table is written whole.

        ``based_on`` is the version that the change was made from, the current one by default. Another writer's increments since then stay; the same keys in
        both are a conflict.
        """
        base = based_on or self.current() or Version()
        if table not in base.tables:
            return self.save({table: upserts}, cursor, based_on=base)
        version = self._commit(base, {table: self._step(base, table, upserts, deletes, key)}, cursor)
        return self._compacted(version, table, most_steps).number

    def load(self, table: str, version: Version | None = None) -> DataFrame | None:
        """The rows of a table: its last whole version with the increments since put on it, the latest word on each key."""
        return self._rows(table, None, version)

    def narrow(self, tables: tuple[str, ...], keys: DataFrame, version: Version | None = None) -> list[DataFrame]:
        """For each of these tables, which have one key, the rows in the buckets of ``keys``: all rows with these keys and some others.

        ``keys`` is read for the numbers of its buckets, of which there are at most ``MOST_BUCKETS``. Few keys are put into the filter of the scan
        too. A table without buckets is read whole.
        """
        now = version or self.current()
        places = [now.tables[t] for t in tables]
        sizes = sorted({p["buckets"] for p in places if p["buckets"]})
        key = next((p["key"] for p in places if p["key"]), None)
        if not sizes:
            return [self._rows(t, None, now) for t in tables]
        buckets = keys.select(F.explode(F.array(*[F.struct(F.lit(n).alias("of"), bucket_of(F.col(key), n).alias("b")) for n in sizes])).alias("x")).select("x.*").distinct().collect()
        few = [r[0] for r in keys.select(key).distinct().limit(MOST_LITERALS + 1).collect()]
        out = []
        for name, place in zip(tables, places, strict=True):
            rows = self._rows(name, [r["b"] for r in buckets if r["of"] == place["buckets"]] if place["buckets"] else None, now)
            out.append(rows.filter(F.col(key).isin(few)) if len(few) <= MOST_LITERALS else rows)
        return out

    def _rows(self, table: str, wanted: list[int] | None, version: Version | None) -> DataFrame | None:
        now = version or self.current()
        if not now or table not in now.tables:
            return None
        place = now.tables[table]
        rows = self._read(place["base"], wanted, place["schema"])
        if not place["steps"]:
            return rows
        steps = None
        for i, step in enumerate(place["steps"]):
            part = self._read(step, wanted, f"{place['schema']}, gone_ boolean").withColumn("step_", F.lit(i))
            steps = part if steps is None else steps.unionByName(part)
        last = steps.groupBy(place["key"]).agg(F.max_by(F.struct(*steps.columns), "step_").alias("row")).select("row.*")
        kept = rows.join(stages.many(last.select(place["key"])), place["key"], "left_anti")
        return kept.unionByName(last.filter("not gone_").select(*rows.columns))

    # Cursor and retention

    def has_checkpoint(self) -> bool:
        now = self.current()
        return bool(now and now.cursor)

    def reset_checkpoint(self, *tables: str) -> int:
        """Forget the cursor and these cached tables, so that the next cycle compares everything; other tables stay."""
        return self._commit(self.current() or Version(), {}, None, tables).number

    def expire(self, keep: int = 10, grace_ms: int = 86_400_000) -> int:
        """Delete all but the last ``keep`` manifests, and data that none of these names and that is older than ``grace_ms``, as a writer may not have committed yet.

        Gives the number of folders of data that were deleted.
        """
        found = self.versions()
        for number in found[:-keep]:
            self._files.delete(self._path(self._manifest(number)), False)
        used = {part["path"].split("/data/")[-1].split("/")[0] for n in found[-keep:] for place in self.version(n).tables.values() for part in (place["base"], *place["steps"])}
        at = self._path(f"{self.folder}/data")
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        old = [s.getPath() for s in self._files.listStatus(at) if s.getPath().getName() not in used and now - s.getModificationTime() >= grace_ms] if self._files.exists(at) else []
        for path in old:
            self._files.delete(path, True)
        return len(old)


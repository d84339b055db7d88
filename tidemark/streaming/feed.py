"""Following a feed of changes by id: a cursor that is taken before the listing, commits of rows and cursor together, and a way back when the cursor expires.

The state is a table of nodes in a ``SnapshotStore``. Its cursor also has the number of the last batch that was applied, so a batch that Spark
runs again after a failure changes nothing. A batch writes the nodes that it changed, not all of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import errors
from tidemark.operators import delta, stages, tree
from tidemark.operators.snapshots import SnapshotStore

NODES = "id string, parent_ids array<string>, name string, is_folder boolean, payload string"
ERROR = "status int, summary string"


class RootGone(Exception):
    """The listing is empty and its root isn't there: that is no deletion of everything."""


@dataclass(frozen=True)
class Service:
    """What a feed needs of its service: the cursor of now, a whole listing (``NODES``), and whether the root is there."""

    cursor: Callable[[], str]
    listing: Callable[[], DataFrame]
    root_is_there: Callable[[], bool]
    root: str = "root"


class Follower:
    """Applies batches of a feed to the stored nodes."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, service: Service, reserved: tuple[str, ...] = ()):
        self.spark, self.store, self.service, self.reserved = spark, store, service, reserved

    def mark(self) -> dict:
        """The cursor and the last batch; nothing before the first scan."""
        now = self.store.current()
        return json.loads(now.cursor) if now and now.cursor else {"cursor": None, "batch": -1}

    def nodes(self) -> DataFrame:
        found = self.store.load("nodes")
        return self.spark.createDataFrame([], NODES) if found is None else found

    def changes(self) -> tuple[DataFrame, DataFrame]:
        """What the last batch changed: (path, kind) and the pairs of renames."""
        return self.store.load("changed"), self.store.load("renames")

    def full_scan(self, batch: int | None = None) -> None:
        """List everything and compare by id with what is known. The cursor is taken first, so what changes meanwhile is told again."""
        last = self.mark()
        cursor = self.service.cursor()
        listing = stages.cut(self.service.listing().select("id", "parent_ids", "name", "is_folder", "payload"))
        if listing.isEmpty() and not self.service.root_is_there():
            raise RootGone("the listing is empty and its root isn't there")
        before = self.nodes()
        paths = lambda rows: rows.join(stages.many(tree.resolve_paths(rows, self.service.root)), "id")
        compared = delta.compare_by_id(paths(before), paths(listing))
        self._commit(before, listing, compared.changed, compared.renames, {"cursor": cursor, "batch": last["batch"] if batch is None else batch}, whole=True)

    def apply(self, pages: DataFrame, batch: int, cursor: str | None = None) -> str:
        """Apply a batch of ``pages`` (page, seq, entry as JSON, error as ``ERROR`` struct or null) with its number, and say what was done.

        ``replayed``: the batch was applied before. ``scanned``: there was no cursor, or it has expired. ``applied``: its entries were. Any other
        error fails the batch, before anything is written.
        """
        last = self.mark()
        if batch <= last["batch"]:
            return "replayed"
        pages = stages.cut(pages)
        failed = pages.filter("error is not null")
        expired = errors.cursor_expired(F.col("error.status"), F.col("error.summary"))
        if last["cursor"] is None or not failed.filter(expired).isEmpty():
            self.full_scan(batch)
            return "scanned"
        if not failed.isEmpty():
            raise ValueError(f"a page of the feed has failed: {failed.select('page', 'error').first().asDict(True)}")
        schema = "id string, tombstone boolean, parent_ids array<string>, name string, is_folder boolean, payload string"
        entries = pages.select("page", "seq", F.from_json("entry", schema, {"mode": "FAILFAST"}).alias("e")).select("page", "seq", "e.*").withColumn("tombstone", F.coalesce("tombstone", F.lit(False)))
        # the root tells of itself in some feeds; it is no child
        entries = entries.filter(F.col("id") != self.service.root)
        before = stages.cut(self.nodes())
        done = delta.apply_delta(before, filled(entries, before), self.service.root, self.reserved)
        told = cursor if cursor is not None else pages.agg(F.max("page")).first()[0]
        self._commit(before, stages.cut(done.nodes).drop("path"), done.changed, done.renames, {"cursor": str(told if told is not None else last["cursor"]), "batch": batch})
        return "applied"

    def _commit(self, before: DataFrame, after: DataFrame, changed: DataFrame, renames: DataFrame, mark: dict, whole: bool = False) -> None:
        """Rows, what changed, and the cursor, in one version."""
        tables = {"changed": changed, "renames": renames}
        if whole:
            self.store.save(tables | {"nodes": after}, json.dumps(mark), keys={"nodes": "id"})
            return
        row = lambda rows, name: rows.select("id", F.struct("parent_ids", "name", "is_folder", "payload").alias(name))
        both = stages.cut(row(before, "a").join(stages.many(row(after, "b")), "id", "full").filter(~F.col("a").eqNullSafe(F.col("b"))))
        self.store.save(tables, json.dumps(mark), increments={"nodes": (both.filter("b is not null").select("id", "b.*"), both.filter("b is null").select("id"))})

    def follow(self, stream: DataFrame, checkpoint: str):
        """Start applying a stream of pages; Spark numbers its batches, and runs one again that it doesn't know to have ended."""
        return stream.writeStream.foreachBatch(lambda rows, number: self.apply(rows, number)).option("checkpointLocation", checkpoint)


def filled(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries that tell of a new name alone, or of new content alone, with what the nodes know of the rest."""
    known = nodes.select("id", *[F.col(c).alias(f"known_{c}") for c in ("parent_ids", "name", "is_folder", "payload")])
    joined = entries.join(stages.many(known), "id", "left")
    return joined.select("page", "seq", "id", "tombstone", *[F.coalesce(c, f"known_{c}").alias(c) for c in ("parent_ids", "name", "is_folder", "payload")])

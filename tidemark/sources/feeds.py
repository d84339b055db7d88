"""Sources: file listings that include hidden names, and pages of provider rows as batches and as a stream.

Both are Python data sources: the driver plans partitions, the executors read them. Folders must be ones that all executors see.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Fixed value: pages after which a listing counts as endless.
PAGE_CAP = 10_000


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class ListingReader(DataSourceReader):
    """A partition for each folder of the second level, and one for the files of each folder above."""

    def __init__(self, root: str):
        self.root = root

    def _store(self) -> tuple[fs.FileSystem, str]:
        """The store and the folder in it; without a scheme it is a folder that all executors see."""
        store, top = fs.FileSystem.from_uri(self.root) if re.match("[A-Za-z][A-Za-z0-9+.-]+:", self.root) else (fs.LocalFileSystem(), os.path.abspath(self.root))
        return store, top.rstrip("/")

    def partitions(self) -> list[Folder]:
        store, top = self._store()
        if store.get_file_info(top).type != fs.FileType.Directory:
            raise ValueError(f"no folder {self.root}")
        inside = lambda folder: sorted(e.base_name for e in store.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"))) if e.type == fs.FileType.Directory)
        tops = inside("")
        return [Folder("", False), *[Folder(t, False) for t in tops], *[Folder(f"{t}/{n}", True) for t in tops for n in inside(t)]]

    def read(self, partition: Folder) -> Iterator[tuple]:
        store, top = self._store()
        if partition.path:
            yield partition.path, True, 0, 0
        for e in store.get_file_info(fs.FileSelector(f"{top}/{partition.path}".rstrip("/"), recursive=partition.deep)):
            path = e.path.rstrip("/")[len(top) + 1 :]
            if e.type == fs.FileType.File:
                yield path, False, e.size, e.mtime_ns // 1_000_000
            elif partition.deep:
                yield path, True, 0, 0


class ListingSource(DataSource):
    """``spark.read.format("tidemark_listing").load(folder)``, of any store that Arrow reads: unlike the binary file source, it lists names that begin with "." or "_", and reads no content."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_listing"

    def schema(self) -> str:
        return "path string, is_directory boolean, size bigint, mtime bigint"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"])


class Page(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


def _pages(root: str, first: int = 0) -> list[Page]:
    names = sorted(n for n in os.listdir(root) if n.endswith(".json"))
    if len(names) > PAGE_CAP:
        raise ValueError(f"more than {PAGE_CAP} pages: the listing doesn't end")
    return [Page(i, os.path.join(root, n)) for i, n in enumerate(names)][first:]


def _rows(page: Page) -> Iterator[tuple]:
    with open(page.path, encoding="utf-8") as f:
        for seq, entry in enumerate(json.load(f)["entries"]):
            yield page.number, seq, json.dumps(entry, sort_keys=True)


class PageReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Page]:
        return _pages(self.root)

    def read(self, partition: Page) -> Iterator[tuple]:
        return _rows(partition)


class PageStream(DataSourceStreamReader):
    """The cursor is the number of pages that were read; Spark commits it after its batch has succeeded."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(_pages(self.root))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return _pages(self.root, start["pages"])[: end["pages"] - start["pages"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _rows(partition)


class PageSource(DataSource):
    """``load(folder)`` of page files ``{"entries": [...]}``, as (page, seq, entry) with each entry as JSON text; batch and stream."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_pages"

    def schema(self) -> str:
        return "page int, seq int, entry string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (ListingSource, PageSource):
        spark.dataSource.register(source)


def entries(pages: DataFrame, schema: str) -> DataFrame:
    """Parse the entries; one that isn't of the schema fails the batch."""
    from pyspark.sql import functions as F

    return pages.select("page", "seq", F.from_json("entry", schema, {"mode": "FAILFAST"}).alias("e")).select("page", "seq", "e.*")

"""Listing a tree that a service gives folder by folder, in pages.

A crawl goes in rounds. Each round reads the folders that the one before found, all at once, on the executors: a task follows a folder's
continuation tokens to their end and repeats calls that may yet succeed. What it finds is written, and the folders among it that weren't
read before are the next round's. So there are as many rounds as levels, a folder that is found twice is read once, and a cycle ends.

A call that fails for good fails the crawl, as does a folder with more pages than there can be: a listing that is short would read as deletions.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.errors import DELAY_CAP_MS
from tidemark.operators import stages
from tidemark.sources.feeds import PAGE_CAP

#: Fixed value: calls of a page at most.
MOST_ATTEMPTS = 3
FOUND = "folder string, page int, seq int, id string, is_folder boolean, entry string"


class CallFailed(Exception):
    """A call of the service that failed, with its kind of error and the wait that it asked for."""

    def __init__(self, kind: str, retry_after_ms: float | None = None):
        super().__init__(kind)
        self.kind, self.retry_after_ms = kind, retry_after_ms


#: Gives a page of a folder: its entries, each with ``id`` and ``is_folder``, and the token of the next page, None at the end.
Fetch = Callable[[str, str | None], tuple[list[dict], str | None]]


class StoredPages:
    """Pages as files ``<root>/<folder>/<token>.json`` of any store that Arrow reads: ``{"entries": [...], "next": token}``; the first token is "first"."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def __call__(self, folder: str, token: str | None) -> tuple[list[dict], str | None]:
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(self.root)
        try:
            with files.open_input_stream(f"{top}/{quote(folder, safe='')}/{token or 'first'}.json") as f:
                page = json.loads(f.read())
        except FileNotFoundError:
            raise CallFailed("notFound") from None
        return page["entries"], page.get("next")


def fetched(fetch: Fetch, folder: str, token: str | None, sleep: Callable[[float], None] = time.sleep) -> tuple[list[dict], str | None]:
    """One page, with the calls repeated that may yet succeed."""
    attempt = 1
    while True:
        try:
            return fetch(folder, token)
        except CallFailed as e:
            if e.kind not in ("transient", "rateLimit") or attempt >= MOST_ATTEMPTS:
                raise
            wait = e.retry_after_ms if e.retry_after_ms is not None else 2 ** (attempt - 1) * 1000 * (0.5 + random.random())
        sleep(min(wait, DELAY_CAP_MS) / 1000)
        attempt += 1


def pages_of(fetch: Fetch, folder: str, most_pages: int = PAGE_CAP) -> Iterator[list[dict]]:
    """All pages of a folder, by their tokens."""
    token = None
    for _ in range(most_pages):
        entries, token = fetched(fetch, folder, token)
        yield entries
        if not token:
            return
    raise ValueError(f"more than {most_pages} pages in {folder}: the listing doesn't end")


def crawl(spark: SparkSession, fetch: Fetch, root: str, most_pages: int = PAGE_CAP, width: int | None = None) -> DataFrame:
    """All entries below ``root``, as (folder, page, seq, id, is_folder, entry). ``width`` is the number of folders that are read at a time, the shuffle partitions by default."""
    width = width or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for page, entries in enumerate(pages_of(fetch, folder, most_pages)):
                    rows = [(folder, page, i, e["id"], bool(e.get("is_folder")), json.dumps(e, sort_keys=True)) for i, e in enumerate(entries)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string()))], names=["folder", "page", "seq", "id", "is_folder", "entry"])

    frontier = spark.createDataFrame([(root,)], "folder string")
    seen, found = frontier, None
    while True:
        round_ = stages.cut(frontier.repartition(width, "folder").mapInArrow(read, FOUND))
        found = round_ if found is None else found.unionByName(round_)
        frontier = stages.cut(round_.filter("is_folder").select(F.col("id").alias("folder")).distinct().join(seen, "folder", "left_anti"))
        if frontier.isEmpty():
            return found
        seen = seen.union(frontier)


def listed(found: DataFrame, schema: str) -> DataFrame:
    """The entries of a crawl as columns, each id once: where an id stands in several folders, ``parent_ids`` has them all."""
    one = found.groupBy("id").agg(F.first("is_folder").alias("is_folder"), F.sort_array(F.collect_set("folder")).alias("parent_ids"), F.max_by("entry", F.struct("folder", "page", "seq")).alias("entry"))
    return one.select("id", "is_folder", "parent_ids", F.from_json("entry", schema, {"mode": "FAILFAST"}).alias("e")).select("id", "is_folder", "parent_ids", "e.*")

"""Crawls in rounds and feeds with cursors: retries, caps, cycles, replays, expired cursors, and what must fail without a trace."""

from __future__ import annotations

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import delta, tree
from tidemark.operators.snapshots import SnapshotStore
from tidemark.sources import crawl, feeds
from tidemark.streaming import feed


def service():
    """Three levels, pages of two; folder "b" stands in two folders, and "loop" leads back to the root. Workers can't import tests, so it is a closure."""
    of = {"root": ["a", "b", "x1", "x2", "x3"], "a": ["b", "a1"], "b": ["loop"], "loop": ["root"]}

    def tree(folder, token):
        children, at = of[folder], int(token or 0)
        entries = [{"id": c, "name": c.upper(), "is_folder": c in of} for c in children[at : at + 2]]
        return entries, str(at + 2) if at + 2 < len(children) else None

    return tree


def test_rounds_find_all_and_read_a_folder_once(spark):
    found = crawl.crawl(spark, service(), "root", width=2)
    assert sorted((r["folder"], r["page"], r["seq"], r["id"]) for r in found.collect()) == [
        ("a", 0, 0, "b"), ("a", 0, 1, "a1"), ("b", 0, 0, "loop"), ("loop", 0, 0, "root"),
        ("root", 0, 0, "a"), ("root", 0, 1, "b"), ("root", 1, 0, "x1"), ("root", 1, 1, "x2"), ("root", 2, 0, "x3"),
    ]
    rows = {r["id"]: (r["parent_ids"], r["name"]) for r in crawl.listed(found, "name string").collect()}
    assert rows["b"] == (["a", "root"], "B") and len(rows) == 8


def test_calls_of_a_page_are_repeated_while_that_can_help():
    slept, left = [], ["transient", "rateLimit"]

    def fetch(folder, token):
        if left:
            raise crawl.CallFailed(left.pop(), 90_000 if left else None)
        return [], None

    assert crawl.fetched(fetch, "f", None, slept.append) == ([], None)
    assert slept[0] == 64 and 1 <= slept[1] <= 3
    for kinds, calls in ((["transient"] * 9, 3), (["auth"], 1), (["notFound"], 1)):
        made = []

        def failing(folder, token, kinds=kinds, made=made):
            made.append(folder)
            raise crawl.CallFailed(kinds[len(made) - 1])

        with pytest.raises(crawl.CallFailed):
            crawl.fetched(failing, "f", None, slept.append)
        assert len(made) == calls


def test_a_folder_that_never_ends_or_fails_fails_the_crawl(spark):
    with pytest.raises(ValueError, match="more than 7 pages"):
        list(crawl.pages_of(lambda folder, token: ([], "again"), "f", 7))
    with pytest.raises(PySparkException):
        crawl.crawl(spark, lambda folder, token: ([], "again"), "root", most_pages=5)

    tree = service()

    def forbidden(folder, token):
        if folder == "b":
            raise crawl.CallFailed("permission")
        return tree(folder, token)

    with pytest.raises(PySparkException):
        crawl.crawl(spark, forbidden, "root")


def nodes(spark, *rows):
    return spark.createDataFrame([(i, [p], i.upper() if n is None else n, f, v) for i, p, n, f, v in rows], feed.NODES)


PAGES = "page int, seq int, entry string, error struct<status:int,summary:string>"


def pages(spark, *entries, page=1):
    return spark.createDataFrame([(page, i, e if isinstance(e, str) else json.dumps(e), None) for i, e in enumerate(entries)], PAGES)


def follower(spark, tmp_path, listings, there=True):
    order, given = [], iter(listings)

    def listing():
        order.append("listing")
        return next(given)

    def cursor():
        order.append("cursor")
        return f"c{order.count('cursor')}"

    return feed.Follower(spark, SnapshotStore(spark, str(tmp_path / "feed")), feed.Service(cursor, listing, lambda: there)), order


def test_the_cursor_is_taken_before_the_listing(spark, tmp_path):
    own, order = follower(spark, tmp_path, [nodes(spark, ("f", "root", None, True, ""), ("a", "f", None, False, "1"))])
    own.full_scan()
    assert order == ["cursor", "listing"] and own.mark() == {"cursor": "c1", "batch": -1}
    changed, renames = own.changes()
    assert {tuple(r) for r in changed.collect()} == {("F", "modified"), ("F/A", "modified")} and renames.isEmpty()


def test_an_empty_listing_is_believed_only_if_the_root_is_there(spark, tmp_path):
    some = nodes(spark, ("a", "root", None, False, "1"))
    own, _ = follower(spark, tmp_path, [some, some.limit(0)], there=False)
    own.full_scan()
    with pytest.raises(feed.RootGone):
        own.full_scan()
    assert own.nodes().count() == 1 and own.mark()["cursor"] == "c1"
    other, _ = follower(spark, tmp_path / "other", [some, some.limit(0)])
    other.full_scan()
    other.full_scan()
    assert other.nodes().isEmpty() and [tuple(r) for r in other.changes()[0].collect()] == [("A", "deleted")]


def test_batches_replays_and_failures(spark, tmp_path):
    own, order = follower(spark, tmp_path, [nodes(spark, ("f", "root", None, True, ""), ("a", "f", None, False, "1"), ("b", "f", None, False, "1")), nodes(spark, ("a", "root", None, False, "1"), ("n", "root", None, False, "9"))])
    assert own.apply(pages(spark), 0) == "scanned"
    batch = pages(spark, {"id": "root", "name": "top", "is_folder": True}, {"id": "a", "name": "new"}, {"id": "b", "tombstone": True}, {"id": "c", "parent_ids": ["root"], "name": "C", "is_folder": False, "payload": "3"}, page=7)
    assert own.apply(batch, 1) == "applied" and own.mark() == {"cursor": "7", "batch": 1}
    now = {r["id"]: (r["parent_ids"], r["name"], r["payload"]) for r in own.nodes().collect()}
    assert now == {"f": (["root"], "F", ""), "a": (["f"], "new", "1"), "c": (["root"], "C", "3")}
    assert [tuple(r)[:2] for r in own.changes()[1].collect()] == [("F/A", "F/new")]
    version = own.store.versions()
    assert own.apply(batch, 1) == "replayed" and own.store.versions() == version
    bad = spark.createDataFrame([(8, 0, None, (503, "later"))], PAGES)
    with pytest.raises(ValueError, match="503"):
        own.apply(batch.unionByName(bad), 2)
    with pytest.raises((PySparkException, Py4JJavaError)):
        own.apply(pages(spark, "{no json", page=8), 2)
    assert own.store.versions() == version
    expired = spark.createDataFrame([(8, 0, None, (409, "reset/..."))], PAGES)
    assert own.apply(expired, 2) == "scanned" and own.mark() == {"cursor": "c2", "batch": 2}
    assert {r["id"] for r in own.nodes().collect()} == {"a", "n"}
    changed, renames = own.changes()
    assert {tuple(r) for r in changed.collect()} == {("A", "modified"), ("N", "modified"), ("C", "deleted"), ("F", "deleted"), ("F/new", "deleted")}
    assert [tuple(r)[:2] for r in renames.collect()] == [("F/new", "A")]


def test_a_stream_of_pages_with_an_expired_cursor_and_a_batch_run_again(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    page = lambda n, *entries: (folder / f"{n:03}.json").write_text(json.dumps({"entries": entries}))
    feeds.register(spark)
    own, order = follower(spark, tmp_path, [nodes(spark, ("a", "root", None, False, "1")), nodes(spark, ("z", "root", None, False, "1"))])
    own.full_scan()
    entry = F.col("entry")
    error = F.from_json(F.get_json_object("entry", "$.error"), feed.ERROR)

    def drain():
        rows = spark.readStream.format("tidemark_pages").load(str(folder)).select("page", "seq", F.when(error.isNull(), entry).alias("entry"), error.alias("error"))
        query = own.follow(rows, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    page(0, {"id": "b", "parent_ids": ["root"], "name": "B", "is_folder": False, "payload": "2"})
    drain()
    assert {r["id"] for r in own.nodes().collect()} == {"a", "b"} and own.mark()["batch"] == 0
    versions = own.store.versions()
    # the stream dies after its batch is applied and before it knows: it runs the batch again
    (tmp_path / "checkpoint" / "commits" / "0").unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(".*.crc"):
        crc.unlink()
    drain()
    assert own.store.versions() == versions
    page(1, {"error": {"status": 410, "summary": ""}})
    drain()
    assert {r["id"] for r in own.nodes().collect()} == {"z"} and order == ["cursor", "listing"] * 2


def test_a_batch_sends_no_nodes_through_the_driver(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("d:"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") == 0, F.array(F.lit("root"))).otherwise(F.array(F.lit("d:0"))).alias("parent_ids"), F.col("id").cast("string").alias("name"), (F.col("id") == 0).alias("is_folder"), F.lit("x").alias("payload"))
    entries = rows.filter("id <> 'd:0'").select(F.lit(1).alias("page"), F.lit(1).alias("seq"), "id", F.lit(False).alias("tombstone"), "parent_ids", F.concat("name", F.lit("n")).alias("name"), "is_folder", "payload")
    done = delta.apply_delta(rows, feed.filled(entries, rows))
    for told in (done.nodes, done.changed, done.renames, tree.relevant_parent(rows, "root")):
        assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()
    assert done.renames.count() == 399

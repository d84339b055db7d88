"""Goldens, sentinels, streams, sources and the fixed point of a cycle."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import batches, fingerprint
from tidemark.operators import exclude, merge, predicates, state
from tidemark.operators.schema import BASELINE, ENTITY
from tidemark.operators.snapshots import CommitConflict, SnapshotStore
from tidemark.plans import cycle, fixtures
from tidemark.sources import feeds
from tidemark.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("data", "digest"),
    [
        (b"hello sha1 casing probe", "qSVkG9ns4uDKMJlgnwEIxhCGOaQ="),
        (b"\0", "AAAAAAAAAAAAAAAAAQAAAAAAAAA="),
        (bytes(i & 255 for i in range(200)), "4wTRmVq14WTAStOsg6tbwZMFVT0="),
        (bytes(i & 255 for i in range(4096)), "QkGEfSisZcA7k+FCh6xr2dbCayY="),
        (bytes((31 * i + 7) & 255 for i in range(1000)), "X4X7cC7/cVgPZMrjju+fOUsa7aY="),
    ],
)
def test_quickxor(data, digest):
    assert fingerprint.quickxor_bytes(data) == digest


def test_block_hash(spark):
    four = 4 << 20
    rows = spark.createDataFrame([(b"abc",), (b"a" * four,), (b"a" * four + b"b" * 100,)], "c binary").select(fingerprint.block_hash(F.col("c")))
    assert [r[0] for r in rows.collect()] == [
        "4f8b42c22dd3729b519ba6f68d2da7cc5b2d606d05daed5ad5128cc03e6c6358",
        "907a506cf5e706bda5c7a29b43c9c65d8344bd2fa2f22339b359c214812af5a1",
        "02155e86ebc2babf5adb548bc0eff2e56e21d395499e5977cd8e7a27738d4cc9",
    ]


@pytest.mark.parametrize(
    ("patterns", "ignored", "kept"),
    [
        (["secret/**", "!secret/public/", "!secret/public/**"], ["secret/key.pem"], ["secret/public/readme.md", "other"]),
        (["build/"], ["build/file.txt", "a/build/x"], ["build"]),
        (["*", "!*/", "!**/*.md"], ["a.txt", "d/b.txt"], ["a.md", "d/e/b.md"]),
        (["# note", "*.log", "!keep.log"], ["x.log", "d/x.log"], ["keep.log", "note"]),
    ],
)
def test_ignore_patterns(spark, patterns, ignored, kept):
    rows = spark.createDataFrame([(p,) for p in [*ignored, *kept]], "path string")
    got = [r[0] for r in rows.filter(exclude.ignored(F.col("path"), patterns)).collect()]
    assert got == ignored


def test_merges():
    clean = merge.three_way("a\nb\nc", "x\nb\nc", "a\nb\nz")
    assert (clean.success, clean.content) == (True, "x\nb\nz")
    both = merge.three_way("head\nold\nfoot", "head\nmine\nfoot", "head\ntheirs\nfoot")
    assert not both.success and both.content.startswith("head\nmine\n") and "> theirs" in both.content and both.content.endswith("foot")
    again = merge.three_way("a\nb", "n\na\nb", "n\na\nz")
    assert again.content.count("n") == 1
    long = ["\n".join(f"{side}{i}" for i in range(20_000)) for side in "abc"]
    assert not merge.three_way(*long).success
    rng = random.Random(3)
    for _ in range(300):
        base, other = (rng.choices("abcdefgh", k=rng.randrange(12)) for _ in range(2))
        found, at = [], 0
        for h in merge.hunks(base, other):
            found += [*base[at : h.start], *h.lines]
            at = h.start + h.length
        assert found + base[at:] == other
    assert "\r\n" in merge.three_way("a\r\nb\r\nc", "x\r\nb\r\nc", "a\r\nb\r\nz").content


def test_a_row_without_its_required_fields_fails_the_read(spark):
    from pyspark.errors import PySparkException

    from tidemark.functions import providers

    rows = spark.createDataFrame([("1", "a", "x"), ("2", None, "y")], "id string, name string, other string")
    assert providers.required(rows.filter("id = '1'"), "id", "name").count() == 1 and set(providers.required(rows, "id").columns) == {"id", "name", "other"}
    with pytest.raises(PySparkException):
        providers.required(rows, "id", "name").collect()


def test_merges_of_long_texts_need_memory_in_proportion():
    import tracemalloc

    rng = random.Random(5)
    lines = [f"line {i}" for i in range(100_000)]
    mixed = rng.sample(lines, len(lines))
    repeated = [f"r{rng.randrange(50)}" for _ in range(20_000)]
    tracemalloc.start()
    for base, other in ((lines, mixed), (repeated, rng.sample(repeated, len(repeated))), (lines, [x for i, x in enumerate(lines) if i % 3])):
        found, at = [], 0
        for h in merge.hunks(base, other):
            found += [*base[at : h.start], *h.lines]
            at = h.start + h.length
        assert found + base[at:] == other
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    one, two = merge.matches(lines, mixed), merge.matches(mixed, mixed)
    assert len(one) >= 600 and len(two) == len(mixed)
    # two whole rewrites of one list, and far edits of both sides
    assert not merge.three_way(*("\n".join(x) for x in (lines[:20_000], rng.sample(lines[:20_000], 20_000), rng.sample(lines[:20_000], 20_000)))).success
    mine, theirs = list(lines), list(lines)
    mine[10::1000], theirs[500::1000] = ["mine"] * 100, ["theirs"] * 100
    both = list(mine)
    both[500::1000] = ["theirs"] * 100
    merged = merge.three_way(*("\n".join(x) for x in (lines, mine, theirs)))
    assert merged.success and merged.content == "\n".join(both)


def test_small_edits_are_the_shortest(monkeypatch):
    rng = random.Random(9)

    def longest(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    texts = [rng.choices("abcdef", k=rng.randrange(14)) for _ in range(120)]
    for a, b in zip(texts, texts[1:], strict=False):
        assert len(merge.matches(a, b)) == longest(a, b)
    monkeypatch.setattr(merge, "MOST_EDITS", 2)
    for a, b in zip(texts, texts[1:], strict=False):
        pairs = merge.matches(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


SIDE = "struct<is_directory:boolean,size:bigint,mtime:bigint,hash:string,remote_checksum:struct<algo:string,value:string>>"
PREV = "struct<hash:string,local_mtime:bigint,remote_mtime:bigint,local_size:bigint,remote_size:bigint,remote_checksum:struct<algo:string,value:string>>"


@pytest.mark.parametrize(
    ("local", "prev", "changed"),
    [
        ((True, 0, 0, "", None), ("", 0, 0, 0, 0, None), False),
        ((False, 5, 10, "a", None), ("a", 99, 0, 7, 0, None), False),
        ((False, 5, 10, "a", None), ("b", 10, 0, 5, 0, None), True),
        ((False, 5, 10, "", None), ("b", 10, 0, 5, 0, None), False),
        ((False, 6, 10, "", None), ("b", 10, 0, 5, 0, None), True),
        ((False, 5, 0, "", None), ("b", 10, 0, 5, 0, None), True),
    ],
)
def test_local_changed(spark, local, prev, changed):
    row = spark.createDataFrame([(local, prev)], f"l {SIDE}, p {PREV}").select(predicates.local_changed(F.col("l"), F.col("p"))).first()
    assert row[0] is changed


@pytest.mark.parametrize(
    ("remote", "prev", "changed"),
    [
        ((False, 5, 10, "", None), ("", 0, 10, 0, 5, None), False),
        ((False, 5, 11, "", ("md5", "x")), ("", 0, 10, 0, 5, ("md5", "x")), False),
        ((False, 5, 11, "", ("md5", "x")), ("", 0, 10, 0, 5, ("sha1", "x")), True),
        ((False, 5, 0, "", ("md5", "y")), ("", 0, 10, 0, 5, ("md5", "x")), True),
        ((False, 5, 0, "", None), ("", 0, 10, 0, 5, None), True),
    ],
)
def test_remote_changed(spark, remote, prev, changed):
    row = spark.createDataFrame([(remote, prev)], f"r {SIDE}, p {PREV}").select(predicates.remote_changed(F.col("r"), F.col("p"))).first()
    assert row[0] is changed


def test_a_second_cycle_plans_nothing_but_conflicts(spark):
    sides = fixtures.listings(spark, SF)
    first = cycle.cold_cycle(*sides, settings=cycle.Settings(deletion_limit=None), synced_at=5)
    local, remote, baseline = (x.checkpoint() for x in (first.local, first.remote, first.baseline))
    second = cycle.cold_cycle(local, remote, baseline, settings=cycle.Settings(deletion_limit=None), synced_at=6)
    conflicts = {r["path"] for r in first.plan.filter("action = 'conflict'").collect()}
    left = second.plan.select("path", "action").collect()
    # a file with neither a time nor a hash can't be shown unchanged, so it is pushed again
    unknown = {r["path"] for r in local.filter("mtime = 0 and hash = ''").collect()}
    assert {r["path"] for r in left} <= conflicts | unknown


def test_snapshots_keep_the_cursor_with_the_rows(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    assert store.current() is None and store.load("baseline") is None
    store.save({"baseline": spark.createDataFrame([], BASELINE)}, "c1")
    store.save({"listing": spark.createDataFrame([], ENTITY)}, "c2")
    assert store.current().cursor == "c2" and store.load("baseline").columns and store.load("listing").columns


def test_listing_source_sees_hidden_names(spark, tmp_path):
    for name in ("a.md", ".hidden/b.md", "_c/d.md", "e/.f"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("xy")
    feeds.register(spark)
    rows = spark.read.format("tidemark_listing").load(str(tmp_path)).filter("not is_directory").collect()
    assert {(r["path"], r["size"]) for r in rows} == {(n, 2) for n in ("a.md", ".hidden/b.md", "_c/d.md", "e/.f")}


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_listing_of_any_store(spark, tmp_path, scheme):
    from urllib.parse import quote

    top = tmp_path / "top dir"
    files = ("a.md", ".b", "b+c/top dir/d e.md", "b+c/.git/config", "_x/y/z/.w")
    for name in files:
        (top / name).parent.mkdir(exist_ok=True, parents=True)
        (top / name).write_text("xyz")
    (top / "none" / "here").mkdir(parents=True)
    feeds.register(spark)
    rows = spark.read.format("tidemark_listing").load(f"file://{quote(str(top))}" if scheme else str(top)).collect()
    assert {(r["path"], r["size"]) for r in rows if not r["is_directory"]} == {(name, 3) for name in files} and all(r["mtime"] > 0 for r in rows if not r["is_directory"])
    assert sorted(r["path"] for r in rows if r["is_directory"]) == ["_x", "_x/y", "_x/y/z", "b+c", "b+c/.git", "b+c/top dir", "none", "none/here"]
    with pytest.raises(Exception, match="no folder"):
        spark.read.format("tidemark_listing").load(str(tmp_path / "absent")).collect()


def test_page_source_in_batch_and_stream(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    for i in range(3):
        (pages / f"{i:03}.json").write_text(json.dumps({"entries": [{"id": f"{i}{j}", "size": j} for j in range(2)]}))
    feeds.register(spark)
    batch = feeds.entries(spark.read.format("tidemark_pages").load(str(pages)), "id string, size int")
    assert [tuple(r) for r in batch.orderBy("page", "seq").collect()] == [(i, j, f"{i}{j}", j) for i in range(3) for j in range(2)]
    stream = spark.readStream.format("tidemark_pages").load(str(pages))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_rename_chains_in_a_stream(spark, tmp_path):
    rows = [("s", 1, "a", "b"), ("s", 2, "b", "c"), ("s", 3, "x", "y"), ("s", 4, "y", "x"), ("t", 1, "p", "q")]
    spark.createDataFrame(rows, "stream_key string, seq int, old_path string, new_path string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_key string, seq int, old_path string, new_path string").parquet(str(tmp_path / "in"))
    query = events.rename_chains(stream).writeStream.outputMode("update").format("memory").queryName("chains").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {(r["stream_key"], r["new_path"]): r["old_path"] for r in spark.table("chains").collect()}
    assert {k: v for k, v in last.items() if v} == {("s", "c"): "a", ("t", "q"): "p"}


def test_paths_of_any_depth(spark):
    from tidemark.operators import tree

    deep = [(f"d{i}", [f"d{i - 1}" if i else "root"], f"n{i}") for i in range(1000)]
    cycle = [(f"c{i}", [f"c{(i + 1) % 5}"], f"m{i}") for i in range(5)]
    below = [(f"b{i}", [f"b{i - 1}" if i else "c2"], f"k{i}") for i in range(70)]
    nodes = spark.createDataFrame(deep + cycle + below, "id string, parent_ids array<string>, name string")
    wanted = {f"d{i}": "/".join(f"n{j}" for j in range(i + 1)) for i in range(1000)} | {f"c{i}": f"m{i}" for i in range(5)}
    wanted |= {f"b{i}": "/".join(["m2", *(f"k{j}" for j in range(i + 1))]) for i in range(70)}
    assert dict(map(tuple, tree.resolve_paths(nodes).collect())) == wanted


def test_nodes_below_others_at_any_depth(spark):
    from tidemark.operators import tree

    chain = [(f"d{i}", [f"d{i - 1}" if i else "root"]) for i in range(90)]
    loop = [(f"c{i}", [f"c{(i + 1) % 30}"]) for i in range(30)] + [("t", ["c4"])]
    nodes = spark.createDataFrame(chain + loop, "id string, parent_ids array<string>")
    tops = spark.createDataFrame([("d40",), ("c3",)], "id string")
    assert {r[0] for r in tree.reaching(nodes, tops).collect()} == {f"d{i}" for i in range(40, 90)} | {f"c{i}" for i in range(30)} | {"t"}


def test_checkpoints_and_increments(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    rows = lambda *r: spark.createDataFrame(r, "path string, v int")
    none = spark.createDataFrame([], "path string, v int")
    assert not store.has_checkpoint()
    store.save({"cache": rows(("a", 1), ("b", 1), ("c", 1)), "baseline": rows(("a", 0))}, "c1")
    store.commit_increment("cache", rows(("b", 2), ("d", 2)), rows(("a", 0), ("b", 0)), "c2")
    store.commit_increment("cache", rows(("a", 3)), rows(("d", 0)), "c3")
    assert sorted(map(tuple, store.load("cache").collect())) == [("a", 3), ("b", 2), ("c", 1)] and store.current().cursor == "c3"
    store.commit_increment("cache", none, rows(("c", 0)), "c4", most_steps=3)
    assert not store.current().tables["cache"]["steps"] and store.load("cache").count() == 2
    store.reset_checkpoint("cache")
    assert not store.has_checkpoint() and store.load("cache") is None and store.load("baseline").count() == 1


def test_a_history_that_cannot_be_read_is_empty(spark, tmp_path):
    from tidemark.operators import guards

    assert guards.load_history(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad.json").write_text("not json")
    assert guards.load_history(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "good.json").write_text('{"seq": 1, "path": "a", "action": "merged"}')
    assert guards.load_history(spark, str(tmp_path / "good.json")).first()["path"] == "a"


def test_strict_limit_and_missing_content(spark):
    from pyspark.errors import PySparkException

    from tidemark.operators import guards, state

    plan = spark.createDataFrame([(f"p{i}", "delete_local") for i in range(4)], "path string, action string")
    with pytest.raises(ValueError):
        guards.quarantine(plan, 3, strict=True)
    assert guards.quarantine(plan, 4, strict=True).safe.count() == 4
    listing = spark.createDataFrame([("a", False), ("d", True)], "path string, is_directory boolean")
    content = spark.createDataFrame([("a", "x"), ("d", "y")], "path string, content string")
    for wanted in ("d", "none"):
        with pytest.raises(PySparkException):
            state.read_content(spark.createDataFrame([(wanted,)], "path string"), listing, content).collect()


def test_requests_for_cycles(spark):
    rows = [("a", 0, "signal"), ("a", 1, "signal"), ("a", 2, "change"), ("a", 3, "change"), ("a", 25, "signal"), ("b", 5, "change"), ("b", 14, "change")]
    found = spark.createDataFrame(rows, "stream_key string, s long, kind string").select("stream_key", F.timestamp_seconds("s").alias("ts"), "kind")
    got = sorted((r[0], r[1] // 1_000_000, r[2]) for r in events.cycles(found, 10).collect())
    assert got == [("a", 0, 0), ("a", 10, 2), ("a", 25, 0), ("b", 5, 1), ("b", 15, 1)]


def test_a_stored_codec_of_another_format_is_an_error(spark):
    from pyspark.errors import PythonException

    from tidemark.operators import state

    rows = spark.createDataFrame([(b"\x07abc",)], "c binary")
    with pytest.raises(PythonException):
        rows.select(state.codec_decode(F.col("c"))).collect()


def _rows(spark, *r):
    return spark.createDataFrame(r, "path string, v int")


def test_two_writers_of_one_version_both_stay(spark, tmp_path):
    first, second = (SnapshotStore(spark, str(tmp_path / "state")) for _ in range(2))
    first.save({"cache": _rows(spark, ("a", 1), ("b", 1)), "other": _rows(spark, ("x", 1))}, "c1", keys={"cache": "path"}, buckets=4)
    seen = second.current()
    none = _rows(spark, ("a", 1)).limit(0)
    first.commit_increment("cache", _rows(spark, ("a", 2)), none, "c2")
    # made from the version before: it is put on top of the first one's
    second.commit_increment("cache", _rows(spark, ("c", 3)), _rows(spark, ("b", 0)), based_on=seen)
    assert sorted(map(tuple, first.load("cache").collect())) == [("a", 2), ("c", 3)] and first.current().cursor == "c2" and first.current().number == 3
    second.save({"other": _rows(spark, ("y", 2))}, based_on=seen)
    for change in (
        lambda: second.commit_increment("cache", _rows(spark, ("a", 9)), none, based_on=seen),  # the same key
        lambda: second.commit_increment("cache", _rows(spark, ("z", 9)), none, "c9", based_on=seen),  # the cursor has moved
        lambda: second.save({"cache": none}, based_on=seen),  # a whole table over the other's increment
        lambda: second.save({"other": none}, based_on=seen),
    ):
        with pytest.raises(CommitConflict):
            change()
    assert first.versions() == [1, 2, 3, 4] and sorted(map(tuple, first.load("cache").collect())) == [("a", 2), ("c", 3)]


def test_one_of_many_writers_takes_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tidemark.operators.snapshots import Version

    stores = [SnapshotStore(spark, str(tmp_path / "my state")) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        taken = list(pool.map(lambda i: stores[i]._take(Version(1, str(i))), range(8)))
    assert taken.count(True) == 1 and stores[0].current().cursor == str(taken.index(True)) and stores[0].versions() == [1]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: stores[i].save({f"t{i}": _rows(spark, ("a", i))}), range(4)))
    assert {*stores[0].current().tables} == {"t0", "t1", "t2", "t3"} and stores[0].versions() == [1, 2, 3, 4, 5]


def test_old_versions_and_their_data_are_deleted(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    for i in range(4):
        store.save({"t": _rows(spark, ("a", i))}, f"c{i}")
    early = store.current()
    assert store.expire(2) == 0 and store.versions() == [3, 4]  # data of yesterday at the earliest
    assert store.expire(2, 0) == 2 and store.load("t", early).first()["v"] == 3
    assert store.expire(1, 0) == 1 and store.load("t").first()["v"] == 3


def _bytes_read(spark, rows) -> int:
    """Bytes of the files that the scans of a DataFrame open."""
    files = set(rows.inputFiles())
    import os
    from urllib.parse import unquote

    return sum(os.path.getsize(unquote(f.removeprefix("file://"))) for f in files)


def test_a_reader_of_few_keys_opens_their_buckets_alone(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    rows = spark.range(20_000).select(F.concat(F.lit("f/"), F.col("id").cast("string")).alias("path"), F.col("id").cast("int").alias("v"))
    store.save({"t": rows, "u": rows}, keys={"t": "path", "u": "path"}, buckets=32)
    store.commit_increment("t", rows.filter("v % 100 = 0").withColumn("v", F.lit(-1)), rows.filter("v % 100 = 1").select("path"))
    whole = _bytes_read(spark, store.load("u"))
    sizes = []
    for n in (1, 4, 16):
        keys = rows.filter(F.col("v") < n).select("path")
        t, u = store.narrow(("t", "u"), keys)
        sizes.append(_bytes_read(spark, u))
        assert sorted(r["v"] for r in u.join(keys, "path", "left_semi").collect()) == list(range(n))
        assert sorted(r["v"] for r in t.join(keys, "path", "left_semi").collect()) == sorted({-1, *range(2, n)})
    assert sizes[0] <= whole / 16 and sizes[0] < sizes[1] < sizes[2] < whole


def test_hot_mode_reads_few_bytes_of_stored_listings(spark):
    from tidemark.operators import detect

    store = fixtures.stored_listings(spark, "/root/testdata/sf0.01")
    keys = fixtures._documents(spark, "/root/testdata/sf0.01").filter("doc_id = 21 or doc_id = 43").select("path")
    hot = detect.hot_stored(store, keys, keys.limit(0))
    assert sorted((r["path"].split("/")[-1], r["action"]) for r in detect.plan(hot).collect()) == [("doc-21.md", "push"), ("doc-43.md", "conflict")]
    stored = sum(_bytes_read(spark, store.load(t)) for t in ("local", "remote", "baseline"))
    assert _bytes_read(spark, hot) < stored / 4


@pytest.mark.parametrize("blocks", [1, 7, 40])
def test_sums_of_blocks_are_those_of_windows(spark, monkeypatch, blocks):
    from tidemark.operators import guards

    rng = random.Random(4)
    rows = [(i, None if i % 90 == 0 else "hot" if i % 3 else f"k{i % 5}", rng.choice([0, 1, 3599, 3600, 3601, rng.randrange(20_000)]), rng.randrange(4)) for i in range(1500)]
    events = spark.createDataFrame(rows, "id long, key string, s long, n int").select("id", "key", F.timestamp_seconds("s").alias("ts"), "n")
    window = {r["id"]: (r["total"], r["tripped"]) for r in guards.deletion_velocity(events, 300).collect()}
    by_blocks = guards.block_totals(events, blocks)
    assert {r["id"]: r["total"] for r in by_blocks.collect()} == {k: v[0] for k, v in window.items()}
    monkeypatch.setattr(guards, "MOST_KEY_ROWS", 400)
    assert {r["id"]: (r["total"], r["tripped"]) for r in guards.deletion_velocity(events, 300).collect()} == window


@pytest.mark.parametrize("call", [lambda d: d.select(state.codec_encode(F.col("text"))), lambda d: d.select(state.codec_decode(F.col("text"))), lambda d: d.select(fingerprint.quickxor(F.col("text"))), lambda d: merge.merge_texts(d.select(*[F.col("text").cast("string").alias(c) for c in ("path", "base", "local", "remote")]))])
def test_texts_go_to_python_in_batches_of_bounded_bytes(spark, call):
    import pyarrow as pa

    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        rows = spark.range(2000).select(F.repeat(F.lit("x"), F.when(F.col("id") < 1000, 50_000).otherwise(1)).cast("binary").alias("text"))
        call(rows)
        sizes = rows.coalesce(1).mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in it), "rows long, bytes long").agg(F.max("rows"), F.max("bytes"), F.sum("rows")).first()
        assert sizes[0] <= batches.ROWS and sizes[1] <= 2 * batches.BYTES and sizes[2] == 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

"""Queries of the reconciliation engine. Each takes (spark, sf_dir); ``tidemark.oracles`` has their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import cycle_queries, state_queries
from tidemark.functions import errors, fingerprint, paths, providers
from tidemark.operators import apply, conflict, delta, detect, exclude, guards, merge, rename, state, tree
from tidemark.operators import predicates as p
from tidemark.oracles import SQL
from tidemark.plans import fixtures
from tidemark.streaming import events as ev

IGNORE = ["*.tmp", "src4/**", "!src4/en/", "src5/fr/", "/src6/de/doc-*6.md"]


def _keep():
    return ~exclude.excluded(F.col("path"))


def _cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.cold(*fixtures.listings(spark, sf_dir), _keep())


def plan_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.plan(_cold(spark, sf_dir)).select("path", "action", F.col("local.size").alias("local_size"), F.col("remote.size").alias("remote_size"))


def _told(spark: SparkSession, sf_dir: str, *residues: int) -> DataFrame:
    return fixtures._documents(spark, sf_dir).filter(F.col("k").isin(*residues)).select("path")


def plan_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remote feed reports the residues that changed there."""
    none = spark.createDataFrame([], "old_path string, new_path string")
    return detect.plan(detect.warm(*fixtures.listings(spark, sf_dir), _told(spark, sf_dir, 2, 3, 4, 5, 7, 8, 10, 11, 12, 16), none, _keep())).select("path", "action")


def plan_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty are the residues that changed locally, and a few clean ones; the listings are those that the last cycle stored."""
    return detect.plan(detect.hot_stored(fixtures.stored_listings(spark, sf_dir), _told(spark, sf_dir, 0, 1, 3, 5, 6, 9, 14), _told(spark, sf_dir, 2, 4, 13), _keep())).select("path", "action")


def plan_hot_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few keys in a thousand are dirty, so only their buckets of the stored listings are read."""
    d = fixtures._documents(spark, sf_dir).withColumn("m", F.col("doc_id") % 1000)
    return detect.plan(detect.hot_stored(fixtures.stored_listings(spark, sf_dir), d.filter("m in (21, 43, 63, 109)").select("path"), d.filter("m in (104, 382, 905)").select("path"), _keep())).select("path", "action")


def local_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _cold(spark, sf_dir).filter("local is not null and prev is not null")
    return both.select("path", p.local_changed(F.col("local"), F.col("prev")).alias("changed"))


def remote_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _cold(spark, sf_dir).filter("remote is not null and prev is not null")
    return both.select("path", p.remote_changed(F.col("remote"), F.col("prev")).alias("changed"))


def same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _cold(spark, sf_dir).filter("local is not null and remote is not null")
    return both.select("path", p.same_content(F.col("local"), F.col("remote")).alias("same"))


def exclusion_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures._documents(spark, sf_dir)
    return d.select("path", paths.is_junk(F.col("path")).alias("junk"), paths.hidden_out_of_scope(F.col("path"), [".other"]).alias("hidden"), paths.hidden_out_of_scope(F.col("path"), [".cfg"]).alias("hidden_in_scope"), exclude.ignored(F.col("path"), IGNORE).alias("ignored"))


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.regexp_replace(F.regexp_replace("url", "^[a-z]+:/", ""), "[?#].*$", "")
    path = paths.normalize(F.concat(raw, F.lit("//part\\x.Md/")))
    rows = fixtures.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    c = F.col("path")
    return rows.select("page_id", "path", paths.extension(c).alias("extension"), paths.parent(c).alias("parent"), paths.depth(c).cast("bigint").alias("depth"), F.array_join(paths.ancestors(c), "|").alias("above"), paths.conflict_name(c, F.lit(2)).alias("second"), paths.rebase(c, F.lit(""), F.lit("top/")).alias("rebased"), paths.slug(c).alias("slug"))


def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("text").cast("binary")
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", F.md5(content).alias("md5"), F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256"), fingerprint.block_hash(content).alias("block"))


def quickxor_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", fingerprint.quickxor(F.col("text").cast("binary")).alias("digest"))


def initial_match_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = detect.enrich_initial_match(_cold(spark, sf_dir), fixtures.contents(spark, sf_dir))
    return detect.plan(mixed).select("path", "action", F.col("local.hash").alias("hash"))


def confirm_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An authoritative listing still has every other file that the local one lacks."""
    local, remote, baseline = fixtures.listings(spark, sf_dir)
    all_local = baseline.filter(F.col("local_mtime") % 2000 == 0).select("path", F.lit(False).alias("is_directory"), F.col("local_size").alias("size"), F.col("local_mtime").alias("mtime"), "hash", F.lit(None).cast("struct<algo:string,value:string>").alias("remote_checksum"), F.lit(None).cast("map<string,string>").alias("backend_meta"))
    mixed = detect.confirm_deletions(detect.cold(local, remote, baseline, _keep()), all_local, "local")
    return detect.plan(mixed).select("path", "action")


def _moved_plan(local: DataFrame, remote: DataFrame, baseline: DataFrame) -> DataFrame:
    return detect.plan(detect.cold(local, remote, baseline))


def _result(r: rename.Rewrite) -> DataFrame:
    actions = r.plan.select("path", "action", "old_path", F.coalesce("is_folder", F.lit(False)).alias("is_folder"), F.coalesce("needs_pull", F.lit(False)).alias("needs_pull"), F.coalesce("descendants", F.lit(0).cast("bigint")).alias("n"), F.lit(None).cast("string").alias("reason"))
    skipped = r.outcome.filter("reason is not null").select(F.col("new_path").alias("path"), F.lit("skipped").alias("action"), "old_path", "is_folder", F.lit(False).alias("needs_pull"), F.lit(0).cast("bigint").alias("n"), "reason")
    return actions.unionByName(skipped)


def rename_local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    *sides, pairs = fixtures.local_moves(spark, sf_dir)
    return _result(rename.local_files(_moved_plan(*sides), pairs))


def rename_remote_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    *sides, pairs = fixtures.remote_moves(spark, sf_dir)
    return _result(rename.remote_files(_moved_plan(*sides), pairs))


def rename_local_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    *sides, files, folders = fixtures.local_folder_moves(spark, sf_dir)
    return _result(rename.local_folders(_moved_plan(*sides), folders, files))


def rename_remote_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    *sides, pairs = fixtures.remote_folder_moves(spark, sf_dir)
    return _result(rename.remote_folders(_moved_plan(*sides), pairs))


def snapshot_diff_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings by id: residues modulo 7 are 0 gone, 1 moved, 2 edited in place, 3 new."""
    d = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 7).alias("r"), F.concat_ws("/", "source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("path"), F.md5("text").alias("payload"), F.lit(False).alias("is_folder"))
    before = d.filter("r <> 3")
    after = d.filter("r <> 0").withColumn("path", F.when(F.col("r") == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))).withColumn("payload", F.when(F.col("r") == 2, "new").otherwise(F.col("payload")))
    found = delta.compare_by_id(before, after)
    none = F.lit(None).cast("string")
    return found.changed.select("path", "kind", none.alias("old_path")).unionByName(found.renames.select(F.col("new_path").alias("path"), F.lit("renamed").alias("kind"), "old_path"))


def resolve_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.resolve_paths(fixtures.nodes(spark, sf_dir, with_odd=True))


def apply_id_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delta.apply_delta(fixtures.nodes(spark, sf_dir), fixtures.id_delta(spark, sf_dir))
    none = F.lit(None).cast("string")
    return found.changed.select("path", "kind", none.alias("old_path")).unionByName(found.renames.select(F.col("new_path").alias("path"), F.lit("renamed").alias("kind"), "old_path"))


def _doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))


def subtree_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = spark.createDataFrame([("src1", "old/one"), ("src1/en", "english"), ("src2", "src2b"), ("src20", "never")], "old_path string, new_path string")
    return tree.rewrite_subtrees(_doc_paths(spark, sf_dir), moves)


def subtree_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.remove_subtrees(_doc_paths(spark, sf_dir), spark.createDataFrame([("src1",), ("src3/en",), ("src",)], "path string"))


def prune_empty_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of src1, the English of src3 and one document of src4 were deleted; src5/xx is empty but was not touched."""
    docs = _doc_paths(spark, sf_dir)
    gone = F.startswith("path", F.lit("src1/")) | F.startswith("path", F.lit("src3/en/")) | (F.col("doc_id") == 4)
    folders = docs.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().union(spark.createDataFrame([("src5/xx",)], "path string")).withColumn("is_directory", F.lit(True))
    listing = docs.filter(~gone).select("path", F.lit(False).alias("is_directory")).unionByName(folders)
    return tree.prunable_folders(listing, docs.filter(gone).select("path"))


def missing_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _doc_paths(spark, sf_dir)
    listing = docs.filter("doc_id % 3 = 0").select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().withColumn("is_directory", F.lit(True))
    return tree.missing_folders(docs.select("path"), listing).withColumn("depth", F.col("depth").cast("bigint"))


def deletion_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.with_hold(detect.plan(_cold(spark, sf_dir)), 5).select("path", "action", "held")


def listing_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remote listing was cut off."""
    local, remote, baseline = fixtures.listings(spark, sf_dir)
    return guards.listing_counts(detect.cold(local, remote.filter("path < 'src12'"), baseline, _keep()))


def _deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.col("user_id").cast("string").alias("key"), "ts", F.lit(1).alias("n"))


def deletion_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _deletions(spark, sf_dir).withColumn("key", (F.col("key").cast("int") % 5).cast("string"))
    return guards.deletion_velocity(rows, 3).select("event_id", "key", "total", "tripped")


def action_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.action_counts(detect.plan(_cold(spark, sf_dir)))


def notification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each burst; files of each source are one burst, and every seventh action of a size failed."""
    plan = detect.plan(_cold(spark, sf_dir)).withColumn("burst", F.substring_index("path", "/", 1)).withColumn("failed", F.coalesce(F.col("local.size") % 7 == 0, F.lit(False)))
    return guards.summary(plan, "burst")


def detection_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.detection_profile(_cold(spark, sf_dir))


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.plan(_cold(spark, sf_dir)).filter("action = 'conflict'")


def conflict_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.keep_newer(_conflicts(spark, sf_dir)).select("path", "outcome")


def conflict_sibling_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are taken: the first for every document with an id that three divides, the second too for nine."""
    d = fixtures._documents(spark, sf_dir)
    taken = d.select("path").union(d.filter("doc_id % 3 = 0").select(paths.conflict_name(F.col("path"), F.lit(1)))).union(d.filter("doc_id % 9 = 0").select(paths.conflict_name(F.col("path"), F.lit(2))))
    return conflict.sibling_names(_conflicts(spark, sf_dir).select("path"), taken)


def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues modulo 3: 0 edits at both ends, 1 edits of one place, 2 the same insertion on both sides and one more edit."""
    r = F.col("doc_id") % 3
    rows = fixtures.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("first\n"), "text", F.lit("\nlast")).alias("base"),
        F.concat(F.when(r == 2, "both\nfirst\n").otherwise("mine\n"), "text", F.lit("\nlast")).alias("local"),
        F.concat(F.when(r == 0, "first\n").when(r == 1, "theirs\n").otherwise("both\nfirst\n"), "text", F.when(r == 1, "\nlast").otherwise("\nchanged")).alias("remote"),
    )
    found = merge.merge_texts(rows).select("path", "merged.*")
    return found.select("path", "success", "has_conflicts", F.when(~F.col("has_conflicts"), F.sha2("content", 256)).alias("sha"))


def commit_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline = fixtures.listings(spark, sf_dir)[2]
    done = rename.widen(detect.plan(_cold(spark, sf_dir)))
    return state.commit(baseline, done, 1_800_000_000_000).select("path", "hash", "local_mtime", "remote_mtime", "local_size", "remote_size", F.col("remote_checksum.value").alias("checksum"), "synced_at")


def execution_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.with_phases(detect.plan(_cold(spark, sf_dir))).groupBy("phase", "lane", "action").agg(F.count(F.lit(1)).alias("n")).withColumn("phase", F.col("phase").cast("bigint"))


def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.table(spark, sf_dir, "events")
    i = F.col("event_id")
    rows = e.select(
        "event_id",
        F.element_at(F.array(*map(F.lit, ["googledrive", "dropbox", "onedrive"])), (i % 3 + 1).cast("int")).alias("provider"),
        F.element_at(F.array(*map(F.lit, [401, 403, 404, 429, 500, 507, 423])), (i % 7 + 1).cast("int")).alias("status"),
        F.when(i % 2 == 0, "userRateLimitExceeded").when(i % 5 == 0, "path/insufficient_space").alias("reason"),
        (i % 4 + 1).cast("int").alias("attempt"),
        F.when(i % 11 == 0, "7").when(i % 13 == 0, "-3").alias("header"),
        ((i % 10) / 10.0).alias("rng"),
    )
    kind = errors.classify(F.col("provider"), F.col("status"), F.col("reason"))
    wait = errors.retry_after_seconds(F.col("header"), F.lit(0)) * 1000
    judged = rows.select("event_id", kind.alias("kind"), errors.decide_retry(kind, F.col("attempt"), F.lit(3), wait, F.col("rng")).alias("d"))
    return judged.select("event_id", "kind", "d.action", F.col("d.kind").alias("abort"), F.round("d.delay_ms").cast("bigint").alias("delay_ms"))


def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the cap: the audit keeps its last 500 rows."""
    e = fixtures.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type")
    return guards.append_history(e.filter("seq % 2 = 0"), e.filter("seq % 2 = 1"))


def _stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "events").select("ts", F.col("user_id").cast("string").alias("stream_key"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("path"), F.lit(None).cast("string").alias("old_path"))


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.bursts(_stream_events(spark, sf_dir), 3600).select("stream_key", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.debounce(_stream_events(spark, sf_dir), "1 hour").select("stream_key", F.unix_micros("first").alias("first"), F.unix_micros("fires_at").alias("fires_at"), "n")


def sliding_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _deletions(spark, sf_dir).withColumnRenamed("key", "stream_key")
    return ev.velocity(rows).select("stream_key", F.unix_micros("until").alias("until"), "n")


def rename_chain_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase renames a user's file to the next number."""
    e = fixtures.table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    name = lambda i: F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), i.cast("string"))
    rows = e.select("user_id", n.alias("seq")).select(F.col("user_id").cast("string").alias("stream_key"), "seq", name(F.col("seq") - 1).alias("old_path"), name(F.col("seq")).alias("new_path"))
    return rename.collapse_chains(rows)


def foreground_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("kind") == "view", "departed").when(F.col("kind") == "click", "returned").when(F.col("kind") == "purchase", "cycle")
    found = ev.foreground_triggers(_stream_events(spark, sf_dir).withColumn("kind", kind).filter("kind is not null"))
    return found.select("stream_key", F.unix_micros("ts").alias("micros"))


def tracked_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of an index text that hold a marker still; every fifth document's file has one."""
    d = _doc_paths(spark, sf_dir)
    index = d.filter("doc_id % 2 = 0").select(F.concat(F.lit("- [["), "path", F.lit("]]\nnoise [[x]]")).alias("text"))
    content = d.select("path", F.when(F.col("doc_id") % 5 == 0, F.lit(f"> {conflict.MARKER} Remote version")).otherwise("plain").alias("text"))
    return conflict.update_index(conflict.tracked_paths(index), d.filter("doc_id % 3 = 0").select("path"), content)


def drive_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 10 == 0, providers.FOLDER_TYPE).otherwise("text/plain").alias("mimeType"), F.col("n_chars").cast("string").alias("size"), F.when(F.col("doc_id") % 3 == 0, "2024-01-02T03:04:05.678Z").when(F.col("doc_id") % 3 == 1, "bad").alias("modifiedTime"), F.md5("text").alias("md5Checksum"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return providers.drive_entities(rows).select("path", "is_directory", "size", "mtime", F.col("remote_checksum.value").alias("checksum"))


def dropbox_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.table(spark, sf_dir, "documents")
    shown = F.concat(F.when(F.col("doc_id") % 4 == 0, "/Elsewhere/").otherwise("/My Vault/"), "source", F.lit("/Doc-"), F.col("doc_id").cast("string"))
    rows = d.select(F.when(F.col("doc_id") % 10 == 0, "folder").otherwise("file").alias(".tag"), F.lower(shown).alias("path_lower"), shown.alias("path_display"), F.col("n_chars").alias("size"), F.lit(None).cast("string").alias("server_modified"), F.lit("2024-01-02T03:04:05Z").alias("client_modified"), F.md5("text").alias("content_hash"), F.lit("r").alias("rev"))
    return providers.dropbox_entities(rows, "/my vault").select("path", "is_directory", "size", "mtime", F.col("remote_checksum.value").alias("checksum"))


_ALL = (
    plan_cold, plan_warm, plan_hot, plan_hot_few, local_changed, remote_changed, same_content, exclusion_scope, path_functions, content_digests, quickxor_digest,
    initial_match_enrichment, confirm_deletions, rename_local_files, rename_remote_files, rename_local_folders, rename_remote_folders, snapshot_diff_by_id,
    resolve_paths, apply_id_delta, subtree_rewrite, subtree_remove, prune_empty_folders, missing_folders, deletion_quarantine, listing_completeness,
    deletion_velocity, action_summary, notification, detection_profile, conflict_outcome, conflict_sibling_path, three_way_merge, commit_baseline,
    execution_phases, retry_decisions, history_cap, debounce_sessions, session_windows, sliding_velocity, rename_chain_collapse, foreground_triggers,
    tracked_conflicts, drive_entities, dropbox_entities,
)
QUERIES = {f.__name__: f for f in _ALL} | state_queries.QUERIES | cycle_queries.QUERIES
ORACLES = {name: sql for name, sql in (SQL | state_queries.SQL | cycle_queries.SQL).items() if name in QUERIES}

"""More queries of the reconciliation engine, each next to its SQL: state, conflicts, path feeds, tracking and whole cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import oracles
from tidemark.functions import errors, paths, providers, settings
from tidemark.operators import conflict, delta, detect, guards, merge, rename, snapshots, stages, state, tree
from tidemark.operators import predicates as p
from tidemark.plans import cycle, fixtures
from tidemark.streaming import events as ev
from tidemark.streaming import tracker

QUERIES: dict = {}
SQL: dict[str, str] = {}
NO_LIMIT = cycle.Settings(deletion_limit=None)
SETTLED = "('push', 'pull', 'match', 'conflict')"
DROPPED = "('delete_local', 'delete_remote', 'cleanup')"


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _keep() -> Column:
    from tidemark.operators import exclude

    return ~exclude.excluded(F.col("path"))


def _cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.cold(*fixtures.listings(spark, sf_dir), _keep())


def _number() -> Column:
    return F.regexp_extract("path", r"doc-([0-9]+)", 1).try_cast("bigint")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", F.concat_ws("/", "source", "lang", name).alias("path"))


_D = "SELECT doc_id, text, source, lang, source || '/' || lang || '/doc-' || doc_id || '.md' AS path FROM documents"
_PLAN = oracles._PLAN


def _act(left: str = "l", right: str = "r") -> str:
    return f"""CASE WHEN b AND {left} AND {right} THEN CASE WHEN lc AND rc THEN 'conflict' WHEN lc THEN 'push' WHEN rc THEN 'pull' END
              WHEN b AND {left} THEN CASE WHEN lc THEN 'conflict' ELSE 'delete_local' END
              WHEN b AND {right} THEN CASE WHEN rc THEN 'conflict' ELSE 'delete_remote' END
              WHEN b THEN 'cleanup' WHEN {left} AND {right} THEN CASE WHEN same AND l_size = r_size THEN 'match' ELSE 'conflict' END
              WHEN {left} THEN 'push' WHEN {right} THEN 'pull' END"""


# Conflicts


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few local sides have no known time."""
    found = detect.plan(_cold(spark, sf_dir)).filter("action = 'conflict'")
    return found.withColumn("local", F.when(_number() % 40 == 12, F.col("local").withField("mtime", F.lit(0).cast("bigint"))).otherwise(F.col("local")))


@_query(
    _PLAN
    + """, c AS (SELECT *, CASE WHEN k = 3 AND doc_id % 3 < 2 THEN 'merged' WHEN doc_id % 40 = 12 THEN 'duplicated' WHEN k = 5 THEN 'kept_local' ELSE 'kept_remote' END AS outcome FROM plan WHERE action = 'conflict')
    SELECT c.path, outcome, CASE WHEN outcome = 'duplicated' THEN c.path[1:length(c.path) - 3] || '.conflict.md' END AS duplicate_path, outcome = 'merged' AND c.doc_id % 3 = 1 AS has_markers,
           CASE WHEN outcome = 'merged' AND c.doc_id % 3 = 0 THEN sha256('mine' || chr(10) || text || chr(10) || 'changed') END AS sha
    FROM c JOIN d USING (path)"""
)
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of edits are merged where a base is stored: residues modulo 3 are 0 edits of both ends, 1 of one place, 2 no base."""
    d = _docs(spark, sf_dir).filter("doc_id % 20 = 3")
    r = F.col("doc_id") % 3
    texts = d.select(
        "path",
        F.when(r < 2, F.concat(F.lit("first\n"), "text", F.lit("\nlast"))).alias("base"),
        F.concat(F.lit("mine\n"), "text", F.lit("\nlast")).alias("local_text"),
        F.concat(F.when(r == 1, "theirs\n").otherwise("first\n"), "text", F.when(r == 1, "\nlast").otherwise("\nchanged")).alias("remote_text"),
    )
    found = conflict.resolve(_conflicts(spark, sf_dir), fixtures.listings(spark, sf_dir)[0], texts)
    return found.select("path", "outcome", "duplicate_path", "has_markers", F.when(~F.col("has_markers"), F.sha2("merged", 256)).alias("sha"))


@_query(
    _PLAN
    + """SELECT path, 'duplicated' AS outcome, CASE WHEN l AND r THEN path[1:length(path) - 3] || CASE WHEN doc_id % 9 = 0 THEN '.conflict-3' WHEN doc_id % 3 = 0 THEN '.conflict-2' ELSE '.conflict' END || '.md' END AS duplicate_path
         FROM plan WHERE action = 'conflict'"""
)
def conflict_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    taken = d.filter("doc_id % 3 = 0").select(paths.conflict_name(F.col("path"), F.lit(1)).alias("path")).union(d.filter("doc_id % 9 = 0").select(paths.conflict_name(F.col("path"), F.lit(2))))
    return conflict.resolve(_conflicts(spark, sf_dir), taken, strategy="duplicate").select("path", "outcome", "duplicate_path")


@_query(_PLAN + "SELECT 99 + row_number() OVER (ORDER BY path) AS seq, path, CASE WHEN doc_id % 40 = 12 THEN 'duplicated' WHEN k = 5 OR NOT r THEN 'kept_local' ELSE 'kept_remote' END AS action FROM plan WHERE action = 'conflict'")
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = conflict.keep_newer(_conflicts(spark, sf_dir)).withColumn("duplicate_path", F.lit(None).cast("string")).withColumn("has_markers", F.lit(False))
    return conflict.audit_rows(judged, 5, first_seq=100).select("seq", "path", "action")


@_query(f"WITH d AS ({_D}) SELECT string_agg('- [[' || path || ']]', chr(10) ORDER BY path) AS text FROM d WHERE doc_id % 5 = 0")
def conflict_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.index_text(_docs(spark, sf_dir).filter("doc_id % 5 = 0"))


# Feeds that are addressed by path, and listings by id


def _path_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    folder = lambda id_, path: d.select(id_.alias("id"), path.alias("path")).distinct().select("path", "id", F.lit(True).alias("is_directory"), F.lit("").alias("payload"))
    both = F.concat_ws("/", "source", "lang")
    return folder(F.concat(F.lit("s:"), "source"), F.col("source")).unionByName(folder(F.concat(F.lit("l:"), both), both)).unionByName(d.select("path", F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.lit(False).alias("is_directory"), F.md5("text").alias("payload")))


def _path_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources have folder entries alone: src1 moves, src2 is deleted and made anew, src3 moves onto src4, which is deleted.

    Residues of the others' documents modulo 11: 0 deleted, 1 moved, 2 edited, 3 deleted and made anew, 4 edited without an id, 5 moved out
    of the root, 6 moved away with a new file in its place, 7 moved onto the reserved path, 8 a stale deletion of a name that isn't there.
    """
    d = _docs(spark, sf_dir).filter(~F.col("source").isin("src1", "src2", "src3", "src4")).withColumn("r", F.col("doc_id") % 11)
    own, none = F.concat(F.lit("d:"), F.col("doc_id").cast("string")), F.lit(None).cast("string")
    row = lambda cond, seq, tag, id_, path: d.filter(cond).select((F.col("doc_id") * 4 + seq).cast("bigint").alias("seq"), F.lit(tag).alias("tag"), id_.alias("id"), path.alias("path"), F.lit("new").alias("payload"))
    path = F.col("path")
    rows = [
        row("r in (0, 1, 3, 6)", 1, "deleted", none, path),
        row("r = 1", 0, "file", own, F.concat(F.lit("moved/"), path)),
        row("r = 2", 0, "file", own, path),
        row("r in (3, 6)", 2, "file", F.concat(F.lit("new:"), own), path),
        row("r = 4", 0, "file", none, path),
        row("r = 5", 0, "file", own, none),
        row("r = 6", 3, "file", own, F.concat(F.lit("away/"), path)),
        row("r = 7", 0, "file", own, F.lit(".internal")),
        row("r = 8", 0, "deleted", none, F.concat(F.lit("never/"), path)),
    ]
    tops = _docs(spark, sf_dir).select("source").distinct()
    top = lambda source, seq, tag, id_, path: tops.filter(F.col("source") == source).select(F.lit(seq).cast("bigint").alias("seq"), F.lit(tag).alias("tag"), F.lit(id_).alias("id"), F.lit(path).alias("path"), F.lit("").alias("payload"))
    rows += [top("src1", 1, "folder", "s:src1", "top/src1"), top("src1", 2, "deleted", None, "src1"), top("src2", 1, "deleted", None, "src2"), top("src2", 2, "folder", "s:other", "src2")]
    rows += [top("src3", 1, "deleted", None, "src3"), top("src4", 1, "deleted", None, "src4"), top("src3", 2, "folder", "s:src3", "src4")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@_query(
    f"""WITH p AS ({_D}), o AS (SELECT *, doc_id % 11 AS r FROM p WHERE source NOT IN ('src1', 'src2', 'src3', 'src4')),
    t AS (SELECT source, source AS path FROM p UNION SELECT source, source || '/' || lang FROM p UNION SELECT source, path FROM p),
    n AS (SELECT 'src4' || path[5:] AS path FROM t WHERE source = 'src3'), has3 AS (SELECT count(*) > 0 AS yes FROM n)
    SELECT 'moved/' || path AS path, 'modified' AS kind, NULL::VARCHAR AS old_path FROM o WHERE r = 1
    UNION ALL SELECT 'moved/' || path, 'renamed', path FROM o WHERE r = 1
    UNION ALL SELECT 'away/' || path, 'modified', NULL FROM o WHERE r = 6
    UNION ALL SELECT 'away/' || path, 'renamed', path FROM o WHERE r = 6
    UNION ALL SELECT path, 'modified', NULL FROM o WHERE r IN (2, 3, 4, 6)
    UNION ALL SELECT path, 'deleted', NULL FROM o WHERE r IN (0, 1, 5, 7)
    UNION ALL SELECT 'top/' || path, 'modified', NULL FROM t WHERE source = 'src1'
    UNION ALL SELECT path, 'deleted', NULL FROM t WHERE source = 'src1'
    UNION ALL SELECT 'top/src1', 'renamed', 'src1' FROM t WHERE path = 'src1'
    UNION ALL SELECT path, CASE WHEN path = 'src2' THEN 'modified' ELSE 'deleted' END, NULL FROM t WHERE source = 'src2'
    UNION ALL SELECT path, 'modified', NULL FROM n
    UNION ALL SELECT path, 'deleted', NULL FROM t WHERE source = 'src3'
    UNION ALL SELECT path, 'deleted', NULL FROM t WHERE source = 'src4' AND path NOT IN (SELECT path FROM n)
    UNION ALL SELECT 'src4', 'renamed', 'src3' FROM t WHERE path = 'src3'"""
)
def apply_path_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delta.apply_path_delta(_path_cache(spark, sf_dir), _path_entries(spark, sf_dir), reserved=(".internal",))
    return found.changed.select("path", "kind", F.lit(None).cast("string").alias("old_path")).unionByName(found.renames.select(F.col("new_path").alias("path"), F.lit("renamed").alias("kind"), "old_path"))


@_query(
    f"""WITH p AS ({_D}), e AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'deleted' WHEN doc_id % 4 = 1 THEN 'folder' ELSE 'file' END AS tag, path, doc_id FROM p)
    SELECT doc_id, (tag = 'deleted')::INT AS late, (tag <> 'folder')::INT AS file, 3 AS depth FROM e"""
)
def drain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("doc_id") % 4
    tag = F.when(r == 0, "deleted").when(r == 1, "folder").otherwise("file")
    late, file, depth = delta.drain_keys(tag, F.col("path"))
    return _docs(spark, sf_dir).select("doc_id", late.alias("late"), file.alias("file"), depth.alias("depth"))


@_query(f"WITH d AS ({_D}) SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'modified' ELSE 'deleted' END AS kind FROM d WHERE doc_id % 3 = 0")
def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return delta.classify(d.filter("doc_id % 3 = 0"), d.filter("doc_id % 2 = 0"))


@_query(f"WITH d AS ({_D}) SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'upsert' ELSE 'delete' END AS kind FROM d WHERE doc_id % 3 = 0")
def cache_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    upserts, deletes = state.reconcile_cache(d.filter("doc_id % 3 = 0"), d.filter("doc_id % 2 = 0"))
    return upserts.select("path", F.lit("upsert").alias("kind")).unionByName(deletes.select("path", F.lit("delete").alias("kind")))


@_query(
    f"""WITH d AS ({_D}) SELECT path, doc_id % 10 = 0 AS is_directory, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS size, CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 4 = 0 THEN 1704164645000 WHEN doc_id % 4 = 1 THEN 1704164646000 ELSE 0 END AS mtime,
           CASE WHEN doc_id % 10 = 0 THEN NULL ELSE ['quickxor', 'sha256', 'sha1'][doc_id % 3 + 1] END AS algo,
           CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'qX=' WHEN doc_id % 3 = 1 THEN sha256(d.text) ELSE sha1(d.text) END AS value
    FROM d JOIN documents USING (doc_id)"""
)
def onedrive_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).join(fixtures.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    r, i = F.col("doc_id") % 3, F.col("doc_id")
    quick = F.when(r == 0, "qX=")
    hashes = F.struct(quick.alias("quickXorHash"), F.when(r <= 1, F.upper(F.sha2("text", 256))).alias("sha256Hash"), F.upper(F.sha1("text")).alias("sha1Hash"))
    items = d.select(
        "path", i.cast("string").alias("id"), F.col("n_chars").alias("size"),
        F.struct(hashes.alias("hashes")).alias("file"),
        F.when(i % 10 == 0, F.struct(F.lit(1).cast("bigint").alias("childCount"))).alias("folder"),
        F.struct(F.when(i % 4 == 0, "2024-01-02T03:04:05Z").alias("lastModifiedDateTime")).alias("fileSystemInfo"),
        F.when(i % 4 == 1, "2024-01-02T03:04:06Z").when(i % 4 == 2, "odd").alias("lastModifiedDateTime"),
    )
    return providers.onedrive_entities(items).select("path", "is_directory", "size", "mtime", F.col("remote_checksum.algo").alias("algo"), F.col("remote_checksum.value").alias("value"))


# Detection


@_query(_PLAN + "SELECT path, CASE WHEN k = 19 AND doc_id % 40 = 19 THEN h ELSE l_hash END AS hash FROM mixed WHERE l")
def rename_target_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the files without a hash, every other one is the target of a rename that a hash source knows."""
    d = fixtures._documents(spark, sf_dir).filter("k = 19")
    renames = d.filter("doc_id % 40 = 19").select(F.concat(F.lit("old/"), "path").alias("old_path"), F.col("path").alias("new_path"))
    return detect.enrich_rename_targets(_cold(spark, sf_dir), renames, d.select("path", F.col("h").alias("hash"))).filter("local is not null").select("path", F.col("local.hash").alias("hash"))


@_query(oracles._BASE.replace("{action}", _act(right="(r OR (b AND doc_id % 2 = 0))")) + "SELECT path, action FROM plan")
def confirm_remote_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote, baseline = fixtures.listings(spark, sf_dir)
    every = baseline.filter(F.col("local_mtime") % 2000 == 0).select("path", F.lit(False).alias("is_directory"), F.col("remote_size").alias("size"), F.col("remote_mtime").alias("mtime"), F.lit("").alias("hash"), "remote_checksum", "backend_meta")
    return detect.plan(detect.confirm_deletions(detect.cold(local, remote, baseline, _keep()), every, "remote")).select("path", "action")


@_query(_PLAN + "SELECT path, action FROM plan WHERE (NOT l OR l_size <= 2000) AND (NOT r OR r_size <= 2000)")
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.plan(detect.within_size(_cold(spark, sf_dir), 2000)).select("path", "action")


@_query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return detect.last_of_each(e, "event_id", "user_id").select("user_id", "event_type", "event_id")


@_query(
    f"""WITH d AS ({_D}), l AS (SELECT * FROM d WHERE doc_id % 2 = 0)
    SELECT 'child' AS kind, path, strlen(text)::BIGINT AS size FROM l WHERE source = 'src1' AND lang = 'en'
    UNION ALL SELECT 'stat', d.path, CASE WHEN d.doc_id % 2 = 0 THEN strlen(d.text)::BIGINT END FROM d WHERE doc_id % 5 = 0
    UNION ALL SELECT 'many', path, strlen(text)::BIGINT FROM l WHERE doc_id % 3 = 0
    UNION ALL SELECT 'read', path, length(text) FROM l WHERE doc_id % 10 = 0"""
)
def listing_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    listing = d.filter("doc_id % 2 = 0").select("path", F.lit(False).alias("is_directory"), F.octet_length("text").cast("bigint").alias("size"), F.col("doc_id"))
    odd = F.concat(F.lit("/"), F.regexp_replace("path", "/", r"\\\\"), F.lit("/"))
    found = [
        tree.children(listing, "src1/en").select(F.lit("child").alias("kind"), "path", "size"),
        state.stat(d.filter("doc_id % 5 = 0").select(odd.alias("path")), listing).select(F.lit("stat").alias("kind"), "path", F.col("found.size").alias("size")),
        state.get_many(listing, d.filter("doc_id % 3 = 0")).select(F.lit("many").alias("kind"), "path", "size"),
        state.read_content(listing.filter("doc_id % 10 = 0"), listing, d.select("path", F.col("text").alias("content"))).select(F.lit("read").alias("kind"), "path", F.char_length("content").cast("bigint").alias("size")),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


# Columns


@_query(
    """SELECT event_id, [200, 404, 410, 429][event_id % 4 + 1] AS status,
       CASE event_id % 6 WHEN 0 THEN 7.0 WHEN 1 THEN 0.0 WHEN 2 THEN (event_id % 100)::DOUBLE WHEN 3 THEN 0.5 END AS retry_after,
       event_id % 4 = 2 OR event_id % 7 = 0 AS expired, 't' || event_id AS token FROM events"""
)
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    date = F.lit("Wed, 21 Oct 2015 07:28:00 GMT")
    now = F.lit(1_445_412_480_000) - (i % 100) * 1000
    headers = F.when(i % 6 == 0, F.create_map(F.lit("retry-after"), F.lit("7"))).when(i % 6 == 1, F.create_map(F.lit("Retry-After"), F.lit("-3"))).when(i % 6 == 2, F.create_map(F.lit("retry-after"), date)).when(i % 6 == 3, F.create_map(F.lit("Retry-After"), F.lit("0.5"))).when(i % 6 == 4, F.create_map(F.lit("retry-after"), F.lit("soon")))
    status = F.element_at(F.array(*map(F.lit, [200, 404, 410, 429])), (i % 4 + 1).cast("int"))
    info = errors.error_info(F.struct(status.alias("status"), headers.alias("headers")), now)
    summary = F.when(i % 7 == 0, "reset/").when(i % 7 == 1, "path/not_found")
    link = F.concat(F.lit("https://example.org/delta?x=1&token=t"), i.cast("string"))
    return fixtures.table(spark, sf_dir, "events").select("event_id", info["status"].alias("status"), info["retry_after"].alias("retry_after"), errors.cursor_expired(status, summary).alias("expired"), errors.delta_token(link).alias("token"))


@_query(
    f"""WITH d AS ({_D}) SELECT doc_id, doc_id % 3 = 2 AS valid, len(list_distinct(['src/' || doc_id, 'src/b'])) AS n_lines, 'src/' || doc_id || ',src/b' AS lines,
       CASE doc_id % 4 WHEN 0 THEN 'auto_merge' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'duplicate' ELSE 'auto_merge' END AS strategy,
       CASE doc_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 5 ELSE -1 END AS most,
       CASE doc_id % 3 WHEN 0 THEN 'a,*.tmp,.cache/' WHEN 1 THEN '!*.tmp,.cache/' ELSE '*.tmp,.cache/,b' END AS patterns FROM d"""
)
def settings_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, path = F.col("doc_id"), F.col("path")
    new = F.when(i % 3 == 0, path).when(i % 3 == 1, F.concat(path, F.lit("/x"))).otherwise(F.concat(F.lit("other/"), path))
    lines = paths.parse_lines(F.concat(F.lit(" /src/"), i.cast("string"), F.lit("/ \n\nother\nsrc/b\r\nsrc/"), i.cast("string")), "src")
    strategy = F.element_at(F.array(*map(F.lit, ["auto_merge", "duplicate", "ask", "odd"])), (i % 4 + 1).cast("int"))
    limit = F.element_at(F.array(*map(F.lit, [0, 5, -1])), (i % 3 + 1).cast("int"))
    patterns = F.when(i % 3 == 0, F.array(F.lit("a"))).when(i % 3 == 1, F.array(F.lit("!*.tmp"))).otherwise(F.array(F.lit("*.tmp"), F.lit(".cache/"), F.lit("b")))
    return _docs(spark, sf_dir).select(
        "doc_id", paths.rename_is_valid(path, new).alias("valid"), F.size(lines).cast("bigint").alias("n_lines"), F.array_join(lines, ",").alias("lines"),
        settings.conflict_strategy(strategy).alias("strategy"), settings.deletion_limit(limit).alias("most"),
        F.array_join(settings.with_default_patterns(patterns, ["*.tmp", ".cache/"]), ",").alias("patterns"),
    )


@_query("SELECT doc_id, TRUE AS same, TRUE AS no_longer FROM documents")
def content_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    stored = fixtures.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), state.codec_encode(raw).alias("stored"))
    return stored.select("doc_id", (state.codec_decode(F.col("stored")) == F.col("raw")).alias("same"), (F.octet_length("stored") <= F.octet_length("raw") + 1).alias("no_longer"))


# State


@_query(f"WITH d AS ({_D}) SELECT 'moved/' || path AS path, CASE WHEN doc_id % 97 = 5 THEN sha256(text || 'L') ELSE sha256(text) END AS hash FROM d")
def folder_rename_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources moved; a folder rename rewrites its files' keys, and the files of a source with an edit are settled one by one."""
    *sides, files, folders = fixtures.local_folder_moves(spark, sf_dir)
    moved = rename.local_folders(detect.plan(detect.cold(*sides)), folders, files)
    return state.commit(sides[2], moved.plan, 5, moved.moved).select("path", "hash")


@_query(
    _PLAN
    + f""", fresh AS (SELECT path, doc_id FROM plan WHERE action IN {SETTLED} AND l AND l_size <= 1048576 AND path LIKE '%.md'),
    gone AS (SELECT path FROM plan WHERE action IN {DROPPED} UNION SELECT path FROM fresh)
    SELECT path, 'old' || doc_id AS content FROM sides WHERE b AND path NOT IN (SELECT path FROM gone) UNION ALL SELECT path, 'new' || doc_id FROM fresh"""
)
def merge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures._documents(spark, sf_dir)
    content = d.filter("k not in (9, 10, 11, 12, 17, 18, 19)").select("path", F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("content"))
    texts = d.filter("k not in (6, 7, 8, 10)").select("path", F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("content"))
    return state.merge_bases(content, detect.plan(_cold(spark, sf_dir)), texts)


_AFTER = """
, done AS (SELECT * FROM plan WHERE action <> 'conflict' {which})
SELECT path, sz AS local_size, sz AS remote_size FROM sides JOIN d USING (path) WHERE sides.b AND path NOT IN (SELECT path FROM done)
UNION ALL SELECT path, CASE WHEN action = 'pull' THEN r_size ELSE l_size END, CASE WHEN action = 'push' THEN l_size ELSE r_size END FROM done WHERE action IN ('push', 'pull', 'match')
"""
_WARM = "AND ((l AND (NOT b OR lc)) OR (b AND NOT l) OR k IN (2, 3, 4, 5, 7, 8, 10, 11, 12, 16))"
_HOT = "AND k IN (0, 1, 3, 5, 6, 9, 14, 2, 4, 13)"


def _told(spark: SparkSession, sf_dir: str, *residues: int) -> DataFrame:
    return fixtures._documents(spark, sf_dir).filter(F.col("k").isin(*residues)).select("path")


def _sizes(baseline: DataFrame) -> DataFrame:
    return baseline.select("path", "local_size", "remote_size")


def _settings(limit: int | None = None) -> cycle.Settings:
    return cycle.Settings(deletion_limit=limit, keep=_keep())


@_query(_PLAN + _AFTER.replace("{which}", ""))
def cold_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(cycle.cold_cycle(*fixtures.listings(spark, sf_dir), settings=_settings()).baseline)


@_query(_PLAN + _AFTER.replace("{which}", _WARM))
def warm_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(cycle.warm_cycle(*fixtures.listings(spark, sf_dir), _told(spark, sf_dir, 2, 3, 4, 5, 7, 8, 10, 11, 12, 16), settings=_settings()).baseline)


@_query(_PLAN + _AFTER.replace("{which}", _HOT))
def hot_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(cycle.hot_cycle(*fixtures.listings(spark, sf_dir), _told(spark, sf_dir, 0, 1, 3, 5, 6, 9, 14), _told(spark, sf_dir, 2, 4, 13), settings=_settings()).baseline)


@_query(
    _PLAN
    + """SELECT 'local' AS side, path, CASE WHEN action = 'pull' THEN r_size ELSE l_size END AS size FROM sides LEFT JOIN plan p USING (path, l_size, r_size) WHERE CASE WHEN action = 'pull' THEN TRUE WHEN action = 'delete_local' THEN FALSE ELSE sides.l END
    UNION ALL SELECT 'remote', path, CASE WHEN action = 'push' THEN l_size ELSE r_size END FROM sides LEFT JOIN plan p USING (path, l_size, r_size) WHERE CASE WHEN action = 'push' THEN TRUE WHEN action = 'delete_remote' THEN FALSE ELSE sides.r END"""
)
def listings_after_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cycle.cold_cycle(*fixtures.listings(spark, sf_dir), settings=_settings())
    return done.local.select(F.lit("local").alias("side"), "path", "size").unionByName(done.remote.select(F.lit("remote").alias("side"), "path", "size"))


@_query(_PLAN + _AFTER.replace("{which}", ""))
def approved_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all deletions held and then approved, the baseline is what an unlimited cycle leaves."""
    held = cycle.cold_cycle(*fixtures.listings(spark, sf_dir), settings=_settings(), velocity_tripped=True)
    return _sizes(cycle.approve_held(held)[2])


@_query(
    _PLAN
    + """, pulled AS (SELECT * FROM mixed WHERE doc_id % 2 = 0 AND b AND r AND rc AND NOT (l AND lc))
    SELECT path, r_size AS local_size, r_mtime AS local_mtime FROM pulled UNION ALL SELECT path, b_size, bl_mtime FROM sides WHERE b AND path NOT IN (SELECT path FROM pulled)"""
)
def opened_files_pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = fixtures._documents(spark, sf_dir).filter("doc_id % 2 = 0").select("path")
    pulled = tracker.pullable(opened, _cold(spark, sf_dir))
    return state.after_pull(fixtures.listings(spark, sf_dir)[2], pulled, 5).select("path", "local_size", "local_mtime")


@_query(_PLAN + "SELECT path, action, 'warm' AS before, 'cold' AS now FROM plan")
def rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursor is forgotten, so the next cycle is a cold one over the stored baseline."""
    local, remote, baseline = fixtures.listings(spark, sf_dir)
    store = snapshots.SnapshotStore(spark, stages.shared_folder(spark, "store"))
    store.save({"baseline": baseline, "remote": remote}, "cursor-1")
    heat = lambda: detect.temperature(True, False, not store.has_checkpoint(), store.load("baseline") is not None)
    before = heat()
    store.reset_checkpoint("remote")
    return detect.plan(detect.cold(local, remote, store.load("baseline"), _keep())).select("path", "action", F.lit(before).alias("before"), F.lit(heat()).alias("now"))


@_query(f"WITH d AS ({_D}) SELECT path, CASE WHEN doc_id % 12 = 0 THEN 'third' WHEN doc_id % 6 IN (0, 1) THEN 'second' ELSE 'first' END AS payload FROM d WHERE doc_id % 6 IN (0, 1, 4)")
def incremental_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents are cached; then some change, come or go, and some change again."""
    d = _docs(spark, sf_dir)
    rows = lambda cond, payload: d.filter(cond).select("path", F.lit(payload).alias("payload"))
    store = snapshots.SnapshotStore(spark, stages.shared_folder(spark, "store"))
    store.save({"cache": rows("doc_id % 2 = 0", "first")}, "c1")
    store.commit_increment("cache", rows("doc_id % 6 in (0, 1)", "second"), rows("doc_id % 6 = 2", ""), "c2")
    store.commit_increment("cache", rows("doc_id % 12 = 0", "third"), rows("false", ""), "c3")
    return store.load("cache")


# Tracking


def _vault_events(spark: SparkSession, sf_dir: str, all_of_them: bool) -> DataFrame:
    """Residues modulo 6: 0 edited, 1 moved, 2 moved twice, 3 moved and back, 4 moved in from out of scope, 5 a folder moved.

    The second part comes while a cycle runs. Residues modulo 12: 0 edited again, and another file; 1 moved on; 5 the folder moved on.
    """
    d = _docs(spark, sf_dir)
    path = F.col("path")
    at = lambda top: F.concat(F.lit(top), path)
    row = lambda cond, seq, new, old=None, folder=False: d.filter(cond).select(F.col("source").alias("stream_key"), (F.col("doc_id") * 8 + seq).alias("seq"), new.alias("path"), (F.lit(None).cast("string") if old is None else old).alias("old_path"), F.lit(folder).alias("is_folder"))
    rows = [
        row("doc_id % 6 = 0", 0, path), row("doc_id % 6 = 1", 0, at("new/"), path), row("doc_id % 6 = 2", 0, at("tmp/"), path), row("doc_id % 6 = 2", 1, at("fin/"), at("tmp/")),
        row("doc_id % 6 = 3", 0, at("new/"), path), row("doc_id % 6 = 3", 1, path, at("new/")), row("doc_id % 6 = 4", 0, path, at(".x/")), row("doc_id % 6 = 5", 0, at("f/"), path, True),
    ]
    if all_of_them:
        rows += [row("doc_id % 12 = 0", 2, path), row("doc_id % 12 = 0", 3, at("again/")), row("doc_id % 12 = 1", 2, at("newer/"), at("new/")), row("doc_id % 12 = 5", 2, at("g/"), at("f/"), True)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@_query(
    f"""WITH d AS ({_D}) SELECT 'dirty' AS kind, path AS key, NULL::VARCHAR AS value FROM d WHERE doc_id % 6 IN (0, 1, 2, 3, 4)
    UNION ALL SELECT 'dirty', 'new/' || path, NULL FROM d WHERE doc_id % 6 IN (1, 3) UNION ALL SELECT 'dirty', 'tmp/' || path, NULL FROM d WHERE doc_id % 6 = 2 UNION ALL SELECT 'dirty', 'fin/' || path, NULL FROM d WHERE doc_id % 6 = 2
    UNION ALL SELECT 'rename', 'new/' || path, path FROM d WHERE doc_id % 6 = 1 UNION ALL SELECT 'rename', 'fin/' || path, path FROM d WHERE doc_id % 6 = 2
    UNION ALL SELECT 'folder_rename', 'f/' || path, path FROM d WHERE doc_id % 6 = 5"""
)
def dirty_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.live(tracker.route(_vault_events(spark, sf_dir, False), ~paths.is_hidden(F.col("path"))))


@_query(
    f"""WITH d AS ({_D}) SELECT 'dirty' AS kind, 'again/' || path AS key, NULL::VARCHAR AS value FROM d WHERE doc_id % 12 = 0
    UNION ALL SELECT 'dirty', 'newer/' || path, NULL FROM d WHERE doc_id % 24 = 13
    UNION ALL SELECT 'rename', 'newer/' || path, path FROM d WHERE doc_id % 24 = 13
    UNION ALL SELECT 'folder_rename', 'g/' || path, path FROM d WHERE doc_id % 12 = 5"""
)
def dirty_after_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came while the cycle ran stays, but for files that were opened and pulled in the meantime."""
    scope = ~paths.is_hidden(F.col("path"))
    snapshot, now = (tracker.live(tracker.route(_vault_events(spark, sf_dir, x), scope)) for x in (False, True))
    pulled = _docs(spark, sf_dir).filter("doc_id % 24 = 1").select(F.concat(F.lit("newer/"), "path").alias("path"))
    return tracker.acknowledge_paths(tracker.acknowledge(now, snapshot), pulled)


_REQUESTS = "SELECT user_id::VARCHAR AS k, epoch_us(ts) AS m, bool_or(event_type = 'view') AS change FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL"


@_query(
    f"""WITH RECURSIVE q AS ({_REQUESTS}), c AS (
      SELECT k, min(m) AS s, FALSE AS again FROM q GROUP BY k
      UNION ALL
      SELECT k, least(coalesce(e, n), coalesce(n, e)), coalesce(e <= coalesce(n, e), FALSE) FROM (
        SELECT c.k, min(CASE WHEN q.change AND (q.m > c.s OR c.again AND q.m = c.s) AND q.m < c.s + 600000000 THEN c.s + 600000000 END) AS e, min(CASE WHEN q.m >= c.s + 600000000 THEN q.m END) AS n
        FROM c JOIN q USING (k) GROUP BY c.k, c.s, c.again) x WHERE e IS NOT NULL OR n IS NOT NULL)
    SELECT k AS stream_key, s AS micros FROM c"""
)
def cycle_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are changes, clicks are signals; a cycle takes ten minutes."""
    e = fixtures.table(spark, sf_dir, "events").filter("event_type in ('view', 'click')").groupBy(F.col("user_id").cast("string").alias("stream_key"), "ts").agg(F.when(F.bool_or(F.col("event_type") == "view"), "change").otherwise("signal").alias("kind"))
    return ev.cycles(e, 600).select("stream_key", "micros")


SQL["foreground_triggers"] = """
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS k, ts, event_type AS t FROM events),
r AS (SELECT k, ts, (SELECT max(d.ts) FROM e d WHERE d.k = e.k AND d.t = 'view' AND d.ts <= e.ts) AS left_at, (SELECT max(c.ts) FROM e c WHERE c.k = e.k AND c.t = 'purchase' AND c.ts <= e.ts) AS cycle_at FROM e WHERE t = 'click'),
good AS (SELECT DISTINCT * FROM r WHERE left_at IS NOT NULL AND (cycle_at IS NULL OR ts - cycle_at >= INTERVAL 1 MINUTE)),
f AS (SELECT k, min(ts) AS ts FROM good GROUP BY k
      UNION ALL SELECT f.k, min(g.ts) FROM f JOIN good g ON g.k = f.k AND g.left_at > f.ts AND g.ts - f.ts >= INTERVAL 1 MINUTE GROUP BY f.k, f.ts)
SELECT k AS stream_key, epoch_us(ts) AS micros FROM f
"""
SQL["three_way_merge"] = """
SELECT 'doc-' || doc_id || '.md' AS path, doc_id % 3 <> 1 AS success, doc_id % 3 = 1 AS has_conflicts,
       CASE doc_id % 3 WHEN 0 THEN sha256('mine' || chr(10) || text || chr(10) || 'changed') WHEN 2 THEN sha256('both' || chr(10) || 'first' || chr(10) || text || chr(10) || 'changed') END AS sha
FROM documents
"""

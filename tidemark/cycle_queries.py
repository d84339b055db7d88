"""Queries of whole cycles with what goes wrong in them, each next to its SQL: failed calls, refusals, renames in each other's way, conflicts with their writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import oracles
from tidemark.operators import apply, detect, exclude, merge, snapshots, stages, state, tree
from tidemark.plans import cycle, fixtures
from tidemark.sources import crawl
from tidemark.streaming import feed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _keep() -> F.Column:
    return ~exclude.excluded(F.col("path"))


def _settings(**more) -> cycle.Settings:
    return cycle.Settings(deletion_limit=None, keep=_keep(), **more)


# Transfers and deletions: of each score of documents, v tells what goes wrong


def _v() -> F.Column:
    return F.floor(F.col("doc_id") / 20) % 6


def _faults(spark: SparkSession, sf_dir: str, plan: DataFrame) -> DataFrame:
    """0: two calls fail and the third succeeds; 1: all three fail; 2: one fails for good, by a missing file or a missing right."""
    d = fixtures._documents(spark, sf_dir).select("path", "k", _v().alias("v")).filter("v < 3")
    actions = plan.filter(F.col("action").isin("push", "pull", "delete_local", "delete_remote")).select("path", "action").join(d, "path")
    calls = actions.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.when(F.col("v") == 0, 2).when(F.col("v") == 1, 3).otherwise(1))))
    kind = F.when(F.col("v") == 0, "transient").when(F.col("v") == 1, "rateLimit").when(F.col("k") % 2 == 0, "notFound").otherwise("permission")
    return calls.select("path", "action", "attempt", kind.alias("kind"), F.lit(100).cast("bigint").alias("retry_after_ms"))


def _troubled(spark: SparkSession, sf_dir: str) -> cycle.Cycle:
    """3: what should be copied has gone; 4: there is a folder where a new file should go."""
    local, remote, baseline = fixtures.listings(spark, sf_dir)
    plan = stages.cut(detect.plan(detect.cold(local, remote, baseline, _keep())))
    at = plan.select("path", "action", F.col("local").isNull().alias("no_local"), F.col("remote").isNull().alias("no_remote")).join(fixtures._documents(spark, sf_dir).select("path", _v().alias("v")), "path")
    now = {}
    for name, rows, copied, taken, absent in (("local", local, "push", "pull", "no_local"), ("remote", remote, "pull", "push", "no_remote")):
        gone = at.filter((F.col("v") == 3) & (F.col("action") == copied)).select("path")
        folders = at.filter((F.col("v") == 4) & (F.col("action") == taken) & F.col(absent)).select("path", F.lit(True).alias("is_directory"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime"), F.lit("").alias("hash"))
        now[name] = rows.join(gone, "path", "left_anti").unionByName(folders, allowMissingColumns=True)
    calls = cycle.Calls(faults=_faults(spark, sf_dir, plan), local=now["local"], remote=now["remote"])
    return cycle.cold_cycle(local, remote, baseline, settings=_settings(), synced_at=5, calls=calls)


_OUT = (
    oracles._PLAN
    + """, out AS (SELECT *, (doc_id // 20) % 6 AS v,
      CASE WHEN action = 'conflict' THEN 'left' WHEN action IN ('match', 'cleanup') THEN 'done'
           WHEN action IN ('push', 'pull') AND v = 3 THEN 'refused' WHEN v = 4 AND ((action = 'push' AND NOT r) OR (action = 'pull' AND NOT l)) THEN 'refused'
           WHEN v IN (1, 2) THEN 'failed' ELSE 'done' END AS status FROM plan)
"""
)


@_query(
    _OUT
    + """SELECT path, action, status,
       CASE WHEN status = 'refused' THEN CASE WHEN v = 3 THEN 'source_missing' ELSE 'folder_in_the_way' END WHEN status = 'failed' THEN CASE WHEN v = 1 THEN 'rateLimit' WHEN k % 2 = 0 THEN 'notFound' ELSE 'permission' END END AS reason,
       CASE WHEN status IN ('left', 'refused') THEN 0 WHEN action IN ('match', 'cleanup') THEN 1 WHEN v IN (0, 1) THEN 3 ELSE 1 END::INTEGER AS attempts FROM out"""
)
def apply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each action of a cycle in which calls fail and listings have changed since the plan."""
    return _troubled(spark, sf_dir).told.select("path", "action", "status", "reason", "attempts")


@_query(
    _OUT
    + """, again AS (SELECT path, CASE WHEN status IN ('failed', 'left') THEN action
           WHEN status = 'refused' AND v = 4 THEN 'conflict'
           WHEN status = 'refused' AND action = 'push' THEN CASE WHEN b THEN 'delete_remote' END
           WHEN status = 'refused' AND action = 'pull' THEN CASE WHEN b THEN 'delete_local' END
           WHEN k = 15 THEN 'conflict' END AS action FROM out)
    SELECT * FROM again WHERE action IS NOT NULL"""
)
def plan_after_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next cycle plans what failed and what its cause calls for, and nothing that is done. A file without time and hash has changed for all that is known."""
    done = _troubled(spark, sf_dir)
    return detect.plan(detect.cold(done.local, done.remote, done.baseline, _keep())).select("path", "action")


# Renames that the remote reported: of each ten documents, w tells what is in their way


def _renamed(spark: SparkSession, sf_dir: str) -> cycle.Cycle:
    """1: a file stands at the target; 2: the call fails; 3: of edited files, the pull after the rename fails."""
    local, remote, baseline, pairs = fixtures.remote_moves(spark, sf_dir)
    d = fixtures._moves(spark, sf_dir).withColumn("w", F.floor(F.col("doc_id") / 10) % 4)
    standing = d.filter("w = 1 and r < 8").select(F.col("new").alias("path"), F.lit(False).alias("is_directory"), F.lit(3).cast("bigint").alias("size"), F.lit(7).cast("bigint").alias("mtime"), F.sha2(F.lit("own"), 256).alias("hash"))
    none = spark.createDataFrame([], "old_path string, new_path string, ordinal bigint")
    one = lambda rows, action, kind: rows.select(F.col("new").alias("path"), F.lit(action).alias("action"), F.lit(1).alias("attempt"), F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("retry_after_ms"))
    faults = one(d.filter("w = 2 and r < 8"), "rename_local", "transient").unionByName(one(d.filter("w = 3 and r = 6"), "pull", "notFound"))
    calls = cycle.Calls(faults=faults, local=local.unionByName(standing, allowMissingColumns=True))
    return cycle.cold_cycle(local, remote, baseline, (none, none, pairs), _settings(), 5, calls=calls)


_RENAMED = oracles._MOVES + ", x AS (SELECT *, (doc_id // 10) % 4 AS w FROM m)"


@_query(
    _RENAMED
    + """SELECT new AS path, 'rename_local' AS action, old AS old_path, CASE w WHEN 1 THEN 'refused' WHEN 2 THEN 'failed' ELSE 'done' END AS status, CASE w WHEN 1 THEN 'target_exists' WHEN 2 THEN 'transient' END AS reason FROM x WHERE r < 8
    UNION ALL SELECT new, 'pull', NULL, CASE WHEN w = 3 THEN 'failed' ELSE 'done' END, CASE WHEN w = 3 THEN 'notFound' END FROM x WHERE r = 6 AND w IN (0, 3)
    UNION ALL SELECT new, 'pull', NULL, 'done', NULL FROM x WHERE r = 8"""
)
def rename_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of renames, and of the pulls of what was edited too."""
    return _renamed(spark, sf_dir).told.select("path", "action", "old_path", "status", "reason")


@_query(
    _RENAMED
    + """SELECT old AS path, 'delete_local' AS action FROM x WHERE r < 8 AND w IN (1, 2) UNION ALL SELECT new, 'conflict' FROM x WHERE r < 8 AND w = 1
    UNION ALL SELECT new, 'pull' FROM x WHERE (r < 8 AND w = 2) OR (r = 6 AND w = 3)"""
)
def plan_after_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No edit is lost: an edited file whose rename is done and whose pull isn't is pulled in the next cycle."""
    done = _renamed(spark, sf_dir)
    return detect.plan(detect.cold(done.local, done.remote, done.baseline, _keep())).select("path", "action")


@_query(
    """WITH d AS (SELECT doc_id, source || '/' || lang || '/doc-' || doc_id AS p, doc_id % 6 AS r FROM documents),
    a AS (SELECT doc_id, r, p || '.a' AS old, p || '.b' AS new FROM d WHERE r < 5 UNION ALL SELECT doc_id, r, p || '.b', p || '.c' FROM d WHERE r IN (0, 1, 2, 3) UNION ALL SELECT doc_id, r, p || '.c', p || '.a' FROM d WHERE r = 2
      UNION ALL SELECT doc_id, r, p || '.e', p || '.b' FROM d WHERE r = 4 UNION ALL SELECT doc_id, r, p || '.a', p || '.a/x' FROM d WHERE r = 5)
    SELECT new AS path, old AS old_path, CASE WHEN r = 0 OR (r = 3 AND old LIKE '%.b') OR (r = 4 AND old LIKE '%.a') THEN 'done' ELSE 'refused' END AS status,
      CASE WHEN r IN (1, 2) OR (r = 4 AND old LIKE '%.e') THEN 'target_exists' WHEN r = 3 AND old LIKE '%.a' THEN 'source_missing' WHEN r = 5 THEN 'into_itself' END AS reason FROM a"""
)
def rename_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames that wait for each other. Residues: 0 a chain of two, 1 one whose end is taken, 2 a circle, 3 a source that isn't there, 4 two with one target, 5 one into itself."""
    d = fixtures.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("p"), (F.col("doc_id") % 6).alias("r"))
    pair = lambda cond, old, new: d.filter(cond).select(F.concat("p", F.lit(old)).alias("old_path"), F.concat("p", F.lit(new)).alias("path"))
    renames = pair("r < 5", ".a", ".b").union(pair("r in (0, 1, 2, 3)", ".b", ".c")).union(pair("r = 2", ".c", ".a")).union(pair("r = 4", ".e", ".b")).union(pair("r = 5", ".a", ".a/x"))
    there = lambda cond, end: d.filter(cond).select(F.concat("p", F.lit(end)).alias("path"), F.lit(False).alias("is_directory"))
    listing = there("r <> 3", ".a").union(there("r in (0, 1, 2, 3)", ".b")).union(there("r in (1, 2)", ".c")).union(there("r = 4", ".e"))
    actions = renames.select("path", F.lit("rename_local").alias("action"), "old_path", F.lit(False).alias("is_folder"))
    results = apply.call_results(spark.createDataFrame([], apply.FAULTS))
    judged = apply.renamed(actions, listing, results, spark.createDataFrame([], "path string"))
    return judged.select("path", "old_path", "status", "reason")


# Conflicts with their writes, parents and emptied folders


def with_folders(listing: DataFrame) -> DataFrame:
    """The listing with rows for the folders above its files."""
    return apply._with_parents(listing, listing.select("path"))


def _resolving(spark: SparkSession, sf_dir: str) -> tuple[cycle.Cycle, cycle.Settings]:
    local, remote, baseline = fixtures.listings(spark, sf_dir)
    kept = [stages.cut(with_folders(x.filter(_keep() & ~((F.col("mtime") == 0) & (F.col("hash") == ""))))) for x in (local, remote)]
    d = fixtures._documents(spark, sf_dir).filter("k = 3")
    r = F.col("doc_id") % 3
    texts = d.select(
        "path",
        F.when(r < 2, F.concat(F.lit("first\n"), "text", F.lit("\nlast"))).alias("base"),
        F.concat(F.lit("mine\n"), "text", F.lit("\nlast")).alias("local_text"),
        F.concat(F.when(r == 1, "theirs\n").otherwise("first\n"), "text", F.when(r == 1, "\nlast").otherwise("\nchanged")).alias("remote_text"),
    )
    settings = cycle.Settings(deletion_limit=None, keep=_keep(), strategy="auto_merge", folders=True)
    return cycle.cold_cycle(*kept, baseline, settings=settings, synced_at=5, calls=cycle.Calls(texts=texts)), settings


#: Without the files of unknown content, as no cycle comes to an end with these: a local file of residue 15 is as good as deleted.
_RESOLVED = (
    oracles._BASE.replace("k NOT IN (6, 7, 8, 10) AS l", "k NOT IN (6, 7, 8, 10, 15) AS l").replace("{action}", oracles._action())
    + """, o AS (SELECT *, action = 'conflict' AS c, CASE WHEN action <> 'conflict' THEN NULL WHEN k = 3 AND doc_id % 3 < 2 THEN 'merged' WHEN k = 5 OR NOT r THEN 'kept_local' WHEN NOT l THEN 'kept_remote'
       WHEN l_mtime > r_mtime THEN 'kept_local' WHEN l_mtime < r_mtime THEN 'kept_remote' ELSE 'duplicated' END AS outcome FROM plan),
    after AS (SELECT mixed.path, mixed.l AND coalesce(action <> 'delete_local', TRUE) OR coalesce(action IN ('pull', 'conflict'), FALSE) AS l2, mixed.r AND coalesce(action <> 'delete_remote', TRUE) OR coalesce(action IN ('push', 'conflict'), FALSE) AS r2,
       CASE WHEN action = 'pull' OR outcome = 'kept_remote' THEN mixed.r_size WHEN outcome = 'merged' THEN -1 ELSE mixed.l_size END AS ls,
       CASE WHEN action = 'push' OR outcome IN ('kept_local', 'duplicated') THEN mixed.l_size WHEN outcome = 'merged' THEN -1 ELSE mixed.r_size END AS rs
       FROM mixed LEFT JOIN o USING (path))
"""
)


@_query(_RESOLVED + "SELECT path, 'local' AS side, ls AS size FROM after WHERE l2 UNION ALL SELECT path, 'remote', rs FROM after WHERE r2")
def resolved_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both listings after a cycle that resolves its conflicts: files and their sizes, -1 for merged texts."""
    done, _ = _resolving(spark, sf_dir)
    merged = F.broadcast(stages.cut(done.resolved.filter("outcome = 'merged'").select("path", F.lit(True).alias("merged"))))
    side = lambda rows, name: rows.filter("not is_directory").join(merged, "path", "left").select("path", F.lit(name).alias("side"), F.when(F.col("merged"), -1).otherwise(F.col("size")).alias("size"))
    return side(done.local, "local").unionByName(side(done.remote, "remote"))


@_query("SELECT 0::BIGINT AS planned, 0::BIGINT AS uneven_folders, 0::BIGINT AS empty_folders")
def settled_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of what a second cycle finds: actions but for folders that both sides have, folders of one side, and folders without a file below."""
    done, settings = _resolving(spark, sf_dir)
    plan = detect.plan(detect.cold(done.local, done.remote, done.baseline, settings.keep)).withColumn("folder", F.coalesce("local.is_directory", "remote.is_directory", F.lit(False)))
    counts = plan.agg(F.count_if(~F.col("folder")).alias("planned"), F.count_if(F.col("folder") & (F.col("action") != "match")).alias("uneven_folders"))
    empty = None
    for rows in (done.local, done.remote):
        above = rows.filter("not is_directory").select(F.explode(apply.paths.ancestors(F.col("path"))).alias("path")).distinct()
        one = rows.filter("is_directory").select("path").join(above, "path", "left_anti")
        empty = one if empty is None else empty.union(one)
    return counts.join(F.broadcast(empty.agg(F.count(F.lit(1)).alias("empty_folders"))))


@_query("""WITH d AS (SELECT source || '/' || lang || '/doc-' || doc_id || '.md' AS path, text, doc_id FROM documents)
    SELECT path, CASE WHEN doc_id % 2 = 0 THEN octet_length(encode(text)) END AS size, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS hash FROM d WHERE doc_id % 3 = 0""")
def stat_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single files are looked up by their bytes: the listing's size is stale and it has no hash."""
    d = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.concat_ws("/", "source", "lang", F.lit("doc-")), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    listing = d.filter("doc_id % 2 = 0").select("path", F.lit(False).alias("is_directory"), F.lit(1).cast("bigint").alias("size"), F.lit("").alias("hash"))
    return state.stat(d.filter("doc_id % 3 = 0"), listing, d.select("path", F.col("text").alias("content"))).select("path", "found.size", "found.hash")


@_query("""WITH n AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, doc_id % 3 = 0 AS folder FROM documents)
    SELECT CASE WHEN doc_id % 5 = 0 THEN source WHEN doc_id % 5 = 1 THEN '' ELSE source || '/' || lang || '/' || doc_id END AS path, (doc_id % 3 <> 0)::INTEGER AS file, CASE WHEN doc_id % 5 IN (0, 1) THEN 1 ELSE 3 END AS depth FROM documents""")
def entry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which entries of a page apply one by one: folders before files, by depth; an unknown path counts as the first level."""
    d = fixtures.table(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") % 5 == 0, F.col("source")).when(F.col("doc_id") % 5 == 1, "").otherwise(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    file, depth = tree.shallow_first(F.col("doc_id") % 3 == 0, path)
    return d.select(path.alias("path"), file.alias("file"), depth.alias("depth"))


@_query("""WITH d AS (SELECT source || '/' || doc_id AS p, doc_id % 5 AS r FROM documents)
    SELECT p || CASE WHEN r = 3 THEN '.md' WHEN r = 4 THEN '.canvas' ELSE '.json' END AS path, r IN (0, 2, 4) AS success, r IN (0, 3, 4) AS usable,
      CASE r WHEN 0 THEN 'x' WHEN 4 THEN 'x' END AS a, CASE r WHEN 0 THEN 'z' WHEN 4 THEN 'z' END AS c FROM d""")
def merge_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of structured files have to come out as JSON. Residues modulo 5: 0 and 4 two edits, 1 one place, 2 a merge that is no JSON, 3 one place in plain text."""
    d = fixtures.table(spark, sf_dir, "documents").withColumn("r", F.col("doc_id") % 5)
    text = lambda a, b, c, first="{": F.concat(F.lit(f'{first}\n"a": "'), a, F.lit('",\n"b": "'), b, F.lit('",\n"c": "'), c, F.lit('"\n}'))
    one, id_ = F.lit("1"), F.col("doc_id").cast("string")
    local = F.when(F.col("r").isin(1, 3), text(one, F.lit("mine"), one)).when(F.col("r") == 2, text(one, id_, one, "[")).otherwise(text(F.lit("x"), id_, one))
    remote = F.when(F.col("r").isin(1, 3), text(one, F.lit("theirs"), one)).otherwise(text(one, id_, F.lit("z")))
    path = F.concat("source", F.lit("/"), id_, F.when(F.col("r") == 3, ".md").when(F.col("r") == 4, ".canvas").otherwise(".json"))
    merged = merge.merge_texts(d.select(path.alias("path"), text(one, id_, one).alias("base"), local.alias("local"), remote.alias("remote")))
    good = F.when(F.col("usable") & F.col("merged.success"), F.col("merged.content"))
    return merged.select("path", F.col("merged.success").alias("success"), "usable", F.get_json_object(good, "$.a").alias("a"), F.get_json_object(good, "$.c").alias("c"))


# A tree that is listed folder by folder, and a feed of changes to it


def _page_files(spark: SparkSession, sf_dir: str, size: int = 40) -> str:
    """The nodes of the fixtures as pages of a service: a folder of files for each folder, whose pages name the next one."""
    import json
    from urllib.parse import quote

    import pyarrow as pa

    root = stages.shared_folder(spark, "pages")
    nodes = fixtures.nodes(spark, sf_dir).withColumn("folder", F.element_at("parent_ids", -1))
    place = F.row_number().over(Window.partitionBy("folder").orderBy("id")) - 1
    pages = nodes.withColumn("page", F.floor(place / size)).groupBy("folder", "page").agg(F.sort_array(F.collect_list(F.struct("id", "name", "is_folder", "payload"))).alias("entries"))
    last = Window.partitionBy("folder")
    pages = pages.withColumn("more", F.col("page") < F.max("page").over(last))
    empty = nodes.filter("is_folder").select(F.col("id").alias("folder")).join(pages.select("folder"), "folder", "left_anti").select("folder", F.lit(0).cast("bigint").alias("page"), F.array().cast(pages.schema["entries"].dataType).alias("entries"), F.lit(False).alias("more"))

    def write(batches):
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            for r in batch.to_pylist():
                folder = f"{top}/{quote(r['folder'], safe='')}"
                files.create_dir(folder, recursive=True)
                with files.open_output_stream(f"{folder}/{r['page'] or 'first'}.json") as f:
                    f.write(json.dumps({"entries": r["entries"], "next": str(r["page"] + 1) if r["more"] else None}).encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    pages.unionByName(empty).mapInArrow(write, "n long").agg(F.sum("n")).first()
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


_TREE = """WITH d AS (SELECT doc_id, source, lang, md5(text) AS m FROM documents)
    SELECT 's:' || source AS id, 'root' AS parent, source AS name, TRUE AS is_folder, '' AS payload FROM d GROUP BY source
    UNION ALL SELECT 'l:' || source || '/' || lang, 's:' || source, lang, TRUE, '' FROM d GROUP BY source, lang
    UNION ALL SELECT 'd:' || doc_id, 'l:' || source || '/' || lang, 'doc-' || doc_id || '.md', FALSE, m FROM d"""


@_query(_TREE)
def crawl_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes, found from the root on in rounds, each folder in pages."""
    found = crawl.crawl(spark, crawl.StoredPages(_page_files(spark, sf_dir)), "root")
    return crawl.listed(found, "name string, payload string").select("id", F.col("parent_ids")[0].alias("parent"), "name", "is_folder", "payload")


_FED = """WITH d AS (SELECT doc_id, source, lang, md5(text) AS m, doc_id % 6 AS r FROM documents),
    n AS (SELECT 's:' || source AS id, source AS path, '' AS payload FROM d GROUP BY source UNION ALL SELECT 'l:' || source || '/' || lang, source || '/' || lang, '' FROM d GROUP BY source, lang
      UNION ALL SELECT 'd:' || doc_id, source || '/' || lang || '/' || CASE WHEN r = 1 THEN 'new-' ELSE '' END || 'doc-' || doc_id || '.md', CASE WHEN r = 2 THEN 'edited' WHEN r = 4 THEN 'late' ELSE m END FROM d WHERE r <> 0)
    SELECT id, path, payload, 'replayed,applied,replayed,scanned' AS done FROM n"""


@_query(_FED)
def followed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes after a scan, a batch of changes, the same batch again, and an expired cursor with what the feed never told.

    Residues modulo 6: 0 deleted, 1 a new name alone, 2 new content alone, 4 changed while the cursor was no good. The root tells of itself.
    """
    first = fixtures.nodes(spark, sf_dir)
    r = F.regexp_extract("id", "^d:([0-9]+)$", 1).try_cast("bigint") % 6
    late = first.withColumn("r", r).filter("r is null or r <> 0").select("id", "parent_ids", F.when(F.col("r") == 1, F.concat(F.lit("new-"), "name")).otherwise(F.col("name")).alias("name"), "is_folder", F.when(F.col("r") == 2, "edited").when(F.col("r") == 4, "late").otherwise(F.col("payload")).alias("payload"))
    listings = iter((first, late))
    service = feed.Service(cursor=lambda: "now", listing=lambda: next(listings), root_is_there=lambda: True)
    follower = feed.Follower(spark, snapshots.SnapshotStore(spark, stages.shared_folder(spark, "feed")), service)
    follower.full_scan(0)
    d = fixtures.table(spark, sf_dir, "documents").withColumn("r", F.col("doc_id") % 6)
    entry = F.to_json(F.struct(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), (F.col("r") == 0).alias("tombstone"), F.when(F.col("r") == 1, F.concat(F.lit("new-doc-"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("name"), F.when(F.col("r") == 2, "edited").alias("payload")))
    none = F.lit(None).cast(f"struct<{apply._struct(feed.ERROR)}>")
    told = d.filter("r < 3").select(F.lit(1).alias("page"), F.col("doc_id").cast("int").alias("seq"), entry.alias("entry"), none.alias("error"))
    own = spark.range(1).select(F.lit(1).alias("page"), F.lit(-1).alias("seq"), F.lit('{"id": "root", "name": "top", "is_folder": true}').alias("entry"), none.alias("error"))
    gone = spark.range(1).select(F.lit(2).alias("page"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("entry"), F.struct(F.lit(410).alias("status"), F.lit("").alias("summary")).alias("error"))
    batch = told.unionByName(own)
    done = [follower.apply(batch, 0), follower.apply(batch, 1), follower.apply(batch, 1), follower.apply(gone, 2)]
    nodes = stages.cut(follower.nodes())
    return nodes.join(stages.many(tree.resolve_paths(nodes)), "id").select("id", "path", "payload", F.lit(",".join(done)).alias("done"))

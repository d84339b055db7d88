"""Listings, hierarchies and feeds derived from the driver's tables, so that every operator has rows of each kind at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import stages
from tidemark.operators.snapshots import SnapshotStore

EPOCH = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # the stored times have no zone; they count as times of the session's zone
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else rows


def _checksum(algo: Column | str, value: Column) -> Column:
    return F.struct((F.lit(algo) if isinstance(algo, str) else algo).alias("algo"), value.alias("value"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 20
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    path = F.when(k == 17, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/.DS_Store"))).when(k == 18, F.concat(F.lit(".cfg/"), name)).otherwise(F.concat_ws("/", "source", "lang", name))
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", "lang", k.alias("k"), path.alias("path"),
        (F.lit(EPOCH) + F.col("doc_id") * 1000).alias("t"),
        F.octet_length("text").cast("bigint").alias("sz"),
        F.sha2("text", 256).alias("h"),
        F.md5("text").alias("m"),
    )


def _entity(rows: DataFrame, path: Column, size: Column, mtime: Column, hash_: Column, checksum: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("struct<algo:string,value:string>")
    return rows.select(
        path.alias("path"),
        F.lit(False).alias("is_directory"),
        size.cast("bigint").alias("size"),
        mtime.cast("bigint").alias("mtime"),
        hash_.alias("hash"),
        (none if checksum is None else checksum).alias("remote_checksum"),
        F.lit(None).cast("map<string,string>").alias("backend_meta"),
    )


def _baseline(rows: DataFrame, path: Column, local_mtime: Column, remote_mtime: Column, size: Column, hash_: Column, checksum: Column) -> DataFrame:
    return rows.select(
        path.alias("path"), hash_.alias("hash"), local_mtime.cast("bigint").alias("local_mtime"), remote_mtime.cast("bigint").alias("remote_mtime"),
        size.cast("bigint").alias("local_size"), size.cast("bigint").alias("remote_size"), checksum.alias("remote_checksum"),
        F.lit(None).cast("map<string,string>").alias("backend_meta"), F.lit(EPOCH).cast("bigint").alias("synced_at"),
    )


def listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(local, remote, baseline): the residue of the document id decides what happened to its file."""
    d = _documents(spark, sf_dir)
    k, t, sz, h, m = (F.col(c) for c in ("k", "t", "sz", "h", "m"))
    text = F.col("text")
    local = _entity(
        d.filter(~k.isin(6, 7, 8, 10)),
        F.col("path"),
        sz + k.isin(1, 3, 5).cast("int"),
        F.when(k.isin(1, 3, 5, 14), t + 5000).when(k == 15, 0).otherwise(t),
        F.when(k.isin(15, 19), "").when(k.isin(1, 3, 5), F.sha2(F.concat(text, F.lit("L")), 256)).otherwise(h),
    )
    edited = k.isin(2, 3, 7, 12)
    remote = _entity(
        d.filter(~k.isin(4, 5, 8, 9)),
        F.col("path"),
        sz + edited.cast("int"),
        t + F.when(k.isin(2, 3, 7, 13, 16), 9000).otherwise(1000),
        F.lit(""),
        _checksum(F.when(k == 11, "sha256").when(k == 16, "quickxor").otherwise("md5"), F.when(edited, F.md5(F.concat(text, F.lit("R")))).when(k == 11, h).otherwise(m)),
    )
    baseline = _baseline(d.filter(~k.isin(9, 10, 11, 12, 17, 18, 19)), F.col("path"), t, t + 1000, sz, h, _checksum("md5", m))
    return local, remote, baseline


#: Where an application has put the listings of a folder of tables.
_STORED: dict[tuple[str, str], str] = {}


def stored_listings(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """The ``listings`` as a cycle leaves them for the next one: tables in buckets of the path. Written once an application, as the driver's tables don't change."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        store = SnapshotStore(spark, stages.shared_folder(spark, "listings"))
        tables = dict(zip(("local", "remote", "baseline"), listings(spark, sf_dir), strict=True))
        store.save(tables, "c1", keys=dict.fromkeys(tables, "path"), buckets=max(16, fixed_buckets(spark, sf_dir)))
        _STORED[key] = store.folder
    return SnapshotStore(spark, _STORED[key])


def fixed_buckets(spark: SparkSession, sf_dir: str) -> int:
    return min(4096, table(spark, sf_dir, "documents").count() // 100_000)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the local files."""
    return _documents(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content"))


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    old = F.concat_ws("/", "source", "lang", name)
    return _documents(spark, sf_dir).withColumn("old", old).withColumn("new", F.concat(F.lit("moved/"), old)).withColumn("r", F.col("doc_id") % 10)


def local_moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(local, remote, baseline, pairs): files moved locally. Residues: 6 edited, 7 not hashed, 8 copied instead, 9 left in place."""
    d = _moves(spark, sf_dir)
    r, t, sz, h, m = (F.col(c) for c in ("r", "t", "sz", "h", "m"))
    there = _entity(d.filter(r != 9), F.col("new"), sz, t, F.when(r == 6, F.sha2(F.concat("text", F.lit("L")), 256)).when(r == 7, "").otherwise(h))
    stayed = _entity(d.filter(r >= 8), F.col("old"), sz, t, h)
    remote = _entity(d, F.col("old"), sz, t + 1000, F.lit(""), _checksum("md5", m))
    baseline = _baseline(d, F.col("old"), t, t + 1000, sz, h, _checksum("md5", m))
    pairs = d.filter(r != 9).select(F.col("old").alias("old_path"), F.col("new").alias("new_path"), F.col("doc_id").alias("ordinal"))
    return there.unionByName(stayed), remote, baseline, pairs


def remote_moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(local, remote, baseline, pairs): files moved remotely. Residues: 6 edited too, 8 copied instead, 9 left in place."""
    d = _moves(spark, sf_dir)
    r, t, sz, h, m = (F.col(c) for c in ("r", "t", "sz", "h", "m"))
    local = _entity(d, F.col("old"), sz, t, h)
    there = _entity(d.filter(r != 9), F.col("new"), sz, t + 1000, F.lit(""), _checksum("md5", F.when(r == 6, F.md5(F.concat("text", F.lit("R")))).otherwise(m)))
    stayed = _entity(d.filter(r >= 8), F.col("old"), sz, t + 1000, F.lit(""), _checksum("md5", m))
    baseline = _baseline(d, F.col("old"), t, t + 1000, sz, h, _checksum("md5", m))
    pairs = d.filter(r != 9).select(F.col("old").alias("old_path"), F.col("new").alias("new_path"), F.lit(False).alias("is_folder"))
    return local, there.unionByName(stayed), baseline, pairs


#: Of documents whose id has this residue modulo ``ODD_OF``, folder moves have something in their way.
ODD_OF, ODD = 97, 5


def local_folder_moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(local, remote, baseline, file pairs, folder pairs): whole sources moved; one edited file keeps its source's files apart."""
    d = _moves(spark, sf_dir)
    odd = F.col("doc_id") % ODD_OF == ODD
    t, sz, h, m = (F.col(c) for c in ("t", "sz", "h", "m"))
    local = _entity(d, F.col("new"), sz, t, F.when(odd, F.sha2(F.concat("text", F.lit("L")), 256)).otherwise(h))
    remote = _entity(d, F.col("old"), sz, t + 1000, F.lit(""), _checksum("md5", m))
    baseline = _baseline(d, F.col("old"), t, t + 1000, sz, h, _checksum("md5", m))
    files = d.select(F.col("old").alias("old_path"), F.col("new").alias("new_path"), F.col("doc_id").alias("ordinal"))
    folders = d.groupBy("source").agg(F.min("doc_id").alias("ordinal")).select(F.col("source").alias("old_path"), F.concat(F.lit("moved/"), "source").alias("new_path"), "ordinal")
    return local, remote, baseline, files, folders


def remote_folder_moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(local, remote, baseline, pairs): whole sources moved remotely; some destinations are taken locally, sources that end with 3 go to a hidden folder."""
    d = _moves(spark, sf_dir)
    odd = F.col("doc_id") % ODD_OF == ODD
    top = F.when(F.col("source").endswith("3"), ".hidden/").otherwise("moved/")
    d = d.withColumn("folder", F.concat(top, F.col("source"))).withColumn("new", F.concat(top, F.col("old")))
    t, sz, h, m = (F.col(c) for c in ("t", "sz", "h", "m"))
    extra = _entity(d.filter(odd), F.concat("folder", F.lit("/extra-"), F.col("doc_id").cast("string"), F.lit(".md")), sz, t, h)
    local = _entity(d, F.col("old"), sz, t, h).unionByName(extra)
    remote = _entity(d, F.col("new"), sz, t + 1000, F.lit(""), _checksum("md5", m))
    baseline = _baseline(d, F.col("old"), t, t + 1000, sz, h, _checksum("md5", m))
    pairs = d.groupBy("source", "folder").agg(F.count(F.lit(1))).select(F.col("source").alias("old_path"), F.col("folder").alias("new_path"), F.lit(True).alias("is_folder"))
    return local, remote, baseline, pairs


def nodes(spark: SparkSession, sf_dir: str, with_odd: bool = False) -> DataFrame:
    """(id, parent_ids, name, is_folder, payload): sources, languages below them, documents below those; ``with_odd`` adds an orphan and a cycle of two."""
    d = table(spark, sf_dir, "documents")
    sources = d.select("source").distinct().select(F.concat(F.lit("s:"), "source").alias("id"), F.array(F.lit("root")).alias("parent_ids"), F.col("source").alias("name"), F.lit(True).alias("is_folder"), F.lit("").alias("payload"))
    langs = d.select("source", "lang").distinct().select(F.concat(F.lit("l:"), "source", F.lit("/"), "lang").alias("id"), F.array(F.lit("gone"), F.concat(F.lit("s:"), "source")).alias("parent_ids"), F.col("lang").alias("name"), F.lit(True).alias("is_folder"), F.lit("").alias("payload"))
    leaves = d.select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.array(F.concat(F.lit("l:"), "source", F.lit("/"), "lang")).alias("parent_ids"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.lit(False).alias("is_folder"), F.md5("text").alias("payload"))
    out = sources.unionByName(langs).unionByName(leaves)
    if with_odd:
        odd = [("o:1", ["nowhere"], "orphan", True, ""), ("o:2", ["o:1"], "below", False, ""), ("c:1", ["c:2"], "one", True, ""), ("c:2", ["c:1"], "two", True, ""), ("c:3", ["c:1"], "under", False, "")]
        out = out.unionByName(spark.createDataFrame(odd, "id string, parent_ids array<string>, name string, is_folder boolean, payload string"))
    return out


def id_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, seq, id, tombstone, parent_ids, name, is_folder, payload). Residues modulo 7: 0 deleted, 1 renamed, 2 moved up a folder, 3 edited, 4 a tombstone and then back."""
    d = table(spark, sf_dir, "documents").withColumn("r", F.col("doc_id") % 7)
    folder = F.array(F.concat(F.lit("l:"), "source", F.lit("/"), "lang"))
    common = [F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id")]
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    last = d.filter("r <= 4").select(
        F.lit(2).alias("page"), F.col("doc_id").cast("int").alias("seq"), *common, (F.col("r") == 0).alias("tombstone"),
        F.when(F.col("r") == 2, F.array(F.concat(F.lit("s:"), "source"))).otherwise(folder).alias("parent_ids"),
        F.when(F.col("r") == 1, F.concat(F.lit("new-"), name)).otherwise(name).alias("name"), F.lit(False).alias("is_folder"),
        F.when(F.col("r") == 3, F.md5(F.concat("text", F.lit("R")))).otherwise(F.md5("text")).alias("payload"),
    )
    first = d.filter("r in (1, 4)").select(F.lit(1).alias("page"), F.col("doc_id").cast("int").alias("seq"), *common, (F.col("r") == 4).alias("tombstone"), folder.alias("parent_ids"), F.concat(F.lit("draft-"), name).alias("name"), F.lit(False).alias("is_folder"), F.lit("x").alias("payload"))
    return last.unionByName(first)

"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair gets a score -weight / ln(u), where u in (0, 1) is a hash of both; the highest score wins. A new
shard changes no other pair's score, so records only ever move to it, in proportion to its weight.

Defined results: the key alone decides, so rows with equal keys share a shard; a null key counts as the string "null"; a null
text has size 1 and checksum 0; equal scores go to the smaller shard; repeated rows get slots of their own; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common


def _score(key: Column, shard: int, weight: float) -> Column:
    """48 bits of md5 are a number that every engine gives alike."""
    number = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 12), 16, 10).cast("double")
    return F.lit(-float(weight)) / F.log((number + F.lit(0.5)) / F.lit(float(1 << 48)))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of a string key. ``weights`` are positive, one a shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [F.struct(_score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def with_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard.

    A shard's rows are numbered in blocks, the partitions that hold them, so no task sees a whole shard: each block counts its
    rows, and a sum over the blocks, which are few, gives each its first slot. The rows are written before that, since the blocks
    must be the same in both reads.
    """
    blocks = common.materialize(rows.withColumn("block", F.spark_partition_id()), "shards")
    counts = blocks.groupBy(shard, "block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(shard).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy(shard, "block").orderBy("doc_id", "text_crc32", "size"))
    return blocks.withColumn("number", number).join(first, [shard, "block"]).withColumn("slot", F.col("first") + F.col("number") - 1).drop("block", "number", "first")


def shard_documents(docs: DataFrame, weights: Sequence[float], added_weight: float = 1.0) -> DataFrame:
    """Shard, slot and, with one more shard, the shard of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous_shard(key, weights).alias("shard"),
        rendezvous_shard(key, [*weights, added_weight]).alias("grown_shard"),
    )
    return with_slots(rows).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.table(spark, sf_dir, "documents"), [1.0] * 16)

"""Token files: documents as Parquet lists of token ids that can be read selectively.

A file holds a contiguous range of ids in ascending order. ``tokens`` is a list column with dictionary encoding; the
metadata columns use delta encoding, so a read of them alone touches a few bytes a document. Row groups and pages are kept
small, and the page index that the writer adds lets a filter on ``doc_id`` skip pages.

Defined results: a null text is an empty one (its only token is the end id); rows with a null id come first; rows with equal
ids are kept, in the order of their places in the input; other columns of the input, whatever their names, are not read; an empty table
gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm import common
from tidemark.llm.encoder import Encoder, vocabulary_path

FILE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("start_in_part", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType())),
    ]
)


def write_token_files(docs: DataFrame, path: str, *, vocabulary: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10) -> None:
    """Encode ``docs`` and write token files under ``path``, in ascending order of the ids over the files' parts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, before = Encoder.of(vocabulary), TaskContext.get().partitionId(), 0
        for batch in common.slices(common.joined(batches), memory=encoder):
            ids, offsets = encoder.encode_with_end(common.texts(batch), end_id)
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + offsets[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                names=FILE_SCHEMA.names,
            )
            before += int(offsets[-1])

    spark = docs.sparkSession
    rows = common.with_rows(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")))
    # rows of one id, or of none, are dealt by their places too, so many of them are no single part
    order = ("doc_id", "row")
    ranged = rows.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    writer = ranged.select("doc_id", "text").mapInArrow(encode, FILE_SCHEMA).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).option("maxRecordsPerFile", 0)
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.writer.version", "PARQUET_2_0")
    for column in ("doc_id", "start_in_part", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Columns of the files; select some or filter on ``doc_id`` and only their pages are read."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def document_starts(files: DataFrame) -> DataFrame:
    """For each part, the ids in all parts before it. Reads metadata columns only; one row a file, so it can be broadcast."""
    totals = files.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))


def token_digests(files: DataFrame) -> DataFrame:
    """Place, count and checksum of each document's ids, from the files."""
    schema = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(4)
            at, ids = np.asarray(tokens.offsets), np.ascontiguousarray(np.asarray(tokens.values), "<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    return files.select(*FILE_SCHEMA.names).mapInArrow(digest, schema).join(F.broadcast(document_starts(files)), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files, read them back and digest them."""
    docs = common.table(spark, sf_dir, "documents")
    path = common.stage_path(spark, "tokens")
    write_token_files(docs, path, vocabulary=vocabulary_path("byte_bpe_50k.json"))
    return token_digests(read_token_files(spark, path))

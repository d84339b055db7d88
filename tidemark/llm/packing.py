"""Best-fit packing of documents into sequences, with token, document-count and attention-cost capacities.

Pieces of one length are alike to the packer, so it works on the histogram of lengths, which has at most ``capacity`` rows
however large the input is. Bins with the same contents are one class with a count. From the longest length down, each length's
pieces go to the class, among those with room in every dimension, that vector best-fit prefers: the smallest weighted norm of
what stays free in it. The plan is a short list of (contents, number of sequences); every piece then finds its sequence by its
rank among the pieces of its length, which needs one equi-join with that list.

In sequences of ``tokens`` pieces of at most as many tokens, the squares of the lengths never add up to more than ``tokens`` squared, so the
default limits on documents and attention leave the fewest sequences alone. They bind where sequences are longer than pieces, or
documents are limited, as in the second packing that the query gives.

Defined results: a null text is an empty one, and has the end id alone; ids may be null or repeat, each row is packed; a text of any length
is cut, its first piece taking what full ones leave; of bins that fit alike the one with the least contents is taken, and pieces of one length
go to their places in the order of tasks and rows; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common
from tidemark.llm.encoder import REMEMBER_BYTES, Encoder, vocabulary_path

PIECES = "doc_id long, part int, piece int, start long, length long, ids_crc32 long, rank_in_part long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold. Attention cost is the sum of the squares of its pieces' lengths."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)


@dataclass(frozen=True)
class Pattern:
    """``count`` sequences with pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    count: int


def plan(histogram: dict[int, int], capacity: Capacity) -> list[Pattern]:
    """Vector best-fit over bin classes. The work depends on the distinct lengths, not on the number of pieces."""
    classes: dict[tuple[int, ...], int] = {}
    free: dict[tuple[int, ...], tuple[int, int, int]] = {(): (capacity.tokens, capacity.documents, capacity.attention)}
    done: list[Pattern] = []
    limits = (capacity.tokens, capacity.documents, capacity.attention)

    def norm(room: tuple[int, int, int], length: int) -> float:
        after = (room[0] - length, room[1] - 1, room[2] - length * length)
        return sum(w * (a / m) ** 2 for w, a, m in zip(capacity.weights, after, limits, strict=True))

    def most(room: tuple[int, int, int], length: int) -> int:
        return min(room[0] // length, room[1], room[2] // (length * length))

    smallest = min(histogram, default=0)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = [c for c in classes if free[c][0] >= length and free[c][1] >= 1 and free[c][2] >= length * length]
            into = min(fits, key=lambda c: (norm(free[c], length), c)) if fits else ()
            # a sequence that has just got a piece has the least room of those that fit, so best fit fills it before it takes another
            each = min(left, max(most(free[into], length), 1))
            take = min(left // each, classes[into]) if into else left // each
            if into:
                classes[into] -= take
                if not classes[into]:
                    del classes[into]
            room, new = free[into], into + (length,) * each
            free[new] = (room[0] - length * each, room[1] - each, room[2] - length * length * each)
            if free[new][0] < smallest or not free[new][1] or free[new][2] < smallest * smallest:
                done.append(Pattern(new, take))
            else:
                classes[new] = classes.get(new, 0) + take
            left -= take * each
    return done + [Pattern(c, n) for c, n in classes.items()]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, pieces a sequence, first sequence, offset): the pieces of a length with these ranks stand in these sequences."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for p in patterns:
        offset = 0
        for length, run in groupby(p.lengths):
            each = len(list(run))
            out.append((length, ranks.get(length, 0), p.count * each, each, sequence, offset))
            ranks[length] = ranks.get(length, 0) + p.count * each
            offset += length * each
        sequence += p.count
    return out


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: Capacity, slice_bytes: int = common.SLICE_BYTES, remember_bytes: int = REMEMBER_BYTES) -> DataFrame:
    """Cut documents, the first piece taking what full ones leave, and number the pieces of each length within each task."""
    most = capacity.tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder.of(vocabulary, remember_bytes), TaskContext.get().partitionId()
        seen = np.zeros(most + 1, np.int64)
        for batch in common.slices(batches, limit=slice_bytes, memory=encoder):
            ids, offsets = encoder.encode_with_end(common.texts(batch), end_id)
            ids, n = ids.astype("<u4"), np.diff(offsets)
            count = (n + most - 1) // most
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = n - (count - 1) * most
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * most)
            length = np.where(piece == 0, first[doc], most)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[doc] + start, offsets[doc] + start + length, strict=True)]
            order = np.argsort(length, kind="stable")
            runs = np.bincount(length, minlength=most + 1)
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + seen[length[order]]
            seen += runs
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(np.full(len(doc), part, np.int32)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(rank)],
                names=["doc_id", "part", "piece", "start", "length", "ids_crc32", "rank_in_part"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def place(rows: DataFrame, cut: DataFrame, capacity: Capacity, prefix: str = "") -> DataFrame:
    """Add ``sequence_id`` and ``offset``, with ``prefix``, to the pieces; ``cut`` is the table of them that was written."""
    spark = cut.sparkSession
    counts = cut.groupBy("length", "part").agg((F.max("rank_in_part") + 1).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    planned = slots(plan(histogram, capacity))
    places = spark.createDataFrame(planned or [(0, 0, 0, 1, 0, 0)], "slot_length long, first_rank long, n_rank long, each long, first_sequence long, first_offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.join(first, ["length", "part"]).withColumn("rank", F.col("before") + F.col("rank_in_part"))
    at = F.col("rank") - F.col("first_rank")
    # bounded: by the number of distinct lengths, as equal pieces of a pattern are one row
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("slot_length")) & (at >= 0) & (at < F.col("n_rank")))
    sequence, offset = F.col("first_sequence") + F.floor(at / F.col("each")), F.col("first_offset") + at % F.col("each") * F.col("length")
    return placed.select(*rows.columns, sequence.alias(f"{prefix}sequence_id"), offset.alias(f"{prefix}offset"))


RESULT = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack(docs: DataFrame, *, vocabulary: str, end_id: int = 2, capacity: Capacity = Capacity(), also: Mapping[str, Capacity] | None = None, lean: bool = False) -> DataFrame:
    """One row a piece with its sequence and its place there. Documents are cut for ``capacity``.

    ``lean`` lets workers encode less at once and remember less, at some more time, for executors that other work has filled.

    ``also`` packs the same pieces under other capacities, none of them too small for a piece, into columns with these prefixes.
    """
    sizes = (common.SMALL_SLICE_BYTES, REMEMBER_BYTES // 2) if lean else (common.SLICE_BYTES, REMEMBER_BYTES)
    cut = packed = common.materialize(pieces(docs, vocabulary, end_id, capacity, *sizes), "pieces")
    for prefix, other in {"": capacity, **(also or {})}.items():
        packed = place(packed, cut, other, prefix)
    return packed.select(*RESULT, *(f"{prefix}{c}" for prefix in also or () for c in ("sequence_id", "offset")))


#: Sequences of twice the length, where documents and attention have limits too.
LONG = Capacity(tokens=2048, documents=12, attention=3 * 1024 * 1024 // 2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest sequences of 1024 tokens; and the same pieces in long sequences, in which all three capacities bind."""
    return pack(common.table(spark, sf_dir, "documents"), vocabulary=vocabulary_path("byte_bpe_50k.json"), also={"long_": LONG})

"""Hard negatives by a distributed nearest-neighbour join over a Voronoi partition.

Scores are integer inner products. Each row gets one more coordinate, the root of the largest squared norm less its own; anchors get 0. Then the
nearer a row is to an anchor, the higher its score. A bounded sample of rows are pivots, and rows and anchors belong to the cell of their nearest
pivot. The anchors of a cell are a group (for positives, those of a cell and a bucket of labels).

Two searches follow each other: the best rows of an anchor's label, and for each of these positives the best rows of other labels in its band of scores.
Each search first joins a group with the rows of its own cell. What that finds bounds how far from an anchor a row can be and still be
among its best. A row of another cell is then sent to those groups alone whose bounds it meets: the ball around the pivot that holds the group, the
plane between both cells, and for a band also its upper end. Groups and the rows sent to them are counted and split into parts of a bounded
size, and each pair of parts is joined exactly in one task; the best of all parts are the best of all. No bound drops a row that could be among
them, so the result is exact for any pivots.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter vectors count as if zeros
followed; equal scores go to the smaller id, equal ids to the earlier place; repeated rows are rows of their own, one can be the positive of the
other; a score beyond a long is an error; no anchors, or an empty table, give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common

#: Buckets of labels; cells times buckets are the most groups there are.
BUCKETS = 16
#: Rows and anchors whose scores are in memory at once.
BLOCK_ROWS, BLOCK_ANCHORS = 2048, 1024
#: Distances that a task holds at once.
DISTANCES = 1 << 22
FOUND = "anchor long, anchor_id long, band int, found long, found_id long, score long"


@dataclass(frozen=True)
class Mining:
    """How many positives an anchor and negatives a positive, the band in percent of the positive's score, and sizes.

    ``part_anchors`` and ``part_bytes`` bound what a task joins; there is a pivot for ``part_anchors`` anchors, ``least_pivots`` at least and
    ``most_pivots`` at most, which are also the bound of the sample.
    """

    positives: int = 5
    negatives: int = 3
    least_percent: int = 50
    most_percent: int = 95
    part_anchors: int = 4096
    part_bytes: int = 16 << 20
    least_pivots: int = 4
    most_pivots: int = 1024


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(row, id, label, vec, anchor) of the rows that take part, from (id, label, vector, anchor); components become floor(scale * x)."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    return common.with_rows(kept).select("row", F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("vector", lambda x: F.floor(x.cast("double") * scale)).alias("vec"), F.coalesce("anchor", F.lit(False)).alias("anchor"))


def matrix(vec: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers, zeros after shorter ones."""
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    values, ends = np.asarray(vec.flatten(), np.int64), np.cumsum(np.asarray(pc.list_value_length(vec), np.int64))
    if len(values) == width * len(vec) and (len(vec) == 0 or (np.diff(ends, prepend=0) == width).all()):
        return values.reshape(len(vec), width)
    out = np.zeros((len(vec), width), np.int64)
    size = np.diff(ends, prepend=0)
    out[np.repeat(np.arange(len(vec)), size), np.arange(len(values)) - np.repeat(ends - size, size)] = values
    return out


@dataclass(frozen=True)
class Space:
    """The pivots, with their further coordinate, and the largest squared norm of all rows."""

    pivots: np.ndarray
    further: np.ndarray
    most: float

    @property
    def width(self) -> int:
        return self.pivots.shape[1]

    def squares(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        """Squared distances to the pivots."""
        x = vectors.astype(np.float64)
        norm = (x * x).sum(1)
        further = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.most - norm, 0))
        return np.maximum((norm + further**2)[:, None] + self.most - 2 * (x @ self.pivots.T + further[:, None] * self.further), 0)


def space(rows: DataFrame, mining: Mining) -> Space | None:
    """Pivots from ``rows``, by the order of a hash of their places. None if there is no anchor."""
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most, width = rows.agg(F.count_if("anchor"), F.max(square), F.max(F.size("vec"))).first()
    if not n:
        return None
    pivots = min(mining.most_pivots, max(mining.least_pivots, n // mining.part_anchors))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(pivots).select("vec").toArrow()
    points = np.unique(matrix(sample["vec"], width), axis=0).astype(np.float64)
    return Space(points, np.sqrt(np.maximum(most - (points**2).sum(1), 0)), float(most))


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of some ``rows`` each, as those of Spark are small."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def in_cells(rows: DataFrame, where: Space, anchors: bool) -> DataFrame:
    """(row, id, label, vec, cell, distance, norm): the nearest pivot, the distance to it and the squared norm."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, max(1, min(4096, DISTANCES // len(where.pivots)))):
            vectors = matrix(batch.column(3), where.width)
            squares = where.squares(vectors, anchors)
            cell = squares.argmin(1)
            norm = (vectors.astype(np.float64) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(squares[np.arange(len(cell)), cell])), pa.array(norm)], names=["row", "id", "label", "vec", "cell", "distance", "norm"])

    return rows.select("row", "id", "label", "vec").mapInArrow(place, "row long, id long, label long, vec array<long>, cell int, distance double, norm double")


@dataclass(frozen=True)
class Groups:
    """What is known of each group of anchors: its pivot and bucket (-1: all labels), the distances of its anchors from the pivot, and how far and how near a row of use can be."""

    group: np.ndarray
    pivot: np.ndarray
    bucket: np.ndarray
    inner: np.ndarray
    radius: np.ndarray
    reach: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, anchors: DataFrame, buckets: bool) -> Groups:
        """From (group, cell, distance, reach, near): at most cells times buckets rows come to the driver."""
        found = anchors.groupBy("group", "cell").agg(F.min("distance").alias("inner"), F.max("distance").alias("radius"), F.max("reach").alias("reach"), F.min("near").alias("near")).orderBy("group").toArrow()
        group = found["group"].to_numpy()
        return cls(group, found["cell"].to_numpy(), group % BUCKETS if buckets else np.full(len(group), -1), *[found[c].to_numpy() for c in ("inner", "radius", "reach", "near")])

    def served(self, where: Space, vectors: np.ndarray, cell: np.ndarray, label: np.ndarray) -> np.ndarray:
        """For each row and group whether the row can be of use there. A group has had the rows of its own cell."""
        squares = where.squares(vectors, False)
        far = np.sqrt(squares)
        own = squares[np.arange(len(cell)), cell]
        apart = np.sqrt(np.maximum(2 * (where.most - where.pivots @ where.pivots.T - np.outer(where.further, where.further)), 0))[cell]
        scale = max(np.sqrt(where.most), 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 1e-3 * scale, (squares - own[:, None]) / (2 * apart), 0.0)[:, self.pivot]
        d = far[:, self.pivot]
        least = np.maximum(np.maximum(d - self.radius, self.inner - d), plane)
        of_use = (least <= self.reach + 1e-5 * scale) & (d + self.radius >= self.near - 1e-5 * scale)
        return of_use & (cell[:, None] != self.pivot) & ((self.bucket == -1) | (label[:, None] % BUCKETS == self.bucket))


def sent(rows: DataFrame, groups: Groups, where: Space) -> DataFrame:
    """(group, row, id, label, vec): each row for each group that it may serve, but for its own cell's."""
    schema = "row long, id long, label long, vec array<long>, groups array<int>"

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, max(1, min(4096, DISTANCES // (len(where.pivots) + len(groups.group))))):
            mask = groups.served(where, matrix(batch.column(3), where.width), np.asarray(batch.column(4)), np.asarray(batch.column(2)))
            offsets = np.concatenate([[0], np.cumsum(mask.sum(1))]).astype(np.int32)
            chosen = groups.group[np.nonzero(mask)[1]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(offsets), pa.array(chosen))], names=["row", "id", "label", "vec", "groups"])

    return rows.select("row", "id", "label", "vec", "cell").mapInArrow(choose, schema).select(F.explode("groups").alias("group"), "row", "id", "label", "vec")


def best(anchors: pa.Table, rows: pa.Table, width: int, most: int, same: bool) -> pa.Table:
    """For each anchor and band the first ``most`` rows, of its label or of others, whose scores are in the band (low to high, null: no end)."""
    order = np.lexsort([rows["row"].to_numpy(), rows["id"].to_numpy()])
    rows = rows.take(pa.array(order))
    x, label, number = matrix(rows["vec"], width), rows["label"].to_numpy(), rows["row"].to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for first in range(0, anchors.num_rows, BLOCK_ANCHORS):
        part = anchors.slice(first, BLOCK_ANCHORS)
        q, own, me = matrix(part["vec"], width), part["label"].to_numpy()[:, None], part["row"].to_numpy()[:, None]
        exact = width * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**53
        kind = np.float64 if exact else object  # whole numbers of any size
        low, high = (np.array([[end if v is None else v for v in bands] for bands in part[name].to_pylist()], kind) for name, end in (("low", -np.inf), ("high", np.inf)))
        q, bands = q.astype(kind), low.shape[1]
        score, place = np.full((len(q), bands, most), -np.inf, kind), np.full((len(q), bands, most), -1)
        at = 0
        while at < len(x):
            step = BLOCK_ROWS if at else 256  # a short block first, so that most of the others' rows are known to be too low
            s = q @ x[at : at + step].astype(kind).T
            fit = ((label[None, at : at + step] == own) == same) & (number[None, at : at + step] != me)
            for b in range(bands):
                hit = fit & (s >= low[:, b, None]) & (s <= high[:, b, None]) & (s > score[:, b, -1:])
                better = np.flatnonzero(hit.any(1))
                if not len(better):
                    continue
                m = np.where(hit[better], s[better], -np.inf)
                top = np.argsort(-m, axis=1, kind="stable")[:, :most]
                both = np.concatenate([score[better, b], np.take_along_axis(m, top, 1)], 1)
                which = np.concatenate([place[better, b], at + top], 1)
                keep = np.argsort(-both, axis=1, kind="stable")[:, :most]
                score[better, b], place[better, b] = np.take_along_axis(both, keep, 1), np.take_along_axis(which, keep, 1)
            at += step
        a, b, r = np.nonzero(score > -np.inf)
        out.append((part["row"].to_numpy()[a], part["id"].to_numpy()[a], b.astype(np.int32), number[place[a, b, r]], rows["id"].to_numpy()[place[a, b, r]], score[a, b, r].astype(np.int64) if exact else np.array([*map(int, score[a, b, r])], object)))
    names = ["anchor", "anchor_id", "band", "found", "found_id", "score"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = [np.concatenate([o[i] for o in out]) if out else [] for i in range(6)]
    return pa.table([pa.array(list(c) if getattr(c, "dtype", None) == object else c, t) for c, t in zip(columns, types, strict=True)], names=names)


def local_joins(anchors: DataFrame, rows: DataFrame, where: Space, mining: Mining, most: int, same: bool, name: str) -> DataFrame:
    """The first ``most`` rows of each anchor and band among those sent to its group, written: ``best`` of each pair of parts, which have a bounded size.

    ``anchors`` has (group, row, id, label, vec, low, high), ``rows`` (group, row, id, label, vec).
    """
    size = max(1, mining.part_bytes // (8 * max(where.width, 1)))
    splits = anchors.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / mining.part_anchors).alias("anchor_parts")).join(rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / size).alias("row_parts")), "group")
    stored = common.materialize(splits, f"{name}-splits")
    splits = F.broadcast(stored)  # a row for each group
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = anchors.join(splits, "group").select("group", part("anchor_parts").alias("anchor_part"), every("row_parts").alias("row_part"), "row", "id", "label", "vec", "low", "high")
    right = rows.join(splits, "group").select("group", every("anchor_parts").alias("anchor_part"), part("row_parts").alias("row_part"), "row", "id", "label", "vec")
    keys, width = ("group", "anchor_part", "row_part"), where.width
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: best(a, b, width, most, same), FOUND)
    out = common.materialize(first_of(found, most), name)
    common.discard(stored)
    return out


def first_of(found: DataFrame, most: int) -> DataFrame:
    """With ``rank``, from 1: the first ``most`` rows of each anchor and band."""
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "found_id", "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def search(anchors: DataFrame, rows: DataFrame, where: Space, mining: Mining, most: int, same: bool, name: str) -> DataFrame:
    """The first ``most`` rows of each anchor and band. ``anchors`` has low and high, an array each of the bands' ends."""
    group = F.col("cell") * BUCKETS + F.pmod("label", F.lit(BUCKETS)).cast("int") if same else F.col("cell")
    grouped = anchors.withColumn("group", group)
    home = local_joins(grouped, rows.withColumn("group", group), where, mining, most, same, f"{name}-home")
    # where a band is full, what else belongs in it scores at least as much as the last one in it
    full = home.filter(F.col("rank") == most).groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("full"))
    raised = grouped.join(full, "row", "left").withColumn("low", F.when(F.col("full").isNull(), F.col("low")).otherwise(F.transform("low", lambda v, i: F.coalesce(F.try_element_at("full", i), v)))).drop("full")
    distance = lambda score: F.sqrt(F.greatest(F.col("norm") + F.lit(where.most) - 2.0 * score.cast("double"), F.lit(0.0)))
    open_low, open_high = F.exists("low", lambda v: v.isNull()), F.exists("high", lambda v: v.isNull())
    raised = raised.withColumns({"reach": F.when(open_low, float("inf")).otherwise(distance(F.array_min("low"))), "near": F.when(open_high, 0.0).otherwise(distance(F.array_max("high")))})
    raised = common.materialize(raised, f"{name}-anchors")
    rest = local_joins(raised, sent(rows, Groups.of(raised, same), where), where, mining, most, same, f"{name}-rest")
    out = common.materialize(first_of(home.unionByName(rest).drop("rank"), most), name)
    common.discard(home, raised, rest)
    return out


def hard_negatives(rows: DataFrame, mining: Mining = Mining(), scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``rows`` (id, label, vector, anchor)."""
    spark = rows.sparkSession
    all_rows = common.materialize(usable(rows, scale), "vectors")
    where = space(all_rows, mining)
    if where is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    placed = common.materialize(in_cells(all_rows, where, False), "cells")
    anchors = common.materialize(in_cells(all_rows.filter("anchor"), where, True), "anchors")
    open_end = F.array(F.lit(None).cast("long"))
    positives = search(anchors.withColumns({"low": open_end, "high": open_end}), placed, where, mining, mining.positives, True, "positives")
    scores = positives.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("of"))
    ends = {"low": F.transform("of", lambda p: -_floor(-p["score"] * mining.least_percent)), "high": F.transform("of", lambda p: _floor(p["score"] * mining.most_percent))}
    bands = anchors.join(scores, "row").withColumns(ends).drop("of")
    negatives = search(bands, placed, where, mining, mining.negatives, False, "negatives")
    common.discard(all_rows, placed, anchors)
    return _answers(positives, negatives)


def _floor(percent: Column) -> Column:
    """A whole number of hundredths, rounded down."""
    return F.floor(percent / F.lit(100).cast("decimal(3,0)")).cast("long")


def _answers(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    which = positives.select("anchor", (F.col("rank") - 1).alias("band"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(which, ["anchor", "band"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; every seventh id counts with the next label, as a known share of wrong labels."""
    rows = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor")))

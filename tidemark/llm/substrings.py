"""Exact removal of repeated passages: seed and extend over winnowed anchors.

Seeds. A window of ``SEED`` words is an anchor if its hash is the least of its winnowing neighbourhood; neighbourhoods are as wide
as makes every passage of ``length`` words hold an anchor, whatever stands around it. Anchors are counted over all documents, and
those that stand at two places or more are the seeds.

Extension. Both ways from each seed, all windows of ``length`` words that hold it are candidates. A candidate is a repeat if its
128-bit hash starts at two places; runs of repeats that follow one another are the maximal repeats. Matching by window instead of by
pair of places keeps the work linear and whole: a passage with a million copies gives a million rows, not a million squared, and no pair
of copies is left out. Copies in one slice of documents are one row, and a task sends a window twice at most while it remembers it: later
copies are repeats by then, and two rows tell all other tasks so. A passage in every document thus gives a few rows a task.

Seeds are broadcast while there are at most ``MOST_SEEDS`` of them (8 bytes each); with more, they are joined to the documents by id.

Defined results: a null text has no words; ids may be null or repeat, each row is a document of its own, so the words of a repeated
row are repeats; a document of fewer than ``length`` words loses none; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common, textkit

SEED = 12
MOST_SEEDS = 3_000_000
#: Windows that a task remembers to have sent, a power of two: the last one with each low part of the hash.
SENT = 1 << 18


def anchors(words: textkit.Words, hashes: np.ndarray, length: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the winnowed anchors."""
    h, at = textkit.windows(words, hashes, seed)
    span = length - seed + 1
    if len(h) < span:
        return h[:0], at[:0]
    text = words.text_of_word()[at]
    # sliding minimum by doubling; neighbourhoods that cross a text's end are dropped
    least, width = h, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(h) - span + 1], least[span - width : len(h) - width + 1])
    within = text[: len(h) - span + 1] == text[span - 1 :]
    chosen = np.zeros(len(h), bool)
    starts = np.flatnonzero(within)
    for j in range(span):
        chosen[starts + j] |= h[starts + j] == least[starts]
    return h[chosen], at[chosen]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("row"), F.col("text").cast("string").alias("text"))


def seed_counts(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, n): how often each anchor stands anywhere; each slice sends an anchor once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            words = textkit.split_words(common.texts(batch))
            h, _ = anchors(words, words.hashes(), length)
            value, n = np.unique(textkit.signed(h), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.minimum(n, 2).astype(np.int8))], names=["anchor", "n"])

    return _rows(docs).mapInArrow(count, "anchor long, n tinyint").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


def _candidates(words: textkit.Words, hashes: np.ndarray, length: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (n, 2) and first words of the windows that hold a seed."""
    h, at = anchors(words, hashes, length)
    if len(seeds) and len(h):
        i = np.minimum(np.searchsorted(seeds, v := textkit.signed(h)), len(seeds) - 1)
        at = at[seeds[i] == v]
    else:
        at = at[:0]
    h1, first = textkit.windows(words, hashes, length)
    reach = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(reach, np.maximum(at - (length - SEED), 0), 1)
    np.add.at(reach, at + 1, -1)
    wanted = np.cumsum(reach)[first] > 0
    # only documents with a candidate pay for the second hash
    if not wanted.any():
        return np.zeros((0, 2), np.int64), first[:0]
    h2, _ = textkit.windows(words, words.hashes(1), length, 1)
    return np.stack([textkit.signed(h1[wanted]), textkit.signed(h2[wanted])], 1), first[wanted]


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each different hash, the number of its hash for every row, and how often each number occurs."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    number = np.empty(len(s), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number, np.bincount(number, minlength=int(new.sum()))


class Sent:
    """How often a task has sent a window: a table of a fixed size, where a later window may take an earlier one's place."""

    def __init__(self):
        self.hash, self.times = np.zeros((SENT, 2), np.int64), np.zeros(SENT, np.int8)

    def known(self, h: np.ndarray) -> np.ndarray:
        """Which of these different windows have been sent twice; the others are counted as sent now."""
        slot = h[:, 0] & (SENT - 1)
        times = np.where((self.hash[slot] == h).all(1), self.times[slot], 0)
        fresh = times < 2
        self.hash[slot[fresh]], self.times[slot[fresh]] = h[fresh], times[fresh] + 1
        return ~fresh


_FOUND = "kind tinyint, h1 long, h2 long, row long, start int, stop int"


def repeat_spans(docs: DataFrame, length: int) -> DataFrame:
    """(row, spans): the sorted, disjoint spans of words that repeats cover. ``docs`` has ``row`` and ``text``."""
    spark = docs.sparkSession
    seeds = common.materialize(seed_counts(docs, length), "seeds")
    broadcast = seeds.count() <= MOST_SEEDS
    shared = spark.sparkContext.broadcast(np.sort(seeds.toArrow()["anchor"].to_numpy())) if broadcast else None
    if not broadcast:
        docs = _with_seeds(docs, seeds, length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows that are repeats as far as this task knows (kind 0), and the windows that it sends (kind 1)."""
        sent = Sent()
        for batch in common.slices(batches):
            words = textkit.split_words(common.texts(batch))
            own = shared.value if shared else np.unique(np.asarray(batch.column(2).flatten()).astype(np.int64))
            h, at = _candidates(words, words.hashes(), length, own)
            doc = words.text_of_word()[at]
            first, number, times = _groups(h)
            known = sent.known(h[first])
            again = (known | (times > 1))[number]
            here, of = at[again], doc[again]
            new = np.ones(len(here), bool)
            new[1:] = (np.diff(here) != 1) | (np.diff(of) != 0)
            begin = np.flatnonzero(new)
            start = here[begin] - words.first[of[begin]]
            stop = start + np.diff(np.append(begin, len(here)))
            send = np.sort(first[~known])
            place = at[send] - words.first[doc[send]]
            # a run is dealt by chance, as it meets no other row
            dealt = textkit.signed(textkit.mix((here[begin] + 1).astype(np.uint64)))
            columns = [
                np.repeat(np.array([0, 1], np.int8), [len(begin), len(send)]),
                np.concatenate([dealt, h[send, 0]]),
                np.concatenate([dealt, h[send, 1]]),
                None,
                np.concatenate([start, place]).astype(np.int32),
                np.concatenate([stop, place + 1]).astype(np.int32),
            ]
            rows = batch.column(0).take(pa.array(np.concatenate([of[begin], doc[send]])))
            yield pa.RecordBatch.from_arrays([rows if c is None else pa.array(c) for c in columns], names=["kind", "h1", "h2", "row", "start", "stop"])

    columns = ["row", "text"] if broadcast else ["row", "text", "anchors"]
    # one pass, one shuffle and one sort; a group has a few rows for each task that holds the window, and Spark spills large ones
    places = docs.select(*columns).mapInArrow(find, _FOUND).withColumn("places", F.count(F.lit(1)).over(Window.partitionBy("h1", "h2", "kind")))
    repeats = places.filter("kind = 0 or places > 1").select("row", "start", "stop")
    runs = repeats.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column(1):
                a = np.asarray(runs.values.field("start")).astype(np.int64)
                b = np.asarray(runs.values.field("stop")) + length - 1
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > b[:-1]
                begin = np.flatnonzero(new)
                out.append([{"start": int(x), "end": int(y)} for x, y in zip(a[begin], b[np.append(begin[1:], len(a)) - 1], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["row", "spans"])

    return runs.mapInArrow(merge, "row long, spans array<struct<start:long,end:long>>")


def _with_seeds(docs: DataFrame, seeds: DataFrame, length: int) -> DataFrame:
    """The documents that hold seeds, each with its own; for more seeds than are broadcast."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            words = textkit.split_words(common.texts(batch))
            h, at = anchors(words, words.hashes(), length)
            yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(h)), batch.column(0).take(pa.array(words.text_of_word()[at]))], names=["anchor", "row"])

    held = _rows(docs).mapInArrow(find, "anchor long, row long").join(seeds, "anchor", "left_semi").groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    return docs.select("row", "text").join(held, "row")


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """One row a document with its spans and the words that stay."""
    numbered = common.with_rows(docs.select("doc_id", "text")).select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = common.materialize(repeat_spans(numbered.select("row", "text"), length), "spans")
    return numbered.join(spans, "row", "left").select("doc_id", "text", "spans")


def digest_kept(documents: DataFrame) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            text = common.texts(batch)
            words = textkit.split_words(text)
            raw, n, removed, sha = words.data.tobytes(), words.count, [], []
            spans = batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                keep = np.ones(n[i], bool)
                for s in spans[i] or ():
                    keep[s["start"] : s["end"]] = False
                at = words.first[i] + np.flatnonzero(keep)
                removed.append(int(n[i] - len(at)))
                sha.append(hashlib.sha256(b" ".join(raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return documents.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_kept(remove_repeats(common.table(spark, sf_dir, "documents")))

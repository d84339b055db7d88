"""Exact n-gram Jaccard self-join with a token-group matrix, and the components of its links.

Sets. A document's set holds the 64-bit hashes of its distinct word shingles; only those of two documents at a time are compared. Documents
with equal sets, by 128 bits and size, are one set from then on.

Matrix. Take the tokens of all sets in one common order, and of a set of n the first fifth and then m = n // 10 more, at least one.
Two sets with similarity of 0.8 or more have at least the smaller m of those in common. The order here puts tokens that many
documents share last, the commonest at the very end (found with one count over all documents; it affects the work, never the result), so
that boilerplate brings together only documents that hold little else. Tokens that only one set has
there are dropped, and then sets that have too few left. The others are partitioned into groups of similar ones of a bounded size,
and the matrix has an entry for each token that a group's union holds, with the sizes of the sets behind it.

Opening. A pair of groups that share enough entries, with sizes that can agree, is opened: a member of one is checked against the union of
the other first, and only where the overlap with the union reaches the bound are the members of that group compared one by one.

Links in a large group of near copies are far too many to compare them all, and components need few of them. So groups are opened in
two rounds: first each with itself and, for each token, with the least group of that token; then, with groups formed anew inside the
components found, only pairs of different components. What is linked is never compared again; what isn't is compared exhaustively.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing and is its own component; a
text of fewer words than a shingle has one shingle of them all; rows with equal ids or null ids get a result each, where the least id
of a component leaves nulls out; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, textkit
from tidemark.llm.components import components

SHINGLE, PERCENT = 5, 80
#: Tokens of a set, divided by this, are those that similar sets share at the beginning of the order, at least.
MORE = 10
#: A token in that many documents of a slice is counted as common; in that many overall it is put last.
SEEN_HERE, COMMON = 3, 24
#: Common tokens and set ids that are broadcast at most (8 bytes each). With more, only commoner tokens are; with more sets, they are joined.
MOST_COMMON, MOST_SETS = 1_000_000, 3_000_000
#: Sets that a task knows to have sent, a power of two: the last one with each low part of the hash.
SENT = 1 << 16
#: Tokens in a group, about.
GROUP_TOKENS = 4096


def shingle_sets(text: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and their offsets."""
    words = textkit.split_words(text)
    hashes = words.hashes(lower=True)
    h, at = textkit.windows(words, hashes, k)
    of = words.text_of_word()[at]
    hs, docs = [h], [of]
    for n in range(1, k):
        if (words.count == n).any():
            h, at = textkit.windows(words, hashes, n)
            of = words.text_of_word()[at]
            whole = words.count[of] == n
            hs.append(h[whole])
            docs.append(of[whole])
    h, of = np.concatenate(hs), np.concatenate(docs)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(text)))])


def _text(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.col("text").cast("string").alias("text"))


def common_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many documents hold, ascending, and the place of each among them from the rarest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            h, n = np.unique(shingle_sets(common.texts(batch))[0], return_counts=True)
            at = n >= SEEN_HERE
            yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(h[at])), pa.array(n[at])], names=["t", "n"])

    counts = common.materialize(_text(docs).mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON), "common")
    least = COMMON
    while counts.filter(F.col("n") >= least).count() > MOST_COMMON:
        least *= 2
    held = counts.filter(F.col("n") >= least).toArrow()
    common.discard(counts)
    tokens, n = held["t"].to_numpy().view(np.uint64), held["n"].to_numpy()
    place = np.empty(len(tokens), np.int64)
    place[np.lexsort((tokens, n))] = np.arange(len(tokens))
    order = np.argsort(tokens)
    return tokens[order], place[order]


def _set_hashes(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textkit.mix(h ^ np.uint64(salt)))])
        out.append(textkit.signed(sums[off[1:]] - sums[off[:-1]]))
    return out[0], out[1]


def describe_sets(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, h1, h2, key) of each document."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            h, off = shingle_sets(common.texts(batch))
            n = np.diff(off)
            h1, h2 = _set_hashes(h, off)
            key = np.zeros(len(n), np.int64)
            key[n > 0] = textkit.signed(h)[off[:-1][n > 0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(h1), pa.array(h2), pa.array(key)], names=["row", "doc_id", "n", "h1", "h2", "key"])

    return _text(docs, "row", "doc_id").mapInArrow(describe, "row long, doc_id long, n long, h1 long, h2 long, key long")


def first_tokens(docs: DataFrame, last: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(t, h1, h2): the first tokens of each set, in the order by hash with the tokens of ``last`` at the end, the commonest last. Equal sets of a task are sent once."""
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(SENT, np.int64)
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            h, off = shingle_sets(common.texts(batch))
            n = np.diff(off)
            h1, h2 = _set_hashes(h, off)
            slot = h1 & (SENT - 1)
            fresh = np.zeros(len(n), bool)
            fresh[np.unique(h1, return_index=True)[1]] = True
            fresh &= sent[slot] != h1
            sent[slot] = h1
            of = np.repeat(np.arange(len(n)), n)
            tokens, place = shared.value
            rank = np.zeros(len(h), np.int64)
            if len(tokens):
                i = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                rank = np.where(tokens[i] == h, place[i] + 1, 0)
            order = np.lexsort((h, rank, of))
            size = np.where((n > 0) & fresh, n - (PERCENT * n + 99) // 100 + np.maximum(n // MORE, 1), 0)
            head = np.arange(len(h)) - np.repeat(off[:-1], n) < np.repeat(size, n)
            yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(h[order][head])), pa.array(h1[of[head]]), pa.array(h2[of[head]])], names=["t", "h1", "h2"])

    return _text(docs).mapInArrow(cut, "t long, h1 long, h2 long")


def set_tokens(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(s, tokens): the whole sets of ``sets`` (s), each from the text of the row that it is named after."""
    wanted = np.sort(sets.select("s").toArrow()["s"].to_numpy()) if sets.count() <= MOST_SETS else None
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    if wanted is None:
        docs = docs.join(sets.select(F.col("s").alias("row")), "row", "left_semi")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is not None:
                batch = batch.filter(pa.array(np.isin(np.asarray(batch.column(0)), shared.value)))
            for part in common.slices([batch], limit=common.SMALL_SLICE_BYTES):
                h, off = shingle_sets(common.texts(part))
                raw = [h[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["s", "tokens"])

    return _text(docs, "row").mapInArrow(tokens, "s long, tokens binary")


def form_groups(sets: DataFrame, by: str) -> DataFrame:
    """Add ``g``: sets alike in ``by``, some thousands of tokens together."""
    total = sets.groupBy(by).agg(F.sum("n").alias("total")).filter(F.col("total") > GROUP_TOKENS)
    parts = F.coalesce(F.ceil(F.col("total") / GROUP_TOKENS), F.lit(1)).cast("long")
    return sets.join(total, by, "left").withColumn("g", F.when(F.col("n") >= GROUP_TOKENS, F.xxhash64(F.lit("alone"), "s")).otherwise(F.xxhash64(F.col(by), F.pmod(F.xxhash64("s"), parts)))).drop("total")


def matrix(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(t, g, whole, least, most): the tokens of each group's union, and the sizes of the sets that have them. ``whole`` is the component of all members, or null.

    Entries are summed by token and group before anything is dealt by the token alone, so a token of many sets in few groups is few rows.
    """
    placed = entries.join(common.few(groups.select("s", "g", "n", "whole")), "s").select("t", "g", "n", "whole")
    return placed.groupBy("t", "g").agg(F.first("whole").alias("whole"), F.min("n").alias("least"), F.max("n").alias("most"))


def _enough(smaller: Column) -> Column:
    """Fewest entries that groups share in which two sets of at least ``smaller`` tokens are similar."""
    return F.greatest(F.floor(smaller / MORE), F.lit(1))


def _agree(a: str, b: str) -> Column:
    """Some sets behind the two entries can be similar by their sizes."""
    return (100 * F.col(f"{a}most") >= PERCENT * F.col(f"{b}least")) & (100 * F.col(f"{b}most") >= PERCENT * F.col(f"{a}least"))


def _shared_enough(rows: DataFrame) -> DataFrame:
    """(g1, g2) of the groups that share enough entries; ``rows`` has one for each entry that two groups share."""
    counted = rows.groupBy("g", "b_g").agg(F.count(F.lit(1)).alias("entries"), F.min(F.least("least", "b_least")).alias("smaller"))
    return counted.filter(F.col("entries") >= _enough(F.col("smaller"))).select(F.col("g").alias("g1"), F.col("b_g").alias("g2"))


def open_pairs(pairs: DataFrame, groups: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links (u, v) between the groups of each pair (g1, g2); g1 = g2 opens a group against itself."""
    used = pairs.select(F.explode(F.array("g1", "g2")).alias("g")).distinct()
    members = common.materialize(groups.select("s", "g", "whole").join(used, "g", "left_semi"), "members")
    held = tokens.join(common.few(members), "s").groupBy("g").agg(F.first("whole").alias("whole"), F.collect_list("s").alias("ids"), F.collect_list("tokens").alias("tokens"))
    sides = [held.select(F.col("g").alias(f"g{i}"), F.struct("whole", "ids", "tokens").alias(f"side{i}")) for i in (1, 2)]
    rows = pairs.join(sides[0], "g1").join(sides[1], "g2").select("g1", "g2", "side1", "side2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (batch.column(c)[i].as_py() for c in (2, 3))
                # the two sides are collected apart, so their orders can differ; a group is compared with itself in one order
                same = batch.column(0)[i].as_py() == batch.column(1)[i].as_py()
                links = compare_groups(left, left if same else right, same)
                if links:
                    u, v = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(compare, "u long, v long")


def compare_groups(left: dict, right: dict, same: bool) -> list[tuple[int, int]]:
    """Links between members; between two whole components one is enough, and for a member of one side one is enough if the other is whole."""
    a = [np.frombuffer(t, np.uint64) for t in left["tokens"]]
    b = [np.frombuffer(t, np.uint64) for t in right["tokens"]]
    # number the tokens of the right side: its union
    union = np.unique(np.concatenate(b))
    of = np.repeat(np.arange(len(b)), [len(x) for x in b])
    where = np.searchsorted(union, np.concatenate(b))
    sizes = np.array([len(x) for x in b])
    has = np.zeros((len(b), len(union)), np.float32) if len(b) * len(union) <= 4_000_000 else None
    if has is not None:
        has[of, where] = 1
    links: list[tuple[int, int]] = []
    for i, q in enumerate(a):
        at = np.minimum(np.searchsorted(union, q), len(union) - 1)
        hit = at[union[at] == q]
        if 100 * len(hit) < PERCENT * len(q):
            continue  # the bound: no member can be similar
        if has is not None:
            inter = has[:, hit].sum(1).astype(np.int64)
        else:
            mask = np.zeros(len(union), bool)
            mask[hit] = True
            inter = np.bincount(of[mask[where]], minlength=len(b))
        similar = np.flatnonzero(100 * inter >= PERCENT * (len(q) + sizes - inter))
        if same:
            similar = similar[similar > i]
        if right["whole"] is not None:
            similar = similar[:1]
        links += [(left["ids"][i], right["ids"][j]) for j in similar]
        if links and left["whole"] is not None and right["whole"] is not None:
            break
    return links


def join_similar(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, component, component_id), one row a document. ``docs`` has ``doc_id`` and ``text``.

    ``row`` is the number that ``common.with_rows`` gives each row of ``docs``; ``component`` is the least row of the component's sets, or null for an empty set.
    """
    spark = docs.sparkSession
    docs = common.with_rows(docs.select("doc_id", "text")).select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = common.materialize(describe_sets(docs), "described")
    same = ["h1", "h2", "n"]
    sets = common.materialize(described.filter("n > 0").groupBy(*same).agg(F.min("row").alias("s"), F.min("doc_id").alias("least_doc"), F.first("key").alias("key")), "sets")
    # one shuffle: both the count of a token's sets and the join with it read the same partitions
    first = first_tokens(docs, common_tokens(docs)).select("t", F.xxhash64("h1", "h2").alias("x")).repartition(common.partitions(spark), "t").distinct()
    shared = first.groupBy("t").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("t")
    having = common.materialize(first.join(shared, "t"), "shared")
    # a similar set has at least four fifths of this one's tokens
    concerned = having.groupBy("x").agg(F.count(F.lit(1)).alias("has")).join(sets.withColumn("x", F.xxhash64("h1", "h2")), "x").filter(F.col("has") >= _enough(F.col("n") * PERCENT / 100))
    concerned = common.materialize(concerned.drop("has"), "concerned")
    entries = common.materialize(having.join(common.few(concerned.select("x", "s")), "x").select("t", "s"), "entries")
    common.discard(having)
    tokens = common.materialize(set_tokens(docs, concerned), "tokens")

    groups = common.materialize(form_groups(concerned.drop("x"), "key").withColumn("whole", F.lit(None).cast("long")), "groups")
    cells = matrix(entries, groups)
    least = cells.groupBy("t").agg(F.min(F.struct("g", "least", "most")).alias("first"))
    to_least = cells.join(least, "t").select("g", "least", "most", F.col("first.g").alias("b_g"), F.col("first.least").alias("b_least"), F.col("first.most").alias("b_most"))
    near = _shared_enough(to_least.filter((F.col("g") != F.col("b_g")) & _agree("", "b_")))
    alone = groups.groupBy("g").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    pairs = common.materialize(near.unionByName(alone), "pairs")
    links = common.materialize(open_pairs(pairs, groups, tokens), "links")

    common.discard(pairs)
    part = components(links).withColumnRenamed("node", "s").withColumnRenamed("component", "whole")
    placed = groups.drop("whole").join(part, "s", "left")
    again = form_groups(placed.filter(F.col("whole").isNotNull()).drop("g"), "whole").select("s", "n", "g", "whole").unionByName(placed.filter(F.col("whole").isNull()).select("s", "n", "g", "whole"))
    again = common.materialize(again, "groups")
    common.discard(groups, concerned)
    cells = matrix(entries, again)
    other = cells.select("t", *[F.col(c).alias(f"b_{c}") for c in ("g", "whole", "least", "most")])
    apart = (F.col("g") < F.col("b_g")) & ~F.coalesce(F.col("whole") == F.col("b_whole"), F.lit(False)) & _agree("", "b_")
    pairs = common.materialize(_shared_enough(cells.join(other, "t").filter(apart)), "pairs")
    more = common.materialize(open_pairs(pairs, again, tokens), "links")

    common.discard(pairs, again, entries, tokens)
    linked = components(links.unionByName(more)).withColumnRenamed("node", "s")
    common.discard(links, more)
    of_set = sets.join(linked, "s", "left").withColumn("component", F.coalesce("component", "s"))
    least_doc = of_set.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    by_set = of_set.join(least_doc, "component").select(*same, "component", "component_id")
    out = described.select("row", "doc_id", *same).join(by_set, same, "left")
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays: the one with the least id, null last, and of equal ones the first. Empty documents stay."""
    docs = common.written(docs)
    found = common.materialize(join_similar(docs), "similar")
    first = found.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))["row"].alias("row"))
    gone = found.filter("n_shingles > 0").join(first, "row", "left_anti")
    return common.without_rows(docs, gone)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(common.table(spark, sf_dir, "documents")).drop("row", "component")

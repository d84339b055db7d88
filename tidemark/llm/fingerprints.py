"""Document fingerprints by I-Match over randomised lexicons, in built-in functions only.

The lexicon is the terms of a band of inverse document frequency: a term stands in it if at least ``least_share`` and at most
``most_share`` of the documents hold it (and two documents at least). It is split by the terms' hashes into many small random lexicons: at
level ``v`` there are ``2 ** v`` of them, and a fingerprint uses the first ``LEXICONS``. For each of these, the distinct terms that the text
has in it are sorted and hashed to one signature; a lexicon without a term of the text gives none. A text of ``n`` distinct terms is
fingerprinted at the level where a lexicon holds one of its terms or fewer, and at the next one, so that texts of like size
share a level. An edit changes the signatures of the few lexicons that hold an added or a removed term and leaves the others.

Likeness of two fingerprints is the share of signatures that both have, at the levels that both have: 2 * common / (all of one + all of the
other). It is 1 for equal fingerprints, and 0 without a shared level.

Only terms of the lexicons in question are looked up, so a text sends some dozens of numbers, whatever its length. The lexicon is broadcast
while it has at most ``MOST_TERMS`` terms, and joined beyond.

Defined results: a null text is an empty one; a text without a term of the lexicon has the hash of its whole text instead, which is like
that of equal texts alone; rows are told apart by their place, so null and equal ids are rows of their own, null ids last in the order, equal ones by
place; the only document is its own next one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common

#: Random lexicons of a level that are used; a power of two.
LEXICONS = 64
#: Terms of a lexicon that is broadcast, at most.
MOST_TERMS = 2_000_000
#: What stands between terms.
BETWEEN = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """The hashes of a text's distinct terms: runs of letters and digits, in lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, least_share: float = 1e-5, most_share: float = 0.1) -> DataFrame:
    """(term): the hashes of the terms of ``texts`` (text) in the band."""
    n = texts.count()
    frequency = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return frequency.filter(F.col("n").between(max(2.0, n * least_share), max(2.0, n * most_share))).select("term")


def level(n_terms: Column) -> Column:
    """The level at which a lexicon holds one of so many terms, or fewer."""
    return F.greatest(F.lit(LEXICONS.bit_length() - 1), F.floor(F.log2(F.greatest(n_terms, F.lit(1)).cast("double"))) + 1).cast("int")


def _place(term: Column) -> Column:
    """The number of the lexicon that a term stands in."""
    return term.bitwiseAND(F.lit(LEXICONS - 1))


def _signature(level_: Column, place: Column, held: Column) -> Column:
    """Eight hex digits of the hash of the sorted distinct terms of one lexicon."""
    return F.lpad(F.hex(F.xxhash64(level_, place, held).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")


def _signatures(level_: Column, held: Column) -> Column:
    """Sorted signatures of the lexicons that have a term in ``held``, which is sorted."""
    places = F.array_distinct(F.transform(held, _place))
    return F.sort_array(F.transform(places, lambda p: _signature(level_, p, F.filter(held, lambda x: _place(x) == p))))


def with_fingerprints(rows: DataFrame, columns: dict[str, str], words: DataFrame) -> DataFrame:
    """Replace each text column by its fingerprint under a new name. ``rows`` has a column ``row`` that tells rows apart.

    Rows that are dealt by ``row`` aren't shuffled again.
    """
    texts = list(columns)
    rest = [c for c in rows.columns if c not in columns and c != "row"]
    low = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v) - 1

    def chosen(i: int) -> Column:
        mask = low(F.col("levels")[i])
        return F.transform(F.filter(f"terms_{i}", lambda t: t.bitwiseAND(mask) < LEXICONS), lambda t: F.struct(F.lit(i).alias("of"), t.alias("term")))

    def fingerprint(i: int) -> Column:
        at = F.col("levels")[i]
        own = F.transform(F.filter("held", lambda x: x["of"] == i), lambda x: x["term"])
        mask = low(at + 1)
        narrow = F.filter(own, lambda t: t.bitwiseAND(mask) < LEXICONS)
        none = F.size(own) == 0
        return F.struct(F.when(~none, at).alias("level"), _signatures(at, own).alias("wide"), _signatures(at + 1, narrow).alias("narrow"), F.when(none, F.col(f"rest.whole_{i}")).alias("whole"))

    n = range(len(texts))
    wholes = [F.hex(F.xxhash64(t)).alias(f"whole_{i}") for i, t in enumerate(texts)]
    read = rows.select("row", F.struct(*rest, *wholes).alias("rest"), *[terms(F.col(t)).alias(f"terms_{i}") for i, t in enumerate(texts)])
    read = read.withColumn("levels", F.array(*[level(F.size(f"terms_{i}")) for i in n]))
    asked = read.select("row", "rest", "levels", F.explode_outer(F.concat(*map(chosen, n))).alias("asked")).select("row", "rest", "levels", "asked.of", "asked.term")
    found = asked.join(words.select("term", F.lit(True).alias("known")), "term", "left")
    held = F.sort_array(F.collect_list(F.when(F.col("known"), F.struct("of", "term"))))
    grouped = found.groupBy("row").agg(F.first("rest").alias("rest"), F.first("levels").alias("levels"), held.alias("held"))
    return grouped.select("row", *[F.col(f"rest.{c}").alias(c) for c in rest], *[fingerprint(i).alias(name) for i, name in enumerate(columns.values())])


def spelled(fingerprint: Column) -> Column:
    """A fingerprint as text: its level and the signatures at it and at the next one, or the hash of the whole text."""
    f = lambda x: fingerprint[x]
    return F.coalesce(F.concat(F.lit("="), f("whole")), F.concat(f("level").cast("string"), F.lit(":"), F.concat_ws(".", f("wide")), F.lit("/"), F.concat_ws(".", f("narrow"))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two fingerprints."""

    def share(*pairs: tuple[Column, Column]) -> Column:
        common_, all_ = F.lit(0), F.lit(0)
        for x, y in pairs:
            common_, all_ = common_ + F.size(F.array_intersect(x, y)), all_ + F.size(x) + F.size(y)
        return F.when(all_ > 0, 2.0 * common_ / all_).otherwise(0.0)

    same = F.when(a["level"] == b["level"], share((a["wide"], b["wide"]), (a["narrow"], b["narrow"])))
    same = same.when(a["level"] == b["level"] + 1, share((a["wide"], b["narrow"]))).when(a["level"] + 1 == b["level"], share((a["narrow"], b["wide"])))
    return F.when(a["whole"] == b["whole"], 1.0).otherwise(F.coalesce(same, F.lit(0.0)))


def next_rows(ids: DataFrame) -> DataFrame:
    """``ids`` (row, doc_id, ...) with ``next_row``: the next one in descending order of the ids; after the last comes the first.

    The rows are dealt by ranges and numbered by the place in their range and the sizes of the ranges before, so no task sees them all.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("row")]
    ranged = ids.repartitionByRange(common.partitions(ids.sparkSession), *order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id())
    stored = common.materialize(ranged, "order", maxRecordsPerFile="0")
    sizes = stored.groupBy("part_").agg(F.count(F.lit(1)).alias("size_"))  # a row for each partition
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("part_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("first_"), F.sum("size_").over(Window.partitionBy()).alias("all_"))
    placed = stored.withColumn("at_", F.col("_metadata.row_index")).join(F.broadcast(first), "part_").withColumn("place_", F.col("first_") + F.col("at_"))
    following = placed.select(F.col("place_").alias("next_"), F.col("row").alias("next_row"))
    chain = common.materialize(placed.withColumn("next_", (F.col("place_") + 1) % F.col("all_")).join(following, "next_").select(*ids.columns, "next_row"), "chain")
    common.discard(stored)
    return chain


def edited_texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_chars, next_row, text, edited): the last third of each text replaced by the beginning of the next document."""
    rows = common.with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    chain = next_rows(rows.select("row", "doc_id", F.char_length("text").cast("long").alias("n_chars")))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    texts = rows.select("row", "text")  # the same rows for both joins, so they are shuffled once
    heads = texts.join(chain.select(F.col("row").alias("to"), F.col("next_row").alias("row"), "doc_id", "n_chars"), "row").select(F.col("to").alias("row"), "doc_id", "n_chars", F.col("row").alias("next_row"), F.substring(F.col("text"), F.lit(1), cut).alias("head"))
    own = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int"))
    return texts.join(heads, "row").select("row", "doc_id", "n_chars", "next_row", "text", F.concat(own, F.col("head")).alias("edited"))


def fingerprint_documents(docs: DataFrame, least_share: float = 1e-5, most_share: float = 0.1) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and the likeness to these and to the next document."""
    words = common.materialize(lexicon(docs.select(F.col("text").cast("string").alias("text")), least_share, most_share), "lexicon")
    rows = edited_texts(docs).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    done = common.materialize(with_fingerprints(rows, {"text": "own", "edited": "changed"}, F.broadcast(words) if words.count() <= MOST_TERMS else words), "fingerprints")
    common.discard(words)
    following = done.select(F.col("row").alias("next_row"), F.col("own").alias("following"))
    own, changed = F.col("own"), F.col("changed")
    return done.join(following, "next_row").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelled(own).alias("fingerprint"),
        spelled(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, F.col("following")).alias("near_next"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(common.table(spark, sf_dir, "documents"))

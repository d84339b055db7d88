"""Phrases, fingerprints and hard negatives by their parts: other limits, the joined forms, and what bounds leave out."""

from __future__ import annotations

import random
from dataclasses import replace

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, fingerprints, negatives, phrases, textkit


def documents(spark, rows):
    return common.materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")


@pytest.mark.parametrize(("bits", "least", "most", "longest"), [(1 << 27, 3, 2000, 5), (1 << 6, 3, 2000, 5), (1 << 27, 2, 7, 3), (1 << 27, 5, 2000, 2)])
def test_phrases_under_other_limits(spark, sf_dir, rows, monkeypatch, bits, least, most, longest):
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    found = phrases.collocations(common.table(spark, sf_dir, "documents"), phrases.Limits(longest=longest, least=least, most=most)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    # texts of a hundred thousand alike words make the same counts quickly, so ties are many
    assert sorted(map(tuple, found)) == sorted(brute.collocations(rows, longest, least, most))


def test_pieces_languages_and_ties_of_phrases(spark):
    rows = [(1, "A b! a B, a b\ta  b\u00a0c", "en"), (2, "a b", None), (2, "a b a", None), (None, None, "en"), (3, ".,;:", ""), (4, "b a\na b", "")] * 3
    found = phrases.collocations(documents(spark, rows), phrases.Limits(least=3)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, found)) == sorted(brute.collocations(rows, least=3))
    assert {r["lang"] for r in found} == {"en", "und", ""}


def test_a_table_of_bits_holds_what_was_put_in(spark):
    frequent = spark.createDataFrame([("en", f"w{i} x{i % 7}", 100) for i in range(500)], "lang string, phrase string, n long")
    bits = phrases.bits_of(frequent, 2)
    read = phrases.Slice.of(pa.array([f"w{i} x{i % 7}" for i in range(500)] + [f"w{i} y" for i in range(500)], pa.large_string()), ["en"] * 1000)
    has = bits.has(textkit.runs(read.hashes, 2)[read.starts(2)])
    assert has[:500].all() and has[500:].mean() < 0.2


def test_large_counts_are_exact(spark):
    levels = spark.createDataFrame([("en", "a", 1, 10**14), ("en", "b", 1, 3 * 10**13 + 7), ("en", "a b", 2, 10**13 + 3)], "lang string, phrase string, k int, n long")
    got = phrases.scored(levels, spark.createDataFrame([("en", 9 * 10**16 + 1)], "lang string, n long")).first()
    assert got["score"] == 1000 * (10**13 + 3) * (9 * 10**16 + 1) // (10**14 * (3 * 10**13 + 7))


def test_a_joined_lexicon_gives_what_a_broadcast_one_does(spark, sf_dir, monkeypatch):
    docs = common.table(spark, sf_dir, "documents")
    broadcast = sorted(map(str, fingerprints.fingerprint_documents(docs).collect()))
    monkeypatch.setattr(fingerprints, "MOST_TERMS", 0)
    assert sorted(map(str, fingerprints.fingerprint_documents(docs).collect())) == broadcast


def test_edited_texts_are_nearer_than_others(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    docs = documents(spark, [(i, " ".join(rng.choices(words, k=rng.choice([60, 200, 900, 3000]))), "en") for i in range(120)] + [(500 + i, "the very same text of some words here", "en") for i in range(3)])
    rows = fingerprints.fingerprint_documents(docs, most_share=0.5).collect()
    assert len({r["fingerprint"] for r in rows if r["doc_id"] >= 500}) == 1
    others = [r for r in rows if r["doc_id"] < 500]
    assert sum(r["near_edited"] > r["near_next"] + 0.1 for r in others) >= 0.95 * len(others)


def test_fingerprints_run_no_python_on_executors(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    texts = fingerprints.edited_texts(docs)
    plan = fingerprints.with_fingerprints(texts, {"text": "own", "edited": "changed"}, fingerprints.lexicon(docs))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapPartitions"))


def test_the_next_document_of_many_ranges(spark):
    ids = [5] * 40 + [None] * 40 + list(range(100))
    random.Random(1).shuffle(ids)
    rows = common.materialize(spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "row long, doc_id long"), "ids")
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, -(ids[i] or 0), i))
    assert {r["row"]: r["next_row"] for r in fingerprints.next_rows(rows).collect()} == dict(zip(order, order[1:] + order[:1], strict=True))


SMALL = negatives.Mining(part_anchors=4, part_bytes=8 * 8 * 20, least_pivots=6, most_pivots=12)


def clustered(n: int, seed: int) -> list[tuple]:
    """Rows around a few far centres; a third of them are one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 3
    x = centres[rng.integers(6, size=n)] + rng.normal(size=(n, 8)) * 0.2
    x[: n // 3] = x[0]
    return [(int(i) * 2, [float(v) for v in np.float32(row)], int(rng.integers(4))) for i, row in enumerate(x)]


@pytest.mark.parametrize("seed", [1, 2])
def test_small_parts_and_hot_vectors(spark, seed):
    rows = clustered(400, seed)
    table = common.materialize(spark.createDataFrame(rows, "vec_id long, vector array<float>, label int"), "rows")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    wanted = sorted(brute.hard_negatives(rows))
    for mining in (SMALL, replace(SMALL, least_pivots=1, most_pivots=1)):
        found = negatives.hard_negatives(table.select(F.col("vec_id").alias("id"), label.alias("label"), "vector", (F.col("vec_id") % 50 == 0).alias("anchor")), mining)
        assert sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == wanted


def test_bounds_leave_far_rows_out(spark):
    rows = common.materialize(negatives.usable(common.materialize(spark.createDataFrame([(a, v, b, a % 10 == 0) for a, v, b in clustered(600, 3)], "id long, vector array<float>, label long, anchor boolean"), "rows")), "vectors")
    where = negatives.space(rows, SMALL)
    placed = negatives.in_cells(rows, where, False)
    anchors = negatives.in_cells(rows.filter("anchor"), where, True).withColumns({"group": F.col("cell"), "reach": F.lit(400.0).cast("double"), "near": F.lit(0.0).cast("double")})
    groups = negatives.Groups.of(anchors, False)
    assert 0 < negatives.sent(placed, groups, where).count() < 0.5 * len(groups.group) * 600


def test_scores_of_large_components_are_exact():
    anchors = pa.table({"row": [0], "id": [0], "label": [1], "vec": [[2**29 + 1, 3]], "low": pa.array([[None]], pa.list_(pa.int64())), "high": pa.array([[None]], pa.list_(pa.int64()))})
    rows = pa.table({"row": [1, 2, 3], "id": [1, 2, 3], "label": [1, 1, 1], "vec": [[2**29 + 3, 1], [2**29 + 3, 2], [2**29 + 3, 0]]})
    got = negatives.best(anchors, rows, 2, 2, True)
    assert got["found"].to_pylist() == [2, 1] and got["score"].to_pylist() == [(2**29 + 1) * (2**29 + 3) + 6, (2**29 + 1) * (2**29 + 3) + 3]

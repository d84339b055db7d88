"""The stages one by one, each on what the stage before kept."""

from __future__ import annotations

import re

import brute
import pyarrow.parquet as pq
import public_tokenizers

import corpus_pipeline
from tidemark.llm import common, quality
from tidemark.llm.pii import find_spans, redact


def staged(spark, sf_dir):
    docs, out = common.table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialize(stage(spark, docs, sf_dir), f"test{i}")
        out.append([r.asDict() for r in docs.collect()])
    return out


def as_rows(found):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in found]


def order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r[:2]])


def test_stages(spark, sf_dir, rows):
    kept, single, clean, hidden, packed = staged(spark, sf_dir)
    # quality: what the counted rules fail is gone, and little else
    failed = {(r[0], r[1]) for r, q in zip(rows, brute.quality(rows), strict=True) if q[-1]}
    assert not failed & {(r["doc_id"], r["text"]) for r in kept}
    assert len(kept) >= 0.9 * (len(rows) - len(failed))
    # Jaccard: one row of each component, the one with the least id
    before = as_rows(kept)
    of = brute.jaccard(before)
    least = {c for _, n, c in of if n}
    assert sorted(r["doc_id"] for r in single if r["doc_id"] is not None) == sorted(c for c in least if c is not None)
    # decontamination: documents that hold an item word for word are gone, others stay
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [plain(t) for t in pq.read_table(f"{sf_dir}/benchmark.parquet")["text"].to_pylist()]
    holds = [any(i in plain(r["text"]) for i in items) for r in single]
    assert order(as_rows(clean)) == order([r for r, h in zip(as_rows(single), holds, strict=True) if not h])
    # personal data: the same rows with spans replaced
    assert order(as_rows(hidden)) == order([(a, None if t is None else redact(t, find_spans(t)), c, d) for a, t, c, d in as_rows(clean)])
    assert all(r["n_chars"] == len(r["text"]) for r in hidden)
    assert set(hidden[0]) == set(kept[0])
    # packing: all tokens, each once
    ids = brute.library_ids(public_tokenizers.path("byte_bpe_50k.json"), [r["text"] or "" for r in hidden])
    assert sum(r["length"] for r in packed) == sum(len(x) + 1 for x in ids)


def test_run_is_its_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() == len(staged(spark, sf_dir)[-1])


def test_an_empty_table_gives_an_empty_one(spark, empty_dir):
    for (name, _), rows in zip(corpus_pipeline.STAGES, staged(spark, empty_dir), strict=True):
        assert rows == [], name


def test_components_of_chains_and_of_nothing(spark):
    from tidemark.llm.components import components

    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (103, 103)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    good = " ".join(f"word{i} of the long story" for i in range(60))
    docs = spark.createDataFrame([(1, good, "en"), (1, "too short", "en"), (None, good + " more", "en"), (None, "short", "en")], "doc_id long, text string, lang string")
    assert sorted(r["text"] for r in quality.keep_good(docs).collect()) == [good, good + " more"]
    from tidemark.llm.jaccard import keep_one

    twice = common.materialize(spark.createDataFrame([(1, good), (1, good), (None, good), (2, ""), (3, "")], "doc_id long, text string"), "rows")
    assert sorted((r["doc_id"], r["text"]) for r in keep_one(twice).collect()) == [(1, good), (2, ""), (3, "")]

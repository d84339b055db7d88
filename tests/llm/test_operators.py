"""Each registered query against a plain version, on whole tables with awkward rows."""

from __future__ import annotations

from collections import Counter, defaultdict

import brute
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from tidemark.llm import licenses, oracle_sql, packing, queries

QUERIES = queries()


def collected(spark, name: str, sf_dir: str, columns: str) -> list[tuple]:
    return [tuple(r) for r in QUERIES[name](spark, sf_dir).select(*columns.split()).collect()]


def same(got: list[tuple], wanted: list[tuple]) -> None:
    key = lambda r: [(x is not None, x) for x in r]
    assert len(got) == len(wanted)
    odd = [(a, b) for a, b in zip(sorted(got, key=key), sorted(wanted, key=key), strict=True) if a != b]
    assert not odd, odd[:5]


def test_token_files(spark, sf_dir, rows):
    # rows with equal ids, nulls included, may stand in any order
    got = collected(spark, "op1_token_files", sf_dir, "doc_id start n_tokens ids_crc32")
    wanted = brute.token_files(rows, public_tokenizers.path("byte_bpe_50k.json"))
    same([(a, c, d) for a, _, c, d in got], [(a, c, d) for a, _, c, d in wanted])
    same([r for r in got if r[0] is not None], [r for r in wanted if r[0] is not None])


def test_substring_dedup(spark, sf_dir, rows):
    same(collected(spark, "op2_substring_dedup", sf_dir, "doc_id n_words n_removed kept_sha256"), brute.substrings(rows))


def test_license_scans(spark, sf_dir, rows):
    same(collected(spark, "op3_license_scans", sf_dir, "doc_id n_words n_base first_word last_word base_labels"), brute.licenses(rows))
    wanted = []
    for r, base in zip(rows, brute.licenses(rows), strict=True):
        spans = brute.license_spans(r[1], licenses.TEMPLATES)
        labels = sorted({*filter(None, base[-1].split(",")), *(s[0] for s in spans)})
        wanted.append((r[0], ",".join(labels), 1.0 if base[2] else max((s[3] for s in spans), default=0.0)))
    same(collected(spark, "op3_license_scans", sf_dir, "doc_id labels score"), wanted)


def test_token_counts(spark, sf_dir, rows):
    same(collected(spark, "op4_token_counts", sf_dir, "doc_id n_bytes n_tokens over_limit"), brute.token_counts(rows, public_tokenizers.path("piece_bpe_32k.model")))


def test_sharding(spark, sf_dir, rows):
    got = collected(spark, "op5_sharding", sf_dir, "doc_id size text_crc32 law shard slot grown_shard")
    import zlib

    same([r[:3] for r in got], [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows])
    slots, of_key = defaultdict(list), defaultdict(set)
    for key, _, _, law, shard, slot, grown in got:
        slots[shard].append(slot)
        of_key[key].add((shard, grown))
        assert law == "key" and 0 <= shard < 16 and grown in (shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_key.values())


def test_ngram_jaccard_join(spark, sf_dir, rows):
    same(collected(spark, "op6_ngram_jaccard_join", sf_dir, "doc_id n_shingles component_id"), brute.jaccard(rows))


def test_quality_rules(spark, sf_dir, rows):
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed"
    same(collected(spark, "op7_quality_rules", sf_dir, columns), brute.quality(rows))
    # the language model: a plain one over the same texts
    got = collected(spark, "op7_quality_rules", sf_dir, "doc_id n_words perplexity")
    wanted = [(r[0], q[1], p) for r, q, p in zip(rows, brute.quality(rows), brute.perplexities(rows), strict=True)]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert [r[:2] for r in sorted(got, key=order)] == [r[:2] for r in sorted(wanted, key=order)]
    assert all(abs(a[2] - b[2]) < 1e-4 * b[2] for a, b in zip(sorted(got, key=order), sorted(wanted, key=order), strict=True))
    verdicts = collected(spark, "op7_quality_rules", sf_dir, "base_failed kept")
    assert not any(failed and kept for failed, kept in verdicts)
    sound = [kept for failed, kept in verdicts if not failed]
    assert sum(sound) >= 0.9 * len(sound)


def test_pii(spark, sf_dir, rows):
    same(collected(spark, "op9_pii", sf_dir, "doc_id n_email n_ip n_card n_phone base_sha256"), brute.pii(rows))


def test_every_span_of_personal_data(spark, sf_dir, rows):
    got = {r[0]: r[1] for r in collected(spark, "op9_pii", sf_dir, "doc_id spans")}
    for r in rows:
        if r[0] is not None:
            spans = [s.rsplit(":", 2) for s in got[r[0]].split(",") if s]
            assert [(k, int(a), int(b)) for k, a, b in spans if k in ("url", "secret")] == brute.added_pii(r[1] or ""), r[0]


def test_packing(spark, sf_dir, rows):
    got = collected(spark, "op10_packing", sf_dir, "doc_id piece start length ids_crc32 sequence_id offset")
    ids = brute.library_ids(public_tokenizers.path("byte_bpe_50k.json"), [r[1] or "" for r in rows])
    wanted = []
    for r, own in zip(rows, ids, strict=True):
        own = [*own, 2]
        n = -(-len(own) // 1024)
        ends = [len(own) - 1024 * (n - 1 - i) for i in range(n)]
        wanted += [(r[0], i, a, b - a, brute.crc(own[a:b])) for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
    same([r[:5] for r in got], wanted)
    of = defaultdict(list)
    for *_, length, _, sequence, offset in got:
        of[sequence].append((offset, length))
    for held in of.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    fewest = -(-sum(r[3] for r in got) // 1024)
    assert len(of) <= 1.02 * fewest + 2
    # the long sequences keep all three capacities, and need more than tokens alone would
    held = defaultdict(list)
    for length, sequence, offset in collected(spark, "op10_packing", sf_dir, "length long_sequence_id long_offset"):
        held[sequence].append((offset, length))
    for x in held.values():
        assert [a for a, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))]
        assert sum(n for _, n in x) <= 2048 and len(x) <= 12 and sum(n * n for _, n in x) <= 3 * 1024 * 1024 // 2
    alone = packing.plan(Counter(r[3] for r in got), packing.Capacity(tokens=2048, documents=2048, attention=2048 * 2048))
    assert sum(p.count for p in alone) < len(held)


def test_collocations(spark, sf_dir, rows):
    same(collected(spark, "op11_collocations", sf_dir, "lang rank phrase a l r n score"), brute.collocations(rows))


def test_fingerprints(spark, sf_dir, rows):
    got = QUERIES["op12_fingerprints"](spark, sf_dir).collect()
    wanted = brute.fingerprints(rows)
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], [(*r[:3], round(r[3], 9), round(r[4], 9)) for r in wanted])
    spelled = lambda f: "=" if len(f) == 1 else f"{f[0]}:{'.'.join(sorted(f[1]))}/{'.'.join(sorted(f[2]))}"
    seen = lambda f: f[:1] if f[0] == "=" else f
    same([(r["doc_id"], r["n_chars"], seen(r["fingerprint"]), seen(r["edited_fingerprint"])) for r in got], [(r[0], r[1], spelled(r[5]), spelled(r[6])) for r in wanted])


def test_hard_negatives(spark, sf_dir, vectors):
    columns = "anchor_id positive_id rank negative_id positive_score negative_score"
    same(collected(spark, "op13_hard_negatives", sf_dir, columns), brute.hard_negatives(vectors))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    """The whole table of the driver against the query's SQL."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    answer = db.execute(oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    found = QUERIES[name](spark, folder)
    assert sorted(found.columns) == sorted(columns)
    same([tuple(r) for r in found.select(*columns).collect()], answer.fetchall())


def test_benchmark_decontamination(spark, sf_dir, rows):
    """The whole table: each item that stands in a text word for word is found, and each found item is covered in order by a plain alignment."""
    items = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pydict()
    words = {i: brute.folded(t or "") for i, t in zip(items["item_id"], items["text"], strict=True)}
    got = collected(spark, "op8_benchmark_decontamination", sf_dir, "doc_id item_ids")
    found = {(d, int(i)) for d, ids in got for i in ids.split(",")}
    texts = {r[0]: brute.folded(r[1] or "") for r in rows if r[0] is not None}
    literal = {(d, i) for d, t in texts.items() for i, w in words.items() if w and brute.stands_in(w, t)}
    assert literal <= found
    for d, i in found:
        assert brute.covered(words[i], texts[d]) >= 0.5 * len(words[i]), (d, i)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []

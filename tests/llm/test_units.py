"""Parts of the operators by themselves: scalings, splits, counted plans and planted cases."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tidemark.llm import common, contamination, encoder, licenses, packing, pii, quality, sharding, substrings, textkit, token_counts, token_files


def odd_texts(n: int, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", ".", "é", "日", "▁", "7", "'s", "<|endoftext|>", "the", "ing", " ", "\x00", "😀"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(n)]


def test_encoder_equals_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*odd_texts(600), "", " ", "\n", "a" * 5000]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    ids, offsets = encoder.Encoder.of(path).encode(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_equals_library_at_symbols_and_line_feeds():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool, rng = encoder.Encoder(path), random.Random(11)
    alphabet = ["the", "It", "7", "é", "日", "'", "'s", "'re", ",", ".", "...", "-", "\"", "@", "://", "_", "\x00", "\x7f", "…", "×"]
    texts = ["".join(rng.choice(["", "", " ", "\n"]) + rng.choice(alphabet) for _ in range(rng.randrange(1, 30))).strip() for _ in range(3000)]
    texts += ["it's", "'s", "a'sb,", "don't.", "x'", "'", "\n", "a\n.b", "I'LL 'tis", "a'", "1,000.5", "<|endoftext|>", "a\u0120b \u010a"]
    for end_id in (None, 2):
        ids, offsets = tool.encode(pa.array(["cut off", *texts], pa.large_string())[1:], end_id)
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == tool.library.encode(t, add_special_tokens=False).ids + [end_id] * (end_id is not None), repr(t)


def test_encoder_learns_a_word_once_whatever_symbols_stand_by_it():
    tool = encoder.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"quor{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    text = " ".join(f"{w} {w}, {w}. ({w}) \"{w}\" {w}!\n{w}; {w}?" for w in words)
    ids, _ = tool.encode(pa.array([text], pa.large_string()))
    assert ids.tolist() == tool.library.encode(text, add_special_tokens=False).ids
    # with and without a space in front, and a few pieces of symbols
    assert len(tool.place) < 2 * len(words) + 20


def test_small_batches_are_joined():
    batches = [pa.record_batch([pa.array([i]), pa.array(["x" * 100])], names=["doc_id", "text"]) for i in range(20)]
    got = list(common.joined(iter([*batches, pa.record_batch([pa.array([20]), pa.array(["y" * 5000])], names=["doc_id", "text"])]), limit=1100))
    assert [b.num_rows for b in got] == [10, 10, 1]
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(21))


def test_transducer_equals_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    machine = token_counts.Transducer.of(path)
    assert machine.usable
    texts = [*odd_texts(600, 3), "", " ", "  x", "x  ", "a" * 3000]
    got = token_counts.count_batch(pa.array(texts, pa.large_string()), machine)
    assert got.tolist() == [len(machine.library.encode(t)) for t in texts]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 50])
def test_chunk_maps_compose(chunk):
    machine = token_counts.Transducer.of(public_tokenizers.path("piece_bpe_32k.model"))
    for t in ["the quick  brown   fox", " lead and trail ", "   ", "unbroken" * 9, "é 日本 x"]:
        assert token_counts.count_long(t, machine, chunk) == len(machine.library.encode(t)), (t, chunk)


@pytest.mark.parametrize(("chunk", "before"), [(1, 0), (7, 3), (300, 0), (300, 64), (5000, 64)])
def test_state_maps_of_unbroken_texts_compose(monkeypatch, chunk, before):
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(token_counts, "BEFORE", before)
    machine = token_counts.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    size = 20 * chunk if chunk < 300 else 12_000
    for alphabet in ("a", "ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz0123456789", "aé日😀"):
        text = "".join(rng.choices(alphabet, k=size))
        assert machine._count(token_counts.MARK + text) == len(machine.library.encode(text)), (alphabet, chunk)


def test_an_unbroken_text_of_a_million_characters():
    machine = token_counts.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    text = "".join(random.Random(8).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    assert token_counts.count_batch(pa.array([text], pa.large_string()), machine).tolist() == [len(machine.library.encode(text))]


def test_every_long_passage_holds_an_anchor():
    rng = random.Random(1)
    words = textkit.split_words(pa.array([" ".join(rng.choices("abcdefgh", k=500))], pa.large_string()))
    _, at = substrings.anchors(words, words.hashes(), 35)
    held = set(at.tolist())
    assert all(any(i <= a <= i + 35 - substrings.SEED for a in held) for i in range(500 - 35 + 1))


def test_joined_seeds_give_what_broadcast_ones_do(spark, sf_dir, monkeypatch):
    docs = common.table(spark, sf_dir, "documents")
    few = sorted(map(tuple, substrings.digest_kept(substrings.remove_repeats(docs)).collect()), key=str)
    monkeypatch.setattr(substrings, "MOST_SEEDS", 0)
    assert sorted(map(tuple, substrings.digest_kept(substrings.remove_repeats(docs)).collect()), key=str) == few


def test_new_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(4000).selectExpr("cast(id as string) as k")
    weights = [1.0, 2.0, 1.0]
    from pyspark.sql import functions as F

    rows = keys.select(sharding.rendezvous_shard(F.col("k"), weights).alias("a"), sharding.rendezvous_shard(F.col("k"), [*weights, 1.0]).alias("b")).collect()
    assert all(r["b"] in (r["a"], 3) for r in rows)
    n = Counter(r["a"] for r in rows)
    assert 1.7 < n[1] / n[0] < 2.3
    assert 0.15 < sum(r["b"] == 3 for r in rows) / len(rows) < 0.25


def test_packing_keeps_every_capacity():
    rng = random.Random(2)
    histogram = Counter(rng.randrange(1, 1025) for _ in range(3000))
    capacity = packing.Capacity(documents=5, attention=600_000)
    usable = {n: c for n, c in histogram.items() if n * n <= capacity.attention}
    patterns = packing.plan(usable, capacity)
    assert Counter(n for p in patterns for n in p.lengths for _ in range(p.count)) == Counter(usable)
    for p in patterns:
        assert sum(p.lengths) <= 1024 and len(p.lengths) <= 5 and sum(n * n for n in p.lengths) <= 600_000


def plain_best_fit(histogram, capacity) -> int:
    """Sequences that vector best fit needs, a piece at a time."""
    limits = (capacity.tokens, capacity.documents, capacity.attention)
    free: list[tuple[int, int, int]] = []
    for n in sorted(Counter(histogram).elements(), reverse=True):
        after = [(sum(w * ((r - c) / m) ** 2 for w, r, c, m in zip(capacity.weights, room, (n, 1, n * n), limits, strict=True)), i) for i, room in enumerate(free) if room[0] >= n and room[1] >= 1 and room[2] >= n * n]
        if not after:
            free.append(limits)
        i = min(after)[1] if after else len(free) - 1
        free[i] = (free[i][0] - n, free[i][1] - 1, free[i][2] - n * n)
    return len(free)


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(documents=5, attention=1_100_000)])
@pytest.mark.parametrize(("spread", "hot", "times"), [(0, 100, 5000), (600, 100, 300), (600, 200, 300), (300, 1, 3000)])
def test_packing_fills_sequences_with_a_hot_length(capacity, spread, hot, times):
    rng = random.Random(3)
    histogram = Counter(rng.randrange(1, 1025) for _ in range(spread))
    histogram[hot] += times
    patterns = packing.plan(histogram, capacity)
    assert Counter(n for p in patterns for n in p.lengths for _ in range(p.count)) == histogram
    assert all(sum(p.lengths) <= capacity.tokens and len(p.lengths) <= capacity.documents and sum(n * n for n in p.lengths) <= capacity.attention for p in patterns)
    assert sum(p.count for p in patterns) <= plain_best_fit(histogram, capacity)


def test_equal_pieces_of_a_sequence_have_places_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "a b c d e") for i in range(900)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    packed = packing.pack(common.prepare(spark).read.parquet(str(tmp_path / "docs")), vocabulary=public_tokenizers.path("byte_bpe_50k.json"), capacity=packing.Capacity(tokens=64)).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(900))
    places = [(r["sequence_id"], at) for r in packed for at in range(r["offset"], r["offset"] + r["length"])]
    assert len(set(places)) == len(places) and max(at for _, at in places) < 64
    assert len({s for s, _ in places}) == -(-len(places) // 64)


def test_token_files_are_read_selectively(spark, sf_dir):
    path = common.stage_path(spark, "tokens")
    token_files.write_token_files(common.table(spark, sf_dir, "documents"), path, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
    files = token_files.read_token_files(spark, path)
    plan = files.filter("doc_id = 5").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "EqualTo(doc_id,5)" in plan
    import pyarrow.parquet as pq
    from pathlib import Path

    meta = [pq.ParquetFile(p).metadata for p in Path(path).glob("*.parquet")]
    column = next(m.row_group(0).column(4) for m in meta if m.num_rows)
    assert any("DICT" in e for e in column.encodings) and column.has_offset_index
    for at in (0, 2, 3):
        column = next(m.row_group(0).column(at) for m in meta if m.num_rows)
        assert "DELTA_BINARY_PACKED" in column.encodings and not any("DICT" in e for e in column.encodings), column.path_in_schema


def test_many_rows_without_an_id_are_several_parts(spark, tmp_path):
    docs = common.materialize(spark.range(4000).selectExpr("cast(null as long) doc_id", "concat('text ', id % 7) text"), "docs")
    token_files.write_token_files(docs, str(tmp_path / "t"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
    sizes = [r["count"] for r in token_files.read_token_files(spark, str(tmp_path / "t")).groupBy("part").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 4 and max(sizes) < 2000


def canonical_pair(spark, item: str, text: str) -> list:
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    return contamination.find_items(common.with_rows(common.materialize(docs, "docs")), bench).collect()


ITEM = "A train leaves Boston at 40 km per hour and another leaves Denver at 60 km per hour; after how many hours do they meet if the cities are 500 km apart?"


def test_reparameterised_questions_are_found(spark):
    again = "Here is one. " + ITEM.replace("Boston", "Lyon").replace("Denver", "Turin").replace("40", "45").replace("60", "75").replace("500", "480") + " Good luck."
    (found,) = canonical_pair(spark, ITEM, again)
    assert found["item_id"] == 7 and not found["exact"]


def test_inconsistent_slots_are_left_alone(spark):
    item = "If Anna has 3 apples and Anna gives 3 apples to Ben then how many apples does Anna keep and how many has Ben got?"
    odd = item.replace("gives 3", "gives 4").replace("does Anna keep", "does Carl keep")
    assert canonical_pair(spark, item, "Well, " + odd) == []
    assert len(canonical_pair(spark, item, "Well, " + item)) == 1


def test_unrelated_text_is_left_alone(spark):
    assert canonical_pair(spark, ITEM, "The cities of the coast are apart by many hours, and the train was late again that day.") == []


MARBLES = "Tom has 5 marbles. Tom gives 2 marbles to Ann. How many does Tom have left?"
OTHER_MARBLES = "Bob has 7 marbles. Bob gives 3 marbles to Sue. How many does Bob have left?"


@pytest.mark.parametrize(
    ("item", "text", "held"),
    [
        (ITEM, ITEM.replace("another", "one more"), True),  # edited
        (ITEM, ITEM.replace("hours do", "hours will").replace("leaves Boston", "departs Boston"), True),
        (ITEM, ITEM.replace("per hour and", "per hour , as we know, and"), True),
        (ITEM, " ".join(ITEM.split()[3:-2]), True),  # partial
        (ITEM, " ".join(ITEM.split()[:16]), False),
        (MARBLES, OTHER_MARBLES, True),  # other names, at the start of sentences too
        (MARBLES, OTHER_MARBLES.lower(), True),
        (MARBLES, OTHER_MARBLES.upper(), True),
        (ITEM, ITEM.replace("Boston", "Lyon").replace("Denver", "Turin").lower(), True),
        (MARBLES, OTHER_MARBLES.replace("Bob gives 3", "Bob gives 7"), False),
        ("42", "we have sold 7 boats", False),  # a short item is found word for word alone
        ("42", "we have 12 and 42", True),
        ("12 and 42", "we have 12 and 42", True),
        ("12 and 42", "we have 13 and 43", False),
        ("How many apples?", "asked how many apples?", True),
        (MARBLES, "Bob has 7 cats. They came to Sue in May. How many does he feed now?", False),
    ],
)
@pytest.mark.parametrize("most", [contamination.MOST_WINDOWS, 0])
def test_altered_copies_of_items(spark, monkeypatch, item, text, held, most):
    monkeypatch.setattr(contamination, "MOST_WINDOWS", most)
    around = "It was said before, and nobody minded. " * 30
    assert bool(canonical_pair(spark, item, around + text + " " + around)) == held


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("mail me@x.org.", ["email"]),
        ("@nobody", []),
        ("see https://a.org/x?y=1.", ["url"]),
        ("api_key = 'abcdEFGH12345678abcd'", ["secret"]),
        ("IBAN DE89 3704 0044 0532 0130 00", ["iban"]),
        ("IBAN DE88 3704 0044 0532 0130 00", []),
        ("1.2.3.256 1.2.3.4", ["ip"]),
        ("1" * 50_000, []),
        ("HTTP://a.org", ["url"]),
        ("ApI_kEy: abcdefghijklmnop1", ["secret"]),
        ("http://" * 100_000, ["url"]),
    ],
)
def test_personal_data(text, kinds):
    assert [k for k, _, _ in pii.find_spans(text) if k != "card"] == kinds


def test_redaction_joins_overlapping_spans():
    assert pii.redact("abcdef", [("url", 0, 4), ("email", 2, 5)]) == "<URL>f"


def test_a_model_that_is_joined_gives_what_a_broadcast_one_does(spark, sf_dir, monkeypatch):
    docs = common.table(spark, sf_dir, "documents")
    few = sorted(map(tuple, quality.judge(docs).collect()), key=str)
    monkeypatch.setattr(quality, "MOST_GRAMS", 0)
    monkeypatch.setattr(quality, "BLOCK_BITS", 3)
    assert sorted(map(tuple, quality.judge(docs).collect()), key=str) == few


def test_many_languages_and_counts_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(quality, "HELD_GRAMS", 50)
    docs = common.materialize(spark.createDataFrame([(i, f"text {i} in a tongue of its own " * 3, f"l{i % 40}") for i in range(200)], "doc_id long, text string, lang string"), "docs")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    import brute

    wanted = {r[0]: p for r, p in zip(rows, brute.perplexities(rows), strict=True)}
    got = quality.judge(docs).select("doc_id", "perplexity").collect()
    assert len(got) == 200 and all(abs(r["perplexity"] - wanted[r["doc_id"]]) < 1e-4 * wanted[r["doc_id"]] for r in got)


def test_gibberish_is_rejected_and_clean_documents_stay(spark):
    rng = random.Random(11)
    words = "the small harbour town kept its lamps lit through a long winter and every boat that came home late found quay by their glow".split()
    clean = [(i, " ".join(rng.choices(words, k=rng.choice([22, 60, 200]))), "en") for i in range(400)]
    letters = "abcdefghijklmnopqrstuvwxyz0123456789#%&"
    noise = [(1000 + i, " ".join("".join(rng.choices(letters, k=6)) for _ in range(rng.choice([22, 60, 200]))), "en") for i in range(12)]
    docs = common.materialize(spark.createDataFrame([*clean, *noise], "doc_id long, text string, lang string"), "docs")
    kept = {r["doc_id"] for r in quality.keep_good(docs).select("doc_id").collect()}
    assert not kept & {r[0] for r in noise}
    failed = {r[0] for r, q in zip(clean, __import__("brute").quality(clean), strict=True) if q[-1]}
    assert len(kept) >= 0.98 * (400 - len(failed))


@pytest.mark.parametrize("files", [common.MOST_FILES, 0])
def test_rows_are_the_same_in_every_job(spark, tmp_path, monkeypatch, files):
    """What is read with other cores, and so in other tasks, loses the right rows."""
    monkeypatch.setattr(common, "MOST_FILES", files)
    spark.range(3000).selectExpr("id doc_id", "cast(id as string) text").repartition(12).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    key = "spark.sql.leafNodeDefaultParallelism"
    try:
        spark.conf.set(key, "16")
        gone = common.materialize(common.with_rows(docs).filter("doc_id % 10 = 0").select("row"), "gone")
        spark.conf.set(key, "4")
        left = common.without_rows(spark.read.parquet(str(tmp_path / "docs")), gone)
        assert sorted(r[0] for r in left.select("doc_id").collect()) == [i for i in range(3000) if i % 10]
    finally:
        spark.conf.unset(key)
    assert common.with_rows(docs.selectExpr("explode(array(1, 2)) x")).select("row").distinct().count() == 6000


def test_long_unlike_words_have_unlike_hashes():
    one, other = "a", "b"
    for _ in range(13):
        one, other = one + other, other + one
        words = textkit.split_words(pa.array([f"{one} {other}"], pa.large_string()))
        for lane in (0, 1):
            assert len(set(words.hashes(lane).tolist())) == 2
    values = textkit.mix(np.arange(2, dtype=np.uint64))
    order = [0]
    for _ in range(6):
        order += [1 - x for x in order]
    run = values[order + [1 - x for x in order]]
    assert textkit.runs(run, 64)[0] != textkit.runs(run, 64)[64]


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "TRANSITIONS", 500)
    monkeypatch.setattr(encoder, "REMEMBER_BYTES", 1000)
    machine = token_counts.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghij", k=20_000))
    assert token_counts.count_batch(pa.array([text], pa.large_string()), machine).tolist() == [len(machine.library.encode(text))]
    assert len(machine.states) <= 502 and not any(len(s) > token_counts.LONGEST for s in machine.segments)
    tool = encoder.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for part in range(3):
        tool.encode(pa.array([f"piece{i} of part{part}" for i in range(100)], pa.large_string()))
    assert len(tool.place) < 300
    forgotten = []
    common.remember(machine, lambda: forgotten.append(1))
    common.remember(None)
    assert forgotten == [1]


def test_empty_slices():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 10, ""])], names=["text"])
    assert [b.num_rows for b in common.slices([batch], limit=12)] == [2, 2]


def test_similar_documents_do_not_depend_on_the_layout(spark):
    from tidemark.llm.jaccard import join_similar

    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    laid = [common.materialize(docs.repartition(n, "doc_id"), "layout") for n in (3, 11)]
    a, b = (dict(join_similar(x).select("doc_id", "component_id").collect()) for x in laid)
    assert a == b


@pytest.mark.parametrize("label", ["mit", "isc", "apache-2.0"])
@pytest.mark.parametrize("change", ["4", "10", "30", "twice", "out", "both"])
def test_licences_with_words_put_in_or_left_out(spark, label, change):
    words = licenses.TEXTS[label].split()
    put = lambda n: [f"zz{i}" for i in range(n)]
    at = len(words) // 2
    text = {
        "4": [*words[:at], *put(4), *words[at:]],
        "10": [*words[:at], *put(10), *words[at:]],
        "30": [*words[:at], *put(30), *words[at:]],
        "twice": [*words[: at - 10], *put(5), *words[at - 10 :], "and", "again", *words[: at + 7], *put(6), *words[at + 7 :]],
        "out": [*words[: at - 9], *words[at + 9 :]],
        "both": [*words[:20], *put(4), *words[20 : at - 4], *words[at + 4 :]],
    }[change]
    docs = spark.createDataFrame([(1, " ".join(["Notes", "first.", *text, "The", "end."])), (2, " ".join(sorted(set(words)))), (3, " ".join(put(200)))], "doc_id long, text string")
    digest, spans = licenses.scan_licenses(docs)
    found = {r["doc_id"]: r["labels"] for r in digest.collect()}
    assert label in found[1].split(",") and label not in found[2].split(",") and found[3] == ""
    assert len([r for r in spans.collect() if r["label"] == label and r["end"] - r["start"] > 24]) == (2 if change == "twice" else 1)


def test_words_are_read_in_arrays_as_one_by_one(monkeypatch):
    import random

    draw = random.Random(1)
    letters = "aZbÉßİıΣς日.!?:…'\"5$€%,-+kKªºŉ\x00"
    words = sorted({"".join(draw.choice(letters) for _ in range(draw.randrange(1, 9))) for _ in range(5000)} | {"3", "km", "€4.50", "Paris", "McX", "«»"})
    low, kind, first = contamination._words_looked_at(pa.array(words, pa.large_string()))
    assert list(zip(low.to_pylist(), kind.tolist(), first.tolist(), strict=True)) == [contamination._looked_at(w) for w in words]
    one_by_one = []
    monkeypatch.setattr(contamination, "_looked_at", one_by_one.append)
    text = contamination.read_all(pa.array(["Élan vital at 3 km. Then Bob a B, ... went ", "", " \n"], pa.large_string()))
    assert not one_by_one and [len(t.value) for t in text] == [10, 0, 0]
    assert text[0].kind.tolist() == [contamination.FIRST, 0, 0, contamination.NUMBER, contamination.UNIT, contamination.FIRST, contamination.NAME, *[contamination.WORD] * 3]

"""Quality rules: counted rules and bands of n-gram perplexity per language.

The language model is a modified Kneser-Ney model of five code points, one per language, counted by Spark over the whole texts of all
documents. Nothing is folded, so every script keeps its letters, and what is counted grows with the corpus. Each task counts its own
distinct n-grams before they are shuffled; the lower orders, discounts, contexts and interpolation are joins and groupings on the n-grams.
The model is kept as a sorted array of n-gram hashes with their log probabilities. As it is counted over the documents that it scores,
each of their n-grams is in it.

Scoring. While the model has at most ``MOST_GRAMS`` n-grams, the array is broadcast. With more, each block of rows asks for the n-grams
that it holds, once each; they are joined to the model by hash, and the answers meet the block's texts in one more shuffle. Both ways
give the same figures, and there is no limit on languages or n-grams.

Bands. A document's figure is the mean log perplexity of its characters. Over the documents that pass the counted rules, by language:
the middle is the median, and the spread is the median deviation from it among documents of like size (powers of two of their characters),
as short texts vary more; a size with few documents takes the spread of the next size that has enough, larger for shorter texts by the
root of the lengths. What lies more than ``width`` spreads above or below the middle is rejected. Spreads under ``least_deviation`` count
as that, so a uniform corpus rejects nothing for tiny differences.

Defined results: a null text has no words and fails; texts of a null language share a model under the empty name; other columns are not
read; repeated rows get a result each; an empty table gives no rows. Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common, textkit

ORDER = 5
#: N-grams of a model that is broadcast, at most (12 bytes each).
MOST_GRAMS = 4_000_000
#: N-grams that a task holds, slice by slice, before it sums them (about 40 bytes each); more than half as many sums are sent.
HELD_GRAMS = 800_000
#: Rows of a file that ask for their n-grams together, as a power of two.
BLOCK_BITS = 14
#: Documents that a size needs for a spread of its own.
LEAST_DOCUMENTS = 30


@dataclass(frozen=True)
class Rules:
    """The limits: fewest words, percent of words in repeated windows, and the band."""

    least_words: int = 20
    most_repeated_percent: int = 30
    window: int = 8
    width: float = 8.0
    least_deviation: float = 0.02


@dataclass
class Grams:
    """The n-gram that ends at each character of several texts. ``code`` tells them apart by language; ``text_start`` has one entry more than texts."""

    points: np.ndarray
    at: np.ndarray
    code: np.ndarray
    text_start: np.ndarray
    salts: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each character the number of its n-gram; for each different n-gram a text that has it, its code points, and the hash of language and n-gram."""
        number, own = pd.factorize(self.code)
        first = np.empty(len(own), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        text = np.searchsorted(self.text_start, first, "right") - 1
        points = self.points[self.at[first][:, None] + np.arange(ORDER)]
        return number, text, points, _key(list(points.T), self.salts[text] if len(own) else np.zeros(0, np.uint64))


def _salts(langs: list[str]) -> np.ndarray:
    words = textkit.split_words(pa.array([x.encode().hex() or "-" for x in langs], pa.large_string()))
    return words.hashes(1)


def _key(columns: list[np.ndarray], salt: np.ndarray) -> np.ndarray:
    key = salt
    for c in columns:
        key = textkit.join(key, c.astype(np.uint64))
    return key


def grams(texts: list[str], langs: list[str]) -> Grams:
    """Before a text stand line feeds, so that its first characters have n-grams too."""
    points = np.frombuffer("".join("\n" * (ORDER - 1) + t for t in texts).encode("utf-32-le"), "<u4")
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(start[-1]) + np.repeat(np.arange(len(texts)) * (ORDER - 1), size)
    tongues = {x: i for i, x in enumerate(dict.fromkeys(langs))}
    of = np.array([tongues[x] for x in langs], np.int64)
    # the characters of these texts are few, so that an n-gram is a number
    there = np.zeros(int(points.max(initial=0)) + 1, bool)
    there[points] = True
    few = (np.cumsum(there, dtype=np.uint32) - 1).astype(np.uint64)[points]
    bits = int(there.sum()).bit_length()
    packs = ORDER * bits + len(tongues).bit_length() <= 64
    n = max(len(few) - ORDER + 1, 0)
    code = few[:n]
    for i in range(1, ORDER):
        code = code << np.uint64(bits) | few[i : n + i] if packs else textkit.join(code, few[i : n + i])
    tongue = np.repeat(of, size).astype(np.uint64)
    code = code[at] | tongue << np.uint64(ORDER * bits) if packs else textkit.join(code[at], tongue)
    return Grams(points, at, code, start, _salts(list(tongues))[of] if len(texts) else np.zeros(0, np.uint64))


@dataclass
class Counted:
    """Distinct n-grams with their hashes, counts, code points and languages."""

    key: np.ndarray
    n: np.ndarray
    points: np.ndarray
    lang: np.ndarray


def summed(parts: list[Counted]) -> Counted:
    key = np.concatenate([p.key for p in parts])
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(np.concatenate([p.n for p in parts])[order], first) if len(key) else np.zeros(0, np.int64)
    one = order[first]
    return Counted(key[first], n, np.concatenate([p.points for p in parts])[one], np.concatenate([p.lang for p in parts])[one])


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all n-grams of the highest order; each task sums its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tongues: dict[str, int] = {}
        waiting: list[Counted] = []
        held = 0

        def out(total: Counted) -> Iterator[pa.RecordBatch]:
            names = pa.array(list(tongues), pa.string())
            for i in range(0, len(total.n), 1 << 16):
                spelled = total.points[i : i + (1 << 16)].astype("<u4").tobytes().decode("utf-32-le")
                part = [spelled[j : j + ORDER] for j in range(0, len(spelled), ORDER)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(total.lang[i : i + (1 << 16)])), pa.array(part, pa.string()), pa.array(total.n[i : i + (1 << 16)])], names=["lang", "gram", "n"])

        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            langs = pc.fill_null(batch.column(1), "").to_pylist()
            number, text, points, key = grams([t or "" for t in batch.column(0).to_pylist()], langs).distinct()
            of = np.array([tongues.setdefault(x, len(tongues)) for x in langs], np.int32)
            waiting.append(Counted(key, np.bincount(number, minlength=len(key)), points, of[text]))
            held += len(key)
            if held > HELD_GRAMS:
                waiting = [summed(waiting)]
                held = len(waiting[0].n)
                if 2 * held > HELD_GRAMS:
                    yield from out(waiting[0])
                    waiting, held = [], 0
        if waiting:
            yield from out(summed(waiting))

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, gram, p): the interpolated probability of the last character of each n-gram of the highest order after the others.

    The highest order uses counts, each lower order the number of different characters in front. The three discounts are estimated by
    order and language from the numbers of n-grams seen once to four times. Below one character, all that the language has are alike.
    """
    levels, of = {ORDER: counts}, counts
    for length in range(ORDER - 1, 0, -1):
        of = of.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[length] = of = common.materialize(of, f"grams{length}")
    lower = None
    for length in range(1, ORDER + 1):
        weighted = _discounted(levels[length], length)
        own, weight = (F.col("n") - F.col("d")) / F.col("total"), F.col("kept") / F.col("total")
        if lower is None:
            lower = weighted.select("lang", "gram", (own + weight / F.col("all")).alias("p"))
        else:
            below = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("below"))
            joined = weighted.withColumn("tail", F.expr("substring(gram, 2)")).join(below, ["lang", "tail"])
            lower = joined.select("lang", "gram", (own + weight * F.col("below")).alias("p"))
    return lower


def _discounted(rows: DataFrame, length: int) -> DataFrame:
    """Rows with their discount ``d``, the ``total`` of their context and its sum ``kept`` of discounts, and ``all`` n-grams of the language."""
    seen = rows.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in range(1, 5)], F.count(F.lit(1)).alias("all"))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k: int, fallback: float) -> Column:
        value = F.lit(float(k)) - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}"))
        usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{k}") > 0) & (value > 0) & (value < k)
        return F.when(usable, value).otherwise(F.lit(fallback))

    limits = seen.select("lang", "all", discount(1, 0.5).alias("d1"), discount(2, 0.75).alias("d2"), discount(3, 0.9).alias("d3"))
    limits = common.materialize(limits, f"discounts{length}")
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    # a context has at most as many rows as there are characters
    context = Window.partitionBy("lang", F.expr(f"substring(gram, 1, {length - 1})"))
    return rows.join(limits, "lang").withColumn("d", d).withColumn("total", F.sum("n").over(context)).withColumn("kept", F.sum("d").over(context))


def hashed(model: DataFrame) -> DataFrame:
    """(key, surprise): the hash of each n-gram with its negative log probability, sorted within parts by hash."""

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "gram"):
            points = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, ORDER)
            lang = batch.column(0).dictionary_encode()
            salt = _salts(lang.dictionary.to_pylist())[np.asarray(lang.indices)]
            yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(_key(list(points.T), salt))), pa.array(-np.log(np.asarray(batch.column(2))).astype(np.float32))], names=["key", "surprise"])

    return model.select("lang", "gram", "p").mapInArrow(hash_, "key long, surprise float").repartition(common.partitions(model.sparkSession), "key").sortWithinPartitions("key")


_SCORED = "row long, doc_id long, lang string, n_chars long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, surprise double"


def _score(rows: list, text: pa.Array, langs: list[str], key: np.ndarray, surprise: np.ndarray, rules: Rules) -> pa.RecordBatch:
    found = grams(text.to_pylist(), langs)
    number, _, _, own = found.distinct()
    value = surprise[np.searchsorted(key, textkit.signed(own))].astype(np.float64) if len(own) else np.zeros(0)
    size = np.diff(found.text_start)
    total = np.bincount(np.repeat(np.arange(len(size)), size), value[number], len(size)) if len(number) else np.zeros(len(size))
    counted = counted_rules(text, rules.window)
    return pa.RecordBatch.from_arrays([*rows, pa.array(langs, pa.string()), pa.array(size), *map(pa.array, counted), pa.array(total / np.maximum(size, 1))], names=[c.split()[0] for c in _SCORED.split(", ")])


def score_documents(docs: DataFrame, rules: Rules) -> DataFrame:
    """The counted values and the mean log perplexity of a character, with the row numbers, ids and languages of ``docs``."""
    spark = docs.sparkSession
    model = common.materialize(hashed(kneser_ney(common.materialize(ngram_counts(docs), "counts"))), "model")
    rows = common.with_rows(docs.select("doc_id", "lang", "text"))
    rows = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    if model.count() > MOST_GRAMS:
        return _score_by_blocks(rows, model, rules)
    table = model.toArrow()
    order = np.argsort(table["key"].to_numpy())
    shared = spark.sparkContext.broadcast((table["key"].to_numpy()[order], table["surprise"].to_numpy()[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            yield _score([batch.column(0), batch.column(1)], common.texts(batch), batch.column(2).to_pylist(), *shared.value, rules)

    return rows.mapInArrow(score, _SCORED)


def _score_by_blocks(rows: DataFrame, model: DataFrame, rules: Rules) -> DataFrame:
    rows = rows.withColumn("block", F.shiftright("row", BLOCK_BITS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct n-grams of each block that a task reads; the rows of a block follow one another."""
        block, held = None, np.zeros(0, np.uint64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.full(len(held), block or 0, np.int64)), pa.array(textkit.signed(held))], names=["block", "key"])
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            of = np.asarray(batch.column(0))
            ends = np.flatnonzero(np.diff(of)) + 1
            for part in np.split(np.arange(len(of)), ends):
                if of[part[0]] != block or len(held) > HELD_GRAMS:
                    yield out()
                    block, held = int(of[part[0]]), held[:0]
                some = batch.slice(int(part[0]), len(part))
                held = np.union1d(held, grams([t or "" for t in some.column(2).to_pylist()], some.column(1).to_pylist()).distinct()[3])
        yield out()

    asked = rows.select("block", "lang", "text").mapInArrow(ask, "block long, key long")
    none = F.lit(None)
    answers = asked.join(model, "key").select("block", F.lit(0).alias("kind"), "key", "surprise", none.cast("long").alias("row"), none.cast("long").alias("doc_id"), none.cast("string").alias("lang"), none.cast("string").alias("text"))
    asking = rows.select("block", F.lit(1).alias("kind"), none.cast("long").alias("key"), none.cast("float").alias("surprise"), "row", "doc_id", "lang", "text")
    met = answers.unionByName(asking).repartition(common.partitions(rows.sparkSession), "block").sortWithinPartitions("block", "kind", "key")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers come before the texts of their block."""
        block, keys, values = None, [], []
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            of, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for part in np.split(np.arange(len(of)), np.flatnonzero((np.diff(of) != 0) | (np.diff(kind) != 0)) + 1):
                some = batch.slice(int(part[0]), len(part))
                if of[part[0]] != block:
                    block, keys, values = int(of[part[0]]), [], []
                if kind[part[0]] == 0:
                    keys.append(some.column(2).to_numpy().copy())
                    values.append(some.column(3).to_numpy().copy())
                    continue
                if len(keys) != 1:
                    keys, values = [np.concatenate(keys or [np.zeros(0, np.int64)])], [np.concatenate(values or [np.zeros(0, np.float32)])]
                yield _score([some.column(4), some.column(5)], common.texts(some), some.column(6).to_pylist(), keys[0], values[0], rules)

    return met.select("block", "kind", "key", "surprise", "row", "doc_id", "lang", "text").mapInArrow(score, _SCORED)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80


def counted_rules(text: pa.Array, window: int = 8) -> tuple[np.ndarray, ...]:
    """Words, code points in words, symbols, repeated lines, and words in windows that the text has twice or more."""
    words = textkit.split_words(text)
    data, off = words.data, textkit.buffers(text)[1]
    n = len(off) - 1
    lead = np.concatenate([[0], np.cumsum(_LEADS[data])])
    of_word = words.text_of_word()
    chars = np.bincount(of_word, lead[words.end] - lead[words.start], n).astype(np.int64)
    symbols = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[data])])[off])
    repeated = np.zeros(n, np.int64)
    if len(words.start) >= window:
        h, at = textkit.windows(words, words.hashes(), window)
        seen = _seen_before_or_after(h, of_word[at])
        cover = np.zeros(len(words.start) + 1, np.int32)
        np.add.at(cover, at[seen], 1)
        np.add.at(cover, at[seen] + window, -1)
        repeated = np.bincount(of_word[np.cumsum(cover)[:-1] > 0], minlength=n)
    feed = np.zeros(256, bool)
    feed[10] = True
    lines = textkit.split_words(text, feed)  # runs without a line feed: lines that aren't empty
    dup = np.zeros(n, np.int64)
    if len(lines.start):
        with_word = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
        of_line, h = lines.text_of_word()[with_word], lines.hashes()[with_word]
        order = np.lexsort((h, of_line))
        same = (h[order][1:] == h[order][:-1]) & (of_line[order][1:] == of_line[order][:-1])
        dup = np.bincount(of_line[order][1:][same], minlength=n)
    return words.count.astype(np.int64), chars, symbols.astype(np.int64), dup.astype(np.int64), repeated.astype(np.int64)


def _seen_before_or_after(h: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether an equal value stands elsewhere in the same group."""
    key = textkit.mix(h + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def bands(sound: DataFrame, rules: Rules) -> DataFrame:
    """(lang, size, middle, reach) of each size that a document of a language has; a row a language and size, some dozens a language."""
    middle = common.few(common.materialize(sound.groupBy("lang").agg(F.percentile_approx("surprise", 0.5, 10_000).alias("middle")), "middle"))
    deviation = F.percentile_approx(F.abs(F.col("surprise") - F.col("middle")), 0.5, 10_000)
    spread = sound.join(middle, "lang").groupBy("lang", "middle", "size").agg(deviation.alias("deviation"), F.count(F.lit(1)).alias("documents"))
    spread = common.materialize(spread, "spread")
    enough = spread.filter(F.col("documents") >= LEAST_DOCUMENTS).select("lang", F.col("size").alias("from"), F.col("deviation").alias("of"))
    apart = F.col("from") - F.col("size")
    # a shorter text than those with a spread varies more; a longer one doesn't vary more than they do
    taken = F.col("of") * F.pow(F.lit(2.0), F.greatest(apart, F.lit(0)) / 2)
    near = spread.join(enough, "lang", "left").groupBy("lang", "middle", "size").agg(F.min_by(taken, F.struct(F.abs(apart), apart)).alias("deviation"))
    reach = F.greatest("deviation", F.lit(rules.least_deviation)) * rules.width
    return common.few(common.materialize(near.select("lang", "size", "middle", reach.alias("reach")), "bands"))


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row a document with its number in ``docs``, the counted values and the verdict."""
    scored = common.materialize(score_documents(docs, rules), "scores")
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated_percent * F.col("n_words"))
    sized = scored.withColumn("base_failed", failed).withColumn("size", F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).cast("int"))
    found = bands(sized.filter(~F.col("base_failed")), rules)
    inside = F.coalesce(F.abs(F.col("surprise") - F.col("middle")) <= F.col("reach"), F.lit(True))
    columns = ("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return sized.join(found, ["lang", "size"], "left").select(*columns, (~F.col("base_failed") & inside).alias("kept"), F.exp("surprise").alias("perplexity"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).drop("row")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    docs = common.written(docs)
    return common.without_rows(docs, judge(docs, rules).filter(~F.col("kept")))

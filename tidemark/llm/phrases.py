"""Collocations by level-wise passes, as Apriori counts item sets.

The first pass counts words. Pass k reads the texts again and emits a phrase of k words only where both phrases of k - 1 words in it are
frequent, counted by the pass before; each slice of texts sums its own phrases first and Spark sums the rest by phrase. What a pass
broadcasts of the pass before is a bit for the hash of each frequent phrase, in a table of bounded size: a bit that two phrases share only
lets a rare phrase be counted too, which the threshold then drops, so counts are exact at every size. The level tables of frequent phrases
are joined, by phrase, to score each cut of a candidate, and to drop those that a longer one absorbs.

Defined results: a null text is an empty one; a null language is ``und``, an empty one a language of its own; repeated rows count each; ids and other columns
are not read; an empty table gives no rows. Texts of any length are read whole, and language and phrase, not hashes, decide what is counted together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common, textkit

#: Bits of the table that is broadcast, at most (16 MB), and for each frequent phrase.
MOST_BITS = 1 << 27
BITS_EACH = 32
#: Separators of pieces, and of words in a piece.
CUTS = np.zeros(256, bool)
CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = CUTS.copy()
APART[[0x20, 0x09]] = True
COUNTED = "lang string, phrase string, n long"


@dataclass(frozen=True)
class Limits:
    """Words of a phrase at most, occurrences at least, phrases a language, and the percent of a phrase's count at which a longer one absorbs it."""

    longest: int = 5
    least: int = 100
    most: int = 2000
    absorbed_percent: int = 100


def _salts(langs: list[str]) -> np.ndarray:
    return textkit.split_words(pa.array([x.encode().hex() or "-" for x in langs], pa.large_string())).hashes(1)


@dataclass
class Slice:
    """The words of several texts, in lower case: their numbers in ``names``, their hashes with the language, and the piece and language of each."""

    names: pa.Array
    number: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    langs: list[str]

    @classmethod
    def of(cls, text: pa.Array, langs: list[str]) -> Slice:
        words = textkit.split_words(text, APART)
        size = words.end - words.start
        data = textkit.LOWER[words.data]
        inside = ~APART[data]
        offsets = np.concatenate([[0], np.cumsum(size)])
        spelled = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside].tobytes())).dictionary_encode()
        tongues = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        of_text = np.array([tongues[x] for x in langs], np.int64)
        text_of = words.text_of_word()
        lang = of_text[text_of] if len(text_of) else np.zeros(0, np.int64)
        # a piece ends at a cut or with its text
        piece = np.cumsum(np.concatenate([CUTS[data], [False]]), dtype=np.int64)[words.start] + text_of
        salts = _salts(list(tongues)) if tongues else np.zeros(0, np.uint64)
        return cls(spelled.dictionary, spelled.indices.to_numpy().astype(np.int64), textkit.join(salts[lang], words.hashes(lower=True)), piece, lang, list(tongues))

    def starts(self, k: int) -> np.ndarray:
        """Where ``k`` words of one piece begin."""
        n = len(self.number) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def counted(self, at: np.ndarray, k: int) -> pa.RecordBatch:
        """The different phrases of ``k`` words that begin at ``at``, with their counts."""
        code = self.lang[at] << 32 | self.number[at]
        for i in range(1, k):
            _, code = np.unique(code, return_inverse=True)
            code = code.astype(np.int64) << 32 | self.number[at + i]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        one = at[first]
        parts = [self.names.take(pa.array(self.number[one + i])) for i in range(k)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
        return self._batch(self.lang[one], phrase.cast(pa.string()), n)

    def _batch(self, lang: np.ndarray, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.langs, pa.string()).take(pa.array(lang)), phrase, pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])

    def totals(self) -> pa.RecordBatch:
        """The number of words of each language, as a row without a phrase."""
        return self._batch(np.arange(len(self.langs)), pa.nulls(len(self.langs), pa.string()), np.bincount(self.lang, minlength=len(self.langs)))


class Bits:
    """A set of 64-bit hashes as bits of a table; it may hold more than was put in, never less."""

    def __init__(self, table: np.ndarray):
        self.table, self.shift = table, np.uint64(64 - (len(table) * 64).bit_length() + 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = textkit.mix(hashes) >> self.shift
        return (self.table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def bits_of(frequent: DataFrame, k: int) -> Bits:
    """The table for the frequent phrases of ``k`` words: Spark gathers the words of bits, of which there are a bounded number."""
    count = frequent.count()
    size = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * count - 1).bit_length()))
    shift = np.uint64(64 - size.bit_length() + 1)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "phrase"):
            words = textkit.split_words(common.texts(batch, "phrase"), APART)
            langs = batch.column(0).to_pylist()
            tongues = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            salt = _salts(list(tongues))[np.array([tongues[x] for x in langs])]
            hashes = textkit.join(np.repeat(salt, words.count), words.hashes())
            slot = textkit.mix(textkit.runs(hashes, k)[words.first[:-1]]) >> shift
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(textkit.signed(np.uint64(1) << (slot & np.uint64(63))))], names=["place", "bit"])

    words = frequent.select("lang", "phrase").mapInArrow(slots, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[words["place"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return Bits(table)


def count_words(texts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of the frequent words of ``texts`` (lang, text), and for each language a row without a phrase with the number of all its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            read = Slice.of(common.texts(batch), batch.column(0).to_pylist())
            yield read.counted(read.starts(1), 1)
            yield read.totals()

    return texts.mapInArrow(count, COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("phrase").isNull())


def count_phrases(texts: DataFrame, frequent: DataFrame, k: int, least: int) -> DataFrame:
    """(lang, phrase, n) of the frequent phrases of ``k`` words, from those of one word less."""
    bits = texts.sparkSession.sparkContext.broadcast(bits_of(frequent, k - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            read = Slice.of(common.texts(batch), batch.column(0).to_pylist())
            at = read.starts(k)
            if len(at):
                good = bits.value.has(textkit.runs(read.hashes, k - 1))
                yield read.counted(at[good[at] & good[at + 1]], k)

    return texts.mapInArrow(count, COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def scored(levels: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates in the level tables (lang, phrase, k, n), by their lowest-scoring cut."""
    parts = levels.select("lang", "phrase", "n")
    cuts = levels.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("cut"))).alias("left"), F.concat_ws(" ", F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(common.few(totals), "lang")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), "under": exact("l") * exact("r")}).withColumn("score", F.expr("over div under"))
    return cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("best")).select("lang", "phrase", "best.*")


def absorbed(levels: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of the candidates whose words stand in a longer candidate with at least ``percent`` of their count."""
    longer = levels.filter("k > 2").select("lang", "n", F.split("phrase", " ").alias("words"), "k")
    inner = longer.select("lang", "n", "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size")).select("lang", "n", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    most = inner.groupBy("lang", F.concat_ws(" ", F.slice("words", F.col("at"), F.col("size"))).alias("phrase")).agg(F.max("n").alias("longer"))
    return levels.filter("k > 1").join(most, ["lang", "phrase"]).filter(F.col("longer") * 100 >= F.col("n") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The best phrases of each language, with rank, counts of phrase, parts and words, and score."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null")
    words = common.materialize(count_words(texts, limits.least), "words")
    totals = words.filter("phrase is null").select("lang", "n")
    tables = [words.filter("phrase is not null").withColumn("k", F.lit(1))]
    for k in range(2, limits.longest + 1):
        if k > 2 and tables[-1].isEmpty():
            break
        tables.append(common.materialize(count_phrases(texts, tables[-1], k, limits.least), f"phrases{k}").withColumn("k", F.lit(k)))
    levels = tables[0]
    for table in tables[1:]:
        levels = levels.unionByName(table)
    kept = scored(levels, totals).join(absorbed(levels, limits.absorbed_percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limits.most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))

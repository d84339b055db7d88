"""Benchmark decontamination by short seeds and alignment of words.

Words are read without case and edge marks; numbers and units are typed placeholders, and capitalised words may be names. All windows
of ``window`` words, once with the names' own words and once with a placeholder for names, are joined by hash to those of the
benchmark. Where a document and an item share such a seed, the item is aligned to the words around it. A word of the item is covered by
the same word, by a value of its type for a number or a unit, and by any word where one of the sides reads a name. An item is found where
at least ``share`` of its words are covered in order, and ``literal`` of them by themselves or a value of their type. Slots have to be
consistent: equal values of the item stand for equal values in the document, and the other way round, per type. If numbers or units
aren't, the item is not found; names that aren't cover nothing.

What stands in a document word for word is found at its own place, whatever its length. An item of fewer than ``least_plain`` words that are
no numbers, units and names says too little to be known by its form, so it is found in no other way.

A document that shares no seed with an item is not compared with it, so an item of which no ``window`` words in a row are left is not found.
The benchmark is broadcast while it has at most ``MOST_WINDOWS`` seeds; with more, seeds and then texts are joined by shuffle. An item
shorter than a window is one seed of its own length and its own words.

Defined results: a null text is empty and matches nothing; an item without words matches nothing; null ids are kept apart by row;
repeated rows and ties each get a result; other columns are not read; with an empty table on either side nothing is found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, textkit

MOST_WINDOWS = 500_000

#: Units that a quantity may have.
UNITS = "mm cm m km mg g kg t ml l s min h ms hz khz mhz v w kw kwh pa kpa bar °c °f % $ € £ ¥ usd eur gbp miles mile feet foot inches inch pounds pound ounces ounce hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents cent percent degrees degree liters litres meters metres kilometers kilometres grams kilograms".split()

_NUMBER = re.compile(r"[+-]?[0-9]+(?:[.,:/][0-9]+)*")
_EDGE = "\"'()[]{}<>.,;:!?¿¡…"
_UNITS, _UNIT_SET = frozenset(UNITS), pa.array(UNITS, pa.large_string())
_NUMBER_ALONE = rf"\A{_NUMBER.pattern}\z"
#: Of words of ``_LATIN_ALONE``: a capital, and then letters of which none is one.
_NAME_ALONE = r"\A\p{Lu}\P{Lu}*\p{Ll}\P{Lu}*\z"
#: Without the letters whose case has a rule of its own, the ordinal indicators and the dotted capital I.
_LATIN_ALONE = r"\A[\x{21}-\x{7E}\x{A1}-\x{A9}\x{AB}-\x{B9}\x{BB}-\x{12F}\x{131}-\x{17F}…€]*\z"
#: What ends a sentence; a word of one letter does too.
_ENDS = r"(?s)[.!?:]\z|[.!?].\z|\A.\z"
#: How a word is read. A capitalised word that begins a sentence may be a name or not.
WORD, NUMBER, UNIT, NAME, FIRST = range(5)
PAIRS = "row long, doc_id long, item_id long, share double, exact boolean"


@dataclass(frozen=True)
class Rules:
    window: int = 4
    share: float = 0.8
    literal: float = 0.5
    least_plain: int = 4


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


_PLACEHOLDERS = np.array([0, _hash(" number"), _hash(" unit"), _hash(" name"), 0], np.uint64)


def _looked_at(raw: str) -> tuple[str, int, int]:
    """A word in lower case without its edges, and how it is read inside and at the start of a sentence."""
    core = raw.strip(_EDGE)
    low = core.lower()
    if _NUMBER.fullmatch(core) or (core and _NUMBER.fullmatch(core.strip("$€£¥%"))):
        return low, NUMBER, NUMBER
    if low in _UNITS:
        return low, UNIT, UNIT
    if core and core[0].isupper() and core[1:].islower():
        return low, NAME, FIRST
    return low, WORD, WORD


def _words_looked_at(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``_looked_at`` of each word. Words of Latin letters and ASCII are read in arrays; letters elsewhere may have cases that only Python knows."""
    core = pc.utf8_trim(words, characters=_EDGE)
    low = pc.utf8_lower(core)
    number = pc.or_(pc.match_substring_regex(core, _NUMBER_ALONE), pc.match_substring_regex(pc.utf8_trim(core, characters="$€£¥%"), _NUMBER_ALONE))
    name = np.asarray(pc.match_substring_regex(core, _NAME_ALONE))
    kind = np.where(np.asarray(number), NUMBER, np.where(np.asarray(pc.is_in(low, _UNIT_SET)), UNIT, np.where(name, NAME, WORD))).astype(np.int8)
    first = np.where(kind == NAME, FIRST, kind).astype(np.int8)
    odd = np.flatnonzero(np.asarray(pc.invert(pc.match_substring_regex(words, _LATIN_ALONE))))
    if len(odd):
        seen = [_looked_at(raw) for raw in words.take(pa.array(odd)).to_pylist()]
        mask = np.zeros(len(words), bool)
        mask[odd] = True
        low = pc.replace_with_mask(low, pa.array(mask), pa.array([x[0] for x in seen], low.type))
        kind[odd], first[odd] = [x[1] for x in seen], [x[2] for x in seen]
    return low, kind, first


def _word_hashes(words: pa.Array) -> np.ndarray:
    data, at = textkit.buffers(words)
    return textkit.Words(data, at[:-1], at[1:], at[:1], at[:1]).hashes()


@dataclass
class Text:
    """Value and kind of each word, and the values with placeholders for numbers and units."""

    value: np.ndarray
    kind: np.ndarray
    word: np.ndarray


def read_all(texts: pa.Array) -> list[Text]:
    """The words of each text of a large_string array without nulls. Distinct words are looked at once; words of edges alone don't count."""
    lists = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(lists).dictionary_encode()
    low, inner, at_first = _words_looked_at(words.dictionary)
    of = np.asarray(words.indices).astype(np.int64)
    full = (np.asarray(pc.binary_length(low)) > 0)[of]
    # text without a word before or after white space gives an empty one, which ends nothing
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.match_substring_regex(words.dictionary, _ENDS))[of])])
    at = np.flatnonzero(full)
    first = np.searchsorted(at, np.asarray(lists.offsets))
    # a word begins a sentence if it is the first of its text, or if a word has ended one since the last that counts, that one included
    begins = np.ones(len(at), bool)
    begins[1:] = ends[at[1:]] > ends[at[:-1]]
    begins[first[:-1][first[:-1] < first[1:]]] = True
    of = of[at]
    value, kind = _word_hashes(low)[of], np.where(begins, at_first[of], inner[of])
    word = np.where((kind == NUMBER) | (kind == UNIT), _PLACEHOLDERS[kind], value)
    return [Text(value[i:j], kind[i:j], word[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def read(text: str) -> Text:
    return read_all(pa.array([text], pa.large_string()))[0]


def read_item(text: str) -> Text:
    """A word that is a name in one place is one in all."""
    item = read(text)
    item.kind[np.isin(item.value, item.value[item.kind == NAME]) & (item.kind != NUMBER) & (item.kind != UNIT)] = NAME
    return item


def seeds(texts: list[Text], k: int, short: bool = False, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of all windows of ``k`` words.

    ``short`` windows are those of items that are shorter than a seed; they hold literal values alone. ``whole`` asks for the windows of
    texts of just ``k`` words.
    """
    count = np.array([len(t.value) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    none = np.zeros(0, np.int64)
    words = textkit.Words(none, none, none, first, none)
    word = np.concatenate([t.value if short else t.word for t in texts]) if texts else np.zeros(0, np.uint64)
    kind = np.concatenate([t.kind for t in texts]) if texts else np.zeros(0, np.int8)
    of_word = words.text_of_word()
    h, at = textkit.windows(words, word, k)
    forms = [(h, at)]
    # with a placeholder for names; a word that begins a sentence is a name in a third form
    for names in () if short else (kind == NAME, (kind == NAME) | (kind == FIRST)):
        h, at = textkit.windows(words, np.where(names, _PLACEHOLDERS[NAME], word), k)
        held = np.concatenate([[0], np.cumsum(names)])
        some = held[at + k] > held[at]
        forms.append((h[some], at[some]))
    h, at = (np.concatenate(x) for x in zip(*forms, strict=True))
    of = of_word[at]
    pos = at - first[of]
    if whole:
        keep = count[of] == k
        h, of, pos = h[keep], of[keep], pos[keep]
    return h, of, pos


def item_seeds(items: list[Text], rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    short = {len(t.value) for t in items} & {*range(1, rules.window)}
    parts = [seeds(items, rules.window), *(seeds(items, n, short=True, whole=True) for n in sorted(short))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def align(item: Text, doc: Text, rules: Rules) -> tuple[float, bool] | None:
    """The covered share of the item in these words of a document, and whether it stands there word for word; None if it isn't held."""
    n, m = len(item.value), len(doc.value)
    if not n or np.isin(item.word, doc.word).sum() < rules.literal * n:
        return None
    typed = (item.kind == NUMBER) | (item.kind == UNIT), (doc.kind == NUMBER) | (doc.kind == UNIT)
    rows = np.zeros((n + 1, m + 1), np.float32)
    for i in range(n):
        same = np.where(doc.value == item.value[i], 1.0, 0.99 * (doc.word == item.word[i]))
        if not typed[0][i]:
            named = (doc.kind == NAME) | ((doc.kind == FIRST) & (item.kind[i] == FIRST)) | (item.kind[i] == NAME)
            same = np.maximum(same, 0.5 * (named & ~typed[1]))
        step = rows[i, :-1] + same
        rows[i + 1, 1:] = np.maximum.accumulate(np.maximum(rows[i, 1:], step))
    at = []
    i, j = n, m
    while i and j:
        if rows[i, j] == rows[i - 1, j]:
            i -= 1
        elif rows[i, j] == rows[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            at.append((i, j))
    slots = {(int(item.kind[i]) if typed[0][i] else NAME, int(item.value[i]), int(doc.value[j])) for i, j in at if typed[0][i] or item.value[i] != doc.value[j] or item.kind[i] == NAME}
    there, back = {}, {}
    for kind, a, b in slots:
        there.setdefault((kind, a), set()).add(b)
        back.setdefault((kind, b), set()).add(a)
    torn = {(k, a, b) for k, a, b in slots if len(there[k, a]) > 1 or len(back[k, b]) > 1}
    if any(k != NAME for k, _, _ in torn):
        return None
    covered = [(i, j) for i, j in at if typed[0][i] or (NAME, int(item.value[i]), int(doc.value[j])) not in torn]
    literal = sum(item.word[i] == doc.word[j] for i, j in covered)
    if len(covered) < rules.share * n or literal < rules.literal * n:
        return None
    exact = all(item.value[i] == doc.value[j] for i, j in at) and len(at) == n and at[0][1] - at[-1][1] == n - 1
    return len(covered) / n, bool(exact)


def verify(item: Text, doc: Text, diagonals: np.ndarray, rules: Rules) -> tuple[float, bool] | None:
    """The best alignment near the places (document word of the item's first) that share a seed."""
    n, best = len(item.value), None
    found = np.unique(diagonals)
    inside = found[(found >= 0) & (found + n <= len(doc.value))]
    for i in range(n):  # each place by itself first: what stands there word for word is found, whatever else is near
        if not len(inside):
            break
        inside = inside[doc.value[inside + i] == item.value[i]]
    if n and len(inside):
        return 1.0, True
    plain = ~np.isin(item.kind, (NUMBER, UNIT, NAME))
    if plain.sum() < rules.least_plain:
        return None
    drift = 2 + n // 4
    for near in np.split(found, np.flatnonzero(np.diff(found) > drift) + 1):
        # a long chain of places is gone through in overlapping parts
        for start in range(int(near[0]), int(near[-1]) + 1, n + drift):
            inside = near[(near >= start) & (near < start + n + drift)]
            if len(inside):
                a, b = max(int(inside[0]) - drift, 0), int(inside[-1]) + n + drift
                got = align(item, Text(doc.value[a:b], doc.kind[a:b], doc.word[a:b]), rules)
                best = max(filter(None, (best, got)), default=None)
    return best


def benchmark_windows(benchmark: DataFrame, rules: Rules) -> DataFrame:
    """(hash, item, at, item_words) of all seeds; ``item`` is the row's number."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            items = [read_item(t or "") for t in batch.column(1).to_pylist()]
            h, of, at = item_seeds(items, rules)
            n = np.array([len(t.value) for t in items], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(h)), batch.column(0).take(pa.array(of)), pa.array(at), pa.array(n[of])], names=["hash", "item", "at", "item_words"])

    return benchmark.select("item", "text").mapInArrow(cut, "hash long, item long, at long, item_words int")


def _near_items(docs: DataFrame, items: DataFrame, rules: Rules) -> DataFrame:
    """Items that are small enough to be held by each worker."""
    held = items.select("item_id", "text").collect()  # bounded by MOST_WINDOWS
    shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"] or "") for r in held])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [read_item(t) for _, t in shared.value]
        ids = [i for i, _ in shared.value]
        h, of, at = item_seeds(known, rules)
        order = np.argsort(h, kind="stable")
        h, of, at = h[order], of[order], at[order]
        lengths = (rules.window, *sorted({len(t.value) for t in known} & {*range(1, rules.window)}))
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            docs = read_all(common.texts(batch))
            hits = []
            for k in lengths:
                seen, text, pos = seeds(docs, k, short=k < rules.window)
                left = np.searchsorted(h, seen)
                hit = left < len(h)
                hit[hit] = h[left[hit]] == seen[hit]
                left, text, pos = left[hit], text[hit], pos[hit]
                times = np.searchsorted(h, h[left], "right") - left
                each = np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())
                hits.append((np.repeat(text, times), of[each], np.repeat(pos, times) - at[each]))
            text, item, diagonal = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.lexsort((item, text))
            text, item, diagonal = text[order], item[order], diagonal[order]
            ends = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
            out = []
            for group in np.split(np.arange(len(text)), ends) if len(text) else []:
                t, i = int(text[group[0]]), int(item[group[0]])
                if got := verify(known[i], docs[t], diagonal[group], rules):
                    out.append((batch.column(0)[t].as_py(), batch.column(1)[t].as_py(), ids[i], *got))
            yield _pairs(out)

    return docs.mapInArrow(find, PAIRS)


def _pairs(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=["row", "doc_id", "item_id", "share", "exact"])


def _joined_items(docs: DataFrame, items: DataFrame, windows: DataFrame, rules: Rules) -> DataFrame:
    """Seeds and then texts joined by shuffle, for any number of items."""
    lengths = [rules.window, *sorted(r[0] for r in windows.select("item_words").filter(F.col("item_words") < rules.window).distinct().collect())]  # fewer than a window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            texts = read_all(common.texts(batch))
            for k in lengths:
                h, of, pos = seeds(texts, k, short=k < rules.window)
                yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(h)), batch.column(0).take(pa.array(of)), pa.array(pos)], names=["hash", "row", "pos"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=common.SMALL_SLICE_BYTES):
            out = []
            for r in batch.to_pylist():
                if got := verify(read_item(r["item_text"] or ""), read(r["text"] or ""), np.array(r["places"], np.int64), rules):
                    out.append((r["row"], r["doc_id"], r["item_id"], *got))
            yield _pairs(out)

    hits = docs.mapInArrow(cut, "hash long, row long, pos long").join(windows, "hash")
    near = hits.groupBy("row", "item").agg(F.collect_set(F.col("pos") - F.col("at")).alias("places"))
    texts = near.join(docs, "row").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    return texts.select("row", "doc_id", "text", "item_id", "item_text", "places").mapInArrow(check, PAIRS)


def find_items(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(row, doc_id, item_id, share, exact): the items that each document holds. ``docs`` has ``row`` to tell equal ids apart."""
    items = common.materialize(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "items")
    windows = common.materialize(benchmark_windows(items, rules), "windows")
    texts = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _near_items(texts, items, rules) if windows.count() <= MOST_WINDOWS else _joined_items(texts, items, windows, rules)
    return found.groupBy("row", "doc_id", "item_id").agg(F.max("share").alias("share"), F.max("exact").alias("exact"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    docs = common.written(docs)
    return common.without_rows(docs, find_items(common.with_rows(docs.select("doc_id", "text")), benchmark, rules))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a contaminated document: the items that it holds, whether one is held word for word, and the largest share."""
    docs = common.with_rows(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_items(docs, common.table(spark, sf_dir, "benchmark"))
    return found.groupBy("row", "doc_id").agg(F.array_join(F.array_sort(F.collect_set("item_id")).cast("array<string>"), ",").alias("item_ids"), F.count(F.lit(1)).alias("n_items"), F.max("share").alias("share"), F.max("exact").alias("exact")).drop("row")

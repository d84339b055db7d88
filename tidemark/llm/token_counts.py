"""Token counts with a compiled transducer for a sentencepiece BPE model with byte fallback.

In such a model no piece has the word mark behind another character, so merges never cross from a word into the next mark: a text
is a sequence of segments (marks, then other characters), and its count is the sum of theirs. Within a segment, the encoding of a
prefix followed by one more character depends only on a bounded suffix: the longest suffix that begins a vocabulary piece, and the
last piece of the encoding at each place in it. That is the state of a deterministic transducer whose transitions carry the change
in emitted tokens. States are compiled when they are first reached and shared by all texts of a worker; segments seen before are
one transition of their own.

A text is read in chunks, independently of one another, and what they do is combined by a tree scan. Between the first and the last
segment border of a chunk all is a constant; the segments that are open at its ends meet those of its neighbours. A segment that is
longer than a chunk is cut itself, and each part has a state map: from the state that the characters before it lead to, wherever one begins
a little way back, to its last state and its tokens. A map that is entered in another state follows that one until both meet, which is
soon, and goes on as before; so maps are exact from every state, and compose associatively.

Defined results: a null text counts as empty and has no tokens; other columns are not read; null and repeated ids give a row each;
an empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.encoder import vocabulary_path

MARK = "▁"
CHUNK_CHARS = 1 << 16
#: Remembered segments, the characters of the longest, and transitions; beyond that they are counted and compiled anew, so memory stays bounded.
SEGMENTS, LONGEST, TRANSITIONS = 500_000, 64, 700_000


class State(NamedTuple):
    """``suffix`` begins a piece; ``last[i]`` is the encoding's last piece where ``suffix[i:]`` starts (None: at the border), and ``back[i]`` the tokens emitted since."""

    suffix: str
    last: tuple[str | None, ...]
    back: tuple[int, ...]


#: The state at a border.
START = State("", (None,), (0,))
#: Characters between the states that a state map keeps, and those before it that lead to the state it is read from.
STEP, BEFORE = 256, 64


class Stretch:
    """The state map of a part of a segment: read once from a likely state, with the states on the way, so that any other state is soon known too."""

    def __init__(self, machine: Transducer, text: str, guess: State):
        self.machine, self.text, self.guess = machine, text, guess
        self.way: list[tuple[State, int]] = []
        self.last, self.tokens = guess, 0
        for at in range(0, len(text), STEP):
            self.last, n = machine.run(self.last, text[at : at + STEP])
            self.tokens += n
            self.way.append((self.last, self.tokens))

    def enter(self, state: State) -> tuple[State, int]:
        """The state at the end and the tokens, for this state at the start."""
        if state == self.guess:
            return self.last, self.tokens
        total = 0
        for i, (known, tokens) in enumerate(self.way):
            state, n = self.machine.run(state, self.text[i * STEP : (i + 1) * STEP])
            total += n
            if state == known:
                return self.last, total + self.tokens - tokens
        return state, total


class Joined:
    """First one state map, then another."""

    def __init__(self, first: Stretch | Joined, second: Stretch | Joined):
        self.first, self.second, self.guess = first, second, first.guess
        self.last, n = second.enter(first.last)
        self.tokens = first.tokens + n

    def enter(self, state: State) -> tuple[State, int]:
        if state == self.guess:
            return self.last, self.tokens
        between, n = self.first.enter(state)
        if between == self.first.last:
            return self.last, n + self.tokens - self.first.tokens
        last, more = self.second.enter(between)
        return last, n + more


class Transducer:
    """Counts tokens of segments as the model's own encoder does."""

    _made: dict[str, Transducer] = {}

    @classmethod
    def of(cls, path: str) -> Transducer:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = model.normalizer_spec
        self.score = {p.piece: p.score for p in model.pieces if p.type == p.NORMAL}
        plain = {p.type for p in model.pieces} <= {1, 2, 3, 6}
        #: Else every text goes to the library.
        self.usable = plain and model.trainer_spec.byte_fallback and model.trainer_spec.model_type == 2 and spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not any(MARK in p.lstrip(MARK) for p in self.score)
        self.begins = {p[:i] for p in self.score for i in range(1, len(p) + 1)}
        self.alone = lru_cache(1 << 16)(self._alone)
        self.apart = lru_cache(1 << 18)(self._apart)
        self.segments: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        """Drop the compiled states; the start state is state 0."""
        self.states: list[State] = [START]
        self.number: dict[State, int] = {self.states[0]: 0}
        #: For each state: character -> (next state, change in emitted tokens).
        self.transitions: list[dict[str, tuple[int, int]]] = [{}]
        self.compiled = 0

    @classmethod
    def release(cls) -> None:
        """Drop all of it, as another operator has come to this worker."""
        cls._made.clear()

    def _merged(self, text: str) -> list[str]:
        """The definition: merge the best-scored neighbours, the leftmost of equals, until none is a piece."""
        return self._steps(text)[0]

    def _steps(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The parts that are left, and for each merge its score and the first and the last part after it."""
        parts, steps = list(text), []
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts, steps
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            steps.append((best[0], parts[0], parts[-1]))

    def _alone(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters; None if these end as several parts."""
        parts, steps = self._steps(piece)
        return steps if len(parts) == 1 else None

    def _apart(self, left: str | None, right: str) -> bool:
        """Whether the encoding of both, one after the other, is these two pieces.

        The merges inside of each are those that it has alone, the better-scored of both sides' next ones first; the pieces stay apart unless
        the parts that touch are a piece themselves and come before either.
        """
        if left is None:
            return self.alone(right) is not None
        before, after = self.alone(left), self.alone(right)
        if before is None or after is None:
            return False
        a, b, i, j, score = left[-1], right[0], 0, 0, self.score
        while True:
            across, mine, theirs = score.get(a + b), before[i][0] if i < len(before) else None, after[j][0] if j < len(after) else None
            if across is not None and (mine is None or across > mine) and (theirs is None or across >= theirs):
                return False
            if mine is not None and (theirs is None or mine >= theirs):
                a, i = before[i][2], i + 1
            elif theirs is not None:
                b, j = after[j][1], j + 1
            else:
                return True

    def _step(self, state: State, char: str) -> tuple[State, int]:
        """The transition: the next state and the change in emitted tokens."""
        text, score, apart = state.suffix + char, self.score, self.apart
        for at, before in enumerate(state.last):
            piece = text[at:]
            if piece in score and apart(before, piece):
                break
        else:  # a character without a piece: its bytes, and nothing merges with it
            return State("", (char,), (0,)), len(char.encode())
        # state.back[at]: tokens between the border before the piece and the current end
        change = 1 - state.back[at]
        last, back = (*state.last, piece), (*(b + change for b in state.back), 0)
        cut = next((i for i in range(len(text)) if text[i:] in self.begins), len(text))
        return State(text[cut:], last[cut:], back[cut:]), change

    def _count(self, segment: str) -> int:
        if segment.startswith(MARK + MARK) and segment.strip(MARK):
            # equal scores of mark runs and the merge into the word interact over the whole run
            return len(self._merged(segment)) if len(segment) < 24 and all(c in self.score for c in segment) else self._by_library(segment)
        if not segment.strip(MARK):
            return self._by_library(segment)
        return self._through_maps(segment) if len(segment) > CHUNK_CHARS else self.run(START, segment)[1]

    def _through_maps(self, segment: str) -> int:
        maps: list[Stretch | Joined] = []
        for at in range(0, len(segment), CHUNK_CHARS):
            guess = self.run(START, segment[max(at - BEFORE, 0) : at])[0]
            maps.append(Stretch(self, segment[at : at + CHUNK_CHARS], guess))
        while len(maps) > 1:
            maps = [Joined(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0].enter(START)[1]

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after these characters and the tokens they emit."""
        number, total = self._number(state), 0
        for char in text:
            found = self.transitions[number].get(char)
            if found is None:
                found = self._compile(number, char)
            number, change = found
            total += change
        return self.states[number], total

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        source = self.states[state]
        target, change = self._step(source, char)
        self.compiled += 1
        if self.compiled > TRANSITIONS:  # the state that is read from is the first one known again
            self._forget()
            state = self._number(source)
        self.transitions[state][char] = found = (self._number(target), change)
        return found

    def _number(self, state: State) -> int:
        number = self.number.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
            self.transitions.append({})
        return number

    def _by_library(self, segment: str) -> int:
        """A segment that begins with a mark; the library puts one in front itself."""
        return len(self.library.encode(segment[1:].replace(MARK, " "))) if segment != MARK else 1

    def counts(self, segments: list[str]) -> np.ndarray:
        known = self.segments
        if len(known) > SEGMENTS:
            known.clear()
        out = np.empty(len(segments), np.int64)
        for i, s in enumerate(segments):
            n = known.get(s)
            if n is None:
                n = self._count(s)
                if len(s) <= LONGEST:
                    known[s] = n
            out[i] = n
        return out


class ChunkMap(NamedTuple):
    """What reading a chunk does: ``head`` closes the segment it is entered in, ``tail`` is open at its end. ``inner`` is None if no segment begins in the chunk; then all of it is ``head``."""

    head: str
    inner: int | None
    tail: str


def chunk_map(chunk: str, machine: Transducer) -> ChunkMap:
    segments = split_segments(chunk)
    if not segments:
        return ChunkMap("", None, "")
    head = "" if segments[0].startswith(MARK) else segments.pop(0)
    if chunk.startswith(MARK):  # its marks may go on a run of marks that the chunk before ends with
        head = segments.pop(0)
        return ChunkMap(head, None, "") if not segments else ChunkMap(head, int(machine.counts(segments[:-1]).sum()), segments[-1])
    if not segments:
        return ChunkMap(head, None, "")
    return ChunkMap(head, int(machine.counts(segments[:-1]).sum()), segments[-1])


def split_segments(text: str) -> list[str]:
    """Cut before each run of marks."""
    parts = text.split(MARK)
    out, marks = ([parts[0]] if parts[0] else []), 0
    for p in parts[1:]:
        marks += 1
        if p:
            out.append(MARK * marks + p)
            marks = 0
    if marks:
        out.append(MARK * marks)
    return out


def compose(a: ChunkMap, b: ChunkMap, machine: Transducer) -> ChunkMap:
    """First ``a``, then ``b``."""
    if a.inner is None:
        joined = a.head + b.head
        if a.head and not a.head.strip(MARK) or not b.head.startswith(MARK) or not a.head:
            return ChunkMap(joined, b.inner, b.tail)
        return ChunkMap(a.head, 0, b.head) if b.inner is None else ChunkMap(a.head, int(machine.counts([b.head])[0]) + b.inner, b.tail)
    open_run = a.tail + b.head
    closed = split_segments(open_run) if open_run else []
    if b.inner is None:
        return ChunkMap(a.head, a.inner + int(machine.counts(closed[:-1]).sum()), closed[-1] if closed else "")
    return ChunkMap(a.head, a.inner + int(machine.counts(closed).sum()) + b.inner, b.tail)


def count_long(text: str, machine: Transducer, chunk_chars: int = CHUNK_CHARS) -> int:
    """Map all chunks, then combine neighbours until one map is left."""
    marked = MARK + text.replace(" ", MARK)
    maps = [chunk_map(marked[i : i + chunk_chars], machine) for i in range(0, len(marked), chunk_chars)]
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2], machine) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    head, inner, tail = maps[0]
    return (inner or 0) + int(machine.counts([s for x in (head, tail) if x for s in split_segments(x)]).sum())


def count_batch(texts: pa.Array, machine: Transducer) -> np.ndarray:
    """Counts of large_strings. Texts of at most a chunk are one chunk each and are read together."""
    n = len(texts)
    out = np.zeros(n, np.int64)
    if not machine.usable:
        out[:] = [len(x) for x in machine.library.encode(texts.to_pylist(), num_threads=1)]
        return out
    chars = np.asarray(pc.utf8_length(texts))
    short = (chars > 0) & (chars <= CHUNK_CHARS)
    odd = np.asarray(pc.match_substring_regex(texts, f"  |^ | $|{MARK}|\\x00"))
    for i in np.flatnonzero((chars > 0) & (~short | odd)):
        text = texts[int(i)].as_py()
        out[i] = len(machine.library.encode(text)) if "\x00" in text or MARK in text else count_long(text, machine)
    plain = short & ~odd
    if plain.any():
        lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        parts = pc.list_flatten(lists).dictionary_encode()
        counts = machine.counts([MARK + p for p in parts.dictionary.to_numpy(zero_copy_only=False).tolist()])
        ends = np.concatenate([[0], np.cumsum(counts[np.asarray(parts.indices)])])
        out[plain] = np.diff(ends[np.asarray(lists.offsets)])
    return out


def count_tokens(docs: DataFrame, *, model: str, limit: int = 4096) -> DataFrame:
    """Bytes, tokens and whether a document is over ``limit`` tokens. No shuffle: a document is counted where it is read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.of(model)
        for batch in common.slices(batches, memory=machine):
            text = common.texts(batch)
            n = count_batch(text, machine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), model=vocabulary_path("piece_bpe_32k.model"))

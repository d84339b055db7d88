"""Batch encoding with a byte-level BPE of the tokenizers library, remembering the ids of recurring pieces.

The pre-tokenizer of these vocabularies always cuts before a single space that stands between two other characters, before and
after such a line feed, and between an ASCII letter or digit and an ASCII symbol, but for what follows an apostrophe. So most texts can
be cut there, and each distinct piece is encoded by the library once per worker: a word with a comma after it is no other piece than the
word. A text with any other white space, or with the string of an added token, goes to the library whole.
"""

from __future__ import annotations

import json
import os
from itertools import repeat
from string import ascii_letters, digits, punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pieces that a worker remembers, by an estimate; beyond that all are forgotten.
REMEMBER_BYTES = 128 << 20
#: What a remembered piece needs besides its characters and ids: the string, its entry and its places.
PIECE_BYTES = 180
#: White space apart from single spaces and line feeds between other characters.
_IRREGULAR = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0B\x0C\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _cuts() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and whether a text is cut between two bytes, by ``8 * kind + kind``."""
    other, space, feed, word, symbol, apostrophe = range(6)
    kinds = np.full(256, other, np.uint8)
    for kind, characters in ((space, " "), (feed, "\n"), (word, ascii_letters + digits), (symbol, punctuation), (apostrophe, "'")):
        kinds[list(characters.encode())] = kind
    cut = np.zeros((8, 8), bool)
    cut[:, [space, feed]] = cut[feed] = True
    cut[word, [symbol, apostrophe]] = cut[symbol, word] = True
    return kinds, cut.ravel()


_KINDS, _CUT = _cuts()


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str, remember_bytes: int = REMEMBER_BYTES) -> Encoder:
        """One per worker process, which remembers as much as its last user asks for."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        cls._made[path].remember_bytes = remember_bytes
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.remember_bytes = REMEMBER_BYTES
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        said = json.loads(self.library.to_str())
        self.library.no_truncation()
        self.library.no_padding()
        feed = self.library.encode("\n", add_special_tokens=False).ids
        pre = said.get("pre_tokenizer") or {}
        self.splittable = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not said.get("normalizer") and len(feed) == 1
        self.feed = feed[0] if feed else -1
        #: Tokens that begin with a space, which the byte-level alphabet writes as one letter.
        self.spaced = np.zeros(self.library.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.library.get_vocab().items() if t[:1] == "Ġ"]] = True
        special = "|".join("".join(f"\\x{{{ord(c):X}}}" for c in t["content"]) for t in said.get("added_tokens", []) if t["content"])
        self.irregular = f"{_IRREGULAR}|{special}" if special else _IRREGULAR
        self.forget()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, many in one call. Each begins with a space of its own or gets a line feed in front, and the token of that shows where it begins."""
        for spaced in (True, False):
            group = [p for p in pieces if (p[:1] == " ") is spaced]
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                joined = "".join(part) if spaced else "\n" + "\n".join(part)
                ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
                cuts = np.flatnonzero(self.spaced[ids] if spaced else ids == self.feed)
                if len(cuts) != len(part):  # a token inside of a piece looks like a first one
                    for p in part:
                        self._add([p], self._whole([p])[0], np.zeros(1, np.int64), None)
                    continue
                self._add(part, ids, cuts if spaced else cuts + 1, np.append(cuts[1:], len(ids)))

    def _add(self, pieces: list[str], ids: np.ndarray, start: np.ndarray, end: np.ndarray | None) -> None:
        end = np.array([len(ids)]) if end is None else end
        n = len(self.place)
        self.held += PIECE_BYTES * len(pieces) + sum(map(len, pieces)) + 8 * len(ids)
        self.place.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        while n + len(pieces) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) >= len(self.pool):  # a place is left after the last one
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[n : n + len(pieces)] = start + self.used
        self.size[n : n + len(pieces)] = end - start
        self.used += len(ids)

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where the pieces stand in ``at`` and ``size``."""
        if self.held > self.remember_bytes:
            self.forget()
        found = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(found < 0)):
            fresh = [pieces[i] for i in new]
            self._learn(fresh)
            found[new] = np.fromiter(map(self.place.__getitem__, fresh), np.int64, len(fresh))
        return found

    @classmethod
    def release(cls) -> None:
        """Drop all of it, vocabularies included, as another operator has come to this worker."""
        cls._made.clear()

    def forget(self) -> None:
        self.held = 0
        self.place: dict[str, int] = {}
        self.at, self.size, self.pool, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0
        self._add(["\n"], np.array([self.feed], np.int32), np.zeros(1, np.int64), None)

    def _regular(self, texts: pa.Array, ends: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that can be cut, with room for as many ``ends`` after each text's, and where each text's room ends."""
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        kinds = _KINDS[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]]
        cut = np.empty(len(kinds), bool)
        np.take(_CUT, 8 * kinds[:-1] + kinds[1:], out=cut[1:])
        first = bounds[:-1] - bounds[0]
        cut[first] = True
        begins = np.append(np.flatnonzero(cut), len(kinds))
        parts = pa.Array.from_buffers(pa.large_string(), len(begins) - 1, [None, pa.py_buffer(begins + bounds[0]), data]).dictionary_encode()
        which = np.asarray(parts.indices)
        place = self._places(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        at, length = self.at[place][which], self.size[place][which]
        last = np.append(np.searchsorted(begins, first[1:]), len(which)) - 1
        length[last] += ends
        after = np.cumsum(length)
        flat = self.pool[np.arange(int(after[-1])) + np.repeat(at - after + length, length)]
        return flat, after[last]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the offset of each text's first id (one more than texts); ``end_id``, if any, follows each text's ids."""
        n, ends = len(texts), int(end_id is not None)
        odd = np.ones(n, bool)
        if self.splittable:
            odd = np.asarray(pc.match_substring_regex(texts, self.irregular)) | (np.asarray(pc.binary_length(texts)) == 0)
        counts = np.zeros(n, np.int64)
        whole = self._whole([texts[int(i)].as_py() for i in np.flatnonzero(odd)])
        counts[odd] = [len(x) + ends for x in whole]
        flat = np.zeros(0, np.int32)
        if not odd.all():
            flat, after = self._regular(texts.filter(pa.array(~odd)) if whole else texts, ends)
            counts[~odd] = np.diff(after, prepend=0)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if whole:
            out, is_odd = np.empty(int(offsets[-1]), np.int32), np.repeat(odd, counts)
            out[is_odd] = np.concatenate([np.append(x, np.zeros(ends, np.int32)) for x in whole])
            out[~is_odd] = flat
            flat = out
        if ends:
            flat[offsets[1:] - 1] = end_id
        return flat, offsets

    def encode_with_end(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each text's ids."""
        return self.encode(texts, end_id)

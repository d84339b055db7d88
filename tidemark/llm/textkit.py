"""Vectorised words and hashes over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes that are not separators. A word is hashed by eights of bytes: each eight is mixed together with its
place, by a permutation that isn't linear, and the results are summed and mixed again. Windows of words are hashed by doubling, from
the mixed hashes of their halves. So no arrangement of equal parts, such as a Thue-Morse word and its complement, meets another one
but by chance. Two hashes with other constants (``lane`` 0 and 1) make 128 bits where equality is decided by the hash alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Eights that are hashed at once, so that a very long text needs a bounded amount of memory besides its words.
BLOCK = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the words that are runs of letters, digits and bytes from 0x80.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Eights of a word that are hashed for all words together.
SHORT = 64
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def join(left: np.ndarray, right: np.ndarray, lane: int = 0) -> np.ndarray:
    """The hash of two things in a row from the hash of each."""
    return mix(left * np.uint64(_BASES[1 - lane] | 2) + right)


@dataclass
class Words:
    """Words of several texts: byte places in ``data``, and for each text the index of its first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_start: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self, lane: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = self.end - self.start
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = LOWER[self.data] if lower else self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
        keys = mix(np.arange(1, SHORT + 1, dtype=np.uint64) * np.uint64(_BASES[lane]))
        out = mix((eight[self.start] & _MASKS[np.minimum(size, 8)]) ^ keys[0])
        for place in range(1, SHORT):
            at = np.flatnonzero(size > 8 * place)
            if not len(at):
                break
            out[at] += mix((eight[self.start[at] + 8 * place] & _MASKS[np.minimum(size[at] - 8 * place, 8)]) ^ keys[place])
        for i in np.flatnonzero(size > 8 * SHORT):  # in blocks, as such a word can be a whole text
            for first in range(SHORT, int(size[i] + 7) >> 3, BLOCK):
                place = np.arange(first, min(first + BLOCK, int(size[i] + 7) >> 3))
                key = mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASES[lane]))
                value = eight[self.start[i] + 8 * place] & _MASKS[np.minimum(size[i] - 8 * place, 8)]
                out[i : i + 1] += np.sum(mix(value ^ key), dtype=np.uint64)
        return mix(out + size.astype(np.uint64) * np.uint64(_BASES[lane]))


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a large_string array without nulls and offset."""
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[: len(text) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[: off[-1]], off


def split_words(text: pa.Array, separators: np.ndarray = SPACE) -> Words:
    data, off = buffers(text)
    n = int(off[-1])
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~separators[data[:n]]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    before[off[off < n]] = False  # a text's start ends the word of the text before
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n + 1, bool)
    after[:n] = inside[1:]
    cut = off[1:] - 1
    after[cut[cut >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, off), off[:-1])


def runs(hashes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` values, by doubling."""
    width, held, out, done = 1, hashes, None, 0
    while True:
        if k & width:
            out = held[: len(hashes) - k + 1] if out is None else join(out, held[done : done + len(hashes) - k + 1], lane)
            done += width
        if 2 * width > k:
            return mix(out + np.uint64(k))
        held = join(held[:-width], held[width:], lane)
        width *= 2


def windows(words: Words, hashes: np.ndarray, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive words of one text, and the index of each window's first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = words.text_of_word()
    at = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
    return runs(hashes, k, lane)[at], at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

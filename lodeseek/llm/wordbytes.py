"""Words of many texts at once, found and hashed with numpy on the UTF-8 bytes of an Arrow column.

A word is a run of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z: the class
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Bytes beyond ASCII are always word bytes in UTF-8, so the byte view
finds the same words as the character view.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128)
_MIX = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


@dataclass
class Words:
    """starts, ends: byte offsets of each word; row: its text; first: index of each text's first word, and one more."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def words_of(data: np.ndarray, offsets: np.ndarray, wide_apart: bool = False) -> Words:
    """Words of the texts between offsets; wide_apart: characters from U+3000 on (no blanks stand between them) are each a word."""
    n_rows = len(offsets) - 1
    inside = IS_WORD[data]
    none = np.zeros(0, np.int64)
    if not inside.any():
        return Words(none, none, none, np.zeros(n_rows + 1, np.int64), none.astype(np.uint64))
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    starts = inside & ~before
    if wide_apart:
        lead = np.flatnonzero(data >= 0xE3)
        starts[lead] = True
        following = lead + np.where(data[lead] >= 0xF0, 4, 3)
        following = following[following < len(data)]
        starts[following] |= inside[following]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[(edges > 0) & (edges <= len(data))] - 1] = False
    if wide_apart:
        after[:-1] &= ~starts[1:]
    starts = np.flatnonzero(starts)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    lens = ends - starts
    at = np.cumsum(lens) - lens
    position = np.arange(int(lens.sum())) - np.repeat(at, lens)
    letters = _MIX[LOWER[data[inside]]]
    letters *= powers(int(lens.max()))[position]
    hashes = mix64(np.add.reduceat(letters, at) ^ (lens.astype(np.uint64) * _BASE))
    return Words(starts, ends, row, first, hashes)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of size consecutive values (texts aren't told apart here)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, p in enumerate(powers(size, np.uint64(0xD1342543DE82EF95))):
        out += hashes[k : k + n] * p
    return mix64(out)


def sequence_digest(words: Words, salt: int) -> np.ndarray:
    """One 64-bit digest of each text's sequence of words; 0 for a text without words."""
    n_rows = len(words.first) - 1
    out = np.zeros(n_rows, np.uint64)
    counts = np.diff(words.first)
    some = np.flatnonzero(counts)
    if len(some):
        at = np.arange(len(words)) - np.repeat(words.first[:-1], counts)
        base = mix64(np.array([salt * 2 + 1], np.uint64))[0] | np.uint64(1)
        terms = mix64(words.hashes ^ np.uint64(salt)) * powers(int(counts.max()), base)[at]
        out[some] = mix64(np.add.reduceat(terms, words.first[:-1][some]) ^ counts[some].astype(np.uint64)) | np.uint64(1)
    return out

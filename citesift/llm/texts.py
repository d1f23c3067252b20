"""Words of raw texts as arrays of 64-bit hashes, computed inside Arrow tasks.

A word is a longest run of characters other than space and ``\\t\\n\\v\\f\\r``, which is what
``bytes.split`` separates. Texts are walked in slices cut at white space, so that a very long text
needs eight bytes per word and not one Python object per word at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

WHITE_SPACE = b" \t\n\v\f\r"
SLICE_BYTES = 1 << 20
KNOWN_WORDS = 200_000
SHINGLE_WORDS = 5

_gap = re.compile(rb"[ \t-\r]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


class WordHashes(dict):
    """Hash of each word met; forgets all when it holds ``KNOWN_WORDS``, so a task stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def slices(data: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, never cut inside a word."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            gap = _gap.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[start:end]
        start = end


def word_hashes(data: bytes, known: WordHashes) -> np.ndarray:
    """One hash per word, in order."""
    parts = []
    for piece in slices(data):
        words = piece.split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    values = (values ^ (values >> _SHIFT)) * _MIX_1
    values = (values ^ (values >> _SHIFT)) * _MIX_2
    return values ^ (values >> _SHIFT)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for i in range(width):
        value = value * _FACTOR + hashes[i : i + n]
    return mix(value)


def shingle_set(hashes: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, a text without words has none."""
    if 0 < len(hashes) < width:
        value = np.full(1, len(hashes), np.uint64)
        for h in hashes:
            value = value * _FACTOR + h
        return mix(value)
    found = np.sort(windows(hashes, width))
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found

"""Words of whole texts as NumPy arrays of code points: places, lengths and 64-bit hashes, no Python loop."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The white space that parts words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_POWERS = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit numbers that spreads close ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _MIX)]))
    return _POWERS


#: The hash of every code point.
_CODES = mixed(np.arange(0x110000, dtype=np.uint64) + _MIX)


class Words(NamedTuple):
    codes: np.ndarray  # code points of the text
    inside: np.ndarray  # whether a code point belongs to a word
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray


def _table(chars: tuple[int, ...]) -> np.ndarray:
    table = np.zeros(128, bool)
    table[list(chars)] = True
    return table


_SPACE = _table(SPACES)
#: ASCII that isn't a letter or digit, for tokens without punctuation.
_NO_TOKEN = _table(tuple(c for c in range(128) if not chr(c).isalnum()))


def code_points(text: str, lower: bool = False) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if lower:
        codes = codes + np.uint32(32) * ((codes >= 65) & (codes <= 90))
    return codes


def words(text: str, lower: bool = False, punctuation: bool = True) -> Words:
    """Runs of code points that aren't white space (nor, without ``punctuation``, ASCII signs)."""
    codes = code_points(text, lower)
    table = _SPACE if punctuation else _NO_TOKEN
    inside = ~(table[np.minimum(codes, 127)] & (codes < 128))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return Words(codes, inside, begin, end, np.zeros(0, np.uint64))
    ends = np.concatenate([begin, [len(codes)]])
    places = np.arange(len(codes), dtype=np.int32) - np.repeat(np.concatenate([[0], begin]).astype(np.int32), np.diff(ends, prepend=0))
    parts = _CODES[codes] * _powers(int(places.max()) + 1)[places]
    parts[~inside] = 0
    return Words(codes, inside, begin, end, mixed(np.add.reduceat(parts, begin) + (end - begin).astype(np.uint64)))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n hashes in a row."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = total * _MIX + hashes[k : k + count]
    return mixed(total)

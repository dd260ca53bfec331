"""Sets of word shingles of whole texts as 64-bit hashes, vectorised over slices of an Arrow batch."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import base

_SLICE = 1 << 20  # bytes of text worked on at once; a longer text is cut at blanks
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    up = np.full(n, _PRIME, np.uint64)
    down = np.full(n, np.uint64(pow(int(_PRIME), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of a text or texts laid end to end; A-Z count as a-z."""
    n = len(body)
    up, down = _powers(max(_SLICE, 1 << (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[body] * up[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the text it is in) of texts laid end to end."""
    n = len(body)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ink = ~_BLANK[body]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets[offsets <= n]] = True
    before = np.r_[False, ink[:-1]]
    starts = np.flatnonzero(ink & (~before | fresh[:-1]))
    after = np.r_[ink[1:], False]
    ends = np.flatnonzero(ink & (~after | fresh[1:])) + 1
    h = span_hashes(body, starts, ends)
    return h, np.searchsorted(offsets, starts, "right") - 1


def _slices(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a slice's bytes each."""
    k, n = 0, len(offsets) - 1
    while k < n:
        j = max(k + 1, int(np.searchsorted(offsets, offsets[k] + _SLICE, "right")) - 1)
        yield k, j
        k = j


def cut_at_blanks(part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about a slice's bytes of one long text: each ends after its last blank."""
    at = 0
    while at < len(part):
        end = min(len(part), at + _SLICE)
        if end < len(part):
            blanks = np.flatnonzero(_BLANK[part[at:end]])
            while not len(blanks) and end < len(part):
                end = min(len(part), end + _SLICE)
                blanks = np.flatnonzero(_BLANK[part[at:end]])
            if end < len(part):
                end = at + int(blanks[-1]) + 1
        yield at, end
        at = end


def _cut_words(part: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, slice by slice."""
    out = [word_hashes(part[a:b], np.array([0, b - a]))[0] for a, b in cut_at_blanks(part)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    s = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        s = s * _PRIME + h[k:len(h) - words + 1 + k]
    return mix64(s + np.uint64(words))


def sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes. A text with fewer words has its whole sequence as one; one without words,
    or null, has none."""
    body, offsets = base.utf8_buffer(column)
    for a, b in _slices(body, offsets):
        part, off = body[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        if b - a == 1 and len(part) > _SLICE:
            h, text = _cut_words(part), None
            bounds = np.array([0, len(h)])
        else:
            h, text = word_hashes(part, off)
            bounds = np.searchsorted(text, np.arange(b - a + 1))
        s = _shingles(h, words)
        for i in range(b - a):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi - lo >= words:
                yield np.unique(s[lo:hi - words + 1])
            else:
                yield _shingles(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    total = np.add.reduce(mix64(s ^ _PRIME), dtype=np.uint64) + np.uint64(len(s))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])

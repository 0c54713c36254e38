"""Distinct five-word shingles of whole texts as 64-bit hashes, many documents at a time.

A word hash is a polynomial over random 64-bit byte values, taken from running sums, so no Python
loop runs over words. A shingle hash mixes its words' hashes with their places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shared import text_bytes

SHINGLE = 5
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators for words of letters and digits: all other ASCII. Bytes of other characters are letters.
LETTERS = np.zeros(256, bool)
LETTERS[:128] = [not chr(b).isalnum() for b in range(128)]
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time; a longer word makes its own piece longer.
PIECE = 1 << 17
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, PIECE + 1) - 1, base, np.uint64)]))
        if n <= 4 * PIECE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word; no word runs from one document into the next."""
    n = len(raw)
    solid = ~space[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def prefix_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``length`` bytes of the words that are longer, and the numbers of those words."""
    longer = np.flatnonzero(end - start > length)
    out = np.full(len(longer), length, np.uint64)
    for k in range(length):
        out = (out + _BYTE[raw[start[longer] + k]]) * np.uint64(_BASE)
    return mix(out), longer


def word_hashes(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 offsets of the documents' words among them."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start, end = word_spans(raw, offsets, space)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        a, b = int(start[i]), int(end[j - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[raw[a:b]] * _power(_BASE, b - a), out=sums[1:])
        at = start[i:j] - a
        out[i:j] = mix((sums[end[i:j] - a] - sums[at]) * _power(_INVERSE, b - a)[at])
        i = j
    return out, np.searchsorted(start, offsets)


def place_mix(hashes: np.ndarray, whole: int, words: int = SHINGLE) -> np.ndarray:
    """Hashes of the first ``whole`` runs of ``words`` words."""
    every = np.zeros(whole, np.uint64)
    for k in range(words):
        every += hashes[k : k + whole] * _PLACE[k]
    return mix(every)


def shingle_sets(column: pa.Array, words: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer words than ``words``: the sequence is one; none or null: empty."""
    raw, offsets = text_bytes(column)
    if not len(raw):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    hashes, at = word_hashes(raw, offsets)
    whole = max(0, len(hashes) - words + 1)
    every = place_mix(hashes, whole, words)
    found = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            s = every[a : b - words + 1].copy()
            s.sort()
            found.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            found.append(mix((hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())

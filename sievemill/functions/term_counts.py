"""The terms of texts, as `text.terms` tells them, counted text by text in arrays."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from .text import IDEOGRAPHS, STOPWORDS

#: Letters and numbers, of which words are; signs, of which pairs are.
LETTER, SIGN = 1, 2
#: Code points there are.
POINTS = 0x110000
#: Cells of a table of all pairs and texts, by characters of these, up to which pairs are counted in one; more are counted by sorting.
CELLS = 4


@cache
def _kinds() -> np.ndarray:
    """`LETTER`, `SIGN` or 0 for every code point."""
    kinds = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(POINTS)), np.uint8, POINTS)
    for first, last in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", IDEOGRAPHS):
        kinds[int(first, 16) : int(last, 16) + 1] = SIGN
    return kinds


def _pairs(points: np.ndarray, kinds: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Text, number of the term, terms, times: overlapping pairs of signs, and signs that stand alone."""
    sign = kinds == SIGN
    after, before = np.append(sign[1:], False), np.insert(sign[:-1], 0, False)
    at = np.flatnonzero(sign & (after | ~before))
    known = np.flatnonzero(np.bincount(points[sign], minlength=1))
    number = np.zeros(POINTS, np.int32)
    number[known] = np.arange(1, len(known) + 1)
    n, dense = len(known) + 1, number[points]
    key = (of[at].astype(np.int64) * n + dense[at]) * n + dense[at + 1]
    if texts * n * n <= CELLS * len(points):
        counts = np.bincount(key, minlength=1)
        key = np.flatnonzero(counts)
        times = counts[key]
    else:
        key, times = np.unique(key, return_counts=True)
    codes, which = np.unique(key % (n * n), return_inverse=True)
    sides = ["", *map(chr, known.tolist())]
    return key // (n * n), which, [sides[c // n] + sides[c % n] for c in codes.tolist()], times


def _words(whole: str, kinds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """The same of words: runs of three letters or numbers and more that aren't stopwords."""
    edges = np.flatnonzero(np.diff((kinds == LETTER).astype(np.int8), prepend=0, append=0))
    first, last = edges[::2], edges[1::2]
    long = last - first >= 3
    first, last = first[long], last[long]
    numbers: dict[str, int] = {}
    found = np.array([numbers.setdefault(whole[a:b], len(numbers)) for a, b in zip(first.tolist(), last.tolist())], np.int64)
    key = of[first].astype(np.int64) * max(len(numbers), 1) + found
    stops = [numbers[w] for w in STOPWORDS if w in numbers]
    key, times = np.unique(key[~np.isin(found, stops)], return_counts=True)
    return key // max(len(numbers), 1), key % max(len(numbers), 1), list(numbers), times


def counted(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which text, term, how often: each different term of each text (lower-cased already), the terms of a text side by side."""
    whole = "\0".join([*texts, ""])  # a mark behind each text
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kinds = _kinds()[points]
    of = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    a, b = _pairs(points, kinds, of, len(texts)), _words(whole, kinds, of)
    at = np.concatenate([a[0], b[0]])
    order = np.argsort(at, kind="stable")
    which = np.concatenate([a[1], b[1] + len(a[2])])[order]
    return at[order], pa.array([*a[2], *b[2]], pa.string()).take(pa.array(which, pa.int64())), np.concatenate([a[3], b[3]])[order]

"""Text as it comes out of PDFs: line ends, hyphens, ligatures, single wrong signs."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Signs of a gram. A title is cut into one segment more than it may have errors, each with room for a gram.
GRAM = 8

_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n\s*(?=[^\W\d_])")
_DASHED = {c: "-" for c in "‐‑‒–—−"} | {"­": "", "’": "'", "‘": "'", "“": '"', "”": '"'}
LIGATURES = {c: unicodedata.normalize("NFKC", c) for c in "\uFB00\uFB01\uFB02\uFB03\uFB04\uFB05\uFB06"}


def _wide(text: str) -> str:
    """NFKC of a text with its dashes and quotes as plain ones. A step is taken only where it changes something, as rewriting whole texts is costly; often ligatures are all there is."""
    for sign, plain_sign in _DASHED.items():
        text = text.replace(sign, plain_sign)
    if unicodedata.is_normalized("NFKC", text):
        return text
    for sign, letters in LIGATURES.items():
        text = text.replace(sign, letters)
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def plain(text: str | None) -> str:
    """Ligatures and wide signs as plain ones, words broken at line ends joined, white space one space, lower case."""
    if not text:
        return ""
    whole = text if text.isascii() else _wide(text)
    return " ".join(_BROKEN.sub("", whole).lower().split())


def errors_allowed(n: int, damage: float) -> int:
    """Edits that a title of ``n`` signs may have. Segments must keep room for a gram."""
    allowed = int(n * damage)
    while allowed and n // (allowed + 1) < GRAM:
        allowed -= 1
    return allowed


def gram_codes(text: str) -> np.ndarray:
    """A 64-bit code for the `GRAM` signs from each place of a text."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(signs) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            code = (code ^ signs[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(32)
    return code.view(np.int64)


def segments(n: int, allowed: int) -> list[tuple[int, int]]:
    """Cuts of ``n`` signs into ``allowed`` + 1 parts that don't overlap: that many edits leave one of them whole."""
    edges = [n * k // (allowed + 1) for k in range(allowed + 2)]
    return list(zip(edges, edges[1:]))


def distance_at(title: str, window: str, start: int, allowed: int) -> int:
    """Least number of edits that turn ``title`` into a part of ``window`` beginning within ``allowed`` of ``start``, or ``allowed`` + 1 if it takes more.

    Only a band around the diagonal is filled in: a path outside it has more edits than allowed.
    """
    much = allowed + 1
    if window[start : start + len(title)] == title:
        return 0
    width = 4 * allowed + 1  # columns start - 2*allowed .. start + 2*allowed for the first row, moving along
    low = start - 2 * allowed
    row = [0 if abs(j - 2 * allowed) <= allowed and 0 <= low + j <= len(window) else much for j in range(width)]
    for i, sign in enumerate(title):
        new = [much] * width
        for j in range(width):
            at = low + i + j  # the column before this cell's sign, on the moving band
            best = much
            if 0 <= at < len(window):
                best = row[j] + (window[at] != sign)
            if j + 1 < width:
                best = min(best, row[j + 1] + 1)  # the title's sign is missing in the text
            if j and 0 <= at < len(window) + 1:
                best = min(best, new[j - 1] + 1)  # the text has a sign more
            new[j] = min(best, much)
        row = new
        if min(row) > allowed:
            return much
    return min(row)

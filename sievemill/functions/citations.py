"""Fields of one reference line, by the best path through the fields of each style (Viterbi).

A style is an order of fields. Every token has a score in every field, and every place where one field
may end and the next begin has one too; the labelling with the largest sum wins.
"""

from __future__ import annotations

import re
from typing import NamedTuple

AUTHORS, YEAR, TITLE, JOURNAL, REST = range(5)
NEVER = -1e9
#: A labelling with a smaller sum is no reference. A line of more words is prose.
LEAST, LONGEST = 6.0, 400


class Style(NamedTuple):
    name: str
    fields: tuple[int, ...]
    #: Which places of ``fields`` may follow which, and which may be the last.
    follows: tuple[tuple[int, int], ...]
    last: tuple[int, ...]
    year: re.Pattern


_CHAIN = ((0, 1), (1, 2), (2, 3), (3, 4))
_SPLIT = ((0, 1), (1, 2), (2, 3), (2, 4), (3, 4), (4, 5))
STYLES = (
    Style("apa", (AUTHORS, YEAR, TITLE, JOURNAL, REST), _CHAIN, (3, 4), re.compile(r"\((?:19|20)\d\d[a-z]?\)[.,:;]*$")),
    Style("vancouver", (AUTHORS, TITLE, JOURNAL, YEAR, REST), _CHAIN, (3, 4), re.compile(r"(?:19|20)\d\d(?:[;:.,].*)?$")),
    Style("ieee", (AUTHORS, TITLE, JOURNAL, REST, YEAR, REST), _SPLIT, (4, 5), re.compile(r"(?:19|20)\d\d[.,;]?$")),
    Style("mla", (AUTHORS, TITLE, JOURNAL, REST, YEAR, REST), _SPLIT, (4, 5), re.compile(r"(?:19|20)\d\d[.,:;]?$")),
    Style("chicago", (AUTHORS, YEAR, TITLE, JOURNAL, REST), _CHAIN, (3, 4), re.compile(r"(?:19|20)\d\d[a-z]?\.$")),
)

# Small words of names and of titles, and what tells of volumes and pages.
CONNECTORS = frozenset("and & et al al. et. al., van von der den de di da la le du del dos y und bin ibn".split())
SMALL = frozenset("a an and at by for from in into of on or the to with & und der die das für et de la le du des y del los las".split())
VOLUME = re.compile(r"(?i)(?:vol|no|pp?|art|issue|suppl|doi|https?|pmid|available|accessed|epub|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b")
NUMBER = re.compile(r"(?:\[\d+\]|\(?\d{1,4}[.)])\s+")
INITIALS = re.compile(r"(?:[A-ZÀ-ÞΑ-ΩА-Я]\.?-?){1,3}[.,;]*$")
DOTTED = re.compile(r"(?:[^\W\d_]\.){2,}[,\"”]*$|(?:Dr|St|Mr|Mrs|vs|No|Inc|Ltd|etc|cf|approx|ca)\.$")
OPENING, CLOSING = "\"“„«", "\"”“»"
DOI_TOKEN = re.compile(r"(?i)(?:doi:|https?://|10\.\d{4,9}/)")


def tokens_of(line: str) -> list[str]:
    """Words of a line without its number."""
    line = line.strip()
    found = NUMBER.match(line)
    return (line[found.end() :] if found else line).split()


def _capital(word: str) -> bool:
    bare = word.lstrip("\"“„«('[")
    return bool(bare) and (bare[0].isupper() or (bare[0].isalpha() and not bare[0].islower()))


def emissions(words: list[str]) -> list[tuple[float, ...]]:
    """For each token its score as part of the authors, title, journal and rest, in the order of the field numbers; years are a matter of the style."""
    found = []
    for word in words:
        bare, digits = word.strip(".,;:()[]"), any(c.isdigit() for c in word)
        lower, capital = bare.lower(), _capital(word)
        link = DOI_TOKEN.match(word) is not None
        quoted = word[:1] in OPENING or word[-1:] in CLOSING
        authors = -4.0 if link or quoted or re.search(r"\d{4}", word) else 0.5 if capital or lower in CONNECTORS or word in CONNECTORS else -1.5
        title = -4.0 if link else -1.0 if re.fullmatch(r"\(?(?:19|20)\d\d[a-z]?\)?[.,;]?", word) else 0.1
        journal = -4.0 if link else -0.8 if VOLUME.match(word) else 0.0 if bare.isdigit() and len(bare) < 4 else -1.0 if digits else 0.3 if capital else 0.0 if lower in SMALL else -0.4
        rest = 0.5 if link or digits or VOLUME.match(word) else -0.2
        found.append((authors, 0.0, title, journal, rest))
    return found


def boundary(style: Style, left: int, right: int, words: list[str], i: int) -> float:
    """Score of field ``right`` beginning after token ``i``, the last one of ``left``."""
    before, after = words[i], words[i + 1]
    stop = before.rstrip("\"”»").endswith((".", "?", "!"))
    if right == YEAR or left == YEAR:
        if style.name == "vancouver" and left == JOURNAL:
            return 1.0 if before.endswith((".", ";")) else 0.0 if before.endswith(",") else -2.0
        if style.name == "chicago" and right == YEAR:
            return 0.5 if before.endswith((".", ",")) else -0.5
        if style.name in ("ieee", "mla") and right == YEAR:
            return 0.5 if before.endswith((",", ".")) else -1.0
        return 1.0 if style.name in ("apa", "chicago") and left == YEAR and before.endswith((".", ",")) else 0.5
    if left == AUTHORS:
        opened = after[:1] in OPENING
        if style.name == "ieee":
            return 3.0 if before.endswith(",") and opened else -6.0
        if style.name == "mla":
            return 3.0 if stop and opened else -6.0
        # Initials stand without full stops here, so a full stop is the end of the authors.
        return (2.0 if INITIALS.match(before) else 0.5) if stop and not opened and not INITIALS.fullmatch(after) else -6.0
    if left == TITLE:
        closed = before[-1:] in CLOSING or before[-2:-1] in CLOSING
        if style.name == "ieee":
            return 3.0 if closed and "," in before[-2:] else -6.0
        if style.name == "mla":
            return 3.0 if closed and "." in before[-2:] else -6.0
        if not stop:
            return -6.0
        return (0.0 if DOTTED.search(before) else 2.0) + (0.5 if _capital(after) else -2.0)
    # Journal to the volume and whatever follows.
    if before.endswith(","):
        return 1.0
    if before.endswith("."):
        return 0.5 if DOTTED.search(before) is None else -0.5
    # Only here a volume follows without a comma; elsewhere a number is part of the name.
    return 0.5 if style.name == "chicago" and after[:1].isdigit() or VOLUME.match(after) else -2.0


def best_path(style: Style, words: list[str], scores: list[tuple[float, ...]] | None = None) -> tuple[float, list[int]]:
    """The largest sum for a style, and for each token its place in the style's fields. Equal sums stay in the earlier field longer."""
    n, k = len(words), len(style.fields)
    # Every path of every style goes through its year.
    if not any(style.year.match(w) for w in words):
        return NEVER, []
    scores = emissions(words) if scores is None else scores
    emit = lambda i, f: scores[i][f] if f != YEAR else (2.0 if style.year.match(words[i]) else NEVER)
    before: list[list[int]] = [[] for _ in range(k)]
    for a, b in style.follows:
        before[b].append(a)
    row = [NEVER] * k
    row[0] = emit(0, style.fields[0])
    back: list[list[int]] = []
    for i in range(1, n):
        new, came = [NEVER] * k, [-1] * k
        for s, field in enumerate(style.fields):
            own = emit(i, field)
            if own <= NEVER:
                continue
            best, of = (row[s], s) if field != YEAR else (NEVER, -1)
            for a in before[s]:
                if row[a] > NEVER / 2:
                    value = row[a] + boundary(style, style.fields[a], field, words, i - 1)
                    if value > best:
                        best, of = value, a
            if best > NEVER / 2:
                new[s], came[s] = best + own, of
        row = new
        back.append(came)
    end = max(style.last, key=lambda s: (row[s], -s))
    if row[end] <= NEVER / 2:
        return NEVER, []
    path = [end]
    for came in reversed(back):
        path.append(came[path[-1]])
    return row[end], path[::-1]


class Reference(NamedTuple):
    score: float
    author: str | None
    year: int | None
    title: str | None
    journal: str | None


def first_author(text: str) -> str | None:
    """Surname of the first author, or the whole name of a body."""
    name = re.split(r",|;|\s+(?:et\.?\s+al\b\.?|and|&|und|y)(?:\s+|$)", text.strip(), maxsplit=1)[0]
    words = name.strip(" .").split()
    while len(words) > 1 and INITIALS.fullmatch(words[-1]) and not words[0].endswith("."):
        words.pop()
    while len(words) > 1 and re.fullmatch(r"(?:\w\.-?){1,3}", words[0]):
        words.pop(0)
    return " ".join(words) or None


def read_line(line: str) -> list[Reference]:
    """What each style makes of a line, in the order of `STYLES`; a score under `LEAST` says that it makes nothing of it."""
    words = tokens_of(line)
    if not words or len(words) > LONGEST:
        return [Reference(NEVER, None, None, None, None)] * len(STYLES)
    scores, found = emissions(words), []
    for style in STYLES:
        score, path = best_path(style, words, scores)
        if score < LEAST:
            found.append(Reference(max(score, NEVER), None, None, None, None))
            continue
        part = lambda f: " ".join(w for w, s in zip(words, path) if style.fields[s] == f)  # noqa: E731, B023
        year = re.search(r"(?:19|20)\d\d", part(YEAR))
        title = part(TITLE).strip(OPENING + CLOSING + " ").rstrip(",").strip(OPENING + CLOSING)
        title = title if DOTTED.search(title) else title.rstrip(".")
        found.append(Reference(score, first_author(part(AUTHORS)), int(year[0]) if year else None, title or None, part(JOURNAL).rstrip(" .,;:") or None))
    return found

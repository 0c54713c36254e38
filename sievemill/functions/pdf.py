"""Structure of a PDF by its bytes: header, end, cross-reference tables, and whether objects lie where these say."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Bytes at the beginning and at the end in which header and end mark may stand.
EDGE = 1024

_VERSION = re.compile(rb"%PDF-(\d\.\d)")
_START = re.compile(rb"startxref\s+(\d+)\s+%%EOF")
_SECTION = re.compile(rb"\s*(\d+)\s+(\d+)[ \t]*\r?\n?")
_ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([nf])[ \r]?[\r\n]?\n?")
_OBJECT = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b")
_PREVIOUS = re.compile(rb"/(?:Prev|XRefStm)\s+(\d+)")
_MARKUP = re.compile(rb"\s*(?:\xef\xbb\xbf)?\s*<(?:!doctype\s+html|html|head|body|\?xml)", re.I)


class Structure(NamedTuple):
    """state: sound, empty, html, not_pdf, truncated (its end is missing) or damaged (its end doesn't lead to its objects)."""

    state: str
    version: str | None
    objects: int
    misplaced: int


def structure(content: bytes | None) -> Structure:
    """What a file's bytes are. A null counts as empty.

    Of tables all entries in use are looked up; tables kept as streams are looked for, but not unpacked.
    """
    if not content:
        return Structure("empty", None, 0, 0)
    found = _VERSION.search(content[:EDGE])
    if found is None:
        return Structure("html" if _MARKUP.match(content[:EDGE]) else "not_pdf", None, 0, 0)
    version = found[1].decode()
    origin = found.start()  # offsets count from the header, also where something stands before it
    ends = list(_START.finditer(content, max(len(content) - EDGE, 0)))
    if not ends:
        return Structure("truncated", version, 0, 0)
    todo, seen, objects, misplaced, rooted = [int(ends[-1][1])], set(), 0, 0, False
    while todo:
        at = todo.pop() + origin
        if at in seen:
            continue
        seen.add(at)
        if at >= len(content):
            return Structure("truncated", version, objects, misplaced)
        table = re.compile(rb"\s*xref\s").match(content, at)
        if table is None:
            # A table kept as a stream is an object that says so.
            end = content.find(b"stream", at)
            if _OBJECT.match(content, at) is None or b"/XRef" not in content[at : end if end >= 0 else at + EDGE]:
                return Structure("damaged", version, objects, misplaced + 1)
            head = content[at : end if end >= 0 else at + EDGE]
            objects += 1
        else:
            place = table.end()
            while section := _SECTION.match(content, place):
                number, entries = int(section[1]), int(section[2])
                place = section.end()
                for k in range(entries):
                    entry = _ENTRY.match(content, place)
                    if entry is None:
                        return Structure("damaged", version, objects, misplaced + 1)
                    place = entry.end()
                    if entry[3] == b"n":
                        objects += 1
                        stands = _OBJECT.match(content, int(entry[1]) + origin)
                        misplaced += stands is None or int(stands[1]) != number + k or int(stands[2]) != int(entry[2])
            end = content.find(b"startxref", place)
            head = content[place : end if end >= 0 else len(content)]
            if b"trailer" not in head:
                return Structure("damaged", version, objects, misplaced + 1)
        rooted |= b"/Root" in head
        todo += [int(x) for x in _PREVIOUS.findall(head)]
    return Structure("sound" if rooted and not misplaced and objects else "damaged", version, objects, misplaced)

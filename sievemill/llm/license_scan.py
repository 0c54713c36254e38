"""License scans by MinHash bands over overlapping windows of text.

Words are runs of ASCII letters and digits and of any other letters, A-Z lower-cased. A template of m
distinct five-word shingles is looked for in windows of m + s - 1 shingles that start every s = m // 4,
so that any m shingles in a row lie in one window. A window that holds three quarters of a template has
a Jaccard similarity of at least 0.75 m / (m + s - 1 + 0.25 m), which is over 0.5. With bands of one
minimum, 24 of them all miss it with probability under 2^-24. Templates that share a band with a window
are then measured exactly: the share of their shingles in the window and half a template beside it.
Windows are laid only over texts with enough shingles of templates of that size, which loses none.

A place found must hold the phrases that tell a template from its kin. Of templates that overlap at
one place, the one with most shingles there is reported, and of equal ones that with the larger share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_templates import Template, licenses
from .minhash import _slices
from .shared import arrow_map, spread, text_bytes
from .shingles import LETTERS, SHINGLE, mix, place_mix, word_hashes

BANDS = 24
CONTAINED = 0.75
#: The tag by which a source file names its license, and its expression.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)")
_ODD = np.random.Generator(np.random.PCG64(23)).integers(1, 2**31, BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

# A short table of wordings, held against an exact scan. The whole one is `licenses`.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


_WORD = re.compile(rb"(?:[a-z0-9]|[\x80-\xff])+")


def _words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode(errors="surrogatepass").lower())


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in order of place over all texts, and the n + 1 offsets of the texts' shingles."""
    hashes, at = word_hashes(*text_bytes(column), LETTERS)
    whole = max(0, len(hashes) - SHINGLE + 1)
    every = place_mix(hashes, whole)
    first, last = at[:-1], np.maximum(at[1:] - SHINGLE + 1, at[:-1])
    keep = np.zeros(whole + 1, np.int64)
    np.add.at(keep, np.minimum(first, whole), 1)
    np.add.at(keep, np.minimum(last, whole), -1)
    return every[np.cumsum(keep[:whole]) > 0], np.concatenate([[0], np.cumsum(last - first)])


class Scanner:
    """Templates by their number of shingles, with the band table of each number."""

    def __init__(self, templates: Mapping[str, str | Template], contained: float = CONTAINED):
        self.names, self.contained = sorted(templates), contained
        full = [t if isinstance(t, Template) else Template(t) for t in (templates[n] for n in self.names)]
        self.phrases = [tuple([b" " + b" ".join(_words(p)) + b" " for p in part] for part in (t.needs, t.bars)) for t in full]
        every, at = _shingles(pa.array([t.text for t in full]))
        self.sets = [np.unique(every[a:b]) for a, b in zip(at[:-1], at[1:])]
        short = [n for n, s in zip(self.names, self.sets) if not len(s)]
        if short:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.groups: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            self.groups.setdefault(len(s), []).append(k)
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.indices = [frozenset(np.searchsorted(self.known, x).tolist()) for x in self.sets]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known >> np.uint64(44)] = True
        self.member = {m: np.isin(self.known, np.concatenate([self.sets[k] for k in members])) for m, members in self.groups.items()}
        self.tables = {}
        for m, members in self.groups.items():
            for j in range(BANDS):
                least = np.array([((self.sets[k] >> np.uint64(32)).astype(np.uint32) * _ODD[j]).min() for k in members])
                seen = np.zeros(1 << 16, bool)
                seen[least >> np.uint32(16)] = True
                self.tables[m, j] = (seen, least, np.array(members))

    def candidates(self, keys: np.ndarray, m: int) -> set[tuple[int, int]]:
        """(start of a window, template) of the windows that share a band with a template of m shingles."""
        step = max(1, m // 4)
        width = m + step - 1
        found: set[tuple[int, int]] = set()
        for j in range(BANDS):
            least = keys * _ODD[j]
            span = 1
            while span < width:  # windows twice as wide each time; a cut window at the end keeps what it has
                more = min(span, width - span)
                if more < len(least):
                    np.minimum(least[:-more], least[more:].copy(), out=least[:-more])
                span += more
            least = least[::step]
            seen, mins, members = self.tables[m, j]
            for i in np.flatnonzero(seen[least >> np.uint32(16)]).tolist():
                found.update((i * step, int(k)) for k in members[mins == least[i]])
        return found

    def places(self, column: pa.Array) -> list[list[tuple[int, int, int, int]]]:
        """(template, shingles held, first and last of their places) for each text; a template may have several places."""
        every, at = _shingles(column)
        out: list[set[tuple[int, int, int, int]]] = [set() for _ in range(len(at) - 1)]
        hits = np.flatnonzero(self.maybe[every >> np.uint64(44)])
        which = np.minimum(np.searchsorted(self.known, every[hits]), max(0, len(self.known) - 1))
        true = self.known[which] == every[hits] if len(hits) else np.zeros(0, bool)
        hits, which = hits[true], which[true]
        owner = np.searchsorted(at, hits, "right") - 1
        ends = np.searchsorted(owner, np.arange(len(out) + 1))
        whole: dict[int, frozenset[int]] = {}
        for m in self.groups:
            docs = np.flatnonzero(np.bincount(owner[self.member[m][which]], minlength=len(out)) >= self.contained * m)
            if not len(docs):
                continue
            held_at = np.concatenate([[0], np.cumsum(at[docs + 1] - at[docs])])
            texts = np.concatenate([every[at[d] : at[d + 1]] for d in docs])
            for d in docs.tolist():
                if d not in whole:
                    whole[d] = frozenset(which[ends[d] : ends[d + 1]].tolist())
            enough = {(n, k) for n, d in enumerate(docs.tolist()) for k in self.groups[m] if len(whole[d] & self.indices[k]) >= self.contained * m}
            step = max(1, m // 4)
            for start, k in self.candidates((texts >> np.uint64(32)).astype(np.uint32), m):
                # A window may run on into the next text; each text in it is measured alone.
                first = int(np.searchsorted(held_at, start, "right")) - 1
                last = int(np.searchsorted(held_at, min(start + m + step - 1, len(texts)), "left"))
                for n in range(first, last):
                    if (n, k) not in enough:
                        continue
                    a = max(int(held_at[n]), start - m // 2)
                    b = min(int(held_at[n + 1]), start + m + step + m // 2)
                    at_hit = np.flatnonzero(np.isin(texts[a:b], self.sets[k]))
                    share, span = self._span(texts[a:b][at_hit], at_hit)
                    if share >= self.contained * m:
                        out[docs[n]].add((k, share, *(a - int(held_at[n]) + x for x in span)))
        return [sorted(x) for x in out]

    @staticmethod
    def _span(held: np.ndarray, at: np.ndarray) -> tuple[int, tuple[int, int]]:
        """Number of distinct shingles, and the ends of the shortest run that holds them all."""
        values, kind = np.unique(held, return_inverse=True)
        if len(values) == len(held):
            return len(values), (int(at[0]), int(at[-1])) if len(at) else (0, 0)
        seen, missing, low, best = [0] * len(values), len(values), 0, (int(at[0]), int(at[-1]))
        kind, at = kind.tolist(), at.tolist()
        for high, x in enumerate(kind):
            missing -= not seen[x]
            seen[x] += 1
            while not missing:
                if at[high] - at[low] < best[1] - best[0]:
                    best = (at[low], at[high])
                seen[kind[low]] -= 1
                missing += not seen[kind[low]]
                low += 1
        return len(values), best

    def scan(self, column: pa.Array) -> list[list[tuple[str, int, float]]]:
        """(template, place of its first shingle found, share contained) for each text, by template; the best place of each."""
        out = []
        for found in self.places(column):
            best: dict[int, tuple[int, int]] = {}
            for k, held, first, _ in found:
                best[k] = min(best.get(k, (0, 0)), (-held, first))
            out.append([(self.names[k], first, -held / len(self.sets[k])) for k, (held, first) in sorted(best.items())])
        return out

    def told_apart(self, column: pa.Array) -> list[list[tuple[str, int, float]]]:
        """As `scan`, but only places with the needed phrases, one template at a place, and one row for all wordings of a key."""
        out = []
        for row, found in enumerate(self.places(column)):
            words = _words(column[row].as_py()) if found else []
            fit = []
            for k, held, first, last in found:
                near = b" " + b" ".join(words[max(0, first - SHINGLE + 1) : last + 2 * SHINGLE - 1]) + b" "
                needs, bars = self.phrases[k]
                if all(p in near for p in needs) and not any(p in near for p in bars):
                    fit.append((-held, -held / len(self.sets[k]), first, last + SHINGLE, self.names[k].split("~")[0]))
            taken: list[tuple[int, int]] = []
            best: dict[str, tuple[float, int]] = {}
            for _, share, first, end, name in sorted(fit):
                if all(end <= a or first >= b for a, b in taken):
                    taken.append((first, end))
                    best[name] = min(best.get(name, (0.0, 0)), (share, first))
            out.append([(n, place, -share) for n, (share, place) in sorted(best.items())])
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str | Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License templates in every whole text, one row per row: ``doc_id, n_licenses, licenses, places, contained, spdx``.

    licenses: names of the templates (those of `licenses`, if none are given) of whose five-word
    shingles the text holds at least three quarters close together, with the phrases the template
    needs, in order, joined by commas, empty if there are none. Of overlapping ones the best is named. places and contained
    list, in the same order, the word at which the best match starts and the share of shingles it
    holds. spdx lists the expressions of SPDX tags, which are too short for shingles, in order and as they
    stand. Null and empty texts hold nothing. Repeated rows and null ids get their answer; other
    columns play no part. An empty table gives an empty one. The templates go to the tasks with the
    code; their number is that of the licenses known, not of the data.
    """
    templates = dict(licenses() if templates is None else templates)
    Scanner(templates)  # fails early on a template that is too short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        scanner = Scanner(templates)
        for batch in batches:
            for part in _slices(batch, 1):
                found = scanner.told_apart(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(n for n, _, _ in x) for x in found], pa.string()),
                        pa.array([[p for _, p, _ in x] for x in found], pa.list_(pa.int64())), pa.array([[c for _, _, c in x] for x in found], pa.list_(pa.float64())),
                        pa.array([SPDX.findall(t or "") for t in part.column(1).to_pylist()], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_licenses", "licenses", "places", "contained", "spdx"],
                )

    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_licenses long, licenses string, places array<long>, contained array<double>, spdx array<string>")

"""Titles found in damaged texts: grams that survive the damage lead to places, edit distance decides there.

A title that may have k errors is cut into k + 1 segments, of which k edits leave one whole. Of every
segment the gram that is rarest in the texts goes into the index. Texts are scanned once for these
grams; each place where one stands comes with the text around it, so nothing has to be joined back.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.damage import GRAM, distance_at, errors_allowed, gram_codes, plain, segments
from ..sources.tables import spread
from ..storage import stored
from ..tasks import arrow_map

#: Errors that a title may have, as a share of its signs.
DAMAGE = 0.05
#: Cells of the map by which texts are scanned; the driver makes it of as many numbers at most.
CELLS = 1 << 22
#: Titles' grams that go to every task at a time, in rows and in signs of titles; more are met in blocks, each a pass over the places found.
BLOCK_ROWS, BLOCK_SIGNS = 100_000, 16 << 20
#: Places of grams that a task holds while it counts.
HELD = 1_000_000


def _cells(codes: np.ndarray) -> np.ndarray:
    return (codes.view(np.uint64) >> np.uint64(64 - 22)).astype(np.int64)


def _title_grams(damage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for title in batch.column(0).to_pylist():
                if len(title) >= GRAM:
                    codes, allowed = gram_codes(title), errors_allowed(len(title), damage)
                    for part, (a, b) in enumerate(segments(len(title), allowed)):
                        out += [(title, allowed, part, a, b, at, int(codes[at])) for at in range(a, b - GRAM + 1)]
            columns = [*zip(*out)] if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), *[pa.int32()] * 5, pa.int64()))], ["title", "allowed", "part", "start", "stop", "at", "gram"])

    return run


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as `plain` makes them. Nulls go here: a filter outside would make Spark derive each text twice."""
    import pyarrow.compute as pc

    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain(t) for t in batch.column(1).to_pylist()], pa.string())], batch.schema.names)


def _marks(cells: np.ndarray) -> np.ndarray:
    marks = np.zeros(CELLS, bool)
    marks[cells] = True
    return marks


def _counts(held):
    """How often each marked gram stands in some texts: a row a gram for every `HELD` places, or for a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = held.value
        for batch in batches:
            some: list[np.ndarray] = []
            n, texts = 0, batch.column(1).to_pylist()
            for k, text in enumerate(texts):
                codes = gram_codes(text)
                some.append(codes[marks[_cells(codes)]])
                n += len(some[-1])
                if k + 1 == len(texts) or n >= HELD:
                    grams, times = np.unique(np.concatenate(some), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(times)], ["gram", "times"])
                    some, n = [], 0

    return run


def _places(held, reach: int):
    """Places of marked grams in each text, with the text around."""

    def rows_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (kind, pa.int64(), pa.int32(), pa.string()))], ["doc_id", "gram", "place", "around"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = held.value
        for batch in batches:
            kind, rows = batch.schema.field(0).type, []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = gram_codes(text)
                for p in np.flatnonzero(marks[_cells(codes)]).tolist():
                    low = max(p - reach, 0)
                    rows.append((doc, int(codes[p]), p - low, text[low : p + reach + GRAM]))
                    if len(rows) >= 2_000:
                        yield rows_of(rows, kind)
                        rows = []
            if rows:
                yield rows_of(rows, kind)

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits at each place where not only the gram but its whole segment stands: some segment of every title that is found does."""
    for batch in batches:
        docs, titles, found = [], [], []
        for doc, place, around, title, allowed, a, b, at in zip(*(batch.column(k).to_pylist() for k in range(8))):
            low = place - (at - a)
            if low < 0 or not around.startswith(title[a:b], low):
                continue
            n = distance_at(title, around, place - at, allowed)
            if n <= allowed:
                docs.append(doc)
                titles.append(title)
                found.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(titles, pa.string()), pa.array(found, pa.int32())], ["doc_id", "title", "edits"])


def damaged_titles(texts: DataFrame, titles: DataFrame, damage: float = DAMAGE) -> DataFrame:
    """``doc_id, item_id, edits``: the texts that hold a title with at most ``damage`` times its signs in errors, and the fewest errors.

    texts: ``doc_id, text``; titles: ``item_id, title``. Both are taken as `plain` makes them, so line
    ends, hyphens there and ligatures are no errors. The search is exact: it finds what comparing every
    title with every place would. Null titles, and those under `GRAM` signs, are found nowhere; null texts hold
    nothing. Titles that are equal when plain share a search. Rows that repeat an id count together.
    A gram's text around is as long as the longest title to each side.
    """
    spark = texts.sparkSession
    kind, item = texts.schema["doc_id"].dataType.simpleString(), titles.schema["item_id"].dataType.simpleString()
    named = stored(arrow_map(titles.select("item_id", "title"), _plain, f"item_id {item}, title string"), "titles")
    longest = named.agg(F.max(F.length("title"))).first()[0] or 0
    every = stored(arrow_map(named.select("title").distinct(), _title_grams(damage), "title string, allowed int, part int, start int, stop int, at int, gram long"), "grams")
    cell = lambda rows: np.array([r[0] for r in rows.select(F.shiftrightunsigned("gram", 64 - 22)).distinct().collect()], np.int64)
    clean = stored(arrow_map(spread(texts.select("doc_id", "text")), _plain, f"doc_id {kind}, text string"), "plain")
    counted = arrow_map(clean, _counts(spark.sparkContext.broadcast(_marks(cell(every)))), "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    rarest = every.join(counted, "gram", "left").groupBy("title", "allowed", "part", "start", "stop").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "at", "gram")).alias("least"))
    # A segment whose rarest gram stands nowhere can't be the whole one.
    chosen = stored(rarest.where("least.times > 0").select("title", "allowed", "start", "stop", "least.at", "least.gram"), "rarest")
    reach = longest + 2 * errors_allowed(longest, damage)
    places = stored(arrow_map(clean, _places(spark.sparkContext.broadcast(_marks(cell(chosen))), reach), f"doc_id {kind}, gram long, place int, around string"), "places")
    rows, signs = chosen.agg(F.count(F.lit(1)), F.sum(F.length("title"))).first()
    blocks, found = max(1, ceil(rows / BLOCK_ROWS), ceil((signs or 0) / BLOCK_SIGNS)), None
    for k in range(blocks):
        side = F.broadcast(chosen.where(F.pmod(F.xxhash64("title"), F.lit(blocks)) == k))
        met = places.join(side, "gram").select("doc_id", "place", "around", "title", "allowed", "start", "stop", "at")
        part = arrow_map(met, _checked, f"doc_id {kind}, title string, edits int")
        found = part if found is None else found.unionByName(part)
    least = found.groupBy("doc_id", "title").agg(F.min("edits").alias("edits"))
    return least.join(named, "title").select("doc_id", "item_id", "edits").groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))

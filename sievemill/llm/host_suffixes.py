"""Long texts that repeat across the pages of a host, by a suffix array over the token streams of its pages.

A stream is a page's tokens with a mark between blocks. Its suffixes are sorted, by host, in ranges cut
anywhere, so a host of any size spreads; neighbours that begin alike and come from different pages are
repeats, and how far they agree is how much of the stream they cover. The array is sparse: it holds the
suffixes that start a block and those whose first tokens have the least hash among their neighbours, which
choose the same places in equal texts. Suffixes whose first tokens no other page of the host has agree with none and
are told by a hash of these before any is written or sorted. Sorting to a depth beyond the longest gap between these covers repeats of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, join_keyed, stored

#: Tokens of a stream that stand for the beginning of a block and for text that is left out.
MARK, CUT = 1, 0
#: Tokens (marks count) from which a repeat is long; tokens to which suffixes are sorted; starts among which the least is chosen.
LONG, DEPTH, GAP = 6, 14, 8
#: Suffixes of a range; rows of a range up to which it isn't worth while to have more.
RANGE_ROWS, FEW_ROWS = 250_000, 20_000
#: Beginnings on several pages up to which they go to every task, at eight bytes each.
BROADCAST_GRAMS = 8_000_000


def stream(blocks: list[str | None]) -> np.ndarray:
    """Tokens of a page as numbers: a mark, then the words of a block; a None is text left out. Marks stand before that and at the end too."""
    found: list[int] = []
    for text in blocks:
        if text is None:
            found += [MARK, CUT]
        else:
            found.append(MARK)
            found.extend(max(crc32(w.encode()), 2) for w in text.split())
    return np.array([*found, MARK] if found else [], np.uint32)


def _mixed(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the `LONG` tokens from each place, and which of them go over no text that is left out."""
    windows = np.lib.stride_tricks.sliding_window_view(tokens, LONG)
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(windows), np.uint64)
        for k in range(LONG):
            mixed = (mixed ^ windows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return mixed, ~(windows == CUT).any(axis=1)


def starts(tokens: np.ndarray) -> np.ndarray:
    """Places of a stream whose suffixes go into the array."""
    return _chosen(tokens, *_mixed(tokens)) if len(tokens) >= LONG else np.zeros(0, np.int64)


def _chosen(tokens: np.ndarray, mixed: np.ndarray, whole: np.ndarray) -> np.ndarray:
    n, mixed = len(mixed), mixed.copy()
    mixed[~whole] = np.iinfo(np.uint64).max
    padded = np.concatenate([mixed, np.full(GAP - 1, np.iinfo(np.uint64).max)])
    least = np.lib.stride_tricks.sliding_window_view(padded, GAP).argmin(axis=1) + np.arange(n)
    chosen = np.zeros(n, bool)
    chosen[least[least < n]] = True
    return np.flatnonzero((chosen | (tokens[:n] == MARK)) & whole)


def _beginnings(host: int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`starts` of a stream, and a hash of the host and the first tokens there."""
    if len(tokens) < LONG:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed, whole = _mixed(tokens)
    places = _chosen(tokens, mixed, whole)
    with np.errstate(over="ignore"):
        grams = (mixed[places] ^ np.int64(host).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
    return places, grams.view(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different beginnings of each stream, twice where pages with different texts have it."""
    for batch in batches:
        host, tokens, low, high = (batch.column(k).to_pylist() for k in range(4))
        found = [np.zeros(0, np.int64)]
        for at in range(len(host)):
            own = np.unique(_beginnings(host[at], np.frombuffer(tokens[at], np.uint32))[1])
            found += [own] * (1 + (low[at] != high[at]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["gram"])


SUFFIX = "key binary, stream long, place int, low long, high long, gram long"


def _suffixes(held):
    """Chosen suffixes of each stream: host and the next tokens, big-endian, so that bytes sort as they do. Past a cut or the end, zeros. held: sorted beginnings that several pages have, if they are few."""

    names, width = [f.split()[0] for f in SUFFIX.split(", ")], 8 + 4 * DEPTH

    def made(parts: list[tuple]) -> pa.RecordBatch:
        rows, host, *others = (np.concatenate(c) for c in zip(*parts))
        rows[np.maximum.accumulate(rows == CUT, axis=1)] = CUT
        keys = np.concatenate([host.astype(">i8").view(np.uint8).reshape(-1, 8), rows.astype(">u4").view(np.uint8)], axis=1)
        offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes())
        key = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(keys.tobytes())])
        return pa.RecordBatch.from_arrays([key, *map(pa.array, others)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, of, tokens, low, high = (batch.column(k).to_pylist() for k in range(5))
            parts, n = [], 0
            for at in range(len(of)):
                own = np.frombuffer(tokens[at], np.uint32)
                places, grams = _beginnings(host[at], own)
                if held is not None and len(places):
                    known = held.value
                    among = np.searchsorted(known, grams)
                    kept = known[np.minimum(among, len(known) - 1)] == grams if len(known) else np.zeros(len(grams), bool)
                    places, grams = places[kept], grams[kept]
                if not len(places):
                    continue
                padded = np.concatenate([own, np.zeros(DEPTH, np.uint32)])
                for cut in range(0, len(places), 50_000):
                    some = places[cut : cut + 50_000]
                    full = [np.full(len(some), x, np.int64) for x in (host[at], of[at], low[at], high[at])]
                    parts.append((padded[some[:, None] + np.arange(DEPTH)], full[0], full[1], some.astype(np.int32), full[2], full[3], grams[cut : cut + 50_000]))
                    n += len(some)
                    if n >= 50_000:
                        yield made(parts)
                        parts, n = [], 0
            if parts:
                yield made(parts)

    return run


#: Rows of one suffix: how far it agrees with another page's, and its key where that may be further beyond the range. Rows of a range's edge: a beginning that may go on there, and the pages that have it.
NEIGHBOUR = "stream long, place int, agrees int, key binary, begins binary, low long, high long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes of one range: for each depth, runs of equal beginnings, and whether a run has different pages."""
    table = pa.Table.from_batches(list(batches))
    n = table.num_rows
    if not n:
        return
    column = table.column(0).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    width = 8 + 4 * DEPTH
    raw = np.frombuffer(column.buffers()[2], np.uint8)[column.offset * width : (column.offset + n) * width].reshape(n, width)
    tokens = np.concatenate([raw[:, :8].view(">u8"), raw[:, 8:].copy().view(">u4").astype(np.uint64)], axis=1)
    low, high = (table.column(k).to_numpy() for k in (3, 4))
    same = tokens[1:] == tokens[:-1]
    alike = np.concatenate([[0], np.where(same.all(axis=1), DEPTH + 1, same.argmin(axis=1))]) - 1  # tokens shared with the row above
    alike[0] = -1
    ends = np.where((tokens[:, 1:] == CUT).any(axis=1), (tokens[:, 1:] == CUT).argmax(axis=1), DEPTH)
    agrees, open_to = np.zeros(n, np.int32), np.zeros(n, np.int32)
    edge: dict[bytes, tuple[int, int]] = {}
    for depth in range(LONG, DEPTH + 1):
        first = np.flatnonzero(alike < depth)
        of = np.cumsum(alike < depth) - 1
        lows, highs = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        long_enough = ends >= depth
        agrees[long_enough & (lows != highs)[of]] = depth
        for run, row in ((0, 0), (len(first) - 1, n - 1)):
            if ends[row] >= depth:
                edge[raw[row, : 8 + 4 * depth].tobytes()] = (int(lows[run]), int(highs[run]))
                open_to[(of == run) & long_enough] = depth
    keep, far = agrees > 0, open_to > agrees
    rows = np.flatnonzero(keep | far)
    keys = pa.array([raw[k].tobytes() if far[k] else None for k in rows], pa.binary())
    none = pa.nulls(len(rows), pa.int64())
    names = [f.split()[0] for f in NEIGHBOUR.split(", ")]
    yield pa.RecordBatch.from_arrays([table.column(1).take(pa.array(rows)).combine_chunks(), table.column(2).take(pa.array(rows)).combine_chunks(), pa.array(agrees[rows]), keys, pa.nulls(len(rows), pa.binary()), none, none], names)
    m = len(edge)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(list(edge), pa.binary()), pa.array([x[0] for x in edge.values()], pa.int64()), pa.array([x[1] for x in edge.values()], pa.int64())],
        names,
    )


def agreements(streams: DataFrame) -> DataFrame:
    """``stream, place, agrees``: suffixes whose first ``agrees`` tokens stand on another page of the host too.

    streams: ``host, stream, tokens, low, high``, one row a different stream of a host; low and high: the
    least and largest hash of the pages that have it, so two different ones make all of it a repeat.
    """
    spark = streams.sparkSession
    grams = arrow_map(streams.select("host", "tokens", "low", "high"), _grams, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(grams.where("n > 1").select("gram"), "repeated")
    rows = streams.select("host", "stream", "tokens", "low", "high")
    if repeated.count() <= BROADCAST_GRAMS:
        known = np.sort(repeated.toArrow().column(0).combine_chunks().to_numpy())
        made = arrow_map(rows, _suffixes(spark.sparkContext.broadcast(known)), SUFFIX)
    else:
        made = arrow_map(rows, _suffixes(None), SUFFIX).join(repeated, "gram", "left_semi")
    made = stored(made.drop("gram"), "suffixes")
    n = made.count()
    ranges = max(ceil(n / RANGE_ROWS), min(streams.sparkSession.sparkContext.defaultParallelism, ceil(n / FEW_ROWS)), 1)
    ordered = made.repartitionByRange(ranges, "key", "stream", "place").sortWithinPartitions("key", "stream", "place")
    found = stored(arrow_map(ordered, _neighbours, NEIGHBOUR), "neighbours")
    # Beginnings that go on from range to range: what all ranges together have of them.
    across = found.where("begins IS NOT NULL").groupBy("begins").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("ranges")).where("ranges > 1 AND low <> high")
    rows = found.where("stream IS NOT NULL")
    asked = rows.where("key IS NOT NULL").select("stream", "place", F.explode(F.transform(F.sequence(F.lit(LONG), F.lit(DEPTH)), lambda d: F.struct(d.alias("depth"), F.substring("key", F.lit(1), 8 + 4 * d).alias("begins")))).alias("x"))
    asked = stored(asked.select("stream", "place", "x.depth", "x.begins"), "asked")
    weighed = asked.groupBy("begins").agg(F.count(F.lit(1)).alias("weight")).join(across.select("begins"), "begins")
    further = join_keyed(asked, weighed, "begins", "weight", asked.count()).select("stream", "place", F.col("depth").alias("agrees"))
    return rows.where("agrees > 0").select("stream", "place", "agrees").unionByName(further)


def covered(streams: DataFrame) -> DataFrame:
    """``stream, starts, ends``: for every stream with a long repeat, where the covered stretches begin and end; they may overlap. A stream's stretches meet in one row, as its tokens do."""
    listed = F.sort_array(F.collect_list(F.struct("place", (F.col("place") + F.col("agrees")).alias("end"))))
    grouped = agreements(streams).groupBy("stream").agg(listed.alias("found"))
    return grouped.select("stream", F.col("found.place").alias("starts"), F.col("found.end").alias("ends"))

"""The main text of web pages: what doesn't repeat across the host, held against the markup of the article.

Markup gives blocks of visible text. All of them go, host by host, into a suffix array (`host_suffixes`):
long texts that other pages of the host have too are boilerplate. Where markup names an article, its say
follows: what repeats inside the article is given back, as articles quote each other and lines recur in
them, and what markup puts beside it goes though it doesn't repeat. What the main element has around the
article, a heading or a lead, is the array's to decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .host_suffixes import covered, stream
from .markup import ARTICLE, MAIN, PLAIN, blocks_of
from .minhash import _slices
from .shared import arrow_map, lower_az, spread, stored

#: Repeated words inside a block that are taken out of it.
RUN = 12
#: A page of whose text less than a tenth is its own is a near copy of others, not all boilerplate: blocks of so many words stay, repeated or not.
OWN, COPY_WORDS = 0.1, 50
#: Repeated stretches up to which their table goes to every task, at eight bytes each.
BROADCAST_PIECES = 2_000_000

PARSED = "host string, page_hash long, blocks array<struct<kind:string,text:string>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    names = [f.split()[0] for f in PARSED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))]
    for batch in batches:
        for part in _slices(batch, 3):
            columns: list[list] = [[] for _ in names]
            for host, html in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                blocks = blocks_of(html)
                seen = blake2b(digest_size=8)
                for b in blocks:
                    seen.update(b.text.encode("utf-8", "surrogatepass") + b"\0")
                row = (host, int.from_bytes(seen.digest(), "big", signed=True), [{"kind": b.kind, "text": b.text} for b in blocks])
                for column, value in zip(columns, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*part.schema.names[:2], *names])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Every page with host, a hash of its visible text and all its blocks."""
    host = lower_az(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    rows = spread(pages.select("page_id", "url", host.alias("host"), "html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return arrow_map(rows, _parsed, f"page_id {kind}, url string, {PARSED}")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            tokens = [stream(texts).tobytes() for texts in part.column(3).to_pylist()]
            seen = part.column(2)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tokens, pa.binary()), seen, seen], ["host", "stream", "tokens", "low", "high"])


def page_streams(parsed: DataFrame) -> DataFrame:
    """``host, stream, tokens, low, high``: the whole visible text of each page as a stream. Made anew for each use, as tokens take more room than the texts. Equal texts have one hash, so they are no repeats of each other."""
    rows = parsed.where(F.size("blocks") > 0).select(F.xxhash64("host").alias("host"), "stream", "page_hash", F.col("blocks.text").alias("texts"))
    return arrow_map(rows, _streams, "host long, stream long, tokens binary, low long, high long")


def _mask(n: int, starts: list[int] | None, ends: list[int] | None) -> np.ndarray:
    """Which of a stream's tokens are covered."""
    change = np.zeros(n + 1, np.int64)
    if starts:
        np.add.at(change, np.array(starts), 1)
        np.add.at(change, np.minimum(ends, n), -1)
    return np.cumsum(change[:n]) > 0


def _left(words: list[str], repeated: np.ndarray) -> list[str]:
    """What the array leaves of a block: nothing if all of it repeats, else all but its repeats of `RUN` words or more."""
    if repeated.all():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8)))
    kept, last = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= RUN:
            kept.extend(words[last:a])
            last = b
    return kept + words[last:]


def unique_text(blocks: list[tuple[str, str]], mask: np.ndarray) -> str:
    """What is left of a page without a named article: blocks in its main element, if there is one, without repeats.

    A block that repeats as a whole goes, and repeats of `RUN` words inside others, but for up to seven words
    at their beginning, as the suffix array is sparse there. Of near copies (see `COPY_WORDS`) only short blocks
    that repeat as a whole go.
    """
    kinds = {kind for kind, _ in blocks}
    wanted = MAIN if MAIN in kinds else PLAIN
    at, found, total, own = 0, [], 0, 0
    for kind, text in blocks:
        words = text.split()
        repeated = mask[at + 1 : at + 1 + len(words)]
        at += 1 + len(words)
        if kind == wanted:
            found.append((words, repeated))
            total += len(words)
            own += int((~repeated).sum())
    if own < OWN * total and any(len(w) >= COPY_WORDS for w, _ in found):
        return " ".join(" ".join(w) for w, repeated in found if len(w) >= COPY_WORDS or not repeated.all())
    return " ".join(w for words, repeated in found for w in _left(words, repeated))


def own_text(blocks: list[tuple[str, str]], mask: np.ndarray) -> tuple[str, int, int, int]:
    """A page's text, and its tokens outside the article, those of them that are repeated, and repeated ones inside the article.

    The mask of the array decides. Where markup names an article it is held against that: repeats inside are
    quotes and given back, and what is outside the article and the main element goes though it doesn't repeat. Of
    what the main element has around the article stays what the mask leaves.
    """
    inside = np.zeros(len(mask), bool)
    at, kept = 0, []
    for kind, text in blocks:
        n = 2 + text.count(" ")
        if kind == ARTICLE:
            inside[at : at + n] = True
            kept.append(text)
        elif kind == MAIN and (left := _left(text.split(), mask[at + 1 : at + n])):
            kept.append(" ".join(left))
        at += n
    text = " ".join(kept) if inside.any() else unique_text(blocks, mask)
    return text, int((~inside).sum()), int((mask & ~inside).sum()), int((mask & inside).sum())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends = (batch.column(k).to_pylist() for k in (3, 4))
        blocks = batch.column(2)
        kinds, texts = (c.to_pylist() for c in blocks.flatten().flatten())
        edges = np.concatenate([[0], np.cumsum(blocks.value_lengths().to_numpy())])
        found = []
        for k in range(batch.num_rows):
            some = slice(edges[k], edges[k + 1])
            listed = [*zip(kinds[some], texts[some])]
            # Words of a block are one space apart.
            n = sum(2 + t.count(" ") for _, t in listed) + bool(listed)
            found.append(own_text(listed, _mask(n, starts[k], ends[k])))
        columns = [*zip(*found)] if found else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 3))]],
            [*batch.schema.names[:2], "text", "n_outside", "n_repeated", "n_quoted"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_outside, n_repeated, n_quoted`` for every row of ``pages`` (``page_id, url, html``).

    text: blocks in page order, joined by one space; empty if there are none. What a named article says is whole, and
    beside it only own text of the main element around it is kept. n_outside: tokens of the
    page outside its article (words, and one mark a block); n_repeated: those that a long text covers which
    other pages of the host have too; n_quoted: such tokens inside the article. Pages of one host whose visible texts are equal count as one page there.
    A null html is empty; a null url, or one without ``://``, has the empty host. Rows that repeat each get
    their answer. Other columns play no part. An empty table gives an empty one.
    """
    parsed = stored(parsed_pages(pages).withColumn("stream", F.monotonically_increasing_id()), "pages", "zstd")
    pieces = stored(covered(page_streams(parsed)), "covered")
    rows = parsed.select("page_id", "url", "blocks", "stream")
    if (pieces.agg(F.sum(F.size("starts"))).first()[0] or 0) <= BROADCAST_PIECES:
        met = rows.join(F.broadcast(pieces), "stream", "left")
    else:
        met = rows.join(pieces, "stream", "left")
    kind = rows.schema["page_id"].dataType.simpleString()
    met = met.select("page_id", "url", "blocks", "starts", "ends")
    texts = arrow_map(met, _texts, f"page_id {kind}, url string, text string, n_outside long, n_repeated long, n_quoted long")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_outside", "n_repeated", "n_quoted")

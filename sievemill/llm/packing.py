"""Packing along a space-filling curve.

A text's token ids are counted into hashed cells; the unit vector is projected to four dimensions and
its cell on a Hilbert curve is the sort key. Documents, long ones in several rows, are dealt by ranges
of the key, ties by id, so a large group of equal texts is split like any other rows. Each range is sorted, its documents laid
end to end and cut every 2,048 tokens. What is left over at a range's end is cut to powers of two, so
no sequence needs padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .minhash import _slices
from .shared import arrow_map, spread, stored
from .token_counts import byte_alphabet

LENGTH = 2048
END = 1
CELLS, DIMS, DEPTH = 1024, 4, 15
#: Tokens of a document that travel in one row, so that ranges of rows are about as even in bytes.
CHUNK = 1 << 12
#: Bytes of ids a range holds; bits of the key by which the curve's bytes are counted.
RANGE_BYTES, COUNTED_BITS = 16 << 20, 18
#: White space of so many signs in a row is kept from the pattern engine.
LONG_RUN = 10_000
#: Fixed by the vocabulary's own pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANKS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}+")

_PROJECTION = np.random.Generator(np.random.PCG64(11)).standard_normal((CELLS, DIMS))


def hilbert_key(cells: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below 2**depth, one row a point."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (depth - 1)
    while bit > 1:  # undo the curve's reflections and exchanges, from the coarsest cell down
        low = bit - 1
        for d in range(dims):
            high = (x[d] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (depth - 1)
    while bit > 1:
        flip ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


class TokenIds:
    """Token ids of a byte-level vocabulary file of the tokenizers library.

    The merges run in tiktoken on the same vocabulary, several times faster than in the library the file
    belongs to; the tests hold both against each other. Special strings in a text give their own ids.
    """

    def __init__(self, vocab_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocab_path, encoding="utf-8") as f:
            read = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in k): v for k, v in read["model"]["vocab"].items() if k not in special}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        assert self.coder.n_vocab <= 2**16
        self.library, self.special = Tokenizer.from_file(vocab_path), tuple(special)

    def ids(self, text: str) -> bytes:
        """Little-endian 16-bit ids."""
        return b"".join(self._short(part) if k % 2 == 0 else self._long(part) for k, part in enumerate(_parts(text, self.special)) if part)

    def _short(self, text: str) -> bytes:
        return self.coder.encode_to_numpy(text, allowed_special="all").astype("<u2").tobytes()

    def _long(self, run: str) -> bytes:
        return np.array(self.library.encode(run, add_special_tokens=False).ids, "<u2").tobytes()


def _parts(text: str, special: tuple[str, ...] = ()) -> list[str]:
    """A text cut around long runs of white space, which stand at the odd places.

    Such a run but for its last sign is a piece of its own for the vocabulary's pattern (the last goes with
    what follows, but for a special string), so cutting there changes no id; the pattern engine would run out of stack on it.
    """
    if len(text) < LONG_RUN:
        return [text]
    found, last = [], 0
    for m in _BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) or text.startswith(special, m.end()) else m.end() - 1
        found += [text[last : m.start()], text[m.start() : end]]
        last = end
    return [*found, text[last:]]


_coders: dict[str, TokenIds] = {}


def tokenized(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, start, tokens, ids`` of every text: its place on the curve, its length, and its 16-bit ids with the end token in rows of `CHUNK` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        if vocab_path not in _coders:
            _coders[vocab_path] = TokenIds(vocab_path)
        coder = _coders[vocab_path]
        end = np.array([END], "<u2").tobytes()
        cell = ((np.arange(2**16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64) % CELLS
        for batch in batches:
            for part in _slices(batch, 1):
                ids = [(coder.ids(t) if t else b"") + end for t in part.column(1).to_pylist()]
                at = np.empty((len(ids), DIMS))
                for i, x in enumerate(ids):
                    counts = np.bincount(cell[np.frombuffer(x, "<u2")], minlength=CELLS).astype(float)
                    at[i] = counts @ _PROJECTION / np.sqrt(counts @ counts)
                cells = (2**DEPTH / (1 + np.exp(-1.702 * at))).astype(np.int64).clip(0, 2**DEPTH - 1)
                tokens = np.array([len(x) // 2 for x in ids])
                rows = -(-tokens // CHUNK)
                of = pa.array(np.repeat(np.arange(len(ids)), rows))
                start = (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)) * CHUNK
                cut = pa.array([x[k : k + 2 * CHUNK] for x in ids for k in range(0, len(x), 2 * CHUNK)], pa.binary())
                whole = [part.column(0), pa.array(hilbert_key(cells)), pa.array(tokens, pa.int64())]
                doc, key, n = (c.take(of) for c in whole)
                yield pa.RecordBatch.from_arrays([doc, key, pa.array(start, pa.int64()), n, cut], ["doc_id", "key", "start", "tokens", "ids"])

    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, start long, tokens long, ids binary")


_PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        out: list[list] = [[] for _ in _PIECES]
        kind = None

        def emit(piece: tuple, offset: int) -> None:
            doc, start, ids, total = piece
            row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset)
            for column, v in zip(out, row):
                column.append(v)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], kind), *(pa.array(x, pa.int64()) for x in out[1:])], _PIECES)
            for column in out:
                column.clear()
            return made

        held: list[tuple] = []  # pieces of the sequence that isn't full yet
        filled = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, first, total, data in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                ids, start = np.frombuffer(data.as_buffer(), "<u2"), 0
                while start < len(ids):
                    part = ids[start : start + length - filled]
                    held.append((doc, first + start, part.copy() if filled + len(part) < length else part, total))
                    filled += len(part)
                    start += len(part)
                    if filled == length:
                        offset = 0
                        for piece in held:
                            emit(piece, offset)
                            offset += len(piece[2])
                        held, filled, sequence = [], 0, sequence + 1
                if len(out[0]) >= 10_000:
                    yield flush()
        while held:  # the rest as sequences of powers of two
            room, offset = 1 << (sum(len(p[2]) for p in held).bit_length() - 1), 0
            while offset < room:
                doc, start, ids, total = held.pop(0)
                part = ids[: room - offset]
                emit((doc, start, part, total), offset)
                offset += len(part)
                if len(part) < len(ids):
                    held.insert(0, (doc, start + len(part), ids[len(part) :], total))
            sequence += 1
        if out[0]:
            yield flush()

    return run


def _ranged(ids: DataFrame) -> DataFrame:
    """Rows of stored ids dealt by ranges of the key that are even in bytes, as many as the bytes need.

    Bytes are counted by the key's first bits; a stretch of the curve that holds more than a range's
    share, as a large group of equal texts does, is dealt over several.
    """
    stretch = F.shiftright("key", DIMS * DEPTH - COUNTED_BITS)
    counted = ids.groupBy(stretch.alias("stretch")).agg(F.sum(F.octet_length("ids")).alias("bytes"))
    # One row a stretch, 2**COUNTED_BITS at most: their running sum is one small task, and every task gets it.
    counted = counted.withColumn("before", F.sum("bytes").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes"))
    counted = stored(counted, "stretches")
    ranges = max(1, -(-(counted.agg(F.sum("bytes")).first()[0] or 0) // RANGE_BYTES))
    inside = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / (1 << 20)
    rows = ids.withColumn("stretch", stretch).withColumn("inside", inside).join(F.broadcast(counted), "stretch")
    place = F.least(F.floor((F.col("before") + F.col("inside") * F.col("bytes")) / RANGE_BYTES), F.lit(ranges - 1)).cast("int")
    return rows.withColumn("range", place).select(*ids.columns, "range").repartitionById(ranges, "range")


def pack(docs: DataFrame, vocab_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens, one row a piece.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. A null or empty text
    is one document of just the end token. Every row of ``docs`` is packed, rows that repeat an id too;
    a null id passes through. Other columns play no part. An empty table gives an empty one. The number
    of ranges follows from the bytes of all ids and they are even in bytes, so a task's share doesn't grow
    with the table.
    """
    ids = stored(tokenized(docs, vocab_path, id_col, text_col), "tokens")
    kind = ids.schema["doc_id"].dataType.simpleString()
    ranged = _ranged(ids).sortWithinPartitions("key", "doc_id", "start").select("doc_id", "start", "tokens", "ids")
    return arrow_map(ranged, _pack(length), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _PIECES[1:]))

"""Small helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import join_keyed
from ..sources.tables import read_table, spread
from ..storage import discard, shared_dir, stored, stored_alone
from ..tasks import arrow_map, send_code

__all__ = ["arrow_map", "discard", "join_keyed", "lower_az", "read_table", "send_code", "shared_dir", "spread", "stored", "stored_alone", "text_bytes", "unused"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of characters that are none of these: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its values; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]

"""MPEG transport streams as a media column.

Writing: program association and map tables, then elementary packets with time stamps, cut into
188-byte packets with continuity counters; random-access points carry a clock reference. Reading:
packets are found by their sync bytes, tables are parsed and their checksums checked, continuity
counters are followed, and elementary packets are put together again with their time stamps.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import _slices
from .shared import arrow_map, spread

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06
#: Bytes of an access unit, units between random-access points, and a unit's length on the 90 kHz clock.
UNIT, ACCESS_EVERY, TICKS = 16_384, 4, 3_600
PADDED = 64


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The checksum of program tables: 32 bits, not reflected; 0 over a table with its checksum."""
    c = 0xFFFFFFFF
    for byte in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ byte]
    return c


def _section(table: int, extension: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), extension, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


def _time(mark: int, ticks: int) -> bytes:
    return bytes([(mark << 4) | ((ticks >> 29) & 0x0E) | 1, (ticks >> 22) & 0xFF, ((ticks >> 14) & 0xFE) | 1, (ticks >> 7) & 0xFF, ((ticks << 1) & 0xFE) | 1])


def _read_time(data: bytes) -> int:
    return ((data[0] >> 1) & 7) << 30 | data[1] << 22 | (data[2] >> 1) << 15 | data[3] << 7 | data[4] >> 1


class Muxer:
    """Writes one program with one data stream."""

    def __init__(self) -> None:
        self.counters: dict[int, int] = {}
        self.out: list[bytes] = []

    def packets(self, pid: int, data: bytes, clock: int | None = None) -> None:
        """One elementary packet or section as transport packets; the last is stuffed. clock: also a random-access point."""
        at, counter = 0, self.counters.get(pid, 0)
        field_bytes = b"" if clock is None else bytes([0x50]) + struct.pack(">IH", clock >> 1, (clock & 1) << 15 | 0x7E00)
        start = 0x4000
        while at < len(data) or start:
            room = 184 - (len(field_bytes) + 1 if field_bytes else 0)
            part = data[at : at + room]
            if len(part) < room and not field_bytes:
                stuffing = room - len(part) - 1
                field_bytes = bytes([0]) + b"\xff" * (stuffing - 1) if stuffing else b""
                adaptation = bytes([stuffing]) + field_bytes
            elif field_bytes:
                field_bytes += b"\xff" * (room - len(part))
                adaptation = bytes([len(field_bytes)]) + field_bytes
            else:
                adaptation = b""
            self.out.append(struct.pack(">BHB", SYNC, start | pid, (0x30 if adaptation else 0x10) | counter) + adaptation + part)
            at, counter, start, field_bytes = at + len(part), (counter + 1) & 15, 0, b""
        self.counters[pid] = counter

    def tables(self) -> None:
        self.packets(0, b"\0" + _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
        self.packets(PMT_PID, b"\0" + _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000)))

    def unit(self, data: bytes, ticks: int, access: bool) -> None:
        ticks &= 2**33 - 1
        head = struct.pack(">BBBBHBBB", 0, 0, 1, PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _time(2, ticks)
        self.packets(DATA_PID, head + data, ticks if access else None)


def write_stream(payload: bytes) -> bytes:
    """The payload as a transport stream; tables come before every random-access point."""
    muxer = Muxer()
    for i in range(max(1, -(-len(payload) // UNIT))):
        access = i % ACCESS_EVERY == 0
        if access:
            muxer.tables()
        muxer.unit(payload[i * UNIT : (i + 1) * UNIT], i * TICKS, access)
    return b"".join(muxer.out)


@dataclass
class Unit:
    pid: int
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    counter_errors: int = 0
    table_errors: int = 0
    sync_losses: int = 0


def _elementary(pid: int, access: bool, data: bytes) -> Unit | None:
    """An elementary packet from its bytes; None if it has no start code or is cut short."""
    if len(data) < 9 or data[:3] != b"\0\0\1":
        return None
    length = struct.unpack_from(">H", data, 4)[0]
    if length and len(data) < length + 6:
        return None
    flags, head = data[7], 9 + data[8]
    pts = _read_time(data[9:14]) if flags & 0x80 and len(data) >= 14 else None
    dts = _read_time(data[14:19]) if flags & 0x40 and len(data) >= 19 else None
    return Unit(pid, pts, dts, access, data[head : length + 6 if length else len(data)])


def read_stream(data: bytes) -> Stream:
    """Tables, elementary packets and errors of a transport stream; damage is counted and skipped."""
    found, held, counters = Stream(), {}, {}
    table_pids = {0}
    at, end = 0, len(data)

    def close(pid: int) -> None:
        access, parts = held.pop(pid, (False, None))
        if parts:
            unit = _elementary(pid, access, b"".join(parts))
            if unit:
                found.units.append(unit)

    while at + PACKET <= end:
        if data[at] != SYNC:
            found.sync_losses += 1
            at = data.find(b"\x47", at + 1)
            while 0 <= at < end - PACKET and data[at + PACKET] != SYNC:
                at = data.find(b"\x47", at + 1)
            if at < 0:
                break
            continue
        two, flags = (data[at + 1] << 8) | data[at + 2], data[at + 3]
        pid, body, stop, access, jump = two & 0x1FFF, at + 4, at + PACKET, False, False
        at = stop
        found.packets += 1
        if two & 0x8000 or pid == 0x1FFF:
            continue
        if flags & 0x20:
            size = data[body]
            if size:
                access, jump = bool(data[body + 1] & 0x40), bool(data[body + 1] & 0x80)
            body += 1 + size
        if not flags & 0x10 or body > stop:
            continue
        counter, last = flags & 15, counters.get(pid)
        if last is not None and not jump and counter != (last + 1) & 15:
            if counter == last:
                continue  # a repeated packet
            found.counter_errors += 1
            held.pop(pid, None)
        counters[pid] = counter
        if pid in table_pids:
            if two & 0x4000 and body < stop:
                _table(found, table_pids, pid, data[body + 1 + data[body] : stop])
        elif two & 0x4000:
            close(pid)
            held[pid] = (access, [data[body:stop]])
        elif pid in held:
            held[pid][1].append(data[body:stop])
    for pid in list(held):
        close(pid)
    return found


def _table(found: Stream, table_pids: set[int], pid: int, data: bytes) -> None:
    size = 3 + (struct.unpack_from(">H", data, 1)[0] & 0x0FFF) if len(data) > 3 else 0
    if size < 12 or len(data) < size or section_crc(data[:size]):
        found.table_errors += 1
        return
    if pid == 0 and data[0] == 0:
        for k in range(8, size - 4, 4):
            program, where = struct.unpack_from(">HH", data, k)
            if program:
                found.programs[program] = where & 0x1FFF
                table_pids.add(where & 0x1FFF)
    elif data[0] == 2:
        k = 12 + (struct.unpack_from(">H", data, 10)[0] & 0x0FFF)
        while k + 5 <= size - 4:
            kind, where, more = struct.unpack_from(">BHH", data, k)
            found.streams[where & 0x1FFF] = kind
            k += 5 + (more & 0x0FFF)


def access_units(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Elementary packets of a column of transport streams, one row a packet.

    Returns ``id, unit, pid, stream_type, pts, dts, random_access, data``. Null, empty and unreadable
    values give no rows; cut or damaged packets are left out. Packets of a stream that no table names
    have a null stream_type. Repeated rows give their packets each; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in _slices(batch, 1):
                out: list[list] = [[] for _ in range(8)]
                for i, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    read = read_stream(value or b"")
                    for k, u in enumerate(read.units):
                        for column, v in zip(out, (i, k, u.pid, read.streams.get(u.pid), u.pts, u.dts, u.random_access, u.data)):
                            column.append(v)
                types = [part.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["id", "unit", "pid", "stream_type", "pts", "dts", "random_access", "data"])

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, unit long, pid int, stream_type int, pts long, dts long, random_access boolean, data binary")


def stored_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts stored as transport streams: ``doc_id, n_bytes, media``. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in _slices(batch, 1):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [write_stream(t + bytes(max(PADDED, -(-len(t) // PADDED) * PADDED) - len(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes of `stored_payloads` give when read back, one row per row.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, access_units, access_pts``. The feature names packets, elementary packets, random-access
    points, first and last time stamp, and errors; access_units and access_pts list the random-access
    points by the number of their elementary packet and their time stamp. A null or damaged value gives
    what could be read of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in _slices(batch, 2):
                out: list[list] = [[] for _ in range(8)]
                for value in part.column(2).to_pylist():
                    value = value or b""
                    read = read_stream(value)
                    payload = b"".join(u.data for u in read.units if u.pid == DATA_PID)
                    times = [u.pts for u in read.units if u.pts is not None] or [-1]
                    points = [(k, u.pts) for k, u in enumerate(read.units) if u.random_access]
                    feature = f"packets={read.packets};units={len(read.units)};access={len(points)};pts={times[0]}-{times[-1]};programs={len(read.programs)};streams={len(read.streams)};errors={read.counter_errors + read.table_errors + read.sync_losses}"
                    for column, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PADDED:]), len(value), hashlib.sha256(value).hexdigest(), feature, [k for k, _ in points], [t for _, t in points])):
                        column.append(v)
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, t) for x, t in zip(out, types))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_units", "access_pts"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return arrow_map(media.select("doc_id", "n_bytes", "media"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access_units array<long>, access_pts array<long>")

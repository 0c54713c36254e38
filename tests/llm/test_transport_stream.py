"""Transport streams: exact round trips, tables, counters and damage."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemill.llm.transport_stream import DATA_PID, PACKET, PMT_PID, UNIT, access_units, media_features, read_stream, section_crc, stored_payloads, write_stream


def payload_of(read):
    return b"".join(u.data for u in read.units)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=2000))
def test_round_trip(data):
    stream = write_stream(data)
    read = read_stream(stream)
    assert len(stream) % PACKET == 0 and all(stream[k] == 0x47 for k in range(0, len(stream), PACKET))
    assert payload_of(read) == data and not (read.counter_errors or read.table_errors or read.sync_losses)
    assert read.programs == {1: PMT_PID} and read.streams == {DATA_PID: 6}


@pytest.mark.parametrize("n", [0, 1, 155, 156, 157, 169, 170, 171, UNIT - 1, UNIT, UNIT + 1, 9 * UNIT + 5])
def test_lengths_and_times(n):
    data = bytes(i * 7 % 256 for i in range(n))
    read = read_stream(write_stream(data))
    assert payload_of(read) == data
    assert [u.pts for u in read.units] == [3600 * k for k in range(len(read.units))]
    assert [u.random_access for u in read.units] == [k % 4 == 0 for k in range(len(read.units))]


def test_crc():
    assert section_crc(b"123456789") == 0x0376E6E7  # the published check value


def test_damage():
    data = bytes(range(256)) * 300
    stream = write_stream(data)
    packets = [stream[k : k + PACKET] for k in range(0, len(stream), PACKET)]
    lost = read_stream(b"".join(packets[:50] + packets[51:]))
    assert lost.counter_errors == 1 and len(lost.units) < len(read_stream(stream).units)
    twice = read_stream(b"".join(packets[:50] + packets[49:]))
    assert payload_of(twice) == data and twice.counter_errors == 0
    shifted = read_stream(b"junk" + stream)
    assert payload_of(shifted) == data and shifted.sync_losses == 1
    broken = bytearray(stream)
    broken[20] ^= 1
    assert read_stream(bytes(broken)).table_errors >= 1 or read_stream(bytes(broken)).programs
    assert read_stream(b"").units == [] and read_stream(b"G" * 100).units == []


def test_table(spark):
    texts = [(1, "é" * 40), (2, ""), (3, None), (4, "x" * 64), (5, "y" * 100_000), (None, "x" * 64), (4, "x" * 64)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    got = media_features(stored_payloads(docs)).collect()
    assert len(got) == len(texts)
    by_text = {}
    for r in got:
        text = next((t or "").encode() for i, t in texts if i == r.doc_id)
        padded = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(padded))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert by_text.setdefault(padded, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    units = access_units(stored_payloads(docs), "doc_id", "media").where("id = 5").orderBy("unit").collect()
    assert b"".join(u.data for u in units).rstrip(b"\0") == b"y" * 100_000 and units[0].stream_type == 6
    assert media_features(stored_payloads(docs.limit(0))).collect() == []

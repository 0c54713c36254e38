"""Token counts and packing against the tokenizers library."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievemill.llm.packing import TokenIds, hilbert_key, pack
from sievemill.llm.token_counts import WordCounts, count_tokens, whole_tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", " ", "\n", "a", "It's  the\tend.\n\n Yes", "don't 'S ''s x's", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c", "\x1c a\x1db \x1f",
    "été İstanbul ΣΑΣ ΟΔΟΣ ﬁn ½²³", "漢字 かな 한국어", "a b c　d\u0085e", "x" * 5000, "ab " * 3000, "᠎ a᠎ b", "😀👍🏽 ok", "\r\n a \r\n", "1234 5 ٣٤", "ß ẞ ª º µ ÿ", "a­b ​ c",
]
text = st.text(alphabet=st.one_of(st.sampled_from(list("abTHE ,.'\n\t 019é<|>")), st.characters(exclude_categories=("Cs",))), max_size=60)


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


@pytest.fixture(scope="module")
def counts():
    return WordCounts(WORD, whole_tokens(WORD))


@pytest.fixture(scope="module")
def ids():
    return TokenIds(BYTE)


def counted(counts, t):
    return counts.count(t)


def test_whole_tokens_are_proven(counts, library):
    assert len(counts.whole) > 20_000
    assert {"the", "of", ","} <= counts.whole
    for w in sorted(counts.whole)[::997]:
        assert len(library[WORD].encode(w, add_special_tokens=False).ids) == 1


@pytest.mark.parametrize("t", HARD)
def test_hard_texts(counts, ids, library, t):
    assert counted(counts, t) == len(library[WORD].encode(t, add_special_tokens=False).ids)
    assert np.frombuffer(ids.ids(t), "<u2").tolist() == library[BYTE].encode(t, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(text)
def test_any_text(t):
    w, b = _held()
    assert counted(w[0], t) == len(w[1].encode(t, add_special_tokens=False).ids)
    assert np.frombuffer(b[0].ids(t), "<u2").tolist() == b[1].encode(t, add_special_tokens=False).ids


_kept = {}


def _held():
    if not _kept:
        _kept["x"] = ((WordCounts(WORD, whole_tokens(WORD)), Tokenizer.from_file(WORD)), (TokenIds(BYTE), Tokenizer.from_file(BYTE)))
    return _kept["x"]


def test_bounded_memory(monkeypatch, library):
    monkeypatch.setattr("sievemill.llm.token_counts.REMEMBER", 3)
    c = WordCounts(WORD, frozenset())
    t = "the cat sat on the mat while dogs slept"
    assert c.count(t) == c.count(t) == len(library[WORD].encode(t, add_special_tokens=False).ids)
    assert len(c) <= 3 and len(c.older) <= 3


def test_counts_of_table(spark, library):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "a b"), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS whole")
    got = sorted(map(tuple, count_tokens(docs, WORD, limit=10).collect()), key=str)
    want = []
    for i, t in rows:
        n = len(library[WORD].encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 10))
    assert got == sorted(want, key=str)
    assert count_tokens(docs.limit(0), WORD).collect() == []


def test_hilbert_neighbours():
    """Consecutive keys of a whole grid are neighbouring cells, and every cell has its own key."""
    for dims, depth in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(2**depth)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert_key(grid, depth)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def held_to(rows, docs, library, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, t in docs:
        want, at = library[BYTE].encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = want[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(want)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or (at < length and at & (at - 1) == 0)


def test_pack(spark, sf_dir, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held_to(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTE).collect(), docs, library, 2048)


def test_pack_hard_texts(spark, library):
    docs = list(enumerate(HARD)) + [(100, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS ids", "3 AS start")
    held_to(pack(table, BYTE, length=64).collect(), docs, library, 64)
    assert pack(table.limit(0), BYTE).collect() == []


def test_pack_repeats_and_null_ids(spark):
    table = spark.createDataFrame([(None, "a b"), (3, "same text"), (3, "same text")], "doc_id long, text string")
    rows = pack(table, BYTE, length=8).collect()
    assert sum(r.length for r in rows) == 2 + 1 + 2 * 3

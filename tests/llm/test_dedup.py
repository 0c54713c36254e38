"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sievemill.llm import exact_dedup, minhash
from sievemill.llm.components import connected_components
from sievemill.llm.exact_dedup import deduplicate, exact_duplicates
from sievemill.llm.minhash import drop_near_duplicates, least_matches, near_duplicates, shared_counts
from sievemill.llm.shingles import PIECE, overlap, shingle_sets

WORD = re.compile("[^\x20\x09-\x0d]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components_by_hand(texts, percent=75):
    sets = {k: shingles(t) for k, t in texts.items()}
    up = {k: k for k in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}, {k: len(s) for k, s in sets.items()}


def hold_near(got, texts):
    want, sizes = components_by_hand(texts)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], r.doc_id == want[r.doc_id])


def changed(rng, words, n, vocabulary):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
    return " ".join(w)


def test_shingles_against_sets():
    rng = random.Random(1)
    texts = ["", None, " \t\n", "one", "a b c d", "a b c d e", "A b\tC\x0bd\x0ce\rf", "é É e f ß", "x" * 1000, "a a a a a a a a", "a\u0085b c d e f"]
    texts += [" ".join(rng.choices(["a", "b", "cc", "É"], k=rng.randrange(60))) for _ in range(200)]
    texts += ["y" * (PIECE + 10) + " b c d e f g", " ".join(f"w{i}" for i in range(60_000))]
    got = shingle_sets(pa.array(texts))
    by_hash = {}
    for t, s in zip(texts, got):
        want = shingles(t)
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
    for i in range(11, 60):
        for j in range(i, 60):
            assert overlap(got[i], got[j]) == len(shingles(texts[i]) & shingles(texts[j]))
    assert (shared_counts(got[11:40], got[30:60], columns=7) == [[overlap(a, b) for b in got[30:60]] for a in got[11:40]]).all()
    sliced = shingle_sets(pa.array(texts).slice(3, 20))
    assert all((a == b).all() for a, b in zip(sliced, got[3:23]))
    assert by_hash == {}


def test_cut_is_low():
    assert 60 < least_matches() < 85


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {0: "", 1: None, 2: "  ", 3: "one two", 4: "ONE two", 5: "one two three", 6: "a b c d e", 7: "A B C D E", 8: "a b c d e f"}
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randrange(8, 200))
        for n in (0, 0, 1, 2, 3, 5, 8):
            texts[len(texts)] = changed(rng, base, min(n, len(base) // 12), vocabulary)
    ids = list(texts)
    rng.shuffle(ids)
    docs = spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS component_id", "3 AS sig")
    hold_near(near_duplicates(docs).collect(), texts)
    left = {r.doc_id for r in drop_near_duplicates(docs).collect()}
    want, _ = components_by_hand(texts)
    assert left == {k for k, v in want.items() if k == v}
    assert drop_near_duplicates(docs).columns == docs.columns


def test_near_duplicates_whole_group(spark, monkeypatch):
    """A large tangle around one text, in which many aren't linked to their bucket's leader, in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 2000)
    monkeypatch.setattr(minhash, "OWN", 8)
    monkeypatch.setattr(minhash, "GROUP", 5)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for _ in range(2):
        base = rng.choices(vocabulary, k=120)
        for _ in range(150):
            texts[len(texts)] = changed(rng, base, rng.choice([1, 2, 3, 4, 5]), vocabulary)
    hold_near(near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


def test_near_duplicates_edges(spark):
    same = "a b c d e f g h i j"
    docs = spark.createDataFrame([(None, same), (5, same), (5, same), (9, same.upper())], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (9, 5, False), (None, None, True)]
    assert near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("salts", [1, 8])
def test_exact_duplicates(spark, salts):
    rows = [(1, "Same Text", "x"), (2, "same text", "y"), (7, "SAME TEXT", None), (3, None, "z"), (4, "", "z"), (5, "É", "q"), (6, "é", "q"), (None, "lonely", "n"), (None, "same text", "n"), (8, "b" * 100_000, "l"), (9, "B" * 100_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(3)
    got = {(r.doc_id, r.text_sha256): r for r in exact_duplicates(docs, salts=salts).collect()}
    assert len(got) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(low(t), []).append(i)
    for i, t, _ in rows:
        r, ids = got[i, hashlib.sha256(low(t).encode()).hexdigest()], groups[low(t)]
        top = max((x for x in ids if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (top, len(ids), i == top)
    left = sorted((r.doc_id or -1 for r in deduplicate(docs, salts=salts).collect()))
    assert left == [-1, 4, 5, 6, 7, 9]
    assert deduplicate(docs).columns == docs.columns
    assert exact_duplicates(docs.limit(0)).collect() == []


def test_exact_duplicates_hot_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text", "'s' AS source")
    got = exact_duplicates(docs)
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000 AND keep_id = 2997").count() == 1000
    twice = docs.unionByName(docs.where("doc_id = 2997"))
    assert deduplicate(twice).count() == 2001


def test_equal_digests_of_different_texts(spark, monkeypatch):
    """Should digests ever collide, full texts still tell the groups apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_digest", lambda norm: F.substring(F.sha2(norm.cast("binary"), 256), 1, 1))
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "doc_id long, text string")
    for r in exact_duplicates(docs).collect():
        same = [i for i in range(100) if i % 40 == r.doc_id % 40]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
    assert deduplicate(docs).count() == 40

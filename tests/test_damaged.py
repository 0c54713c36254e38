"""Titles in damaged texts against every title at every place of every text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sievemill.functions.damage import GRAM, distance_at, errors_allowed, plain, segments
from sievemill.operators import damaged
from sievemill.operators.damaged import DAMAGE, damaged_titles
from sievemill.plans.damage_queries import titles_in_damaged_texts


def distance(title, text):
    """Fewest edits between a title and any part of a text."""
    signs, steps = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(title):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (signs != ord(c)))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def spoilt(rng, text, edits):
    signs = list(text)
    for _ in range(edits):
        k = rng.randrange(len(signs))
        rng.choice([lambda: signs.insert(k, "x"), lambda: signs.pop(k), lambda: signs.__setitem__(k, "#")])()
    return "".join(signs)


def test_plain():
    assert plain("The eﬀect of exer-\n  cise on ﬁtness:\na “U.S.” study — 2") == 'the effect of exercise on fitness: a "u.s." study - 2'
    assert plain("soft­hyphen A\tB well-known 10-\n20") == "softhyphen a b well-known 10- 20" and plain(None) == plain(" \n") == ""


def test_distance_and_segments():
    rng = random.Random(1)
    for _ in range(3_000):
        title = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        window = "".join(rng.choice("abc") for _ in range(rng.randrange(8))) + spoilt(rng, title, rng.randrange(2)) + "".join(rng.choice("abc") for _ in range(rng.randrange(8)))
        allowed = rng.randrange(4)
        assert min(distance_at(title, window, s, allowed) for s in range(-allowed, len(window) + 1)) == min(distance(title, window), allowed + 1)
    for n in range(GRAM, 400):
        cut = segments(n, errors_allowed(n, 0.05))
        assert cut[0][0] == 0 and cut[-1][1] == n and all(b - a >= GRAM for a, b in cut) and len(cut) >= int(n * 0.05) + (n < 20)


WORDS = "air pollution exercise health fitness effect study of the cities long term exposure particles reflex classification heart rate sleep walking school".split()


@pytest.mark.parametrize("rows", [100_000, 5])
def test_against_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(damaged, "BLOCK_ROWS", rows)
    rng = random.Random(2)
    titles = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 14))).capitalize()) for k in range(40)] + [(100, None), (101, ""), (102, "short"), (103, "The effect of the effect"), (104, "THE  effect of\nthe effect")]
    texts = [(900, None), (901, ""), (902, "none of it")]
    for k in range(60):
        _, title = titles[k % 40]
        n = max(errors_allowed(len(title), DAMAGE) + rng.randrange(-2, 2), 0)
        inner = spoilt(rng, title, n).replace("fi", "ﬁ").replace("fl", "ﬂ")
        words = inner.split(" ")
        if len(words) > 3:
            inner = " ".join(words[:2]) + "\n" + " ".join(words[2:])
            inner = inner.replace("pollution", "pol-\nlution")
        texts.append((k % 50, " ".join(rng.choice(WORDS) for _ in range(30)) + " " + inner + ". " + " ".join(rng.choice(WORDS) for _ in range(30))))
    table = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS gram", "2 AS title", "3 AS place")
    got = {(r.doc_id, r.item_id): r.edits for r in damaged_titles(table, spark.createDataFrame(titles, "item_id long, title string")).collect()}
    want = {}
    for doc, text in texts:
        for item, title in titles:
            t = plain(title)
            if len(t) >= GRAM:
                n = distance(t, plain(text))
                if n <= errors_allowed(len(t), DAMAGE):
                    want[doc, item] = min(n, want.get((doc, item), n))
    assert got == want and len(want) > 40 and max(want.values()) >= 2


def test_registered_query_against_all_pairs(spark, sf_dir):
    """The query's own texts and titles; a title can't be in a text that lacks most of its grams, which spares most comparisons."""
    from sievemill.plans.damage_queries import BROKEN

    got = {(r.doc_id, r.item_id): r.edits for r in titles_in_damaged_texts(spark, sf_dir).collect()}
    texts = [(r.doc_id, plain(r.t)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{BROKEN} AS t").collect()]
    titles = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {}
    for doc, text in texts:
        grams = {text[i : i + 4] for i in range(len(text) - 3)}
        for item, title in titles:
            allowed = errors_allowed(len(title), DAMAGE)
            if sum(title[i : i + 4] in grams for i in range(len(title) - 3)) >= len(title) - 3 - 4 * allowed:
                n = distance(title, text)
                if n <= allowed:
                    want[doc, item] = n
    assert got == want and want
    assert damaged_titles(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, title string")).collect() == []


def test_plain_takes_shortcuts_only():
    """Texts with few wide signs go a shorter way, to the same result."""
    import random
    import unicodedata

    from sievemill.functions.damage import _DASHED, _wide

    rng = random.Random(9)
    signs = [*"abfi st-\n", *_DASHED, *"\uFB00\uFB01\uFB05\uFB06\u0307\u0301\uFF21\u212B\u2460e\u1E9B\u0323\uAC00\u1100\u1161"]
    for _ in range(3_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
        assert _wide(text) == unicodedata.normalize("NFKC", text.translate(str.maketrans(_DASHED)))


def test_texts_are_derived_once(spark, monkeypatch):
    """No filter derives a text a second time, and a gram whose segment isn't whole costs no edit distance."""
    plans, made = [], damaged.arrow_map
    monkeypatch.setattr(damaged, "arrow_map", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or made(df, *a))
    texts = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again"), (2, None)], "doc_id long, text string")
    titles = spark.createDataFrame([(7, "quick brown fox jumps over the lazy dog"), (8, None)], "item_id long, title string")
    got = damaged_titles(texts.selectExpr("doc_id", "regexp_replace(text, 'x', 'x') AS text"), titles).collect()
    assert [tuple(r) for r in got] == [(1, 7, 0)] and max(p.count("regexp_replace") for p in plans) == 1
    seen: list = []
    monkeypatch.setattr(damaged, "distance_at", lambda *a: seen.append(a) or 0)
    names = ["doc_id", "place", "around", "title", "allowed", "start", "stop", "at"]
    row = (1, 10, "xxxxxxxxxxick browx" + "y" * 40, "quick brown fox jumps over the lazy dog", 1, 0, 19, 2)
    batch = pa.RecordBatch.from_pylist([dict(zip(names, row))])
    assert sum(b.num_rows for b in damaged._checked(iter([batch]))) == 0 and not seen

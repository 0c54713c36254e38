"""Terms counted in arrays against `text.terms`; scores against counting by hand; pairs of questions and notes are never dealt."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemill import joins
from sievemill.functions import term_counts
from sievemill.functions.text import IDEOGRAPHS, terms
from sievemill.operators import note_index
from sievemill.operators.note_index import NoteIndex

PIECES = ["the", "The", "with", "thé", "Straße", "ΣΟΦΟΣ", "İstanbul", "ab", "a1b2", "2024", "x", "研究", "研", "カタカナ・テスト", "한국어", "𠮷野家", "天", " ", "  ", "\n", "\t", "-", "—", "，", "\0", "word", "ABC研究abc", "ﬁne", "étude", "😀", " "]


def lists(texts):
    of, term, times = term_counts.counted(texts)
    found = [Counter() for _ in texts]
    for k, t, n in zip(of.tolist(), term.to_pylist(), times.tolist()):
        assert t not in found[k]
        found[k][t] = n
    assert of.tolist() == sorted(of.tolist())
    return found


@pytest.mark.parametrize("cells", [4, 0])
def test_terms_are_counted_as_the_column_tells_them(spark, monkeypatch, cells):
    monkeypatch.setattr(term_counts, "CELLS", cells)
    rng = random.Random(7)
    texts = [None, "", " ", *IDEOGRAPHS, "the", "研", "研究", "a研", *("".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(rng.randrange(25))) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", F.lower(F.coalesce("text", F.lit(""))).alias("low"), terms(F.col("text")).alias("terms")).orderBy("k").collect()
    assert lists([r.low for r in rows]) == [Counter(r.terms) for r in rows]
    assert lists([]) == [] and lists(["", ""]) == [Counter(), Counter()]


def by_hand(notes, asked, top):
    """notes: id, categories, terms; asked: question, category, terms."""
    whole = {}
    for i, c, t in notes:
        of = whole.setdefault(i, ([], Counter()))
        of[0].append(c)
        of[1].update(t)
    mean = max(sum(sum(t.values()) for _, t in whole.values()), 1) / len(whole)
    having = Counter(w for _, t in whole.values() for w in t)
    scores = {}
    for q, only, word in {(q, c, w) for q, c, t in asked for w in t}:
        for i, (cs, t) in whole.items():
            category = min((c for c in cs if c is not None), default=None)
            n = t[word]
            if n and (only is None or only == category):
                idf = math.log(1 + (len(whole) - having[word] + 0.5) / (having[word] + 0.5))
                scores.setdefault(q, Counter())[i] += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(t.values()) / mean))
    return {(q, i, round(s, 6), rank) for q, of in scores.items() for rank, (i, s) in enumerate(sorted(of.items(), key=lambda x: (-round(x[1], 6), x[0]))[:top], 1)}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_scores_against_counting_by_hand(spark, tmp_path, monkeypatch, small, kind):
    """Several rows a note and a question, categories, equal notes, appended segments; also with the least that is scored at once."""
    if small:
        for name, value in (("TEXT_BYTES", 40), ("SCORED_NOTES", 7), ("SCORED_CELLS", 30), ("SCORED_QUESTIONS", 2), ("KNOWN_IDS", 0)):
            monkeypatch.setattr(note_index, name, value)
        monkeypatch.setattr(joins, "FEW_ROWS", 0)
        monkeypatch.setattr(joins, "HOT_ROWS", 3)
    rng = random.Random(3)
    key = (lambda k: k) if kind == "long" else (lambda k: f"n{k}")
    words = [f"wo{k:02d}" for k in range(30)] + ["rare", "sole"]
    text = lambda n: [rng.choice(words[:30]) for _ in range(n)]
    same = text(12)
    notes = [(key(k), rng.choice(["a", "b", None]), same if k % 3 == 0 else text(rng.randrange(20))) for k in range(90)]
    notes += [(key(k), rng.choice(["a", "b", None]), text(4)) for k in range(0, 60, 7)] + [(key(200), "a", []), (key(200), None, []), *[(key(202), "b", ["often", "wo03"])] * 5, (key(201), "b", ["rare"] * 50)]
    asked = [(q, rng.choice(["a", "b", None, None, "none"]), text(rng.randrange(6))) for q in range(12)] + [(3, "a", ["rare", "wo01"]), (3, "b", ["rare", "wo02"]), (None, None, same), (50, None, ["rare", "unheard", "often"])]
    frame = lambda rows, schema: spark.createDataFrame([(a, b, " ".join(t)) for a, b, t in rows], schema).repartition(3)
    index, first = NoteIndex(spark, f"{tmp_path}/i"), [n for n in notes if n[0] not in {key(k) for k in range(0, 90, 5)}]
    schema = f"note_id {kind}, category string, text string"
    index.append(frame(first, schema))
    index.append(frame([n for n in notes if n not in first] + first[:20], schema))
    got = {(r.question_id, r.note_id, r.score, r["rank"]) for r in index.search(frame(asked, "question_id long, category string, text string"), top=4).collect()}
    assert got == by_hand(notes, asked, 4) and len(got) > 30


def test_pairs_of_questions_and_notes_are_not_dealt(spark, tmp_path):
    """A note's scores are summed where its row is: one shuffle, of the best notes of each task."""
    index = NoteIndex(spark, f"{tmp_path}/i")
    index.append(spark.createDataFrame([(k, None, f"word{k % 7} word{k % 5}") for k in range(50)], "note_id long, category string, text string"))
    found = index.search(spark.createDataFrame([(q, None, f"word{q}") for q in range(7)], "question_id long, category string, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(question_id") == 1 and "Exchange hashpartitioning(question_id#" in plan and "HashAggregate" not in plan
    assert found.count() == 35
    unheard = spark.createDataFrame([(1, None, "unheard of"), (2, "c", None)], "question_id long, category string, text string")
    assert index.search(unheard).collect() == []

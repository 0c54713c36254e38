"""Sides that go to every task are cut into blocks: as many as there are, the result is the same."""

import pytest
from pyspark.sql import functions as F

from sievemill.operators import retrieval, verification


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_questions_in_blocks(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    notes = retrieval.notes_from_documents(docs)
    asked = items.selectExpr("item_id AS question_id", "CAST(NULL AS string) AS category", "text")
    whole = rows_of(retrieval.shared_keywords(notes, asked, 2))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 100)
    assert rows_of(retrieval.shared_keywords(notes, asked, 2)) == whole and whole


def test_titles_in_blocks_and_hot_words(spark, monkeypatch):
    texts = [(k, "the study of the air " * 3 + f"and word{k} here now") for k in range(60)] + [(60, None), (61, "")]
    titles = [(k, f"air and word{k} here") for k in range(0, 60, 2)] + [(100, "of the air"), (101, "air the of"), (102, "the air"), (103, None), (104, ""), (105, "study of the air")]
    a, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(titles, "item_id long, title string")
    want = sorted((d, i) for d, t in texts for i, x in titles if t and x and x in t)
    assert rows_of(verification.texts_with_titles(a, b)) == want
    monkeypatch.setattr(verification, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(verification, "COUNTED_TEXTS", 7)
    assert rows_of(verification.texts_with_titles(a, b)) == want
    assert verification.texts_with_titles(a.limit(0), b.where(F.lit(False))).collect() == []


@pytest.mark.parametrize("meetings,repeats", [(2_000_000, 0), (50, 0), (50, 3)])
def test_hits_are_told_inside_rows(spark, monkeypatch, meetings, repeats):
    """Against a plain count, with notes in several rows, questions in several rows and categories, nulls and ties; no count of pairs is left where no note repeats."""
    import random
    from collections import Counter

    monkeypatch.setattr(retrieval, "MEETINGS", meetings)
    rng = random.Random(4)
    word = lambda n: " ".join(f"word{rng.randrange(12)}" for _ in range(n)) or None
    notes = [(f"n{k % 200 if k >= 200 else k}", rng.choice(["a", "b", None]), word(rng.randrange(9))) for k in range(200 + 20 * repeats)]
    asked = [(k % 9 if k else None, rng.choice(["a", "c", None]), word(rng.randrange(6))) for k in range(12)]
    want = Counter()
    for q, wanted, question in asked:
        for n, category, text in notes:
            hits = len(set((question or "").split()) & set((text or "").split()))
            if hits and wanted in (None, category):
                want[q, n] += hits
    tables = spark.createDataFrame(notes, "note_id string, category string, text string"), spark.createDataFrame(asked, "question_id long, category string, text string")
    for least in (1, 2, 4):
        enough = {k: v for k, v in want.items() if v >= least}
        found = retrieval.shared_keywords(*tables, least)
        assert {(r.question_id, r.note_id): r.hits for r in found.collect()} == enough and found.count() == len(enough)
        assert ("Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()) == (repeats > 0)
        best = {}
        for (q, n), hits in sorted(enough.items(), key=lambda x: (-x[1], x[0][1])):
            best.setdefault(q, []).append((n, hits))
        got = {}
        for r in sorted(retrieval.search(*tables, 3, least).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.question_id, []).append((r.note_id, r.hits))
        assert got == {q: rows[:3] for q, rows in best.items()}

"""Versions, one-way copies, progress with odd keys, and the note index: broken runs, repeats, appends."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sievemill.functions.text import keywords, progress_key, tokens
from sievemill.operators import progress, retrieval, verification
from sievemill.operators.copies import VersionedCopy
from sievemill.operators.note_index import NoteIndex
from sievemill.versions import Conflict, Versions


def test_versions_are_whole_and_ordered(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/t")
    assert v.latest() == 0 and v.entries() == {}
    assert v.commit({"a": "x"}, 0) == 1 and v.commit({"a": "y", "b": "ü"}, 1) == 2
    assert v.entries(1) == {"a": "x"} and v.entries() == {"a": "y", "b": "ü"} and v.numbers() == [1, 2]
    with pytest.raises(Conflict):
        v.commit({"a": "late"}, 1)
    assert v.entries(2) == {"a": "y", "b": "ü"} and len(os.listdir(f"{tmp_path}/t/manifests")) - sum(n.endswith(".crc") for n in os.listdir(f"{tmp_path}/t/manifests")) == 2
    with pytest.raises(Exception):
        v.entries(9)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_copy(spark, tmp_path, monkeypatch):
    table = lambda rows: spark.createDataFrame(rows, "k long, a string, n long")
    copy = VersionedCopy(spark, f"{tmp_path}/c", "k", buckets=8)
    assert copy.read() is None and copy.run(table([])) == 0
    first = [(k, f"v{k}", k) for k in range(100)]
    assert copy.run(table(first + [(None, "no key", 0), (7, "a smaller row", 0)])) == 1
    assert rows_of(copy.read().select("k", "a", "n")) == rows_of(table(first))
    assert copy.run(table(first)) == 1 and copy.run(table(first[:50])) == 1  # nothing new; what only the copy has stays
    second = [(3, None, 3), (200, "new", 1)]
    with monkeypatch.context() as m:  # broken after the data, before the manifest
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            copy.run(table(second))
    assert copy.versions.latest() == 1 and rows_of(copy.read().select("k", "a", "n")) == rows_of(table(first))
    assert copy.run(table(second)) == 2
    assert rows_of(copy.read().select("k", "a", "n")) == rows_of(table([r for r in first if r[0] != 3] + second))
    assert rows_of(copy.replaced(2).select("k", "a", "n")) == [(3, "v3", 3)]
    assert rows_of(copy.read(1).select("k", "a", "n")) == rows_of(table(first))
    wide = spark.createDataFrame([(5, "v5", 5, "extra")], "k long, a string, n long, more string")
    assert copy.run(wide) == 3 and {r.more for r in copy.read().where("k IN (5, 99)").collect()} == {"extra", None}
    assert copy.read().count() == 101


def test_progress_keys(spark):
    rows = [(None, None, None, None, "1"), (None, "", None, None, "2"), (None, "On it", None, None, "3"), (None, "QT", None, None, "4"), (None, "QT", "Roe", 1999, "5"), (None, "QT", "Roe", 2000, "6"), (" 10.1/A ", "x", None, None, "7"), ("10.1/a", "y", None, None, "8"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doi string, title string, author string, year int, id string")
    got = [r.k for r in df.select(progress_key(F.col("doi"), F.col("title"), F.col("author"), F.col("year"), F.col("id")).alias("k")).collect()]
    assert len(set(got[:6])) == 6 and got[6] == got[7] and got[8] is None
    bare = [r.k for r in df.select(progress_key(F.col("doi"), F.col("title")).alias("k")).collect()]
    assert bare[0] is None and bare[2] != bare[3]


def test_backfill_equals_reconcile(spark, tmp_path):
    records, disk = (spark.createDataFrame([(k, v) for k, v in rows], "progress_key string, path string") for rows in ([("a", "1"), (None, "2")], [("a", "1"), ("b", "4"), ("b", "3"), (None, "5")]))
    only = {r.progress_key for r in progress.reconcile(records, disk).where("status = 'disk_only'").collect()}
    assert rows_of(progress.backfill(records, disk)) == [("b", "3")] and only == {"b"}
    base = f"{tmp_path}/records"
    records.write.parquet(base)
    report = progress.apply_backfill(spark.read.parquet(base), disk, base, apply=True)
    spark.catalog.refreshByPath(base)
    assert rows_of(report) == [("b", "3")]  # what was missing, also after the write
    assert progress.apply_backfill(spark.read.parquet(base), disk, base, apply=True).count() == 0
    spark.catalog.refreshByPath(base)
    assert spark.read.parquet(base).count() == 3


def test_ideographs(spark):
    df = spark.createDataFrame([("空气污染与运动PM2.5对健康的影响", 1), ("猫", 2), (None, 3), ("The 研究 of cats", 4), ("𠀀𠀁𠀂", 5), ("", 6)], "t string, k int")
    got = {r.k: (r.a, r.b) for r in df.select("k", keywords(F.col("t")).alias("a"), tokens(F.col("t")).alias("b")).collect()}
    assert got[1][0] == ["空气", "气污", "污染", "染与", "与运", "运动", "pm2", "对健", "健康", "康的", "的影", "影响"] and "pm2" in got[1][1]
    assert got[2] == (["猫"], ["猫"]) and got[3] == got[6] == ([], [])
    assert got[4][0] == ["研究", "cats"] and got[5][0] == ["𠀀𠀁", "𠀁𠀂"]


def test_chinese_questions_find_chinese_notes(spark):
    notes = spark.createDataFrame([("n1", 1, "c", "长期暴露于细颗粒物会增加心血管疾病的风险"), ("n2", 2, "c", "有氧运动可以改善睡眠质量")], "note_id string, source_id long, category string, text string")
    asked = spark.createDataFrame([(1, None, "细颗粒物与心血管疾病有什么关系"), (2, "x", "有氧运动"), (3, None, "完全无关")], "question_id long, category string, text string")
    got = {r.question_id: (r.verdict, r.citations) for r in retrieval.grounded_answers(asked, retrieval.search(notes, asked)).collect()}
    assert got[1] == ("answered", ["n1"]) and got[2][0] == got[3][0] == "insufficient_evidence"
    files = spark.createDataFrame([("a.pdf", 1, "张伟，李娜。\n空气污染与运动的健康影响。摘要"), ("b.pdf", 1, "别的文章 张伟")], "path string, study_id long, text string")
    studies = spark.createDataFrame([(1, None, "张伟", "空气污染与运动的健康影响")], "study_id long, doi string, author string, title string")
    assert {r.path: r.verdict for r in verification.verify(files, studies).collect()} == {"a.pdf": "verified", "b.pdf": "unverified"}


def test_index_grows_by_appending(spark, tmp_path):
    note = lambda rows: spark.createDataFrame(rows, "note_id string, category string, text string")
    asked = spark.createDataFrame([(1, None, "深度学习 transformer"), (2, "b", "transformer transformer"), (3, None, ""), (4, None, None)], "question_id long, category string, text string")
    index = NoteIndex(spark, f"{tmp_path}/i")
    assert index.search(asked).collect() == []
    assert index.append(note([("1", "a", "transformer models"), ("2", "b", None), (None, "b", "transformer"), ("3", "b", "")])) == 1
    assert [(r.question_id, r.note_id) for r in index.search(asked).collect()] == [(1, "1")]
    before = {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{tmp_path}/i/data") for f in fs}
    time.sleep(0.05)
    more = note([("4", "b", "深度学习"), ("1", "a", "again"), ("5", "b", "transformer " * 50_000)])
    assert index.append(more) == 2
    assert all(os.stat(os.path.join(*k)).st_mtime_ns == t for k, t in before.items())
    got = [(r.question_id, r.note_id, r["rank"]) for r in index.search(asked).orderBy("question_id", "rank").collect()]
    assert {g[:2] for g in got} == {(1, "4"), (1, "1"), (1, "5"), (2, "5")} and got[0] == (1, "4", 1)
    assert [(r.question_id, r.note_id) for r in index.search(asked, version=1).collect()] == [(1, "1")]
    index.append(more)  # again: nothing is doubled
    assert sorted(map(tuple, index.search(asked).collect())) == sorted(map(tuple, index.search(asked, version=2).collect()))


def test_index_in_blocks(spark, tmp_path, monkeypatch):
    from sievemill.operators import note_index

    rows = [(str(k), None, " ".join(f"word{(k * 7 + j) % 40}" for j in range(6))) for k in range(200)]
    index = NoteIndex(spark, f"{tmp_path}/b")
    index.append(spark.createDataFrame(rows, "note_id string, category string, text string"))
    asked = spark.createDataFrame([(q, None, f"word{q} word{q + 1} word{q + 2}") for q in range(30)], "question_id long, category string, text string")
    whole = rows_of(index.search(asked))
    monkeypatch.setattr(note_index, "ASKED_TERMS", 20)
    assert rows_of(index.search(asked)) == whole and len(whole) == 150


def test_an_index_is_written_without_a_shuffle_of_terms(spark, tmp_path, monkeypatch):
    """Notes of one row and of several, against counting by hand; nothing but ids and lengths is dealt."""
    from collections import Counter

    rows = [(k, "c" if k % 3 else None, " ".join(f"w{(k * j) % 11}xx 研究所{'天地'[j % 2]}" for j in range(k % 9))) for k in range(60)]
    rows += [(k, "a", "again 研究 the w1xx") for k in range(0, 60, 10)]
    index = NoteIndex(spark, f"{tmp_path}/i")
    index.append(spark.createDataFrame(rows, "note_id long, category string, text string").repartition(5))
    want, least = {}, {}
    for k, category, text in rows:
        found = want.setdefault(k, Counter())
        for word in text.split():
            found.update([word[i : i + 2] for i in range(len(word) - 1)] if "研" in word else [] if word == "the" else [word])
        least[k] = min((c for c in (category, least.get(k)) if c is not None), default=None)
    folder = index.versions.entries()["segment-000000"]
    got = spark.read.parquet(f"{folder}/postings").collect()
    assert {(r.note_id, r.term, r.times, r.length, r.category) for r in got} == {(k, t, n, sum(c.values()), least[k]) for k, c in want.items() for t, n in c.items()}
    assert len(got) == sum(map(len, want.values()))
    single = spark.createDataFrame(rows[:60], "note_id long, category string, text string")
    written = []
    original = type(single.write).parquet
    monkeypatch.setattr(type(single.write), "parquet", lambda self, path, *a, **k: (written.append((path, self._df._jdf.queryExecution().executedPlan().toString())), original(self, path, *a, **k))[1])
    NoteIndex(spark, f"{tmp_path}/j").append(single)
    plan = next(p for path, p in written if path.endswith("/postings"))
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan

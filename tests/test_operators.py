"""The reference's behaviours, rule by rule, on small tables with nulls, ties, repeats and empty inputs."""

import datetime as dt

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemill.functions.text import doi, file_name, keywords, progress_key
from sievemill.operators import extraction, fallback, progress, queue, retrieval, verification
from sievemill.sources import tables

T0 = dt.datetime(2024, 1, 1)


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'int' if isinstance(values[n], int) else 'string'}" for n in names)).select(column).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [("see doi:10.1234/AbC.5.", "10.1234/abc.5"), ("(https://doi.org/10.10/x)", None), ("10.12345/a(b)c)", "10.12345/a(b)c"), ("x10.1234/a", None), (None, None), ("", None), ("10.1234/a 10.1234/b", "10.1234/a")],
)
def test_doi(spark, text, want):
    assert one(spark, doi(F.col("t")), t=text) == want


def test_keywords_and_names(spark):
    assert one(spark, keywords(F.col("t")), t="The Effect of Air on air, and Health") == ["effect", "air", "health"]
    assert one(spark, keywords(F.col("t")), t=None) == []
    name = file_name(F.col("a"), F.col("y"), F.col("t"))
    assert one(spark, name, a="O'Neil", y=2014, t="Air: the/effect") == "oneil_2014_air-effect.pdf"
    assert one(spark, name, a=None, y=1, t=None) == "anon_1_.pdf"
    key = progress_key(F.col("d"), F.col("t"))
    assert one(spark, key, d="10.1/A", t="x") == one(spark, key, d="10.1/a", t="other")
    assert one(spark, key, d=None, t="Air effect") == one(spark, key, d=None, t="air: EFFECT!")


def test_extraction(spark):
    text = "Intro 10.5\n[3] Smith et al. (2014). Air and health. Lancet. doi:10.1234/AB.1.\nNo author here doi:10.1234/zz\nend"
    rows = extraction.included_studies(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id", "text").orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "Smith", 2014, "Air and health", "Lancet", "10.1234/ab.1"), (1, 2, None, None, None, None, "10.1234/zz")]
    studies = spark.createDataFrame([tuple(r) for r in rows], "id long, line_no int, author string, year int, title string, journal string, doi string")
    assert extraction.project(studies.union(studies), "fast").columns == ["author", "year", "doi", "journal"]
    assert extraction.project(studies.union(studies), "core").count() == 2
    with pytest.raises(KeyError):
        extraction.project(studies, "twenty_one_fields")


def test_page_metadata(spark):
    html = '<html lang="de"><meta name="citation_doi" content="10.1234/X"><title>T\nu</title><meta name=\'citation_pdf_url\' content=\'http://a/b.pdf\'>'
    rows = extraction.page_metadata(spark.createDataFrame([(1, "HTTPS://A.b/c", html), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert tuple(rows[0]) == (1, "a.b", "de", "T\nu", "10.1234/x", "http://a/b.pdf") and tuple(rows[1]) == (2,) + (None,) * 5


def test_citation_tags(spark):
    html = "<META content='A \"b\" > c' NAME=citation_title><meta name='citation_author' content=Roe /><meta content=\"name=citation_doi\" name=citation_author><meta name=citation_date content=2014><meta name='citation_title' content='second'><meta name=citation_journal_title content=''>"
    odd = "<meta " + "x" * 100_000
    rows = extraction.citation_tags(spark.createDataFrame([(1, html), (2, None), (3, odd), (4, "")], "page_id long, html string")).orderBy("page_id").collect()
    assert tuple(rows[0]) == (1, 'A "b" > c', "Roe; name=citation_doi", None, "2014")
    assert [tuple(r)[1:] for r in rows[1:]] == [(None,) * 4] * 3
    loose = extraction.page_metadata(spark.createDataFrame([(1, "http://a.b", "<HTML class='x' lang=en><Title id=t>T</TITLE >")], "page_id long, url string, html string")).first()
    assert (loose.lang, loose.title) == ("en", "T")


@pytest.mark.parametrize(
    "line, want",
    [
        ("Roe, J., & Poe, K. (2014). Air and health. Lancet.", ("Roe", 2014, "Air and health", "Lancet", None)),
        ("[2] Smith and Jones (1999a). Sleep. Sleep Journal. https://doi.org/10.1234/X", ("Smith", 1999, "Sleep", "Sleep Journal", "10.1234/x")),
        ("World Health Organization (2020). Report. Geneva.", ("World Health Organization", 2020, "Report", "Geneva", None)),
        ("a line with (brackets) and 10.5 in it", None),
        ("see (2014). x", None),
    ],
)
def test_reference_lines(spark, line, want):
    rows = extraction.included_studies(spark.createDataFrame([(1, f"x\n{line}\ny")], "id long, text string"), "id", "text").collect()
    assert [tuple(r)[2:] for r in rows] == ([want] if want else [])


ATTEMPT = "study_id long, tier_rank int, source_rank int, source string, ok boolean, ts timestamp, attempt_id long"


def test_fallback(spark):
    tried = [(1, 1, 0, "b", True, T0, 1), (1, 0, 1, "a1", True, T0, 2), (1, 0, 0, "a0", False, T0, 3), (2, 3, 0, "m", False, T0, 4), (3, 4, 0, "w", True, T0 + dt.timedelta(1), 5), (3, 4, 0, "w", True, T0, 6), (3, 4, 0, "w", True, T0, 7), (4, 2, 0, "x", None, T0, 8)]
    chosen = fallback.choose_source(spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 4, 5)], "study_id long"), spark.createDataFrame(tried, ATTEMPT))
    got = {r.study_id: (r.tier, r.attempt_id) for r in chosen.collect()}
    assert got == {1: ("api", 2), 2: ("manual", None), 3: ("web_search", 6), 4: ("manual", None), 5: ("manual", None)}
    rates = fallback.success_rates(chosen.withColumn("case_name", F.when(F.col("study_id") < 3, "a").otherwise("b")))
    assert {tuple(r) for r in rates.collect()} == {("a", 2, 1, 50.0), ("b", 3, 1, 33.3)}
    assert [tuple(r) for r in fallback.cumulative(rates).orderBy("case_name").collect()] == [("a", 2, 1), ("b", 5, 2)]


def test_verification(spark):
    studies = spark.createDataFrame([(1, "10.1234/A", "Smith", "Air pollution and exercise"), (2, None, "Jones", "Sleep quality")], "study_id long, doi string, author string, title string")
    texts = [("right.pdf", 1, "x 10.1234/a."), ("smith_air.pdf", 1, "doi 10.9999/other air pollution exercise smith"), ("c", 1, "SMITH on air pollution"), ("d", 1, "smith"), ("e", 2, "jones sleep quality"), ("f", 1, ""), ("g", 1, None)]
    files = spark.createDataFrame(texts, "path string, study_id long, text string")
    got = {r.path: r.verdict for r in verification.verify(files, studies).collect()}
    assert got == {"right.pdf": "verified", "smith_air.pdf": "mismatch", "c": "verified", "d": "unverified", "e": "verified", "f": "unverified", "g": "unverified"}
    renamed = files.withColumn("path", F.concat(F.lit("10.1234_A_Smith"), "path"))
    assert sorted(r.verdict for r in verification.verify(renamed, studies).collect()) == sorted(got.values())


def test_titles_in_texts(spark, sf_dir):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {tuple(r) for r in verification.texts_with_titles(docs, items.withColumnRenamed("text", "title")).collect()}
    rows, wanted = docs.collect(), items.collect()
    assert got == {(d.doc_id, i.item_id) for d in rows for i in wanted if i.text in d.text} and got
    assert verification.texts_with_titles(docs, items.limit(0).withColumnRenamed("text", "title")).count() == 0


def test_files_of_unknown_studies_are_reported(spark):
    studies = spark.createDataFrame([(1, "10.1234/A", "Smith", "Air")], "study_id long, doi string, author string, title string")
    files = spark.createDataFrame([("a", 2, "10.1234/a smith air"), ("b", None, None), ("c", 1, "10.1234/a")], "path string, study_id long, text string")
    got = {r.path: tuple(r)[1:] for r in verification.verify(files, studies).collect()}
    assert got == {"a": (2, False, False, 0.0, "unverified"), "b": (None, False, False, 0.0, "unverified"), "c": (1, True, False, 0.0, "verified")}


@pytest.mark.parametrize("block", [1, 100])
def test_short_titles_are_found(spark, block):
    texts = spark.createDataFrame([(1, "on deep learning"), (2, "deep  learning"), (3, "learning"), (4, None), (5, ""), (6, "a deep learnings b"), (3, "learning")], "doc_id long, text string")
    titles = spark.createDataFrame([(1, "deep learning"), (2, "learning"), (3, "a deep learnings b"), (4, None), (5, ""), (6, "deep learning")], "item_id long, title string")
    got = sorted(map(tuple, verification.texts_with_titles(texts, titles, block).collect()))
    assert got == [(1, 1), (1, 2), (1, 6), (2, 2), (3, 2), (6, 1), (6, 2), (6, 3), (6, 6)]


def test_progress(spark, tmp_path):
    records = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "progress_key string")
    disk = spark.createDataFrame([("b",), ("c",), (None,)], "progress_key string")
    assert {tuple(r) for r in progress.reconcile(records, disk).collect()} == {("a", "record_only"), ("b", "both"), ("c", "disk_only")}
    out = str(tmp_path / "records")
    assert progress.apply_backfill(records, disk.dropna(), out).count() == 1 and not (tmp_path / "records").exists()
    progress.apply_backfill(records, disk.dropna(), out, apply=True)
    assert [r[0] for r in spark.read.parquet(out).collect()] == ["c"]


def test_sync(spark, tmp_path):
    source, target = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b"), (3, None)], [(2, "old"), (3, None), (4, "own")]))
    assert {tuple(r) for r in progress.sync_plan(source, target, "k", "v").collect()} == {(1, "add"), (2, "replace"), (3, "same"), (4, "keep")}
    backup = str(tmp_path / "backup")
    assert sorted(map(tuple, progress.synced(source, target, "k", "v", backup).collect())) == [(1, "a"), (2, "b"), (3, None), (4, "own")]
    assert [tuple(r) for r in spark.read.parquet(backup).collect()] == [(2, "old")]


def test_repath(spark):
    paths = spark.createDataFrame([("/old/a",), ("/old",), ("/older/a",), ("/x/old/a",), (None,)], "p string")
    assert [r.p for r in progress.repath(paths, "p", "/old/", "/new").collect()] == ["/new/a", "/new", "/older/a", "/x/old/a", None]


def test_cases(spark):
    case = lambda *names: spark.createDataFrame([(n,) for n in names], "case_name string")
    assert tables.resolve_case(case("a", "a", None)) == "a" and tables.resolve_case(case("a", "b"), "b") == "b"
    for bad in (case("a", "b"), case(None)):
        with pytest.raises(ValueError):
            tables.resolve_case(bad)


def test_sources(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"<html>"), ("c.pdf", b"")):
        (tmp_path / "pdf" / name).write_bytes(data)
    assert {r.path[-5:]: r.valid for r in tables.read_pdfs(spark, str(tmp_path / "pdf")).collect()} == {"a.pdf": True, "b.pdf": False}
    files = tables.read_pdfs(spark, str(tmp_path / "pdf")).withColumn("path", F.substring_index("path", "/", -1))
    wanted = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",), ("d.pdf",), ("a.pdf",), (None,)], "path string")
    assert {(r.path, r.state) for r in tables.fetched_pdfs(wanted, files).collect()} == {("a.pdf", "valid"), ("b.pdf", "not_pdf"), ("c.pdf", "missing"), ("d.pdf", "missing")}
    info = str(tmp_path / "info.csv")
    open(info, "w").write("case_name,study_id,author,year,doi,title,journal\nc,1,A,2001, 10.1/X ,T,J\nc,1,A,2001,10.1/X,T,J\nd,2,B,,,U,\n")
    rows = tables.download_input(tables.read_info_table(spark, info), "c").collect()
    assert [(r.study_id, r.doi, r.year) for r in rows] == [("1", "10.1/x", 2001)]
    for _ in range(2):
        tables.write_by_case(tables.read_info_table(spark, info), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("case_name").count().where("case_name = 'd' AND count = 2").count() == 1


def test_grounded(spark):
    notes = spark.createDataFrame([("n1", 1, "a", "air pollution harms runners lungs"), ("n2", 1, "a", "air pollution harms"), ("n3", 2, "b", "air pollution harms runners lungs"), ("n4", 3, "a", None)], "note_id string, source_id long, category string, text string")
    asked = spark.createDataFrame([(1, "a", "Does air pollution harms runners?"), (2, None, "air pollution harms runners lungs"), (3, "a", "quantum gravity"), (4, "a", None)], "question_id long, category string, text string")
    found = retrieval.search(notes, asked)
    assert [tuple(r) for r in found.where("question_id = 2").orderBy("rank").select("note_id", "hits").collect()] == [("n1", 5), ("n3", 5), ("n2", 3)]
    answers = retrieval.grounded_answers(asked, found, least=4)
    assert {r.question_id: (r.verdict, r.citations) for r in answers.collect()} == {1: ("answered", ["n1"]), 2: ("answered", ["n1", "n3"]), 3: ("insufficient_evidence", []), 4: ("insufficient_evidence", [])}
    assert retrieval.invented_citations(answers, notes).count() == 0
    assert retrieval.invented_citations(answers, notes.where("note_id <> 'n3'")).collect()[0].note_id == "n3"
    assert {tuple(r) for r in retrieval.survey(answers, notes).collect()} == {(1, 1, 1), (2, 1, 1), (2, 2, 1)}


ROUND = "task_id long, lane long, batch_id long, paper_id long, pull_ts timestamp, push_ts timestamp"


def test_deadlines(spark):
    rows = [(s, 1, s // 100, s, T0, T0 + dt.timedelta(seconds=s)) for s in (109, 110, 111, 119, 120, 121)] + [(999, 1, 9, 1, T0, None)]
    rounds = queue.round_status(spark.createDataFrame(rows, ROUND))
    assert {r.task_id: r.status for r in rounds.collect()} == {109: "ok", 110: "ok", 111: "at_risk", 119: "at_risk", 120: "at_risk", 121: "timed_out", 999: "timed_out"}
    assert {r.batch_id: (r.tasks, r.late, r.poisoned) for r in queue.batch_outcomes(rounds).collect()} == {1: (6, 1, True), 9: (1, 1, True)}
    said = queue.results(rounds.withColumn("source_text", F.lit("en")).withColumn("target_text", F.when(F.col("task_id") != 109, "zh")))
    assert {r.task_id: (r.result, r.timed_out) for r in said.where("task_id IN (109, 110, 121)").collect()} == {109: ("en", False), 110: ("zh", False), 121: ("en", True)}


#: Task 1 begins while 9 is open and just when 2 begins and ends.
ZERO_LENGTH = [(0, 2, 0, 0), (0, 1, 0, 30), (0, 3, 0, None)]


@settings(max_examples=25, deadline=None)
@example([(0, 3, 0, 50), (0, 1, 5, 30), (0, 2, 5, 0)])
@example(ZERO_LENGTH)
@example([(0, 1, 0, 0), (0, 2, 0, 0), (1, 1, 0, 0), (0, 3, 7, 7), (0, 1, 14, 0)])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 300), st.one_of(st.none(), st.integers(0, 150))), min_size=1, max_size=25))
def test_overlaps_by_hand(spark, drawn):
    rows = [(i, lane, 0, paper, T0 + dt.timedelta(seconds=at), None if took is None else T0 + dt.timedelta(seconds=at + took)) for i, (lane, paper, at, took) in enumerate(drawn)]
    ends = [r[5] or r[4] + dt.timedelta(seconds=120) for r in rows]
    want = {}
    for r in rows:
        n = sum(o[1] == r[1] and o[3] != r[3] and (o[4], o[0]) < (r[4], r[0]) and ends[o[0]] > r[4] for o in rows)
        if n:
            want[r[0]] = n
    assert {r.task_id: r.open_others for r in queue.overlapping(spark.createDataFrame(rows, ROUND), "lane").collect()} == want


def test_overlaps_beside_nulls_and_early_ends(spark):
    second = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(9, 3, 0, 3, second(-5), second(50)), (1, 3, 0, 1, T0, second(30)), (2, 3, 0, 2, T0, T0), (4, 3, 0, 4, T0, second(-3)), (5, None, 0, 5, T0, second(9)), (6, 3, 0, None, T0, second(9)), (7, 3, 0, 7, None, second(9))]
    got = {r.task_id: r.open_others for r in queue.overlapping(spark.createDataFrame(rows, ROUND), "lane").collect()}
    assert got == {1: 1, 2: 2, 4: 2}
    assert queue.overlapping(spark.createDataFrame([], ROUND), "lane").collect() == []


def test_cache_and_archive(spark):
    cache = spark.createDataFrame([(1, "hello there", "hello there"), (2, "hello", "bonjour"), (3, "E = 1", "E = 1"), (4, "x", None)], "id long, source_text string, target_text string")
    assert [r.id for r in queue.poisoned_entries(cache).collect()] == [1]
    assert sorted(r.id for r in queue.purge(cache).collect()) == [2, 3, 4]
    tasks = spark.createDataFrame([(1, 7, None), (2, 7, True), (3, 8, False)], "task_id long, batch_id long, archived boolean")
    done = queue.archive(tasks, 7)
    assert done.count() == 3 and [r.task_id for r in queue.active(done).collect()] == [3]
    assert sorted(r.task_id for r in queue.active(tasks).collect()) == [1, 3]


def test_pairing(spark):
    pulls = spark.createDataFrame([(1, 1, 1, T0), (2, 1, 1, T0)], "task_id long, batch_id long, paper_id long, pull_ts timestamp")
    pushes = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=9)), (1, T0 + dt.timedelta(seconds=5)), (1, T0 - dt.timedelta(seconds=5)), (2, T0 - dt.timedelta(seconds=1))], "task_id long, push_ts timestamp")
    assert {r.task_id: r.push_ts for r in queue.pair_rounds(pulls, pushes).collect()} == {1: T0 + dt.timedelta(seconds=5), 2: None}

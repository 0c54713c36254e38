"""Queries on Chinese notes, questions and files, derived from every document and benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import IDEOGRAPHS, STOPWORDS
from ..operators import retrieval, verification
from ..operators.note_index import NoteIndex
from ..sources.tables import read_table
from ..storage import fresh_path

#: The letters a to z as signs, so that every text gives a Chinese one.
SIGNS = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _chinese(text: str, key: str) -> str:
    """SQL of a text in signs, for two rows of three without its spaces."""
    signs = f"translate(lower({text}), '{LETTERS}', '{SIGNS}')"
    return f"CASE {key} % 3 WHEN 0 THEN replace({signs}, ' ', '') WHEN 1 THEN replace(concat({text}, ' ', {signs}), '  ', ' ') ELSE {signs} END"


STOPS = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def terms_sql(column: str) -> str:
    """DuckDB: words of three letters and pairs of signs, with repeats, in order."""
    apart = f"regexp_replace(lower(coalesce({column}, '')), '([{IDEOGRAPHS}]+)', ' \\1 ', 'g')"
    runs = f"regexp_extract_all({apart}, '[{IDEOGRAPHS}]+|[\\pL\\pN]{{3,}}')"
    grams = f"CASE WHEN NOT regexp_matches(r, '^[{IDEOGRAPHS}]') OR length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda k: substring(r, CAST(k AS INTEGER), 2)) END"
    return f"list_filter(flatten(list_transform({runs}, lambda r: {grams})), lambda w: NOT list_contains({STOPS}, w))"


def chinese_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").selectExpr("doc_id AS note_id", "source AS category", f"{_chinese('text', 'doc_id')} AS text")


def chinese_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").selectExpr("item_id AS question_id", "CASE WHEN item_id % 4 = 0 THEN concat('src', item_id % 20) END AS category", f"{_chinese('text', 'item_id')} AS text")


def ranked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions against an index of all notes, a fifth of which were appended later and some of them twice."""
    notes, index = chinese_notes(spark, sf_dir), NoteIndex(spark, fresh_path(spark, "index"))
    index.append(notes.where("note_id % 5 <> 0"))
    index.append(notes.where("note_id % 5 = 0 OR note_id % 7 = 0"))
    return index.search(chinese_questions(spark, sf_dir))


_translated = {
    name: _chinese("text", key)
    for name, key in (("notes", "doc_id"), ("questions", "item_id"))
}
CHINESE = f"""notes AS (
  SELECT doc_id AS note_id, source AS category, {_translated['notes']} AS text FROM documents
), questions AS (
  SELECT item_id AS question_id, CASE WHEN item_id % 4 = 0 THEN concat('src', item_id % 20) END AS in_category, {_translated['questions']} AS text FROM benchmark
)"""
RANKED = f"""
WITH {CHINESE}, listed AS (
  SELECT note_id, category, {terms_sql('text')} AS t FROM notes
), postings AS (
  SELECT note_id, category, len(t) AS length, term, count(*) AS times FROM (SELECT *, unnest(t) AS term FROM listed) GROUP BY ALL
), stats AS (
  SELECT count(*) AS n, sum(len(t)) / count(*) AS mean FROM listed
), frequency AS (
  SELECT term, count(*) AS notes FROM postings GROUP BY term
), asked AS (
  SELECT DISTINCT question_id, in_category, unnest({terms_sql('text')}) AS term FROM questions
), scored AS (
  SELECT a.question_id, p.note_id, round(sum(ln(1 + (s.n - f.notes + 0.5) / (f.notes + 0.5)) * p.times * CAST(2.2 AS DOUBLE)
         / (p.times + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * p.length / s.mean))), 6) AS score
  FROM asked a JOIN frequency f USING (term) JOIN postings p USING (term) CROSS JOIN stats s WHERE a.in_category IS NULL OR a.in_category = p.category
  GROUP BY 1, 2
)
SELECT question_id, note_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, note_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 5
"""


def chinese_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the same questions that rest on notes sharing eight terms or more."""
    asked = chinese_questions(spark, sf_dir)
    found = retrieval.search(chinese_notes(spark, sf_dir).withColumn("note_id", F.col("note_id").cast("string")), asked)
    answers = retrieval.grounded_answers(asked, found, least=8)
    return answers.select("question_id", "verdict", F.array_join("citations", ",").alias("citations"))


CHINESE_ANSWERS = f"""
WITH {CHINESE}, shared AS (
  SELECT q.question_id, CAST(n.note_id AS VARCHAR) AS note_id, count(*) AS hits
  FROM (SELECT question_id, in_category, unnest(list_distinct({terms_sql('text')})) AS word FROM questions) q
  JOIN (SELECT note_id, category, unnest(list_distinct({terms_sql('text')})) AS word FROM notes) n ON n.word = q.word AND (q.in_category IS NULL OR q.in_category = n.category)
  GROUP BY 1, 2
), found AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, note_id) AS rank FROM shared) WHERE rank <= 5 AND hits >= 8
)
SELECT q.question_id, CASE WHEN count(f.note_id) = 0 THEN 'insufficient_evidence' ELSE 'answered' END AS verdict, coalesce(string_agg(f.note_id, ',' ORDER BY f.rank), '') AS citations
FROM questions q LEFT JOIN found f ON f.question_id = q.question_id GROUP BY 1
"""


def chinese_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file in signs; its study has the first thirty signs of the same text, or of the next document's, as title."""
    docs = read_table(spark, sf_dir, "documents")
    files = docs.selectExpr("'f' AS path", "doc_id AS study_id", f"concat({_chinese('text', 'doc_id')}, CASE WHEN doc_id % 2 = 0 THEN concat('作者：张', doc_id % 97, '王伟') ELSE '' END) AS text")
    wanted = docs.selectExpr(
        "doc_id - doc_id % 4 + (doc_id + CASE WHEN doc_id % 8 < 4 THEN 0 ELSE 1 END) % 4 AS study_id", "CAST(NULL AS STRING) AS doi", "'王伟' AS author",
        f"substring(translate(lower(text), '{LETTERS}', '{SIGNS}'), 1, 30) AS title",
    )
    return verification.verify(files, wanted)


CHINESE_FILES = f"""
WITH files AS (
  SELECT 'f' AS path, doc_id AS study_id, concat({_chinese('text', 'doc_id')}, CASE WHEN doc_id % 2 = 0 THEN concat('作者：张', doc_id % 97, '王伟') ELSE '' END) AS text FROM documents
), studies AS (
  SELECT doc_id - doc_id % 4 + (doc_id + CASE WHEN doc_id % 8 < 4 THEN 0 ELSE 1 END) % 4 AS study_id, substring(translate(lower(text), '{LETTERS}', '{SIGNS}'), 1, 30) AS title FROM documents
), facts AS (
  SELECT f.study_id, s.study_id IS NOT NULL AS known, contains(lower(f.text), '王伟') AND s.study_id IS NOT NULL AS author_ok, {terms_sql('f.text')} AS words, list_distinct({terms_sql('s.title')}) AS keys
  FROM files f LEFT JOIN studies s ON s.study_id = f.study_id
), evidence AS (
  SELECT study_id, known, author_ok, CASE WHEN known AND len(keys) > 0 THEN round(CAST(len(list_intersect(keys, words)) AS DOUBLE) / len(keys), 4) ELSE 0.0 END AS title_share FROM facts
)
SELECT 'f' AS path, study_id, false AS doi_ok, author_ok, title_share, CASE WHEN known AND author_ok AND title_share >= 0.6 THEN 'verified' ELSE 'unverified' END AS verdict FROM evidence
"""

QUERIES = {"ranked_notes": ranked_notes, "chinese_answers": chinese_answers, "chinese_files": chinese_files}
ORACLES = {"ranked_notes": RANKED, "chinese_answers": CHINESE_ANSWERS, "chinese_files": CHINESE_FILES}

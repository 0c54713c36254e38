"""Registered queries over the driver's tables, each with the DuckDB SQL it must agree with.

The tables hold no references, fetched files or rounds, so the queries derive those from every row of
documents, pages, labels, benchmark, part and events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, file_name, keywords, progress_key
from ..operators import extraction, fallback, progress, queue, retrieval, verification
from ..sources.tables import download_input, fetched_pdfs, read_pdfs, read_table, resolve_case, write_by_case, write_files
from ..storage import fresh_path, stored
from ..streaming import queue as streams
from . import copy_queries, damage_queries, file_queries, queue_queries, reference_queries, search_queries, summary_queries, vector_queries

# ---- derived inputs: the same expressions run in Spark and in DuckDB


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a reference line after their own: one, two or more authors, a fifth of them without a DOI."""
    return read_table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source",
        "concat(text, '\n[', doc_id, '] Author', doc_id % 97, CASE doc_id % 4 WHEN 1 THEN ', J., & Poe, K.' WHEN 2 THEN ' and Poe' ELSE ' et al.' END, ' (', 1990 + doc_id % 35, '). Study ', doc_id % 700, ' of ', lang, '. Journal ', doc_id % 13, '.', "
        "CASE WHEN doc_id % 5 <> 0 THEN concat(' doi:10.', 1000 + doc_id % 90, '/ABC.', doc_id % 700, '.') ELSE '' END, '\nEnd') AS text",
    )


REVIEWS = """reviews AS (
  SELECT doc_id, source, text || chr(10) || '[' || doc_id || '] Author' || doc_id % 97
         || CASE doc_id % 4 WHEN 1 THEN ', J., & Poe, K.' WHEN 2 THEN ' and Poe' ELSE ' et al.' END || ' (' || (1990 + doc_id % 35) || '). Study ' || doc_id % 700 || ' of ' || lang
         || '. Journal ' || doc_id % 13 || '.' || CASE WHEN doc_id % 5 <> 0 THEN ' doi:10.' || (1000 + doc_id % 90) || '/ABC.' || doc_id % 700 || '.' ELSE '' END || chr(10) || 'End' AS text
  FROM documents)"""


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").selectExpr(
        "source AS case_name", "cast(doc_id AS string) AS study_id", "concat('Author', doc_id % 97) AS author", "cast(1990 + doc_id % 35 AS int) AS year",
        "CASE WHEN doc_id % 5 <> 0 THEN concat(' 10.', 1000 + doc_id % 90, '/ABC.', doc_id) END AS doi", "split(text, '\n')[0] AS title", "concat('Journal ', doc_id % 13) AS journal",
    )


STUDIES = """studies AS (
  SELECT source AS case_name, CAST(doc_id AS VARCHAR) AS study_id, 'Author' || doc_id % 97 AS author, CAST(1990 + doc_id % 35 AS INTEGER) AS year,
         CASE WHEN doc_id % 5 <> 0 THEN ' 10.' || (1000 + doc_id % 90) || '/ABC.' || doc_id END AS doi, string_split(text, chr(10))[1] AS title, 'Journal ' || doc_id % 13 AS journal
  FROM documents)"""


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round for each event, 0 to 130 s long; every 17th is never pushed."""
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id AS task_id", "user_id % 10 AS lane", "user_id * 1000 + event_id % 1000 AS batch_id", "user_id AS paper_id", "cast(ts AS timestamp) AS pull_ts",
        "CASE WHEN event_id % 17 <> 0 THEN cast(ts AS timestamp) + make_dt_interval(0, 0, 0, event_id % 131) END AS push_ts", "event_type AS source_text",
        "CASE WHEN event_id % 17 <> 0 THEN upper(event_type) END AS target_text",
    )


ROUNDS = """rounds AS (
  SELECT event_id AS task_id, user_id % 10 AS lane, user_id * 1000 + event_id % 1000 AS batch_id, user_id AS paper_id, ts AS pull_ts,
         CASE WHEN event_id % 17 <> 0 THEN ts + to_seconds(event_id % 131) END AS push_ts, event_type AS source_text,
         CASE WHEN event_id % 17 <> 0 THEN upper(event_type) END AS target_text
  FROM events)"""
STATUS = """timed AS (
  SELECT *, (epoch_us(push_ts) - epoch_us(pull_ts)) / 1e6 AS latency,
         CASE WHEN epoch_us(push_ts) - epoch_us(pull_ts) <= 110000000 THEN 'ok' WHEN epoch_us(push_ts) - epoch_us(pull_ts) <= 120000000 THEN 'at_risk' ELSE 'timed_out' END AS status
  FROM rounds)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt for each event: the user is the study, the kind of event the tier."""
    return read_table(spark, sf_dir, "events").selectExpr(
        "user_id AS study_id", "cast(ascii(event_type) % 5 AS int) AS tier_rank", "cast(event_id % 4 AS int) AS source_rank", "concat('source', event_id % 4) AS source",
        "event_id % 40 = user_id % 40 AS ok", "ts", "event_id AS attempt_id",
    )


ATTEMPTS = """attempts AS (
  SELECT user_id AS study_id, CAST(ascii(event_type) % 5 AS INTEGER) AS tier_rank, event_id % 4 AS source_rank, 'source' || event_id % 4 AS source,
         event_id % 40 = user_id % 40 AS ok, ts, event_id AS attempt_id FROM events)"""
WORDS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\\pL\\pN]+'), lambda w: w <> '')"
STOPS = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
#: Distinct words of three letters or more in order of first place, without stopwords.
KEYS = f"list_filter(list_transform(list_filter(list_zip({WORDS}, range(1, len({WORDS}) + 1)), lambda p: list_position({WORDS}, p[1]) = p[2]), lambda p: p[1]), lambda w: length(w) > 2 AND NOT list_contains({STOPS}, w))"

# ---- queries


def included_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.included_studies(reviews(spark, sf_dir), "doc_id", "text").withColumnRenamed("id", "doc_id").withColumn("line_no", F.col("line_no").cast("long"))


INCLUDED = f"""
WITH {REVIEWS}, lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM reviews
), found AS (
  SELECT *, regexp_extract(line, '^(?:\\[[0-9]+\\]\\s*)?([^(),;]+?)(?:[,;][^()]*| et al\\.?| (?:and|&) [^()]*)? \\(((?:19|20)[0-9]{{2}})[a-z]?\\)\\. ([^.]+)\\. ([^.]+)\\.', ['author', 'year', 'title', 'journal']) AS m,
         nullif(lower(regexp_extract(line, '(?i)\\b(10\\.[0-9]{{4,9}}/[^\\s"''<>]*[^\\s"''<>.,;:()\\[\\]])', 1)), '') AS doi
  FROM lines
)
SELECT doc_id, line_no, nullif(trim(m.author), '') AS author, CAST(nullif(m.year, '') AS INTEGER) AS year, nullif(trim(m.title), '') AS title, nullif(trim(m.journal), '') AS journal, doi
FROM found WHERE doi IS NOT NULL OR m.year <> ''
"""


def studies_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.project(included_studies(spark, sf_dir), "fast")


def studies_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.project(included_studies(spark, sf_dir), "core")


def prepared_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return download_input(studies(spark, sf_dir))


PREPARED = f"WITH {STUDIES} SELECT case_name, study_id, lower(trim(doi)) AS doi, author, year, title FROM studies"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with bibliographic tags, their attributes in several orders and quotings."""
    return read_table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url",
        r"""replace(CASE WHEN page_id % 5 = 0 THEN replace(html, '<html lang="en"', '<HTML class=x lang=en') ELSE html END, '<title>', concat(
           CASE page_id % 3 WHEN 0 THEN concat('<meta name="citation_doi" content="10.1234/P.', page_id, '"><meta content="name=citation_title > ', page_id, '" name="citation_title">')
                            WHEN 1 THEN concat('<META CONTENT=\'The "title" of ', page_id, '\' Name=citation_title /><meta name=citation_author content="Roe, J."><meta name=\'citation_author\' content=Poe><meta property="x" content="y">')
                            ELSE concat('<meta data-x="1" name="citation_date" content="', 1990 + page_id % 35, '"><meta name="citation_journal_title" content="Journal ', page_id % 13, '"><meta name="citation_pdf_url" content="http://a.b/', page_id, '.pdf"><meta name="citation_title" content="">') END,
           CASE WHEN page_id % 4 = 0 THEN '<Title class="t">' ELSE '<title>' END)) AS html""",
    )


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.page_metadata(_tagged(spark, sf_dir))


def citation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.citation_tags(_tagged(spark, sf_dir))


def _attribute(tag: str, name: str) -> str:
    every = r"""'([A-Za-z][A-Za-z0-9:_.-]*)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)'"""
    return f"""nullif(regexp_replace(regexp_extract_all({tag}, {every}, 2)[list_position(list_transform(regexp_extract_all({tag}, {every}, 1), lambda n: lower(n)), '{name}')], '^["'']|["'']$', '', 'g'), '')"""


def _tag(name: str) -> str:
    return rf"""'(?i)<{name}\b[^>"'']*(?:"[^"]*"[^>"'']*|''[^'']*''[^>"'']*)*>'"""


TAGGED = rf"""
WITH tagged AS (
  SELECT page_id, url, replace(CASE WHEN page_id % 5 = 0 THEN replace(html, '<html lang="en"', '<HTML class=x lang=en') ELSE html END, '<title>',
    CASE page_id % 3 WHEN 0 THEN '<meta name="citation_doi" content="10.1234/P.' || page_id || '"><meta content="name=citation_title > ' || page_id || '" name="citation_title">'
                     WHEN 1 THEN '<META CONTENT=''The "title" of ' || page_id || ''' Name=citation_title /><meta name=citation_author content="Roe, J."><meta name=''citation_author'' content=Poe><meta property="x" content="y">'
                     ELSE '<meta data-x="1" name="citation_date" content="' || (1990 + page_id % 35) || '"><meta name="citation_journal_title" content="Journal ' || page_id % 13 || '"><meta name="citation_pdf_url" content="http://a.b/' || page_id || '.pdf"><meta name="citation_title" content="">' END
    || CASE WHEN page_id % 4 = 0 THEN '<Title class="t">' ELSE '<title>' END) AS html
  FROM pages
), found AS (
  SELECT page_id, url, html, list_filter(list_transform(
    regexp_extract_all(html, {_tag('meta')}), lambda t: {{'name': lower({_attribute('t', 'name')}), 'content': {_attribute('t', 'content')}}}), lambda m: m.name IS NOT NULL AND m.content IS NOT NULL) AS tags
  FROM tagged
)
"""
PAGES = rf"""{TAGGED}
SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '') AS host,
       {_attribute(f"regexp_extract(html, {_tag('html')})", 'lang')} AS lang,
       nullif(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '') AS title,
       lower(list_filter(tags, lambda m: m.name = 'citation_doi')[1].content) AS doi,
       list_filter(tags, lambda m: m.name = 'citation_pdf_url')[1].content AS pdf_url
FROM found
"""
CITATIONS = rf"""{TAGGED}
SELECT page_id, list_filter(tags, lambda m: m.name = 'citation_title')[1].content AS citation_title,
       nullif(array_to_string(list_transform(list_filter(tags, lambda m: m.name = 'citation_author'), lambda m: m.content), '; '), '') AS authors,
       list_filter(tags, lambda m: m.name = 'citation_journal_title')[1].content AS journal,
       coalesce(list_filter(tags, lambda m: m.name = 'citation_publication_date')[1].content, list_filter(tags, lambda m: m.name = 'citation_date')[1].content) AS published
FROM found
"""


def study_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title keywords, file name and progress key of every study."""
    return studies(spark, sf_dir).select("study_id", F.array_join(keywords(F.col("title")), " ").alias("title_keywords"), file_name(F.col("author"), F.col("year"), F.col("title")).alias("file_name"), progress_key(F.col("doi"), F.col("title"), F.col("author"), F.col("year"), F.col("study_id")).alias("progress_key"))


KEYED = f"""
WITH {STUDIES}, keyed AS (SELECT *, {KEYS.format('title')} AS keys, array_to_string({WORDS.format('title')}, ' ') AS words FROM studies)
SELECT study_id, array_to_string(keys, ' ') AS title_keywords,
       lower(author) || '_' || year || '_' || array_to_string(keys[1:6], '-') || '.pdf' AS file_name,
       sha256(coalesce(lower(trim(doi)), CASE WHEN words <> '' THEN words || '|' || lower(author) || '|' || year ELSE 'study|' || study_id END)) AS progress_key
FROM keyed
"""


def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = attempts(spark, sf_dir)
    return fallback.choose_source(tried.select("study_id"), tried)


CHOSEN = """chosen AS (
  SELECT s.study_id, CAST(coalesce(a.tier_rank, 5) AS INTEGER) AS tier_rank, coalesce(['api', 'publisher_tags', 'mirror_a', 'mirror_b', 'web_search'][a.tier_rank + 1], 'manual') AS tier, a.source, a.attempt_id
  FROM (SELECT DISTINCT study_id FROM attempts) s
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY tier_rank, source_rank, ts, attempt_id) AS rn FROM attempts WHERE ok) a ON a.study_id = s.study_id AND a.rn = 1)"""


def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.success_rates(source_fallback(spark, sf_dir).withColumn("case_name", F.concat(F.lit("case"), F.col("study_id") % 7)))


RATES = f"""rates AS (
  SELECT 'case' || study_id % 7 AS case_name, count(*) AS studies, CAST(sum(CAST(tier <> 'manual' AS INT)) AS BIGINT) AS found,
         round(100.0 * sum(CAST(tier <> 'manual' AS INT)) / count(*), 1) AS rate
  FROM chosen GROUP BY 1)"""


def success_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.cumulative(success_rates(spark, sf_dir))


def verified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fetched file, under the name of a study or of none; a third show their DOI, a seventh another one."""
    docs = read_table(spark, sf_dir, "documents")
    files = docs.selectExpr(
        "concat('file', doc_id % 50, '.pdf') AS path", "concat(CASE WHEN doc_id % 23 = 0 THEN 'none-' ELSE '' END, doc_id) AS study_id",
        "concat(text, CASE WHEN doc_id % 7 = 0 THEN ' doi:10.9999/other.1' WHEN doc_id % 3 = 0 THEN concat(' 10.', 1000 + doc_id % 90, '/ABC.', doc_id, '.') ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN concat(' AUTHOR', doc_id % 97) ELSE '' END) AS text",
    )
    wanted = studies(spark, sf_dir).withColumn("doi", F.trim("doi"))
    return verification.verify(files, wanted)


VERIFIED = f"""
WITH {STUDIES}, files AS (
  SELECT 'file' || doc_id % 50 || '.pdf' AS path, CASE WHEN doc_id % 23 = 0 THEN 'none-' ELSE '' END || doc_id AS study_id,
         text || CASE WHEN doc_id % 7 = 0 THEN ' doi:10.9999/other.1' WHEN doc_id % 3 = 0 THEN ' 10.' || (1000 + doc_id % 90) || '/ABC.' || doc_id || '.' ELSE '' END
         || CASE WHEN doc_id % 2 = 0 THEN ' AUTHOR' || doc_id % 97 ELSE '' END AS text
  FROM documents
), facts AS (
  SELECT f.path, f.study_id, s.study_id IS NOT NULL AS known, lower(trim(s.doi)) AS doi, nullif(lower(regexp_extract(f.text, '(?i)\\b(10\\.[0-9]{{4,9}}/[^\\s"''<>]*[^\\s"''<>.,;:()\\[\\]])', 1)), '') AS seen,
         {WORDS.format('f.text')} AS words, lower(s.author) AS author, {KEYS.format('s.title')} AS keys
  FROM files f LEFT JOIN studies s ON s.study_id = f.study_id
), evidence AS (
  SELECT path, study_id, known, seen, coalesce(seen = doi, false) AS doi_ok, coalesce(list_contains(words, author), false) AS author_ok,
         CASE WHEN known AND len(keys) > 0 THEN round(CAST(len(list_intersect(keys, words)) AS DOUBLE) / len(keys), 4) ELSE 0.0 END AS title_share
  FROM facts)
SELECT path, study_id, doi_ok, author_ok, title_share,
       CASE WHEN NOT known THEN 'unverified' WHEN doi_ok THEN 'verified' WHEN seen IS NOT NULL THEN 'mismatch' WHEN author_ok AND title_share >= 0.6 THEN 'verified' ELSE 'unverified' END AS verdict
FROM evidence
"""


def titles_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items as titles, and the first two words or the fifth word of each."""
    items = read_table(spark, sf_dir, "benchmark")
    titles = items.selectExpr("item_id", "text AS title").unionByName(
        items.selectExpr("item_id + 1000000 AS item_id", "CASE WHEN item_id % 2 = 0 THEN concat(split(text, ' ')[0], ' ', split(text, ' ')[1]) ELSE split(text, ' ')[4] END AS title")
    )
    return verification.texts_with_titles(read_table(spark, sf_dir, "documents"), titles)


TITLES = """
WITH titles AS (
  SELECT item_id, text AS title FROM benchmark
  UNION ALL
  SELECT item_id + 1000000, CASE WHEN item_id % 2 = 0 THEN string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] ELSE string_split(text, ' ')[5] END FROM benchmark
)
SELECT d.doc_id, t.item_id FROM documents d JOIN titles t ON contains(d.text, t.title)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").selectExpr("CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id")


def progress_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.reconcile(_records(spark, sf_dir), read_table(spark, sf_dir, "documents"), "doc_id")


RECORDS = "records AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id FROM labels)"
RECONCILED = f"""
WITH {RECORDS}
SELECT coalesce(r.doc_id, d.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'disk_only' WHEN d.doc_id IS NULL THEN 'record_only' ELSE 'both' END AS status
FROM records r FULL JOIN (SELECT DISTINCT doc_id FROM documents) d ON r.doc_id = d.doc_id
"""


def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_status(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def progress_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.backfill(_records(spark, sf_dir), read_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, against a copy in which some have other names; on each side some are known under a key of its own."""
    parts = read_table(spark, sf_dir, "part")
    source = parts.selectExpr("CASE WHEN p_partkey % 13 = 0 THEN -2 * p_partkey ELSE p_partkey END AS p_partkey", "p_name")
    target = parts.selectExpr("CASE WHEN p_partkey % 7 = 0 THEN -2 * p_partkey - 1 ELSE p_partkey END AS p_partkey", "CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) ELSE p_name END AS p_name")
    return progress.sync_plan(source, target, "p_partkey", "p_name")


SYNC = """
SELECT coalesce(s.p_partkey, t.p_partkey) AS p_partkey,
       CASE WHEN t.p_partkey IS NULL THEN 'add' WHEN s.p_partkey IS NULL THEN 'keep' WHEN s.p_name IS NOT DISTINCT FROM t.p_name THEN 'same' ELSE 'replace' END AS action
FROM (SELECT CASE WHEN p_partkey % 13 = 0 THEN -2 * p_partkey ELSE p_partkey END AS p_partkey, p_name FROM part) s
FULL JOIN (SELECT CASE WHEN p_partkey % 7 = 0 THEN -2 * p_partkey - 1 ELSE p_partkey END AS p_partkey, CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part) t
  ON s.p_partkey = t.p_partkey
"""


def moved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(CASE doc_id % 3 WHEN 0 THEN '/old/vault/' WHEN 1 THEN '/old/vault2/' ELSE '/new/' END, source, '/', doc_id, '.md') AS path")
    return progress.repath(docs, "path", "/old/vault", "/moved/")


MOVED = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/moved/' WHEN 1 THEN '/old/vault2/' ELSE '/new/' END || source || '/' || doc_id || '.md' AS path FROM documents"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").selectExpr("item_id AS question_id", "CASE WHEN item_id % 4 <> 0 THEN concat('src', item_id % 20) END AS category", "text")


def note_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(retrieval.notes_from_documents(read_table(spark, sf_dir, "documents")), _questions(spark, sf_dir))


SEARCH = f"""notes AS (
  SELECT doc_id || '-' || line_no AS note_id, doc_id AS source_id, source AS category, text
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents) WHERE text <> ''
), questions AS (
  SELECT item_id AS question_id, CASE WHEN item_id % 4 <> 0 THEN 'src' || item_id % 20 END AS in_category, text FROM benchmark
), shared AS (
  SELECT q.question_id, n.note_id, count(*) AS hits
  FROM (SELECT question_id, in_category, unnest({KEYS.format('text')}) AS word FROM questions) q
  JOIN (SELECT note_id, category, unnest({KEYS.format('text')}) AS word FROM notes) n ON n.word = q.word AND (q.in_category IS NULL OR q.in_category = n.category)
  GROUP BY 1, 2
), found AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, note_id) AS INTEGER) AS rank FROM shared) WHERE rank <= 5)"""


def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = retrieval.grounded_answers(_questions(spark, sf_dir), note_search(spark, sf_dir))
    return answers.select("question_id", "verdict", F.array_join("citations", ",").alias("citations"))


ANSWERS = f"""
WITH {SEARCH}
SELECT q.question_id, CASE WHEN count(f.note_id) = 0 THEN 'insufficient_evidence' ELSE 'answered' END AS verdict, coalesce(string_agg(f.note_id, ',' ORDER BY f.rank), '') AS citations
FROM questions q LEFT JOIN found f ON f.question_id = q.question_id AND f.hits >= 3 GROUP BY 1
"""


def invented_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer's citations against the notes, with one invented note added to each question."""
    notes = retrieval.notes_from_documents(read_table(spark, sf_dir, "documents"))
    answers = retrieval.grounded_answers(_questions(spark, sf_dir), retrieval.search(notes, _questions(spark, sf_dir)))
    spoilt = answers.withColumn("citations", F.array_append("citations", F.concat(F.lit("invented-"), F.col("question_id"))))
    return retrieval.invented_citations(spoilt, notes)


INVENTED = f"""
WITH {SEARCH}, cited AS (
  SELECT question_id, note_id FROM found WHERE hits >= 3 UNION ALL SELECT question_id, 'invented-' || question_id FROM questions
)
SELECT question_id, note_id FROM cited c WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.note_id = c.note_id)
"""


def survey_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note with three shared keywords or more, by question and source."""
    notes = retrieval.notes_from_documents(read_table(spark, sf_dir, "documents"))
    return retrieval.survey_of(retrieval.shared_keywords(notes, _questions(spark, sf_dir), least=3), notes)


SURVEY = f"WITH {SEARCH} SELECT f.question_id, n.source_id, count(*) AS notes FROM shared f JOIN notes n USING (note_id) WHERE f.hits >= 3 GROUP BY 1, 2"


def round_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = queue.results(queue.round_status(rounds(spark, sf_dir)))
    return timed.select("task_id", "batch_id", "latency", "status", "result", "timed_out")


def paired_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulls joined with their pushes, some of which come twice."""
    all_rounds = rounds(spark, sf_dir)
    pushes = all_rounds.where("push_ts IS NOT NULL").select("task_id", "push_ts")
    again = pushes.where("task_id % 3 = 0").withColumn("push_ts", F.expr("push_ts + INTERVAL 5 SECONDS"))
    paired = queue.round_status(queue.pair_rounds(all_rounds.drop("push_ts"), pushes.unionByName(again)))
    return paired.groupBy("status").agg(F.count(F.lit(1)).alias("rounds"), F.sum("latency").alias("latency"))


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.batch_outcomes(queue.round_status(rounds(spark, sf_dir).withColumn("batch_id", F.expr("batch_id div 10"))))


OUTCOMES = f"""
WITH {ROUNDS}, {STATUS}
SELECT batch_id // 10 AS batch_id, count(*) AS tasks, CAST(sum(CAST(status = 'timed_out' AS INT)) AS BIGINT) AS late, bool_or(status = 'timed_out') AS poisoned FROM timed GROUP BY 1
"""


def overlapping_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.overlapping(rounds(spark, sf_dir), "lane")


OVERLAPS = f"""
WITH {ROUNDS}, spans AS (SELECT *, coalesce(push_ts, pull_ts + INTERVAL 120 SECONDS) AS end_ts FROM rounds)
SELECT a.task_id, count(*) AS open_others
FROM spans a JOIN spans b ON a.lane = b.lane AND a.paper_id <> b.paper_id AND (b.pull_ts < a.pull_ts OR (b.pull_ts = a.pull_ts AND b.task_id < a.task_id)) AND b.end_ts > a.pull_ts
GROUP BY 1
"""


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS entry_id", "CASE WHEN doc_id % 11 = 0 THEN concat('E = ', doc_id) ELSE text END AS source_text",
        "CASE WHEN doc_id % 11 = 0 THEN concat('E = ', doc_id) WHEN doc_id % 4 = 0 THEN text ELSE concat('~', text) END AS target_text",
    )


CACHE = """cache AS (
  SELECT doc_id AS entry_id, CASE WHEN doc_id % 11 = 0 THEN 'E = ' || doc_id ELSE text END AS source_text,
         CASE WHEN doc_id % 11 = 0 THEN 'E = ' || doc_id WHEN doc_id % 4 = 0 THEN text ELSE '~' || text END AS target_text
  FROM documents)"""


def cache_poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.poisoned_entries(_cache(spark, sf_dir)).select("entry_id")


def cache_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.purge(_cache(spark, sf_dir)).select("entry_id", "target_text")


def archived_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks still active once the first paper's batches are archived, by batch; no row is lost on the way."""
    tasks = rounds(spark, sf_dir).selectExpr("task_id", "paper_id AS batch_id", "task_id % 29 = 0 AS archived")
    return queue.active(queue.archive(tasks, 1)).groupBy("batch_id").agg(F.count(F.lit(1)).alias("tasks"))


ARCHIVED = "SELECT user_id AS batch_id, count(*) AS tasks FROM events WHERE event_id % 29 <> 0 AND user_id <> 1 GROUP BY 1"


def streamed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds read as two streams, some pushes twice, joined within the engine's limit, and counted by status."""
    base = fresh_path(spark, "rounds")
    both = rounds(spark, sf_dir)
    pulls = both.select("task_id", "batch_id", "pull_ts")
    pushes = both.where("push_ts IS NOT NULL").select("task_id", "push_ts")
    pushes = pushes.unionByName(pushes.where("task_id % 3 = 0").withColumn("push_ts", F.expr("push_ts + INTERVAL 5 SECONDS")))
    for name, rows, column in (("pulls", pulls, "pull_ts"), ("pushes", pushes, "push_ts")):
        rows.unionByName(streams.sentinel(spark, rows, column, "2100-01-01")).write.parquet(f"{base}/{name}")
    joined = streams.joined_rounds(streams.read_stream(spark, f"{base}/pulls", pulls.schema, 1000), streams.read_stream(spark, f"{base}/pushes", pushes.schema, 1000))
    done = streams.drained(streams.status_of(joined), f"{base}/out", f"{base}/checkpoint")
    return done.where("task_id >= 0").groupBy("status").agg(F.count(F.lit(1)).alias("rounds"))


def fetched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for most suppliers, some of which aren't PDFs, read back as bytes and held against the list of all."""
    base = fresh_path(spark, "pdfs")
    suppliers = read_table(spark, sf_dir, "supplier")
    written = suppliers.where("s_suppkey % 5 <> 0").selectExpr("s_suppkey", "concat(CASE WHEN s_suppkey % 3 = 0 THEN '<html>' ELSE '%PDF-1.7 ' END, s_name) AS value")
    write_files(written, "s_suppkey", base)
    files = read_pdfs(spark, base).withColumn("path", F.regexp_extract("path", r"s_suppkey=(\d+)/", 1))
    found = fetched_pdfs(suppliers.select(F.col("s_suppkey").cast("string").alias("path")), files)
    return found.select(F.col("path").cast("long").alias("s_suppkey"), "length", "state")


FETCHED = """
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(CASE WHEN s_suppkey % 3 = 0 THEN 7 ELSE 10 END + strlen(s_name) AS BIGINT) END AS length,
       CASE WHEN s_suppkey % 5 = 0 THEN 'missing' WHEN s_suppkey % 3 = 0 THEN 'not_pdf' ELSE 'valid' END AS state
FROM supplier
"""


def outputs_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen sources written by case in two goes, each case read back from its own folder."""
    base = fresh_path(spark, "cases")
    chosen = source_fallback(spark, sf_dir).withColumn("case_name", F.concat(F.lit("case"), F.col("study_id") % 7))
    for part in ("study_id % 2 = 0", "study_id % 2 = 1"):
        write_by_case(chosen.where(part), base)
    return spark.read.schema(chosen.schema).parquet(base).groupBy("case_name", "tier").agg(F.count(F.lit(1)).alias("studies"))


def applied_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records after a report, which writes nothing, and after the missing ones have been filled in."""
    base = fresh_path(spark, "records")
    _records(spark, sf_dir).write.parquet(base)
    disk = read_table(spark, sf_dir, "documents").select("doc_id")
    for apply in (False, True):
        progress.apply_backfill(spark.read.parquet(base), disk, base, "doc_id", apply)
        spark.catalog.refreshByPath(base)
    return spark.read.parquet(base)


def only_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download input of the one case there is, which nobody has named."""
    info = stored(studies(spark, sf_dir).withColumn("case_name", F.lit("review")), "info")
    return download_input(info, resolve_case(info))


def timed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all rounds by event-time timers, counted by status."""
    base = fresh_path(spark, "timed")
    both = rounds(spark, sf_dir)
    events = both.selectExpr("task_id", "pull_ts AS event_ts", "'pull' AS kind").unionByName(both.where("push_ts IS NOT NULL").selectExpr("task_id", "push_ts AS event_ts", "'push' AS kind"))
    events.unionByName(streams.sentinel(spark, events, "event_ts", "2100-01-01")).write.parquet(f"{base}/events")
    with streams.rocksdb(spark):
        done = streams.drained(streams.timed_rounds(streams.read_stream(spark, f"{base}/events", events.schema, 1000)), f"{base}/out", f"{base}/checkpoint")
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("rounds"))


QUERIES = {
    "included_studies": included_studies,
    "studies_fast": studies_fast,
    "studies_core": studies_core,
    "prepared_downloads": prepared_downloads,
    "page_metadata": page_metadata,
    "citation_tags": citation_tags,
    "study_keys": study_keys,
    "source_fallback": source_fallback,
    "success_rates": success_rates,
    "success_totals": success_totals,
    "verified_files": verified_files,
    "titles_in_texts": titles_in_texts,
    "progress_status": progress_status,
    "progress_counts": progress_counts,
    "progress_backfill": progress_backfill,
    "sync_actions": sync_actions,
    "moved_paths": moved_paths,
    "note_search": note_search,
    "grounded_answers": grounded_answers,
    "invented_citations": invented_citations,
    "survey_material": survey_material,
    "round_status": round_status,
    "paired_rounds": paired_rounds,
    "batch_outcomes": batch_outcomes,
    "overlapping_rounds": overlapping_rounds,
    "cache_poisoned": cache_poisoned,
    "cache_purged": cache_purged,
    "archived_queue": archived_queue,
    "streamed_rounds": streamed_rounds,
    "timed_rounds": timed_rounds,
    "fetched_files": fetched_files,
    "outputs_by_case": outputs_by_case,
    "applied_backfill": applied_backfill,
    "only_case": only_case,
}
MORE = (search_queries, copy_queries, reference_queries, damage_queries, queue_queries, file_queries, vector_queries, summary_queries)
for _module in MORE:
    QUERIES |= _module.QUERIES

_inner = INCLUDED.strip()
BY_STATUS = f"WITH {ROUNDS}, {STATUS} SELECT status, count(*) AS rounds FROM timed GROUP BY 1"
ORACLES = {
    "included_studies": INCLUDED,
    "studies_fast": f"SELECT DISTINCT author, year, doi, journal FROM ({_inner})",
    "studies_core": f"SELECT DISTINCT author, year, doi, title, journal FROM ({_inner})",
    "prepared_downloads": PREPARED,
    "page_metadata": PAGES,
    "citation_tags": CITATIONS,
    "study_keys": KEYED,
    "source_fallback": f"WITH {ATTEMPTS}, {CHOSEN} SELECT * FROM chosen",
    "success_rates": f"WITH {ATTEMPTS}, {CHOSEN}, {RATES} SELECT * FROM rates",
    "success_totals": f"WITH {ATTEMPTS}, {CHOSEN}, {RATES} SELECT case_name, CAST(sum(studies) OVER w AS BIGINT) AS studies_so_far, CAST(sum(found) OVER w AS BIGINT) AS found_so_far FROM rates WINDOW w AS (ORDER BY case_name)",
    "verified_files": VERIFIED,
    "titles_in_texts": TITLES,
    "progress_status": RECONCILED,
    "progress_counts": f"SELECT status, count(*) AS files FROM ({RECONCILED.strip()}) GROUP BY 1",
    "progress_backfill": f"WITH {RECORDS} SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.doc_id = d.doc_id)",
    "sync_actions": SYNC,
    "moved_paths": MOVED,
    "note_search": f"WITH {SEARCH} SELECT question_id, note_id, hits, rank FROM found",
    "grounded_answers": ANSWERS,
    "invented_citations": INVENTED,
    "survey_material": SURVEY,
    "round_status": f"WITH {ROUNDS}, {STATUS} SELECT task_id, batch_id, latency, status, CASE WHEN status = 'timed_out' THEN source_text ELSE coalesce(target_text, source_text) END AS result, status = 'timed_out' AS timed_out FROM timed",
    "paired_rounds": f"WITH {ROUNDS}, {STATUS} SELECT status, count(*) AS rounds, sum(latency) AS latency FROM timed GROUP BY 1",
    "batch_outcomes": OUTCOMES,
    "overlapping_rounds": OVERLAPS,
    "cache_poisoned": f"WITH {CACHE} SELECT entry_id FROM cache WHERE target_text = source_text AND regexp_matches(source_text, '\\pL{{3}}')",
    "cache_purged": f"WITH {CACHE} SELECT entry_id, target_text FROM cache WHERE NOT coalesce(target_text = source_text AND regexp_matches(source_text, '\\pL{{3}}'), false)",
    "archived_queue": ARCHIVED,
    "streamed_rounds": BY_STATUS,
    "timed_rounds": BY_STATUS,
    "fetched_files": FETCHED,
    "outputs_by_case": f"WITH {ATTEMPTS}, {CHOSEN} SELECT 'case' || study_id % 7 AS case_name, tier, count(*) AS studies FROM chosen GROUP BY 1, 2",
    "applied_backfill": """
WITH records AS (SELECT CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id FROM labels)
SELECT doc_id FROM records UNION ALL SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM records)
""",
    "only_case": f"WITH {STUDIES} SELECT 'review' AS case_name, study_id, lower(trim(doi)) AS doi, author, year, title FROM studies",
}
for _module in MORE:
    ORACLES |= _module.ORACLES

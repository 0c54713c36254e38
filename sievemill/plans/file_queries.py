"""Queries on files: a small PDF for every supplier, some of them spoilt on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_damaged_info, read_structures, read_table, write_files
from ..storage import fresh_path

_HEAD = "'%PDF-1.4\n'"
_FIRST = "concat('1 0 obj\n<< /Type /Catalog /Name (', s_name, ') >>\nendobj\n')"
_SECOND = "concat('2 0 obj\n<< /Length ', length(s_name), ' >>\nendobj\n')"


def pdf_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound files, cut ones, pages of markup, plain texts, and some whose table points beside an object; all read back as bytes."""
    base = fresh_path(spark, "structures")
    parts = read_table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_name", f"{_HEAD} AS head", f"{_FIRST} AS first", f"{_SECOND} AS second")
    shift = "CASE WHEN s_suppkey % 6 = 3 THEN 2 ELSE 0 END"
    body = parts.selectExpr("s_suppkey", "s_name", "concat(head, first, second) AS body", "length(head) AS a", f"length(head) + length(first) + {shift} AS b")
    entry = lambda at: f"concat(lpad({at}, 10, '0'), ' 00000 n \n')"
    whole = body.selectExpr(
        "s_suppkey", "s_name",
        f"concat(body, 'xref\n0 3\n0000000000 65535 f \n', {entry('a')}, {entry('b')}, 'trailer\n<< /Size 3 /Root 1 0 R >>\nstartxref\n', length(body), '\n%%EOF') AS pdf",
    )
    written = whole.selectExpr("s_suppkey", "CASE s_suppkey % 6 WHEN 1 THEN substring(pdf, 1, length(pdf) - 40) WHEN 2 THEN concat('<!DOCTYPE html><html>', s_name) WHEN 4 THEN s_name ELSE pdf END AS value")
    write_files(written, "s_suppkey", base)
    return read_structures(spark, base).select(F.regexp_extract("path", r"s_suppkey=(\d+)/", 1).cast("long").alias("s_suppkey"), "state", "version", "objects", "misplaced").where("s_suppkey IS NOT NULL")


STRUCTURE = """
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE s_suppkey % 6 WHEN 1 THEN 'truncated' WHEN 2 THEN 'html' WHEN 3 THEN 'damaged' WHEN 4 THEN 'not_pdf' ELSE 'sound' END AS state,
       CASE WHEN s_suppkey % 6 NOT IN (2, 4) THEN '1.4' END AS version, CASE WHEN s_suppkey % 6 IN (0, 3, 5) THEN 2 ELSE 0 END::BIGINT AS objects, CASE WHEN s_suppkey % 6 = 3 THEN 1 ELSE 0 END::BIGINT AS misplaced
FROM supplier
"""

def damaged_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An info table of all documents in three files of other columns each: years that are none, unknown columns, values beyond the header."""
    base = fresh_path(spark, "info")
    docs = read_table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "cast(doc_id AS string) AS id", "concat('Author \"', doc_id % 97, '\"\n& others') AS author", "CASE WHEN doc_id % 5 = 0 THEN concat('ca. ', doc_id % 30) ELSE cast(1990 + doc_id % 30 AS string) END AS year")
    write = lambda rows, name, **options: rows.write.options(header=True, escape='"', **options).csv(f"{base}/{name}")
    write(docs.where("doc_id % 3 = 0").selectExpr("source AS case_name", "id AS study_id", "author", "year"), "plain")
    write(docs.where("doc_id % 3 = 1").selectExpr("year AS ` Year`", "'seen' AS Note", "id AS STUDY_ID", "source AS case_name", "author", "'again' AS ` note`"), "other")
    # Written as one column with another separator, so that a line may have more fields than its header.
    beyond = docs.where("doc_id % 3 = 2").selectExpr("concat(id, ',', source, CASE WHEN doc_id % 2 = 0 THEN ',more' ELSE '' END) AS `study_id,case_name`")
    write(beyond, "beyond", sep=";")
    found = read_damaged_info(spark, f"{base}/*")
    return found.select("case_name", "study_id", "author", "year", F.col("rescued").cast("string").alias("rescued"))


DAMAGED = """
WITH d AS (
  SELECT doc_id, source AS case_name, CAST(doc_id AS VARCHAR) AS study_id, 'Author "' || doc_id % 97 || '"' || chr(10) || '& others' AS author,
         CASE WHEN doc_id % 5 <> 0 THEN CAST(1990 + doc_id % 30 AS INTEGER) END AS year, CASE WHEN doc_id % 5 = 0 THEN '"year":"ca. ' || doc_id % 30 || '"' END AS odd
  FROM documents
)
SELECT case_name, study_id, author, year, '{' || odd || '}' AS rescued FROM d WHERE doc_id % 3 = 0
UNION ALL
SELECT case_name, study_id, author, year, '{"note":"seen","note#6":"again"' || coalesce(',' || odd, '') || '}' FROM d WHERE doc_id % 3 = 1
UNION ALL
SELECT case_name, study_id, NULL, NULL, CASE WHEN doc_id % 2 = 0 THEN '{"column_3":"more"}' END FROM d WHERE doc_id % 3 = 2
"""

QUERIES = {"pdf_structure": pdf_structure, "damaged_info": damaged_info}
ORACLES = {"pdf_structure": STRUCTURE, "damaged_info": DAMAGED}

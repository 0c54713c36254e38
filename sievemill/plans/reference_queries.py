"""References in five styles, derived from every document: what they say is known, so SQL has the fields themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction
from ..sources.tables import read_table

NAMES = ("Smith", "van der Berg", "O''Neill", "Müller", "Li", "Garcia-Lopez", "Østergaard")
TITLES = ("Effects of the U.S. air policy on health", "Is exercise safe? A review of trials", "Air quality in the U.S.", "Long-term exposure to particles and sleep", "Walking to school", "PM2.5 and the E.U. limits: 10 years on")
JOURNALS = ("Lancet", "Am J Epidemiol", "Journal of Health and Place", "BMJ", "Environ Res", "IEEE Trans. Med. Imaging")


def _pick(values: tuple[str, ...], number: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values[:-1]))
    return f"CASE ({number}) % {len(values)} {cases} ELSE '{values[-1]}' END"


FIELDS = {
    "doc_id": "doc_id",
    "k": "k",
    "author": _pick(NAMES, "doc_id + k"),
    "year": "CAST(1990 + (doc_id + 3 * k) % 35 AS INT)",
    "title": _pick(TITLES, "doc_id * 5 + k"),
    "journal": _pick(JOURNALS, "doc_id + 2 * k"),
    "doi": "CASE WHEN (doc_id + k) % 3 <> 0 THEN concat('10.1000/abc.', doc_id, '.', k) END",
}
SELECTED = [f"{e} AS {n}" for n, e in FIELDS.items()]
_stopped = "concat(title, CASE WHEN substring(title, length(title), 1) = '.' THEN '' ELSE '.' END)"
_shown = "coalesce(concat(' doi:', doi, '.'), '')"
#: A line for each reference; each document has one style, but for its last line.
LINE = f"""CASE (doc_id + CASE WHEN k = 4 THEN 1 ELSE 0 END) % 5
  WHEN 0 THEN concat(author, ', J., & Poe, K. (', year, '). ', {_stopped}, ' ', journal, ', 12(3), 45-67.', {_shown})
  WHEN 1 THEN concat(author, ' J, Poe KL. ', {_stopped}, ' ', journal, CASE WHEN substring(journal, length(journal), 1) = '.' THEN ' ' ELSE '. ' END, year, ';12(3):45-9.', {_shown})
  WHEN 2 THEN concat('[', k + 1, '] J. ', author, ' and K. Poe, "', title, '," ', journal, ', vol. 12, no. 3, pp. 45-67, ', year, '.', {_shown})
  WHEN 3 THEN concat(author, ', John, and Kim Poe. "', {_stopped}, '" ', journal, ', vol. 12, no. 3, ', year, ', pp. 45-67.', {_shown})
  ELSE concat(author, ', John, and Kim Poe. ', year, '. ', {_stopped}, ' ', journal, ' 12 (3): 45-67.', {_shown}) END"""
PROSE = "In 1999 we saw that things were better than before (2001). The study was good. It was long and had 2010 rows."


def styled_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).selectExpr(*SELECTED).selectExpr("doc_id", "k", f"{LINE} AS line")
    listed = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    reviews = docs.join(listed, "doc_id").select("doc_id", F.concat("text", F.lit(f"\n{PROSE}\n"), "lines").alias("text"))
    return extraction.included_studies(reviews, "doc_id", "text").select(F.col("id").alias("doc_id"), "author", "year", "title", "journal", "doi")


STYLED = f"""
WITH rows AS (SELECT doc_id, unnest(range(0, 5)) AS k FROM documents), fields AS (SELECT {', '.join(SELECTED)} FROM rows)
SELECT doc_id, author, year, title, journal, doi FROM fields
"""

QUERIES = {"styled_references": styled_references}
ORACLES = {"styled_references": STYLED}

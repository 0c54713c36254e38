"""Included studies from review texts, and bibliographic tags from publishers' pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import LEAST, STYLES, read_line
from ..functions.text import doi
from ..joins import join_keyed
from ..storage import stored
from ..tasks import arrow_map

#: The two projections of an extraction. Which fields each has is an assumption.
FAST = ("author", "year", "doi", "journal")
CORE = ("author", "year", "doi", "title", "journal")
#: What a line must show to be looked at: a year, or a DOI's beginning.
CANDIDATE = r"(?:19|20)[0-9]{2}|10\.[0-9]{4,9}/"
#: The styles' scores count so much in a review's vote at most, and so little at least.
MOST_VOTE, LEAST_VOTE = 10.0, -5.0
#: A line leaves its review's style for one that scores so much more.
CLEARLY = 4.0
READ = "id {kind}, line_no long, doi string, read array<struct<score:double,author:string,year:int,title:string,journal:string>>"


def reference_lines(reviews: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that may be references, with or without a DOI: ``id, line_no, line``."""
    lines = reviews.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(CANDIDATE))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("score", pa.float64()), ("author", pa.string()), ("year", pa.int32()), ("title", pa.string()), ("journal", pa.string())]))
    for batch in batches:
        read = [[r._asdict() for r in read_line(line)] for line in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), batch.column(2), pa.array(read, kind)], ["id", "line_no", "doi", "read"])


def labelled_lines(reviews: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, doi, read`` of candidate lines that show a DOI or that some style reads; read: what each of `STYLES` makes of it."""
    lines = reference_lines(reviews, id_col, text_col).select("id", "line_no", doi(F.col("line")).alias("doi"), "line")
    found = arrow_map(lines, _read, READ.format(kind=lines.schema["id"].dataType.simpleString()))
    return found.where(F.col("doi").isNotNull() | F.exists("read", lambda r: r["score"] >= LEAST))


def _best(read: Column) -> Column:
    """The reading with the largest score, of equal ones that of the first style."""
    return F.reduce(F.slice(read, 2, len(STYLES)), F.get(read, 0), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))


def included_studies(reviews: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each reference line: ``id, line_no, author, year, title, journal, doi``.

    A line is a reference if one of the styles of `citations` reads it, or if it names a DOI. Each review
    votes for a style by what its lines score in each; a line is read in that style, and where that
    makes nothing of it, or another fits clearly better, in the one that fits best. A field that it doesn't show is null; author is the
    first one's surname, or a body. Null texts give no rows; lines with a null id vote for themselves alone.
    """
    lines = stored(labelled_lines(reviews, id_col, text_col), "references")
    clipped = lambda k: F.least(F.greatest(F.col("read")[k]["score"], F.lit(LEAST_VOTE)), F.lit(MOST_VOTE))
    votes = lines.groupBy("id").agg(*[F.sum(clipped(k)).alias(f"s{k}") for k in range(len(STYLES))], F.count(F.lit(1)).alias("lines"))
    most = F.greatest(*[F.col(f"s{k}") for k in range(len(STYLES))])
    style = F.coalesce(*[F.when(F.col(f"s{k}") == most, F.lit(k)) for k in range(len(STYLES))])
    rows = join_keyed(lines, votes.select("id", style.alias("style"), "lines"), "id", "lines", lines.count(), "left")
    voted = F.get("read", F.coalesce("style", F.lit(0)))
    best = _best(F.col("read"))
    close = F.col("style").isNotNull() & (voted["score"] >= LEAST) & (voted["score"] >= best["score"] - CLEARLY)
    own = F.when(close, voted).when(best["score"] >= LEAST, best)
    rows = rows.withColumn("own", own)
    return rows.select("id", "line_no", *[F.col("own")[c].alias(c) for c in ("author", "year", "title", "journal")], "doi")


def project(studies: DataFrame, mode: str) -> DataFrame:
    """The fields of a mode, ``fast`` or ``core``, one row for each different study."""
    return studies.select(*{"fast": FAST, "core": CORE}[mode]).distinct()


#: A tag up to its end, past what is quoted in it; its attributes one after the other, with their values.
TAG = r"(?i)<{}\b[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>"
ATTRIBUTES = r"([A-Za-z][A-Za-z0-9:_.-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, in any order and quoting; null if it isn't there or empty."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTES), F.lit(1)), F.lower)
    value = F.get(F.regexp_extract_all(tag, F.lit(ATTRIBUTES), F.lit(2)), F.array_position(names, name).cast("int") - 1)
    return F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit(""))


def meta_tags(html: Column) -> Column:
    """The named meta tags of a page, in order: an array of ``name`` (lower-cased) and ``content``."""
    tags = F.regexp_extract_all(html, F.lit(TAG.format("meta")), F.lit(0))
    return F.filter(F.transform(tags, lambda t: F.struct(F.lower(attribute(t, "name")).alias("name"), attribute(t, "content").alias("content"))), lambda m: m["name"].isNotNull())


def _named(name: str) -> Column:
    return F.transform(F.filter("tags", lambda m: (m["name"] == name) & m["content"].isNotNull()), lambda m: m["content"])


def _first(*names: str) -> Column:
    return F.coalesce(*[F.get(_named(n), 0) for n in names])


def page_metadata(pages: DataFrame) -> DataFrame:
    """``page_id, host, lang, title, doi, pdf_url`` from a page's address and markup, one row a page; what isn't there is null."""
    return pages.select("page_id", "url", "html", meta_tags(F.col("html")).alias("tags")).select(
        "page_id",
        F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1)), F.lit("")).alias("host"),
        attribute(F.regexp_extract("html", TAG.format("html"), 0), "lang").alias("lang"),
        F.nullif(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), F.lit("")).alias("title"),
        F.lower(_first("citation_doi")).alias("doi"),
        _first("citation_pdf_url").alias("pdf_url"),
    )


def citation_tags(pages: DataFrame) -> DataFrame:
    """``page_id, citation_title, authors, journal, published`` from publishers' meta tags, one row a page.

    Of tags that repeat the first counts, but of authors all, joined by semicolons. What isn't there is
    null; character references stay as they are.
    """
    return pages.select("page_id", meta_tags(F.col("html")).alias("tags")).select(
        "page_id",
        _first("citation_title").alias("citation_title"),
        F.nullif(F.array_join(_named("citation_author"), "; "), F.lit("")).alias("authors"),
        _first("citation_journal_title").alias("journal"),
        _first("citation_publication_date", "citation_date").alias("published"),
    )

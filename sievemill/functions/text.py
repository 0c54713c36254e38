"""Column functions for bibliographic text: DOIs, title keywords, file names, progress keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no title.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")

#: Registrant and suffix of a DOI. A closing full stop, comma, bracket or quote isn't part of it.
DOI = r"(?i)\b(10\.[0-9]{4,9}/[^\s\"'<>]*[^\s\"'<>.,;:()\[\]])"


def doi(text: Column) -> Column:
    """The first DOI in a text, lower-cased; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(text, DOI, 1)), F.lit(""))


#: Signs of scripts that are written without spaces between words: Chinese, Japanese and Korean. Both Java and RE2 read it.
IDEOGRAPHS = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}"
GRAM = 2


def tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased, in order; an empty array for a null text. A run without spaces between its words gives overlapping pairs of signs instead."""
    return F.array_distinct(_words(text, "+"))


def _runs(text: Column, times: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]" + times), F.lit(0))


def _words(text: Column, times: str, stopwords: tuple = ()) -> Column:
    """Runs in order, of texts with ideographs without ``stopwords``; runs of ideographs, which stand alone, as overlapping pairs of signs.

    One pass of a pattern that takes no room: at each place it looks ahead for a pair, a single sign or the beginning of a run. Looking back goes up to two places, as some signs take two.
    """
    sign, other = f"[{IDEOGRAPHS}]", rf"[\p{{L}}\p{{N}}&&[^{IDEOGRAPHS}]]"
    left_out = rf"(?!(?:{'|'.join(stopwords)})(?!{other}))" if stopwords else ""
    mixed = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?=({sign}{{{GRAM}}}|(?<!{sign}{{1,2}}){sign}(?!{sign})|(?<!{other}{{1,2}}){left_out}{other}{times}))"), F.lit(1))
    return F.when(F.coalesce(text, F.lit("")).rlike(f"[{IDEOGRAPHS}]"), mixed).otherwise(_runs(text, times))


def keywords(title: Column, stopwords: tuple = STOPWORDS) -> Column:
    """Distinct title words of three or more letters that aren't stopwords, in order; of ideographs, overlapping pairs of signs."""
    return F.array_except(_words(title, "{3,}"), F.array(*[F.lit(w) for w in stopwords]))


def terms(text: Column, stopwords: tuple = STOPWORDS) -> Column:
    """What `keywords` gives, with repeats: the terms of an index."""
    stops = F.array(*[F.lit(w) for w in stopwords])
    plain = F.filter(_runs(text, "{3,}"), lambda w: ~F.array_contains(stops, w))
    return F.when(F.coalesce(text, F.lit("")).rlike(f"[{IDEOGRAPHS}]"), _words(text, "{3,}", stopwords)).otherwise(plain)


def file_name(author: Column, year: Column, title: Column, words: int = 6) -> Column:
    """Standard name of a study's file: author, year and the first title keywords, safe on any file system."""
    parts = [F.coalesce(F.regexp_replace(F.lower(author), r"[^\p{L}\p{N}]+", ""), F.lit("anon")), F.coalesce(year.cast("string"), F.lit("nd")), F.array_join(F.slice(F.array_except(_runs(title, "{3,}"), F.array(*[F.lit(w) for w in STOPWORDS])), 1, words), "-")]
    return F.concat(F.concat_ws("_", *parts), F.lit(".pdf"))


def progress_key(doi_col: Column, title: Column, author: Column | None = None, year: Column | None = None, study_id: Column | None = None) -> Column:
    """Key under which a study's progress is kept: of its DOI; else of all words of its title, its author and year; else of its id.

    Words of any length and stopwords count, so different titles have different keys. A study that has
    neither DOI nor title nor id has no key.
    """
    words = F.array_join(_runs(title, "+"), " ")
    missing = F.lit(None).cast("string")
    named = F.concat_ws("|", words, F.coalesce(F.lower(author), F.lit("")) if author is not None else F.lit(""), F.coalesce(year.cast("string"), F.lit("")) if year is not None else F.lit(""))
    own = F.concat(F.lit("study|"), study_id) if study_id is not None else missing
    return F.sha2(F.coalesce(F.nullif(F.lower(F.trim(doi_col)), F.lit("")), F.when(words != "", named), own), 256)

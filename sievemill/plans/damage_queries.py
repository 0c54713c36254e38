"""Titles in damaged texts: every document broken into lines, with ligatures and wrong signs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.damaged import damaged_titles
from ..sources.tables import read_table

#: A line end for every seventh space, every fourth "ti" torn at one, fi and fl as ligatures, and a wrong sign here and there.
BROKEN = r"""replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '((?:[^ ]+ ){6}[^ ]+) ', '$1\n'), '(\\w{3,}[a-z]ti)([a-z]{3})', '$1-\n$2'), '(.{150}) e', '$1 c'), 'fi', 'ﬁ'), 'fl', 'ﬂ')"""


def titles_in_damaged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{BROKEN} AS text")
    titles = read_table(spark, sf_dir, "benchmark").selectExpr("item_id", "text AS title")
    return damaged_titles(texts, titles)


#: Edit distance to every place of a text isn't expressed in SQL; the tests hold the query against all pairs.
QUERIES = {"titles_in_damaged_texts": titles_in_damaged_texts}
ORACLES: dict[str, str] = {}

"""Targets of links as browsers resolve them, and all tags of a page."""

import pytest
from pyspark.sql import functions as F

from sievemill.llm.url_filters import Rule, declared_edges, judge_urls, resolved

BASE = "https://a.org/x/y/page.html?q=1#top"


@pytest.mark.parametrize(
    "target, want",
    [
        ("q.html", "https://a.org/x/y/q.html"), ("./q?a=1&amp;b=2", "https://a.org/x/y/q?a=1&b=2"), ("../q", "https://a.org/x/q"), ("../../../q/./r", "https://a.org/q/r"),
        ("?p=2", "https://a.org/x/y/page.html?p=2"), ("/z/../w", "https://a.org/w"), ("//b.com/c", "https://b.com/c"), ("HTTP://b.com", "HTTP://b.com"),
        ("#part", None), ("mailto:a@b.c", None), ("", None), (" /t ", "https://a.org/t"), (None, None),
    ],
)
def test_resolved(spark, target, want):
    row = spark.createDataFrame([(BASE, target), ("no address", target)], "base string, target string").select(resolved(F.col("base"), F.col("target")).alias("r")).collect()
    assert row[0].r == want and row[1].r in (None, target)
    if target is not None:
        bare = spark.createDataFrame([("https://a.org", "q")], "base string, target string").select(resolved(F.col("base"), F.col("target")).alias("r")).first().r
        assert bare == "https://a.org/q"


def test_every_tag_counts(spark):
    html = """<link rel=icon href=/i><link href='one?a=1&amp;b=2' rel='nofollow CANONICAL'><p><link rel=canonical href=/two><META content='5;URL="three"' HTTP-EQUIV='Refresh'><link rel=notcanonical href=/no>"""
    pages = spark.createDataFrame([(1, "http://a.org/d/x", html), (2, "http://a.org/none", None), (3, None, html)], "page_id long, url string, html string")
    assert {tuple(r) for r in declared_edges(pages).collect()} == {("a.org/d/x", "a.org/" + t) for t in ("d/one?a=1&b=2", "two", "d/three")}


def test_a_block_passes_on_along_relative_links(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.com/bad/x", None), (2, "http://a.com/other/y", "<link href='../bad/x' rel=canonical>"), (3, "http://a.com/third", "<meta http-equiv=refresh content='0; url=other/y'>"), (4, "http://a.com/free", "")],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r.verdict for r in judge_urls(pages, [Rule("a.com", "/bad/", "block")]).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}

"""Verdicts do not change where names, hosts and components hold most pages and meet theirs by broadcast."""

from sievemill import joins
from sievemill.llm import url_filters
from sievemill.llm.queries import URL_RULES, _linked_pages
from sievemill.llm.url_filters import judge_urls


def test_hot_names(spark, sf_dir, monkeypatch):
    pages, redirects = _linked_pages(spark, sf_dir)
    copies = pages.where("page_id = 1").crossJoin(spark.range(300)).selectExpr("page_id + 1000 * id AS page_id", "concat(url, '?utm_source=', id) AS url", "html")
    every = pages.unionByName(copies).unionByName(spark.createDataFrame([(None, None, None), (-1, "no scheme", "")], pages.schema))
    want = sorted(map(tuple, judge_urls(every, URL_RULES, redirects).collect()), key=str)
    monkeypatch.setattr(joins, "FEW_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 40)
    assert sorted(map(tuple, judge_urls(every, URL_RULES, redirects).collect()), key=str) == want
    monkeypatch.setattr(url_filters, "INLINE_RULES", 0)
    assert sorted(map(tuple, judge_urls(every, URL_RULES, redirects).collect()), key=str) == want
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, judge_urls(every, URL_RULES, redirects).collect()), key=str) == want

"""URL rules and the hand-over of decisions to aliases."""

import re

from sievemill.llm import url_filters
from sievemill.llm.url_filters import Rule, judge_urls

RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"), Rule("bad.net", "/x", "block"), Rule("good.net", "/", "allow")]
LINK = '<html><link rel="canonical" href="{}"></html>'
REFRESH = "<meta http-equiv=refresh content='0; url={}'>"


def by_hand(url):
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), r.verdict == "allow"), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_rules(spark, monkeypatch):
    urls = ["http://A.Example.ORG/es/1", "https://example.org", "https://example.org/", "x://org/?q#f", "http://xorg/de/", "http://www.a.com/de/1#://b.org/", "http://com/fr/x?y=/de/", "", None, "nothing", "://", "a://b://c.org/d", "http://É.ORG/x\ny"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(None, "http://q.org/a", ""), (3, urls[3], None)], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS node")
    for most in (64, 0):  # in the plan, and joined
        monkeypatch.setattr(url_filters, "INLINE_RULES", most)
        got = judge_urls(pages, RULES).collect()
        assert len(got) == len(urls) + 2
        for r in got:
            if r.page_id is not None:
                host, path, rule, verdict = by_hand(urls[r.page_id])
                assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert judge_urls(pages.limit(0), RULES).collect() == []
    assert {r.verdict for r in judge_urls(pages, []).collect()} == {"allow"}


def test_aliases(spark):
    rows = [
        (1, "http://bad.net/x/1", LINK.format("https://m.fine.io/a")),  # blocked, and hands it on
        (2, "https://m.fine.io/a/", None),
        (3, "https://m.fine.io/a?utm_source=z#top", REFRESH.format("http://far.io/b")),
        (4, "http://far.io/b?ref=1", None),
        (5, "http://far.io/b?page=2", None),  # another page
        (6, "http://bad.net/x/2", LINK.format("http://both.io/c")),
        (7, "http://good.net/c", REFRESH.format("http://both.io/c")),
        (8, "http://both.io/c", None),  # allowed: a block doesn't pass an explicit allow
        (9, "http://redirected.io/", None),
        (10, "http://rel.io/q", LINK.format("/p")),
        (11, "http://rel.io/p", LINK.format("//bad.net/x/1")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://redirected.io", "http://far.io/b"), (None, "http://far.io/b")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in judge_urls(pages, RULES, redirects).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 4, 6, 9, 10, 11}


def test_hot_alias(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://hot.io/p?utm_source=', id) AS url", "if(id = 7, '<link href=http://bad.net/x rel=canonical>', '') AS html")
    both = pages.unionByName(spark.createDataFrame([(-1, "http://bad.net/x", "")], "page_id long, url string, html string"))
    assert both.count() == judge_urls(both, RULES).where("verdict = 'block'").count()

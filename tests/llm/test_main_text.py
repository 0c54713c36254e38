"""Markup told apart; the host suffix array against all pairs of suffixes; pages with and without an article."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.llm import host_suffixes
from sievemill.llm.host_suffixes import CUT, DEPTH, LONG, MARK, agreements, starts, stream
from sievemill.llm.main_text import main_texts
from sievemill.llm.markup import ARTICLE, BESIDE, MAIN, PLAIN, blocks_of


def texts(html, kind=ARTICLE):
    return [b.text for b in blocks_of(html) if b.kind == kind]


def test_blocks():
    assert blocks_of(None) == blocks_of("") == blocks_of("<!-- a") == blocks_of("<script>a < b; '</p>'") == []
    assert texts("a&nbsp;b<br>c<b>d</b>e < 5 &amp;lt; &copy &#x41;", PLAIN) == ["a b cde < 5 &lt; © A"]
    assert texts("<style>x</style><p>a\n\t b<p>c<div>d</div>e<table><tr><td>f<td>g</table>", PLAIN) == ["a b", "c", "d", "e", "f", "g"]
    assert texts("<p title='a > b' data-x=\"</p>\">in</p>", PLAIN) == ["in"]


def test_article():
    page = (
        "<html><head><title>T</title></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><ul><li>Menu<li>More</ul></nav><div id=wrap-with-ads>"
        "<article class=post><header class=entry-header><h1 class=header>Head</h1></header><p>One <a href=x>two</a> <span class='ad'>buy</span>three<p class=advert>Offer<p>Four"
        "<aside>Box</aside><form><label>Mail</label><input><button>Go</button></form><figure><img><figcaption>Caption</figcaption></figure><div class='cookie-notice'>We use</div>"
        "<section id=comments><article><p>First!</p></article></section><article class=comment>Me too</article><footer>Tags</footer></article></div>"
        "<div class=sidebar>Side</div><article class=teaser>Next</article><footer>&copy; us</footer><div hidden>no</div><noscript>js</noscript></body>"
    )
    assert texts(page) == ["Head", "One two three", "Four", "Caption"]
    assert {"Menu", "More", "Offer", "Box", "Mail", "We use", "First!", "Me too", "Tags", "Side", "Next", "© us", "Site"} == set(texts(page, BESIDE))
    assert texts("<form id=f><div class=banner><article>in</article></div></form>") == ["in"]
    assert texts("<main><h1>a</h1><nav>b</nav><p>c</main><p>d", MAIN) == ["a", "c"]


@pytest.mark.parametrize("html", ["<a" * 200_000, '<a "' * 100_000, "<p>" * 200_000, "</div>" * 200_000, "<div><b>" * 100_000 + "x</b>", "<" * 300_000, "&" * 300_000, "<div class='a'>" * 50_000 + "</section>" * 50_000, "<script>" * 50_000])
def test_hostile_pages_in_linear_time(html):
    began = time.time()
    blocks_of(html)
    assert time.time() - began < 20


def test_starts_choose_alike():
    rng = np.random.default_rng(3)
    shared = rng.integers(2, 2**32, 60, np.uint32)
    a, b = (np.concatenate([rng.integers(2, 2**32, n, np.uint32), shared, rng.integers(2, 2**32, 40, np.uint32)]) for n in (31, 77))
    inner = lambda x, at: {p - at for p in starts(x).tolist() if at + host_suffixes.GAP <= p <= at + 60 - LONG - host_suffixes.GAP}
    assert inner(a, 31) == inner(b, 77) and len(inner(a, 31)) >= 3
    marks = stream(["one two three", "four five six seven", None, "x y"])
    assert marks[0] == MARK and (marks == CUT).sum() == 1 and marks[-1] == MARK
    assert {0, 4} <= set(starts(marks).tolist()) and starts(marks[:3]).tolist() == []


@pytest.mark.parametrize("rows", [250_000, 40])
def test_against_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(host_suffixes, "RANGE_ROWS", rows)
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(2, 20))) for _ in range(25)]
    pages = []
    for k in range(60):
        blocks = [rng.choice(lines) for _ in range(rng.randrange(1, 6))] + [" ".join(f"u{k}x{j}" for j in range(rng.randrange(12)))]
        if k % 5 == 0:
            blocks.insert(1, None)
        low = rng.randrange(1000)
        pages.append((k % 3, k, stream(blocks), low, low + (k % 7 == 0)))
    table = spark.createDataFrame([(h, s, bytearray(t.tobytes()), a, b) for h, s, t, a, b in pages], "host long, stream long, tokens binary, low long, high long")
    got = {}
    for r in agreements(table).collect():
        got[r.stream, r.place] = max(r.agrees, got.get((r.stream, r.place), 0))
    suffixes = []
    for h, s, t, a, b in pages:
        for p in starts(t).tolist():
            own = t[p : p + DEPTH].tolist()
            suffixes.append((h, s, p, own[: own.index(CUT)] if CUT in own else own, a, b))
    want = {}
    for h, s, p, own, a, b in suffixes:
        best = len(own) if a != b else 0
        for h2, s2, _, other, a2, b2 in suffixes:
            if h == h2 and min(a, a2) != max(b, b2):
                n = next((i for i, (x, y) in enumerate(zip(own, other)) if x != y), min(len(own), len(other)))
                best = max(best, n)
        if best >= LONG:
            want[s, p] = best
    assert got == want and want


NOTE = "We use small files to make this site better for you and to count our visitors"
MENU = ["Home", "About us", "Our shop", "Contact", "Help"]


def plain_page(k, words):
    body = " ".join(f"{words}{k}n{j}" for j in range(60))
    return f"<body><div>{'</div><div>'.join(MENU)}</div><p>{body}</p><p>{body[:40]} {NOTE} at{k} the end</p><div>{NOTE}</div><div>Imprint and terms of this shop</div></body>"


def test_pages_without_an_article(spark):
    near = "<p>" + " ".join(f"c{j}" for j in range(80)) + "</p><div>" + "</div><div>".join(MENU) + "</div>"
    rows = [(k, f"http://A.example/{k}", plain_page(k, "a")) for k in range(12)] + [(100, "http://b.example/", plain_page(0, "a")), (101, None, plain_page(1, "z")), (102, "no address", None), (102, "no address", "")]
    rows += [(200 + k, f"https://a.example/copy{k}", near.replace("c5 ", f"d{k} ")) for k in range(3)] + [(300, "http://a.example/5?x", plain_page(5, "a")), (None, "http://a.example/m", f"<main><p>Mine alone here</p><div>{NOTE}</div></main><p>{plain_page(99, 'q')}")]
    rows += [(400, "http://long.example/", "<p>" + "one two three four five six seven " * 60_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumn("text", F.lit("clash")).withColumn("stream_id", F.lit(1))
    got = {}
    for r in main_texts(pages).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text) and 0 <= r.n_repeated <= r.n_outside
    assert sum(map(len, got.values())) == len(rows)
    for k in [*range(12), 300]:
        body = " ".join(f"a{k % 295}n{j}" for j in range(60))
        # The note goes as a block, and inside one but for its first words at most.
        before, after = f"{body} {body[:40].strip()}", f"at{k % 295} the end"
        text = got[k][0].text
        assert text.startswith(before) and text.endswith(after) and len(text[len(before) : -len(after)].split()) < host_suffixes.GAP
    assert NOTE in got[100][0].text and "Home" in got[100][0].text  # alone on its host
    assert [r.text for r in got[102]] == ["", ""] and got[None][0].text == "Mine alone here"
    assert all("c79" in got[200 + k][0].text and f"d{k} " in got[200 + k][0].text and "Home" not in got[200 + k][0].text for k in range(3))
    assert got[400][0].text.count("seven") == 60_000


def test_articles_are_whole(spark):
    line = "the very same line stands in all of these articles and is quoted whole"
    rows = [(k, "http://h.example/x", f"<nav>{' '.join(MENU)} and more of it</nav><article><p>{line}</p><p>own {k}</p></article><div>{NOTE}</div>") for k in range(30)]
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"{line} own {k}" for k in range(30)} and all(r.n_repeated >= r.n_outside - 3 for r in got)
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_given_pages(spark, sf_dir):
    """Against the markup of the given pages, which is regular."""
    import html
    import re

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r.text for r in main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?(?:p|h1)>|<br>", inner)).split())


@pytest.mark.parametrize("few", [8_000_000, 0])
def test_articles_go_through_the_array(spark, monkeypatch, few):
    """Repeats inside articles are found by the array, by broadcast beginnings or a join, and given back."""
    monkeypatch.setattr(host_suffixes, "BROADCAST_GRAMS", few)
    quote = "this very passage is quoted by two articles of the host and by nobody else at all"
    page = lambda k, also: f"<nav>{' '.join(MENU)} and more of it</nav><article><p>{' '.join(f'own{k}x{j}' for j in range(20))}</p>{also}</article>"
    rows = [(k, "http://h.example/x", page(k, f"<p>{quote}</p>" if k < 2 else "")) for k in range(4)] + [(9, "http://other.example/", page(9, f"<p>{quote}</p>"))]
    got = {r.page_id: r for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k].n_quoted >= len(quote.split()) for k in (0, 1, 2, 3, 9)] == [True, True, False, False, False]
    assert all(got[k].text.endswith(quote) for k in (0, 1, 9)) and all(got[k].n_repeated > 0 for k in range(4)) and got[9].n_repeated == got[9].n_quoted == 0


def test_the_array_decides_around_an_article(spark):
    """In the main element what the host's pages share goes and what is a page's own stays; beside it own text goes too, and quotes in articles stay."""
    lead = lambda k: f"lead{k} of a story that only this page {k} of the host tells"
    page = lambda k: f"<nav>{' '.join(MENU)}</nav><main><h1>Heading{k} alone</h1><p>{lead(k)}</p><div>{NOTE}</div><article><p>{NOTE}</p><p>own{k} text</p></article><div>{NOTE}</div><aside>beside{k}</aside></main><div>outside{k} of it</div>"
    rows = [(k, "http://h.example/x", page(k)) for k in range(8)] + [(9, "http://one.example/", page(9))]
    got = {r.page_id: r for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].text == f"Heading{k} alone {lead(k)} {NOTE} own{k} text" and got[k].n_quoted >= len(NOTE.split()) for k in range(8))
    # Alone on its host nothing repeats on another page.
    assert got[9].text == f"Heading9 alone {lead(9)} {NOTE} {NOTE} own9 text {NOTE}"


def test_own_blocks_of_near_copies_stay(spark):
    """A near copy loses what all of its copies have in short blocks, and no short block of its own."""
    near = "<p>" + " ".join(f"c{j}" for j in range(200)) + "</p><p>note of mine @</p><div>" + "</div><div>".join(MENU) + "</div>"
    rows = [(k, f"https://a.example/copy{k}", near.replace("c5 ", f"d{k} ").replace("@", f"k{k}")) for k in range(3)]
    for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert f"d{r.page_id} " in r.text and "c199" in r.text and f"note of mine k{r.page_id}" in r.text and "Our shop" not in r.text

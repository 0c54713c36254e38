"""A web page as blocks of visible text, with what its markup says of each."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

#: What markup says of a block: of the article, of nothing in particular, inside the main element, or beside the text.
ARTICLE, PLAIN, MAIN, BESIDE = "article", "plain", "main", "beside"

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style noscript template iframe object svg math audio video canvas map datalist select textarea title xmp noembed noframes button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
BESIDES = frozenset("nav header footer aside menu dialog form fieldset legend".split())
BESIDE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class and id that name what stands beside the text.
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar"
    " notice cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription share sharing social related recommended teaser comment comments disqus respond reply replies"
    " pagination pager widget toolbar skip login signup".split()
)
#: These make even an article one that isn't the page's own, and none inside them is.
OTHERS = frozenset("ad ads advert comment comments disqus respond reply replies teaser related recommended promo sponsored".split())
#: What follows these in a class, as in "has-sidebar", tells of the layout.
LAYOUT = frozenset("has with without no not is".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    kind: str
    text: str


class _Open(NamedTuple):
    tag: str
    kind: str
    unseen: bool
    #: Inside this an article is somebody else's.
    others: bool


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] or ""
        found.setdefault(m[1].lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def marked(attributes: dict[str, str]) -> set[str]:
    """Words of class and id that name something beside the text."""
    found: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        for word in _WORDS.findall(name):
            word = word.lower()
            if word in LAYOUT:
                break
            if word in BESIDE_WORDS:
                found.add(word)
    return found


class _Parser:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack = [_Open("", PLAIN, False, False)]
        self.counts: Counter[str] = Counter()
        self.pieces: list[str] = []

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1].unseen:
            self.pieces.append(unescape(raw) if "&" in raw else raw)

    def flush(self) -> None:
        if self.pieces:
            joined = " ".join("".join(self.pieces).split())
            if joined:
                self.blocks.append(Block(self.stack[-1].kind, joined))
            self.pieces.clear()

    def push(self, entry: _Open) -> None:
        self.stack.append(entry)
        self.counts[entry.tag] += 1

    def pop(self) -> None:
        self.counts[self.stack.pop().tag] -= 1

    def start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        attributes = _attributes(raw) if raw and not raw.isspace() else {}
        inline = tag in INLINE
        if inline and not attributes:
            return
        if not inline:
            self.flush()
            if self.stack[-1].tag == "p" or (tag == "li" and self.stack[-1].tag == "li"):
                self.pop()
        if tag in VOID:
            return
        if not attributes and tag in ("p", "li") and not self.counts[tag]:
            return  # changes nothing, and its end finds nothing to close
        top = self.stack[-1]
        words = marked(attributes) if attributes and tag not in ("html", "body", "main") else set()
        role = attributes.get("role", "").strip().lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or ("style" in attributes and _HIDDEN.search(attributes["style"]) is not None)
        unseen = top.unseen or tag in UNSEEN or (hidden and tag not in ("html", "body", "article", "main"))
        others = top.others or bool(words & OTHERS) or tag in ("aside", "nav", "footer")
        if inline:
            # Advertising and the like inside a line goes, and splits no block.
            if unseen != top.unseen or words:
                self.push(_Open(tag, top.kind, True, top.others))
            return
        kind = top.kind
        article = tag == "article" or role == "article" or "articlebody" in attributes.get("itemprop", "").lower().split()
        if article and tag == "article" and top.kind == ARTICLE:
            kind, others = BESIDE, True  # an article in an article: comments on it
        elif article and not others:
            kind = ARTICLE
        elif (tag == "main" or role == "main") and not others:
            kind = MAIN
        elif tag in BESIDES or role in BESIDE_ROLES or words:
            heading = tag == "header" or not words - {"header", "banner"}
            # The header of an article is its heading.
            named = role in BESIDE_ROLES or (tag in BESIDES and tag != "header") or bool(words - {"header", "banner"})
            if not (top.kind == ARTICLE and heading and not named) and not (re.fullmatch(r"h[1-6]", tag) and not words - {"header", "banner"}):
                kind = BESIDE
        self.push(_Open(tag, kind, unseen, others))

    def end(self, tag: str) -> None:
        if tag in INLINE:
            if self.stack[-1].tag == tag:
                self.pop()
            return
        self.flush()
        if self.counts[tag] > 0:
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()

    def run(self, html: str) -> list[Block]:
        at, last = 0, html.rfind(">")
        while True:
            open_at = html.find("<", at)
            if open_at < 0:
                self.text(html[at:])
                break
            self.text(html[at:open_at])
            if html.startswith("<!--", open_at):
                end = html.find("-->", open_at + 4)
                if end < 0:
                    break
                at = end + 3
                continue
            following = html[open_at + 1 : open_at + 3]
            if not (following[:1].isalpha() and following[:1].isascii() or following[:1] in ("!", "?") or (following[:1] == "/" and following[1:2].isalpha())):
                self.text("<")
                at = open_at + 1
                continue
            if open_at > last:  # a tag that never ends
                break
            m = _TAG.match(html, open_at)
            if m is None:
                at = html.find(">", open_at) + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = close.start() if close else len(html)
        self.flush()
        return self.blocks


def blocks_of(html: str | None) -> list[Block]:
    """Blocks of visible text in page order: character references decoded, white space inside a block one space, none at its ends.

    Scripts, styles, comments and hidden elements give none. Unclosed and unmatched tags are taken as
    browsers take them, and a text of any length in time that grows with it.
    """
    return _Parser().run(html) if html else []

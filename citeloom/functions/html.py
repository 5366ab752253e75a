"""HTML to text and markdown, and publication dates (HTML-1 to HTML-5), on the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED = frozenset("script style noscript template svg iframe code pre form button select".split())
PRUNED = frozenset("header nav footer aside".split())
BLOCKS = frozenset("p div section article main ul ol li table tr td th h1 h2 h3 h4 h5 h6 blockquote br hr figure figcaption dl dt dd".split())
VOID = frozenset("br hr img meta link input area base col embed source track wbr".split())
DEPTH = 40


class _Reader(HTMLParser):
    def __init__(self, markdown: bool, prune: bool):
        super().__init__(convert_charrefs=True)
        self.markdown, self.prune = markdown, prune
        self.stack: list[str] = []
        self.out: list[str] = []
        self.main: list[str] | None = None
        self.hidden = 0
        self.href: list[str | None] = []

    def emit(self, s: str) -> None:
        if not self.hidden and len(self.stack) <= DEPTH:
            self.out.append(s)
            if self.main is not None and "main" in self.stack:
                self.main.append(s)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag in BLOCKS:
                self.emit("\n")
            return
        self.stack.append(tag)
        if tag == "main" and self.main is None:
            self.main = []
        if tag in SKIPPED or self.prune and tag in PRUNED:
            self.hidden += 1
        if tag in BLOCKS:
            self.emit("\n")
        if self.markdown:
            if re.fullmatch(r"h[1-6]", tag):
                self.emit("#" * int(tag[1]) + " ")
            elif tag == "li":
                self.emit("+ ")
            elif tag in ("b", "strong"):
                self.emit("**")
            elif tag == "a":
                self.href.append(dict(attrs).get("href"))
                self.emit("[")

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag not in self.stack:
            return
        if self.markdown and tag == "a" and self.href:
            self.emit(f"]({self.href.pop() or ''})")
        elif self.markdown and tag in ("b", "strong"):
            self.emit("**")
        if tag in BLOCKS:
            self.emit("\n")
        while self.stack:
            top = self.stack.pop()
            if top in SKIPPED or self.prune and top in PRUNED:
                self.hidden -= 1
            if top == tag:
                break

    def handle_data(self, data: str) -> None:
        self.emit(re.sub(r"\s+", " ", data))

    def text(self) -> str:
        s = "".join(self.main if self.main else self.out)
        s = re.sub(r"[ \t]*\n[ \t]*", "\n", s)
        return re.sub(r"\n{3,}", "\n\n", s).strip()


def read(html: str | None, markdown: bool = False, prune: bool = True) -> str | None:
    if html is None:
        return None
    reader = _Reader(markdown, prune)
    reader.feed(html)
    reader.close()
    return reader.text()


def clean_markdown(text: str | None, least_words: int = 0) -> str | None:
    """HTML-4: blank lines before headings and lists, at most one between paragraphs, short paragraphs gone."""
    if text is None:
        return None
    s = re.sub(r"(?<!\n)\n(#{1,6} )", r"\n\n\1", text)
    s = re.sub(r"(?<=[^\n])\n(?=\+ )(?<!\+ )", "\n", s)
    parts = re.split(r"\n{2,}", s)
    return "\n\n".join(p for p in parts if len(p.split()) >= least_words).strip()


_META = re.compile(r"<meta[^>]+(?:property|name|itemprop)=[\"'](?:article:published_time|datePublished|date|pubdate|dc\.date|publishdate)[\"'][^>]*content=[\"']([^\"']+)", re.I)
_META2 = re.compile(r"<meta[^>]+content=[\"']([^\"']+)[\"'][^>]*(?:property|name|itemprop)=[\"'](?:article:published_time|datePublished|date|pubdate|dc\.date|publishdate)[\"']", re.I)
_TIME = re.compile(r"<time[^>]+datetime=[\"']([^\"']+)", re.I)
_ISO = re.compile(r"(?<!\d)((?:19|20)\d{2})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?!\d)")


def published(html: str | None) -> str | None:
    """HTML-5: of meta data, then of <time>, then the first ISO date; null if none is a date."""
    for pattern in (_META, _META2, _TIME):
        for m in pattern.finditer(html or ""):
            if found := _ISO.search(m[1]):
                return found[0]
    found = _ISO.search(html or "")
    return found[0] if found else None


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    """HTML-1, HTML-2"""
    return html.map(read)


@F.pandas_udf(T.StringType())
def to_markdown(html: pd.Series) -> pd.Series:
    """HTML-3, HTML-4"""
    return html.map(lambda h: clean_markdown(read(h, markdown=True)))


@F.pandas_udf(T.StringType())
def publication_date(html: pd.Series) -> pd.Series:
    return html.map(published)

"""Wikitext to cited facts (WIKI-1 to WIKI-7, STR-4 to STR-6, WIN-1, WIN-2, JOIN-5): one small scanner, run page by page in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .parallel import spread

_REF = re.compile(r"<ref\b([^>]*?)/>|<ref\b([^>]*?)>(.*?)</ref\s*>", re.S | re.I)
_URL = re.compile(r"https?://[\w\-.]+(?:\.[a-z]{2,})+(?:/[\w\-.~:/?#\[\]@!$&'()*+,;=%]*)?")
_NAME = re.compile(r"name\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s/>]+)")
_HEADING = re.compile(r"^(={2,6})\s*(.*?)\s*\1\s*$", re.M)
_LINK = re.compile(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]")
_TAG = re.compile(r"\[REF-(\d+)\]")
_SENTENCE = re.compile(r"(?<=[.!?])((?:\[REF-\d+\])*)\s+(?=[^\s])")
_MARKUP = re.compile(r"'{2,}|<[^>]+>|\[https?://\S+\s*([^\]]*)\]")
NEAR = 5


def drop_nested(text: str, opening: str, closing: str, keep: Callable[[str], bool] | None = None) -> str:
    """Text without the balanced spans between opening and closing, but for those that keep() wants; an unclosed one is kept."""
    out, stack, i = [[]], [], 0
    while i < len(text):
        if text.startswith(opening, i):
            stack.append(i)
            out.append([])
            i += len(opening)
        elif stack and text.startswith(closing, i):
            stack.pop()
            inner = "".join(out.pop())
            if keep and keep(inner):
                out[-1].append(opening + inner + closing)
            i += len(closing)
        else:
            out[-1].append(text[i])
            i += 1
    while stack:
        stack.pop()
        inner = "".join(out.pop())
        out[-1].append(opening + inner)
    return "".join(out[0])


def url_of(ref: str) -> str | None:
    """STR-7"""
    found = _URL.findall(ref)
    if not found:
        return None
    return next((u for u in found if "web.archive.org" in u), found[0]) if len(found) > 1 else found[0]


def strip_markup(text: str) -> str:
    plain = _MARKUP.sub(lambda m: m[1] or "", text)
    return re.sub(r"[^\S\n]+", " ", unicodedata.normalize("NFKD", plain).encode("ascii", "ignore").decode()).strip()


def good_sentence(text: str) -> bool:
    """FLT-12, offline: starts like a sentence, ends like one, and has at least four words."""
    return bool(re.match(r"[\"'(]?[A-Z0-9]", text)) and bool(re.search(r"[.!?][\"')]?$", text)) and len(text.split()) >= 4


def sections(text: str) -> str:
    """WIKI-4, WIKI-6: headings as 'SECTION: path' lines of their own, the section of references gone."""
    out, path, at, dropping = [], [], 0, 0
    for m in _HEADING.finditer(text):
        if not dropping:
            out.append(text[at : m.start()])
        level = len(m[1])
        path = [*path[: level - 2], m[2]]
        if not dropping or level <= dropping:
            dropping = level if m[2].strip().lower() == "references" else 0
        if not dropping:
            out.append("\nSECTION: " + " > ".join(path) + "\n")
        at = m.end()
    if not dropping:
        out.append(text[at:])
    return "".join(out)


def tag_groups(sentence: str) -> list[list[int]]:
    """WIN-2: the tags of a sentence grouped by gaps of under NEAR characters."""
    groups: list[list[int]] = []
    end = None
    for m in _TAG.finditer(sentence):
        if end is None or m.start() - end >= NEAR:
            groups.append([])
        groups[-1].append(int(m[1]))
        end = m.end()
    return groups


def page_facts(source: str | None, denied: tuple[str, ...] = (), sentence_ok: Callable[[str], bool] = good_sentence, compat: bool = False) -> list[tuple]:
    """(fact, marked, extracted, [urls], [pos]) of the sentences with a usable citation; fact counts all sentences of the page.

    pos is the index of the tag group. compat numbers the groups anew after groups without usable URLs are gone, as the data of old does.
    Tags that begin the first sentence have no sentence before them and are dropped (compat: they go to the last one).
    """
    if not source:
        return []
    text = source.replace("et al.", "et al")
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    refs: list[str] = []
    names: dict[str, str] = {}

    def tag(m: re.Match) -> str:
        attributes, body = (m[1], "") if m[1] is not None else (m[2], m[3])
        name, url = _NAME.search(attributes or ""), url_of(body or "")
        if name and url:
            names[name[1].strip("\"'")] = url
        refs.append(url or (name[1].strip("\"'") if name else ""))
        return f"[REF-{len(refs) - 1}]"

    text = _REF.sub(tag, text)
    text = drop_nested(text, "{|", "|}")
    text = drop_nested(text, "{{", "}}", lambda inner: "cite" in inner.split("|", 1)[0].lower())
    text = sections(text)
    text = _LINK.sub(lambda m: m[2] if m[2] is not None else m[1], text)
    found = []
    for line in text.split("\n"):
        if line.strip():
            line = _SENTENCE.sub(lambda m: m[1] + "\n", line)
            found += [s for x in line.split("\n") if (s := strip_markup(x))]
    for i in range(len(found)):
        m = re.match(r"(?:.{0,4}?\[REF-\d+\])+", found[i])
        if m and (i or compat) and len(found) > 1:
            moved = "".join(f"[REF-{n}]" for n in _TAG.findall(m[0]))
            prior = found[i - 1]
            found[i - 1] = prior[:-1] + moved + prior[-1:]
            found[i] = found[i][m.end() :].strip()
    out = []
    for i, s in enumerate(x for x in found if x):
        groups = tag_groups(s)
        if not groups:
            continue
        urls, pos = [], []
        for g, group in enumerate(groups):
            for n in group:
                url = refs[n] if refs[n].startswith("http") else names.get(refs[n])
                if url and not any(d in url for d in denied) and not (url.endswith(".pdf") or "/pdf/" in url or "/pdfs/" in url):
                    urls.append(url)
                    pos.append(g)
        if not urls:
            continue
        if compat:
            order = {g: k for k, g in enumerate(dict.fromkeys(pos))}
            pos = [order[g] for g in pos]
        last = [m.end() for m in _TAG.finditer(s)][-1]
        marked = re.sub(r"\[REF-\d+\](?:.{0,4}?\[REF-\d+\])*", " [KP] ", s[:last])
        extracted = re.sub(r"\s+", " ", _TAG.sub("", s)).strip()
        marked = re.sub(r"\s+", " ", marked).strip() if sentence_ok(extracted) else ""
        out.append((i, marked, extracted, urls, pos))
    return out


SCHEMA = "title string, fact int, marked string, extracted string, citation_urls array<string>, pos array<int>"


def facts(pages: DataFrame, denied: tuple[str, ...] = (), compat: bool = False, title: str = "title", source: str = "source_text") -> DataFrame:
    """SCHEMA of every page; pages without text, or with a null title, give no facts. A page is the unit of work, so rows only stream through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, *f) for t, s in zip(b["title"], b["source"]) for f in page_facts(s, denied, compat=compat)]
            yield pd.DataFrame(rows, columns=["title", "fact", "marked", "extracted", "citation_urls", "pos"])

    rows = pages.selectExpr(f"`{title}` AS title", f"`{source}` AS source").filter("title IS NOT NULL AND source IS NOT NULL")
    return spread(rows).mapInPandas(run, SCHEMA)

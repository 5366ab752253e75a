"""Problems 3 and 4: residue, and the main body of pages, from ratios of text and punctuation along paths and from slots induced by alignment.

A page is a sequence of lines, and a line stands at the end of a path from the root of its page: tags (where the page still has them) / zone and kind
of line / template. A template is the line with its slots masked: the name of the site, digits, hexadecimal numbers, case, spacing and bullets.
Lines of a menu and sentences of a notice are leaves of their own below the line.

Over all pages the length and the punctuation of the text on each path are summed. The ratio of a leaf is the text it says once to the text it fills on all
pages, smoothed by that of its parent and fused with its punctuation: what is said over and over falls below the threshold. The ratio of the path
below a heading is the number of bare lines it leads to at each place: headings of link lists lead to many. Tags have the classic ratio,
text per node, fused with punctuation and the number of nodes a page has.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from xxhash import xxh64_intdigest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import spread
from .common import cut, h64, mix, read, signed, site
from .neardup import components, permutations

#: A leaf whose fused ratio is under THRESHOLD belongs to a template. Its parent's ratio counts as much as that of SMOOTH places;
#: sentences, which copies of an article share, need up to 1 + MARKED times as much repetition as a bare line.
THRESHOLD, SMOOTH, MARKED = 0.2, 1.0, 0.9
#: Bare lines that a heading leads to at each place, from which on it heads a list of links; and the most of them that may end like sentences.
CHILDREN, ENDINGS = 1.5, 0.34
#: Tags: a path is main body from this fused ratio on; the path above counts as much as TAG_SMOOTH nodes.
TAG_THRESHOLD, TAG_SMOOTH = 30.0, 3.0
#: A line is program output if it has a phrase of such for every so many characters.
PER_SIGN = 400
#: Sentences of prose a page needs to be a copy of another (error pages are alike, too, and have fewer), and the share of all of theirs that two copies have in common.
LEAST_BODY, COPIES = 5, 0.3
#: Least hashes kept of the sentences of a page; bands of ROWS of them under permutations name the pages to compare.
BODY, ROWS, BANDS = 64, 2, 16
#: Sentences (those of the least hashes) that stand for a line in its page's body, so that a long notice doesn't make pages alike.
PER_LINE = 4
#: Template paths up to this number are broadcast (9 bytes each), beyond it they are joined to their pages.
BROADCAST = 2_000_000
#: Alignment: a value is a variable's name if it fills at least so many different templates; a template has a slot if so many such names fill it.
FILLS, NAMES = 3, 2
#: A span or a line is a template's default if so many pages have it and at least this share of them has unfilled slots.
DEFAULT_PAGES, DEFAULT_SHARE = 3, 0.8
#: Pages whose lines of one skeleton are filled, for a blank in it to be an unfilled slot.
SKELETON_PAGES = 14
#: Pieces (from a capital to the next) of a template that stands in a sentence with others.
PART = 16
#: Words of filler that make a page residue.
FILLER_WORDS = 12

META, ITEM, PROSE, PROGRAM, FILLER, ENDED, EMPTY, HAS_KEY, HAS_PREFIX, WORDY = (1 << i for i in range(10))
SEGMENTS = 12
#: Kinds of template paths.
LEAF, HEAD, DEFAULT, TAG = 0, 1, 2, 3

# --- fixed values: headline data, which are main body though they are alike on many pages ---
_BYLINE = re.compile(
    r"^(?:by|von|par|por|di|door|od|text(?:o)?:?|автор:?|reporting by)\s+[^.]{3,80}$|^.{3,60}(?:, correspondent|, corresponsal de .+|, correspondente .+|, envoyée? spéciale? de .+|, inviat[oa] (?:di|de) .+|, verslaggever .+| berichtet für .+| bericht voor .+)$|^редакция .+, отдел .+$|^.+编辑部(?:[，,].+)?$|^(?:корреспондент|специально для) .+$|^记者.{2,30}$",
    re.I,
)
_DATE = re.compile(r"\b\d{4}-\d{2}-\d{2}\b|\d{4}-\d{2}-\d{2}|\b\d{1,2}[./]\d{1,2}[./]\d{4}\b|\d{4}年\d{1,2}月\d{1,2}日")
_READING = re.compile(r"^\W*(?:\d+\s*min(?:ute)?s?\s+(?:read|reading|lezen|leestijd)|(?:lesezeit|temps de lecture|tempo di lettura|tempo de leitura|tiempo de lectura|lectura de|leitura de|lettura(?: di)?|leestijd|reading time|время чтения|чтение)\s*:?\s*\d+.{0,12}|\d+\s*(?:minutos?|minuti|minuten|minutes)\s+(?:de |di )?(?:lectura|leitura|lettura|lecture|leestijd|lesezeit)|阅读.{0,8}\d+\s*分钟?.{0,4}|\d+\s*分钟阅读)\W*$", re.I)
# fixed values: forms of program output
_FLAT = re.compile(r"traceback \(most recent|\bfile \"[^\"]+\", line \d+|\b\w*(?:error|exception): |fatal error|\bwarning: |sqlstate\[|https?connectionpool|\b\d{3} (?:client|server) error|connection aborted|undefined variable|\[object object\]|\.php(?:\(\d+\)| on line)|\bat [\w.$<>]+\([\w.]+:\d+\)|remotedisconnected|segmentation fault|stack trace|\bnan undefined\b|<\/?noscript>", re.I)
# fixed values: signs that notations of templates put round the name of a variable
_SPAN = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|\$\{[^{}\n]{1,60}\}|\[\[[^\[\]\n]{1,60}\]\]|%%[^%\n]{1,60}%%|(?<!\w)__[^\W_][\w.]*?__(?!\w)|(?<!\w)#[^\W\d_][\w.]*#|\{[^{}\n]{1,60}\}|<[^\W\d_][^<>\n/=]{1,60}>|%\([^()\n]{1,60}\)s|\[[^\[\]\n]{1,60}\]|\bTODO:(?: [^\W\d_]+){1,2}"
)
# fixed values: words of a sentence that writes about slots
_MENTION = re.compile(r"placeholder|such as|platzhalter|marcador|espace réservé|segnaposto|espaço reservado|tijdelijke aanduiding|заполнител|占位|so-called|syntax|notation", re.I)
#: The customary filler vocabulary.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)


# each begins with one class of signs or one sign, so that the search goes straight to the next of them
_DIGITS, _OTHER = re.compile(r"[0-9][0-9]*"), re.compile(r"[^\w\s\x01\x03][^\w\s\x01\x03]*")
_HEX = re.compile(r"\b(?=[a-f]*0)(?:[a-f]|0){3,}\b")
_ANY = re.compile(r"[^\W_]")
_OUTER = " \t|•»·*–-\xa0\r"
#: Words and signs without which no line of a page can be filler or program output.
_FILLER_SIGNS = ("dolor", "ipsum", "aliqu", "eiusmod", "consequat", "incididunt", "exercitation", "cupidatat", "reprehenderit", "adipisc")
_PROGRAM_SIGNS = ("traceback", "error", "exception", "warning:", "sqlstate", "connectionpool", "file \"", "content type is", "empty html", "undefined", "[object", ".php", "noscript", "remotedisconnected", "segmentation", "stack trace", "connection aborted", "\n  at ", "\n\tat ")
_SEP = re.compile(r"\s*[|·•»>/]\s*|\s+-\s+|\s{2,}|\t")
_SEPS = frozenset("|·•»>/")
_SENT = re.compile(r"[.!?…。！？](?:(?<=[.!?…])[\"'”’»」)\]]*[^\S\n]+|(?<=[。！？]))")
_HEXLIKE = re.compile(r"0(?:[a-f]|(?<=[a-f]0))")
_CAPITAL = re.compile(r"(?<=\s)(?=[A-ZÀ-ÖØ-ÞА-ЯЁ0-9぀-ヿ㐀-鿿])")
_PREFIX = re.compile(r"^\W*([^\W\d][^:：\d]{1,30}?)\s?[:：]")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_ENDED = re.compile(r"[.!?。！？…][\"'”’»」)\]]*\s*$")
_ITEM = re.compile(r"^\s*(?:[•»*\-–·|]|\d{1,2}[.)])\s*")
_SIGN, _DIGIT = frozenset("{<[$%#"), re.compile(r"\d")
_MARKS = ",.;:!?，。；：！？"
_BLANK = re.compile(r"\w ,(?=\s|$)|,\s*,|\(\s*\)")
_NAMES = re.compile(r"[^\W_]+(?:[._][^\W_]+)*")
_TAGGED = re.compile(r"<(?:!doctype|html|body|div|p|ul|ol|li|a|span|article|section|nav|table|h[1-6])\b[^<>]*>", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|<![^<>]*>")
_CLASS = re.compile(r"\b(?:class|id)\s*=\s*[\"']?([\w-]+)")
_COMMENT = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def templates(text: str, host: str) -> list[list[str]]:
    """For each line of text (lower case) the leaves of its sentences, slots masked, empty ones left out."""
    s = _SENT.sub("\x01", text)
    s = _DIGITS.sub("0", s)
    if _HEXLIKE.search(s):
        s = _HEX.sub("0", s)
    s = _OTHER.sub(" ", s.replace("_", " "))
    if host:
        return [[x.replace(host, "§") for p in line.split("\x01") if (x := " ".join(p.split()))] for line in s.split("\n")]
    return [[x for p in line.split("\x01") if (x := " ".join(p.split()))] for line in s.split("\n")]


def template(text: str, host: str) -> str:
    return " ".join(templates(text.lower(), host)[0])


def host_words(name: str) -> str:
    """'the-daily.example' -> 'the daily', as a page writes its own name."""
    part = name.rsplit(".", 1)[0] if "." in name else name
    return re.sub(r"[\W_]+", " ", part.rsplit(".", 1)[-1]).strip()


def untag(text: str, name: str) -> tuple[list[str], list[tuple[int, int]]]:
    """(visible text, (path of tags, path above it)) of each line of a page that has tags; the paths bear tags, their class and the site."""
    text = _COMMENT.sub(lambda m: "\n" * m[0].count("\n"), text)
    stack: list[str] = []
    lines, paths = [], []
    for line in text.split("\n"):
        own: tuple[int, int] | None = None
        out, at = [], 0
        for m in [*_TAG.finditer(line), None]:
            piece = line[at : m.start() if m else len(line)]
            if own is None and piece.strip():
                own = h64(f"{name}\0{'/'.join(stack)}"), h64(f"{name}\0{'/'.join(stack[:-1])}")
            out.append(piece)
            if m is None:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if m[1] and any(x.split(".")[0] == tag for x in stack):
                while stack and stack.pop().split(".")[0] != tag:
                    pass
            elif tag and not m[1] and tag not in _VOID and not m[3].rstrip().endswith("/"):
                c = _CLASS.search(m[3])
                stack.append(f"{tag}.{c[1].lower()}" if c else tag)
        lines.append(" ".join("".join(out).split()))
        paths.append(own or (0, 0))
    return lines, paths


#: Lines remembered per site name, menus and notices being most of the short ones; emptied when it grows beyond this number.
REMEMBERED = 200_000


class Page:
    """What one page adds to the statistics of paths.

    codes: per line its flags and the number of its segments; hashes: per line, in order, those of its template, prefix and segments; sizes: beside each hash
    the length of its text, the punctuation in it, and its parent (kind of page, zone and kind of line). mass: text per parent. spans: possible slots; skeletons: lines with
    their words taken out, filled; blanks: the same of lines with an empty place. parts: of pages with hardly a sentence, per sentence the number of its line and of
    its pieces, which begin with a capital or a digit, its hash and those of its runs of up to PART pieces. tags, line_tags: paths of tags, if there are any.
    """

    def __init__(self, text: str, host: str, name: str = "", memo: dict | None = None):
        memo = {} if memo is None else memo
        self.codes: list[int] = []
        self.hashes: list[int] = []
        self.sizes: list[int] = []
        self.body: set[int] = set()
        self.spans: list[str] = []
        self.skeletons: set[int] = set()
        self.blanks: set[int] = set()
        self.parts: list[np.ndarray] = []
        self.filler = 0
        self.mass = [0] * 48
        self.tags: dict[int, list[int]] = {}
        self.line_tags: list[int] = []
        lines = text.split("\n")
        if "<" in text and _TAGGED.search(text):
            lines, paths = untag(text, name)
            text = "\n".join(lines)
            self.line_tags = [p for p, _ in paths]
            for line, (p, up) in zip(lines, paths):
                if p:
                    t = self.tags.setdefault(p, [up, 0, 0, 0])
                    for i, v in enumerate((1, len(line), sum(map(line.count, _MARKS))), 1):
                        t[i] += v
        low = text.lower()
        if any(x in text for x in "{<[$%#_") or "TODO" in text:
            self._spans(lines)
        latin = sum(x in low for x in _FILLER_SIGNS) >= 3
        program = any(x in low for x in _PROGRAM_SIGNS)
        long = [x for x in lines if len(x) > 120]
        wide = iter(templates("\n".join(long).lower(), host)) if long else iter(())
        got = []
        for line in lines:
            if len(line) > 120:
                got.append(_line(line, host, program, next(wide)))
            else:
                if (one := memo.get((host, line))) is None:
                    one = _line(line, host, program, None)
                    if not program:
                        if len(memo) >= REMEMBERED:
                            memo.clear()
                        memo[host, line] = one
                got.append(one)
        prose = [i for i, g in enumerate(got) if g[0] & PROSE]
        first, last = (prose[0], prose[-1]) if prose else (len(got), len(got))
        # pages with hardly a sentence are a branch of their own: most of them are notices of errors
        n_sentences = sum(max(1, g[0] >> SEGMENTS) for g in got if g[0] & PROSE)
        thin = 16 * ((n_sentences < LEAST_BODY) + (n_sentences < 3))
        for i, (line, (code, own, sizes, skeleton)) in enumerate(zip(lines, got)):
            if latin and not code & EMPTY:
                words = _WORD.findall(line.lower())
                if len(words) >= 5 and sum(w in LOREM for w in words) >= 0.7 * len(words):
                    code |= FILLER
                    self.filler += len(words)
            if code & PROSE and not code & (FILLER | PROGRAM | META):
                n = code >> SEGMENTS
                self.body.update(sorted(own[-n:])[:PER_LINE] if n else own[:1])
            parent = (0 if i < first else 2 if i > last else 1) | bool(code & ENDED) << 2 | bool(code & WORDY) << 3 | thin
            self.codes.append(code)
            self.hashes += own
            if sizes:
                self.sizes += [x | parent for x in sizes]
                self.mass[parent] += sum([x >> 22 for x in sizes])
            if thin and code & HAS_KEY and code & (PROSE | ENDED):
                for leaf in templates(_CAPITAL.sub("\x03", line.strip(_OUTER)).lower(), host)[0]:
                    pieces = [y for x in leaf.split("\x03") if (y := x.strip())]
                    runs = [h64(" ".join(pieces[j:k])) for j in range(len(pieces)) for k in range(j + 1, min(len(pieces), j + PART) + 1)]
                    self.parts.append(np.array([i, len(pieces), h64(" ".join(pieces)), *runs], np.uint64))
            if skeleton:
                (self.blanks if skeleton < 0 else self.skeletons).add(abs(skeleton))

    def _spans(self, lines: list[str]) -> None:
        before = ""
        for line in lines:
            for m in _SPAN.finditer(line):
                # a sentence that writes about slots, or the list below one, has none of its own
                if not _MENTION.search(line, max(0, m.start() - 90), m.start()) and not (m[0] == line.strip(_OUTER) and _MENTION.search(before)):
                    self.spans.append(m[0].lower())
            if _ANY.search(line):
                before = line if not _SPAN.fullmatch(line.strip(_OUTER)) else before


def _size(part: str, marks: int) -> int:
    return len(part) << 22 | min(marks, 0xFFFF) << 6


def _line(line: str, host: str, program: bool, leaves: list[str] | None) -> tuple[int, list[int], list[int], int]:
    """(flags and number of segments, hashes, sizes, hash of the skeleton: negative for one with a blank, 0 for none)."""
    s = line.strip()
    n, code, skeleton = len(s), 0, 0
    own: list[int] = []
    sizes: list[int] = []
    if not _ANY.search(s):
        return EMPTY, own, sizes, 0
    if program and PER_SIGN * sum(1 for _ in _FLAT.finditer(s)) >= n:
        code |= PROGRAM
    if _ITEM.match(s):
        code |= ITEM
    core = s.strip(_OUTER)
    if _ENDED.search(core[-12:]):
        code |= ENDED
    blanks = core.count(" ")
    cjk = len(_CJK.findall(core)) if core[-1:] > "\u3000" or core[:1] > "\u3000" else 0
    if (blanks >= 7 or cjk >= 15) and code & ENDED or blanks >= 24 or cjk >= 60:
        code |= PROSE
    if blanks >= 4 or cjk >= 10:
        code |= WORDY
    flat = " ".join(core.split()) if n <= 120 else ""
    if flat:
        if "," in flat or "(" in flat:
            shape = re.sub(r"[^\W_]+(?:\s+[^\W_]+)*", "w", flat)
            words = _WORD.findall(flat.lower())
            if words and not code & PROSE:
                shape = re.sub(r"\s+", "", shape)
                skeleton = (h64(f"{words[0]} {shape}") >> 1 or 1) * (-1 if _BLANK.search(flat) else 1)
        # dates and reading times have a digit
        if len(flat) <= 70 and _DIGIT.search(flat) and (len(flat) <= 60 and _READING.match(flat) or "©" not in flat and _DATE.search(flat)) or len(flat) <= 110 and not code & ENDED and _BYLINE.match(flat):
            return code | META, own, sizes, skeleton
    whole = leaves is None
    if whole and (not _SIGN.isdisjoint(core) or "__" in core or "TODO" in core) and _SPAN.search(core):
        # a line with what may be a slot keeps its signs, so that it isn't taken for one with the bare name
        leaves, whole = ["\x02" + " ".join(core.lower().split())], False
    elif whole:
        leaves = templates(core.lower(), host)[0]
    if not leaves:
        return code, own, sizes, skeleton
    marks = sum(map(core.count, _MARKS))
    key = " ".join(leaves)
    code |= HAS_KEY
    own.append(h64(key))
    sizes.append(_size(key, marks))
    if n <= 200 and (":" in core or "：" in core) and (m := _PREFIX.match(" ".join(core.split()))) and len(m[1].split()) <= 4 and (pre := template(m[1], host)):
        code |= HAS_PREFIX
        own.append(h64(pre + ":"))
        sizes.append(_size(key, marks))
    segs = leaves
    if whole:
        outer = line.strip(_OUTER)
        # with single blanks only and no sign that separates there is nothing to split
        parts = [outer] if outer == flat and _SEPS.isdisjoint(outer) and " - " not in outer else [x for x in _SEP.split(outer) if x.strip()]
        if len(parts) >= 2 and max(map(len, parts)) <= 30:
            segs = [k for x in parts if (k := template(x, host))]
        elif not code & (PROSE | ENDED):
            segs = []
    if len(segs) > 1:
        code |= len(segs) << SEGMENTS
        own += map(xxh64_intdigest, segs)
        each = _size("", -(-marks // len(segs)))
        sizes += [len(x) << 22 | each for x in segs]
    return code, own, sizes, skeleton


_PATHS = "tbl string, page_key string, page bigint, site string, codes array<bigint>, hashes array<bigint>, sizes array<bigint>, mass array<bigint>, filler int, body array<bigint>, bands array<bigint>, parts array<array<bigint>>, spans array<string>, skeletons array<bigint>, blanks array<bigint>, tags array<struct<path:bigint,up:bigint,nodes:int,chars:bigint,marks:bigint>>, line_tags array<bigint>"


def page_paths(pages: DataFrame) -> DataFrame:
    """pages (tbl, page_key, url, text) -> one row per page with what it adds to the statistics of paths (see Page).

    Texts are read line by line; tags are taken off, and their paths kept. Where one key comes with two texts the greater row counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        perms = permutations(ROWS * BANDS)
        names: dict[str, str] = {}
        ints = lambda x: signed(np.array(x if isinstance(x, list) else sorted(x), np.uint64))
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("codes", "hashes", "sizes", "mass", "filler", "body", "bands", "parts", "spans", "skeletons", "blanks", "tags", "line_tags")}
            for s, t in zip(b["site"], b["text"]):
                host = names.get(s)
                if host is None:
                    host = names[s] = host_words(s)
                p = Page(t, host, s, memo)
                body = np.sort(mix(np.array(list(p.body), np.uint64)))[:BODY] if len(p.body) >= LEAST_BODY else np.empty(0, np.uint64)
                tags = [{"path": int(signed(np.array([k], np.uint64))[0]), "up": int(signed(np.array([v[0]], np.uint64))[0]), "nodes": v[1], "chars": v[2], "marks": v[3]} for k, v in p.tags.items()]
                for c, v in zip(out, (np.array(p.codes, np.int64), ints(p.hashes), np.array(p.sizes, np.int64), np.array(p.mass, np.int64), p.filler, signed(body), signed(bands(body, perms)), [signed(x) for x in p.parts], p.spans, ints(p.skeletons), ints(p.blanks), tags, ints(p.line_tags))):
                    out[c].append(v)
            yield b[["tbl", "page_key", "page", "site"]].assign(**out)

    rows = pages.filter("page_key IS NOT NULL AND text IS NOT NULL").select("tbl", "page_key", F.xxhash64(F.lower(F.coalesce("url", "page_key"))).alias("page"), site(F.col("url")).alias("site"), "text")
    got = spread(rows).mapInPandas(run, _PATHS)
    rest = [c for c in got.columns if c not in ("tbl", "page_key")]
    # structs of arrays of structs don't compare by every type, so the greater row is chosen by its plain columns
    return got.groupBy("tbl", "page_key").agg(F.max_by(F.struct(*rest), F.struct("page", "codes", "hashes", "filler")).alias("p")).select("tbl", "page_key", "p.*")


def bands(body: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """Names of the bands of a body: ROWS minima under permutations each."""
    if not len(body):
        return body
    h = body * perms
    low = (h ^ (h >> np.uint64(29))).min(axis=1).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
    return out


def copies(paths: DataFrame) -> DataFrame:
    """(page, root): the pages that have near-equal copies, each with the least page of its class.

    Pages with a common band are compared with the least of them, so a class that holds a third of all pages costs no more than its rows. Pages
    that share a notice only meet in a band, too, but have too little in common.
    """
    named = paths.select("page", F.explode("bands").alias("band"))
    heads = named.groupBy("band").agg(F.min("page").alias("head"), F.max("page").alias("last")).filter("head < last").drop("last")
    pairs = named.join(heads, "band").filter("page <> head").select(F.col("head").alias("a"), F.col("page").alias("b")).distinct()
    bodies = paths.filter("size(body) > 0")
    first, second = bodies.select(F.col("page").alias("a"), F.col("body").alias("x")), bodies.select(F.col("page").alias("b"), F.col("body").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = pairs.join(first, "a").join(second, "b").filter(both >= COPIES * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()
    return components(cut(alike, "copies")).select(F.col("node").alias("page"), "root")


def leaf_ratios(paths: DataFrame, same: DataFrame) -> DataFrame:
    """(path, n, chars, marks, parent) of the leaves that stand in more than one body: places, and text and punctuation summed over them.

    Pages that are near-equal copies of each other (same: page, root) are one body.
    """
    one = paths.select("page", "hashes", "sizes").join(same, "page", "left").withColumn("page", F.coalesce("root", "page"))
    places = one.select("page", F.explode(F.arrays_zip("hashes", "sizes")).alias("x")).groupBy("page", F.col("x.hashes").alias("path")).agg(F.max("x.sizes").alias("size"))
    by = places.groupBy("path", F.col("size").bitwiseAND(F.lit(63)).alias("parent")).agg(F.count("*").alias("n"), F.sum(F.shiftright("size", 22)).alias("chars"), F.sum(F.shiftright("size", 6).bitwiseAND(F.lit(0xFFFF))).alias("marks"))
    leaf = by.groupBy("path").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("marks").alias("marks"), F.max_by("parent", "n").alias("parent"))
    return leaf.filter("n > 1")


def leaf_templates(paths: DataFrame, leaves: DataFrame) -> DataFrame:
    """(path) of the leaves whose ratio, smoothed by that of their parents and fused with punctuation, is under the threshold."""
    # one number per parent: 48 rows
    mass = paths.agg(*(F.coalesce(F.sum(F.element_at("mass", i + 1)), F.lit(0)).alias(f"m{i}") for i in range(48))).select(F.posexplode(F.array(*(f"m{i}" for i in range(48)))).alias("parent", "mass"))
    again = leaves.groupBy("parent").agg(F.sum(F.col("chars") - F.col("chars") / F.col("n")).alias("again"))
    parents = mass.join(again, "parent", "left").select("parent", F.greatest(F.lit(0.0), 1 - F.coalesce("again", F.lit(0.0)) / F.greatest("mass", F.lit(1))).alias("new"))
    said = F.col("chars") / F.col("n")
    ratio = (said + SMOOTH * F.col("new") * said) / (F.col("chars") + SMOOTH * said)
    weight = 1 + MARKED * F.least(F.lit(1.0), F.col("marks") / F.col("n") / 2) * F.least(F.lit(1.0), said / 60)
    return leaves.join(F.broadcast(parents), "parent").filter(ratio * weight < THRESHOLD).select("path")


def tag_templates(paths: DataFrame) -> DataFrame:
    """(path) of the paths of tags whose text per node, smoothed by the path above and fused with punctuation and nodes per page, is under the threshold."""
    each = paths.filter("size(tags) > 0").select(F.explode("tags").alias("t")).select("t.*").groupBy("path").agg(F.max("up").alias("up"), F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in ("nodes", "chars", "marks")))
    above = each.select(F.col("path").alias("up"), (F.col("chars") / F.col("nodes")).alias("up_chars"), (F.col("marks") / F.col("nodes")).alias("up_marks"))
    smooth = lambda c: (F.col(c) + F.coalesce(TAG_SMOOTH * F.col(f"up_{c}"), F.lit(0.0))) / (F.col("nodes") + F.when(F.col(f"up_{c}").isNull(), 0.0).otherwise(TAG_SMOOTH))
    fused = smooth("chars") * (1 + smooth("marks")) / F.sqrt(F.col("nodes") / F.col("pages"))
    return each.join(above, "up", "left").filter(fused < TAG_THRESHOLD).select("path")


def with_templates(paths: DataFrame, tops: DataFrame, columns: list[str], work: Callable, schema: str, broadcast: int = BROADCAST) -> DataFrame:
    """work(row, paths of LEAF, HEAD, DEFAULT and TAG kind that it may use) for each page; tops: (path, kind).

    tops is broadcast while it is small, else each page is joined with its own.
    """
    keep = ["tbl", "page_key"]
    if tops.count() <= broadcast:
        known = [(r["path"], r["kind"]) for r in tops.toLocalIterator()]
        arrays = [np.array([p for p, k in known if k == kind], np.int64) for kind in range(4)]
        shared = paths.sparkSession.sparkContext.broadcast(arrays)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sets = [set(a.tolist()) for a in shared.value]
            for b in batches:
                yield work(b, [sets] * len(b))

        return paths.select(*keep, *columns).mapInPandas(run, schema)
    uses = F.concat("hashes", "line_tags", F.flatten("parts"))
    own = paths.select(*keep, F.explode(F.array_distinct(uses)).alias("path")).join(tops, "path").groupBy(*keep).agg(F.collect_list("path").alias("_path"), F.collect_list("kind").alias("_kind"))

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = []
            for p, k in zip(b["_path"], b["_kind"]):
                pairs = [] if p is None else list(zip(p.tolist(), k.tolist()))
                sets.append([{x for x, y in pairs if y == kind} for kind in range(4)])
            yield work(b, sets)

    return paths.join(own, keep, "left").select(*keep, *columns, "_path", "_kind").mapInPandas(run_joined, schema)


def template_lines(codes: list[int], hashes: list[int], known: set[int]) -> tuple[list[bool], list[int]]:
    """(whether a line is of a template: its own leaf, its prefix or all of its segments are; its own hash, 0 for none) of each line."""
    out, own = [], []
    at = 0
    for c in codes:
        hit = bool(c & HAS_KEY) and hashes[at] in known
        own.append(hashes[at] if c & HAS_KEY else 0)
        at += bool(c & HAS_KEY)
        if c & HAS_PREFIX:
            hit = hit or hashes[at] in known
            at += 1
        k = c >> SEGMENTS
        if k > 1:
            hit = hit or all(h in known for h in hashes[at : at + k])
            at += k
        out.append(hit and not c & META)
    return out, own


def children(codes: list[int], hashes: list[int], known: set[int]) -> list[tuple[int, int, int]]:
    """(own hash, bare lines that follow, those that end like sentences) of each line of a template."""
    of, own = template_lines(codes, hashes, known)
    out: list[tuple[int, int, int]] = []
    head, n, ended = 0, 0, 0
    for c, t, h in zip(codes, of, own):
        if c & EMPTY:
            continue
        if t or c & (META | PROSE):
            if head:
                out.append((head, n, ended))
            head, n, ended = (h if h in known and not c & (PROSE | ENDED | META) else 0), 0, 0
        else:
            n += 1
            ended += bool(c & ENDED)
    if head:
        out.append((head, n, ended))
    return out


def link_heads(paths: DataFrame, tops: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """(path) of the templates that head lists of links: at each place they lead to several bare lines that few other pages have."""

    def work(b: pd.DataFrame, sets: list) -> pd.DataFrame:
        got = [x for c, h, k in zip(b["codes"], b["hashes"], sets) for x in children(c.tolist(), h.tolist(), k[LEAF])]
        one = pd.DataFrame(got, columns=["path", "children", "ended"]).groupby("path", as_index=False).agg(n=("path", "size"), children=("children", "sum"), ended=("ended", "sum"))
        return one[["path", "n", "children", "ended"]]

    counts = with_templates(paths, tops, ["codes", "hashes"], work, "path bigint, n bigint, children bigint, ended bigint", broadcast)
    total = counts.groupBy("path").agg(*(F.sum(c).alias(c) for c in ("n", "children", "ended")))
    return total.filter((F.col("children") >= CHILDREN * (F.col("n") + SMOOTH)) & (F.col("ended") <= ENDINGS * F.col("children"))).select("path")


def composed(parts: list[list[int]], known: set[int]) -> set[int]:
    """Numbers of the lines all of whose sentences are templates, or several templates that follow each other without a sign, as the title and text of an error do."""
    good: dict[int, bool] = {}
    for line, n, whole, *runs in parts:
        if whole not in known:
            ends, at = {0}, 0
            for j in range(n):
                size = min(n - j, PART)
                if j in ends:
                    ends.update(j + k + 1 for k in range(size) if runs[at + k] in known)
                at += size
            good[line] = good.get(line, True) and n in ends
        else:
            good[line] = good.get(line, True)
    return {i for i, hit in good.items() if hit}


def judge(codes: list[int], hashes: list[int], known: set[int], heads: set[int], filler: int, line_tags: list[int] = (), low_tags: set[int] = frozenset(), parts: list[list[int]] = ()) -> tuple[bool, list[int]]:
    """(residue, numbers of the lines that are not main body).

    A line of a template is not main body, but for headline data such as dates and bylines; nor is one on a path of tags with a low ratio. Bare lines under the
    heading of a list of links are links up to the next prose or headline datum.
    """
    n = len(codes)
    of, own = template_lines(codes, hashes, known)
    for i in composed(parts, known):
        of[i] = True
    if line_tags:
        of = [t or (p in low_tags and bool(c & HAS_KEY)) for t, p, c in zip(of, line_tags, codes)]
    prose = any(c & PROSE and not t and not c & (FILLER | PROGRAM | META) for c, t in zip(codes, of))
    residue = filler >= FILLER_WORDS or not prose and any(not c & EMPTY for c in codes)
    drop = [False] * n
    linking, headline, shared = False, False, -1
    block: list[int] = []

    def body_begins() -> None:
        # a page has its headline before its body: where none was seen, it is the last line of the block of links above, if that bears no bullet
        # or else the last line of some length that many copies of the article share
        nonlocal shared
        if not headline:
            if block and not codes[block[-1]] & ITEM:
                drop[block[-1]] = False
            elif shared >= 0:
                drop[shared] = False
        block.clear()
        shared = -1

    for i, c in enumerate(codes):
        if c & EMPTY:
            continue
        if of[i] and own[i] in heads:
            block.clear()
            drop[i] = linking = True
        elif c & META:
            body_begins()
            linking, headline = False, True
        elif of[i]:
            linking = False
            drop[i] = True
            if c & WORDY and not c & (ITEM | ENDED | HAS_PREFIX) and not c >> SEGMENTS:
                shared = i
        elif c & PROSE:
            body_begins()
            linking, headline = False, True
        elif linking:
            drop[i] = True
            block.append(i)
        else:
            headline = True
            block.clear()
    return residue, [i for i in range(n) if drop[i]]


def align(span: str) -> list[tuple[str, str]]:
    """(template, value) for every run of words of a span that can be its slot: what stands round the run, and the run, marks between its words as blanks."""
    words = list(_NAMES.finditer(span))
    out = []
    for i in range(len(words)):
        for j in range(i, len(words)):
            value = " ".join(re.split(r"[\W_]+", span[words[i].start() : words[j].end()]))
            out.append((re.sub(r"\s+", "", span[: words[i].start()] + "\x00" + span[words[j].end() :]), value))
    return out


def unfilled(paths: DataFrame) -> DataFrame:
    """(tbl, page_key) of the pages with slots left unfilled, induced by aligning what may be a slot over all pages.

    Spans of one template are aligned with each other: what differs between them is the slot. A value that fills the slots of several templates is the
    name of a variable; a template that several names fill has a slot. A slot that holds such a name is unfilled. So is a default, a span
    most of whose pages have unfilled slots, and a blank in a line whose skeleton other pages fill.
    """
    spans = cut(paths.filter("size(spans) > 0").select("tbl", "page_key", "page", F.explode(F.array_distinct("spans")).alias("span")), "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(s, t, v) for s in b["span"] for t, v in align(s)], columns=["span", "template", "value"])

    aligned = cut(spans.select("span").distinct().mapInPandas(run, "span string, template string, value string"), "aligned")
    names = aligned.groupBy("value").agg(F.countDistinct("template").alias("n")).filter(F.col("n") >= FILLS).select("value")
    named = aligned.join(names, "value", "left_semi")
    slots = named.groupBy("template").agg(F.countDistinct("value").alias("n")).filter(F.col("n") >= NAMES).select("template")
    held = named.join(slots, "template", "left_semi").select("span").distinct()
    found = cut(spans.join(held, "span", "left_semi").select("tbl", "page_key", "page").distinct(), "unfilled")
    marked = spans.join(found.select("page", F.lit(1).alias("has")).distinct(), "page", "left")
    share = marked.groupBy("span").agg(F.countDistinct("page").alias("n"), F.countDistinct(F.when(F.col("has") == 1, F.col("page"))).alias("k"))
    defaults = share.filter((F.col("k") >= DEFAULT_PAGES) & (F.col("k") >= DEFAULT_SHARE * F.col("n"))).select("span")
    filled = paths.select("page", F.explode("skeletons").alias("skeleton")).groupBy("skeleton").agg(F.countDistinct("page").alias("n")).filter(F.col("n") >= SKELETON_PAGES).select("skeleton")
    blank = paths.filter("size(blanks) > 0").select("tbl", "page_key", F.explode("blanks").alias("skeleton")).join(filled, "skeleton", "left_semi")
    return found.select("tbl", "page_key").union(spans.join(defaults, "span", "left_semi").select("tbl", "page_key")).union(blank.select("tbl", "page_key")).distinct()


def default_lines(paths: DataFrame, slotted: DataFrame, leaves: DataFrame, same: DataFrame) -> DataFrame:
    """(path) of bare lines that are defaults: nearly all of the bodies that have them have unfilled slots, and these are of more than one site."""
    bodies = paths.join(slotted, ["tbl", "page_key"], "left_semi").join(same, "page", "left").withColumn("page", F.coalesce("root", "page"))
    mine = bodies.select("page", "site", F.explode(F.arrays_zip("hashes", "sizes")).alias("x")).filter(F.col("x.sizes").bitwiseAND(F.lit(4)) == 0)
    own = mine.groupBy(F.col("x.hashes").alias("path")).agg(F.countDistinct("page").alias("k"), F.countDistinct("site").alias("sites")).filter((F.col("k") >= DEFAULT_PAGES) & (F.col("sites") > 1))
    return own.join(leaves, "path").filter(F.col("k") >= DEFAULT_SHARE * F.col("n")).select("path")


def judged(paths: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """(tbl, page_key, residue, dropped): the verdict on every page and the numbers of its lines that are not main body."""
    same = cut(copies(paths), "same")
    leaves = cut(leaf_ratios(paths, same), "leaves")
    slotted = cut(unfilled(paths), "slotted")
    kind = lambda df, k: df.select("path", F.lit(k).alias("kind"))
    tops = cut(kind(leaf_templates(paths, leaves), LEAF).union(kind(tag_templates(paths), TAG)), "templates")
    heads = link_heads(paths, tops, broadcast)
    tops = cut(tops.union(kind(heads, HEAD)).union(kind(default_lines(paths, slotted, leaves, same), DEFAULT)), "templates")

    def work(b: pd.DataFrame, sets: list) -> pd.DataFrame:
        got = []
        for c, h, f, t, p, (known, first, defaults, low) in zip(b["codes"], b["hashes"], b["filler"], b["line_tags"], b["parts"], sets):
            hashes = h.tolist()
            bad, drop = judge(c.tolist(), hashes, known, first, f, t.tolist(), low, [x.tolist() for x in p])
            got.append((bad or bool(defaults) and not defaults.isdisjoint(hashes), np.array(drop, np.int32)))
        return b[["tbl", "page_key"]].assign(residue=[g[0] for g in got], dropped=[g[1] for g in got])

    verdict = with_templates(paths, tops, ["codes", "hashes", "filler", "line_tags", "parts"], work, "tbl string, page_key string, residue boolean, dropped array<int>", broadcast)
    return verdict.join(slotted.withColumn("slot", F.lit(True)), ["tbl", "page_key"], "left").select("tbl", "page_key", (F.col("residue") | F.coalesce("slot", F.lit(False))).alias("residue"), "dropped")


def passed_on(url_content: DataFrame) -> DataFrame:
    """Pages of the rows that are accessible or have both an error and a date: url_content if it isn't empty, else error."""
    admitted = url_content.filter(F.coalesce("accessible", F.lit(False)) | (F.col("error").isNotNull() & F.col("published_date").isNotNull()))
    return admitted.select(F.lit("url_content").alias("tbl"), F.col("crawl_id").cast("string").alias("page_key"), "url", F.coalesce(F.when(F.col("url_content") != "", F.col("url_content")), F.col("error")).alias("text"))


def accessible(url_content: DataFrame) -> DataFrame:
    return url_content.filter("accessible").select(F.lit("url_content").alias("tbl"), F.col("crawl_id").cast("string").alias("page_key"), "url", F.col("url_content").alias("text"))


def corpus_pages(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.lit("corpus").alias("tbl"), F.col("_id").alias("page_key"), F.col("_id").alias("url"), "text")


def residue(pages: DataFrame) -> DataFrame:
    """(tbl, page_key) of the pages (tbl, page_key, url, text) that are residue.

    Residue is a page with a slot left unfilled, with a default or a blank in it (unless the sentence writes about such), with filler, or without any prose of its
    own: all its lines belong to templates that other pages share (menus, error pages, calls for scripts), or are program output.
    Null keys and null or empty texts are never residue. A page delivered twice counts once.
    """
    return judged(cut(page_paths(pages.filter("text <> ''")), "paths")).filter("residue").select("tbl", "page_key")


def boilerplate(pages: DataFrame) -> DataFrame:
    """(tbl, page_key, line_no) of the lines that are not main body; pages that are residue give none. Null and empty texts have no lines."""
    return judged(cut(page_paths(pages), "paths")).filter("NOT residue").select("tbl", "page_key", F.explode("dropped").alias("line_no"))


def main_body(pages: DataFrame) -> DataFrame:
    """(tbl, page_key, body): the text of each page without the lines that are not main body; residue gives null."""
    verdict = judged(cut(page_paths(pages), "paths"))
    rows = pages.filter("page_key IS NOT NULL AND text IS NOT NULL").groupBy("tbl", "page_key").agg(F.max("text").alias("text"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("dropped", i))
    return rows.join(verdict, ["tbl", "page_key"]).select("tbl", "page_key", F.when(~F.col("residue"), F.array_join(kept, "\n")).alias("body"))


def without_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "url_content")
    bad = residue(passed_on(rows)).select(F.col("page_key").cast("bigint").alias("crawl_id"))
    return rows.join(bad, "crawl_id", "left_anti")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(passed_on(read(spark, sf_dir, "url_content"))).select(F.col("page_key").cast("bigint").alias("crawl_id"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accessible(read(spark, sf_dir, "url_content")).unionByName(corpus_pages(read(spark, sf_dir, "corpus")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate(_both(spark, sf_dir))


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body(_both(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_rest": without_residue, "p4_found": p4_found, "p4_bodies": p4_bodies}
SQL: dict = {}

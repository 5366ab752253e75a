"""Problem 9: abusive, hateful or sexually explicit texts, by non-negative learning from positive and unlabelled examples.

A text is a row of segments (sentences, lines), a segment a set of words and of pairs of adjacent words, each known by a 64-bit hash.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import spread
from .common import MULT, WordHash, cut, mix, read

#: Bounds of the fitted sample: documents with confirmed verdicts, and unlabelled documents, chosen by the hash of their key.
MOST_POSITIVE, MOST_UNLABELLED = 3000, 12000
#: A document above this score is toxic.
THRESHOLD = 0.4
WINDOW = 14
#: Sharpness of the soft maximum over the segments of a text.
SHARP = 4.0
#: Texts whose words are looked up at once.
CHUNK = 256
# fixed values: the notations of verdicts
TOXIC, CLEAN = frozenset("abusive abuse hateful hate adult sexual toxic explicit".split()), frozenset("ok clean fine safe".split())

_HIDDEN = re.compile("[­​-‏⁠️﻿]")


def _signs(signs: Iterable[str]) -> str:
    """The inside of a class of these signs, in order: one table for the search, where categories are asked sign by sign."""
    out: list[list[int]] = []
    for i in map(ord, signs):
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


# texts with a sign beyond the first plane, for which a class would be a long list, take the patterns with categories
_WIDE = re.compile("[\U00010000-\U0010ffff]")
_ALNUM = [c for c in map(chr, range(0x10000)) if c.isalnum()]
#: In the first plane: letters in the sense of [^\W\d_]; decimal digits; what is alphanumeric but no letter of an alphabet.
_L, _D, _N = _signs(c for c in _ALNUM if not c.isdecimal()), _signs(filter(str.isdecimal, _ALNUM)), _signs(c for c in _ALNUM if not c.isalpha())
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_·*]{1,2}[^\W\d_](?![^\W_])){2,}")
# what a text must have for the pattern above to match
_MAYBE_SPACED = re.compile(r"[ .\-_·*][^\W\d_][ .\-_·*]{1,2}[^\W\d_](?![^\W_])")
_LEET = re.compile(r"(?<![\w@$!(+])(?=[^\s]*[^\W\d_])[(@$]?(?:[^\W_]|[@$!(+|](?=[^\W_]))+")
_LEET_SIGN = re.compile(rf"[{_N}@$!(+|]")
_MASK = re.compile(r"([^\W\d_])[*#]{2,}([^\W\d_])?")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_CYRILLIC, _MIXED = re.compile("[а-яёіјѕ]"), re.compile(r"[a-z](?:[а-яёіјѕ]|(?<=[а-яёіјѕ].))")
_TOKEN = re.compile(rf"\n|[぀-ヿ㐀-鿿]+|[{_L}]+(?:'[{_L}]+)?(?:\*[{_L}]?)?")
_TOKEN_WIDE = re.compile(r"\n|[぀-ヿ㐀-鿿]+|[^\W\d_]+(?:'[^\W\d_]+)?(?:\*[^\W\d_]?)?")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_SEGMENT = re.compile(r"[.!?…;\n。！？；](?:(?<=[.!?…;])[.!?…;]*(?=[\s\"'”’»)]|$)|(?<=\n)\n*|(?<=[。！？；])[。！？；]*)")
# fixed values: signs that stand for letters
_SIGNS = str.maketrans("@431!05$7(+|", "aeiiiosstctl")
_TWINS = str.maketrans("аеорсухіјѕкмтвн", "aeopcyxijskmtbh")
_TRIPLES = tuple(3 * c for c in "abcdefghijklmnopqrstuvwxyz")
_ODD_SIGNS = (*"*#@$(|+", *_TRIPLES)
_ODD = re.compile(rf"[{_D}! .\-_·](?:(?<=[{_D}])[{_L}]|(?<=[{_L}][{_D}!])[^\W_]|(?<=[ .\-_·])[{_L}][ .\-_·][{_L}](?![^\W_]))")
_ODD_WIDE = re.compile(r"\d[^\W\d_]|[\d!](?<=[^\W\d_].)[^\W_]|[ .\-_·][^\W\d_][ .\-_·][^\W\d_](?![^\W_])")
_TRIPLE = re.compile(rf"([{_signs(c for c in _ALNUM if not c.isdecimal() and not "a" <= c <= "z")}])\1\1")
_TRIPLE_WIDE = re.compile(r"([^\W\d_a-z])\1\1")


def _wide(s: str) -> bool:
    return not s.isascii() and bool(_WIDE.search(s))


def _mixed(s: str) -> bool:
    return not s.isascii() and bool(_CYRILLIC.search(s)) and bool(_MIXED.search(s))


def _odd(s: str) -> bool:
    for x in _ODD_SIGNS:
        if x in s:
            return True
    if s.isascii():
        return bool(_ODD.search(s))
    odd, triple = (_ODD_WIDE, _TRIPLE_WIDE) if _wide(s) else (_ODD, _TRIPLE)
    return bool(odd.search(s)) or bool(_HIDDEN.search(s)) or _mixed(s) or bool(triple.search(s))


def _letters(s: str) -> str:
    """s with digits and signs that stand for letters replaced; only where a word has such a sign is it looked at."""
    if _wide(s):
        return _LEET.sub(lambda m: _plain(m[0]), s)
    out, at = [], 0
    for m in _LEET_SIGN.finditer(s):
        i = m.start()
        if i < at:
            continue
        while i and s[i - 1].isalpha():
            i -= 1
        if i >= at and (found := _LEET.match(s, i)):
            out += s[at:i], _plain(found[0])
            at = found.end()
    return "".join([*out, s[at:]]) if out else s


def _plain(w: str) -> str:
    if w[0].isdigit() and len(w) > 1 and not w[1].isalpha() or w.isalpha():
        return w
    letters = sum(c.isalpha() and c < "\u0500" for c in w)
    return w.translate(_SIGNS) if letters >= 2 and len(w) - letters <= letters + 1 else w


def normalise(text: str) -> str:
    """Lower case with the usual disguises undone: hidden signs, spaced or stretched letters, digits and signs for letters, twins of other scripts, masks."""
    s = text.lower()
    if not _odd(s):
        return s
    s = unicodedata.normalize("NFKC", _HIDDEN.sub("", s))
    if _MAYBE_SPACED.search(s):
        s = _SPACED.sub(lambda m: re.sub(r"[ .\-_·*]", "", m[0]), s)
    if _mixed(s):
        s = re.sub(r"[a-zа-яёіјѕ]+", lambda m: m[0].translate(_TWINS) if _MIXED.search(m[0]) else m[0], s)
    if "*" in s or "#" in s:
        s = _MASK.sub(r"\1*\2", s)
    s = _letters(s)
    low = s.lower() if s.isascii() else ""
    return _STRETCH.sub(r"\1", s) if not s.isascii() or any(x in low for x in _TRIPLES) else s


@dataclass
class Words:
    """Texts as arrays: a hash for each word, the segment of each word, the text of each segment."""

    words: np.ndarray
    seg: np.ndarray
    doc: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions of words whose segment goes on, hash of each with its successor)."""
        at = np.flatnonzero(self.seg[1:] == self.seg[:-1])
        return at, mix(self.words[at] * MULT[0] + self.words[at + 1])


def split_words(texts: list[str], memo: WordHash) -> Words:
    """Texts in words; script without blanks gives pairs of signs."""
    words: list[str] = []
    ends = []
    for text in texts:
        clean = normalise(text)
        found = (_TOKEN_WIDE if _wide(clean) else _TOKEN).findall(_SEGMENT.sub("\n", clean))
        if not clean.isascii() and _CJK.search(clean):
            found = [x for w in found for x in ([w[i : i + 2] for i in range(max(1, len(w) - 1))] if "぀" <= w[0] <= "鿿" else (w,))]
        words += found
        ends.append(len(words))
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    text_of = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
    cut_here = hashes == memo["\n"]
    number = np.cumsum(cut_here) + text_of
    keep = ~cut_here
    kinds, seg = np.unique(number[keep], return_inverse=True)
    doc = np.zeros(len(kinds), np.int64)
    doc[seg] = text_of[keep]
    return Words(hashes[keep], seg, doc)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


@dataclass
class Model:
    """Weights of words and of pairs of adjacent words, by their sorted hashes."""

    bias: float = -30.0
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))

    def segments(self, t: Words) -> np.ndarray:
        """Logit of every segment: of the whole, or of its window with the most weight where it is longer."""
        if not len(t.words):
            return np.empty(0)
        w = _lookup(self.keys, self.weights, t.words)
        at, pairs = t.pairs()
        w[at] += _lookup(self.keys, self.weights, pairs)
        first = np.flatnonzero(np.concatenate([[True], t.seg[1:] != t.seg[:-1]]))
        size = np.diff([*first, len(w)])
        best = np.add.reduceat(w, first)
        run = np.concatenate([[0.0], np.cumsum(w)])
        starts = np.flatnonzero(np.arange(len(w)) + WINDOW <= np.repeat(first + size, size))
        np.maximum.at(best, t.seg[starts], run[starts + WINDOW] - run[starts])
        return self.bias + best

    def scores(self, texts: list, memo: WordHash) -> np.ndarray:
        """The score of each text, 0 to 1: that of its most toxic segments; 0 where there is no word."""
        out = np.zeros(len(texts))
        for i in range(0, len(texts), CHUNK):
            part = [t or "" for t in texts[i : i + CHUNK]]
            t = split_words(part, memo)
            z = self.segments(t)
            top = np.full(len(part), -np.inf)
            np.maximum.at(top, t.doc, z)
            # a sharp soft maximum: it lies above the greatest logit by log(segments) / SHARP at most, and orders texts by their other segments, too
            more = np.bincount(t.doc, np.exp(SHARP * (z - top[t.doc])), len(part))
            top = top + np.log(np.maximum(more, 1)) / SHARP
            out[i : i + len(part)] = 1 / (1 + np.exp(-np.clip(top, -700, 30)))
        return np.where(out < 1e-300, 0.0, out)

    def score(self, text: str | None) -> float:
        return float(self.scores([text], WordHash())[0])


def _pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of numbers under 2**32, in order; in place, and by sorting: np.unique hashes, which takes longer for millions."""
    both = first.astype(np.uint64)
    both <<= np.uint64(32)
    both |= second.view(np.uint64)
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    second = (both & np.uint64(0xFFFFFFFF)).view(np.int64)
    both >>= np.uint64(32)
    return both.view(np.int64), second


def features(t: Words) -> tuple[np.ndarray, np.ndarray]:
    """(segment, hash) of the distinct words and pairs of every segment."""
    at, pairs = t.pairs()
    seg, h = np.concatenate([t.seg, t.seg[at]]), np.concatenate([t.words, pairs])
    kinds, name = np.unique(h, return_inverse=True)
    del h
    seg, name = _pairs(seg, name)
    return seg, kinds[name]


class _Matrix:
    """Rows (seg, in order) of features that have a name, each feature once in a row, with a last column of ones for the bias; kept by rows and by columns."""

    def __init__(self, seg: np.ndarray, h: np.ndarray, n: int, names: np.ndarray):
        at = np.searchsorted(names, h)
        np.minimum(at, len(names) - 1, out=at)
        hit = names[at] == h
        self.n, self.width = n, len(names) + 1
        self.column, row = at[hit], seg[hit]
        del at, hit
        starts = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
        self.row_starts = starts(row)
        self.rows = row[self.row_starts]
        order = np.argsort(self.column, kind="stable")
        self.row = row[order]
        row = self.column[order]
        self.column_starts = starts(row)
        self.columns = row[self.column_starts]
        self.room = np.empty(len(row))

    def dot(self, w: np.ndarray) -> np.ndarray:
        """The sum of the weights of each row."""
        out = np.full(self.n, w[-1])
        if len(self.rows):
            out[self.rows] += np.add.reduceat(w.take(self.column, out=self.room, mode="clip"), self.row_starts)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        """The sum of g over the rows of each column."""
        out = np.zeros(self.width)
        if len(self.columns):
            out[self.columns] = np.add.reduceat(g.take(self.row, out=self.room, mode="clip"), self.column_starts)
        out[-1] = g.sum()
        return out


def _fit(pos: _Matrix, unl: _Matrix, names: np.ndarray, prior: float, steps: int = 120, rate: float = 0.15, ridge: float = 2e-3) -> Model:
    """Linear classifier under the non-negative positive-unlabelled risk: prior * R+(P) + max(0, R-(U) - prior * R-(P)), by Adam.

    The loss is the sigmoid, which bounds what a wrong verdict can do. Where the part in brackets would fall below zero it has no slope.
    """
    n_pos, n_unl, size = pos.n, unl.n, len(names) + 1
    w = np.zeros(size)
    w[-1] = -2.0
    m, v = np.zeros(size), np.zeros(size)
    free = np.arange(size) < size - 1
    for t in range(1, steps + 1):
        zp, zu = pos.dot(w), unl.dot(w)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        gp, gu = -prior * sp * (1 - sp) / n_pos, np.zeros(n_unl)
        if su.mean() > prior * sp.mean():
            gp, gu = 2 * gp, su * (1 - su) / n_unl
        g = (pos.back(gp) + unl.back(gu)) / prior + ridge * w * free
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(w[-1]), names, w[:-1].astype(np.float32))


def train(positive: list[str], unlabelled: list[str], prior: float, rounds: int = 3) -> Model:
    """Fit on segments: at first those of confirmed documents with words that other documents use less stand for them, then those that the model takes for toxic.

    prior: the share of toxic documents; that of toxic segments follows from it and from the number of positive segments a document has.
    """
    memo = WordHash()
    pos, unl = split_words(positive, memo), split_words(unlabelled, memo)
    n_docs = len(np.unique(pos.doc))
    if not n_docs or not len(unl.doc):
        return Model()
    per_doc = len(unl.doc) / max(1, len(unlabelled))
    ps, ph = features(pos)
    us, uh = features(unl)

    def documents(seg: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, name = np.unique(h, return_inverse=True)
        return kinds, np.bincount(_pairs(name, doc[seg])[0], minlength=len(kinds))

    in_pos, n_pos = documents(ps, ph, pos.doc)
    in_unl, n_unl = documents(us, uh, unl.doc)
    often = n_pos >= 2
    ratio = np.log((n_pos + 0.5) / (n_docs + 1)) - np.log((_lookup(in_unl, n_unl.astype(float), in_pos) + 0.5) / (len(unlabelled) + 1))
    worth = _lookup(in_pos, np.where(often & (ratio > 1.0), ratio, 0.0), ph)
    length = np.bincount(pos.seg, minlength=len(pos.doc))
    gain = np.bincount(ps, worth, len(pos.doc)) / np.sqrt(length + 2)
    best = np.zeros(int(pos.doc.max()) + 1)
    np.maximum.at(best, pos.doc, gain)
    chosen = np.flatnonzero((gain > 0) & (gain >= 0.6 * best[pos.doc]))
    chosen = chosen if len(chosen) else np.arange(len(pos.doc))
    # what several confirmed documents have, and what isn't rare in the others
    kinds, uses = np.unique(uh, return_counts=True)
    names = np.union1d(in_pos[often], kinds[uses >= 4])
    unl_matrix = _Matrix(us, uh, len(unl.doc), names)
    model = Model()
    for r in range(rounds):
        share = min(0.3, max(1e-3, prior * min(2.0, max(1.0, len(chosen) / n_docs)) / per_doc))
        row = np.full(len(pos.doc), -1)
        row[chosen] = np.arange(len(chosen))
        hit = row[ps] >= 0
        model = _fit(_Matrix(row[ps][hit], ph[hit], len(chosen), names), unl_matrix, names, share)
        if r + 1 < rounds:
            z = model.segments(pos)
            order = np.lexsort((-z, pos.doc))
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(np.concatenate([[True], pos.doc[order][1:] != pos.doc[order][:-1]]), np.arange(len(order)), 0))
            picked = order[(place < 3) & (z[order] > 0)]
            chosen = np.sort(picked) if len(picked) else chosen
    return model


def verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, votes) of documents with a clear majority; verdicts repeated by one annotator count once, unknown ones not at all."""
    word = F.lower(F.trim("label"))
    vote = F.when(word.isin(*sorted(TOXIC)), 1).when(word.isin(*sorted(CLEAN)), 0)
    each = labels.select("doc_id", "annotator", vote.alias("v")).filter("v IS NOT NULL AND doc_id IS NOT NULL").distinct()
    tally = each.groupBy("doc_id").agg(F.sum("v").alias("yes"), F.count("*").alias("votes"))
    return tally.filter("2 * yes <> votes").select("doc_id", (F.col("yes") * 2 > F.col("votes")).alias("toxic"), "votes")


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """The classifier, from at most most_positive confirmed toxic documents and most_unlabelled others; the class prior comes from all verdicts."""
    known = cut(verdicts(labels), "verdicts")
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"]
    if not share:
        return Model()
    docs = documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text <> ''")
    marked = docs.join(known.filter("toxic").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", "text", F.coalesce("toxic", F.lit(False)).alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"))
    # rows are chosen where they are, so that no task sends more than its share
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    most = {True: most_positive, False: most_unlabelled}
    limit = {k: (1 << 40) if n.get(k, 0) <= most[k] else int(most[k] / n[k] * (1 << 40)) for k in most}
    rows = sorted(marked.filter(F.col("h") < F.when(F.col("toxic"), limit[True]).otherwise(limit[False])).collect(), key=lambda r: (r["h"], r["doc_id"], r["text"]))
    positive, unlabelled = ([r["text"] for r in rows if r["toxic"] == k][: most[k]] for k in (True, False))
    return train(positive, unlabelled, float(share))


def toxicity(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, 0 to 1: that of the most toxic segments. Null and empty texts score 0."""
    kind = dict(documents.dtypes)[key]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, memo = shared.value, WordHash()
        for b in batches:
            yield pd.DataFrame({key: b[key], "score": m.scores(b["text"].tolist(), memo)})

    return spread(documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))).mapInPandas(run, f"`{key}` {kind}, score double")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, read(spark, sf_dir, "review_labels"))).filter(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, read(spark, sf_dir, "review_labels"))).select("doc_id", F.round("score", 6).alias("score"))


def p9_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n_documents, n_toxic, rate), sources in lower case without outer blanks."""
    docs = read(spark, sf_dir, "documents")
    scored = toxicity(docs.select(F.struct("doc_id", F.lower(F.trim("source")).alias("source")).alias("k"), "text"), fit(docs, read(spark, sf_dir, "review_labels")), "k")
    return scored.groupBy(F.col("k.source").alias("source")).agg(F.count("*").alias("n_documents"), F.sum((F.col("score") >= THRESHOLD).cast("bigint")).alias("n_toxic")).withColumn("rate", F.round(F.col("n_toxic") / F.col("n_documents"), 6))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_source_rates": p9_source_rates}
SQL: dict = {}

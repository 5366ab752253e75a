"""Problem 5: the language of texts and of their segments, by character language models with interpolated Kneser-Ney smoothing."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import spread
from .common import bounded_sample, cut, read
from .pages import corpus_pages, residue

ORDER, DISCOUNT = 4, 0.75
#: Bits of one symbol in a packed n-gram; at most 2**BITS - 1 symbols, the rest count as unknown.
BITS = 8
#: Training text of a language is taken up to this number of characters (a bound for the fitted sample).
MOST_CHARS = 2_000_000
#: Held-out sentences set what a language accepts: their cross-entropy a character at quantile FIT, and as much again as that lies above the median.
#: A sentence is taken for a language whose calibrated probability is at least SURE.
FOLDS, FIT, SURE = 5, 0.99, 0.9
#: Lengths of the held-out fragments on which the temperature of the probabilities is fitted; whole sentences leave no error to learn from.
FRAGMENTS, TEMPERATURES = (8, 16, 32), (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0)
#: A sentence has at least this many words, or characters where words are not set apart.
LEAST_WORDS, LEAST_SIGNS = 5, 10
#: A line of a single sentence under this length (or number of signs where words are not set apart) is taken for a notice.
NOTE, NOTE_SIGNS = 90, 30
#: The probability that a run of sentences in another language than most of the text must have against that.
RUN_SURE = 1 - 1e-6
#: Characters scored at once, and the number of n-grams whose bits a process remembers before it begins anew.
CHUNK, REMEMBERED = 1 << 16, 1 << 21

# fixed values: notations of the languages besides the two-letter code
NAMES = {
    "en": "eng english anglais englisch inglés inglese inglês engels английский 英语 英文",
    "de": "deu ger german deutsch allemand alemán tedesco alemão duits немецкий 德语",
    "fr": "fra fre french français francais französisch francés francese francês frans французский 法语",
    "es": "spa spanish español espanol spanisch espagnol spagnolo espanhol spaans испанский 西班牙语 castellano",
    "it": "ita italian italiano italienisch italien italiaans итальянский 意大利语",
    "pt": "por portuguese português portugues portugiesisch portugais portugués portoghese portugees португальский 葡萄牙语",
    "nl": "nld dut dutch nederlands niederländisch néerlandais neerlandés olandese holandês нидерландский 荷兰语 flemish",
    "ru": "rus russian русский russisch russe ruso russo russisch 俄语",
    "zh": "zho chi cmn chinese 中文 汉语 chinesisch chinois chino cinese chinês chinees китайский",
}
UNKNOWN = frozenset("und unknown unk n/a na none null nan xx xxx zxx mul mis ? - unbekannt inconnu desconocido sconosciuto desconhecido onbekend неизвестно 未知".split())
_LABELS = {w: code for code, words in NAMES.items() for w in [code, *words.split()]}
# both forms behind one class of signs, which the search looks for first
_SENTENCE_END = re.compile(r"[.!?…。！？](?:(?<=[.!?…])[.!?…]*[\"'”’»)\]]*(?=\s|$)|(?<=[。！？])[。！？]*[”’」』）]*)")


def label_code(label: str | None) -> str | None:
    """The language that a label names in any notation, itself in lower case if unheard of; None if it is missing."""
    if label is None:
        return None
    s = label.strip().lower()
    if not s or s in UNKNOWN:
        return None
    return _LABELS.get(s) or _LABELS.get(re.split(r"[-_\s(;,]", s)[0]) or s


def _fold(ch: str) -> str:
    if ch.isdigit():
        return "0"
    if not ch.isalpha():
        return " "
    o = ord(ch)
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
        return "中"
    return ch


@dataclass
class Models:
    """One table for all languages: per order a sorted array of packed n-grams and, by row, what every language's model adds."""

    langs: list[str]
    symbols: dict[str, int]
    codes: np.ndarray
    keys: list[np.ndarray]
    adds: list[np.ndarray]
    backs: list[np.ndarray]
    base: np.ndarray
    #: bits a character that a text of each language may have, and the temperature of the probabilities
    most: np.ndarray | None = None
    temperature: float = 4.0
    tables: list[np.ndarray] | None = None

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.codes[np.minimum(points, len(self.codes) - 1)]

    def index(self) -> list[np.ndarray]:
        """Per order a table (row of the context, symbol) -> row, built from the sorted arrays once per process; the last row stands for none.

        full holds the interpolated probability of every n-gram of an order, so that only what was never seen backs off. What the models know of
        the symbols before a character is a state: the longest n-gram under ORDER that ends there and was seen. first has the least state of each length.
        """
        if self.tables is None:
            self.tables = [np.empty(0), np.arange(1 << BITS)]
            self.backs_ = [np.vstack([a, np.ones((1, a.shape[1]), np.float32)]) if a.ndim == 2 else a for a in self.backs]
            self.adds_ = [np.vstack([a, np.zeros((1, a.shape[1]), np.float32)]) if k > 1 else a for k, a in enumerate(self.adds)]
            self.full = [np.empty(0), self.base]
            for k in range(2, ORDER + 1):
                above, rows = self.keys[k - 1], self.keys[k]
                table = np.full((len(above) + 1, 1 << BITS), len(rows), np.int32)
                at = np.searchsorted(above, rows >> BITS)
                fits = above[np.minimum(at, len(above) - 1)] == rows >> BITS
                table[at[fits], (rows & ((1 << BITS) - 1))[fits]] = np.flatnonzero(fits)
                self.tables.append(table)
                # the probability that its last k - 1 symbols have, as if they stood alone
                low = np.searchsorted(above, rows & ((1 << (BITS * (k - 1))) - 1))
                context = np.where(fits, at, len(above))
                full = self.adds[k] + self.backs_[k][context] * self.full[k - 1][np.minimum(low, len(above) - 1)]
                self.full.append(np.vstack([full, np.ones((1, full.shape[1]), np.float32)]).astype(np.float32))
            self._states()
        return self.tables

    def _states(self) -> None:
        symbols, low = np.arange(1 << BITS), (1 << BITS) - 1
        self.first = np.cumsum([0, 1, *(len(self.keys[k]) for k in range(1, ORDER))])
        # per order k and state the row of its last k - 1 symbols, as far as it has them and they were seen
        self.contexts = [np.empty(0, np.int64)] * 2 + [np.full(self.first[-1], len(self.keys[k - 1])) for k in range(2, ORDER + 1)]
        #: (state of up to ORDER - 2 symbols, next symbol) -> state
        self.step = np.broadcast_to(1 + symbols, (self.first[ORDER - 1], 1 << BITS)).astype(np.int32)
        for k in range(1, ORDER):
            own = slice(self.first[k], self.first[k + 1])
            for j in range(1, k + 1):
                row = (self.keys[k] >> (BITS * (j - 1))) & low
                for i in range(2, j + 1):
                    row = self.tables[i][row, (self.keys[k] >> (BITS * (j - i))) & low]
                self.contexts[j + 1][own] = row
                if k < ORDER - 1:
                    to = self.tables[j + 1][row]
                    self.step[own] = np.where(to < len(self.keys[j + 1]), self.first[j + 1] + to, self.step[own])
        self.place = np.full(self.first[-1] << BITS, -1, np.int32)
        self.bits, self.known = np.empty((0, len(self.langs)), np.float32), 0

    def _remember(self, grams: np.ndarray) -> None:
        """Bits of (state, symbol), packed; what was seen of the longest context counts, the rest backs off."""
        state, symbol = grams >> BITS, grams & ((1 << BITS) - 1)
        p = self.full[1][symbol]
        for k in range(2, ORDER + 1):
            context = self.contexts[k][state]
            row = self.tables[k][context, symbol]
            p = np.where((row < len(self.keys[k]))[:, None], self.full[k][row], p * self.backs_[k][context])
        end = self.known + len(grams)
        if end > len(self.bits):
            self.bits = np.concatenate([self.bits[: self.known], np.empty((max(end, 4096), len(self.langs)), np.float32)])
        self.bits[self.known : end] = -np.log2(p)
        self.place[grams] = np.arange(self.known, end)
        self.known = end

    def score_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits of every character in every language, given the characters of its text before it, and a row of zeros at the end; start of each text)."""
        self.index()
        low = [t.lower() for t in texts]
        ends = np.cumsum([len(t) for t in low], dtype=np.int64)
        starts = np.concatenate([[0], ends])[:-1]
        s = self.encode("".join(low)).astype(np.int64)
        before = np.zeros(len(s), np.int64)
        x, heads = 1 + s, [(starts, 0)]
        for k in range(2, ORDER):
            at = starts[starts + k - 1 < ends]
            heads.append((at + k - 1, x[at]))
            x = self.step[x[:-1], s[k - 1 :]]
        before[ORDER - 1 :] = x[:-1]
        for at, state in heads:
            before[at] = state
        grams = (before << BITS) + s
        rows = self.place.take(grams)
        if len(new := grams[rows < 0]):
            if self.known > REMEMBERED:
                self.place.fill(-1)
                self.known, new = 0, grams
            self._remember(np.unique(new))
            rows = self.place.take(grams)
        out = np.zeros((len(s) + 1, len(self.langs)), np.float32)
        self.bits.take(rows, axis=0, out=out[:-1], mode="clip")
        return out, starts

    def score(self, text: str) -> np.ndarray:
        """Bits of every character in every language, given the characters before it."""
        return self.score_all([text])[0][:-1]


def train(samples: list[tuple[str, str]]) -> Models:
    """Models of the languages of (language, text), interpolated Kneser-Ney with one discount and a uniform base."""
    texts: dict[str, list[str]] = defaultdict(list)
    size: Counter = Counter()
    for lang, text in samples:
        code = label_code(lang)
        if code and text and size[code] < MOST_CHARS:
            texts[code].append(unicodedata.normalize("NFC", text).lower())
            size[code] += len(text)
    langs = sorted(texts)
    if not langs:
        raise ValueError("no labelled sample to train on")
    seen = Counter(c for t in texts.values() for x in t for c in map(_fold, x))
    symbols = {" ": 1, "0": 2, "中": 3}
    for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
        if c not in symbols and len(symbols) < (1 << BITS) - 2:
            symbols[c] = len(symbols) + 1
    codes = np.zeros(0x20000, np.uint8)
    for i in range(len(codes) - 1):
        if not 0xD800 <= i < 0xE000:
            codes[i] = symbols.get(_fold(chr(i)), 0)
    codes[-1] = symbols["中"]
    n_symbols = 1 << BITS
    grams: list[dict[str, Counter]] = [{} for _ in range(ORDER + 1)]
    for lang in langs:
        ids = [np.concatenate([[1], codes[np.minimum(np.frombuffer(t.encode("utf-32-le"), np.uint32), len(codes) - 1)], [1]]).astype(np.int64) for t in texts[lang]]
        for k in range(1, ORDER + 1):
            c: Counter = Counter()
            for s in ids:
                if len(s) >= k:
                    g = s[: len(s) - k + 1].copy()
                    for j in range(1, k):
                        g = (g << BITS) | s[j : len(s) - k + 1 + j]
                    c.update(g.tolist())
            grams[k][lang] = c
    # below the highest order, counts are the numbers of different characters before the n-gram
    counts: list[dict[str, Counter]] = [{} for _ in range(ORDER + 1)]
    for lang in langs:
        counts[ORDER][lang] = grams[ORDER][lang]
        for k in range(ORDER - 1, 0, -1):
            low: Counter = Counter()
            mask = (1 << (BITS * k)) - 1
            for g in grams[k + 1][lang]:
                low[g & mask] += 1
            counts[k][lang] = low
    base = np.full((n_symbols, len(langs)), 1.0 / n_symbols)
    for j, lang in enumerate(langs):
        total, kinds = sum(counts[1][lang].values()), len(counts[1][lang])
        base[:, j] *= DISCOUNT * kinds / total
        for g, n in counts[1][lang].items():
            base[g, j] += max(n - DISCOUNT, 0) / total
    keys: list[np.ndarray] = [np.empty(0, np.int64), np.arange(n_symbols, dtype=np.int64)]
    adds: list[np.ndarray] = [np.empty(0), base]
    backs: list[np.ndarray] = [np.empty(0), np.empty(0)]
    for k in range(2, ORDER + 1):
        rows = np.array(sorted({g for c in counts[k].values() for g in c}), np.int64)
        add = np.zeros((len(rows), len(langs)))
        back = np.ones((len(keys[k - 1]), len(langs)))
        for j, lang in enumerate(langs):
            total: Counter = Counter()
            kinds: Counter = Counter()
            for g, n in counts[k][lang].items():
                total[g >> BITS] += n
                kinds[g >> BITS] += 1
            for g, n in counts[k][lang].items():
                add[np.searchsorted(rows, g), j] = max(n - DISCOUNT, 0) / total[g >> BITS]
            for h, n in total.items():
                i = np.searchsorted(keys[k - 1], h)
                if i < len(keys[k - 1]) and keys[k - 1][i] == h:
                    back[i, j] = DISCOUNT * kinds[h] / n
        keys.append(rows)
        adds.append(add)
        backs.append(back)
    return Models(langs, symbols, codes, keys, [a.astype(np.float32) for a in adds], [b.astype(np.float32) for b in backs], base.astype(np.float32))


def probabilities(bits: np.ndarray, temperature: float) -> np.ndarray:
    """Calibrated probability of each language (last axis) from the bits that its model needs for a text."""
    z = -(bits - bits.min(axis=-1, keepdims=True)) * (np.log(2) / temperature)
    e = np.exp(z)
    return e / e.sum(axis=-1, keepdims=True)


def calibrated(samples: list[tuple[str, str]]) -> Models:
    """Models of all samples, with the limits of each language and the temperature that samples held out in FOLDS parts give.

    A language with too few samples for a held-out part gets the greatest limit of the others.
    """
    whole = train(samples)
    ordered = sorted((code, text) for lang, text in samples if (code := label_code(lang)) and text and text.strip())
    count: Counter = Counter()
    folds = []
    for code, _ in ordered:
        folds.append(count[code] % FOLDS)
        count[code] += 1
    cross: dict[str, list[float]] = defaultdict(list)
    parts: list[tuple[int, np.ndarray]] = []
    for k in range(FOLDS):
        rest = [x for x, f in zip(ordered, folds) if f != k]
        if not rest or len({c for c, _ in rest}) < len(whole.langs):
            continue
        models = train(rest)
        for (code, text), f in zip(ordered, folds):
            if f == k:
                bits = models.score(text)
                own = models.langs.index(code)
                cross[code].append(float(bits[:, own].mean()))
                for n in FRAGMENTS:
                    parts += [(own, bits[i : i + n].sum(axis=0)) for i in range(0, len(bits) - n + 1, n)]
    limits = {}
    for code, values in cross.items():
        high, mid = np.quantile(values, FIT), np.median(values)
        limits[code] = float(2 * high - mid)
    top = max(limits.values(), default=float(BITS))
    whole.most = np.array([limits.get(x, top) for x in whole.langs])
    if parts:
        own, bits = np.array([p for p, _ in parts]), np.array([b for _, b in parts])
        loss = {t: float(-np.log(np.maximum(probabilities(bits, t)[np.arange(len(own)), own], 1e-12)).mean()) for t in TEMPERATURES}
        whole.temperature = min(loss, key=lambda t: (loss[t], t))
    return whole


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, block) of the whole sentences: parts of a line that end with a sentence's sign.

    Lines that follow each other and hold whole sentences only, blank ones aside, form a block. Any other line ends it, and so does a short line of
    a single sentence, as notices and prompts are.
    """
    out, at, block = [], 0, 0
    for line in text.split("\n"):
        start, first = 0, len(out)
        for m in _SENTENCE_END.finditer(line):
            part = line[start : m.end()].strip()
            if len(part.split(None, LEAST_WORDS - 1)) >= LEAST_WORDS and "©" not in part or len(part) >= LEAST_SIGNS and part[-1] in "。！？”」":
                out.append((at + start, at + m.end(), block))
            start = m.end()
        if line[start:].strip():
            block += 1
        elif len(out) == first + 1 and len(line) < (NOTE_SIGNS if line.rstrip()[-1:] in "。！？”」" else NOTE):
            block += 1
            out[-1] = (*out[-1][:2], block)
            block += 1
        at += len(line) + 1
    return out


@dataclass
class Verdicts:
    """Languages of many texts: per text the number of its language (-1: blank) and the confidence; per segment its text, language, start, end, sentences and confidence."""

    language: np.ndarray
    confidence: np.ndarray
    text: np.ndarray
    lang: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentences: np.ndarray
    sure: np.ndarray


def verdicts(texts: list[str], models: Models) -> Verdicts:
    """The language of most of each text, and segments.

    Every whole sentence gets the language of the lowest cross-entropy per character; it is rejected where that is above what held-out sentences of the
    language have, or where the calibrated probability is low, and then takes no side. Runs of sentences in one language form the segments. A text without a whole sentence is judged as one piece.
    """
    n, n_langs = len(texts), len(models.langs)
    language, confidence = np.full(n, -1), np.zeros(n)
    cuts: list[tuple] = [(np.empty(0, np.int64), *np.empty((5, 0)))]
    number = [i for i, t in enumerate(texts) if t and not t.isspace()]
    # texts are scored together up to CHUNK characters, each text whole
    group = np.cumsum([len(texts[i]) for i in number]) // CHUNK
    for part in np.split(np.array(number, np.int64), np.flatnonzero(np.diff(group)) + 1):
        if not len(part):
            continue
        here = [texts[i] for i in part]
        spans = [sentences(t) for t in here]
        whole = np.array([bool(x) for x in spans])
        spans = [x or [(0, len(t), 0)] for x, t in zip(spans, here)]
        size = np.array([len(x) for x in spans])
        a, b, block = np.array([x for s in spans for x in s]).T
        of = np.repeat(np.arange(len(here)), size)
        head = np.cumsum(size) - size
        bits, starts = models.score_all(here)
        # sentences don't overlap: sums of the stretches from start to end, those between them left out
        edges = np.append(np.column_stack([a + starts[of], b + starts[of]]).ravel(), len(bits) - 1)
        sums = np.add.reduceat(bits, edges[:-1], axis=0)[::2].astype(np.float64)
        best = np.argmin(sums, axis=1)
        rows = np.arange(len(a))
        trust = probabilities(sums, models.temperature)[rows, best]
        most = np.full(n_langs, float(BITS)) if models.most is None else models.most
        ok = (sums[rows, best] / (b - a) <= most[best]) & (trust >= SURE)
        weight = np.bincount(of[ok] * n_langs + best[ok], (b - a)[ok], len(here) * n_langs).reshape(len(here), n_langs)
        some = weight.any(axis=1)
        total = probabilities(np.add.reduceat(sums, head, axis=0), models.temperature)
        main = np.where(some, np.argmax(weight, axis=1), np.argmax(total, axis=1))
        mine = probabilities(np.add.reduceat(np.where((ok & (best == main[of]))[:, None], sums, 0.0), head, axis=0), models.temperature)
        each = np.arange(len(here))
        share = weight[each, main] / np.maximum(weight.sum(axis=1), 1)
        language[part] = main
        confidence[part] = np.where(some, share * mine[each, main], 0.5 * total[each, main])
        idx = np.flatnonzero(ok & whole[of])
        if len(idx):
            new = np.append(True, (np.diff(of[idx]) != 0) | (np.diff(best[idx]) != 0) | (np.diff(block[idx]) != 0))
            at = np.flatnonzero(new)
            run, last = idx[at], idx[np.append(at[1:], len(idx)) - 1]
            own, main_of = best[run], main[of[run]]
            total = np.add.reduceat(sums[idx], at, axis=0)
            against = probabilities(np.column_stack([total[np.arange(len(at)), main_of], total[np.arange(len(at)), own]]), models.temperature)[:, 1]
            keep = (own == main_of) | (against >= RUN_SURE)
            sure = probabilities(total, models.temperature)[np.arange(len(at)), own]
            cuts.append(tuple(x[keep] for x in (part[of[run]], own, a[run], b[last], np.diff(np.append(at, len(idx))), sure)))
    text, *rest, sure = (np.concatenate(x) for x in zip(*cuts))
    return Verdicts(language, confidence, text, *(x.astype(np.int64) for x in rest), sure)


def identify_all(texts: list[str], models: Models) -> list[tuple[str | None, float, list[tuple[str, int, int, int, float]]]]:
    """(language of most of the text, confidence, segments (language, start, end, sentences, confidence)) of each text, see verdicts."""
    v = verdicts(texts, models)
    names = [*models.langs, None]
    out = [(names[k], round(c, 4), []) for k, c in zip(v.language.tolist(), v.confidence.tolist())]
    for i, lang, start, end, n, sure in zip(*(x.tolist() for x in (v.text, v.lang, v.start, v.end, v.sentences, v.sure))):
        out[i][2].append((names[lang], start, end, n, round(sure, 4)))
    return out


def identify(text: str, models: Models) -> tuple[str | None, float, list[tuple[str, int, int, int, float]]]:
    return identify_all([text], models)[0]


def fit(samples: DataFrame, lang: str = "lang", text: str = "text", most_rows: int = 20_000) -> Models:
    """Models from at most `most_rows` labelled rows (chosen by the hash of their text); a documented bound of the fitted sample."""
    rows = bounded_sample(samples.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(lang, text).distinct(), [text, lang], most_rows)
    return calibrated([(r[lang], r[text]) for r in sorted(rows, key=lambda r: (r[lang], r[text]))])


def languages(df: DataFrame, models: Models, key: str = "_id", text: str = "text") -> DataFrame:
    """(key, language, confidence, segments) of every row with a text; null texts and keys give no row, texts without letters a null language.

    segments: runs of consecutive whole sentences in one language, as (lang, start, end, sentences, confidence) with code point offsets.
    """
    kind = dict(df.dtypes)[key]
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            got = identify_all(b["text"].tolist(), m)
            yield pd.DataFrame({key: b[key], "language": [g[0] for g in got], "confidence": [g[1] for g in got], "segments": [[dict(zip(("lang", "start", "end", "sentences", "confidence"), s)) for s in g[2]] for g in got]})

    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")).filter(F.col(key).isNotNull() & F.col("text").isNotNull())
    return spread(rows).mapInPandas(run, f"`{key}` {kind}, language string, confidence double, segments array<struct<lang:string,start:int,end:int,sentences:int,confidence:double>>")


def label(lang: Column) -> Column:
    """label_code as a column expression."""
    s = F.lower(F.trim(lang))
    table = F.create_map(*(F.lit(x) for kv in sorted(_LABELS.items()) for x in kv))
    missing = lang.isNull() | (s == "") | s.isin(*sorted(UNKNOWN))
    return F.when(~missing, F.coalesce(table[s], table[F.split(s, r"[-_\s(;,]")[0]], s))


def relabelled(df: DataFrame, models: Models, key: str = "_id", text: str = "text", lang: str = "lang", least: int = 2) -> DataFrame:
    """(key, lang): for each text whose label is missing or names another language than most of the text, or that has `least` consecutive
    sentences in a second language, every language with such a run of sentences. A key that comes twice with differing labels is judged by each.
    """
    kind = dict(df.dtypes)[key]
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        number = {x: i for i, x in enumerate(m.langs)}
        for b in batches:
            v = verdicts(b["text"].tolist(), m)
            # a missing label is of no language, one that no model has of none of theirs
            was = np.array([number.get(x, -2) if isinstance(x, str) else -1 for x in b["was"]], np.int64)
            pairs = np.unique(np.column_stack([v.text, v.lang])[v.sentences >= least], axis=0)
            kinds = np.bincount(pairs[:, 0], minlength=len(b))
            wrong = (v.language >= 0) & ((was != v.language) | (kinds > 1))
            pairs = pairs[wrong[pairs[:, 0]]]
            yield pd.DataFrame({key: b["id"].to_numpy()[pairs[:, 0]], "lang": [m.langs[k] for k in pairs[:, 1]]})

    rows = df.select(F.col(f"`{key}`").alias("id"), label(F.col(f"`{lang}`")).alias("was"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return spread(rows).mapInPandas(run, f"`{key}` {kind}, lang string").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = read(spark, sf_dir, "corpus")
    found = relabelled(corpus, fit(read(spark, sf_dir, "lang_samples")))
    bad = cut(residue(corpus_pages(corpus)), "residue").select(F.col("page_key").alias("_id"))
    return found.join(bad, "_id", "left_anti")


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record and one per segment in another language, each with a confidence."""
    corpus = read(spark, sf_dir, "corpus")
    got = cut(languages(corpus.select("_id", "text").dropDuplicates(["_id"]), fit(read(spark, sf_dir, "lang_samples"))), "languages")
    whole = got.select("_id", F.lit("record").alias("unit"), F.lit(0).alias("start"), F.col("language").alias("lang"), "confidence")
    other = got.select("_id", "language", F.explode("segments").alias("s")).filter("s.lang <> language").select("_id", F.lit("segment").alias("unit"), F.col("s.start").alias("start"), F.col("s.lang").alias("lang"), F.col("s.confidence").alias("confidence"))
    return whole.unionByName(other)


QUERIES = {"p5_found": p5_found, "p5_languages": p5_languages}
SQL: dict = {}

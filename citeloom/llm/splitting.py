"""Problem 1: oversized texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

LIMIT, OVERLAP = 6000, 200
#: Strength of a boundary; the weakest pair is merged first.
CHAR, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[”’」』）]*")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"\n+")
_WORD = re.compile(r"\s+")


def _cuts(text: str, start: int, end: int, level: int, most: int) -> list[tuple[int, int]]:
    """(end offset, strength of the boundary there) of the atoms of text[start:end].

    An atom is a sentence; only one longer than `most` is taken apart into words, and only a longer word into runs of `most` characters.
    """
    if level == CHAR:
        return [(min(i + most, end), CHAR) for i in range(start, end, most)]
    pattern = {PARAGRAPH: _PARAGRAPH, LINE: _LINE, SENTENCE: _SENTENCE, WORD: _WORD}[level]
    out: list[tuple[int, int]] = []
    at = start
    for stop in [*(m.end() for m in pattern.finditer(text, start, end)), end]:
        if stop <= at:
            continue
        if level > SENTENCE or stop - at > most:
            out += _cuts(text, at, stop, level - 1, most)
        else:
            out.append((stop, level))
        out[-1] = (stop, level)
        at = stop
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, body start, end) of each piece; text[start:body] repeats the end of the piece before, the bodies tile the text.

    Agglomerative: adjacent segments wait in a heap, the pair with the weakest boundary (then the smallest sum) is merged
    while its size plus the overlap stays within the limit.
    """
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    overlap = max(0, min(overlap, limit - 1))
    most = limit - overlap
    cuts = _cuts(text, 0, n, PARAGRAPH, most)
    ends, strength = [c[0] for c in cuts], [c[1] for c in cuts]
    starts = [0, *ends[:-1]]
    right, left = list(range(1, len(cuts) + 1)), list(range(-1, len(cuts) - 1))
    alive = [True] * len(cuts)
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < len(cuts) and ends[j] - starts[i] <= most:
            heapq.heappush(heap, (strength[i], ends[j] - starts[i], i, j))

    for i in range(len(cuts)):
        offer(i)
    while heap:
        _, total, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or ends[j] - starts[i] != total:
            continue
        alive[j] = False
        ends[i], strength[i], right[i] = ends[j], strength[j], right[j]
        if right[j] < len(cuts):
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out = []
    for i in range(len(cuts)):
        if alive[i]:
            body = starts[i]
            begin = max(0, body - overlap)
            if 0 < begin < body:  # begin at a word if one begins within the overlap
                m = _WORD.search(text, begin - 1, body)
                if m and m.end() < body:
                    begin = m.end()
            out.append((begin, body, ends[i]))
    return out


def split_oversized(df: DataFrame, key: str = "_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, n_pieces, overlap_chars, piece) of every row with a text; rows whose key and text repeat count once.

    Null text gives no row, an empty text one empty piece. Texts within the limit never leave the JVM. A text longer than the
    limit gives at least two pieces of at most `limit` code points each; dropping the first overlap_chars of every piece and
    joining them gives back the text. Other columns of df are ignored.
    """
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)).filter(F.col(text).isNotNull())
    size: Column = F.length(text)
    kind = dict(rows.dtypes)[key]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                cut = split_text(t, limit, overlap)
                out += [(k, i, len(cut), body - start, t[start:end]) for i, (start, body, end) in enumerate(cut)]
            yield pd.DataFrame(out, columns=[key, "piece_no", "n_pieces", "overlap_chars", "piece"])

    schema = f"`{key}` {kind}, piece_no int, n_pieces int, overlap_chars int, piece string"
    # one row per key and text: repeated deliveries are dropped while rows are still whole texts, and only among long ones by shuffle
    long = rows.filter(size > limit).dropDuplicates([key, text]).mapInPandas(pieces, schema)
    short = rows.filter(size <= limit).dropDuplicates([key, text]).select(key, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("overlap_chars"), F.col(text).alias("piece"))
    return long.unionByName(short)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read(spark, sf_dir, "corpus")).filter("n_pieces > 1").select("_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read(spark, sf_dir, "corpus"))


def p1_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(_id, is_cut, within, digest): whether the text was cut, whether all pieces are within the limit, and the digest of what they give when joined without overlaps."""
    pieces = split_oversized(read(spark, sf_dir, "corpus"))
    own = F.struct("piece_no", F.expr("substring(piece, overlap_chars + 1)").alias("body"))
    each = pieces.groupBy("_id").agg(F.sort_array(F.collect_list(own)).alias("p"), F.max(F.length("piece")).alias("longest"), F.max("n_pieces").alias("n_pieces"))
    return each.select("_id", (F.col("n_pieces") > 1).alias("is_cut"), (F.col("longest") <= LIMIT).alias("within"), F.md5(F.array_join(F.transform("p", lambda x: x["body"]), "")).alias("digest"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_rebuilt": p1_rebuilt}
SQL = {
    "p1_found": "SELECT DISTINCT _id FROM corpus WHERE length(text) > 6000",
    "p1_rebuilt": "SELECT _id, max(length(text)) > 6000 AS is_cut, true AS within, md5(min(text)) AS digest FROM corpus WHERE text IS NOT NULL GROUP BY _id",
}

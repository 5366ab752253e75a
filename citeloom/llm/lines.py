"""Problem 2: lines repeated across the documents of one site."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import spread
from .common import cut, h64, read, signed, site

LEAST = 8
#: Counters of one heavy-hitter summary. A site gets so many summaries that none counts more than SHARE * COUNTERS lines.
COUNTERS, SHARE = 4096, 4
#: Counters that a task holds before it sends its summaries on; merging makes up for summaries sent in several parts.
HELD = 4_000_000
#: Confirmed lines up to this number are broadcast (8 bytes each); beyond it the lines to drop are joined by document.
BROADCAST = 2_000_000
_DIGITS = re.compile(r"[0-9]+")
_OTHER = re.compile(r"[^\w\n]+|_+")


def normalise(text: str) -> list[str]:
    """The lines of text in lower case, runs of digits as one sign, runs of other signs as one blank, outer blanks gone."""
    return [x.strip() for x in _OTHER.sub(" ", _DIGITS.sub("0", text.lower())).split("\n")]


def _keys(host: str, text: str) -> np.ndarray:
    """A 64-bit hash of site and line for each line of text, 0 for lines without letters or digits."""
    pre = host + "\0"
    return signed(np.array([h64(pre + x) or 1 if x else 0 for x in normalise(text)], np.uint64))


def line_keys(df: DataFrame, key: str = "_id", text: str = "text", host=None) -> DataFrame:
    """(key, site, keys): one 64-bit hash per line, 0 for lines without text; one row per key (the greatest where texts differ)."""
    rows = df.select(F.col(f"`{key}`").alias("id"), (site(F.col(f"`{key}`")) if host is None else host).alias("site"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = []
            for s, t in zip(b["site"], b["text"]):
                keys.append(_keys(s, t))
            yield pd.DataFrame({"id": b["id"], "site": b["site"], "keys": keys})

    return spread(rows).mapInPandas(run, f"id {kind}, site string, keys array<bigint>").groupBy("id").agg(F.max("site").alias("site"), F.max("keys").alias("keys"))


def shrink(keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries step: if there are more than `counters` keys, take the next largest count off all of them.

    Returns what is left and the error that this adds. Merging by adding counts and shrinking again keeps the bound:
    the true count of a key is at most its counter plus the sum of errors, and that sum is at most lines / (counters + 1).
    """
    if len(keys) <= counters:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
    keep = counts > off
    return keys[keep], counts[keep] - off, off


def added(keys, counts) -> tuple[np.ndarray, np.ndarray]:
    """The counters of several summaries added up."""
    all_keys, at = np.unique(np.concatenate([np.asarray(x, np.int64) for x in keys]), return_inverse=True)
    return all_keys, np.bincount(at, weights=np.concatenate([np.asarray(x, np.int64) for x in counts]), minlength=len(all_keys)).astype(np.int64)


def summaries(lines: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(site, shard, keys, counts, error): one merged heavy-hitter summary per site, several for a large site.

    The number of shards follows the lines of the site, so a hot site is spread and the error of any summary stays under
    SHARE + 1; each input partition sends summaries, never lines.
    """
    each = F.size(F.filter("keys", lambda k: k != 0))
    shards = lines.groupBy("site").agg(F.sum(each).alias("n")).select("site", F.ceil(F.col("n") / (SHARE * counters)).cast("int").alias("shards")).filter("shards > 1")
    rows = lines.select("site", "keys").join(shards, "site", "left").select("site", F.coalesce("shards", F.lit(1)).alias("shards"), "keys")

    schema = pa.schema([("site", pa.string()), ("shard", pa.int32()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("error", pa.int64())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, int]] = {}
        size = 0

        def sent() -> pa.RecordBatch:
            items = [(s, sh, k, n, e) for (s, sh), (k, n, e) in held.items()]
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*items)))), schema=schema)

        for b in batches:
            keys = b.column("keys")
            sizes = np.diff(keys.offsets.to_numpy())
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            first = pd.DataFrame({"doc": doc, "key": flat}).drop_duplicates()
            first = first[first.key != 0]
            names = b.column("site").to_numpy(zero_copy_only=False)
            by = pd.DataFrame({"site": names[first.doc], "shard": (first.key.to_numpy().view(np.uint64) % b.column("shards").to_numpy()[first.doc].astype(np.uint64)).astype(np.int32), "key": first.key.to_numpy()})
            got = by.groupby(["site", "shard", "key"], sort=True).size().reset_index(name="n")
            for (s, sh), g in got.groupby(["site", "shard"], sort=False):
                k, n, e = g.key.to_numpy(), g.n.to_numpy().astype(np.int64), 0
                if old := held.get((s, int(sh))):
                    size -= len(old[0])
                    k, n, e = *added([old[0], k], [old[1], n]), old[2]
                k, n, off = shrink(k, n, counters)
                held[s, int(sh)] = k, n, e + off
                size += len(k)
            if size > HELD:
                yield sent()
                held.clear()
                size = 0
        if held:
            yield sent()

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        keys, counts, off = shrink(*added(g["keys"], g["counts"]), counters)
        return pd.DataFrame({"site": [g["site"].iloc[0]], "shard": [g["shard"].iloc[0]], "keys": [keys], "counts": [counts], "error": [int(g["error"].sum()) + off]})

    kinds = "site string, shard int, keys array<bigint>, counts array<bigint>, error bigint"
    return rows.mapInArrow(local, kinds).groupBy("site", "shard").applyInPandas(merge, kinds)


def repeated_lines(df: DataFrame, least: int = LEAST, key: str = "_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(key, site, line_no, line_key, n_docs): every line that stands in at least `least` distinct documents of its site.

    Candidates are the lines whose counter plus error reaches `least` in the summary of their site; they are then counted exactly.
    Summaries whose error alone reaches it (possible only for `least` <= SHARE + 1) send all their lines to the exact count, so
    nothing is lost. Rows with a null key or text, and lines without letters or digits, never count; a line that stands twice in a document
    counts once for it, as does a document delivered twice; documents without a host form the site ''.
    """
    lines = cut(line_keys(df, key, text), "lines")
    tops = cut(summaries(lines, counters), "summaries")
    candidates = tops.filter(F.col("error") < least).select(F.explode(F.arrays_zip("keys", "counts")).alias("x"), "error").filter(F.col("x.counts") + F.col("error") >= least).select(F.col("x.keys").alias("line_key")).distinct()
    spread = lines.select("id", "site", F.posexplode("keys").alias("line_no", "line_key")).filter("line_key <> 0")
    found = spread.join(candidates, "line_key", "left_semi")
    lost = tops.filter(F.col("error") >= least).select("site").distinct()
    if lost.head(1):
        found = found.unionByName(spread.join(lost, "site", "left_semi")).distinct()
    found = cut(found, "candidates")
    confirmed = found.select("id", "site", "line_key").distinct().groupBy("site", "line_key").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least)
    return found.join(confirmed, ["site", "line_key"]).select(F.col("id").alias(key), "site", "line_no", "line_key", "n_docs")


def _without(text: str | None, host: str, gone: np.ndarray) -> tuple[str | None, int]:
    """text without the lines whose keys are in the sorted array gone, and their number."""
    if text is None or not len(gone):
        return text, 0
    own = text.split("\n")
    keys = _keys(host, text)
    known = gone[np.minimum(np.searchsorted(gone, keys), len(gone) - 1)] == keys
    return "\n".join(x for x, k in zip(own, known) if not k), int(known.sum())


def strip_repeated_lines(df: DataFrame, least: int = LEAST, key: str = "_id", text: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """(key, text, n_removed): each row of df without the lines repeated within its site; null texts stay null.

    Every row is treated alike, those with a null key (site '') or with a key that comes twice, too. The confirmed lines are a broadcast
    set while there are at most `broadcast` of them, else each text is joined with its own.
    """
    confirmed = cut(repeated_lines(df, least, key, text).select("line_key").distinct(), "repeated")
    rows = df.select(F.col(f"`{key}`").alias(key), site(F.col(f"`{key}`")).alias("site"), F.col(f"`{text}`").alias("text"))
    schema = f"`{key}` {dict(rows.dtypes)[key]}, text string, n_removed int"

    def result(b: pd.DataFrame, gone) -> pd.DataFrame:
        got = [_without(t, s, g) for t, s, g in zip(b["text"], b["site"], gone)]
        return pd.DataFrame({key: b[key], "text": [x[0] for x in got], "n_removed": [x[1] for x in got]})

    if confirmed.count() <= broadcast:
        shared = df.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in confirmed.toLocalIterator()], np.int64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield result(b, [shared.value] * len(b))

        return rows.mapInPandas(run, schema)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "keys": [np.unique(_keys(s, t)) for s, t in zip(b["site"], b["text"])]})

    # rows of equal site and text lose the same lines, so their hash names them
    named = rows.withColumn("name", F.when(F.col("text").isNotNull(), F.xxhash64("site", "text")))
    lines = named.filter("name IS NOT NULL").dropDuplicates(["name"]).select("name", "site", "text").mapInPandas(own, "name bigint, keys array<bigint>").select("name", F.explode("keys").alias("line_key"))
    gone = lines.join(confirmed, "line_key", "left_semi").groupBy("name").agg(F.sort_array(F.collect_list("line_key")).alias("gone"))

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield result(b, [np.empty(0, np.int64) if g is None else np.asarray(g, np.int64) for g in b["gone"]])

    return named.join(gone, "name", "left").select(key, "site", "text", "gone").mapInPandas(run_joined, schema)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(read(spark, sf_dir, "corpus")).select("_id", F.col("line_no").cast("int").alias("line_no"))


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeated_lines(read(spark, sf_dir, "corpus"))


_OFTEN = r"""
docs AS (SELECT _id, min(text) AS text FROM corpus WHERE text IS NOT NULL AND _id IS NOT NULL GROUP BY _id),
lines AS (SELECT _id, regexp_replace(regexp_extract(lower(_id), '^\s*[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#\s]+)', 1), '^(www|m)\.', '') AS site,
  unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM docs),
keyed AS (SELECT _id, site, line, CAST(line_no AS INTEGER) AS line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS k FROM lines),
often AS (SELECT site, k FROM keyed WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT _id) >= 8)"""

QUERIES = {"p2_found": p2_found, "p2_cleaned": p2_cleaned}
SQL = {
    "p2_found": f"WITH {_OFTEN} SELECT _id, line_no FROM keyed JOIN often USING (site, k)",
    "p2_cleaned": f"""WITH {_OFTEN},
kept AS (SELECT _id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (often.k IS NULL), '') AS text, CAST(count(often.k) AS INTEGER) AS n_removed FROM keyed LEFT JOIN often USING (site, k) GROUP BY _id)
SELECT c._id, kept.text, coalesce(n_removed, 0) AS n_removed FROM corpus c LEFT JOIN kept USING (_id)""",
}

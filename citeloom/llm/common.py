"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_scratch: list[str] = []
_paths: dict[int, list[str]] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir. Where that is unset a temporary one serves a local session; on a cluster it raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _scratch:
        _scratch.append(tempfile.mkdtemp(prefix="citeloom-"))
        atexit.register(shutil.rmtree, _scratch[0], True)
    return f"file://{_scratch[0]}"


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: one computation, compressed, columns prunable, safe when executors go.

    release() removes what this process wrote.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/citeloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.setdefault(id(spark.sparkContext), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def written(spark: SparkSession) -> list[str]:
    """Paths that cut() has written in this session and that were not deleted, oldest first."""
    return _paths.setdefault(id(spark.sparkContext), [])


def release(spark: SparkSession) -> None:
    """Delete the tables that cut() wrote; call it once results that read them have been stored."""
    drop(spark, _paths.pop(id(spark.sparkContext), []))


def site(url: Column) -> Column:
    """Host in lower case without user, port and a leading www. or m.; '' where there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#\s]+)", 1)
    return F.regexp_replace(host, r"^(?:www|m)\.", "")


def h64(data: bytes | str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


class WordHash(dict):
    """Word -> 64-bit hash, remembered; emptied when it grows beyond a bound."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, vectorised."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[str], k: int, memo: WordHash) -> np.ndarray:
    """Distinct hashes of the runs of k consecutive words; empty where there are fewer than k."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    w = np.fromiter((memo[x] for x in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h * MULT[i % 5] + w[i : i + n] + np.uint64(i))
    return np.unique(h)


def bounded_sample(df: DataFrame, by: list[str], most: int) -> list:
    """Rows of df, all where there are at most `most`, else about `most` of them by the hash of columns `by`; never more reach the driver.

    The rows are filtered where they are, so no task sends more than its share (an ordered limit would send `most` rows of every task).
    """
    return sample_of(df, by, most, df.count())


def sample_of(df: DataFrame, by: list[str], most: int, n: int) -> list:
    """bounded_sample where the number n of rows is known."""
    h = F.pmod(F.xxhash64(*by), F.lit(1 << 40))
    kept = df.withColumn("_h", h) if n <= most else df.withColumn("_h", h).filter(F.col("_h") < int(most / n * (1 << 40)))
    return sorted(kept.collect(), key=lambda r: (r["_h"], *(str(r[c]) for c in by)))[:most]

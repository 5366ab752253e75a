"""Incremental forms: crawled pages as a stream of files, and per-domain slots with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

URL_CONTENT = "crawl_id bigint, title string, url string, accessible boolean, url_content string, error string, published_date string, lang string, crawled_at timestamp"


def page_stream(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """The files of a folder as they arrive, `files` at a time."""
    return spark.readStream.schema(URL_CONTENT).option("maxFilesPerTrigger", files).parquet(folder)


def once(pages: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Rows delivered twice within the watermark count once."""
    return pages.withWatermark("crawled_at", delay).dropDuplicatesWithinWatermark(["crawl_id"])


def hourly(pages: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Crawls and usable pages per hour and language; late rows count up to the watermark."""
    usable = (F.col("accessible") & (F.col("url_content") != "")).cast("bigint")
    windowed = once(pages, delay).groupBy(F.window("crawled_at", "1 hour"), "lang")
    return windowed.agg(F.count("*").alias("n"), F.sum(F.coalesce(usable, F.lit(0))).alias("n_usable"))


def slots(requests: DataFrame, spacing: float = 6.0) -> DataFrame:
    """RATE-1 with state: (domain, id, slot) for requests (domain, id, arrival in seconds); the next free slot of a domain outlives its batch."""

    def assign(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(parts)).sort_values(["arrival", "id"])
        out = []
        for i, a in zip(rows["id"], rows["arrival"]):
            at = max(a, free)
            free = at + spacing
            out.append((key[0], i, at))
        state.update((free,))
        yield pd.DataFrame(out, columns=["domain", "id", "slot"])

    return requests.groupBy("domain").applyInPandasWithState(assign, "domain string, id bigint, slot double", "free double", "append", GroupStateTimeout.NoTimeout)

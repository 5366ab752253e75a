"""Problem 7: items of varying length packed into containers of fixed capacity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parallel import spread
from .common import cut, read
from .tokens import n_tokens

CAPACITY = 2048


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum comes closest to room from below; of equal sums one with long items.

    Bitset subset-sum: a big integer holds the reachable sums, every length joins in powers of two of its count; the
    states before each step are kept to walk back to the counts taken. Stops as soon as the window can be filled.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
            if reach >> room:
                break
        if reach >> room:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not (before >> total) & 1:
            out[length] = out.get(length, 0) + take
            total -= length * take
    return out


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths with counts, number of containers filled so) by minimum bin slack.

    Each window opens with the longest length left, the best fill of the rest is searched, and the pattern found is used as
    often as the counts allow. Works on at most `capacity` distinct lengths, so its cost follows those and not the items.
    """
    counts = {x: n for x, n in histogram.items() if n > 0}
    out = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        got = best_fill(counts, capacity - first)
        counts[first] += 1
        got[first] = got.get(first, 0) + 1
        times = min(counts[x] // n for x, n in got.items())
        out.append((got, times))
        for x, n in got.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return out


def numbered(items: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A column `rank` that numbers the rows of each `by` from 0, in the order of `order` only within 256 salted parts, so that no group is one task."""
    salt = F.pmod(F.xxhash64(*order), F.lit(256)).cast("int")
    rows = items.withColumn("_salt", salt)
    sizes = rows.groupBy(*by, "_salt").agg(F.count("*").alias("_n"))
    before = sizes.select(*by, "_salt", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_salt")) - F.col("_n")).alias("_before"))
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order)) - 1)
    return local.join(before, [*by, "_salt"]).withColumn("rank", (F.col("_r") + F.col("_before")).cast("bigint")).drop("_salt", "_r", "_before")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, size: str | None = None) -> DataFrame:
    """(key, piece_no, n_tokens, container): a container for every row of df, sizes in tokens (or from the column `size`).

    Only an item above the capacity is split, into full pieces, each a container of its own, and a rest that is packed like
    an item. Null and empty texts have 0 tokens and go to container 0. A key that occurs more than once is packed once,
    by its greatest size, and so are all rows with a null key together. The driver sees a histogram of at most
    `capacity` lengths; items are matched to the plan by length and rank.
    """
    amount = n_tokens(F.col(f"`{text}`"), tokenizer) if size is None else F.greatest(F.coalesce(F.col(f"`{size}`").cast("int"), F.lit(0)), F.lit(0))
    items = cut((df if size else spread(df)).select(F.col(f"`{key}`").alias("k"), amount.alias("total")).groupBy("k").agg(F.max("total").alias("total")), "sizes")
    full = F.floor(F.col("total") / capacity).cast("int")
    rest = F.col("total") % capacity
    hist = {int(r["rest"]): int(r["n"]) for r in items.select(rest.alias("rest")).filter("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    plan, at = [], 0
    used: dict[int, int] = {}
    for got, times in patterns(hist, capacity):
        for length, n in got.items():
            lo = used.get(length, 0)
            plan.append((length, lo, lo + n * times, n, at))
            used[length] = lo + n * times
        at += times
    spark = df.sparkSession
    steps = spark.createDataFrame(pd.DataFrame(plan or [(0, 0, 0, 1, 0)], columns=["rest", "lo", "hi", "per", "first"]).astype(np.int64), "rest bigint, lo bigint, hi bigint, per bigint, first bigint")
    by_rest = steps.groupBy("rest").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "per", "first"))).alias("steps"))
    rests = numbered(items.select("k", rest.cast("bigint").alias("rest"), full.alias("piece_no")).filter("rest > 0"), ["rest"], ["k"])
    # at most `capacity` rows of intervals: a proven bound for the broadcast
    placed = rests.join(F.broadcast(by_rest), "rest").withColumn("s", F.element_at(F.filter("steps", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"])), 1))
    packed = placed.select("k", "piece_no", F.col("rest").cast("int").alias("n_tokens"), (F.col("s.first") + F.floor((F.col("rank") - F.col("s.lo")) / F.col("s.per"))).cast("bigint").alias("container"))
    empty = items.filter("total = 0").select("k", F.lit(0).alias("piece_no"), F.lit(0).alias("n_tokens"), F.lit(0).cast("bigint").alias("container"))
    wide = items.select("k", full.alias("full")).filter("full > 0")
    pieces = numbered(wide.select("k", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece_no")).withColumn("g", F.lit(0)), ["g"], ["k", "piece_no"])
    whole = pieces.select("k", "piece_no", F.lit(capacity).alias("n_tokens"), (F.col("rank") + at).cast("bigint").alias("container"))
    return packed.unionByName(empty).unionByName(whole).withColumnRenamed("k", key)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, placed): for every document whether its pieces are whole: numbered from 0, none but the last under the capacity, in containers within the capacity."""
    packed = cut(pack(read(spark, sf_dir, "documents")), "packed")
    fill = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    over = packed.join(fill.filter(F.col("fill") > CAPACITY), "container").select("doc_id").distinct().withColumn("over", F.lit(True))
    each = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("piece_no").alias("last"), F.sum((F.col("n_tokens") < CAPACITY).cast("int")).alias("parts"))
    ok = (F.col("n") == F.col("last") + 1) & (F.col("parts") <= 1) & F.col("over").isNull()
    return each.join(over, "doc_id", "left").select("doc_id", ok.alias("placed"))


def p7_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, tokens, the least number possible and the share of space left unused."""
    each = pack(read(spark, sf_dir, "documents")).groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return each.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.ceil(F.sum("t") / CAPACITY).alias("least"), F.max("t").alias("fullest"), F.round(1 - F.sum("t") / (F.count("*") * CAPACITY), 6).alias("unused"))


QUERIES = {"p7_containers": p7_containers, "p7_fill_report": p7_fill_report, "p7_checked": p7_checked}
SQL = {"p7_checked": "SELECT DISTINCT doc_id, true AS placed FROM documents"}

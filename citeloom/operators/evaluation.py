"""Verdicts, slices and reports of question answering runs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assembly import earliest_year, multilingual

LABELS = ("CORRECT", "INCORRECT", "NOT_ATTEMPTED")


def predicate(key: str, value) -> Column:
    """FLT-13: the condition that a slice of attributes sets; unknown keys raise."""
    if key in ("num_keypoints", "num_hops", "false_premise"):
        return F.coalesce(F.col(key) == F.lit(value), F.lit(False))
    if key == "language":
        m = multilingual(F.col("langs"))
        return m if value == "multilingual" else ~m
    if key == "freshness":
        return F.coalesce(earliest_year(F.col("published_dates")) == int(value), F.lit(False))
    if key == "topic":
        return F.coalesce(F.exists("topics", lambda t: t.contains(value)), F.lit(False))
    raise ValueError(f"unknown slice key {key}")


def slice_condition(conditions: Mapping) -> Column:
    """FLT-14: all conditions of a slice."""
    return reduce(lambda a, b: a & b, (predicate(k, v) for k, v in conditions.items()), F.lit(True))


def slice_name(conditions: Mapping) -> str:
    """STR-32"""
    return "_".join(f"{k}-{v}" for k, v in conditions.items())


def verdict_fractions(judgements: DataFrame, keys: list[str] = ["query_id"]) -> DataFrame:  # noqa: B006
    """AGG-5: the share of each label among a query's judgements."""
    share = lambda label: (F.count_if(F.col("label") == label) / F.count("label")).alias(label.lower())
    return judgements.filter("label IS NOT NULL").groupBy(*keys).agg(*map(share, LABELS))


def run_mean(fractions: DataFrame, queries: DataFrame) -> DataFrame:
    """AGG-6: means over all queries, a missing one counting 0."""
    joined = queries.select("query_id").distinct().join(fractions, "query_id", "left")
    return joined.agg(*(F.round(F.avg(F.coalesce(F.col(c), F.lit(0.0))), 5).alias(c) for c in ("correct", "incorrect", "not_attempted")))


def slice_report(scored: DataFrame, slices: list[Mapping], compat_tokens: bool = False) -> DataFrame:
    """AGG-7, AGG-8: (split, support, avg_reasoning_tokens, correct, incorrect, not_attempted, truthfulness) of 'general' and of each slice.

    scored has the attributes and correct, incorrect, not_attempted, reasoning_tokens. One pass: each row is exploded into its slices.
    A slice without rows is reported with support 0 and nulls. compat_tokens averages the general tokens over the rows of all slices together.
    """
    names = F.array_compact(F.array(F.lit("general"), *(F.when(slice_condition(s), slice_name(s)) for s in slices)))
    rows = scored.withColumn("split", F.explode(names))
    mean = lambda c, p=3: F.round(F.avg(c), p).alias(c)
    got = rows.groupBy("split").agg(F.count("*").alias("support"), F.round(F.avg("reasoning_tokens"), 3).alias("avg_reasoning_tokens"), mean("correct"), mean("incorrect"), mean("not_attempted"), F.round(F.avg("correct") - F.avg("incorrect"), 3).alias("truthfulness"))
    if compat_tokens:
        general = rows.filter("split <> 'general'").agg(F.round(F.avg("reasoning_tokens"), 3).alias("t"))
        got = got.crossJoin(F.broadcast(general)).withColumn("avg_reasoning_tokens", F.when(F.col("split") == "general", F.col("t")).otherwise(F.col("avg_reasoning_tokens"))).drop("t")
    every = scored.sparkSession.createDataFrame([("general",), *((slice_name(s),) for s in slices)], "split string")
    return every.join(got, "split", "left").withColumn("support", F.coalesce("support", F.lit(0)).cast("bigint"))


def retrieval_report(per_query: DataFrame, attrs: DataFrame, slices: list[Mapping], k: int) -> DataFrame:
    """AGG-9: mean ndcg and recall at k of each slice."""
    names = F.array_compact(F.array(F.lit("general"), *(F.when(slice_condition(s), slice_name(s)) for s in slices)))
    rows = per_query.filter(F.col("k") == k).join(attrs.withColumnRenamed("_id", "query_id"), "query_id").withColumn("split", F.explode(names))
    return rows.groupBy("split").agg(F.count("*").alias("support"), F.round(F.avg("ndcg"), 3).alias("ndcg"), F.round(F.avg("recall"), 3).alias("recall"))


def closed_book_ok(correct: Column) -> Column:
    """FLT-20"""
    return F.coalesce(correct, F.lit(0.0)) >= 0.999


def interplay(outcomes: DataFrame, closed_book: DataFrame) -> DataFrame:
    """JOIN-15: (cell, n) of redundant, augmentation, resilience and hopeless queries, by whether retrieval and the closed book suffice."""
    rows = outcomes.join(closed_book, "query_id")
    r, c = F.col("outcome") == "correct", closed_book_ok(F.col("correct"))
    cell = F.when(r & c, "redundant").when(r & ~c, "augmentation").when(~r & c, "resilience").otherwise("hopeless")
    return rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


def transition_matrix(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-17: (before, CORRECT, INCORRECT, NOT_ATTEMPTED): shares of all queries by label before and after."""
    rows = before.select("query_id", F.col("label").alias("before")).join(after.select("query_id", F.col("label").alias("after")), "query_id")
    total = rows.agg(F.count("*").alias("total"))
    cells = rows.groupBy("before").pivot("after", list(LABELS)).agg(F.count("query_id"))
    return cells.crossJoin(F.broadcast(total)).select("before", *(F.round(F.coalesce(F.col(x), F.lit(0)) / F.col("total"), 6).alias(x.lower()) for x in LABELS))


def fixed_facts(before: DataFrame, after: DataFrame) -> DataFrame:
    """JOIN-16: rows whose label was 0 and has become 1."""
    return after.filter("score = 1").join(before.filter("score = 0").select("id"), "id", "left_semi")


def result_pivot(results: DataFrame, splits: list[str]) -> DataFrame:
    """AGG-18: one row per model, one column per split, values in per cent with one decimal."""
    out = results.groupBy("model").pivot("split", splits).agg(F.first("value"))
    return out.select("model", *(F.round(F.col(s) * 100, 1).alias(s) for s in splits))


def positive_rate(labels: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-16"""
    return labels.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("rate"))


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """AGG-14: (stage, n)"""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def yield_ratio(good: DataFrame, facts: DataFrame) -> DataFrame:
    """AGG-21: the mean number of good facts of a page over the mean number of its facts."""
    mean = lambda df, c: df.groupBy("title").count().agg(F.avg("count").alias(c))
    return mean(good, "g").crossJoin(mean(facts, "f")).select(F.round(F.col("g") / F.col("f"), 6).alias("ratio"))

"""Assembly of queries, answers, qrels and attributes, and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import parse_query_id, query_id


def two_hop_qrels(qrels: DataFrame, questions: DataFrame) -> DataFrame:
    """JOIN-6, SET-7: (query_id, corpus_id, score) of the 1-hop queries, of 2-hop questions (title, fact, aux_title, aux_fact) as the union
    of both 1-hop sets, and of the false-premise copies under '~'. A missing 1-hop set counts as empty.
    """
    one = qrels.select("query_id", "corpus_id", "score").distinct()
    own = F.lit(False)
    ids = questions.select(query_id(F.col("title"), F.col("fact"), F.lit(2), own).alias("query_id"), F.explode(F.array(query_id(F.col("title"), F.col("fact"), F.lit(1), own), query_id(F.col("aux_title"), F.col("aux_fact"), F.lit(1), own))).alias("part"))
    two = ids.join(one.withColumnRenamed("query_id", "part"), "part").select("query_id", "corpus_id", "score").distinct()
    plain = one.unionByName(two)
    return plain.unionByName(plain.select(F.concat(F.lit("~"), "query_id").alias("query_id"), "corpus_id", "score")).distinct()


def mirrored(ids: DataFrame, column: str) -> DataFrame:
    """SET-7: every row and its copy under '~'."""
    return ids.unionByName(ids.withColumn(column, F.concat(F.lit("~"), F.col(column))))


def evidence(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """JOIN-7: (query_id, langs, published_dates): sorted arrays of the known languages and dates of the query's documents."""
    docs = corpus.groupBy("_id").agg(F.max("lang").alias("lang"), F.max("published_date").alias("published_date"))
    pairs = qrels.select("query_id", F.col("corpus_id").alias("_id")).distinct().join(docs, "_id")
    return pairs.groupBy("query_id").agg(F.sort_array(F.collect_list("lang")).alias("langs"), F.sort_array(F.collect_list("published_date")).alias("published_dates"))


def attributes(queries: DataFrame, pages: DataFrame, evidence_: DataFrame) -> DataFrame:
    """JOIN-8: (_id, num_hops, false_premise, topics, wiki_create_timestamp, langs, published_dates)."""
    parsed = queries.select("_id", parse_query_id(F.col("_id")).alias("p"))
    rows = parsed.select("_id", F.col("p.title").alias("title"), F.col("p.hops").alias("num_hops"), F.col("p.false_premise").alias("false_premise"), F.regexp_replace("_id", "^~", "").alias("query_id"))
    return rows.join(pages.select("title", "topics", F.col("create_timestamp").alias("wiki_create_timestamp")), "title", "left").join(evidence_, "query_id", "left").drop("title", "query_id")


def earliest_year(dates: Column) -> Column:
    """WIN-10: the least year of an array of ISO dates; null without any."""
    return F.array_min(F.filter(F.transform(F.coalesce(dates, F.array().cast("array<string>")), lambda d: F.substring(d, 1, 4).try_cast("int")), lambda y: y.isNotNull()))


def multilingual(langs: Column) -> Column:
    return F.coalesce(F.exists(langs, lambda c: ~F.lower(c).startswith("en")), F.lit(False))


def bins(attrs: DataFrame) -> DataFrame:
    """AGG-10: (_id, bin), bin = year__hops__topic__multilingual__fp, one row per distinct top-level topic; the year also looks at the page's creation."""
    year = F.least(earliest_year(F.col("published_dates")), F.substring("wiki_create_timestamp", 1, 4).try_cast("int"))
    top = F.array_distinct(F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.split(t, r"\.")[0]))
    rows = attrs.select("_id", year.alias("year"), "num_hops", multilingual(F.col("langs")).alias("m"), "false_premise", F.explode_outer(top).alias("topic"))
    text = lambda c, none="none": F.coalesce(F.col(c).cast("string"), F.lit(none))
    return rows.select("_id", F.concat_ws("__", text("year"), text("num_hops"), text("topic"), text("m"), text("false_premise")).alias("bin"))


def stratified_order(binned: DataFrame, seed: str = "42") -> DataFrame:
    """LIM-6: (_id, seq): every id once, in the order in which a round robin over the bins takes it; within a bin by md5(seed + id)."""
    w = Window.partitionBy("bin").orderBy(F.md5(F.concat(F.lit(seed), "_id")), "_id")
    first = binned.distinct().withColumn("round", F.row_number().over(w)).groupBy("_id").agg(F.min(F.struct("round", "bin")).alias("p"))
    return first.select("_id", F.col("p.round").cast("bigint").alias("round"), F.col("p.bin").alias("bin"))


def stratified_sample(binned: DataFrame, n: int, false_premise_limit: int, seed: str = "42") -> DataFrame:
    """LIM-6, JOIN-13: about n ids by round robin; at most false_premise_limit with '~'; a plain 2-hop brings its 1-hop twin and is left out without one.

    Only the order's first rounds can matter, so at most n rounds of each bin are walked; fewer ids than n give all that qualify.
    """
    order = stratified_order(binned, seed)
    hops = F.substring_index("_id", "--", -1)
    twin = F.concat(F.substring_index("_id", "--", 2), F.lit("--1"))
    fp = F.col("_id").startswith("~")
    known = order.select(F.col("_id").alias("twin"))
    plain2 = (hops == "2") & ~fp
    rows = order.withColumn("twin", F.when(plain2, twin)).join(known.withColumn("has", F.lit(True)), "twin", "left").filter(~plain2 | F.col("has"))
    rounds = rows.filter(F.col("round") <= n).withColumn("is_fp", fp)
    w = Window.orderBy("round", "bin", "_id")
    capped = rounds.filter("is_fp").orderBy("round", "bin", "_id").limit(false_premise_limit).unionByName(rounds.filter("NOT is_fp"))
    taken = capped.orderBy("round", "bin", "_id").limit(n).withColumn("pos", F.row_number().over(w))
    brought = taken.select("_id", "pos").unionByName(taken.filter("twin IS NOT NULL").select(F.col("twin").alias("_id"), "pos"))
    first = brought.groupBy("_id").agg(F.min("pos").alias("pos"))
    size = first.groupBy("pos").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    return first.join(size, "pos").filter(F.coalesce("before", F.lit(0)) < n).select("_id")


def hashed_sample(df: DataFrame, key: str, n: int, seed: str = "42", by: str | None = None) -> DataFrame:
    """LIM-7, LIM-8: n rows (of each group) with the least md5(seed + key)."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    if by is None:
        return df.orderBy(h, key).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(h, key))).filter(F.col("_r") <= n).drop("_r")


def shards(df: DataFrame, key: str, n: int) -> DataFrame:
    """LIM-10: a column `shard` from 0: n runs of keys of nearly equal size, the first ones longer by one. Ranks come from range partitions, not from one task."""
    from pyspark.sql import functions as F

    total = df.count()
    ranked = df.repartitionByRange(max(1, df.sparkSession.sparkContext.defaultParallelism), key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    sizes = ranked.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    i = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    rank = ranked.withColumn("_i", i).join(F.broadcast(sizes), "_p").withColumn("_rank", F.col("_i") + F.col("_before"))
    small, extra = total // n, total % n
    edge = extra * (small + 1)
    return rank.withColumn("shard", F.when(F.col("_rank") < edge, F.floor(F.col("_rank") / (small + 1))).otherwise(extra + F.floor((F.col("_rank") - edge) / max(1, small))).cast("int")).drop("_p", "_n", "_before", "_i", "_rank")


def violations(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """FLT-21: (check_name, n_violations) of the rules that a finished benchmark keeps."""
    rows = [
        ("duplicate query ids", queries.groupBy("_id").count().filter("count > 1")),
        ("queries without qrels", queries.filter("NOT startswith(_id, '~')").join(qrels.select(F.col("query_id").alias("_id")), "_id", "left_anti")),
        ("qrels without document", qrels.select(F.col("corpus_id").alias("_id")).distinct().join(corpus.select("_id"), "_id", "left_anti")),
        ("malformed query ids", queries.filter(~F.col("_id").rlike(r"^~?.+--\d+--\d+$"))),
    ]
    out = None
    for name, bad in rows:
        one = bad.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check_name"), "n_violations")
        out = one if out is None else out.unionByName(one)
    return out

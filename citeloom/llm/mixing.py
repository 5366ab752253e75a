"""Problem 8: sources mixed to target shares of all tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read
from .tokens import n_tokens

#: Tokens of a block, and slots whose order is taken in one window: a source's slots are ranked within runs of so many, then over the runs.
BLOCK, RUN = 256, 1 << 18
GOLDEN = 0.6180339887498949


def name(source: Column) -> Column:
    return F.lower(F.trim(source))


def golden_point(t: Column) -> Column:
    """Fractional part of t times the golden ratio; taking 20 bits at a time keeps 2**-32 precision up to t = 2**40."""
    high, low = F.floor(t / (1 << 20)), F.pmod(t, F.lit(1 << 20))
    return F.pmod(high * F.lit((GOLDEN * (1 << 20)) % 1.0) + low * F.lit(GOLDEN), F.lit(1.0))


def running_tokens(rows: DataFrame) -> DataFrame:
    """A column `start`, the tokens of the source before the row in (repeat_no, hash) order, summed in 256 hash ranges per source and repeat."""
    part = F.shiftrightunsigned("hash", 56).cast("int")
    parted = rows.withColumn("part", part)
    sums = parted.groupBy("source", "repeat_no", "part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("source", "repeat_no", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("repeat_no", "part")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("source", "repeat_no", "part").orderBy("hash", "doc").rowsBetween(Window.unboundedPreceding, -1)
    return parted.withColumn("own", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(before, ["source", "repeat_no", "part"]).withColumn("start", F.col("own") + F.col("before")).drop("own", "before", "part")


def slot_ranks(schedule: DataFrame, run: int = RUN) -> DataFrame:
    """schedule (slot, source) with `rank`, the number of earlier slots of the same source: ranks within runs of slots plus the sizes of the runs before."""
    rows = schedule.withColumn("run", F.floor(F.col("slot") / run))
    sizes = rows.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = sizes.select("source", "run", (F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n")).alias("before"))
    inner = rows.withColumn("r", F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1)
    return inner.join(before, ["source", "run"]).select("slot", "source", (F.col("r") + F.col("before")).cast("bigint").alias("rank"))


def _wanted(targets: DataFrame) -> DataFrame:
    """(source, share, most): each usable target once."""
    rows = targets.select(name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most"))
    return rows.filter("source IS NOT NULL AND share > 0 AND most > 0").groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most"))


def mix_sources(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, total_tokens: int | None = None, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(key, source, repeat_no, n_tokens, slot): the documents used, once per use, and their place in the mixed order.

    Golden-ratio points through the cumulative shares give every slot a source; the k-th slot of a source takes its k-th block
    of `block` tokens, blocks being runs of its documents in shuffled order, all of them once before any is repeated.
    A document belongs to the block that holds its middle, so a source is off by half a document at most.

    total_tokens is the budget; None: as many tokens as the documents of all target sources have. A source that is short of its share of
    it gives all it has max_repeats times and leaves the rest of its slots empty, which shares() reports; the others keep their share.
    Sources compare in lower case without outer blanks. Targets that occur twice count once (greatest share and repeats); null,
    zero or negative shares and repeats, and null sources, contribute nothing; shares are taken relative to their sum. Documents with null
    or empty text or a null key are left out. A key that occurs twice in a source is one document. No target or no document gives no row.
    """
    spark = df.sparkSession
    wanted = _wanted(targets)
    docs = df.select(F.col(f"`{key}`").alias("doc"), name(F.col(f"`{source}`")).alias("source"), F.col(f"`{text}`").alias("t")).filter("doc IS NOT NULL AND t <> ''")
    sized = cut(docs.join(wanted.select("source", "most"), "source").select("doc", "source", "most", n_tokens(F.col("t"), tokenizer).cast("bigint").alias("n_tokens")).groupBy("doc", "source").agg(F.max("most").alias("most"), F.max("n_tokens").alias("n_tokens")), "mix")
    # one row per target source: the list of targets is configuration
    have = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    goal = [(r["source"], r["share"]) for r in wanted.orderBy("source").collect()]
    schema = f"`{key}` {dict(df.dtypes)[key]}, source string, repeat_no int, n_tokens bigint, slot bigint"
    total = sum(have.values()) if total_tokens is None else total_tokens
    if not goal or not sum(have.values()) or total <= 0:
        return spark.createDataFrame([], schema)
    whole = sum(s for _, s in goal)
    slots = total // block or 1
    edges, at = [], 0.0
    for _, s in goal:
        at += s / whole
        edges.append(at)
    edges[-1] = 2.0
    pick = F.element_at(F.array(*(F.lit(x) for x, _ in goal)), (F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("u"))) + 1).cast("int"))
    schedule = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", golden_point(F.col("slot"))).select("slot", pick.alias("source"))
    # a source is repeated no oftener than its slots ask for
    share_of = F.element_at(F.create_map(*(v for x, s in goal if have.get(x) for v in (F.lit(x), F.lit(min(1.0, s / whole + 64 / slots) * total / have[x])))), F.col("source"))
    repeats = F.least(F.col("most"), (F.floor(share_of) + 1).cast("int"))
    copies = sized.filter("n_tokens > 0").select("doc", "source", "n_tokens", F.explode(F.sequence(F.lit(0), repeats - 1)).alias("repeat_no")).withColumn("hash", F.xxhash64("doc", "source", "repeat_no", F.lit(seed)))
    blocks = running_tokens(copies).withColumn("rank", F.floor((F.col("start") + F.floor(F.col("n_tokens") / 2)) / block).cast("bigint"))
    used = blocks.join(slot_ranks(schedule), ["source", "rank"])
    return used.select(F.col("doc").alias(key), "source", "repeat_no", "n_tokens", "slot")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_documents, most_used) of each target source; actual_share is that of all tokens used."""
    wanted = targets.select(name(F.col("source")).alias("source"), "target_share").filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
    key = mixed.columns[0]
    got = mixed.groupBy("source", key).agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t")).groupBy("source").agg(F.sum("t").alias("n_tokens"), F.count("*").alias("n_documents"), F.max("uses").alias("most_used"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    joined = wanted.join(got, "source", "left").select("source", "target_share", zero("n_tokens"), zero("n_documents"), zero("most_used"))
    total = joined.agg(F.sum("n_tokens").alias("total"))
    return joined.crossJoin(F.broadcast(total)).select("source", "target_share", F.when(F.col("total") > 0, F.col("n_tokens") / F.col("total")).otherwise(0.0).alias("actual_share"), "n_tokens", "n_documents", "most_used")


def budget_report(mixed: DataFrame, df: DataFrame, targets: DataFrame, total_tokens: int, source: str = "source", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(source, n_wanted, n_tokens, n_most, short): tokens a source should give of the budget, those it gives, the most it could give, and whether it is short of its share."""
    wanted = _wanted(targets)
    whole = wanted.agg(F.sum("share").alias("whole"))
    have = df.select(name(F.col(f"`{source}`")).alias("source"), n_tokens(F.col(f"`{text}`"), tokenizer).cast("bigint").alias("n")).groupBy("source").agg(F.sum("n").alias("have"))
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    rows = wanted.crossJoin(F.broadcast(whole)).join(have, "source", "left").join(got, "source", "left")
    most = F.coalesce(F.col("have") * F.col("most"), F.lit(0)).cast("bigint")
    ask = F.round(F.col("share") / F.col("whole") * total_tokens).cast("bigint")
    return rows.select("source", ask.alias("n_wanted"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), most.alias("n_most"), (most < ask).alias("short"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), read(spark, sf_dir, "source_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read(spark, sf_dir, "source_targets")
    return shares(mix_sources(read(spark, sf_dir, "documents"), targets), targets)


def p8_budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a budget fixed beforehand: half of the tokens that the documents of all sources have."""
    targets, docs = read(spark, sf_dir, "source_targets"), read(spark, sf_dir, "documents")
    total = docs.select(n_tokens(F.col("text")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // 2
    return budget_report(mix_sources(docs, targets, total_tokens=total), docs, targets, total)


def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, doc_id, uses): documents used oftener than their source's max_repeats, or used of a source that is no target; there must be none."""
    targets = read(spark, sf_dir, "source_targets")
    mixed = mix_sources(read(spark, sf_dir, "documents"), targets)
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.countDistinct("repeat_no").alias("kinds"))
    return uses.join(_wanted(targets), "source", "left").filter("most IS NULL OR uses > most OR kinds <> uses").select("source", "doc_id", "uses")


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_budget_shares": p8_budget_shares, "p8_violations": p8_violations}
SQL = {"p8_violations": "SELECT lower(trim(source)) AS source, doc_id, CAST(count(*) AS BIGINT) AS uses FROM documents GROUP BY 1, 2 HAVING count(*) < 0"}

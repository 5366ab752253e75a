"""Readers and writers of the stage files (SRC-1 to SRC-9, SNK-1 to SNK-7)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DUMP = "title string, source_text string, create_timestamp string, timestamp string, page_id bigint, weighted_tags array<string>"
CORPUS = "_id string, title string, text string, published_date string, lang string"
QUERIES = "_id string, text string"
QRELS = "`query-id` string, `corpus-id` string, score int"


def read_dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """SRC-1: JSON lines, gzip or plain; gzip can't be split, so the rows are spread after the read."""
    rows = spark.read.schema(DUMP).json(path)
    return rows.repartition(partitions) if partitions else rows


def read_json(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = False) -> DataFrame:
    """SRC-2: one document per line, or (multiline) one per file."""
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-3: all *.json of a folder, with the title from the file's name."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("title", F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.json$", 1))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: (query_id, corpus_id, score), one row per pair."""
    rows = spark.read.schema(QRELS).csv(path, sep="\t", header=True)
    return rows.groupBy(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id")).agg(F.max("score").alias("score"))


def read_opinions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: bz2 CSV with escaped quotes and line feeds in cells; malformed rows and rows without xml_harvard are dropped."""
    rows = spark.read.csv(path, header=True, quote='"', escape="\\", multiLine=True, mode="DROPMALFORMED", schema="id string, xml_harvard string, date_created string")
    return rows.filter(F.trim(F.coalesce("xml_harvard", F.lit(""))) != "")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: result CSVs of run folders, with the run from the folder's name."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path, header=True, inferSchema=False)
    return rows.withColumn("run", F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)/[^/]+\.csv$", 1))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: (id, embedding, raw) in Parquet instead of an index file and two maps."""
    return spark.read.parquet(path)


def write_pages(df: DataFrame, path: str, key: str = "title", order: str = "page_id") -> None:
    """SNK-1: one row per title, the last in `order`."""
    cols = [c for c in df.columns if c != key]
    df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*").write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK-2: overwrites, so that a rerun doesn't double the rows."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_qrels(df: DataFrame, path: str) -> None:
    """SNK-3: sorted by query, range partitioned."""
    df.select(F.col("query_id").alias("query-id"), F.col("corpus_id").alias("corpus-id"), "score").orderBy("query-id", "corpus-id").write.mode("overwrite").csv(path, sep="\t", header=True)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """SNK-4: appends the rows whose keys an earlier run hasn't written; a folder that can't be read raises, only a missing one is begun."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.parquet(path)
        return
    df.join(done, keys, "left_anti").write.mode("append").parquet(path)


def write_run(df: DataFrame, path: str, dataset: str, model: str, reranked: bool) -> None:
    """SNK-5: hits partitioned by dataset, model and whether they are reranked."""
    df.withColumn("dataset", F.lit(dataset)).withColumn("model", F.lit(model)).withColumn("reranked", F.lit(reranked)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "model", "reranked").parquet(path)

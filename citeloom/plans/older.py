"""Queries of superseded variants whose semantics differ, and of plain caps and orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators.assembly import earliest_year
from .building import ATTRIBUTES, attributes, read

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT DISTINCT title FROM wiki_dump WHERE source_text IS NOT NULL AND coalesce(create_timestamp, '1998') >= '2020-01-01'")
def pages_since(spark, d):
    """OLD-1: pages created since a date, those without one counting as of 1998"""
    return read(spark, d, "wiki_dump").filter("source_text IS NOT NULL").filter(F.coalesce("create_timestamp", F.lit("1998")) >= "2020-01-01").select("title").distinct()


@query("""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, trim(unnest(x)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l WHERE line <> '')
SELECT doc_id, CAST(n AS INTEGER) AS n, md5(coalesce(string_agg(line, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '')) AS context_md5 FROM k""")
def line_contexts(spark, d):
    """OLD-3: the four lines before each line as its context"""
    rows = read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(text.sentence_lines(F.col("text"))).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(-4, -1)
    return rows.select("doc_id", (F.col("i") + 1).alias("n"), F.md5(F.array_join(F.collect_list("line").over(w), " ")).alias("context_md5"))


_IDS = r"'^(~?.*--\d+)--(\d+)$'"


@query(rf"""WITH p AS (SELECT DISTINCT query_id, corpus_id, regexp_extract(query_id, {_IDS}, 1) AS stem, regexp_extract(query_id, {_IDS}, 2) AS hops FROM qrels)
SELECT query_id, count(*) AS n_documents, count(b.corpus_id) AS n_known FROM p a LEFT JOIN (SELECT stem, corpus_id FROM p WHERE hops = '1') b USING (stem, corpus_id) WHERE a.hops = '2' GROUP BY query_id HAVING count(*) = count(b.corpus_id)""")
def easy_two_hop(spark, d):
    """OLD-9, JOIN-14: 2-hop questions whose evidence the 1-hop question has already"""
    part = lambda i: F.regexp_extract("query_id", r"^(~?.*--\d+)--(\d+)$", i)
    p = read(spark, d, "qrels").select("query_id", "corpus_id").distinct().withColumn("stem", part(1)).withColumn("hops", part(2))
    one = p.filter("hops = '1'").select("stem", "corpus_id", F.lit(1).alias("known"))
    two = p.filter("hops = '2'").join(one, ["stem", "corpus_id"], "left")
    return two.groupBy("query_id").agg(F.count("*").alias("n_documents"), F.count("known").alias("n_known")).filter("n_documents = n_known")


@query(f"""WITH {ATTRIBUTES} SELECT year, num_hops = 1 AS single, count(*) AS n FROM (SELECT num_hops, least(list_min(list_filter(list_transform(coalesce(published_dates, CAST([] AS VARCHAR[])), lambda x: TRY_CAST(left(x, 4) AS INTEGER)), lambda y: y IS NOT NULL)), TRY_CAST(left(wiki_create_timestamp, 4) AS INTEGER)) AS year FROM att) GROUP BY 1, 2""")
def freshness_with_creation(spark, d):
    """OLD-13: the earliest year includes the page's creation, hops as single or multi"""
    year = F.least(earliest_year(F.col("published_dates")), F.substring("wiki_create_timestamp", 1, 4).try_cast("int"))
    return attributes(spark, d).groupBy(year.alias("year"), (F.col("num_hops") == 1).alias("single")).agg(F.count("*").alias("n"))


@query("SELECT _id FROM (SELECT DISTINCT _id FROM queries) ORDER BY _id LIMIT 1000")
def evaluation_cap(spark, d):
    """LIM-5, LIM-11: the first 1,000 ids in order of their characters"""
    return read(spark, d, "queries").select("_id").distinct().orderBy("_id").limit(1000)

"""Queries over retrieval, text functions, verdicts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import evaluation, graphs, metrics, pages, retrieval
from .building import ATTRIBUTES, BINS, YEAR, attributes, read

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_WS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '\s+'), lambda x: x <> '')"


def _bm25_sql(docs: str, k: int) -> str:
    return f"""bdocs AS ({docs}), bw AS (SELECT d, {_TOK.format("t")} AS w FROM bdocs), stat AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM bw),
post AS (SELECT d, dl, term, count(*) AS tf FROM (SELECT d, len(w) AS dl, unnest(w) AS term FROM bw) GROUP BY d, dl, term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT _id AS query_id, unnest({_TOK.format("text")}) AS term FROM queries) GROUP BY query_id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hits AS (SELECT query_id, d AS doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))), 9) AS score FROM qt JOIN post USING (term) JOIN dfs USING (term) CROSS JOIN stat GROUP BY query_id, d),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits QUALIFY rank <= {k})"""


_CORPUS = "SELECT _id AS d, min(text) AS t FROM corpus GROUP BY _id"


def _docs(spark, d):
    return read(spark, d, "corpus").groupBy("_id").agg(F.min("text").alias("text"))


def _asked(spark, d):
    return read(spark, d, "queries").select(F.col("_id").alias("query_id"), "text")


def _qrels(spark, d):
    return read(spark, d, "qrels").select("query_id", F.col("corpus_id").alias("doc_id"), F.col("score").alias("rel"))


def bm25_run(spark, d, k=100):
    return retrieval.bm25(_docs(spark, d), _asked(spark, d), k)


@query(f"WITH {_bm25_sql(_CORPUS, 10)} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm")
def bm25_topk(spark, d):
    """IR-1, IR-2, WIN-3, LIM-2"""
    return bm25_run(spark, d, 10).withColumn("score", F.round("score", 6))


@query(f"""WITH chunked AS (SELECT d, unnest(range(0, greatest(1, CAST(ceil((n - 512) / 480.0) AS BIGINT) + 1))) AS i, w, n FROM (SELECT d, {_WS.format("t")} AS w, len({_WS.format("t")}) AS n FROM ({_CORPUS})) WHERE n > 0)
SELECT d || '--__--' || i AS chunk_id, d AS doc_id, md5(array_to_string(w[i * 480 + 1 : i * 480 + 512], ' ')) AS contents_md5 FROM chunked""")
def chunk_overlap(spark, d):
    """STR-24"""
    return retrieval.chunked(_docs(spark, d)).select("chunk_id", "doc_id", F.md5("contents").alias("contents_md5"))


_CHUNKS = f"""SELECT d || '--__--' || i AS d, array_to_string(w[i * 480 + 1 : i * 480 + 512], ' ') AS t FROM (SELECT d, unnest(range(0, greatest(1, CAST(ceil((n - 512) / 480.0) AS BIGINT) + 1))) AS i, w FROM (SELECT d, {_WS.format("t")} AS w, len({_WS.format("t")}) AS n FROM ({_CORPUS})) WHERE n > 0)"""


@query(f"""WITH {_bm25_sql(_CHUNKS, 200)}, mp AS (SELECT query_id, string_split(doc_id, '--__--')[1] AS doc_id, greatest(max(score), 0) AS score FROM bm GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM mp QUALIFY rank <= 10""")
def bm25_max_passage(spark, d):
    """AGG-1, IR-2 on chunks"""
    hits = retrieval.bm25(retrieval.chunked(_docs(spark, d)), _asked(spark, d), 200, key="chunk_id", text="contents")
    run = metrics.max_passage(hits.select("query_id", F.col("doc_id").alias("chunk_id"), "score"))
    return metrics.ranked(run, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_METRICS = """ks AS (SELECT unnest([5, 10, 50, 100]) AS k), qr AS (SELECT query_id, doc_id, max(rel) AS rel FROM rels GROUP BY 1, 2 HAVING max(rel) > 0),
scored AS (SELECT DISTINCT query_id FROM run WHERE query_id IN (SELECT query_id FROM qr)), rk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM run WHERE doc_id <> query_id),
hit AS (SELECT query_id, rank, rel, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM rk JOIN qr USING (query_id, doc_id)),
ide AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS pos, count(*) OVER (PARTITION BY query_id) AS n FROM qr),
pq AS (SELECT query_id, k, coalesce((SELECT sum(rel / log2(rank + 1)) FROM hit h WHERE h.query_id = s.query_id AND rank <= k), 0) / (SELECT sum(rel / log2(pos + 1)) FROM ide i WHERE i.query_id = s.query_id AND pos <= k) AS ndcg,
 coalesce((SELECT sum(seen / rank) FROM hit h WHERE h.query_id = s.query_id AND rank <= k), 0) / (SELECT max(n) FROM ide i WHERE i.query_id = s.query_id) AS map,
 (SELECT count(*) FROM hit h WHERE h.query_id = s.query_id AND rank <= k) / (SELECT max(n) FROM ide i WHERE i.query_id = s.query_id) AS recall,
 (SELECT count(*) FROM hit h WHERE h.query_id = s.query_id AND rank <= k) / k AS precision, coalesce((SELECT 1 / min(rank) FROM hit h WHERE h.query_id = s.query_id AND rank <= k), 0) AS rr FROM scored s CROSS JOIN ks)"""
_SUMMARY = """SELECT k, round(avg(ndcg), 5) AS ndcg, round(avg(map), 5) AS map, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(sum(rr) / (SELECT count(DISTINCT query_id) FROM rels), 5) AS mrr, round(sum(rr) / count(*), 5) AS mrr_scored, count(*) AS n_scored FROM pq GROUP BY k"""
_RUN = f"""{_bm25_sql(_CORPUS, 100)}, run AS (SELECT query_id, doc_id, score FROM bm), rels AS (SELECT query_id, corpus_id AS doc_id, score AS rel FROM qrels)"""


@query(f"WITH {_RUN}, {_METRICS} {_SUMMARY}")
def retrieval_metrics(spark, d):
    """WIN-4 to WIN-8, AGG-2, AGG-3, JOIN-9, JOIN-10, JOIN-12, IR-4"""
    return metrics.summary(bm25_run(spark, d), _qrels(spark, d))


def _vectors(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return v, v.filter("vec_id % 50 = 0")


_KNN = """knn AS (SELECT q.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id AND q.vec_id % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM knn)"""


@query(f"WITH {_KNN} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10")
def dense_knn(spark, d):
    """VEC-1, VEC-2, JOIN-19: every vector whose id 50 divides, against all"""
    return retrieval.knn(*_vectors(spark, d), 10)


@query(f"""WITH {_KNN}, run AS (SELECT query_id, doc_id, score FROM top WHERE rank <= 100), rels AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, 1 AS rel FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 50 = 0), {_METRICS} {_SUMMARY}""")
def dense_metrics(spark, d):
    """WIN-4 to WIN-8 on vectors, equal labels being relevant"""
    docs, asked = _vectors(spark, d)
    lab = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    rels = asked.select(F.col("vec_id").alias("query_id")).join(lab.withColumnRenamed("doc_id", "query_id"), "query_id").join(lab, "label").filter("query_id <> doc_id").select("query_id", "doc_id", F.lit(1).alias("rel"))
    return metrics.summary(retrieval.knn(docs, asked, 100), rels)


@query(f"WITH {_KNN} SELECT query_id, count(*) AS n, max(CAST(rank AS INTEGER)) AS last, max(score) AS top, min(score) AS least FROM top WHERE rank <= 1000 GROUP BY query_id")
def dense_thousand(spark, d):
    """LIM-2, WIN-8: the first 1000 of every query, as the dense evaluation keeps them"""
    run = retrieval.knn(*_vectors(spark, d), 1000)
    return run.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.max("score").alias("top"), F.min("score").alias("least"))


@query(f"""WITH {_bm25_sql(_CORPUS, 20)}, s AS (SELECT query_id, doc_id, list_distinct({_TOK.format("q.text")}) AS q, list_distinct({_TOK.format("c.t")}) AS w FROM bm JOIN queries q ON q._id = query_id JOIN bdocs c ON c.d = doc_id),
r AS (SELECT query_id, doc_id, CASE WHEN len(q) > 0 THEN len(list_intersect(q, w)) / len(q) ELSE 0.0 END AS score FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r""")
def rerank_overlap(spark, d):
    """IR-3, JOIN-11 with the overlap stub"""
    docs = _docs(spark, d).select(F.col("_id").alias("doc_id"), "text")
    return retrieval.rerank(bm25_run(spark, d, 20), _asked(spark, d), docs, retrieval.overlap(F.col("query"), F.col("text")), 20).withColumn("score", F.round("score", 6))


_OUTCOME = f"""{_RUN}, need AS (SELECT DISTINCT query_id, doc_id FROM rels WHERE rel > 0), got AS (SELECT n.query_id, count(*) AS n, count(b.doc_id) AS h FROM need n LEFT JOIN (SELECT query_id, doc_id FROM bm WHERE rank <= 5) b USING (query_id, doc_id) GROUP BY n.query_id),
outcomes AS (SELECT a.query_id, CASE WHEN h = n THEN 'correct' WHEN h > 0 THEN 'partially-correct' ELSE 'wrong' END AS outcome FROM (SELECT DISTINCT query_id FROM run) a LEFT JOIN got USING (query_id))"""


@query(f"WITH {_OUTCOME} SELECT query_id, outcome FROM outcomes")
def retrieval_outcomes(spark, d):
    """WIN-9"""
    return metrics.retrieval_outcome(bm25_run(spark, d), _qrels(spark, d), 5)


SLICES = [{"num_hops": 1}, {"num_hops": 2}, {"false_premise": True}, {"language": "english"}, {"language": "multilingual"}, {"freshness": 2024}, {"freshness": 2025}, {"topic": "STEM"}, {"num_hops": 2, "language": "multilingual"}, {"topic": "nowhere"}]
_COND = {
    "num_hops": "coalesce(num_hops = {0}, false)", "false_premise": "coalesce(false_premise = {0}, false)", "freshness": "coalesce(list_min(list_filter(list_transform(coalesce(published_dates, CAST([] AS VARCHAR[])), lambda x: TRY_CAST(left(x, 4) AS INTEGER)), lambda y: y IS NOT NULL)) = {0}, false)",
    "topic": "coalesce(len(list_filter(topics, lambda t: contains(t, '{0}'))) > 0, false)", "language": "coalesce(len(list_filter(langs, lambda c: NOT starts_with(lower(c), 'en'))) > 0, false) = {0}",
}


def _slice_sql(s: dict) -> str:
    value = lambda k, v: str(v == "multilingual").lower() if k == "language" else str(v).lower() if isinstance(v, bool) else str(v)
    return " AND ".join(_COND[k].format(value(k, v)) for k, v in s.items())


_SLICES = " UNION ALL ".join([f"SELECT 'general' AS split, * FROM {{0}}", *(f"SELECT '{evaluation.slice_name(s)}' AS split, * FROM {{0}} WHERE {_slice_sql(s)}" for s in SLICES)])  # noqa: F541
_NAMES = ", ".join(["'general'", *(f"'{evaluation.slice_name(s)}'" for s in SLICES)])


def _scored(spark, d):
    out = metrics.retrieval_outcome(bm25_run(spark, d), _qrels(spark, d), 5).withColumnRenamed("query_id", "_id")
    is_ = lambda v: (F.col("outcome") == v).cast("double")
    tok = read(spark, d, "queries").select("_id", F.size(text.tokens(F.col("text"))).alias("reasoning_tokens"))
    return attributes(spark, d).join(out, "_id").join(tok, "_id").withColumns({"correct": is_("correct"), "incorrect": is_("wrong"), "not_attempted": is_("partially-correct")})


@query(f"""WITH {ATTRIBUTES}, {_OUTCOME}, sc AS (SELECT att.*, CAST(outcome = 'correct' AS DOUBLE) AS correct, CAST(outcome = 'wrong' AS DOUBLE) AS incorrect, CAST(outcome = 'partially-correct' AS DOUBLE) AS not_attempted, len({_TOK.format("q.text")}) AS tok FROM att JOIN outcomes o ON o.query_id = att._id JOIN queries q ON q._id = att._id),
sl AS ({_SLICES.format("sc")}), rep AS (SELECT split, count(*) AS support, round(avg(tok), 3) AS avg_reasoning_tokens, round(avg(correct), 3) AS correct, round(avg(incorrect), 3) AS incorrect, round(avg(not_attempted), 3) AS not_attempted, round(avg(correct) - avg(incorrect), 3) AS truthfulness FROM sl GROUP BY split)
SELECT n.split, coalesce(support, 0) AS support, avg_reasoning_tokens, correct, incorrect, not_attempted, truthfulness FROM (SELECT unnest([{_NAMES}]) AS split) n LEFT JOIN rep USING (split)""")
def slice_report(spark, d):
    """FLT-13, FLT-14, AGG-7, AGG-8"""
    return evaluation.slice_report(_scored(spark, d), SLICES)


@query(f"""WITH {ATTRIBUTES}, {_RUN}, {_METRICS}, j AS (SELECT att.*, pq.ndcg, pq.recall FROM pq JOIN att ON att._id = pq.query_id WHERE k = 5), sl AS ({_SLICES.format("j")})
SELECT split, count(*) AS support, round(avg(ndcg), 3) AS ndcg, round(avg(recall), 3) AS recall FROM sl GROUP BY split""")
def retrieval_report(spark, d):
    """AGG-9"""
    return evaluation.retrieval_report(metrics.per_query(bm25_run(spark, d), _qrels(spark, d)), attributes(spark, d), SLICES, 5)


_VOTES = """votes AS (SELECT DISTINCT doc_id, annotator, CASE WHEN lower(trim(label)) IN ('ok', 'clean') THEN 'CORRECT' WHEN lower(trim(label)) = 'unsure' THEN 'NOT_ATTEMPTED' WHEN label IS NOT NULL THEN 'INCORRECT' END AS label, reviewed_at FROM review_labels)"""


def _votes(spark, d):
    word = F.lower(F.trim("label"))
    label = F.when(word.isin("ok", "clean"), "CORRECT").when(word == "unsure", "NOT_ATTEMPTED").when(F.col("label").isNotNull(), "INCORRECT")
    return read(spark, d, "review_labels").select("doc_id", "annotator", label.alias("label"), "reviewed_at").distinct()


@query(f"""WITH {_VOTES} SELECT doc_id, count(*) FILTER (label = 'CORRECT') / count(*) AS correct, count(*) FILTER (label = 'INCORRECT') / count(*) AS incorrect, count(*) FILTER (label = 'NOT_ATTEMPTED') / count(*) AS not_attempted FROM votes WHERE label IS NOT NULL GROUP BY doc_id""")
def label_fractions(spark, d):
    """AGG-5 on the verdicts of several annotators"""
    return evaluation.verdict_fractions(_votes(spark, d), ["doc_id"])


@query(f"""WITH {_VOTES}, f AS (SELECT doc_id, count(*) FILTER (label = 'CORRECT') / count(*) AS c, count(*) FILTER (label = 'INCORRECT') / count(*) AS i, count(*) FILTER (label = 'NOT_ATTEMPTED') / count(*) AS n FROM votes WHERE label IS NOT NULL GROUP BY doc_id)
SELECT round(avg(coalesce(c, 0)), 5) AS correct, round(avg(coalesce(i, 0)), 5) AS incorrect, round(avg(coalesce(n, 0)), 5) AS not_attempted FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN f USING (doc_id)""")
def run_mean(spark, d):
    """AGG-6"""
    fractions = evaluation.verdict_fractions(_votes(spark, d), ["doc_id"]).withColumnRenamed("doc_id", "query_id")
    return evaluation.run_mean(fractions, read(spark, d, "documents").select(F.col("doc_id").alias("query_id")))


_FIRST_LAST = f"""{_VOTES}, ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY reviewed_at, annotator, label) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY reviewed_at DESC, annotator DESC, label DESC) AS z FROM votes WHERE label IS NOT NULL),
fl AS (SELECT f.doc_id, f.label AS before, l.label AS after FROM ord f JOIN ord l ON f.doc_id = l.doc_id AND f.a = 1 AND l.z = 1)"""


def _first_last(spark, d):
    v = _votes(spark, d).filter("label IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("reviewed_at", "annotator", "label")).alias("f"), F.max(F.struct("reviewed_at", "annotator", "label")).alias("l"))
    return v.select(F.col("doc_id").alias("query_id"), F.col("f.label").alias("label")), v.select(F.col("doc_id").alias("query_id"), F.col("l.label").alias("label"))


@query(f"""WITH {_FIRST_LAST} SELECT before, round(count(*) FILTER (after = 'CORRECT') / (SELECT count(*) FROM fl), 6) AS correct, round(count(*) FILTER (after = 'INCORRECT') / (SELECT count(*) FROM fl), 6) AS incorrect, round(count(*) FILTER (after = 'NOT_ATTEMPTED') / (SELECT count(*) FROM fl), 6) AS not_attempted FROM fl GROUP BY before""")
def transition_matrix(spark, d):
    """AGG-17: the first against the last verdict of each document"""
    return evaluation.transition_matrix(*_first_last(spark, d))


@query(f"WITH {_FIRST_LAST} SELECT doc_id AS id, 1 AS score FROM fl WHERE before <> 'CORRECT' AND after = 'CORRECT'")
def corrected_verdicts(spark, d):
    """JOIN-16"""
    a, b = _first_last(spark, d)
    bit = lambda df: df.select(F.col("query_id").alias("id"), (F.col("label") == "CORRECT").cast("int").alias("score"))
    return evaluation.fixed_facts(bit(a), bit(b))


@query(f"""WITH {_OUTCOME}, c AS (SELECT query_id, CAST(length(text) % 2 AS DOUBLE) AS correct FROM outcomes JOIN queries ON _id = query_id)
SELECT CASE WHEN outcome = 'correct' AND correct >= 0.999 THEN 'redundant' WHEN outcome = 'correct' THEN 'augmentation' WHEN correct >= 0.999 THEN 'resilience' ELSE 'hopeless' END AS cell, count(*) AS n FROM outcomes JOIN c USING (query_id) GROUP BY 1""")
def interplay_cells(spark, d):
    """JOIN-15, FLT-20: the parity of a question's length stands for the closed-book verdict"""
    closed = _asked(spark, d).select("query_id", (F.length("text") % 2).cast("double").alias("correct"))
    return evaluation.interplay(metrics.retrieval_outcome(bm25_run(spark, d), _qrels(spark, d), 5), closed)


_LANGS = ["en", "de", "fr", "es"]


@query("""SELECT model, round(100 * max(v) FILTER (split = 'en'), 1) AS en, round(100 * max(v) FILTER (split = 'de'), 1) AS de, round(100 * max(v) FILTER (split = 'fr'), 1) AS fr, round(100 * max(v) FILTER (split = 'es'), 1) AS es
FROM (SELECT lower(trim(source)) AS model, lang AS split, round(avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.0 END), 4) AS v FROM documents GROUP BY 1, 2) GROUP BY model""")
def result_pivot(spark, d):
    """AGG-18, SRC-8: sources stand for models, languages for splits, the share of long texts for the value"""
    rows = read(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("model"), F.col("lang").alias("split")).agg(F.round(F.avg(F.when(F.col("n_chars") > 500, 1.0).otherwise(0.0)), 4).alias("value"))
    return evaluation.result_pivot(rows, _LANGS)


@query(f"WITH {_VOTES} SELECT annotator, count(*) AS n, round(avg(CASE WHEN label = 'CORRECT' THEN 1 ELSE 0 END), 6) AS rate FROM votes GROUP BY annotator")
def positive_rates(spark, d):
    """AGG-16"""
    return evaluation.positive_rate(_votes(spark, d).select("annotator", F.when(F.col("label") == "CORRECT", 1).otherwise(0).alias("score")), ["annotator"])


@query(f"""WITH {ATTRIBUTES} SELECT kind, value, count(*) AS n FROM (SELECT 'topic' AS kind, unnest(topics) AS value FROM att UNION ALL SELECT 'lang', unnest(langs) FROM att UNION ALL SELECT 'year', left(unnest(published_dates), 4) FROM att) GROUP BY kind, value""")
def attribute_counters(spark, d):
    """AGG-13"""
    a = attributes(spark, d)

    def named(kind: str, column: str, head: int = 0):
        values = F.coalesce(column, F.array().cast("array<string>"))
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), (F.substring(x, 1, head) if head else x).alias("value")))

    parts = F.concat(named("topic", "topics"), named("lang", "langs"), named("year", "published_dates", 4))
    return a.select(F.explode(parts).alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


@query(f"WITH {BINS} SELECT topic, year, count(*) AS n FROM (SELECT unnest(tops) AS topic, left(wiki_create_timestamp, 7) AS year FROM years) WHERE topic IS NOT NULL GROUP BY topic, year")
def topic_month_table(spark, d):
    """AGG-19: top-level topics by the month of the page's creation"""
    a = attributes(spark, d)
    top = F.array_distinct(F.transform("topics", lambda t: F.split(t, r"\.")[0]))
    return a.select(F.explode(top).alias("topic"), F.substring("wiki_create_timestamp", 1, 7).alias("year")).groupBy("topic", "year").agg(F.count("*").alias("n"))


@query("""SELECT 'pages' AS stage, count(*) AS n FROM (SELECT DISTINCT title FROM wiki_dump WHERE source_text IS NOT NULL AND left(create_timestamp, 4) = '2025') UNION ALL SELECT 'facts', count(*) FROM (SELECT DISTINCT title, fact FROM raw_facts)
UNION ALL SELECT 'usable crawls', count(DISTINCT crawl_id) FROM url_content WHERE accessible AND url_content <> '' UNION ALL SELECT 'documents', count(DISTINCT _id) FROM corpus UNION ALL SELECT 'questions', count(DISTINCT _id) FROM queries""")
def stage_funnel(spark, d):
    """AGG-14"""
    return evaluation.funnel({
        "pages": pages.wiki_pages(read(spark, d, "wiki_dump"), YEAR), "facts": read(spark, d, "raw_facts").select("title", "fact").distinct(),
        "usable crawls": pages.usable(read(spark, d, "url_content")).select("crawl_id").distinct(), "documents": read(spark, d, "corpus").select("_id").distinct(), "questions": read(spark, d, "queries").select("_id").distinct(),
    })


@query("""WITH f AS (SELECT title, fact, max(len(citation_urls)) AS n FROM raw_facts GROUP BY title, fact) SELECT round((SELECT avg(c) FROM (SELECT title, count(*) AS c FROM f WHERE n > 1 GROUP BY title)) / (SELECT avg(c) FROM (SELECT title, count(*) AS c FROM f GROUP BY title)), 6) AS ratio""")
def yield_ratio(spark, d):
    """AGG-21: facts with several citations against all facts of a page"""
    f = read(spark, d, "raw_facts").groupBy("title", "fact").agg(F.max(F.size("citation_urls")).alias("n"))
    return evaluation.yield_ratio(f.filter("n > 1"), f)


_EDGES = """edges AS (SELECT title, fact, regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/:?#]+)', 1) AS relation, title AS head, url AS tail FROM (SELECT title, fact, unnest(citation_urls) AS url FROM (SELECT DISTINCT ON (title, fact) * FROM raw_facts)))"""


def _edges(spark, d):
    c = pages.citations(read(spark, d, "raw_facts"))
    return c.select("title", "fact", urls.host(F.col("url")).alias("relation"), F.col("title").alias("head"), F.col("url").alias("tail"))


@query(f"""WITH {_EDGES} SELECT DISTINCT title, fact, tail AS node FROM edges WHERE (title, fact, relation) IN (SELECT (title, fact, relation) FROM edges GROUP BY title, fact, relation HAVING count(DISTINCT tail) > 1)""")
def non_exclusive_nodes(spark, d):
    """AGG-12, SET-1: citation graphs, a site being the relation"""
    return graphs.non_exclusive(_edges(spark, d))


@query(f"WITH {_EDGES} SELECT title, fact, max(c) AS most FROM (SELECT title, fact, relation, count(*) AS c FROM edges GROUP BY title, fact, relation) GROUP BY title, fact")
def relation_counts(spark, d):
    """AGG-11, AGG-20"""
    return graphs.relation_counts(_edges(spark, d))


# graphs of two facts a customer: where it lives, and where that nation lies
_KG = """kg AS (SELECT c_name AS title, 1 AS fact, 0 AS edge_idx, c_name AS head, 'customer' AS head_type, 'lives in' AS relation, n_name AS tail, 'nation' AS tail_type FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT c_name, 1, 1, n_name, 'nation', 'hosts', c_mktsegment, 'segment' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0
 UNION ALL SELECT c_name, 2, 0, n_name, 'nation', 'lies in', r_name, 'continent' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _kg(spark, d):
    c = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    edge = lambda fact, i, h, ht, rel, t, tt: F.struct(F.lit(fact).alias("fact"), F.lit(i).alias("edge_idx"), F.col(h).alias("head"), F.lit(ht).alias("head_type"), F.lit(rel).alias("relation"), F.col(t).alias("tail"), F.lit(tt).alias("tail_type"))
    some = F.array(edge(1, 0, "c_name", "customer", "lives in", "n_name", "nation"), edge(2, 0, "n_name", "nation", "lies in", "r_name", "continent"))
    more = F.when(F.col("c_acctbal") > 0, F.array(edge(1, 1, "n_name", "nation", "hosts", "c_mktsegment", "segment"))).otherwise(F.array())
    return c.select(F.col("c_name").alias("title"), F.explode(F.concat(some, more)).alias("e")).select("title", "e.*")


def _kg_keypoints(spark, d):
    """What the facts say; every third customer's first fact leaves the customer out."""
    e = _kg(spark, d).filter("edge_idx = 0").withColumn("number", F.substring("title", -9, 9).cast("int"))
    said = F.when((F.col("fact") == 1) & (F.col("number") % 3 == 0), F.concat(F.lit("Somebody lives in "), F.col("tail"))).otherwise(F.concat_ws(" ", "head", "relation", "tail"))
    more = _kg(spark, d).filter("edge_idx = 1").select("title", "fact", F.concat_ws(" ", "head", "relation", "tail").alias("m"))
    return e.join(more, ["title", "fact"], "left").select("title", "fact", F.array_compact(F.array(said, "m")).alias("keypoints"))


_NUMBER = "CAST(right(title, 9) AS INTEGER)"


@query(f"WITH {_KG} SELECT title, fact, head AS node FROM kg WHERE fact = 1 AND edge_idx = 0 AND {_NUMBER} % 3 = 0")
def kg_missing_nodes(spark, d):
    """GR-2, GR-3, JOIN-17, JOIN-18, SET-1: the bad nodes by all rules; here only that of nodes that the keypoints don't name finds any"""
    edges = _kg(spark, d).withColumn("head_coverage", F.lit(None).cast("array<int>"))
    return graphs.bad_nodes(edges, _kg_keypoints(spark, d))


@query(f"""WITH {_KG} SELECT title, fact, edge_idx, CASE WHEN edge_idx = 0 THEN '<Unknown> #1' ELSE head END AS head, head AS head_unmasked, head_type, relation, tail, tail AS tail_unmasked, tail_type FROM kg WHERE NOT (fact = 1 AND {_NUMBER} % 3 = 0)
UNION ALL SELECT title, fact, CAST(1 - edge_idx AS INTEGER), CASE WHEN edge_idx = 1 THEN '<Unknown> #1' ELSE head END, head, head_type, relation, CASE WHEN edge_idx = 0 THEN '<Unknown> #1' ELSE tail END, tail, tail_type FROM kg k
WHERE fact = 1 AND {_NUMBER} % 3 = 0 AND EXISTS (SELECT 1 FROM kg x WHERE x.title = k.title AND x.edge_idx = 1)""")
def kg_masks(spark, d):
    """GR-1, GR-4, GR-5: the first good head is masked; where the customer isn't named that is the nation"""
    return _kg_masked(spark, d)


def _kg_masked(spark, d):
    unnamed = _kg(spark, d).filter((F.col("fact") == 1) & (F.col("edge_idx") == 0) & (F.substring("title", -9, 9).cast("int") % 3 == 0))
    return graphs.masked(_kg(spark, d), unnamed.select("title", "fact", F.col("head").alias("node")))


@query(f"WITH {_KG} SELECT title, fact, 2 AS aux_fact, tail AS node FROM kg WHERE fact = 1 AND edge_idx = 0 AND {_NUMBER} % 3 <> 0")
def kg_two_hop(spark, d):
    """JOIN-4"""
    return graphs.two_hop(_kg_masked(spark, d))


@query(f"""WITH {_KG}, good AS (SELECT *, max(CASE WHEN edge_idx = 0 AND fact = 1 THEN tail END) OVER (PARTITION BY title) AS nation FROM kg WHERE {_NUMBER} % 3 <> 0)
SELECT title, 1 AS fact, 2 AS aux_fact, CAST(row_number() OVER (PARTITION BY title ORDER BY fact, edge_idx) - 1 AS INTEGER) AS edge_idx, CASE WHEN head = title THEN '<Unknown> #1' WHEN head = nation THEN '<Unknown> #2' ELSE head END AS head, head AS head_unmasked, relation,
CASE WHEN tail = nation THEN '<Unknown> #2' ELSE tail END AS tail, tail AS tail_unmasked, 2 AS num_hops FROM good""")
def kg_combined(spark, d):
    """GR-9: both graphs of a two-hop pair as one, masked anew"""
    m = _kg_masked(spark, d)
    return graphs.combined(m, _kg_keypoints(spark, d), graphs.two_hop(m)).select("title", "fact", "aux_fact", "edge_idx", "head", "head_unmasked", "relation", "tail", "tail_unmasked", "num_hops")


@query(f"WITH {_KG} SELECT type, count(DISTINCT node) AS n_nodes FROM (SELECT head_type AS type, head AS node FROM kg UNION ALL SELECT tail_type, tail FROM kg) GROUP BY type")
def kg_node_types(spark, d):
    """AGG-15, LIM-9"""
    return graphs.node_types(_kg(spark, d))


@query(f"WITH {_KG} SELECT DISTINCT title, fact, statement FROM (SELECT title, fact, head || ' ' || relation || ' ' || tail AS statement FROM kg UNION ALL SELECT title, fact, head || ' is a ' || head_type FROM kg UNION ALL SELECT title, fact, tail || ' is a ' || tail_type FROM kg)")
def kg_statements(spark, d):
    """SET-5"""
    return graphs.statement_rows(_kg(spark, d))


@query(f"WITH {_KG}, f AS (SELECT title, fact, max(n) AS failed FROM (SELECT title, fact, relation, count(*) AS n FROM kg WHERE length(tail) % 2 = 0 GROUP BY ALL) GROUP BY title, fact) SELECT DISTINCT title, fact, coalesce(failed, 0) AS failed FROM kg LEFT JOIN f USING (title, fact)")
def kg_failures(spark, d):
    """UDF-7, AGG-20: the most failed statements of one relation; tails of an even length stand for what a judge turns down"""
    e = _kg(spark, d)
    verdicts = e.select("title", "fact", "relation", "tail", (F.length("tail") % 2 == 1).alias("ok"))
    return graphs.complete_graphs(e, _kg_keypoints(spark, d), verdicts).select("title", "fact", "failed")


@query(f"WITH {_KG} SELECT title, fact, string_agg((edge_idx + 1) || '. ' || head || ' [' || head_type || '] | ' || relation || ' | ' || tail || ' [' || tail_type || ']', chr(10) ORDER BY edge_idx) AS prompt FROM kg GROUP BY title, fact")
def kg_prompts(spark, d):
    """STR-33, STR-18"""
    e = _kg(spark, d).groupBy("title", "fact").agg(F.sort_array(F.collect_list(F.struct("edge_idx", "head", "head_type", "relation", "tail", "tail_type"))).alias("e"))
    return e.select("title", "fact", text.render("{edges}", edges=text.render_edges(F.col("e"))).alias("prompt"))


@query("""SELECT c_custkey, list_filter([CASE WHEN contains(k[1], n_name) THEN 0 END, CASE WHEN contains(k[2], n_name) THEN 1 END], lambda x: x IS NOT NULL) AS cov, n_name AS restored
FROM (SELECT c_custkey, n_name, [c_name || ' lives in ' || n_name, CASE WHEN c_acctbal > 0 THEN n_name || ' hosts' ELSE 'none' END] AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)""".replace("list_filter([", "array_to_string(list_filter([").replace("x IS NOT NULL) AS cov", "x IS NOT NULL), ',') AS cov"))
def keypoint_coverage(spark, d):
    """STR-16, STR-17"""
    c = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.array(F.concat_ws(" lives in ", "c_name", "n_name"), F.when(F.col("c_acctbal") > 0, F.concat(F.col("n_name"), F.lit(" hosts"))).otherwise(F.lit("none")))
    return c.select("c_custkey", F.array_join(text.coverage(k, F.col("n_name")).cast("array<string>"), ",").alias("cov"), text.restore_case(F.lower("n_name"), F.element_at(k, 1)).alias("restored"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false ELSE false END AS grounded, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS n_keypoints, CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 0 END AS reasoning, CAST(doc_id AS VARCHAR) || ' U.S. 12' AS cite FROM documents""")
def reply_fields(spark, d):
    """STR-13, STR-14, STR-30, JSON-1: replies made from the ids of documents"""
    i = F.col("doc_id")
    verdict = F.when(i % 3 == 0, "Grounded").when(i % 3 == 1, "Not Grounded, though Grounded before").otherwise("unclear")
    reply = F.when(i % 2 == 0, '##KEYPOINTS##: ["one", "two"]').otherwise('["one"]')
    raw = F.when(i % 5 == 0, '{"usage": {"output_tokens_details": {"reasoning_tokens": 7}}}').otherwise("not json")
    cite = text.case_citations(F.concat(F.lit("In <em>Moss v. Hart</em>, "), i.cast("string"), F.lit(" U.S. 12 the court said")))
    first = F.get(cite, F.lit(0))
    return read(spark, d, "documents").select("doc_id", text.grounded_verdict(verdict).alias("grounded"), F.size(text.parse_keypoints(reply, F.lit("a [KP] b [KP]"))).alias("n"), text.reasoning_tokens(raw).alias("reasoning"), F.concat_ws(" ", first["volume"], first["reporter"], first["page"]).alias("cite")).select("doc_id", "grounded", F.coalesce(F.greatest("n", F.lit(0)), F.lit(0)).alias("n_keypoints"), "reasoning", "cite")


@query("""WITH q AS (SELECT doc_id, line, line_no, CASE WHEN length(line) % 4 = 0 THEN 0 ELSE 1 END AS ok FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL))
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, min(ok) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS good FROM q) WHERE good = 1 GROUP BY doc_id""")
def answerable_questions(spark, d):
    """FLT-17: lines stand for the questions of a document, their length for the judge's reply"""
    lines = read(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("title"), F.posexplode(F.split("text", "\n", -1)).alias("question_no", "question")).withColumn("fact", F.lit(0))
    return pages.answerable(lines.withColumn("reply", F.when(F.length("question") % 4 == 0, "A.").otherwise("B."))).groupBy(F.col("title").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n"))


@query()
def question_overlap(spark, d):
    """FLT-11, STR-9: how far a question repeats its page's title; checked against brute force in the tests"""
    from ..functions.fuzzy import word_partial_ratio

    rows = read(spark, d, "queries").select("_id", "text", text.parse_query_id(F.col("_id")).alias("p"))
    ratio = word_partial_ratio(F.col("p.title"), F.col("text"))
    return rows.select("_id", F.round(ratio, 4).alias("ratio"), (F.col("text").contains("<Unknown") | (ratio >= 50)).alias("leaks"))


@query(f"""SELECT doc_id, len({_TOK.format("text")}) AS n_tokens, len({_WS.format("text")}) AS n_words, md5(array_to_string({_WS.format("text")}[1:20], ' ')) AS head_md5, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s) <> '')) AS n_lines FROM documents""")
def text_measures(spark, d):
    """STR-21, STR-23, STR-27, STR-29 and the canonical tokeniser over whole texts"""
    t = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select("doc_id", F.size(text.tokens(t)).cast("bigint").alias("n_tokens"), text.count_tokens(t).cast("bigint").alias("n_words"), F.md5(text.truncate_words(t, 20)).alias("head_md5"), F.size(text.sentence_lines(t)).cast("bigint").alias("n_lines"))


@query(r"""SELECT title, page_id, len(f) AS n_urls, CASE WHEN len(f) = 0 THEN NULL WHEN len(f) > 1 AND len(list_filter(f, lambda x: contains(x, 'web.archive.org'))) > 0 THEN list_filter(f, lambda x: contains(x, 'web.archive.org'))[1] ELSE f[1] END AS first_url
FROM (SELECT DISTINCT title, page_id, regexp_extract_all(source_text, '(https?://[\p{L}\p{N}_\-.]+(?:\.[a-z]{2,})+(?:/[\p{L}\p{N}_\-.~:/?#\[\]@!$&''()*+,;=%]*)?)', 1) AS f FROM wiki_dump WHERE source_text IS NOT NULL)""")
def citation_urls(spark, d):
    """STR-7 over whole page sources"""
    rows = read(spark, d, "wiki_dump").filter("source_text IS NOT NULL")
    return rows.select("title", "page_id", F.size(text.urls(F.col("source_text"))).cast("bigint").alias("n_urls"), text.citation_url(F.col("source_text")).alias("first_url")).distinct()


_NAMES_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.LANGUAGES.items()) + "}"


@query(f"SELECT coalesce({_NAMES_SQL}[replace(lower(lang), '_', '-')], {_NAMES_SQL}[string_split(replace(lower(lang), '_', '-'), '-')[1]], lang) AS language, count(*) AS n FROM corpus GROUP BY 1")
def language_names(spark, d):
    """STR-25"""
    return read(spark, d, "corpus").groupBy(text.language_name(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT crawl_id, TRY_CAST(CASE WHEN regexp_matches(published_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN published_date END AS DATE) AS p FROM url_content), x AS (SELECT crawl_id, date_diff('day', p, DATE '2026-01-01') AS d FROM r WHERE p IS NOT NULL)
SELECT crawl_id, CASE WHEN d = 0 THEN 'today' WHEN abs(d) < 7 THEN 'a few days' || t WHEN abs(d) < 30 THEN 'a few weeks' || t WHEN abs(d) < 365 THEN 'roughly ' || (abs(d) // 30) || ' month' || (CASE WHEN abs(d) // 30 = 1 THEN '' ELSE 's' END) || t
 ELSE 'roughly ' || (abs(d) // 365) || ' year' || (CASE WHEN abs(d) // 365 = 1 THEN '' ELSE 's' END) || t END AS phrase FROM (SELECT *, CASE WHEN d >= 0 THEN ' ago' ELSE ' from now' END AS t FROM x)""")
def date_phrases(spark, d):
    """DATE-1"""
    c = F.col("published_date")
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    rows = read(spark, d, "url_content").select("crawl_id", day.alias("p")).distinct().filter("p IS NOT NULL")
    return rows.select("crawl_id", dates.date_phrase(F.col("p"), F.lit("2026-01-01").cast("date")).alias("phrase"))


@query("""SELECT page_id, CASE WHEN d = 0 THEN 'this year' WHEN d > 0 THEN d || (CASE WHEN d = 1 THEN ' year' ELSE ' years' END) || ' ago' ELSE -d || (CASE WHEN d = -1 THEN ' year' ELSE ' years' END) || ' from now' END AS phrase
FROM (SELECT DISTINCT page_id, 2024 - CAST(left(create_timestamp, 4) AS INTEGER) AS d FROM wiki_dump WHERE create_timestamp IS NOT NULL)""")
def year_phrases(spark, d):
    """DATE-2"""
    rows = read(spark, d, "wiki_dump").filter("create_timestamp IS NOT NULL").select("page_id", F.substring("create_timestamp", 1, 4).cast("int").alias("y")).distinct()
    return rows.select("page_id", dates.year_phrase(F.col("y"), F.lit(2024)).alias("phrase"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'NOT_ATTEMPTED' WHEN 2 THEN 'NOT_ATTEMPTED' WHEN 3 THEN 'CORRECT' WHEN 4 THEN 'INCORRECT' END AS rule,
CASE doc_id % 6 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'NOT_ATTEMPTED' WHEN 2 THEN 'NOT_ATTEMPTED' WHEN 3 THEN 'INCORRECT' WHEN 4 THEN 'INCORRECT' ELSE 'CORRECT' END AS strict, CASE doc_id % 6 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'NOT_ATTEMPTED' WHEN 2 THEN 'CORRECT' WHEN 3 THEN 'NOT_ATTEMPTED' ELSE 'INCORRECT' END AS compat FROM documents""")
def judge_rules(spark, d):
    """STR-10, STR-11, STR-12: each document bears one of six forms of prediction, gold answer and reply"""
    i = F.col("doc_id") % 6
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (i + 1).cast("int"))
    prediction = F.when(i == 0, F.concat(F.lit('"'), F.coalesce("source", F.lit("x")), F.lit('."'))).otherwise(pick("", "I don't know", "I don’t know the answer", "False premise question", "It is a false premise question.", "Bern"))
    gold = F.when(i == 0, F.upper(F.coalesce("source", F.lit("x")))).otherwise(pick("", "Rome", "Rome", "False premise question", "Oslo", "Basel"))
    reply = pick("A", "C", "NOT_ATTEMPTED", "INCORRECT", "B: wrong", "correct")
    return read(spark, d, "documents").select("doc_id", text.rule_verdict(prediction, gold).alias("rule"), text.judge_verdict(reply).alias("strict"), text.judge_verdict(reply, compat=True).alias("compat"))


@query("""SELECT lower(event_type) AS event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum FROM events GROUP BY 1""")
def json_fields(spark, d):
    """JSON-1: a path of free JSON as VARIANT"""
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return read(spark, d, "events").groupBy(F.lower("event_type").alias("event_type")).agg(F.count("*").alias("n"), F.sum(v).alias("k_sum"))


@query("""WITH g AS (SELECT title, fact, max(len(list_distinct(pos))) AS groups FROM raw_facts GROUP BY title, fact), dates AS (SELECT _id, max(published_date) AS p FROM corpus GROUP BY _id),
q AS (SELECT DISTINCT query_id, corpus_id, score + 1 AS score, regexp_extract(query_id, '^~?(.*)--(\\d+)--(\\d+)$', 1) AS title, TRY_CAST(regexp_extract(query_id, '^~?(.*)--(\\d+)--(\\d+)$', 2) AS INTEGER) AS fact FROM qrels)
SELECT least(groups, 3) AS groups, 5 * (coalesce(TRY_CAST(left(p, 4) AS INTEGER), 2006) // 5) AS years, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM q JOIN g USING (title, fact) LEFT JOIN dates ON dates._id = corpus_id GROUP BY 1, 2""".replace("\\\\d", "\\d"))
def qrels_buckets(spark, d):
    """OLD-6: qrels by number of citation groups and five-year bins, scores one higher, missing dates as 2006"""
    g = read(spark, d, "raw_facts").groupBy("title", "fact").agg(F.max(F.size(F.array_distinct("pos"))).alias("groups"))
    q = read(spark, d, "qrels").distinct().select("query_id", "corpus_id", (F.col("score") + 1).alias("score"), text.parse_query_id(F.col("query_id")).alias("p")).select("*", "p.title", "p.fact")
    when = read(spark, d, "corpus").groupBy(F.col("_id").alias("corpus_id")).agg(F.max("published_date").alias("date"))
    year = F.coalesce(F.substring("date", 1, 4).try_cast("int"), F.lit(2006))
    return q.join(g, ["title", "fact"]).join(when, "corpus_id", "left").groupBy(F.least("groups", F.lit(3)).alias("groups"), (5 * F.floor(year / 5)).cast("int").alias("years")).agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query("""SELECT DISTINCT doc_id FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)) WHERE n BETWEEN 3 AND 500""".replace("\\\\", "\\"))
def line_chunks(spark, d):
    """FLT-19: documents with a line of 3 to 500 words"""
    lines = read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(text.count_tokens(F.col("line")).between(3, 500)).select("doc_id").distinct()

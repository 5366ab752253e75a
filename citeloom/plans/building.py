"""Queries over the building stages: dump, citations, crawled pages, corpus, queries, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, text, urls, wiki
from ..operators import assembly, pages


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


YEAR = 2025
_PAGES = r"""
pages AS (SELECT title, page_id, create_timestamp, weighted_tags FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY page_id DESC, coalesce(timestamp, '') DESC, create_timestamp DESC) AS r
  FROM wiki_dump WHERE source_text IS NOT NULL AND left(create_timestamp, 4) = '2025') WHERE r = 1),
topics AS (SELECT title, page_id, create_timestamp, list_filter(list_transform(coalesce(weighted_tags, CAST([] AS VARCHAR[])), lambda t: regexp_extract(t, '^classification\.(?:prediction|ores)\.articletopic/(.*?)\|(\d+)$', 1)), lambda x: x <> '') AS topics FROM pages)"""


@query(f"WITH {_PAGES} SELECT title, 'https://en.wikipedia.org/?curid=' || page_id AS wiki_url, page_id, array_to_string(topics, ';') AS topics FROM topics")
def wiki_pages(spark, d):
    """SRC-1, FLT-1, FLT-2, FLT-3, SNK-1"""
    return pages.wiki_pages(read(spark, d, "wiki_dump"), YEAR).select("title", "wiki_url", "page_id", F.array_join("topics", ";").alias("topics"))


@query()
def wikitext_facts(spark, d):
    """WIKI-1 to WIKI-7, STR-2 to STR-7, STR-22, STR-31, WIN-1, WIN-2, JOIN-5, FLT-12"""
    return wiki.facts(pages.wiki_pages(read(spark, d, "wiki_dump"), YEAR), urls.DENIED, source="source")


# fixed values, written here anew and not taken from functions.urls
_NAME = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
_VERDICT = """CASE WHEN url IS NULL OR h = '' THEN 'invalid url' WHEN h = 'archive.org' OR contains(h, 'internetarchive.org') THEN 'archive'
 WHEN {} OR contains(h, 'facebook.com') OR contains(h, 'twitter.com') OR contains(h, 'x.com') OR contains(h, 'github.com') OR contains(h, 'google.com') OR contains(h, 'amazon.com') OR contains(h, 'youtube.com') THEN 'bad domain'
 WHEN contains(h, 'music') THEN 'music' WHEN contains(lower(url), 'pdf') THEN 'pdf' ELSE 'ok' END"""
_LISTED = "h IN ('twitter.com', 'x.com', 'books.google.com', 'docs.google.com', 'youtube.com', 'www.facebook.com', 'music', 'porn', 'spotify.com', 'linkedin.com', 'amazon.com')"


@query(f"WITH u AS (SELECT DISTINCT url, {_NAME} AS h FROM url_content) SELECT url, {_VERDICT.format(_LISTED)} AS verdict FROM u")
def url_admission(spark, d):
    """FLT-6"""
    return read(spark, d, "url_content").select("url").distinct().select("url", urls.admission(F.col("url")).alias("verdict"))


# every host of forums and clubs stands in for a long deny list: a table that grows with the data
_DENY = f"deny AS (SELECT DISTINCT {_NAME} AS entry FROM url_content WHERE contains(lower(url), '-forum.') OR contains(lower(url), '-club.'))"


def _deny_table(spark, d):
    name = urls.authority(F.col("url"))
    return read(spark, d, "url_content").filter(F.lower("url").contains("-forum.") | F.lower("url").contains("-club.")).select(name.alias("entry")).distinct()


@query(f"WITH u AS (SELECT DISTINCT url, {_NAME} AS h FROM url_content), {_DENY} SELECT url, {_VERDICT.format('h IN (SELECT entry FROM deny)')} AS verdict FROM u")
def url_admission_listed(spark, d):
    """FLT-6 with the deny list as a table"""
    return pages.admitted(read(spark, d, "url_content"), _deny_table(spark, d))


@query(f"WITH u AS (SELECT DISTINCT url FROM url_content WHERE url IS NOT NULL), {_DENY} SELECT url FROM u WHERE EXISTS (SELECT 1 FROM deny WHERE entry <> '' AND contains(url, entry))")
def urls_denied(spark, d):
    """FLT-5 with the deny list as a table, an entry counting anywhere in the URL"""
    return pages.denied_urls(read(spark, d, "url_content"), _deny_table(spark, d))


_CITES = """cites AS (SELECT title, fact, unnest(range(len(citation_urls))) AS cite_idx, unnest(citation_urls) AS url, unnest(pos) AS pos FROM (SELECT DISTINCT ON (title, fact) * FROM raw_facts))"""
_GOOD = "NOT (contains(url, 'twitter.com') OR contains(url, 'x.com') OR contains(url, 'books.google.com') OR contains(url, 'docs.google.com') OR contains(url, 'youtube.com') OR contains(url, 'www.facebook.com') OR contains(url, 'music') OR contains(url, 'porn') OR contains(url, 'spotify.com') OR contains(url, 'linkedin.com') OR contains(url, 'amazon.com') OR ends_with(url, '.pdf') OR contains(url, '/pdf/') OR contains(url, '/pdfs/'))"


@query(f"""WITH {_CITES}, good AS (SELECT * FROM cites WHERE url IS NOT NULL AND {_GOOD}),
ch AS (SELECT *, CASE WHEN pos <> lag(pos) OVER w THEN 1 ELSE 0 END AS c FROM good WINDOW w AS (PARTITION BY title, fact ORDER BY cite_idx))
SELECT title, fact, CAST(cite_idx AS INTEGER) AS cite_idx, url, CAST(sum(c) OVER (PARTITION BY title, fact ORDER BY cite_idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS pos FROM ch""")
def citation_renumber(spark, d):
    """FLT-4, FLT-5, WIN-1"""
    return pages.renumbered(pages.citations(read(spark, d, "raw_facts")))


@query("""SELECT crawl_id, published_date, coalesce(CASE WHEN regexp_matches(published_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN TRY_CAST(published_date AS DATE) END >= DATE '2024-06-01', false) AS admissible FROM (SELECT DISTINCT crawl_id, published_date FROM url_content)""")
def date_admissible(spark, d):
    """FLT-7"""
    return read(spark, d, "url_content").select("crawl_id", "published_date").distinct().select("crawl_id", "published_date", dates.admissible(F.col("published_date"), F.lit("2024-06-01")).alias("admissible"))


@query("""SELECT crawl_id, CASE WHEN accessible THEN md5(content) ELSE md5('') END AS content_md5, CASE WHEN accessible THEN md5('') ELSE md5(content) END AS error_md5
FROM (SELECT DISTINCT crawl_id, coalesce(accessible, false) AS accessible, coalesce(nullif(url_content, ''), error, '') AS content FROM url_content)""")
def crawl_result(spark, d):
    """FLT-8"""
    rows = read(spark, d, "url_content").select("crawl_id", F.coalesce("accessible", F.lit(False)).alias("a"), F.coalesce(F.when(F.col("url_content") != "", F.col("url_content")), F.col("error"), F.lit("")).alias("content")).distinct()
    content, error = pages.crawl_result(F.col("a"), F.col("content"))
    return rows.select("crawl_id", F.md5(content).alias("content_md5"), F.md5(error).alias("error_md5"))


@query("SELECT title, count(DISTINCT url) AS n_urls, count(DISTINCT crawl_id) AS n_crawls FROM url_content WHERE accessible AND url_content <> '' GROUP BY title")
def usable_urls(spark, d):
    """FLT-9, SET-3"""
    return pages.usable(read(spark, d, "url_content")).groupBy("title").agg(F.countDistinct("url").alias("n_urls"), F.countDistinct("crawl_id").alias("n_crawls"))


@query("""SELECT _id, published_date, lang, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY ok DESC, length(text) DESC, crawl_id) AS r FROM (
 SELECT url AS _id, coalesce(nullif(url_content, ''), error) AS text, published_date, lang, coalesce(accessible, false) AS ok, crawl_id FROM url_content WHERE coalesce(accessible, false) OR (error <> '' AND published_date IS NOT NULL)) WHERE text <> '' AND _id IS NOT NULL) WHERE r = 1""")
def corpus_build(spark, d):
    """FLT-10, SET-2"""
    return pages.corpus(read(spark, d, "url_content")).select("_id", "published_date", "lang", F.md5("text").alias("text_md5"))


@query("""SELECT title, n_facts, n_urls FROM (SELECT title, count(DISTINCT fact) AS n_facts FROM raw_facts GROUP BY title) JOIN (SELECT title, count(DISTINCT url) AS n_urls FROM url_content GROUP BY title) USING (title) WHERE title IN (SELECT title FROM wiki_dump)""")
def stage_join(spark, d):
    """JOIN-1"""
    facts = read(spark, d, "raw_facts").groupBy("title").agg(F.countDistinct("fact").alias("n_facts"))
    crawled = read(spark, d, "url_content").groupBy("title").agg(F.countDistinct("url").alias("n_urls"))
    return facts.join(crawled, "title").join(read(spark, d, "wiki_dump").select("title").distinct(), "title", "left_semi")


@query(f"""WITH {_CITES}, last AS (SELECT title, url, url_content, error FROM (SELECT *, row_number() OVER (PARTITION BY title, url ORDER BY crawled_at DESC, crawl_id DESC) AS r FROM url_content) WHERE r = 1)
SELECT title, fact, CAST(cite_idx AS INTEGER) AS cite_idx, url, pos, CAST(length(url_content) AS INTEGER) AS n_chars FROM cites JOIN last USING (title, url) WHERE url_content <> '' AND coalesce(error, '') = ''""")
def fact_evidence(spark, d):
    """JOIN-2"""
    return pages.fact_evidence(pages.citations(read(spark, d, "raw_facts")), read(spark, d, "url_content"))


_CAP = 10


@query(f"""WITH {_CITES}, f AS (SELECT title, url, min(fact) AS fact FROM cites GROUP BY title, url), fresh AS (SELECT title, fact, count(*) AS n FROM f GROUP BY title, fact),
g AS (SELECT title, fact, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY title ORDER BY fact ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT DISTINCT title, fact FROM cites) LEFT JOIN fresh USING (title, fact))
SELECT title, fact, CAST(before AS BIGINT) AS before FROM g WHERE before < {_CAP}""")
def soft_url_cap(spark, d):
    """LIM-3, LIM-4"""
    return pages.soft_url_cap(pages.citations(read(spark, d, "raw_facts")), _CAP)


@query(f"""WITH {_CITES}, ok AS (SELECT DISTINCT title, fact, cite_idx FROM cites JOIN (SELECT DISTINCT title, url FROM url_content WHERE accessible AND url_content <> '') USING (title, url))
SELECT title, fact, CAST(cite_idx AS INTEGER) AS kp_idx, url, CAST(row_number() OVER (PARTITION BY title, fact ORDER BY cite_idx) - 1 AS INTEGER) AS new_idx FROM cites JOIN ok USING (title, fact, cite_idx)""")
def grounded_keypoints(spark, d):
    """JOIN-3, AGG-4: citations stand for keypoints, grounded where their page was crawled"""
    cites = pages.citations(read(spark, d, "raw_facts"))
    keypoints = cites.select("title", "fact", F.col("cite_idx").alias("kp_idx"), "url")
    crawled = pages.usable(read(spark, d, "url_content")).select("title", "url").distinct().withColumn("grounded", F.lit(True))
    return pages.grounded(keypoints, keypoints.join(crawled, ["title", "url"]).select("title", "fact", "kp_idx", "grounded"))


_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


@query("""SELECT event_id, user_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS group_no FROM (
 SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 3600000000 THEN 1 ELSE 0 END AS n FROM events)""")
def gap_groups(spark, d):
    """WIN-2 on the request log: a new group after an hour without events"""
    rows = read(spark, d, "events").select("event_id", "user_id", F.expr(_US).alias("t"))
    return pages.gap_groups(rows, "user_id", "t", "t", 3_600_000_000, ["event_id"]).select("event_id", "user_id", "group_no")


@query("""SELECT event_id, user_id, CAST(6000000 * i + max(t - 6000000 * i) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slot FROM (
 SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)""")
def rate_slots(spark, d):
    """RATE-1 on the request log, in microseconds"""
    rows = read(spark, d, "events").select("event_id", "user_id", F.expr(_US).alias("t"))
    return pages.rate_slots(rows, "user_id", "t", "event_id", 6_000_000).select("event_id", "user_id", F.col("slot").cast("bigint").alias("slot"))


_PARSED = r"""parsed AS (SELECT _id, text, regexp_extract(_id, '^(~?)(.*)--(\d+)--(\d+)$', 2) AS title, TRY_CAST(regexp_extract(_id, '^(~?)(.*)--(\d+)--(\d+)$', 3) AS INTEGER) AS fact,
 TRY_CAST(regexp_extract(_id, '^(~?)(.*)--(\d+)--(\d+)$', 4) AS INTEGER) AS hops, starts_with(_id, '~') AS false_premise FROM queries)"""


@query(f"WITH {_PARSED} SELECT _id, title, fact, hops, false_premise, (CASE WHEN false_premise THEN '~' ELSE '' END) || title || '--' || fact || '--' || hops AS rendered FROM parsed")
def query_ids(spark, d):
    """STR-28"""
    rows = read(spark, d, "queries").select("_id", text.parse_query_id(F.col("_id")).alias("p")).select("_id", "p.*")
    return rows.withColumn("rendered", text.query_id(F.col("title"), F.col("fact"), F.col("hops"), F.col("false_premise")))


def _questions(spark, d):
    rows = read(spark, d, "queries").select(text.parse_query_id(F.col("_id")).alias("p")).select("p.*").filter("NOT false_premise").distinct()
    one = rows.filter("hops = 1").select("title", F.col("fact").alias("aux_fact"))
    pairs = rows.filter("hops = 2").join(one, "title").filter("fact <> aux_fact")
    return pairs.groupBy("title", "fact").agg(F.min("aux_fact").alias("aux_fact")).withColumn("aux_title", F.col("title"))


@query(rf"""WITH {_PARSED}, p AS (SELECT DISTINCT title, fact, hops FROM parsed WHERE NOT false_premise),
q AS (SELECT a.title, a.fact, min(b.fact) AS aux FROM p a JOIN p b ON a.title = b.title AND a.hops = 2 AND b.hops = 1 AND a.fact <> b.fact GROUP BY a.title, a.fact),
one AS (SELECT DISTINCT query_id, corpus_id, score FROM qrels WHERE regexp_matches(query_id, '^[^~].*--1$')),
two AS (SELECT DISTINCT q.title || '--' || q.fact || '--2' AS query_id, corpus_id, score FROM q JOIN one ON one.query_id = q.title || '--' || q.fact || '--1' OR one.query_id = q.title || '--' || q.aux || '--1'),
al AS (SELECT * FROM one UNION SELECT * FROM two) SELECT * FROM al UNION SELECT '~' || query_id, corpus_id, score FROM al""")
def two_hop_qrels(spark, d):
    """JOIN-6, SET-7"""
    qrels = read(spark, d, "qrels").filter(F.col("query_id").rlike("^[^~].*--1$"))
    return assembly.two_hop_qrels(qrels, _questions(spark, d))


def attributes(spark, d):
    queries = read(spark, d, "queries").select("_id").distinct()
    wiki_ = pages.wiki_pages(read(spark, d, "wiki_dump"), YEAR)
    return assembly.attributes(queries, wiki_, assembly.evidence(read(spark, d, "qrels"), read(spark, d, "corpus")))


ATTRIBUTES = rf"""{_PARSED}, {_PAGES},
docs AS (SELECT _id, max(lang) AS lang, max(published_date) AS published_date FROM corpus GROUP BY _id),
ev AS (SELECT query_id, list_sort(list(lang) FILTER (lang IS NOT NULL)) AS langs, list_sort(list(published_date) FILTER (published_date IS NOT NULL)) AS dates FROM (SELECT DISTINCT query_id, corpus_id FROM qrels) JOIN docs ON corpus_id = docs._id GROUP BY query_id),
att AS (SELECT p._id, p.hops AS num_hops, p.false_premise, t.topics, t.create_timestamp AS wiki_create_timestamp, ev.langs, ev.dates AS published_dates FROM (SELECT DISTINCT _id, title, hops, false_premise FROM parsed) p LEFT JOIN topics t USING (title) LEFT JOIN ev ON ev.query_id = regexp_replace(p._id, '^~', ''))"""


@query(f"WITH {ATTRIBUTES} SELECT _id, num_hops, false_premise, CASE WHEN len(topics) > 0 THEN array_to_string(topics, ';') ELSE '-' END AS topics, wiki_create_timestamp, CASE WHEN len(langs) > 0 THEN array_to_string(langs, ';') ELSE '-' END AS langs, CASE WHEN len(published_dates) > 0 THEN array_to_string(published_dates, ';') ELSE '-' END AS published_dates FROM att")
def query_attributes(spark, d):
    """JOIN-7, JOIN-8, SET-2"""
    flat = lambda c: F.when(F.size(c) > 0, F.array_join(c, ";")).otherwise("-").alias(c)
    return attributes(spark, d).select("_id", "num_hops", "false_premise", flat("topics"), "wiki_create_timestamp", flat("langs"), flat("published_dates"))


BINS = f"""{ATTRIBUTES}, years AS (SELECT *, least(list_min(list_filter(list_transform(coalesce(published_dates, CAST([] AS VARCHAR[])), lambda x: TRY_CAST(left(x, 4) AS INTEGER)), lambda y: y IS NOT NULL)), TRY_CAST(left(wiki_create_timestamp, 4) AS INTEGER)) AS year,
 coalesce(len(list_filter(langs, lambda c: NOT starts_with(lower(c), 'en'))) > 0, false) AS m, CASE WHEN len(coalesce(topics, CAST([] AS VARCHAR[]))) = 0 THEN [NULL] ELSE list_distinct(list_transform(topics, lambda t: string_split(t, '.')[1])) END AS tops FROM att),
binned AS (SELECT _id, concat_ws('__', coalesce(CAST(year AS VARCHAR), 'none'), coalesce(CAST(num_hops AS VARCHAR), 'none'), coalesce(topic, 'none'), CAST(m AS VARCHAR), CAST(false_premise AS VARCHAR)) AS bin FROM (SELECT *, unnest(tops) AS topic FROM years))"""


@query(f"WITH {BINS} SELECT bin, count(*) AS n FROM binned GROUP BY bin")
def attribute_bins(spark, d):
    """AGG-10, WIN-10"""
    return assembly.bins(attributes(spark, d)).groupBy("bin").agg(F.count("*").alias("n"))


@query(f"""WITH {BINS}, r AS (SELECT _id, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('42' || _id), _id) AS round FROM (SELECT DISTINCT _id, bin FROM binned))
SELECT _id, round, bin FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY round, bin) AS k FROM r) WHERE k = 1""")
def stratified_order(spark, d):
    """LIM-6, cap-free"""
    return assembly.stratified_order(assembly.bins(attributes(spark, d)))


@query()
def stratified_sample(spark, d):
    """LIM-6, JOIN-13, SNK-6: 100 ids, at most 20 of them false-premise"""
    chosen = assembly.stratified_sample(assembly.bins(attributes(spark, d)), 100, 20)
    return read(spark, d, "queries").join(chosen, "_id", "left_semi")


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM (SELECT doc_id, lower(trim(source)) AS source FROM documents)) WHERE r <= 7""")
def sample_per_source(spark, d):
    """LIM-7, LIM-8: 7 documents of each source"""
    rows = read(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"))
    return assembly.hashed_sample(rows, "doc_id", 7, by="source")


@query("""WITH u AS (SELECT DISTINCT _id FROM corpus), r AS (SELECT _id, row_number() OVER (ORDER BY _id) - 1 AS i, count(*) OVER () AS n FROM u)
SELECT _id, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // greatest(1, n // 7) END AS INTEGER) AS shard FROM r""")
def corpus_shards(spark, d):
    """LIM-10"""
    return assembly.shards(read(spark, d, "corpus").select("_id").distinct(), "_id", 7).select("_id", "shard")


@query(r"""SELECT * FROM (SELECT 'duplicate query ids' AS check_name, count(*) AS n_violations FROM (SELECT _id FROM queries GROUP BY _id HAVING count(*) > 1)
UNION ALL SELECT 'queries without qrels', count(*) FROM queries WHERE NOT starts_with(_id, '~') AND _id NOT IN (SELECT query_id FROM qrels)
UNION ALL SELECT 'qrels without document', count(*) FROM (SELECT DISTINCT corpus_id FROM qrels) WHERE corpus_id NOT IN (SELECT _id FROM corpus)
UNION ALL SELECT 'malformed query ids', count(*) FROM queries WHERE NOT regexp_matches(_id, '^~?.+--\d+--\d+$'))""")
def integrity(spark, d):
    """FLT-21"""
    return assembly.violations(read(spark, d, "queries"), read(spark, d, "qrels"), read(spark, d, "corpus"))


_PLAIN = "[^\\p{L}\\p{N}]+"
_TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f"""SELECT _id, corpus_id, round(len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(b)), 6) AS coverage FROM (
 SELECT q._id, corpus_id, {_TOK.format("c.text")} AS a, {_TOK.format("q.text")} AS b FROM (SELECT DISTINCT query_id, corpus_id FROM qrels) r JOIN queries q ON r.query_id = q._id JOIN (SELECT DISTINCT ON (_id) _id, text FROM corpus) c ON c._id = corpus_id) WHERE len(b) > 0""")
def word_coverage(spark, d):
    """FLT-16, SET-4: how much of a question's words its document has"""
    pairs = read(spark, d, "qrels").select("query_id", "corpus_id").distinct()
    q = read(spark, d, "queries").select(F.col("_id").alias("query_id"), text.tokens(F.col("text")).alias("b"))
    c = read(spark, d, "corpus").dropDuplicates(["_id"]).select(F.col("_id").alias("corpus_id"), text.tokens(F.col("text")).alias("a"))
    return pairs.join(q, "query_id").join(c, "corpus_id").filter(F.size("b") > 0).select(F.col("query_id").alias("_id"), "corpus_id", F.round(pages.word_coverage(F.col("a"), F.col("b")), 6).alias("coverage"))


@query(f"""WITH {_PARSED}, t AS (SELECT DISTINCT _id, title, fact, hops, false_premise, {_TOK.format("text")} AS w FROM parsed), u AS (SELECT *, lag(w) OVER (PARTITION BY title, false_premise ORDER BY fact, hops, _id) AS b FROM t)
SELECT _id, coalesce(len(list_intersect(list_distinct(b), list_distinct(w))) >= 0.8 * len(list_distinct(b)), false) AS keeps FROM u""")
def question_progress(spark, d):
    """FLT-15: each question of a page against the one before it"""
    rows = read(spark, d, "queries").select("_id", text.parse_query_id(F.col("_id")).alias("p"), text.tokens(F.col("text")).alias("w")).distinct()
    w = Window.partitionBy("p.title", "p.false_premise").orderBy("p.fact", "p.hops", "_id")
    return rows.withColumn("b", F.lag("w").over(w)).select("_id", pages.question_progress(F.col("b"), F.col("w")).alias("keeps"))


@query("""SELECT title FROM (SELECT title FROM raw_facts INTERSECT SELECT title FROM wiki_dump) UNION ALL SELECT '-' || title FROM (SELECT title FROM url_content EXCEPT SELECT title FROM raw_facts)""")
def title_sets(spark, d):
    """SET-6, SET-8, JOIN-14"""
    t = {x: read(spark, d, x).select("title") for x in ("raw_facts", "wiki_dump", "url_content")}
    return t["raw_facts"].intersect(t["wiki_dump"]).unionByName(t["url_content"].exceptAll(t["raw_facts"]).distinct().join(t["raw_facts"], "title", "left_anti").select(F.concat(F.lit("-"), "title").alias("title")))

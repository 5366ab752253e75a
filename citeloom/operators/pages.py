"""Pages, facts, crawled content, keypoints: filters, joins and windows of the building stages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U


def topics(tags: Column) -> Column:
    """FLT-2: the topics of tags like 'classification.prediction.articletopic/Topic|859' with scores in 0..1; null tags give none."""
    pattern = r"^classification\.(?:prediction|ores)\.articletopic/(.*?)\|(\d+)$"
    rows = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.struct(F.regexp_extract(t, pattern, 1).alias("topic"), (F.regexp_extract(t, pattern, 2).try_cast("int") / 1000.0).alias("score")))
    return F.filter(rows, lambda r: r["topic"] != "")


def wiki_pages(dump: DataFrame, target_year: str | int, offset: int = 0, limit: int | None = None) -> DataFrame:
    """SRC-1, FLT-1, FLT-3, LIM-1: pages with a text, created in target_year; the last of rows with one title (by page_id, then timestamp).

    A null timestamp never matches. offset counts pages with a text before the year is looked at; falsy limit means all. No year raises.
    """
    if target_year in (None, "", "None"):
        raise ValueError("target_year is required")
    pages = dump.filter(F.col("source_text").isNotNull())
    if offset:
        pages = pages.orderBy("page_id", "title").offset(offset)
    pages = pages.filter(F.substring("create_timestamp", 1, 4) == str(target_year))
    last = F.max(F.struct("page_id", F.coalesce("timestamp", F.lit("")), "create_timestamp", "source_text", "weighted_tags")).alias("p")
    one = pages.groupBy("title").agg(last)
    out = one.select("title", U.page_url(F.col("p.page_id")).alias("wiki_url"), F.col("p.page_id").alias("page_id"), F.col("p.source_text").alias("source"), F.col("p.create_timestamp").alias("create_timestamp"), F.transform(topics(F.col("p.weighted_tags")), lambda t: t["topic"]).alias("topics"))
    return out.orderBy("page_id", "title").limit(limit) if limit else out


def citations(raw_facts: DataFrame) -> DataFrame:
    """(title, fact, cite_idx, url, pos): the parallel arrays side by side, repeated rows once."""
    zipped = F.arrays_zip(F.col("citation_urls").alias("url"), F.col("pos").alias("pos"))
    one = raw_facts.groupBy("title", "fact").agg(F.min(zipped).alias("z"))
    return one.select("title", "fact", F.posexplode("z").alias("cite_idx", "c")).select("title", "fact", "cite_idx", "c.url", "c.pos")


#: Characters of deny list entries that are broadcast at once; a longer list is gone through in several blocks.
DENY_BLOCK = 8 << 20


def denied_urls(urls: DataFrame, entries: DataFrame, url: str = "url", entry: str = "entry") -> DataFrame:
    """FLT-5 with a table of entries: the distinct URLs that have an entry anywhere in them. Null and empty entries match nothing, null URLs give no row.

    Each block of entries becomes an automaton (or, without that library, one alternation), so a URL is read once per block whatever the number of entries.
    """
    spark = urls.sparkSession
    rows = urls.select(F.col(url).alias("url")).filter("url IS NOT NULL").distinct()
    out = spark.createDataFrame([], "url string")

    def hits(words: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(words)

        def run(batches):
            try:
                import ahocorasick

                known = ahocorasick.Automaton()
                for w in shared.value:
                    known.add_word(w, 1)
                known.make_automaton()
                has = lambda s: next(known.iter(s), None) is not None
            except ImportError:
                known = re.compile("|".join(map(re.escape, shared.value)))
                has = lambda s: known.search(s) is not None
            for b in batches:
                yield b[[has(s) for s in b["url"]]]

        return rows.mapInPandas(run, "url string")

    block, size = [], 0
    for r in entries.select(F.col(entry).alias("e")).filter("e <> ''").distinct().toLocalIterator():
        block.append(r["e"])
        size += len(r["e"])
        if size >= DENY_BLOCK:
            out, block, size = out.union(hits(block)), [], 0
    return (out.union(hits(block)) if block else out).distinct()


def admitted(urls: DataFrame, entries: DataFrame, url: str = "url", entry: str = "entry") -> DataFrame:
    """FLT-6 with a table of entries: (url, verdict) of the distinct URLs; an entry turns away the host that it names."""
    listed = entries.select(F.lower(F.col(entry)).alias("name")).filter("name <> ''").distinct().withColumn("listed", F.lit(True))
    rows = urls.select(F.col(url).alias("url")).distinct().withColumn("name", U.authority(F.col("url")))
    return rows.join(listed, "name", "left").select("url", U.admission(F.col("url"), F.coalesce("listed", F.lit(False))).alias("verdict"))


def renumbered(cites: DataFrame, strict: bool = False, denied: tuple[str, ...] = U.DENIED) -> DataFrame:
    """FLT-5, WIN-1: citations without bad URLs, `pos` counted anew from 0 at each change; strict keeps the original group number in `pos`."""
    good = cites.filter(~U.is_bad(F.col("url"), denied))
    if strict:
        return good
    w = Window.partitionBy("title", "fact").orderBy("cite_idx")
    changed = (F.col("pos") != F.lag("pos").over(w)).cast("int")
    return good.withColumn("c", F.coalesce(changed, F.lit(0))).withColumn("pos", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("c")


def gap_groups(events: DataFrame, key: str, start: str, end: str, gap: float, order: list[str]) -> DataFrame:
    """WIN-2: a group number from 0 that grows where start is `gap` or more after the end before."""
    w = Window.partitionBy(key).orderBy(start, *order)
    new = F.coalesce((F.col(start) - F.lag(end).over(w) >= gap).cast("int"), F.lit(0))
    return events.withColumn("_n", new).withColumn("group_no", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_n")


def crawl_result(accessible: Column, content: Column) -> tuple[Column, Column]:
    """FLT-8: (url_content, error): the content of a page goes to the one or the other, the rest is ''."""
    return F.when(accessible, content).otherwise(""), F.when(accessible, "").otherwise(content.cast("string"))


def usable(url_content: DataFrame) -> DataFrame:
    """FLT-9"""
    return url_content.filter(F.col("accessible") & (F.col("url_content") != ""))


def corpus(url_content: DataFrame) -> DataFrame:
    """FLT-10: one row per URL of the admitted rows, accessible ones first, then the longest text, then the least text and crawl."""
    admitted = url_content.filter(F.coalesce("accessible", F.lit(False)) | ((F.col("error") != "") & F.col("published_date").isNotNull()))
    rows = admitted.select(F.col("url").alias("_id"), F.coalesce(F.when(F.col("url_content") != "", F.col("url_content")), F.col("error")).alias("text"), "published_date", "lang", F.coalesce("accessible", F.lit(False)).alias("ok"), "crawl_id").filter("text <> '' AND _id IS NOT NULL")
    best = F.max(F.struct("ok", F.length("text").alias("n"), (-F.col("crawl_id")).alias("c"), "text", "published_date", "lang")).alias("b")
    return rows.groupBy("_id").agg(best).select("_id", F.lit("").alias("title"), "b.text", "b.published_date", "b.lang")


def soft_url_cap(cites: DataFrame, cap: int = 100) -> DataFrame:
    """LIM-3, SET-3: (title, fact) of the facts, in order, before which the page had under `cap` distinct URLs; the last may exceed it."""
    first = cites.groupBy("title", "url").agg(F.min("fact").alias("fact"))
    fresh = first.groupBy("title", "fact").agg(F.count("*").alias("fresh"))
    facts = cites.select("title", "fact").distinct().join(fresh, ["title", "fact"], "left")
    w = Window.partitionBy("title").orderBy("fact").rowsBetween(Window.unboundedPreceding, -1)
    return facts.withColumn("before", F.coalesce(F.sum(F.coalesce("fresh", F.lit(0))).over(w), F.lit(0))).filter(F.col("before") < cap).select("title", "fact", F.col("before").cast("bigint").alias("before"))


def fact_evidence(cites: DataFrame, url_content: DataFrame) -> DataFrame:
    """JOIN-2: (title, fact, cite_idx, pos, url, n_chars) of citations whose page's crawl has a content and no error; the last crawl of a URL counts."""
    last = url_content.groupBy("title", "url").agg(F.max_by(F.struct("url_content", "error"), F.struct("crawled_at", "crawl_id")).alias("c"))
    ok = last.filter("c.url_content <> '' AND coalesce(c.error, '') = ''").select("title", "url", F.length("c.url_content").alias("n_chars"))
    return cites.join(ok, ["title", "url"])


def grounded(keypoints: DataFrame, verdicts: DataFrame) -> DataFrame:
    """JOIN-3, AGG-4: keypoints (title, fact, kp_idx, ...) with a true verdict by any URL, with both the old and the new index."""
    kept = keypoints.join(verdicts.filter("grounded").select("title", "fact", "kp_idx").distinct(), ["title", "fact", "kp_idx"], "left_semi")
    return kept.withColumn("new_idx", F.row_number().over(Window.partitionBy("title", "fact").orderBy("kp_idx")) - 1)


def answerable(questions: DataFrame) -> DataFrame:
    """FLT-17: questions (fact keys, question_no, question, reply) up to the first that a judge finds unanswerable; line feeds make one so."""
    ok = (~F.col("question").contains("\n") & F.col("reply").contains("B.")).cast("int")
    w = Window.partitionBy("title", "fact").orderBy("question_no").rowsBetween(Window.unboundedPreceding, 0)
    return questions.withColumn("ok", F.min(ok).over(w)).filter("ok = 1").drop("ok")


def question_progress(before: Column, after: Column, share: float = 0.8) -> Column:
    """FLT-15, SET-4: whether the next question keeps that share of the words (arrays) of the one before."""
    b = F.array_distinct(before)
    return F.coalesce(F.size(F.array_intersect(b, F.array_distinct(after))) >= share * F.size(b), F.lit(False))


def word_coverage(answer: Column, document: Column) -> Column:
    """FLT-16: the share of the document's distinct words that the other side has; null for an empty document."""
    d = F.array_distinct(document)
    return F.when(F.size(d) > 0, F.size(F.array_intersect(d, F.array_distinct(answer))) / F.size(d))


def section_context(sentences: DataFrame) -> DataFrame:
    """STR-20: for each sentence (title, sent_idx, extracted) the text of its section up to it and the title paragraph, heading lines starting with 'SECTION:'."""
    w = Window.partitionBy("title").orderBy("sent_idx")
    head = F.col("extracted").startswith("SECTION:").cast("int")
    numbered = sentences.withColumn("section", F.sum(head).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # each section is collected once; a sentence takes what stands before it
    parts = numbered.groupBy("title", "section").agg(F.sort_array(F.collect_list(F.struct("sent_idx", "extracted"))).alias("all"))
    texts = lambda rows: F.array_join(F.transform(rows, lambda x: x["extracted"]), " ")
    lead = parts.filter("section = 0").select("title", texts(F.col("all")).alias("lead"))
    before = F.filter("all", lambda x: x["sent_idx"] <= F.col("sent_idx"))
    return numbered.join(parts, ["title", "section"]).join(lead, "title", "left").select("title", "sent_idx", "section", "lead", texts(before).alias("context"))


def rate_slots(requests: DataFrame, key: str, arrival: str, order: str, spacing: float = 6.0) -> DataFrame:
    """RATE-1: the slot of each request (arrival in seconds): never before its arrival, `spacing` after the one before of the same key."""
    w = Window.partitionBy(key).orderBy(arrival, order)
    i = F.row_number().over(w) - 1
    lead = F.max(F.col(arrival) - spacing * F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("_i", i).withColumn("slot", lead + spacing * F.col("_i")).drop("_i")


def remaining(pages: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-4: what an earlier run has not written yet."""
    return pages.join(done.select(*keys).distinct(), keys, "left_anti")

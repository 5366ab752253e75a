import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom import providers, sources, streaming
from citeloom.operators import assembly, evaluation, graphs, metrics, pages, retrieval


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q1", "d3", 1), ("q1", "d3", 1), ("q2", "d1", 1)], "query_id string, doc_id string, rel int")
    run = spark.createDataFrame([("q1", "d1", 3.0), ("q1", "d2", 2.0), ("q1", "d3", 1.0), ("q1", "q1", 9.0), ("q3", "d1", 1.0)], "query_id string, doc_id string, score double")
    got = {r["k"]: r for r in metrics.per_query(run, qrels, (2, 3, 5)).collect()}
    assert got[2]["precision"] == 0.5 and got[2]["recall"] == 0.5 and got[5]["rr"] == 1
    assert math.isclose(got[3]["map"], (1 + 2 / 3) / 2) and math.isclose(got[3]["ndcg"], (1 + 1 / 2) / (1 + 1 / math.log2(3)))
    s = metrics.summary(run, qrels, (5,)).first()
    assert s["mrr"] == 0.5 and s["mrr_scored"] == 1 and s["n_scored"] == 1
    assert rows(metrics.retrieval_outcome(run, qrels, 2)) == [("q1", "partially-correct"), ("q3", "wrong")]
    only_self = spark.createDataFrame([("q1", "q1", 1.0)], run.schema)
    assert metrics.per_query(only_self, qrels, (5,)).first()["ndcg"] == 0
    chunks = spark.createDataFrame([("q", "d--__--0", -1.0), ("q", "d--__--1", -2.0), ("q", "e--__--0", 2.0)], "query_id string, chunk_id string, score double")
    assert rows(metrics.max_passage(chunks)) == [("q", "d", 0.0), ("q", "e", 2.0)]


def brute_bm25(docs, query, k):
    n, avg = len(docs), sum(len(d) for d in docs.values()) / len(docs)
    out = []
    for key, d in docs.items():
        s = 0.0
        for t in query:
            df = sum(t in x for x in docs.values())
            tf = d.count(t)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * len(d) / avg))
        if s:
            out.append((-round(s, 9), key))
    return [(key, -s) for s, key in sorted(out)[:k]]


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    docs = {f"d{i:02}": [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))] for i in range(30)} | {"d98": ["a"], "d99": ["a"]}
    queries = {"q1": ["a", "b", "b"], "q2": ["h"], "q3": ["zz"], "q4": []}
    d = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()] + [("dn", None)], "_id string, text string").repartition(3)
    q = spark.createDataFrame([(k, " ".join(v)) for k, v in queries.items()], "query_id string, text string")
    docs["dn"] = []
    got = {}
    for r in retrieval.bm25(d, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for name in ("q1", "q2"):
        want = brute_bm25(docs, queries[name], 5)
        assert [x for x, _ in got[name]] == [x for x, _ in want]
        assert np.allclose([s for _, s in got[name]], [s for _, s in want], atol=1e-8)
    assert set(got) == {"q1", "q2"}
    assert retrieval.bm25(d.limit(0), q, 5).count() == 0 and retrieval.bm25(d, q.limit(0), 5).count() == 0


def test_best_keeps_ties_in_order():
    best = retrieval.Best(2, 2)
    best.most = 3
    for doc, score in (("c", 1.0), ("a", 1.0), ("b", 2.0), ("d", 0.5)):
        best.add(np.array([0, 1]), np.array([doc, doc], object), np.array([score, -score]))
    got = best.result(["q", "r"])
    assert list(zip(got["query_id"], got["doc_id"])) == [("q", "b"), ("q", "a"), ("r", "d"), ("r", "a")]


def test_knn_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 4)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None), (98, [1.0])], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 64)
    got = retrieval.knn(df, df.filter("vec_id % 10 = 0"), 3)
    found = {(r["query_id"], r["rank"]): r["doc_id"] for r in got.collect()}
    s = v @ v.T
    for q in range(0, 40, 10):
        order = sorted((j for j in range(40) if j != q), key=lambda j: (-round(s[q, j], 6), j))[:3]
        assert [found[q, r] for r in (1, 2, 3)] == order


KG = [("T", 1, i, *e) for i, e in enumerate([("Ada Moss", "person", "founded", "Old Mill", "mill"), ("Old Mill", "mill", "stands in", "Brock", "town"), ("Far Isle", "isle", "near", "Low Isle", "isle")])]
EDGE = "title string, fact int, edge_idx int, head string, head_type string, relation string, tail string, tail_type string"


def test_masking_prunes_what_is_not_connected(spark):
    edges = spark.createDataFrame(KG, EDGE)
    none = spark.createDataFrame([], "title string, fact int, node string")
    got = graphs.masked(edges, none).orderBy("edge_idx").collect()
    assert [(r["head"], r["tail"]) for r in got] == [("<Unknown> #1", "Old Mill"), ("Old Mill", "Brock")]
    assert got[0]["head_unmasked"] == "Ada Moss"
    bad = spark.createDataFrame([("T", 1, n) for n in ("Ada Moss", "Old Mill", "Far Isle")], none.schema)
    assert graphs.masked(edges, bad).count() == 0
    late = [{"head": h, "head_type": "", "relation": "", "tail": t, "tail_type": ""} for h, t in (("a", "b"), ("c", "d"), ("b", "c"))]
    assert len(graphs.mask_single(late, set(), compat=True)) == 2 and len(graphs.mask_single(late, set())) == 3
    assert graphs.mask_text("Ada Moss ran", "Ada Moss", "person") == "<Unknown #1 (person)> ran"


def test_deny_list_as_a_table(spark, monkeypatch):
    from citeloom.operators import pages as P

    df = spark.createDataFrame([("http://a.bad.example/x", 1), ("http://good.example/?u=bad.example", 2), ("http://good.example/", 3), (None, 4), ("http://bad.example", 5)], "url string, entry int")
    entries = spark.createDataFrame([("bad.example",), ("",), (None,), ("zzz",), ("bad.example",)], "entry string")
    want = {"http://a.bad.example/x", "http://good.example/?u=bad.example", "http://bad.example"}
    assert {r["url"] for r in P.denied_urls(df, entries).collect()} == want
    monkeypatch.setattr(P, "DENY_BLOCK", 1)
    assert {r["url"] for r in P.denied_urls(df, entries).collect()} == want
    assert P.denied_urls(df, entries.limit(0)).count() == 0
    assert {r["url"]: r["verdict"] for r in P.admitted(df, entries).collect()} == {"http://a.bad.example/x": "ok", "http://good.example/?u=bad.example": "ok", "http://good.example/": "ok", None: "invalid url", "http://bad.example": "bad domain"}


def test_refined_questions(spark):
    df = spark.createDataFrame([(1, "Who ran?", "Who ran the mill?", "Ada Moss"), (2, "Who ran?", "", "Ada"), (3, "Who ran?", "Did Ada Moss run?", "Ada Moss"), (4, "Who ran?", "Who\nran", "x"), (5, "Who ran?", None, "x"), (6, "Who ran?", "What of <Unknown> #1?", "x")], "i int, question string, refined string, gold string")
    got = {r["i"]: r["question"] for r in graphs.refined(df).collect()}
    assert got == {1: "Who ran the mill?", **dict.fromkeys(range(2, 7), "Who ran?")}


def test_combined_graphs(spark):
    kg = [("T", 1, 0, "Ada Moss", "person", "founded", "Old Mill", "mill"), ("T", 2, 0, "Old Mill", "mill", "stands in", "Brock", "town"), ("U", 1, 0, "Eve", "person", "wrote", "Night Song", "book"), ("U", 2, 0, "Night Song", "book", "won", "Reed Prize", "award")]
    edges = spark.createDataFrame(kg, EDGE)
    m = graphs.masked(edges, spark.createDataFrame([], "title string, fact int, node string"))
    kp = spark.createDataFrame([("T", 1, ["Ada Moss founded Old Mill"]), ("T", 2, ["Old Mill stands in Brock"]), ("U", 1, ["Somebody wrote Night Song"]), ("U", 2, ["Night Song won Reed Prize"])], "title string, fact int, keypoints array<string>")
    got = sorted((r["title"], r["edge_idx"], r["head"], r["tail"], r["masked_keypoints"]) for r in graphs.combined(m, kp, graphs.two_hop(m)).collect())
    said = "<Unknown #1 (person)> founded <Unknown #2 (mill)>\n<Unknown #2 (mill)> stands in Brock"
    assert got == [("T", 0, "<Unknown> #1", "<Unknown> #2", said), ("T", 1, "<Unknown> #2", "Brock", said)]


def test_bad_nodes(spark):
    kg = [("T", 1, 0, "Ada Moss", "p", "met", "Bo and Cy", "p", [0], [0]), ("T", 1, 1, "Ada Moss Junior", "p", "saw", "rowed the lake", "x", [0, 1], [0]), ("T", 1, 2, "Dee", "p", "met", "Eve", "p", [0, 1], [0])]
    edges = spark.createDataFrame(kg, EDGE + ", head_coverage array<int>, tail_coverage array<int>")
    kp = spark.createDataFrame([("T", 1, ["Ada Moss met Bo and Cy, Dee met Eve", "Ada Moss Junior rowed the lake"])], "title string, fact int, keypoints array<string>")
    assert {r["node"] for r in graphs.bad_nodes(edges, kp).collect()} == {"Ada Moss", "Ada Moss Junior", "Bo and Cy", "rowed the lake", "Dee", "Eve"}
    assert graphs.leaks("Who is <Unknown> #1?", "x") and graphs.leaks("Who was Ada Moss?", "Ada Moss") and not graphs.leaks("Who wrote it?", "Ada Moss")
    e = [{"head": "Ada", "head_type": "p", "relation": "met", "tail": "Bo", "tail_type": "p"}]
    assert graphs.complete(e, ["Ada met Bo"], lambda a, b: True, lambda t: t.lower().split()) and not graphs.complete(e, ["quite other words"], lambda a, b: True, lambda t: t.lower().split())
    assert graphs.statements(e + e) == ["Ada met Bo", "Ada is a p", "Bo is a p"]


def test_citations_and_sections(spark):
    raw = spark.createDataFrame([("T", 1, ["http://x.example/a.pdf", "http://y.example", "http://z.example"], [0, 1, 2])] * 2, "title string, fact int, citation_urls array<string>, pos array<int>")
    c = pages.citations(raw)
    assert [r[-1] for r in rows(pages.renumbered(c))] == [0, 1] and [r[-1] for r in rows(pages.renumbered(c, strict=True))] == [1, 2]
    s = spark.createDataFrame([("T", 0, "Lead."), ("T", 1, "SECTION: A"), ("T", 2, "One."), ("T", 3, "Two.")], "title string, sent_idx int, extracted string")
    got = {r["sent_idx"]: r for r in pages.section_context(s).collect()}
    assert got[3]["context"] == "SECTION: A One. Two." and got[3]["lead"] == "Lead."
    q = spark.createDataFrame([("T", 1, 0, "a", "B. yes"), ("T", 1, 1, "b\n", "B."), ("T", 1, 2, "c", "B.")], "title string, fact int, question_no int, question string, reply string")
    assert [r["question"] for r in pages.answerable(q).collect()] == ["a"]
    with pytest.raises(ValueError):
        pages.wiki_pages(s, None)
    rate = spark.createDataFrame([("d", 1, 0.0), ("d", 2, 1.0), ("d", 3, 20.0)], "k string, id int, at double")
    assert [r["slot"] for r in pages.rate_slots(rate, "k", "at", "id").orderBy("id").collect()] == [0.0, 6.0, 20.0]


def test_sample_brings_twins(spark):
    b = spark.createDataFrame([("P--1--2", "a"), ("P--1--1", "b"), ("Q--1--2", "a"), ("~P--1--1", "c"), ("~P--2--1", "c"), ("R--1--1", "b")], "_id string, bin string")
    got = {r[0] for r in assembly.stratified_sample(b, 10, 1).collect()}
    assert {"P--1--2", "P--1--1", "R--1--1"} <= got and "Q--1--2" not in got and sum(x.startswith("~") for x in got) == 1
    assert assembly.stratified_sample(b, 1, 1).count() <= 2
    assert assembly.hashed_sample(b, "_id", 2).count() == 2
    n = spark.range(10).withColumnRenamed("id", "k")
    assert [r["count"] for r in assembly.shards(n, "k", 3).groupBy("shard").count().orderBy("shard").collect()] == [4, 3, 3]


def test_slices(spark):
    with pytest.raises(ValueError):
        evaluation.predicate("nothing", 1)
    a = spark.createDataFrame([("q", 1, False, ["STEM.X"], "2025", ["en-GB", "de"], ["2024-01-02"], 1.0, 0.0, 0.0, 4)], "_id string, num_hops int, false_premise boolean, topics array<string>, wiki_create_timestamp string, langs array<string>, published_dates array<string>, correct double, incorrect double, not_attempted double, reasoning_tokens int")
    got = {r["split"]: r for r in evaluation.slice_report(a, [{"topic": "STEM"}, {"freshness": 2023}, {"language": "multilingual", "num_hops": 1}], compat_tokens=True).collect()}
    assert got["topic-STEM"]["support"] == 1 and got["freshness-2023"]["support"] == 0 and got["freshness-2023"]["correct"] is None
    assert got["language-multilingual_num_hops-1"]["truthfulness"] == 1 and got["general"]["avg_reasoning_tokens"] == 4


def test_providers(spark):
    df = spark.createDataFrame([(1, "a [KP] b [KP]")], "id int, t string")
    assert providers.generate(df, "echo", F.lit("Answer with a JSON list"), F.col("t")).first()["reply"] == '["a", "b"]'
    assert len(providers.embed(df, "hash", "t", "id", size=8).first()["embedding"]) == 8
    with pytest.raises(ValueError):
        providers.provider("none")

    class Fetch:
        def fetch(self, url):
            if "bad" in url:
                raise OSError("gone")
            return ("text/html", b"<p>x</p>") if "ok" in url else ("image/png", b"")

    urls = spark.createDataFrame([("ok",), ("bad",), ("img",), ("ok",)], "url string")
    assert rows(providers.crawl(urls, Fetch(), lambda kind, body: body.decode())) == [("bad", False, "gone"), ("img", False, "Content type is image/png"), ("ok", True, "<p>x</p>")]


def test_sources_and_sinks(spark, tmp_path):
    q = spark.createDataFrame([("q2", "d", 1), ("q1", "d", 1)], "query_id string, corpus_id string, score int")
    sources.write_qrels(q, str(tmp_path / "q"))
    assert rows(sources.read_qrels(spark, str(tmp_path / "q"))) == [("q1", "d", 1), ("q2", "d", 1)]
    docs = spark.createDataFrame([("a", "", "x\ny", None, "en")], sources.CORPUS)
    sources.write_jsonl(docs, str(tmp_path / "c"))
    assert rows(sources.read_json(spark, str(tmp_path / "c"), sources.CORPUS)) == rows(docs)
    for _ in range(2):
        sources.append_missing(docs, str(tmp_path / "p"), ["_id"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "A b.json").write_text('{"fact":\n 3}')
    assert rows(sources.read_folder(spark, str(tmp_path / "f"), "fact int")) == [(3, "A b")]
    (tmp_path / "o.csv").write_text('id,xml_harvard,date_created\n1,"a \\"b\\"\nc",d\n2,,d\n')
    assert [r["xml_harvard"] for r in sources.read_opinions(spark, str(tmp_path / "o.csv")).collect()] == ['a "b"\nc']


def test_streams(spark, tmp_path):
    rows_ = [(1, "t", "u", True, "x", None, None, "en"), (1, "t", "u", True, "x", None, None, "en"), (2, "t", "u", False, "", "e", None, "en")]
    df = spark.createDataFrame(rows_, streaming.URL_CONTENT.replace(", crawled_at timestamp", "")).withColumn("crawled_at", F.lit("2025-01-01 00:10:00").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    query = streaming.hourly(streaming.page_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["n"], r["n_usable"]) for r in spark.sql("SELECT * FROM hourly").collect()] == [(2, 1)]

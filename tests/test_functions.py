import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import dates, fuzzy, html, text, wiki
from citeloom.functions.urls import admission


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    row = spark.createDataFrame([tuple(values.values()) or ("",)], schema)
    return row.select(column.alias("r")).first()["r"]


def test_words_and_tags(spark):
    assert one(spark, text.split_words(F.col("a")), a="The co-op_shop, (new)!") == ["the", "co", "op", "shop", "new"]
    assert one(spark, text.ref_tags(F.col("a")), a="x[REF-1] y[REF-22]") == ["[REF-1]", "[REF-22]"]
    assert one(spark, text.leading_refs(F.col("a")), a="[REF-1], [REF-2] Then[REF-3].") == ["[REF-1]", "[REF-2]"]
    assert one(spark, text.fact_marks(F.col("a")), a="A rose[REF-1][REF-2] and a fall[REF-3]. Tail") == "A rose [KP] and a fall [KP]"
    assert one(spark, text.fix_et_al(F.col("a")), a="Poe et al. say") == "Poe et al say"
    assert one(spark, text.clean_ascii(F.col("a")), a="Café  ①") == "Cafe 1"
    assert one(spark, text.sentence_tokens(F.col("a")), a="One. Two? 3 more! no.") == ["One.", "Two?", "3 more! no."]


def test_citation_url_prefers_the_archive_only_among_several(spark):
    u = text.citation_url(F.col("a"))
    assert one(spark, u, a="http://a.example http://web.archive.org/b") == "http://web.archive.org/b"
    assert one(spark, u, a="{{cite|url=http://a.example/x|t=1}}") == "http://a.example/x"
    assert one(spark, u, a="none") is None


def test_chunks_cover_every_word(spark):
    words = [str(i) for i in range(1300)]
    got = one(spark, text.token_chunks(F.col("a")), a=" ".join(words))
    assert [len(c.split()) for c in got] == [512, 512, 340] and got[1].split()[0] == "480"
    assert one(spark, text.token_chunks(F.col("a")), a="  ") == []


def test_parsers(spark):
    kp = text.parse_keypoints(F.col("a"), F.col("b"))
    assert one(spark, kp, a='##KEYPOINTS##: ["x", "y"]', b="p [KP] q [KP]") == ["x", "y"]
    assert one(spark, kp, a='["x"]', b="p [KP] q [KP]") is None and one(spark, kp, a="[", b="p [KP]") is None
    graph = 'Knowledge Graph:\n```json\n[{"head":"h","head_type":"t","relation":"r","tail":"l","tail_type":"u"}]\n```'
    assert one(spark, text.parse_graph(F.col("a")), a=graph)[0]["relation"] == "r"
    assert one(spark, text.restore_case(F.col("a"), F.col("b")), a="ada moss", b="By Ada Moss") == "Ada Moss"
    assert one(spark, text.coverage(F.col("a"), F.col("b")), a=["x y", "z", "y"], b="y") == [0, 2]
    assert [one(spark, text.grounded_verdict(F.col("a")), a=x) for x in ("Grounded", "Not Grounded", "?")] == [True, False, False]
    raw = json.dumps({"usage": {"output_tokens_details": {"reasoning_tokens": 7}}})
    assert one(spark, text.reasoning_tokens(F.col("a")), a=raw) == 7 and one(spark, text.reasoning_tokens(F.col("a")), a="no json") == 0
    blocks = json.dumps({"output": {"message": {"content": [{"reasoningContent": {"reasoningText": {"text": "a b c"}}}]}}})
    assert one(spark, text.reasoning_tokens(F.col("a")), a=blocks) == 3
    cited = one(spark, text.case_citations(F.col("a")), a="<em>Doe v. Roe</em>, 12 U.S. 345 (1900)")
    assert tuple(cited[0]) == ("Doe v. Roe", "12", "U.S.", "345")
    assert one(spark, text.render("{a}-{b}", a=F.col("a"), b=F.lit(2)), a="x") == "x-2"
    label = text.slice_label(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))
    assert one(spark, label) == "a-1_b-2"
    assert one(spark, text.run_name(F.col("a"), F.lit(None), F.lit("m"))  , a="d") == "d__m"
    ctx = text.render_contexts(F.array(F.struct(F.lit("a b c").alias("text"), F.lit(None).cast("string").alias("date"))), 2)
    assert one(spark, ctx) == "Context 1:\n```\na b\n```\nDate: unknown"
    edge = F.array(F.struct(*(F.lit(c).alias(n) for c, n in zip("hxrty", ("head", "head_type", "relation", "tail", "tail_type")))))
    assert one(spark, text.render_edges(edge)) == "1. h [x] | r | t [y]"


def test_titles_may_hold_dashes(spark):
    p = one(spark, text.parse_query_id(F.col("a")), a="~A -- B--12--2")
    assert tuple(p) == ("A -- B", 12, 2, True)


def test_admission_order(spark):
    for url, verdict in {None: "invalid url", "x": "invalid url", "http://archive.org/a.pdf": "archive", "http://web.archive.org/web/1/http://a.example": "ok", "http://x.internetarchive.org/": "archive", "https://m.facebook.com/": "bad domain", "https://sub.github.com/": "bad domain", "https://spotify.com/": "bad domain", "https://open.spotify.com/": "ok", "http://blog.example/": "ok", "http://a.example/Music": "ok", "http://Music.example/": "music", "http://a.example/x.PDF": "pdf", "http://a.example/": "ok"}.items():
        assert one(spark, admission(F.col("a")), a=url) == verdict


def test_dates(spark):
    ok = dates.admissible(F.col("a"), F.col("b"))
    for a, b, want in (("2024-01-02", "2024-01-02", True), ("2023-01-01", "2024-01-02", False), (None, "2024-01-02", False), ("31/01/2024", "2024-01-02", False), (None, None, True), ("x", "", True)):
        assert one(spark, ok, a=a, b=b) is want
    assert one(spark, dates.person_phrase(F.col("a")), a="Ada Lee Moss") == "A. L. Moss"
    assert one(spark, dates.person_phrase(F.col("a")), a="ada moss") is None
    assert one(spark, dates.number_phrase(F.col("a")), a="Route 42") == "Route forty-two" and one(spark, dates.number_phrase(F.col("a")), a="1 of 2") is None
    today = F.lit("2026-01-01").cast("date")
    for a, want in {"2025-12-30": "a few days ago", "2019": "7 years ago", "March 3, 2024": "roughly 1 year ago", "Japan": "the country with a red disc on its flag", "things": None}.items():
        assert one(spark, dates.paraphrase(F.col("a"), today), a=a) == want
    assert one(spark, dates.year_phrase(F.lit(2025), F.lit(2026), F.lit(2))) == "1 year from now"


def brute_partial(a, b):
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 100.0 if not b else 0.0
    return max(fuzzy.ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=6), st.lists(st.sampled_from("abcd"), max_size=9))
def test_partial_ratio(a, b):
    assert abs(fuzzy.partial_ratio(a, b) - brute_partial(a, b)) < 1e-9
    if a and "".join(a) in "".join(b):
        assert fuzzy.partial_ratio(a, b) == 100.0


def test_html():
    page = "<html><head><meta property='article:published_time' content='2024-05-06T01:00Z'><script>x</script></head><body><nav>Menu</nav><main><h2>Head</h2><p>One <b>two</b> <a href='u'>three</a>.</p><ul><li>four</li></ul></main><footer>End 2020-01-01</footer></body></html>"
    assert html.read(page) == "Head\n\nOne two three.\n\nfour"
    assert html.clean_markdown(html.read(page, markdown=True)) == "## Head\n\nOne **two** [three](u).\n\n+ four"
    assert html.published(page) == "2024-05-06" and html.published("<p>none</p>") is None
    assert html.read("<div>" * 60 + "deep") == "" and html.read(None) is None and html.read("") == ""


WIKI = """{{Infobox|a={{b}}}}<!-- c -->Lead here is said.<ref name="n">{{cite web|url=http://a.example/1}}</ref>
== One ==
=== Two ===
{| class=x
| cell
|}
First fact stands here,<ref name=n/> and more[[Page|text]] of it.<ref>http://b.example/2.pdf</ref><ref>[http://c.example/3 t]</ref> A bare one.<ref>no url</ref>
== References ==
Gone.<ref>http://d.example/4</ref>"""


def test_wiki_facts():
    got = wiki.page_facts(WIKI)
    assert [(f[2], f[3], f[4]) for f in got] == [
        ("Lead here is said.", ["http://a.example/1"], [0]),
        ("First fact stands here, and moretext of it.", ["http://a.example/1", "http://c.example/3"], [0, 1]),
    ]
    assert got[1][1] == "First fact stands here, [KP] and moretext of it. [KP]"
    assert wiki.sections("== A ==\nx\n=== B ===\ny\n== C ==\nz").count("SECTION: A > B") == 1
    assert wiki.page_facts(None) == [] and wiki.page_facts("") == []
    assert wiki.page_facts("[REF-x] {{unclosed <ref>http://a.example</ref>") == [(0, "", "[REF-x] {{unclosed", ["http://a.example"], [0])]
    assert wiki.drop_nested("a{{b{{c}}d}}e", "{{", "}}") == "ae" and wiki.drop_nested("a{{b", "{{", "}}") == "a{{b"


def test_sentence_lines_keep_digits(spark):
    assert one(spark, text.sentence_lines(F.col("a")), a="0 a 0\n\n 1 b 1 \n2") == ["0 a 0", "1 b 1", "2"]

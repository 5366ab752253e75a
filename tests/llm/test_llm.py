import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import common, langid, lines, mixing, neardup, packing, pages, splitting, tokens, toxicity


def rows(df):
    return sorted(tuple(r) for r in df.collect())


CORPUS = "_id string, title string, text string, published_date string, lang string, line_no int, site string, band string, cls string, slot int, score double"


def corpus(spark, texts):
    """Rows with columns whose names the operators use inside, nulls everywhere else."""
    return spark.createDataFrame([(i, None, t, None, None, None, None, None, None, None, None) for i, t in texts], CORPUS)


# --- 1 ---
TEXT = st.text(alphabet=st.sampled_from("ab. \n。é"), max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(2, 60), st.integers(0, 30))
def test_split_is_a_round_trip(text, limit, overlap):
    got = splitting.split_text(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in got) == text
    assert all(e - s <= limit for s, _, e in got)
    assert all(b - s <= overlap for s, b, _ in got) and got[0][0] == 0
    assert (len(got) == 1) == (len(text) <= limit)


def test_split_prefers_strong_boundaries():
    paragraphs = ["One two three. " * 8 + "End.", "Four five six. " * 9 + "End.", "Seven. " * 10 + "End."]
    text = "\n\n".join(paragraphs)
    cuts = [text[b:e].strip() for _, b, e in splitting.split_text(text, 180, 20)]
    assert cuts == paragraphs
    assert max(len(text[s:e]) for s, _, e in splitting.split_text("x" * 1000, 100, 10)) == 100


def test_split_rows(spark):
    long = "word " * 2000
    df = corpus(spark, [("a", long), ("a", long), ("b", ""), ("c", None), (None, "x"), ("d", "short")])
    got = splitting.split_oversized(df)
    assert {r["_id"] for r in got.filter("n_pieces > 1").collect()} == {"a"}
    assert rows(got.filter("_id <> 'a' OR _id IS NULL").select("piece", "n_pieces")) == [("", 1), ("short", 1), ("x", 1)]
    pieces = got.filter("_id = 'a'").orderBy("piece_no").collect()
    assert "".join(r["piece"][r["overlap_chars"] :] for r in pieces) == long and len(pieces) == pieces[0]["n_pieces"]
    assert splitting.split_oversized(df.limit(0)).count() == 0


# --- 2 ---
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=300), st.integers(1, 12), st.integers(1, 5))
def test_summaries_bound_the_error(stream, counters, parts):
    keys, counts, error = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for part in np.array_split(np.array(stream), parts):
        k, n = np.unique(part, return_counts=True)
        k, n, e = lines.shrink(k, n, counters)
        keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64) if len(at) else counts
        keys, counts, e2 = lines.shrink(keys, counts, counters)
        error += e + e2
    true, got = Counter(stream), dict(zip(keys.tolist(), counts.tolist()))
    assert error <= len(stream) / (counters + 1)
    assert all(got.get(x, 0) <= n <= got.get(x, 0) + error for x, n in true.items())


@pytest.mark.parametrize("counters", [4096, 3])
def test_repeated_lines_against_brute_force(spark, counters):
    rng = random.Random(4)
    docs = [(f"http://{'www.' * (i % 2)}s{i % 3}.example/{i}", "\n".join(rng.choice(["Share  this 5", "share this 77!", "© All", "", " - ", f"own {rng.random()}", "Rare"]) for _ in range(6))) for i in range(90)]
    df = corpus(spark, docs + docs[:9] + [(None, "Share this 1"), ("http://s0.example/x", None)])
    seen, want = defaultdict(set), []
    key = lambda s: " ".join(re.sub(r"[\W_]+", " ", re.sub("[0-9]+", "0", s.lower())).split())
    for i, t in docs:
        for x in t.split("\n"):
            seen[re.search(r"s\d", i)[0], key(x)].add(i)
    for i, t in docs:
        want += [(i, n) for n, x in enumerate(t.split("\n")) if key(x) and len(seen[re.search(r"s\d", i)[0], key(x)]) >= 8]
    got = lines.repeated_lines(df, counters=counters)
    assert rows(got.select("_id", "line_no")) == sorted(want)
    if counters > 3:
        kept = {i: [x for n, x in enumerate(t.split("\n")) if (i, n) not in set(want)] for i, t in docs}
        a = {r["_id"]: r["text"] for r in lines.strip_repeated_lines(df).filter("_id IS NOT NULL AND text IS NOT NULL").collect()}
        assert a == {i: "\n".join(x) for i, x in kept.items()}
        # both ways of dropping lines treat every row alike, those with a null key and those of a key with two texts too
        more = df.unionByName(corpus(spark, [(docs[0][0], docs[1][1] + "\nother"), (None, docs[2][1])]))
        assert sorted(map(str, lines.strip_repeated_lines(more).collect())) == sorted(map(str, lines.strip_repeated_lines(more, broadcast=0).collect()))
    assert lines.repeated_lines(df.limit(0)).count() == 0


def test_site(spark):
    df = spark.createDataFrame([("http://WWW.A.example:80/x",), ("https://m.a.example?q",), ("https://u:p@b.example#f",), ("no url",), (None,)], "u string")
    assert [r[0] for r in df.select(common.site(F.col("u"))).collect()] == ["a.example", "a.example", "b.example", "", ""]


# --- 3, 4 ---
def page_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6)).capitalize()
    prose = lambda: " ".join(f"{word()} said that {word()} went to {word()} before the {word()} came back home again." for _ in range(5))
    out = []
    for i in range(30):
        host = f"paper-{i % 4}.example"
        lines_ = ["Home | News | Sport", f"{word()} and {word()} at {word()}", f"By {word()} {word()}, staff", "2024-01-02 10:00", prose(), "Advertisement", prose(), "You may also like", f"- {word()} looks at {word()}", f"- {word()} sees {word()}", "All rights reserved, paper", "Back to top"]
        out.append((f"k{i}", f"http://{host}/{i}", "\n".join(lines_)))
    out += [(f"e{i}", f"http://paper-{i % 4}.example/e{i}", f"Home | News | Sport\nThis page was not found on the server. Ref: {i}a{i}b{i}c{i}9") for i in range(24)]
    # variables in several notations, which alignment makes out
    out += [(f"slot{i}", f"http://z{i % 2}.example/s{i}", prose() + "\n" + x) for i, x in enumerate(["The {{ author }} wrote {{ title }} here.", "The [INSERT AUTHOR HERE] wrote it.", "The __TITLE__ of [INSERT TITLE HERE] is open.", "It was __AUTHOR__ again.", "A <TITLE GOES HERE> and <AUTHOR GOES HERE> here."])]
    out += [("sic", "http://z.example/8", prose() + "\nHe said it [sic] twice."), ("once", "http://z.example/9", prose() + "\nA line [with one aside] in it."), ("mention", "http://z.example/2", prose() + "\nA placeholder such as {{ name }} is filled in later, he said to them."), ("filler", "http://z.example/3", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.\nUt enim ad minim veniam quis nostrud exercitation ullamco."), ("trace", "http://z.example/4", "Traceback (most recent call last):\n  File \"/a/b.py\", line 3, in f\nKeyError: 'title'")]
    out += [("empty", "http://z.example/5", ""), ("null", None, None), (None, "http://z.example/6", "x"), ("k0", "http://paper-0.example/0", out[0][2])]
    return spark.createDataFrame([("t", k, u, t, None) for k, u, t in out], "tbl string, page_key string, url string, text string, codes string")


def test_pages(spark):
    p = page_rows(spark)
    assert {r["page_key"] for r in pages.residue(p).collect()} == {*(f"slot{i}" for i in range(5)), "filler", "trace", *(f"e{i}" for i in range(24))}
    got = defaultdict(set)
    for r in pages.boilerplate(p).collect():
        got[r["page_key"]].add(r["line_no"])
    assert all(got[f"k{i}"] == {0, 5, 7, 8, 9, 10, 11} for i in range(30)) and "slot0" not in got
    paths = common.cut(pages.page_paths(p))
    joined = {(r["page_key"], tuple(r["dropped"])) for r in pages.judged(paths, broadcast=0).collect()}
    assert joined == {(r["page_key"], tuple(r["dropped"])) for r in pages.judged(paths).collect()}
    body = {r["page_key"]: r["body"] for r in pages.main_body(p).collect()}
    assert body["slot0"] is None and body["k1"].count("\n") == 4 and "Advertisement" not in body["k1"]
    assert pages.boilerplate(p.limit(0)).count() == 0 and pages.residue(p.limit(0)).count() == 0


def test_long_notices_are_templates_too(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6)).capitalize()
    prose = lambda: " ".join(f"{word()} said that {word()} went to {word()} before the {word()} came back home again." for _ in range(5))
    notice = "We and our partners keep data on your device to measure how our pages are used. " * 5 + "You can change your choice at any time."
    many = " ".join(f"Partner {w} of this paper may keep your choice." for w in ("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)))
    p = spark.createDataFrame([("t", f"k{i}", f"http://paper-{i % 3}.example/{i}", "\n".join([f"{word()} at {word()}", "2024-01-02", prose(), notice, prose(), many])) for i in range(30)], "tbl string, page_key string, url string, text string")
    assert len(notice) > 300
    got = defaultdict(set)
    for r in pages.boilerplate(p).collect():
        got[r["page_key"]].add(r["line_no"])
    assert got == {f"k{i}": {3, 5} for i in range(30)}
    mixed = spark.createDataFrame([(*r[:3], r[3].replace(notice, notice + (" This page is kept by the editors of the evening desk." if i % 2 else ""))) for i, r in enumerate(p.collect())], p.schema)
    assert {r["line_no"] for r in pages.boilerplate(mixed).collect()} == {3, 5}


def test_copies_of_an_article_are_one_body(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6)).capitalize()
    said = lambda: f"{word()} said that {word()} went to {word()} before the {word()} came back home again."
    article = [[said() for _ in range(2)] for _ in range(6)]
    out = []
    for i in range(60):
        if i < 25:
            text = [[*x] for x in article]
            text[rng.randrange(6)][rng.randrange(2)] = said()
            lines_ = ["Mill at the old river reopens", *(" ".join(x) for x in text[:3]), "What comes next", *(" ".join(x) for x in text[3:])]
        else:
            lines_ = [f"{word()} at {word()}", *(f"{said()} {said()}" for _ in range(6)), "Send us what you saw at the river and we will look at it."]
        out.append(("t", f"k{i}", f"http://paper-{i % 5}.example/{i}", "\n".join(lines_)))
    out += [("t", f"e{i}", f"http://paper-{i % 5}.example/e{i}", "This page was not found on the server, please go back to the start.") for i in range(20)]
    p = spark.createDataFrame(out, "tbl string, page_key string, url string, text string")
    assert {r["page_key"] for r in pages.residue(p).collect()} == {f"e{i}" for i in range(20)}
    got = {(r["page_key"], r["line_no"]) for r in pages.boilerplate(p).collect()}
    assert got == {(f"k{i}", 7) for i in range(25, 60)}
    assert {r["page_key"] for r in pages.main_body(p).filter("body IS NULL").collect()} == {f"e{i}" for i in range(20)}


def test_residue_in_one_long_line(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6)).capitalize()
    prose = lambda: " ".join(f"{word()} said that {word()} went to {word()} before the {word()} came back home again." for _ in range(5))
    frames = " ".join(f'File "/srv/app/{word()}.py", line {i}, in {word()} return self.{word()}(request)' for i in range(6))
    error = "403 Forbidden. Access denied: your browser sent a request that this server could not accept. Please enable JavaScript and cookies to continue. Checking your browser before you reach the page you are looking for. If the page is temporarily unavailable, please try again later. This session has expired or the page was not found on this server."
    consent = "We keep data on your device so that we and our partners can measure how our pages are used and what you care for. " * 3 + "Choose what you agree to before you go on."
    article = prose() + " The error page of the town said 404 not found, and Voros told readers to try again later. " + prose()
    trace = prose() + " The log had ValueError: twice, they said. " + prose()
    out = [("trace", "Traceback (most recent call last): " + frames + " KeyError: 'title'"), ("frames", frames), ("article", article), ("mention", trace)]
    out += [(f"c{i}", consent) for i in range(24)] + [(f"x{i}", error) for i in range(24)]
    # an error page made of templates that follow each other without a sign
    out += [(f"t{i}", "Error 502") for i in range(24)] + [(f"u{i}", "Your address has been logged by the server of this paper.") for i in range(24)] + [("both", "Error 503 Your address has been logged by the server of this paper.")]
    assert len(frames) > 400 and len(error) > 300
    p = spark.createDataFrame([("t", k, f"http://{k}.example/1", t) for k, t in out], "tbl string, page_key string, url string, text string")
    assert {r["page_key"] for r in pages.residue(p).collect()} == {"trace", "frames", "both", *(f"{k}{i}" for k in "cxtu" for i in range(24))}


def test_residue_of_the_corpus_rests_on_all_its_pages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6)).capitalize()
    prose = lambda: " ".join(f"{word()} said that {word()} went to {word()} before the {word()} came back home again." for _ in range(6))
    notice = "The editors of the evening desk keep this page for the readers of the town. The readers said that the town went home before the editors came back again."
    out = [(f"http://a.example/{i}", f"{prose()}\n{notice}", "xx") for i in range(30)] + [("http://a.example/bare", notice, "xx")]
    spark.createDataFrame(out, "_id string, text string, lang string").write.parquet(f"{tmp_path}/corpus.parquet")
    samples = [("en", "The editors said that the town went to the river before the readers came back home again."), ("de", "Der Verein sagte, dass die Stadt vor dem Abend wieder zum Fluss gehen soll und dort bleibt.")]
    spark.createDataFrame(samples, "lang string, text string").write.parquet(f"{tmp_path}/lang_samples.parquet")
    bad = {r["page_key"] for r in pages.residue(pages.corpus_pages(spark.read.parquet(f"{tmp_path}/corpus.parquet"))).collect()}
    assert bad == {"http://a.example/bare"}
    samples = spark.read.parquet(f"{tmp_path}/lang_samples.parquet")
    loose = {r["_id"] for r in langid.relabelled(spark.read.parquet(f"{tmp_path}/corpus.parquet"), langid.fit(samples)).collect()}
    found = {r["_id"] for r in langid.p5_found(spark, str(tmp_path)).collect()}
    assert bad <= loose and found == loose - bad


def test_slots_are_induced_by_alignment():
    got = dict(pages.align("[insert item.url here]"))
    assert got["[insert\x00here]"] == "item url" and got["[\x00here]"] == "insert item url" and len(pages.align("{{a}}")) == 1


def test_defaults_and_blanks(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6)).capitalize()
    prose = lambda: " ".join(f"{word()} said that {word()} went to {word()} before the {word()} came back home again." for _ in range(6))
    names = ["title", "author", "date"]
    marks = ["{{ %s }}", "[[%s]]", "__%s__", "#%s#"]
    texts = {f"s{i}": f"Sample text\n{marks[i % 4] % names[i % 3]}\n{marks[(i + 1) % 4] % names[(i + 1) % 3]}\n{prose()}" for i in range(12)}
    texts |= {"default": f"Sample text\n{prose()}", "plain": f"{word()} text\n{prose()}", "title": f"Title\n{prose()}\nDate", "mention": f"{prose()}\nA template comes with a placeholder for each part:\n{{{{ title }}}}\n{prose()}"}
    texts |= {f"by{i}": f"{word()}\nBy {word()} {word()}, published here\n{prose()}" for i in range(20)} | {"blank": f"{word()}\nBy , published here\n{prose()}"}
    p = spark.createDataFrame([("t", k, f"http://{k}.example/1", t) for k, t in texts.items()], "tbl string, page_key string, url string, text string")
    assert {r["page_key"] for r in pages.residue(p).collect()} == {*(f"s{i}" for i in range(12)), "default", "blank"}


def test_paths_of_tags(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6)).capitalize()
    said = lambda: " ".join(f"{word()} said, as {word()} did, that {word()} came back home again." for _ in range(4))
    page = lambda: "\n".join(["<html><body>", "<nav><ul class=menu>", *(f"<li><a href='/{i}'>{word()}</a></li>" for i in range(6)), "</ul></nav>", f"<h1>{word()} opens the mill at {word()} again</h1>", "<div class='text'>", *(f"<p>{said()} <b>{word()}</b> agreed, and left.</p>" for _ in range(4)), "</div>", "<!-- note", "end --><div class=side><ul>", *(f"<li><a>{word()} at {word()}</a></li>" for _ in range(5)), "</ul></div></body></html>"])
    p = spark.createDataFrame([("t", f"k{i}", f"http://a.example/{i}", page()) for i in range(6)], "tbl string, page_key string, url string, text string")
    got = defaultdict(set)
    for r in pages.boilerplate(p).collect():
        got[r["page_key"]].add(r["line_no"])
    assert all(got[f"k{i}"] == {*range(2, 8), *range(18, 23)} for i in range(6))
    lines_, paths = pages.untag("<div id=a>one\n<p>two<br>three\n</p>four</div>", "s")
    assert lines_ == ["one", "twothree", "four"] and paths[0] == paths[2] and paths[1][1] == paths[0][0]


def test_passed_on(spark):
    df = spark.createDataFrame([(1, "u", True, "a", None, None), (2, "u", False, "", "e", "d"), (3, "u", False, "", "e", None), (4, "u", None, None, None, "d"), (5, "u", True, "", "x", None)], "crawl_id bigint, url string, accessible boolean, url_content string, error string, published_date string")
    assert rows(pages.passed_on(df).select("page_key", "text")) == [("1", "a"), ("2", "e"), ("5", "x")]


# --- 5 ---
SAMPLES = {
    "en": ["The harbour board counted the birds near the river in early spring.", "Neither the museum nor the library explained why the ledger was left.", "According to the clerk, forty people saw how they sold the old house.", "When the water fell, the workers went back to the mill with their tools."],
    "de": ["Der Hafenrat zählte die Vögel am Fluss im zeitigen Frühjahr.", "Weder das Museum noch die Bibliothek wusste, warum das Buch dort lag.", "Nach Angaben des Schreibers sahen vierzig Leute, wie man das Haus verkaufte.", "Als das Wasser fiel, gingen die Arbeiter mit ihrem Werkzeug zur Mühle zurück."],
    "fr": ["Le conseil du port a compté les oiseaux près de la rivière au printemps.", "Ni le musée ni la bibliothèque n'ont expliqué pourquoi le livre restait là.", "Selon le greffier, quarante personnes ont vu comment on vendait la maison.", "Quand l'eau a baissé, les ouvriers sont revenus au moulin avec leurs outils."],
    "zh": ["港务委员会在早春时节清点了河边的鸟类。", "博物馆和图书馆都没有解释为什么账本留在那里。"],
}


def test_language_models():
    m = langid.train([(k, t) for k, v in SAMPLES.items() for t in v])
    for lang, text in {"en": "The people of the town went to the river with their birds and the old ledger.", "de": "Die Leute gingen mit dem alten Buch zum Fluss und wussten nicht, warum.", "fr": "Les gens de la ville sont revenus à la rivière avec le livre.", "zh": "图书馆在河边的早春时节。"}.items():
        assert langid.identify(text, m)[0] == lang
    mixed = " ".join(SAMPLES["en"]) + "\n" + " ".join(SAMPLES["fr"][:3])
    lang, confidence, segments = langid.identify(mixed, m)
    assert lang == "en" and 0 < confidence < 1 and [(s[0], s[3]) for s in segments] == [("en", 4), ("fr", 3)]
    assert mixed[segments[1][1] : segments[1][2]] == " ".join(SAMPLES["fr"][:3])
    assert langid.identify("", m) == (None, 0.0, []) and langid.identify("12 34", m)[2] == []
    # the distribution over symbols after any context sums to one
    p = m.base.sum(axis=0)
    assert np.allclose(p, 1, atol=1e-4)
    sums = np.zeros(len(m.langs))
    context = m.encode("the")
    for c in range(256):
        s = np.append(context, c).astype(np.uint8)
        q, at = m.base[s].copy(), s
        for k in range(2, langid.ORDER + 1):
            ctx = at[:-1]
            at = m.index()[k][ctx, s[k - 1 :]]
            q[k - 1 :] = q[k - 1 :] * m.backs_[k][ctx] + m.adds_[k][at]
        sums += q[-1]
    assert np.allclose(sums, 1, atol=1e-3)


def test_languages_of_many_texts_at_once(monkeypatch):
    m = langid.train([(k, t) for k, v in SAMPLES.items() for t in v])
    m.index()
    texts = ["", " ", "a", "ab", "The", "İ. x", "12 34", *(t for v in SAMPLES.values() for t in v), *(" ".join(v) + "\n" + " ".join(SAMPLES["fr"]) for v in SAMPLES.values())]
    bits, starts = m.score_all(texts)
    assert len(bits) == sum(len(t.lower()) for t in texts) + 1 and not bits[-1].any()
    for t, at in zip(texts, starts):
        s = m.encode(t)
        for i in range(len(s)):
            # the interpolation written out, from the shortest n-gram to the longest
            q = m.base[s[i]].astype(float)
            for k in range(2, min(langid.ORDER, i + 1) + 1):
                rows = s[i - k + 1]
                for j in range(2, k):
                    rows = m.tables[j][rows, s[i - k + j]]
                q = q * m.backs_[k][rows] + m.adds_[k][m.tables[k][rows, s[i]]]
            assert np.allclose(bits[at + i], -np.log2(q), atol=1e-3)
    want = [langid.identify(t, m) for t in texts]
    assert langid.identify_all(texts, m) == want and langid.identify_all([], m) == []
    # texts in several groups, and bits forgotten in between
    monkeypatch.setattr(langid, "CHUNK", 50)
    monkeypatch.setattr(langid, "REMEMBERED", 20)
    assert langid.identify_all(texts * 3, m) == want * 3


def test_sentences_end_as_by_the_plain_pattern():
    plain = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[”’」』）]*")
    for s in ["One. Two!? \"Three...\" 3.5 a.b.", "他说。”然后！！」走了？ end…", "x.。 y。.", "...", ".\"a", "。.!\u3000", "no end"]:
        assert [m.span() for m in plain.finditer(s)] == [m.span() for m in langid._SENTENCE_END.finditer(s)]
    sent, other = re.compile(r"[.!?…][\"'”’»」)\]]*[^\S\n]+|[。！？]"), re.compile(r"(?:[^\w\s\x01\x03]|_)+")
    for s in ["one. two!?  \"three...\" 3.5 a_b -_- c", "他说。”然后！！」走了？ end… x", "a0f 0a b_0c d0-_e", "_x_ y\x03z"]:
        assert sent.sub("\x01", s) == pages._SENT.sub("\x01", s)
        assert " ".join(other.sub(" ", s).split()) == " ".join(pages._OTHER.sub(" ", s.replace("_", " ")).split())


def test_labels(spark):
    for x, want in {None: None, "": None, "und": None, "N/A": None, "de_AT": "de", "DEU": "de", "German": "de", "zh-CN": "zh", "tlh": "tlh", " en ": "en"}.items():
        assert langid.label_code(x) == want
        assert spark.createDataFrame([(x,)], "l string").select(langid.label(F.col("l")).alias("r")).first()["r"] == want


def test_relabelled(spark):
    m = langid.train([(k, t) for k, v in SAMPLES.items() for t in v])
    en, fr = " ".join(SAMPLES["en"]), " ".join(SAMPLES["fr"])
    data = [("right", en, "en_GB"), ("wrong", en, "fr"), ("missing", fr, None), ("mixed", en + "\n" + fr, "en"), ("null", None, None), (None, en, None), ("empty", "", ""), ("missing", fr, None)]
    df = spark.createDataFrame([(a, b, c, None) for a, b, c in data], "_id string, text string, lang string, language string")
    assert rows(langid.relabelled(df, m)) == [("missing", "fr"), ("mixed", "en"), ("mixed", "fr"), ("wrong", "en")]
    assert langid.languages(df.limit(0), m).count() == 0
    with pytest.raises(ValueError):
        langid.train([])


# --- 6 ---
def jaccard(a, b, k=5):
    sh = lambda t: {tuple(w[i : i + k]) for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - k + 1)}
    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    texts = {}
    for g in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(60)]
        for v in range(5):
            t = list(base)
            for _ in range(v * rng.randint(0, 2)):
                t[rng.randrange(60)] = f"x{rng.randint(0, 99)}"
            texts[f"{g}-{v}"] = " ".join(t)
    texts["copy"] = texts["0-0"].upper()
    texts["short"] = "a b c"
    df = corpus(spark, [*texts.items(), ("0-0", texts["0-0"]), ("none", None), (None, texts["1-0"]), ("e", "")])
    ids = sorted(k for k in texts if k != "short")
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if jaccard(texts[a], texts[b]) >= 0.6}
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()} == want
    membership, links = neardup.near_duplicate_links(df)
    classes = dict(rows(membership))
    assert classes["copy"] == "0-0" and "short" not in classes
    assert {(r["class_a"], r["class_b"]) for r in links.collect()} == {tuple(sorted((classes[a], classes[b]))) for a, b in want if classes[a] != classes[b]}
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["_id"]: r["group_id"] for r in neardup.near_duplicate_groups(df).collect()}
    assert got == {i: find(i) for i in ids} | {"short": "short", "none": "none", "e": "e"}
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0 and neardup.near_duplicate_groups(df.limit(0)).count() == 0


def test_one_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 4)
    base = [f"w{i}" for i in range(80)]
    df = corpus(spark, [(f"d{i:02}", " ".join([*base, f"t{i}"])) for i in range(20)])
    assert neardup.near_duplicate_pairs(df).count() == 190


def test_pairs_of_a_large_class_are_all_there(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CLASS_BLOCK", 16)
    base = " ".join(f"w{i}" for i in range(60))
    df = corpus(spark, [(f"c{i:03}", base.upper() if i % 2 else base) for i in range(70)] + [("near", base + " more words")])
    assert neardup.near_duplicate_pairs(df).count() == 71 * 70 // 2


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2")], "a string, b string")
    got = rows(neardup.components(edges))
    assert {r for _, r in got} == {"n000", "z1"} and len(got) == 63


# --- 7 ---
@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(1, 40))
def test_best_fill_is_the_closest_sum(counts, room):
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * i for s in sums for i in range(n + 1)}
    got = packing.best_fill(counts, room)
    assert all(n <= counts[x] for x, n in got.items())
    assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def test_pack(spark):
    rng = random.Random(7)
    sizes = [rng.choice([7, 7, 7, 7, rng.randint(0, 250)]) for _ in range(300)]
    data = [(i, n) for i, n in enumerate(sizes)] + [(900, None), (901, -3), (0, sizes[0]), (902, 200)]
    df = spark.createDataFrame([(i, None, n, None, None) for i, n in data], "doc_id bigint, text string, n int, rest string, k string")
    got = packing.pack(df, capacity=100, size="n").collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
    want = {i: max(0, n or 0) for i, n in data}
    assert dict(total) == want
    load = Counter()
    for r in got:
        load[r["container"]] += r["n_tokens"]
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    assert len(load) <= -(-sum(want.values()) // 100) + 1
    pieces = Counter(r["doc_id"] for r in got)
    assert all(pieces[i] == max(1, -(-n // 100)) for i, n in want.items())
    assert packing.pack(df.limit(0), capacity=100, size="n").count() == 0


def test_tokens(spark):
    assert tokens.count_tokens(None) == tokens.count_tokens("") == 0
    assert tokens.count_tokens("hello world <|endoftext|>") > 3
    long = "x" * 250_000
    assert tokens.count_tokens(long) > 0


# --- 8 ---
def test_mix(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["river", "stone", "the", "lamp"]) for _ in range(rng.randint(5, 60)))
    docs = [(i, text(), rng.choice(["A", " a", "b", "B ", "c"]), None) for i in range(400)] + [(1000, text(), "d", None), (1001, None, "a", None), (None, "x", "a", None), (1002, "x", None, None), (0, docs0 := "dup", "A", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, slot string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 2), ("c", 0.1, 3), ("none", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix_sources(df, targets, block=32).collect()
    uses = Counter((r["source"], r["doc_id"]) for r in mixed)
    most = {"a": 1, "b": 2, "c": 3}
    assert all(n <= most[s] for (s, _), n in uses.items())
    got = Counter()
    for r in mixed:
        got[r["source"]] += r["n_tokens"]
    whole = sum(got.values())
    have = Counter()
    for (s, i), n in {((r["source"], r["doc_id"])): r["n_tokens"] for r in mixed}.items():
        have[s] += n
    assert have["a"] == got["a"] and all(n <= have[s] * most[s] for s, n in got.items()) and whole
    again = mixing.mix_sources(df.repartition(3), targets, block=32)
    assert len(mixed) > 300
    ranks = {(r["source"], r["rank"]): r["slot"] for r in mixing.slot_ranks(spark.range(1000).select(F.col("id").alias("slot"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source")), run=64).collect()}
    assert [ranks["a", k] for k in range(334)] == list(range(0, 1000, 3))
    report = {r["source"]: r for r in mixing.budget_report(mixing.mix_sources(df, targets, total_tokens=4000, block=32), df, targets, 4000).collect()}
    assert all(r["short"] or abs(r["n_tokens"] - r["n_wanted"]) <= 40 + 3 * 32 for r in report.values()) and report["none"]["short"]
    assert rows(again) == sorted(tuple(r) for r in mixed)
    report = {r["source"]: r for r in mixing.shares(again, targets).collect()}
    assert report["none"]["n_tokens"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    short = mixing.mix_sources(df, targets, total_tokens=10**6, block=32)
    assert {s: max(n for (x, _), n in Counter((r["source"], r["doc_id"]) for r in short.collect()).items() if x == s) for s in most} == most
    assert mixing.mix_sources(df.limit(0), targets).count() == 0 and mixing.mix_sources(df, targets.limit(0)).count() == 0


def test_golden_points_are_even(spark):
    u = np.array([r["u"] for r in spark.range(1000).select(mixing.golden_point(F.col("id")).alias("u")).collect()])
    assert ((u >= 0) & (u < 1)).all() and max(abs((u < e).sum() - 1000 * e) for e in np.linspace(0, 1, 21)) <= 4
    big = spark.range(2**36, 2**36 + 1).select(mixing.golden_point(F.col("id"))).first()[0]
    from fractions import Fraction

    exact = (Fraction(mixing.GOLDEN) * 2**36) % 1
    assert abs(big - float(exact)) < 1e-4


# --- 9 ---
def test_disguises_are_found_as_by_the_plain_patterns():
    rng = random.Random(91)
    signs = "ab1!|@$(+ .-_*#'\n\u0430e\u0301\u00e9\u00b2\u00bd\u4e2d\u306e\u3002;\u20263A\u00b7\U0001d41a\U00020000"
    segment = re.compile(r"[.!?…;]+(?=[\s\"'”’»)]|$)|\n+|[。！？；]+")
    for _ in range(4000):
        s = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert segment.sub("\n", s) == toxicity._SEGMENT.sub("\n", s)
        assert toxicity._LEET.sub(lambda m: toxicity._plain(m[0]), s) == toxicity._letters(s)
        if not toxicity._wide(s):
            assert toxicity._TOKEN_WIDE.findall(s) == toxicity._TOKEN.findall(s)
            assert bool(toxicity._ODD_WIDE.search(s)) == bool(toxicity._ODD.search(s)) and bool(toxicity._TRIPLE_WIDE.search(s)) == bool(toxicity._TRIPLE.search(s))
            assert bool(toxicity._SPACED.search(s)) <= bool(toxicity._MAYBE_SPACED.search(s))


def test_matrix_of_features():
    seg, h = np.array([0, 0, 2, 2, 3]), np.array([5, 9, 5, 7, 8], np.uint64)
    m = toxicity._Matrix(seg, h, 5, np.array([5, 7, 9], np.uint64))
    dense = np.array([[1, 0, 1, 1], [0, 0, 0, 1], [1, 1, 0, 1], [0, 0, 0, 1], [0, 0, 0, 1.0]])
    w, g = np.array([0.5, -2.0, 3.0, 0.25]), np.array([1.0, 2.0, -4.0, 8.0, 0.5])
    assert np.allclose(m.dot(w), dense @ w) and np.allclose(m.back(g), g @ dense)
    none = toxicity._Matrix(seg[:0], h[:0], 2, np.array([5], np.uint64))
    assert none.dot(np.array([1.0, 2.0])).tolist() == [2.0, 2.0] and none.back(np.ones(2)).tolist() == [0.0, 2.0]


def test_disguises():
    for x in ("sh​it", "s h i t", "s-h-i-t", "shhhit", "$h1t", "shіt"):
        assert "shit" in toxicity.normalise(x), x
    assert toxicity.normalise("w***e") == "w*e"
    assert toxicity.normalise("in 1904 18 boats") == "in 1904 18 boats"


def toxic_rows(spark):
    rng = random.Random(9)
    calm = lambda: f"The board of {rng.choice('ABCDEF')}town listed {rng.randint(2, 90)} boats near the {rng.choice(['mill', 'pier', 'hall'])}."
    rude = lambda: rng.choice(["You absolute numbskull, crawl away from here", "Nobody likes you, numbskull, go away", "crawl away you rotten weasel"])
    docs, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        docs.append((i, " ".join(calm() for _ in range(4)) + (" " + rude() + "! " + calm() if bad else ""), "S" if bad else None, None))
        if i % 3 == 0:
            labels += [(i, "a1", " Abusive" if bad else "OK", None), (i, "a1", " Abusive" if bad else "OK", None), (i, "a2", None, None)]
    docs += [(900, None, None, None), (901, "", None, None), (902, "x" * 100_000, None, None)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string, score string"), spark.createDataFrame(labels, "doc_id bigint, annotator string, label string, reviewed_at timestamp")


def test_toxicity_on_rows_without_verdict(spark):
    docs, labels = toxic_rows(spark)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    held = [i for i in range(400) if i % 3]
    hits = {i for i in held if got[i] >= toxicity.THRESHOLD}
    bad = {i for i in held if i % 8 == 0}
    assert len(hits & bad) >= 0.9 * len(bad) and len(hits - bad) <= 0.02 * len(held)
    assert got[900] == got[901] == 0 and len(got) == 403
    assert toxicity.fit(docs, labels.limit(0)).score("anything") < 1e-6
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_verdicts(spark):
    df = spark.createDataFrame([(1, "a", "hate"), (1, "b", "OK"), (2, "a", "adult"), (2, "a", "adult"), (3, "a", "unsure"), (4, "a", "clean "), (None, "a", "hate"), (5, "a", "hate"), (5, "b", "sexual"), (5, "c", "ok")], "doc_id bigint, annotator string, label string")
    assert rows(toxicity.verdicts(df)) == [(2, True, 1), (4, False, 1), (5, True, 3)]

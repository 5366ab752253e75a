"""Text functions as column expressions; everything here stays in the JVM except where a pandas UDF is named."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def tokens(text: Column) -> Column:
    """The canonical tokeniser: runs of letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def split_words(text: Column) -> Column:
    """STR-8: '_' and '-' as blanks, split at white space, outer punctuation gone, lower case; may hold ''."""
    parts = F.split(F.trim(F.regexp_replace(text, r"[_\-\s]+", " ")), " ")
    return F.transform(parts, lambda w: F.lower(F.regexp_replace(w, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")))


@F.pandas_udf(T.StringType())
def clean_ascii(text: pd.Series) -> pd.Series:
    """STR-1, STR-31: compatibility forms decomposed and what is left beyond ASCII dropped; case kept, blanks collapsed."""
    plain = text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())
    return plain.str.replace(r"\s+", " ", regex=True).str.strip()


def fix_et_al(text: Column) -> Column:
    """STR-2"""
    return F.regexp_replace(text, r"et al\.", "et al")


def ref_tags(text: Column) -> Column:
    """STR-3"""
    return F.regexp_extract_all(text, F.lit(r"(\[REF-\d+\])"), 1)


def leading_refs(text: Column) -> Column:
    """STR-4: the tags at the start, each less than 5 characters after the one before."""
    return ref_tags(F.regexp_extract(text, r"^(?:.{0,4}?\[REF-\d+\])+", 0))


# fixed value: what a citation's URL looks like
URL = r"https?://[\p{L}\p{N}_\-.]+(?:\.[a-z]{2,})+(?:/[\p{L}\p{N}_\-.~:/?#\[\]@!$&'()*+,;=%]*)?"


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({URL})"), 1)


def citation_url(text: Column) -> Column:
    """STR-7: of several URLs the first of web.archive.org, else the first; null without any."""
    found = urls(text)
    archived = F.filter(found, lambda u: u.contains("web.archive.org"))
    return F.when(F.size(found) == 0, None).when((F.size(found) > 1) & (F.size(archived) > 0), F.get(archived, F.lit(0))).otherwise(F.get(found, F.lit(0)))


def truncate_words(text: Column, n: int) -> Column:
    """STR-29: the first n words parted by white space."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def sentence_lines(text: Column) -> Column:
    """STR-21: trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_tokens(text: Column) -> Column:
    """STR-22: sentences ending with . ! ? before white space and a capital, a digit or a quotation mark."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[\p{Lu}\d\"'“«])"), lambda s: F.trim(s) != "")


def fact_marks(sentence: Column) -> Column:
    """STR-6: the text before each group of tags (gaps under 5 characters) followed by ' [KP]', tags gone; what follows the last tag is dropped."""
    kept = F.regexp_extract(sentence, r"^(?s:.*)\[REF-\d+\]", 0)
    marked = F.regexp_replace(kept, r"\[REF-\d+\](?:.{0,4}?\[REF-\d+\])*", " [KP] ")
    return F.trim(F.regexp_replace(marked, r"\s+", " "))


def token_chunks(text: Column, size: int = 512, overlap: int = 32) -> Column:
    """STR-24: windows of `size` white space tokens, each beginning with the last `overlap` of the one before; none for an empty text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    n, step = F.size(words), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")))
    return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def token_truncate(text: Column, n: int) -> Column:
    """STR-23 with white space tokens."""
    return truncate_words(text, n)


def count_tokens(text: Column) -> Column:
    """STR-27 with white space tokens."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def render(template: str, **values: Column) -> Column:
    """STR-18: {name} replaced one after the other; null counts as ''."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def render_contexts(contexts: Column, words: int = 5000) -> Column:
    """STR-19: 'Context i:' with the first `words` words and the date of each struct<text,date>."""
    return F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("Context "), (i + 1).cast("string"), F.lit(":\n```\n"), truncate_words(c["text"], words), F.lit("\n```\nDate: "), F.coalesce(c["date"], F.lit("unknown")))), "\n\n")


def query_id(title: Column, fact: Column, hops: Column, false_premise: Column) -> Column:
    """STR-28: [~]title--fact--hops"""
    return F.concat(F.when(false_premise, "~").otherwise(""), F.concat_ws("--", title, fact.cast("string"), hops.cast("string")))


def parse_query_id(qid: Column) -> Column:
    """STR-28, read from the right so that a title may hold '--'."""
    m = lambda i: F.regexp_extract(qid, r"^(~?)(.*)--(\d+)--(\d+)$", i)
    return F.struct(m(2).alias("title"), m(3).try_cast("int").alias("fact"), m(4).try_cast("int").alias("hops"), (m(1) == "~").alias("false_premise"))


# fixed values: names that differ from the code's own language
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "ru": "Russian", "zh": "Chinese", "ja": "Japanese", "ar": "Arabic", "pl": "Polish", "zh-cn": "Simplified Chinese", "zh-tw": "Traditional Chinese", "pt-br": "Brazilian Portuguese", "en-gb": "British English"}


def language_name(code: Column) -> Column:
    """STR-25: the display name, of the base language if the variant has none, else the code."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    key = F.lower(F.replace(code, F.lit("_"), F.lit("-")))
    return F.coalesce(table[key], table[F.split(key, "-")[0]], code)


def strip_punctuation(text: Column) -> Column:
    """STR-10: lower case without outer punctuation."""
    return F.regexp_replace(F.lower(text), f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")


def rule_verdict(prediction: Column, gold: Column) -> Column:
    """STR-11: CORRECT, INCORRECT or NOT_ATTEMPTED where a rule decides, null where a judge has to."""
    idk = prediction.contains("I don't know") | prediction.contains("I don’t know")
    false_premise = F.lower(prediction).contains("false premise question")
    return (
        F.when(strip_punctuation(prediction) == strip_punctuation(gold), "CORRECT")
        .when(idk, "NOT_ATTEMPTED")
        .when(false_premise, F.when(F.lower(gold) == "false premise question", "CORRECT").otherwise("INCORRECT"))
    )


def judge_verdict(reply: Column, compat: bool = False) -> Column:
    """STR-12: the verdict that a judge's reply gives. compat looks for the letters anywhere; else a whole label or a leading letter counts."""
    if compat:
        return F.when(reply.contains("A"), "CORRECT").when(reply.contains("B"), "INCORRECT").when(reply.contains("C"), "NOT_ATTEMPTED").otherwise("INCORRECT")
    s = F.upper(F.trim(reply))
    letter = F.regexp_extract(s, r"^[^A-Z]*([ABC])\b", 1)
    return (
        F.when(s.contains("NOT_ATTEMPTED") | s.contains("NOT ATTEMPTED") | (letter == "C"), "NOT_ATTEMPTED")
        .when(s.contains("INCORRECT") | (letter == "B"), "INCORRECT")
        .when(s.contains("CORRECT") | (letter == "A"), "CORRECT")
        .otherwise("INCORRECT")
    )


def grounded_verdict(reply: Column) -> Column:
    """STR-13: 'Not Grounded' is looked for first; neither gives false."""
    return F.when(reply.contains("Not Grounded"), False).otherwise(F.coalesce(reply.contains("Grounded"), F.lit(False)))


def parse_keypoints(reply: Column, marked: Column) -> Column:
    """STR-14: the JSON list after an optional heading; null unless it has as many entries as the fact has [KP] marks."""
    listed = F.from_json(F.trim(F.regexp_replace(reply, r"^\s*##KEYPOINTS##:", "")), "array<string>")
    marks = F.size(F.split(marked, r"\[KP\]")) - 1
    return F.when(F.size(listed) == marks, listed)


EDGES = "array<struct<head:string,head_type:string,relation:string,tail:string,tail_type:string>>"


def parse_graph(reply: Column) -> Column:
    """STR-15: a JSON list of edges, after an optional heading and inside an optional fence; null if unreadable."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"^\s*Knowledge Graph:\s*", ""), r"^\s*```(?:json)?|```\s*$", "")
    return F.from_json(F.trim(bare), EDGES)


def restore_case(name: Column, source: Column) -> Column:
    """STR-16: name as it is written where source first has it in any case; else as it is."""
    at = F.locate_col(F.lower(source), F.lower(name)) if hasattr(F, "locate_col") else F.position(F.lower(name), F.lower(source))
    return F.when(at > 0, F.substring(source, at, F.length(name))).otherwise(name)


def coverage(keypoints: Column, node: Column) -> Column:
    """STR-17: the indexes from 0 of the keypoints that hold node."""
    hits = F.transform(keypoints, lambda k, i: F.when(k.contains(node), i))
    return F.filter(hits, lambda i: i.isNotNull())


def render_edges(edges: Column) -> Column:
    """STR-33: 'i. head [type] | relation | tail [type]' per line."""
    return F.array_join(F.transform(edges, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["head"], F.lit(" ["), e["head_type"], F.lit("] | "), e["relation"], F.lit(" | "), e["tail"], F.lit(" ["), e["tail_type"], F.lit("]"))), "\n")


def reasoning_tokens(raw: Column) -> Column:
    """JSON-1: usage.output_tokens_details.reasoning_tokens, else the tokens of the first reasoning block, else 0."""
    v = F.try_parse_json(raw)
    counted = F.try_variant_get(v, "$.usage.output_tokens_details.reasoning_tokens", "int")
    said = F.try_variant_get(v, "$.output.message.content[0].reasoningContent.reasoningText.text", "string")
    return F.coalesce(counted, F.when(said.isNotNull(), count_tokens(said)), F.lit(0))


def case_citations(text: Column) -> Column:
    """STR-30: (name, volume, reporter, page) of '<em>name</em>, volume reporter page'."""
    pattern = r"<em>([^<]+)</em>,?\s+(\d+)\s+([A-Z][A-Za-z0-9. ]*?)\s+(\d+)"
    part = lambda i: F.regexp_extract_all(text, F.lit(pattern), i)
    return F.arrays_zip(part(1).alias("name"), part(2).alias("volume"), part(3).alias("reporter"), part(4).alias("page"))


def slice_label(conditions: Column) -> Column:
    """STR-32: 'k-v' of a map, in order of keys, joined by '_'."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(conditions)), lambda e: F.concat_ws("-", e["key"], e["value"])), "_")


def run_name(*parts: Column) -> Column:
    """SNK-7: parts joined by '__', nulls left out."""
    return F.concat_ws("__", *parts)

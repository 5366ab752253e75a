"""Knowledge graphs of a fact: bad nodes, masking, two-hop joins, completeness (GR-1 to GR-9, JOIN-4, JOIN-17, JOIN-18, AGG-11, AGG-12).

Edge tables are long: (title, fact, edge_idx, head, head_type, relation, tail, tail_type, head_coverage, tail_coverage). A fact has tens of edges,
so the stateful masking takes them as one row, many facts to an Arrow batch; everything relational stays declarative.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fuzzy import partial_ratio, stems, word_partial_ratio, words

KEY = ["title", "fact"]
UNKNOWN = "<Unknown> #{}"
# fixed values: signs of several things under one name (looked for anywhere in it)
PLURAL = ("and", "&", "et al", "et. al", "etal", " + ", " plus ", " with ")
SIMILAR = 75.0


def proper_noun(name: str) -> bool:
    """GR-3, offline: at least three quarters of the words begin with a capital or a digit."""
    parts = name.split()
    return bool(parts) and sum(p[:1].isupper() or p[:1].isdigit() for p in parts) >= 0.75 * len(parts)


def valid_edges(edges: DataFrame) -> DataFrame:
    """GR-1"""
    return edges.filter("head <> '' AND tail <> ''")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(*KEY, F.explode(F.array("head", "tail")).alias("node")).distinct()


def overlapping(edges: DataFrame) -> DataFrame:
    """JOIN-17: both nodes of each pair of one fact whose word-level partial ratio is at least SIMILAR."""
    n = nodes(edges)
    pairs = n.join(n.withColumnRenamed("node", "other"), KEY).filter("node < other")
    close = pairs.filter(word_partial_ratio(F.col("node"), F.col("other")) >= SIMILAR)
    return close.select(*KEY, F.explode(F.array("node", "other")).alias("node")).distinct()


def relation_like(edges: DataFrame) -> DataFrame:
    """JOIN-18: nodes that read like a relation of their fact."""
    pairs = nodes(edges).join(edges.select(*KEY, "relation").distinct(), KEY)
    return pairs.filter(word_partial_ratio(F.col("node"), F.col("relation")) >= SIMILAR).select(*KEY, "node").distinct()


def non_exclusive(edges: DataFrame) -> DataFrame:
    """AGG-12: all heads of a relation with several heads, all tails of one with several tails."""

    def many(side: str) -> DataFrame:
        sets = edges.groupBy(*KEY, "relation").agg(F.collect_set(side).alias("s"))
        return sets.filter(F.size("s") > 1).select(*KEY, F.explode("s").alias("node"))

    return many("head").union(many("tail")).distinct()


def bad_nodes(edges: DataFrame, keypoints: DataFrame) -> DataFrame:
    """GR-2, SET-1: (title, fact, node) by any of the seven rules. keypoints: (title, fact, keypoints ARRAY)."""
    n = nodes(edges)
    plural = F.lit(False)
    for sign in PLURAL:
        plural = plural | F.col("node").contains(sign)
    proper = F.pandas_udf(lambda s: s.map(proper_noun), "boolean")
    with_kp = n.join(keypoints, KEY, "left")
    missing = ~F.coalesce(F.array_join("keypoints", " ").contains(F.col("node")), F.lit(False))
    uncovered = edges.join(keypoints, KEY).filter(F.col("head_coverage").isNotNull() & (F.size("head_coverage") != F.size("keypoints"))).select(*KEY, F.col("head").alias("node"))
    rules = [n.filter(plural), overlapping(edges), n.filter(~proper("node")), uncovered, relation_like(edges), with_kp.filter(missing).select(*KEY, "node"), non_exclusive(edges)]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r.select(*KEY, "node"))
    return out.distinct()


def bad_of(edges: list[tuple[str, str, str]], keypoints: list[str]) -> set[str]:
    """GR-2 for one graph (head, relation, tail) without coverage indexes, where graphs are rows and a join for each rule would cost more than the graph."""
    names = list(dict.fromkeys(x for h, _, t in edges for x in (h, t)))
    said, split = "\n".join(keypoints), {x: words(x) for x in [*names, *(r for _, r, _ in edges)]}
    like = lambda a, b: partial_ratio(split[a], split[b]) >= SIMILAR
    ends: dict[tuple[str, int], set[str]] = {}
    for h, r, t in edges:
        ends.setdefault((r, 0), set()).add(h)
        ends.setdefault((r, 1), set()).add(t)
    several = {x for group in ends.values() if len(group) > 1 for x in group}
    return {
        x for x in names
        if x in several or x not in said or not proper_noun(x) or any(p in x for p in PLURAL) or any(like(x, r) for _, r, _ in edges) or any(y != x and like(x, y) for y in names)
    }


def spanning_edges(triples: list[tuple[str, str]]) -> set[frozenset]:
    """GR-5: the edges of the tree that Prim's algorithm grows from the first head, unit weights, ties in order of the names."""
    near: dict[str, set[str]] = {}
    for h, t in triples:
        near.setdefault(h, set()).add(t)
        near.setdefault(t, set()).add(h)
    root = triples[0][0]
    seen, tree, heap = {root}, set(), [(root, v) for v in near[root]]
    heapq.heapify(heap)
    while heap:
        u, v = heapq.heappop(heap)
        if v not in seen:
            seen.add(v)
            tree.add(frozenset((u, v)))
            for w in near[v] - seen:
                heapq.heappush(heap, (v, w))
    return tree


def mask_single(edges: list[dict], bad: set[str], number: int = 1, compat: bool = False) -> list[dict] | None:
    """GR-4: edges rotated to begin at the first good head, that head replaced by '<Unknown> #n', pruned to a tree; None without a good head.

    compat prunes after each appended edge, so an edge that connects only later is lost; else once at the end.
    """
    start = next((i for i, e in enumerate(edges) if e["head"] not in bad), None)
    if start is None:
        return None
    root, mark = edges[start]["head"], UNKNOWN.format(number)
    out: list[dict] = []

    def prune(rows: list[dict]) -> list[dict]:
        tree = spanning_edges([(r["head"], r["tail"]) for r in rows])
        return [r for r in rows if frozenset((r["head"], r["tail"])) in tree]

    for e in edges[start:] + edges[:start]:
        out.append(e | {"head_unmasked": e["head"], "tail_unmasked": e["tail"], "head": mark if e["head"] == root else e["head"], "tail": mark if e["tail"] == root else e["tail"]})
        if compat:
            out = prune(out)
    return out if compat else prune(out)


MASKED = "title string, fact int, edge_idx int, head string, head_unmasked string, head_type string, relation string, tail string, tail_unmasked string, tail_type string"


def masked(edges: DataFrame, bad: DataFrame, compat: bool = False) -> DataFrame:
    """GR-4 for every fact: MASKED; facts without a good head give no row."""
    marks = bad.groupBy(*KEY).agg(F.collect_set("node").alias("bad"))
    columns = ["head", "head_type", "relation", "tail", "tail_type"]
    # a fact's edges travel as one row, so that an Arrow batch holds many facts
    rows = valid_edges(edges).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("edge_idx", *columns))).alias("edges")).join(marks, KEY, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for title, fact, own, known in zip(b["title"], b["fact"], b["edges"], b["bad"]):
                got = mask_single([{c: e[c] for c in columns} for e in own], set(known) if known is not None else set(), compat=compat) or []
                out += [(title, fact, i, e["head"], e["head_unmasked"], e["head_type"], e["relation"], e["tail"], e["tail_unmasked"], e["tail_type"]) for i, e in enumerate(got)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in MASKED.split(", ")])

    return rows.mapInPandas(run, MASKED)


def mask_text(text: str, node: str, kind: str, number: int = 1) -> str:
    """The spelling used in keypoints: '<Unknown #1 (type)>'."""
    return text.replace(node, f"<Unknown #{number} ({kind})>")


def two_hop(masked_edges: DataFrame) -> DataFrame:
    """JOIN-4: (title, fact, aux_fact) for facts with an edge of masked head whose tail is the masked head of another fact of the page; the least aux_fact.

    Heads of similar types are turned away.
    """
    mark = UNKNOWN.format(1)
    left = masked_edges.filter(F.col("head") == mark).select("title", "fact", F.col("tail").alias("node"), F.col("tail_type").alias("kind"), F.col("head_type").alias("left_type"))
    right = masked_edges.filter((F.col("edge_idx") == 0) & (F.col("head") == mark)).select("title", F.col("fact").alias("aux_fact"), F.col("head_unmasked").alias("node"), F.col("head_type").alias("kind"))
    pairs = left.join(right, ["title", "node", "kind"]).filter("fact <> aux_fact").filter(word_partial_ratio(F.col("left_type"), F.col("kind")) < SIMILAR)
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("title", "fact").orderBy("aux_fact"))).filter("r = 1").select("title", "fact", "aux_fact", "node")


def combined(masked_edges: DataFrame, keypoints: DataFrame, pairs: DataFrame) -> DataFrame:
    """GR-9: both graphs of each pair (title, fact, aux_fact) as one, with its two masked nodes: MASKED plus aux_fact, num_hops and masked_keypoints.

    Heads and tails get their names back, the bad nodes of the joint graph are found anew, and a pair goes if one of its two nodes is among
    them. keypoints: (title, fact, keypoints ARRAY); those of both facts count.
    """
    own = masked_edges.drop("head", "tail").withColumnRenamed("head_unmasked", "head").withColumnRenamed("tail_unmasked", "tail")
    first = masked_edges.filter("edge_idx = 0").select("title", "fact", F.col("head_unmasked").alias("node"), F.col("head_type").alias("kind"))
    two = pairs.select("title", "fact", "aux_fact").join(first.withColumnRenamed("node", "node_1").withColumnRenamed("kind", "kind_1"), KEY)
    two = two.join(first.select("title", F.col("fact").alias("aux_fact"), F.col("node").alias("node_2"), F.col("kind").alias("kind_2")), ["title", "aux_fact"])
    left = two.join(own, KEY).withColumn("side", F.lit(0))
    right = two.join(own.withColumnRenamed("fact", "aux_fact"), ["title", "aux_fact"]).withColumn("side", F.lit(1))
    edges = left.unionByName(right)
    kp = keypoints.select("title", F.col("fact"), "keypoints")
    joint = two.join(kp, KEY, "left").withColumnRenamed("keypoints", "kp_1").join(kp.select("title", F.col("fact").alias("aux_fact"), F.col("keypoints").alias("kp_2")), ["title", "aux_fact"], "left")
    text = F.array_join(F.concat(F.coalesce("kp_1", F.array().cast("array<string>")), F.coalesce("kp_2", F.array().cast("array<string>"))), "\n")
    # a joint graph has tens of edges and travels as one row
    graph = edges.groupBy(*KEY).agg(F.collect_list(F.struct("head", "relation", "tail")).alias("graph"), F.first("node_1").alias("node_1"), F.first("node_2").alias("node_2"))

    @F.pandas_udf("boolean")
    def spoils(graphs: pd.Series, said: pd.Series, one: pd.Series, two_: pd.Series) -> pd.Series:
        return pd.Series([not {a, b}.isdisjoint(bad_of([(e["head"], e["relation"], e["tail"]) for e in g], [t])) for g, t, a, b in zip(graphs, said, one, two_)], dtype="bool")

    spoilt = graph.join(joint.select(*KEY, text.alias("said")), KEY).filter(spoils("graph", "said", "node_1", "node_2")).select(*KEY)
    hide = lambda c: F.when(F.col(c) == F.col("node_1"), UNKNOWN.format(1)).when(F.col(c) == F.col("node_2"), UNKNOWN.format(2)).otherwise(F.col(c))
    named = lambda n: F.concat(F.lit(f"<Unknown #{n} ("), F.col(f"kind_{n}"), F.lit(")>"))
    said = joint.select(*KEY, F.replace(F.replace(text, F.col("node_1"), named(1)), F.col("node_2"), named(2)).alias("masked_keypoints"))
    order = F.row_number().over(Window.partitionBy(*KEY).orderBy("side", "edge_idx")) - 1
    rows = edges.join(spoilt, KEY, "left_anti").join(said, KEY)
    return rows.select("title", "fact", "aux_fact", order.alias("edge_idx"), hide("head").alias("head"), F.col("head").alias("head_unmasked"), "head_type", "relation", hide("tail").alias("tail"), F.col("tail").alias("tail_unmasked"), "tail_type", F.lit(2).alias("num_hops"), "masked_keypoints")


def statement_rows(edges: DataFrame) -> DataFrame:
    """SET-5: (title, fact, statement), the distinct statements of relations and types."""
    said = F.array(F.concat_ws(" ", "head", "relation", "tail"), F.concat_ws(" is a ", "head", "head_type"), F.concat_ws(" is a ", "tail", "tail_type"))
    return edges.select(*KEY, F.explode(said).alias("statement")).distinct()


def complete_graphs(edges: DataFrame, keypoints: DataFrame, verdicts: DataFrame, least: float = 0.5) -> DataFrame:
    """UDF-7, AGG-20: (title, fact, covered, failed, complete) of every fact with edges.

    covered: the share of the distinct stems of the keypoints (title, fact, keypoints) that edges have; failed: the most statements of one relation
    that a judge turned down (verdicts: title, fact, relation, tail, ok). Complete needs `least` of the one and at most one of the other.
    """
    said = edges.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "head", "relation", "tail"))), " ").alias("said"))
    words_ = said.join(keypoints, KEY, "left").select(*KEY, stems(F.coalesce("said", F.lit(""))).alias("s"), stems(F.coalesce(F.array_join("keypoints", " "), F.lit(""))).alias("k"))
    failed = verdicts.filter(~F.coalesce("ok", F.lit(False))).groupBy(*KEY, "relation").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.max("n").alias("failed"))
    share = F.when(F.size("k") == 0, 1.0).otherwise(F.size(F.array_intersect("s", "k")) / F.size("k"))
    rows = words_.select(*KEY, share.alias("covered")).join(failed, KEY, "left").withColumn("failed", F.coalesce("failed", F.lit(0)))
    return rows.withColumn("complete", (F.col("covered") >= least) & (F.col("failed") <= 1))


def leaking(question: Column, gold: Column, most: float = 50.0) -> Column:
    """FLT-11, FLT-18: whether a question still holds '<Unknown', or the answer's words to `most` per cent; a null question leaks."""
    return F.coalesce(question.contains("<Unknown") | (word_partial_ratio(gold, question) >= most), F.lit(True))


def refined(questions: DataFrame, most: float = 50.0) -> DataFrame:
    """FLT-18: (.., question): the refined question where it is not empty, without a line feed and doesn't leak the gold answer, else the one before."""
    new = F.col("refined")
    fit = (F.coalesce(F.trim(new), F.lit("")) != "") & ~new.contains("\n") & ~leaking(new, F.col("gold"), most)
    return questions.withColumn("question", F.when(fit, new).otherwise(F.col("question"))).drop("refined")


def relation_counts(edges: DataFrame) -> DataFrame:
    """AGG-11: the most that one relation occurs in a fact."""
    return edges.groupBy(*KEY, "relation").count().groupBy(*KEY).agg(F.max("count").alias("most"))


def node_types(edges: DataFrame, top: int = 100) -> DataFrame:
    """AGG-15, LIM-9: distinct nodes by type, the `top` most frequent types."""
    both = edges.select(F.col("head_type").alias("type"), F.col("head").alias("node")).union(edges.select("tail_type", "tail"))
    return both.groupBy("type").agg(F.countDistinct("node").alias("n_nodes")).orderBy(F.desc("n_nodes"), "type").limit(top)


def statements(edges: list[dict]) -> list[str]:
    """SET-5: the distinct statements of relations and types, in order."""
    out = [s for e in edges for s in (f"{e['head']} {e['relation']} {e['tail']}", f"{e['head']} is a {e['head_type']}", f"{e['tail']} is a {e['tail_type']}")]
    return list(dict.fromkeys(out))


def complete(edges: list[dict], keypoints: list[str], judge: Callable[[str, str], bool], stems: Callable[[str], list[str]], least: float = 0.5) -> bool:
    """UDF-7, AGG-20: the graph covers the keypoints' words to `least`, and at most one statement per relation fails the judge."""
    doc = set(stems(" ".join(keypoints)))
    said = set(stems(" ".join(f"{e['head']} {e['relation']} {e['tail']}" for e in edges)))
    if doc and len(doc & said) / len(doc) < least:
        return False
    failed: dict[str, int] = {}
    for e in edges:
        if not judge(" ".join(keypoints), f"{e['head']} {e['relation']} {e['tail']}"):
            failed[e["relation"]] = failed.get(e["relation"], 0) + 1
    return all(n <= 1 for n in failed.values())


def leaks(question: str, gold: str, most: float = 50.0) -> bool:
    """FLT-11: the question still holds '<Unknown', or the answer's words to `most` per cent."""
    return "<Unknown" in question or partial_ratio(words(gold), words(question)) >= most

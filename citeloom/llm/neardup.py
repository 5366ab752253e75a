"""Problem 6: near-duplicate texts by max-min hashing, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import spread
from .common import WORD, WordHash, cut, drop, mix, read, shingles, signed, written

SHINGLE, LIKENESS, LEAST_WORDS = 5, 0.6, 40
#: Rows of a band and number of bands; a pair of likeness s is missed with probability (1 - s**ROWS)**BANDS: 0.0004 at 0.6.
ROWS, BANDS = 4, 56
#: Signature values kept per document, 16 bits each, to drop unlikely candidates before the exact comparison.
KEPT = 224
#: A bucket is joined in blocks of this many members, so that a hot one is spread over tasks.
BUCKET_BLOCK = 128
#: Members of a class are paired in blocks of this many, so that a class of any size is spread over tasks.
CLASS_BLOCK = 64


def permutations(n: int) -> np.ndarray:
    """n odd multipliers from a fixed sequence."""
    return (mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)).reshape(-1, 1)


def max_min(sh: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the shingles under every permutation: two values for one evaluation."""
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(mult), np.uint64)
    for i in range(0, len(sh), 4096):
        h = sh[i : i + 4096] * mult
        h ^= h >> np.uint64(29)
        low, high = np.minimum(low, h.min(axis=1)), np.maximum(high, h.max(axis=1))
    return np.concatenate([low, high])


def signatures(df: DataFrame, key: str, text: str, k: int, least_words: int, rows: int, bands: int) -> DataFrame:
    """(id, cls, n, bands, sig) of each row with enough words; cls names the sequence of words, n counts the distinct shingles."""
    perms = permutations(-(-rows * bands // 2))
    n_values = 2 * len(perms)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("id", "cls", "n", "bands", "sig")}
            for i, t in zip(b["id"], b["text"]):
                words = WORD.findall(t.lower())
                if len(words) < least_words:
                    continue
                sh = shingles(words, k, memo)
                if not len(sh):
                    continue
                v = max_min(sh, perms)
                m = v[: rows * bands].reshape(bands, rows) if n_values == rows * bands else np.resize(v, rows * bands).reshape(bands, rows)
                h = np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, r])
                out["id"].append(i)
                out["cls"].append(xxhash.xxh3_128_digest(" ".join(words)))
                out["n"].append(len(sh))
                out["bands"].append(signed(h))
                out["sig"].append((mix(v) >> np.uint64(48)).astype("<u2").tobytes())
            yield pd.DataFrame(out)

    rows_ = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return spread(rows_).mapInPandas(run, f"id {kind}, cls binary, n int, bands array<bigint>, sig binary")


def near_duplicates(df: DataFrame, key: str = "_id", text: str = "text", likeness: float = LIKENESS, k: int = SHINGLE, least_words: int = LEAST_WORDS, rows: int = ROWS, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, cls) of the classes of texts with equal words, links (a, b, likeness) between classes, a < b.

    Classes are named by 16 bytes. Every pair of classes with a common band is a candidate; the share of equal values in the two
    signatures (five standard deviations below the threshold) drops the unlikely ones, and the sets of shingles decide exactly. Null keys, null texts and texts
    under least_words words (or under k) take no part; a key that occurs twice with the same text counts once.
    """
    sig = cut(signatures(df, key, text, k, least_words, rows, bands), "sig")
    members = sig.select("id", "cls").distinct()
    classes = cut(sig.groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    spread = classes.select("cls", "n", F.explode("bands").alias("band"))
    sizes = spread.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    hot = cut(spread.join(sizes, "band"), "buckets").withColumn("blocks", F.ceil(F.col("size") / BUCKET_BLOCK).cast("int"))
    left = hot.select("band", F.col("cls").alias("a"), F.col("n").alias("na"), F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"))
    right = hot.select("band", F.col("cls").alias("b"), F.col("n").alias("nb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # sets that differ in size by more than the threshold can't reach it
    bound = F.least("na", "nb") / F.greatest("na", "nb") >= likeness
    candidates = left.join(right, ["band", "block"]).filter("a < b").filter(bound).select("a", "b").distinct()
    n_values = 2 * (-(-rows * bands // 2))
    floor = max(0.0, likeness - 5 * (likeness * (1 - likeness) / n_values) ** 0.5)

    @F.pandas_udf("double")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        p = np.frombuffer(b"".join(x), "<u2").reshape(len(x), -1)
        q = np.frombuffer(b"".join(y), "<u2").reshape(len(y), -1)
        return pd.Series((p == q).mean(axis=1))

    a, b = classes.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), classes.select(F.col("cls").alias("b"), F.col("sig").alias("sb"))
    likely = cut(candidates.join(a, "a").join(b, "b").filter(agree("sa", "sb") >= floor).select("a", "b"), "likely")
    ids = likely.select(F.col("a").alias("cls")).union(likely.select(F.col("b").alias("cls"))).distinct().join(classes.select("cls", "id"), "cls")
    texts = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL").join(ids, "id").select("cls", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for part in batches:
            words = [WORD.findall(t.lower()) for t in part["text"]]
            same = [xxhash.xxh3_128_digest(" ".join(w)) == c for w, c in zip(words, part["cls"])]
            yield pd.DataFrame({"cls": part["cls"][same], "sh": [signed(shingles(w, k, memo)) for w, s in zip(words, same) if s]})

    grams = cut(texts.mapInPandas(sets, "cls binary, sh array<bigint>").dropDuplicates(["cls"]), "shingles")
    common = F.size(F.array_intersect("sh", "sb"))
    exact = likely.join(grams.withColumnRenamed("cls", "a"), "a").join(grams.select(F.col("cls").alias("b"), F.col("sh").alias("sb")), "b")
    links = exact.select("a", "b", common.alias("c"), (F.size("sh") + F.size("sb") - common).alias("u")).select("a", "b", (F.col("c") / F.col("u")).alias("likeness")).filter(F.col("likeness") >= likeness)
    return members, links


def near_duplicate_pairs(df: DataFrame, key: str = "_id", text: str = "text", **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of keys whose texts are alike, those of equal texts among them.

    The pairs are as many as the result has by its definition; near_duplicate_links gives the same in rows that grow with the input where many
    keys share one text. Members of one class are paired in blocks, so that no task has to write the pairs of a large class alone.
    """
    members, links = near_duplicates(df, key, text, **options)
    members = cut(members, "members")
    size = members.groupBy("cls").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / CLASS_BLOCK).cast("int")
    placed = members.join(size, "cls").select("cls", "id", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    # a class is linked to itself, too, where it has more than one member
    every = links.select("a", "b").union(size.filter("size > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    parts_of = size.select("cls", parts.alias("parts"))
    grid = every.join(parts_of.select(F.col("cls").alias("a"), F.col("parts").alias("pa")), "a").join(parts_of.select(F.col("cls").alias("b"), F.col("parts").alias("pb")), "b")
    cells = grid.select("a", "b", "pb", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)).alias("i")).select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("j"))
    x = placed.select(F.col("cls").alias("a"), F.col("part").alias("i"), F.col("id").alias("x"))
    y = placed.select(F.col("cls").alias("b"), F.col("part").alias("j"), F.col("id").alias("y"))
    pairs = cells.join(x, ["a", "i"]).join(y, ["b", "j"]).filter("a <> b AND x <> y OR a = b AND x < y")
    # a key with two texts can be in two classes, and so twice in a pair
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_links(df: DataFrame, key: str = "_id", text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """(membership, links): membership (key, class_id) of every key with enough words, class_id being the least key with the same words;
    links (class_a, class_b, likeness) between classes that are alike, class_a < class_b. No link between different texts is lost."""
    members, links = near_duplicates(df, key, text, **options)
    members = cut(members, "members")
    heads = cut(members.groupBy("cls").agg(F.min("id").alias("head")), "heads")
    named = links.join(heads.select(F.col("cls").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("cls").alias("b"), F.col("head").alias("y")), "b")
    return members.join(heads, "cls").select(F.col("id").alias(key), F.col("head").alias("class_id")), named.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "likeness")


def near_duplicate_groups(df: DataFrame, key: str = "_id", text: str = "text", **options) -> DataFrame:
    """(key, group_id, n_links): each key with the least key of its group and the number of classes its own is linked to.

    Keys without enough words form groups of their own. Groups are the connected components of the links between classes, found by
    alternating large-star and small-star steps on written tables until no edge changes.
    """
    members, links = near_duplicates(df, key, text, **options)
    members, links = cut(members, "members"), cut(links, "links")
    label = components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    full = members.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    heads = full.groupBy("root").agg(F.min("id").alias("group_id"))
    grouped = full.join(heads, "root").join(degree, "cls", "left").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"))
    every = df.select(F.col(f"`{key}`").alias("id")).filter("id IS NOT NULL").distinct()
    return every.join(grouped, "id", "left").select(F.col("id").alias(key), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of the connected component of every node of edges (a, b); raises if it has not ended after `rounds`."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    spark, state = edges.sparkSession, None
    for _ in range(rounds):
        old = written(spark)[-1:] if state is None else written(spark)[-2:]
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m", "u")
        now = cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small")
        drop(spark, old)
        for path in old:
            written(spark).remove(path)
        last, state = state, tuple(now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())
        if state == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(read(spark, sf_dir, "corpus"))


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_links(read(spark, sf_dir, "corpus"))[0]


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = near_duplicate_links(read(spark, sf_dir, "corpus"))[1]
    return links.select("class_a", "class_b", F.round("likeness", 6).alias("likeness"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read(spark, sf_dir, "corpus"))


_SHINGLES = r"""
docs AS (SELECT _id, list_filter(regexp_split_to_array(lower(min(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM corpus WHERE text IS NOT NULL AND _id IS NOT NULL GROUP BY _id),
classes AS (SELECT array_to_string(w, ' ') AS cls, min(_id) AS class_id, any_value(w) AS w FROM docs WHERE len(w) >= 40 GROUP BY 1),
sh AS (SELECT DISTINCT class_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT class_id, w, unnest(range(len(w) - 4)) AS i FROM classes)),
size AS (SELECT class_id, count(*) AS n FROM sh GROUP BY class_id),
common AS (SELECT a.class_id AS class_a, b.class_id AS class_b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.class_id < b.class_id GROUP BY 1, 2),
links AS (SELECT class_a, class_b, c / (x.n + y.n - c) AS likeness FROM common JOIN size x ON x.class_id = class_a JOIN size y ON y.class_id = class_b WHERE c / (x.n + y.n - c) >= 0.6),
members AS (SELECT _id, class_id FROM docs JOIN classes ON array_to_string(docs.w, ' ') = cls)"""

QUERIES = {"p6_found": p6_found, "p6_members": p6_members, "p6_links": p6_links, "p6_groups": p6_groups}
SQL = {
    "p6_members": f"WITH {_SHINGLES} SELECT _id, class_id FROM members",
    "p6_links": f"WITH {_SHINGLES} SELECT class_a, class_b, round(likeness, 6) AS likeness FROM links",
    "p6_found": f"""WITH {_SHINGLES}
SELECT least(x._id, y._id) AS id_a, greatest(x._id, y._id) AS id_b FROM links JOIN members x ON x.class_id = class_a JOIN members y ON y.class_id = class_b
UNION ALL SELECT x._id, y._id FROM members x JOIN members y ON x.class_id = y.class_id AND x._id < y._id""",
    "p6_groups": f"""WITH RECURSIVE {_SHINGLES},
edges AS (SELECT class_a AS a, class_b AS b FROM links UNION SELECT class_b, class_a FROM links),
reach(a, b) AS (SELECT class_id, class_id FROM classes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
roots AS (SELECT a AS class_id, min(b) AS group_id FROM reach GROUP BY a),
degree AS (SELECT a AS class_id, count(*) AS n FROM edges GROUP BY a)
SELECT d._id, coalesce(group_id, d._id) AS group_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM (SELECT DISTINCT _id FROM corpus WHERE _id IS NOT NULL) d LEFT JOIN members USING (_id) LEFT JOIN roots USING (class_id) LEFT JOIN degree USING (class_id)""",
}

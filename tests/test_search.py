import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trawl.config import CollectionConfig, ConfigError, SearchOption, SearchQuery, VectorConfig, arms_of
from trawl.functions import dense, stem, text
from trawl.operators import search


def arms(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id string, arm string, weight double, score double, rank int")


def test_rrf_ties(spark):
    rows = [(0, "b", "x", 1.0, .9, 1), (0, "a", "x", 1.0, .1, 2), (0, "a", "y", 1.0, .5, 1), (0, "b", "y", 1.0, .4, 2)]
    assert [r.id for r in search.fuse(arms(spark, rows)).orderBy("place").collect()] == ["b", "a"]
    rows = [r[:4] + (.5,) + r[5:] for r in rows]
    found = search.fuse(arms(spark, rows)).orderBy("place").collect()
    assert [r.id for r in found] == ["a", "b"] and found[0].score == round(1 / 3 + 1 / 4, 6)


def test_linear_of_one(spark):
    assert search.fuse(arms(spark, [(0, "a", "x", .7, 3.0, 1)]), "linear").first().score == .7


def test_fusion_ignores_arm_order(spark):
    rows = [(0, c, arm, w, float(s), r) for arm, w in (("x", 1.0), ("y", .5)) for r, (c, s) in enumerate(zip("abcd", (4, 3, 2, 1)), 1)]
    assert search.fuse(arms(spark, rows)).collect() == search.fuse(arms(spark, rows[::-1])).collect()


def test_group_cap_and_facets(spark):
    rows = [(0, c, "x", 1.0, 9.0 - i, i + 1) for i, c in enumerate("abcdef")]
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "g"), ("d", None), ("e", None)], "id string, group_value string")
    found = search.grouped(search.reciprocal_rank_fusion(arms(spark, rows)), groups, 2, 10).orderBy("place")
    assert [r.id for r in found.collect()] == ["a", "b", "d", "e"]  # f has no value either
    docs = spark.createDataFrame([(c, c < "c", 1.0) for c in "abcdef"], "id string, flag boolean, n double")
    counts = search.facet_counts(arms(spark, rows), docs, {"flag": "flag", "n": "n"}, 1).collect()
    assert sorted((r.field, r.value, r.n) for r in counts) == [("flag", "false", 4), ("n", "1.0", 6)]


def test_dense_zero_and_order(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [3.0, 4.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert {(r.id, r.score) for r in search.dense_scores(v, q).collect()} == {(2, 1.0), (3, .6)}
    assert search.dense_scores(v, q, "euclid").orderBy(F.desc("score")).first().id == 2
    assert v.select(dense.normalised("embedding").alias("x")).collect()[0].x == [0.0, 0.0]


def test_arm_planning():
    config = CollectionConfig("c", (VectorConfig("w", "keyword", ("name", "content")), VectorConfig("d", "dense_custom", dimensions=2)))
    assert [o.weight for _, _, o in arms_of(config, SearchQuery("q"))] == [pytest.approx(1 / 3)] * 3
    assert arms_of(config, SearchQuery("q", (SearchOption("w", "name", 0.0),))) == []
    for bad in (SearchOption("x", "name"), SearchOption("w", "description"), SearchOption("w")):
        with pytest.raises(ConfigError):
            arms_of(config, SearchQuery("q", (bad,)))
    assert SearchQuery("q", limit=10).prefetch == 15 and SearchQuery("q", limit=1).prefetch == 5 and SearchQuery("q", facets=("a",)).prefetch == 50
    for bad in (dict(type="dense_custom"), dict(type="whitespace", top_k=0), dict(type="trigrams", distance="dot"), dict(type="dense_model"), dict(type="wmtr", language="eng"), dict(type="wmtr", document_template="{name}")):
        with pytest.raises(ConfigError):
            VectorConfig("v", **bad)


def model(plain, stems, avgdl, top_k, ratio, tri_weight):
    """The three channels, written out."""
    if not plain:
        return {}
    words = [w for w in plain.split(" ") if w not in set(stems)]
    padded = f" {plain} "
    boost = .5 * min(1, 1 / max(1, math.log10(len(plain))))
    sat = lambda tf: tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(stems) / avgdl))
    word = {p + t: b * sat(n) + (len(t.encode()) / len(plain) * boost if len(t.encode()) >= 3 else 0) for p, b, ts in (("#", 4, words), ("##", 8, stems)) for t, n in Counter(ts).items()}
    tri = {"###" + t: tri_weight * sat(n) for t, n in Counter(padded[i:i + 3] for i in range(len(padded) - 2)).items()}
    k = top_k * ratio // 100
    best = lambda d, m: dict(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:m])
    return best(word, k) | best(tri, top_k - k)


@pytest.mark.parametrize("top_k", [128, 8])
def test_multilevel_vector(spark, top_k):
    texts = ["The Running dogs ran; the dog's café runs!", "", "x", "naïve naïve ﬁne a.b 1,000"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("plain", text.preprocessed(F.col("t")))
    docs = docs.withColumn("stems", stem.stemmed(text.word_tokens(F.col("t")), "en"))
    rows = docs.withColumn("v", text.multilevel_vector(F.col("plain"), F.col("stems"), 50.0, top_k, 80, 1.0)).collect()
    for r in rows:
        want = model(r.plain, r.stems, 50.0, top_k, 80, 1.0)
        got = {x.token: x.weight for x in r.v}
        assert got == pytest.approx(want)


def test_tokens(spark):
    row = spark.createDataFrame([("  A b  don't 3.141 _x a_b .. --",)], "t string").select(
        text.whitespace_tokens(F.col("t")).alias("w"), text.word_tokens(F.col("t")).alias("f"), text.trigram_tokens(F.lit("ab")).alias("g"), text.trigram_tokens(F.lit("")).alias("e")).first()
    assert row.w == ["a", "b", "don't", "3.141", "_x", "a_b", "..", "--"]
    assert row.f == ["a", "b", "don't", "3.141", "_x", "a_b"]
    assert row.g == ["  a", " ab", "ab ", "b  "] and row.e == []


def test_idf_and_average(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a"), (3, "")], "id long, txt string")
    posted = search.postings(docs, text.sparse_vector(text.whitespace_tokens(F.col("txt")), 50.0, 128))
    seen = defaultdict(int)
    for r in posted.collect():
        seen[r.token] += 1
    assert dict(seen) == {"a": 2, "b": 1}

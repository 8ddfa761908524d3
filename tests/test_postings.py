import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from trawl.functions import postings, stem, text
from trawl.operators import search
from trawl.plans import catalog, storage  # noqa: F401

TEXTS = [
    "The Running dogs ran; the dog's café runs!", "", None, "   ", "x", "naïve naïve ﬁne a.b 1,000 don’t 3.14 a_b _ __ -- l·l", "́ _́ été x²½ Ⅳ", "a b c\x1cd \t e\n",
    "emoji 😀 word 😀", "𐐀𐐁 𝟘.𝟙 mixed 𠀀𠀁'𠀂 𝅥", "ΑΣ İstanbul ß STRASSE Straßen", " ".join(f"w{i % 300} w{i % 7} Wörter{i % 150}" for i in range(900)), "abcabcabd" * 60,
]


def docs(spark):
    return spark.createDataFrame([(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(TEXTS)], "id long, txt string, lang string")


def plain(df):
    return sorted((r.id, r.token, r.weight) for r in df.collect())


@pytest.mark.parametrize("top_k", [128, 8, 0])
def test_same_vectors_as_columns(spark, top_k):
    d = docs(spark)
    pre, boost = text.preprocessed(F.col("txt")).alias("plain"), postings.length_boost(text.preprocessed(F.col("txt"))).alias("boost")
    stems = d.withColumn("plain", pre).withColumn("stems", stem.stemmed(text.word_tokens(F.col("txt")), F.col("lang")))
    low = F.lower(F.coalesce("txt", F.lit(""))).alias("low")
    for got, want in (
        (postings.made(d.select("id", pre), postings.whitespace(50.0, top_k)), search.postings(d, text.sparse_vector(text.whitespace_tokens(F.col("txt")), 50.0, top_k))),
        (postings.made(d.select("id", pre), postings.whitespace(5.0, top_k, None, ("the", "w3"))), search.postings(d, text.sparse_vector(text.whitespace_tokens(F.col("txt"), ("the", "w3")), 5.0, top_k))),
        (postings.made(d.select("id", pre), postings.trigrams(50.0, top_k)), search.postings(d, text.sparse_vector(text.trigram_tokens(F.col("txt")), 50.0, top_k))),
        (postings.made(d.select("id", low, "lang"), postings.full_text(50.0, top_k)), search.postings(stems, text.sparse_vector(F.col("stems"), 50.0, top_k))),
        (postings.made(d.select("id", pre, "lang", boost), postings.multilevel(50.0, top_k, 80, 0.5)),
         search.postings(stems, text.multilevel_vector(F.col("plain"), F.col("stems"), 50.0, top_k, 80, 0.5))),
    ):
        assert plain(got) == plain(want)


def test_wanted_tokens_are_of_the_pruned_vector(spark):
    rows, wanted = docs(spark).select("id", text.preprocessed(F.col("txt")).alias("plain")), frozenset(("w3", "wörter149", "abc", "the"))
    for kind in (postings.whitespace, postings.trigrams):
        assert plain(postings.made(rows, kind(50.0, 8, wanted))) == [x for x in plain(postings.made(rows, kind(50.0, 8))) if x[1] in wanted]


def explained(spark, name):
    return catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["wmtr", "fulltext_stem", "tok_whitespace", "tok_trigrams", "df_idf_stats"])
def test_no_lambda_for_each_token(spark, name):
    assert "lambdafunction" not in explained(spark, name)


@pytest.mark.parametrize("name", ["batch_search", "sparse_prefiltered", "sparse_topk", "group_cap", "facets", "sparse_threshold", "default_arms", "group_refetch"])
def test_texts_are_tokenized_once(spark, name):
    assert not re.search(r"ReadSchema: struct<(doc_id|p_partkey)[^>]*(text|p_name):string", explained(spark, name))

"""Odd, empty, repeated and clashing tables through every operator and every stage of the pipeline."""

import pytest
from pyspark.sql import functions as F

from trawl.llm import chat, fingerprint, langid, mixing, near_dedup, packing, pii, quality, secrets, topk

#: Every name that an operator gives a column of its own, beside those of documents.
INTERNAL = ("key kept hubs hub component items holders item at parts shared digest bands n id a b u v m low high row entities terms spans held by term text_key rules clause bits "
            "_text_key _held _entities _terms _spans x bucket block part turn size p whole left certain rate place range ahead hash id_key prefix lang_pred score rejected stat_chars _words").split()
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "one two", "en", None), (4, "one two", "en", None), (None, "one two three four five six", "de", "b"),
       (8, "mail me a@b.example or +1 (555) 555-0100, token=abcdefghijklmnop", "en", "b"), (9, "1234567", None, "c"), (10, "word " * 30_000, "en", "b")]


def frame(spark, rows):
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in INTERNAL])


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0)], "doc_id long, quality int")


OPERATORS = {
    "pii": lambda d: pii.sanitised(d), "secrets": lambda d: secrets.found(d).select("row.*"), "quality": lambda d: quality.scored(d, quality.fit(d, labels(d.sparkSession))),
    "packing": lambda d: packing.pack(d, packing.default_tokenizer()).where("start = 0"), "near_dedup": lambda d: near_dedup.near_duplicates(d),
    "language": lambda d: langid.predict(d, langid.fit(d), ("doc_id", "key")), "mixing": lambda d: mixing.mix(d, carry=("key", "kept", "u")), "fingerprints": lambda d: fingerprint.fingerprints(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(odd, none, name):
    """A row a row, whatever else the table holds, and the user's values as they were."""
    got = OPERATORS[name](odd)
    rows = got.collect()
    assert len(rows) == len(ODD)
    for c in set(got.columns) & set(INTERNAL) & {"pii": set(INTERNAL), "secrets": set(INTERNAL), "mixing": {"key", "kept", "u"}, "language": {"key"}}.get(name, set()):
        assert {r[c] for r in rows} == {f"own {c}"}
    assert OPERATORS[name](none).count() == 0


def test_clashing_columns_of_other_tables(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(c) for c in ("block", "digest", "n_copies", "part", "h0")])
    assert chat.chat_format(turns).first().rendered == "<|user|>\nx\n<|end|>\n"
    vectors = spark.createDataFrame([(50, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in ("id", "x", "is_query", "c", "q", "dim")])
    assert topk.top_k(vectors, 1, is_query=F.col("id") % 50 == 0).first().id == 1


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == "packing" or out.columns == list(corpus_pipeline.COLUMNS)
            n = out.count()
            assert n <= 2 * len(ODD) + 60 and (n == 0) == (docs is none or name == "language_id" and n == 0)


def test_one_row_repeated(spark):
    """A row of many copies: nothing is lost, and no operator but those whose task it is sees them as one."""
    n = 20_000
    docs = spark.range(n, numPartitions=8).select(F.lit(5).cast("long").alias("doc_id"), F.lit("some words of one text").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(22).cast("long").alias("n_chars"))
    packed = packing.pack(docs, packing.default_tokenizer())
    assert packed.agg(F.sum("length")).first()[0] == n * packed.first().doc_tokens
    model = langid.fit(docs)
    assert langid.predict(docs, model).where("lang_pred in ('en', 'und')").count() == n
    mixed = mixing.mix(docs).agg(F.sum("taken"), F.sum("size")).first()
    assert mixed[1] == 5 * n and abs(mixed[0] - 1.5 * mixed[1]) <= mixed[1]
    assert fingerprint.fingerprints(docs).where("near_next = 1").count() == n
    assert near_dedup.near_duplicates(docs).where("kept and component_id = 5").count() == n
    assert quality.fit(docs, labels(spark).withColumn("doc_id", F.lit(5).cast("long"))).intercept is not None

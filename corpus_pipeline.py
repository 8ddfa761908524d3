"""A training corpus from documents: language, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet and read again.

All stages: an empty table gives an empty one; columns beside those of documents go, whatever their names; texts of any
length are read whole; repeated rows are treated one by one but where a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import langid, mixing, near_dedup, packing, pii
from trawl.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of this corpus rejects go: too unlike its languages, null, or without a letter; all, if none has a language to learn from."""
    return langid.accepted(docs.select(*COLUMNS), langid.fit(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays, with all rows of that id; so do those without words, and null ids."""
    return near_dedup.deduplicated(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts, and n_chars follows them; a null text stays null, of 0 characters. No row goes."""
    return pii.sanitised(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document has as many rows as the mix takes copies of it, at most two; rows of equal rank go by id, then size; a null source is a source."""
    mixed = mixing.mix(docs.select(*COLUMNS), carry=("text", "lang", "source", "n_chars"))
    return mixed.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a sequence, as `packing.pack` gives them; a document without text is its end id."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Models and tokenizers aren't SQL; a test holds the result against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs

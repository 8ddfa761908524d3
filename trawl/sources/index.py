"""Persisted postings: a collection's sparse vectors as a table partitioned by a hash of the token.

It is made once, with the collection. A search then reads the partitions of its own tokens only, each sorted by token, so
that row groups without them are skipped too; no text is tokenized again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")


def write(posted: DataFrame, path: str, buckets: int = BUCKETS, files: int = 1) -> None:
    """posted: (token, id, weight). files: how many share a bucket; a token that many documents have is spread over them by id."""
    dealt = posted.withColumn("bucket", _bucket(buckets)).withColumn("_file", F.pmod(F.xxhash64("id"), F.lit(files)))
    dealt = dealt.repartition(buckets * files, "bucket", "_file").sortWithinPartitions("bucket", "token", "id").drop("_file")
    dealt.write.mode("errorifexists").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, queries: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(token, id, weight) of the partitions that hold the queries' tokens (query_id, token, weight)."""
    wanted = [r[0] for r in queries.select(_bucket(buckets)).distinct().collect()]  # at most one number a bucket
    return spark.read.parquet(path).where(F.col("bucket").isin(*wanted)).select("token", "id", "weight")

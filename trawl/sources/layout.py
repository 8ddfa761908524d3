"""How rows lie in partitions, and tables that are kept while the driver runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """df over all cores before costly work on each row, where its files give fewer splits than that.

    A table that is large beside the cluster has more splits and stays as it is read; only a small one is dealt anew.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= per_core * cores else df.repartition(per_core * cores)


def written(df: DataFrame) -> DataFrame:
    """df as a table beside the checkpoints, or in the warehouse, so that what is read twice is made once. It goes when the driver ends."""
    spark = df.sparkSession
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    folder = f"{base}/made-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)

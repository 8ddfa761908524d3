"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes up to which a side is broadcast, as its rows times the width that its caller proves; beyond, both sides are shuffled.
BROADCAST_BYTES = 16 << 20
#: Rows of whole texts that become Python objects at once. Spark cuts what it sends by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
ROWS_AT_ONCE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and the executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _on(spark: SparkSession, path: str):
    """The path and its file system, in the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of executors.

    The tables of an application are in one folder, which goes when its driver ends; `discard` drops one before.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/trawl-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, system = _on(spark, folder)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Drops a written table that nothing reads any more."""
    where, system = _on(df.sparkSession, df.written_to)
    system.delete(where, True)


def few(df: DataFrame, width: int, rows: int | None = None) -> DataFrame:
    """df, a written table, marked for broadcast if its rows of at most so many bytes are few; else left for a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def few_bytes(df: DataFrame, size: Column) -> DataFrame:
    """df, a written table, marked for broadcast if the sum of its rows' sizes is small."""
    return few(df, 1, df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0])


def packed(df: DataFrame) -> DataFrame:
    """df's columns as one column, `row`: what an operator adds beside it clashes with none of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of df (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The batches' rows, at most ROWS_AT_ONCE at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield list(zip(*(c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns)))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

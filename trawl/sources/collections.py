"""Collections as directories of versioned Parquet snapshots, with their configuration as a small JSON file.

    <root>/_collections/<name>.json          the configuration
    <root>/<name>/v=<batch id>/              a snapshot; the largest batch id is the current one
    <root>/_queue/<name>/                    the log of changes, one file or more a request

A snapshot is written beside the current one and becomes current by its name, so readers never see half of it, and a
batch that is replayed rewrites its own version. Paths are Hadoop paths: any file system that Spark reads will do.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from trawl.config import CollectionConfig, ConfigError, MetadataIndex, VectorConfig
from trawl.operators import documents
from trawl.streaming import changelog

SYSTEM = "_"


class Conflict(ConfigError):
    """The collection exists already."""


class NotFound(ConfigError):
    """No such collection or document."""


class Store:
    """One collection's snapshots."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.path = spark, name, f"{root.rstrip('/')}/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith("v=") and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(int(n[2:]) for n in done)

    def read(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise NotFound(f"collection {self.name!r} has no snapshot")
        return self.spark.read.parquet(f"{self.path}/v={versions[-1]}")

    def write(self, docs: DataFrame, version: int | None = None) -> None:
        version = (self.versions() or [-1])[-1] + 1 if version is None else version
        docs.write.mode("overwrite").parquet(f"{self.path}/v={version}")

    def apply(self, changes: DataFrame, batch_id: int, keep: int = 2) -> None:
        """One micro-batch of changes on top of the version before it; version 0 is what the collection began with."""
        before = [v for v in self.versions() if v <= batch_id]
        base = self.spark.read.parquet(f"{self.path}/v={before[-1]}")
        self.write(changelog.merged(base, changes), batch_id + 1)
        for old in self.versions()[:-keep]:
            fs, p = self._fs(f"{self.path}/v={old}")
            fs.delete(p, True)


class Catalog:
    """The collections under a root directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        return Store(self.spark, self.root, "_")._fs(path)

    def _config_path(self, name: str) -> str:
        return f"{self.root}/_collections/{name}.json"

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self._config_path(name))
        return bool(fs.exists(p))

    def list(self) -> list[str]:
        fs, p = self._fs(f"{self.root}/_collections")
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith(SYSTEM))

    def create(self, config: CollectionConfig, docs: DataFrame) -> Store:
        """A collection with the documents' schema and rows (none is fine)."""
        if self.exists(config.name):
            raise Conflict(f"collection {config.name!r} exists")
        store = self.store(config.name)
        store.write(docs, 0)
        fs, p = self._fs(self._config_path(config.name))
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(asdict(config)).encode()))
        out.close()
        return store

    def config(self, name: str) -> CollectionConfig:
        if not self.exists(name):
            raise NotFound(f"no collection {name!r}")
        text = "\n".join(r[0] for r in self.spark.read.text(self._config_path(name), wholetext=True).collect())
        raw = json.loads(text)
        vectors = tuple(VectorConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()} | ({"index_fields": ()} if x["document_template"] else {})) for x in raw["vectors"])
        return CollectionConfig(raw["name"], vectors, tuple(MetadataIndex(**x) for x in raw["metadata_indexes"]), raw["store_content"])

    def store(self, name: str) -> Store:
        return Store(self.spark, self.root, name)

    def docs(self, name: str) -> DataFrame:
        self.config(name)
        return self.store(name).read()

    def drop(self, name: str) -> None:
        self.config(name)
        for path in (f"{self.root}/{name}", f"{self.root}/_queue/{name}", self._config_path(name)):
            fs, p = self._fs(path)
            if fs.exists(p):
                fs.delete(p, True)

    def empty(self, name: str) -> None:
        """All documents and queued changes go; the configuration stays."""
        store = self.store(name)
        store.write(store.read().where(F.lit(False)))
        fs, p = self._fs(f"{self.root}/_queue/{name}")
        if fs.exists(p):
            fs.delete(p, True)

    def stats(self, name: str) -> DataFrame:
        """doc_count and the queue's counts, one row."""
        count = self.docs(name).agg(F.count("*").alias("doc_count"))
        queue = self.queue(name)
        return count if queue is None else count.crossJoin(changelog.queue_info(queue))  # one row each

    def enqueue(self, name: str, changes: DataFrame) -> None:
        """Append to the change log and return; a stream or `Store.apply` takes it from there."""
        self.config(name)
        changes.write.mode("append").parquet(f"{self.root}/_queue/{name}")

    def queue(self, name: str) -> DataFrame | None:
        fs, p = self._fs(f"{self.root}/_queue/{name}")
        return self.spark.read.parquet(f"{self.root}/_queue/{name}") if fs.exists(p) else None

    def queue_stream(self, name: str) -> DataFrame:
        path = f"{self.root}/_queue/{name}"
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(path)

    def upsert(self, name: str, changes: DataFrame) -> None:
        """Apply a batch of changes now."""
        store = self.store(name)
        store.apply(changes, store.versions()[-1])

    def export(self, name: str, path: str) -> None:
        """JSON lines, gzip, without null fields."""
        export(self.docs(name), path)

    def get(self, name: str, ids: list) -> DataFrame:
        return documents.multi_get(self.docs(name), ids)


def export(docs: DataFrame, path: str) -> None:
    stripped(docs).write.mode("errorifexists").option("ignoreNullFields", "true").json(path, compression="gzip")


def without_nulls(value: Column, kind: DataType) -> Column:
    """value without the nulls in its arrays and maps, at any depth; a struct's null fields go when it is written as JSON."""
    if isinstance(kind, ArrayType):
        return F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: without_nulls(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(F.map_filter(value, lambda k, v: v.isNotNull()), lambda k, v: without_nulls(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[without_nulls(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def stripped(docs: DataFrame) -> DataFrame:
    """docs with nothing null within its columns."""
    return docs.select(*[without_nulls(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in docs.schema.fields])


def json_rows(docs: DataFrame) -> DataFrame:
    """(json) of each row, without nulls at any depth."""
    return stripped(docs).select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("json"))


def export_array(docs: DataFrame, path: str, by: str = "id") -> None:
    """The documents by id as one JSON array, in gzip parts that, one after the other in the order of their names, are one file.

    Sorted and written by all executors: gzip files may be joined as they are.
    """
    first = docs.agg(F.min(by)).first()[0]
    rows = stripped(docs).select(F.col(by).alias("_by"), F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("json"))
    number = F.row_number().over(Window.partitionBy("_by").orderBy("json"))
    head = rows.where(F.col("_by").isNull() | (F.col("_by") == F.lit(first))).withColumn("_first", (F.col("_by").isNotNull()) & (number == 1))
    rest = rows.where(F.col("_by") > F.lit(first)).withColumn("_first", F.lit(False))
    lines = head.unionByName(rest).orderBy(F.desc("_first"), F.col("_by").asc_nulls_last(), "json").select(F.concat(F.when(F.col("_first"), "[").otherwise(","), "json").alias("value"))
    ends = docs.sparkSession.createDataFrame([("]",)] if first is not None else [("[",), ("]",)], "value string").coalesce(1)
    lines.union(ends).write.mode("errorifexists").option("compression", "gzip").text(path)


def versions() -> dict[str, str]:
    import platform

    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__}

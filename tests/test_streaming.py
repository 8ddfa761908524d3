import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trawl.config import CollectionConfig, MetadataIndex, VectorConfig
from trawl.sources.collections import Catalog, Conflict, NotFound
from trawl.streaming import changelog, metrics

AT = datetime(2024, 1, 1)
CHANGE = "id string, op string, ts timestamp_ntz, seq long, payload double"
SNAP = "id string, ts timestamp_ntz, payload double"


def changes(spark, rows):
    return spark.createDataFrame([(i, op, AT + timedelta(seconds=s), k, p) for k, (i, op, s, p) in enumerate(rows)], CHANGE)


def test_replay_order_does_not_matter(spark):
    rows = [(random.Random(1).choice("abc") + str(i % 3), "upsert", i, float(i)) for i in range(12)]
    want = sorted(map(tuple, changelog.replayed(changes(spark, rows)).collect()))
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    assert sorted(map(tuple, changelog.replayed(changes(spark, shuffled)).collect())) == want


def test_delete_and_stale(spark):
    base = spark.createDataFrame([("a", AT + timedelta(seconds=5), 1.0), ("b", AT, 2.0)], SNAP)
    batch = changes(spark, [("a", "delete", 5, None), ("b", "upsert", 3, 2.0), ("c", "delete", 9, None), ("d", "upsert", 1, 4.0)])
    fates = {r.id: r.fate for r in changelog.classified(base, batch, ("payload",)).collect()}
    assert fates == {"a": "skipped", "b": "patch", "c": "absent", "d": "insert"}
    assert sorted(r.id for r in changelog.merged(base, batch).collect()) == ["a", "b", "d"]
    # no trace of a delete: an older upsert brings the row back
    gone = changelog.merged(base, changes(spark, [("b", "delete", 8, None)]))
    assert sorted(r.id for r in changelog.merged(gone, changes(spark, [("b", "upsert", 2, 7.0)])).collect()) == ["a", "b"]


def test_equal_times_first_wins(spark):
    assert changelog.newest(changes(spark, [("a", "upsert", 1, 1.0), ("a", "upsert", 1, 2.0)])).first().payload == 1.0


def test_collection_life(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    config = CollectionConfig("c", (VectorConfig("w", "whitespace"),), (MetadataIndex("k", "string"),))
    docs = spark.createDataFrame([("a", AT, 1.0)], SNAP)
    store = catalog.create(config, docs)
    with pytest.raises(Conflict):
        catalog.create(config, docs)
    assert catalog.list() == ["c"] and catalog.exists("c") and catalog.config("c") == config
    batch = changes(spark, [("b", "upsert", 1, 2.0)])
    store.apply(batch, 0)
    store.apply(batch, 0)  # a replayed batch
    assert store.read().count() == 2 and store.versions() == [0, 1]
    assert [r.found for r in catalog.get("c", ["b", "zz"]).collect()] == [True, False]
    catalog.export("c", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    catalog.enqueue("c", changes(spark, [("x", "upsert", 1, 2.0), ("a", "delete", 99, None)]).withColumn("status", F.lit("queued")))
    assert catalog.stats("c").first().asDict()["queued_upsert"] == 1
    stream = changelog.stream_into(catalog.queue_stream("c").drop("status"), Shifted(store), str(tmp_path / "chk"))
    stream.awaitTermination()
    assert sorted(r.id for r in store.read().collect()) == ["b", "x"]
    catalog.empty("c")
    assert catalog.docs("c").count() == 0 and catalog.queue("c") is None
    catalog.drop("c")
    assert not catalog.exists("c")
    with pytest.raises(NotFound):
        catalog.docs("c")


class Shifted:
    """A store whose stream begins after the batches that were applied by hand."""

    def __init__(self, store):
        self.store = store

    def apply(self, batch, batch_id):
        self.store.apply(batch, batch_id + 1)


def test_streamed_minutes_are_in_the_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = metrics.minute_stream(stream, ["event_type"]).writeStream.format("memory").queryName("minutes").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "chk")).start()
    query.awaitTermination()
    got = {(r.window.start, r.event_type, r.n) for r in spark.table("minutes").collect()}
    want = {(r.window.start, r.event_type, r.n) for r in source.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 minute"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got <= want and len(got) >= len(want) - 30


def test_roll_up_keeps_completed_slots(spark):
    fine = spark.createDataFrame([("k", s, 1.0, 1) for s in range(0, 150, 5)], "key string, bucket_start long, value double, n long")
    assert {(r.bucket_start, r.n) for r in metrics.rolled_up(fine, ["key"], 60, F.lit(130)).collect()} == {(0, 12), (60, 12)}
    assert metrics.snapshot(fine, ["key"], F.lit(147), 60).first().n == 12

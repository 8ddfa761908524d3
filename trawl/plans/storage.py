"""Registered queries over stored collections, the queue, indexes and encoders; they join those of `catalog`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.config import CollectionConfig, MetadataIndex, SearchOption, SearchQuery, VectorConfig
from trawl.functions import language, pooling, postings, text
from trawl.operators import documents, search
from trawl.plans import catalog
from trawl.plans.catalog import PART_ARMS_SQL, QUEUE_SQL, query, queue_rows, table
from trawl.sources import collections, index
from trawl.streaming import changelog, metrics


def folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, or in the warehouse; it goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/collections-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return path


# Collections

CONFIG = CollectionConfig("orders", (VectorConfig("ws", "whitespace", ("name",)),), (MetadataIndex("status", "string"),))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents (id, ts, name, meta_status)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("meta_status"))


def made(spark: SparkSession, sf_dir: str, name: str = "orders") -> collections.Catalog:
    found = collections.Catalog(spark, folder(spark))
    found.create(CollectionConfig(name, CONFIG.vectors, CONFIG.metadata_indexes), orders(spark, sf_dir))
    return found


@query("SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS name, o_orderstatus AS meta_status FROM orders")
def collection_create(spark, sf_dir):
    return made(spark, sf_dir).docs("orders")


@query("SELECT 'orders' AS name, 'status' AS indexed, 'ws' AS vector, true AS present, false AS other_present")
def collection_config(spark, sf_dir):
    found = made(spark, sf_dir)
    rows = [(n, found.config(n).metadata_indexes[0].key, found.config(n).vectors[0].name, found.exists(n), found.exists("customers")) for n in found.list()]
    return spark.createDataFrame(rows, "name string, indexed string, vector string, present boolean, other_present boolean")


@query("SELECT CAST(0 AS BIGINT) AS n, true AS there, CAST(0 AS BIGINT) AS listed_after_drop")
def collection_empty_drop(spark, sf_dir):
    found = made(spark, sf_dir)
    found.empty("orders")
    n, there = found.docs("orders").count(), found.exists("orders")
    found.drop("orders")
    return spark.createDataFrame([(n, there, len(found.list()))], "n long, there boolean, listed_after_drop long")


@query(f"SELECT (SELECT count(*) FROM orders) AS doc_count, count(*) FILTER (status = 'queued' AND op = 'upsert') AS queued_upsert, count(*) FILTER (status = 'failed' AND op = 'delete') AS failed_delete, count(*) AS total FROM {QUEUE_SQL}")
def collection_stats(spark, sf_dir):
    found = made(spark, sf_dir)
    found.enqueue("orders", queue_rows(spark, sf_dir))
    return found.stats("orders").select("doc_count", "queued_upsert", "failed_delete", "total")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderpriority END AS name FROM orders WHERE o_orderkey % 5 <> 0""")
def collection_upsert(spark, sf_dir):
    """A batch of upserts and deletes that are later than what is stored, and older ones that change nothing."""
    found, docs = made(spark, sf_dir), orders(spark, sf_dir)
    day = F.expr("interval 1 day")
    new = docs.where("id % 3 = 0 and id % 5 <> 0").withColumn("name", F.lit("changed")).withColumn("ts", F.col("ts") + day).withColumn("op", F.lit("upsert"))
    old = docs.where("id % 3 = 1 and id % 5 <> 0").withColumn("name", F.lit("stale")).withColumn("ts", F.col("ts") - day).withColumn("op", F.lit("upsert"))
    gone = docs.where("id % 5 = 0").withColumn("ts", F.col("ts") + day).withColumn("op", F.lit("delete"))
    found.upsert("orders", new.union(old).union(gone).withColumn("seq", F.col("id")))
    return found.docs("orders").select("id", "name")


@query("SELECT o_orderkey AS id, o_orderpriority AS name, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS status FROM orders")
def export_json_array(spark, sf_dir):
    """What a JSON reader finds in the exported array, null fields left out."""
    path = folder(spark) + "/export"
    docs = orders(spark, sf_dir).select("id", "name", F.when(F.col("meta_status") != "F", F.col("meta_status")).alias("status"))
    collections.export_array(docs, path)
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^[\[,]", "").alias("json")).where("json <> ']'")
    return lines.select(F.from_json("json", "id long, name string, status string").alias("x")).select("x.*")


@query("""SELECT event_id, '{"a":[1,' || (event_id % 3) || '],"k":' || (CASE WHEN event_id % 2 = 0 THEN '{"y":2}' ELSE '{"x":1,"y":2}' END) || '}' AS json FROM events""")
def strip_nulls(spark, sf_dir):
    nested = F.struct(F.array(F.lit(1), F.lit(None).cast("int"), (F.col("event_id") % 3).cast("int")).alias("a"),
                      F.struct(F.when(F.col("event_id") % 2 == 1, 1).alias("x"), F.lit(2).alias("y")).alias("k"), F.lit(None).cast("string").alias("z"))
    events = table(spark, sf_dir, "events").select("event_id", nested.alias("doc"))
    return collections.stripped(events).select("event_id", F.to_json("doc", {"ignoreNullFields": "true"}).alias("json"))


@query("SELECT doc_id AS id, md5(text) AS content_hash, lang AS meta_lang FROM documents")
def store_without_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("content_hash"), F.col("lang").alias("meta_lang"))
    return documents.without_content(docs, F.md5(F.col("content").cast("binary")))


@query("SELECT doc_id AS id, n_chars AS meta_n_chars FROM documents")
def pruned_columns(spark, sf_dir):
    """Hidden columns aren't read, but for one that a group needs."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("meta_lang"), F.col("source").alias("meta_source"), F.col("n_chars").alias("meta_n_chars"))
    return documents.needed_columns(docs, ("content", "metadata"), ("meta_n_chars",))


@query("SELECT item_id, 'find: ' || text AS text FROM benchmark")
def query_template(spark, sf_dir):
    template = documents.query_text("find: {query}", "\x00").split("\x00")
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit(template[0]), "text", F.lit(template[1])).alias("text"))


@query("SELECT event_id, k AS k FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def flatten_wrapped(spark, sf_dir):
    """Plain values and wrapped ones ({"value": v, "type": t}) read alike."""
    k = F.get_json_object("props", "$.k")
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"value":'), k, F.lit(',"type":"integer"}'))).otherwise(k)
    return table(spark, sf_dir, "events").select("event_id", documents.flattened_metadata(F.parse_json(wrapped), "bigint").alias("k"))


# The queue

@query(f"SELECT queue_id, status, try_count FROM {QUEUE_SQL} WHERE id IN ('3', '5')")
def queue_lookup(spark, sf_dir):
    queue = queue_rows(spark, sf_dir)
    return changelog.looked_up(queue, queue.where("id in ('3', '5')"), missing_ok=False).select("queue_id", "status", "try_count")


@query(f"SELECT queue_id, CASE WHEN queue_id % 4 = 1 THEN 'requeued' ELSE status END AS status, CAST(CASE WHEN queue_id % 4 = 1 THEN try_count + 1 ELSE try_count END AS INTEGER) AS try_count FROM {QUEUE_SQL}")
def queue_update(spark, sf_dir):
    queue = queue_rows(spark, sf_dir)
    updates = queue.where("queue_id % 4 = 1").select("queue_id", (F.col("try_count") + 1).alias("try_count"))
    return changelog.with_status(queue, updates, "requeued", "again", F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))).select("queue_id", "status", "try_count")


@query(f"SELECT queue_id FROM {QUEUE_SQL} WHERE NOT (status = 'failed' AND op = 'upsert') AND queue_id % 7 <> 0")
def queue_clear_ack(spark, sf_dir):
    queue = queue_rows(spark, sf_dir)
    left = changelog.cleared(queue, (F.col("status") == "failed") & (F.col("op") == "upsert"))
    return changelog.acknowledged(left, queue.where("queue_id % 7 = 0")).select("queue_id")


@query(f"SELECT queue_id FROM {QUEUE_SQL} WHERE status <> 'failed' AND queue_id % 3 <> 2 AND queue_id % 5 <> 0 AND queue_id % 2 = 0")
def queue_reverify(spark, sf_dir):
    """Claimed entries of which some have gone since, and some were made for a collection that was made anew."""
    queue = queue_rows(spark, sf_dir)
    claimed = queue.withColumns({"collection_name": F.lit("c"), "collection_id": F.col("queue_id") % 2})
    now = spark.createDataFrame([("c", 0)], "collection_name string, collection_id long")
    return changelog.reverified(claimed, queue.where("queue_id % 3 <> 2 and queue_id % 5 <> 0"), now).select("queue_id")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE least(pow(2.0, event_id % 9 - 1), 16.0) END AS wait FROM events")
def idle_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", changelog.idle_wait(F.col("event_id") % 9).alias("wait"))


@query("""WITH d AS (SELECT lang AS slot, doc_id, n_chars FROM documents WHERE lang IS NOT NULL)
SELECT slot, count(*) AS doc_count, round(sum(CASE WHEN doc_id % 3 = 0 THEN n_chars + 10 ELSE n_chars END) / count(*), 4) AS avgdl FROM d GROUP BY slot""")
def incremental_avgdl(spark, sf_dir):
    """Running averages after a batch of new and changed documents, as a scan of all would give."""
    docs = table(spark, sf_dir, "documents").where("lang is not null").select(F.col("lang").alias("slot"), "doc_id", "n_chars")
    old = docs.where("doc_id % 2 = 0").groupBy("slot").agg(F.count("*").alias("doc_count"), F.avg("n_chars").alias("avgdl"))
    length = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 10).otherwise(F.col("n_chars"))
    new = (F.col("doc_id") % 2 != 0)
    updates = docs.select("slot", new.cast("long").alias("new_docs"), F.when(~new & (F.col("doc_id") % 3 == 0), F.col("n_chars")).otherwise(0).alias("old_length"),
                          F.when(new, length).otherwise(0).alias("new_length"), F.when(~new & (F.col("doc_id") % 3 == 0), length).otherwise(0).alias("updated_length"))
    return changelog.updated_averages(old, updates).select("slot", "doc_count", F.round("avgdl", 4).alias("avgdl"))


# Metrics

@query("""SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS hour, count(*) FILTER (r <= 10) AS kept, count(*) FILTER (r > 10) AS dropped
FROM (SELECT *, row_number() OVER (PARTITION BY CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) ORDER BY ts, event_id) AS r FROM events) GROUP BY 1""")
def buffer_overflow(spark, sf_dir):
    events = metrics.buffered(table(spark, sf_dir, "events"), 10, 3600, order=("ts", "event_id"))
    return events.groupBy(metrics.bucket_start(F.col("ts"), 3600).alias("hour")).agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@query(f"SELECT event_type, bucket_start, n FROM {catalog.FIVE_SQL} WHERE bucket_start >= epoch(TIMESTAMP '2024-01-20 00:00:00') - 86400")
def metric_retention(spark, sf_dir):
    return metrics.retained(catalog.five(spark, sf_dir), F.lit(1705708800)).select("event_type", "bucket_start", "n")


# Indexes, groups, encoders

@query(catalog.ORACLES["sparse_topk"])
def indexed_topk(spark, sf_dir):
    """`sparse_topk` from persisted postings: only the partitions of the query's tokens are read."""
    docs, path = catalog.docs_of(spark, sf_dir), folder(spark) + "/postings"
    index.write(search.text_postings(docs, postings.whitespace), path)
    asked = catalog.query_vector(spark, catalog.one_query(spark, catalog.TEXT_QUERY), text.whitespace_tokens)
    scores = search.sparse_scores(index.read(spark, path, asked), asked, docs.count())
    return search.arm(scores, "content_ws", 1.0, 10).select(F.col("id").alias("doc_id"), "score", "rank")


GROUP_SQL = """,
v AS (SELECT a.*, p.p_brand AS g FROM (SELECT query_id, id, 'name_ws' AS arm, 1.0::DOUBLE AS weight, score FROM xs UNION ALL SELECT query_id, id, 'name_tri', 0.5::DOUBLE, score FROM ys) a JOIN part p ON a.id = p.p_partkey),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY score DESC, id) AS pos FROM v) WHERE pos <= 15),
f1 AS (SELECT id, any_value(g) AS g, round(sum(weight / (2 + pos)), 6) AS score, round(sum(score), 6) AS tie FROM r1 GROUP BY id),
k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, tie DESC, id) AS c FROM f1) WHERE c <= 1),
s1 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, tie DESC, id) AS place FROM k1) WHERE place <= 12),
o AS (SELECT (SELECT count(*) FROM s1) >= 12 OR (SELECT max(n) FROM (SELECT count(*) AS n FROM r1 GROUP BY arm)) < 15 AS done),
r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY score DESC, id) AS pos FROM v WHERE g NOT IN (SELECT g FROM s1) AND NOT (SELECT done FROM o)) WHERE pos <= 15),
l AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY round, pos) AS rank FROM (SELECT *, 1 AS round FROM r1 UNION ALL SELECT *, 2 FROM r2 WHERE (arm, id) NOT IN (SELECT (arm, id) FROM r1))),
f2 AS (SELECT id, any_value(g) AS g, round(sum(weight / (2 + rank)), 6) AS score, round(sum(score), 6) AS tie FROM l GROUP BY id),
k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, tie DESC, id) AS c FROM f2) WHERE c <= 1)
SELECT id AS p_partkey, g AS brand, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY score DESC, tie DESC, id) AS place FROM k2) WHERE place <= 12"""


@query(PART_ARMS_SQL + GROUP_SQL)
def group_refetch(spark, sf_dir):
    """One result a brand, from two rounds of bounded prefetches."""
    asked = SearchQuery(catalog.PART_QUERY, (SearchOption("ws", "name", 1.0), SearchOption("tri", "name", 0.5)))
    queries, parts = catalog.one_query(spark, asked.text), catalog.parts_of(spark, sf_dir)
    scores = {"name_ws": (catalog.ws_arm_scores(spark, parts, queries), 1.0), "name_tri": (catalog.tri_arm_scores(spark, parts, queries), 0.5)}
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("group_value"))
    found = search.refetched(scores, brands, group_max=1, limit=12)
    return found.select(F.col("id").alias("p_partkey"), F.col("group_value").alias("brand"), "score", "place")




@query("""WITH t AS (SELECT vec_id, m, d.d, list_transform(range(0, m), lambda i: CAST(e[i * 8 + d.d + 1] AS DOUBLE)) AS x FROM (SELECT vec_id, CAST(vec_id % 8 + 1 AS BIGINT) AS m, embedding AS e FROM embeddings), (SELECT unnest(range(0, 8)) AS d) d)
SELECT vec_id, CAST(d AS INTEGER) AS dim, round(x[1], 6) AS cls, round(list_max(x), 6) AS max, round(list_sum(x) / m, 6) AS mean, round(list_sum(x) / sqrt(m), 6) AS mean_sqrt_len,
  round(list_sum(list_transform(range(1, m + 1), lambda i: x[i] * i)) / (m * (m + 1) / 2), 6) AS weightedmean, round(x[m], 6) AS lasttoken FROM t""")
def pooling_modes(spark, sf_dir):
    """The embeddings as eight tokens of eight numbers, of which the first few are kept."""
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.col("vec_id") % 8).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", pooling.pooled(states, mask, pooling.MODES).alias("v")).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("dim"))
    names = ("cls", "max", "mean", "mean_sqrt_len", "weightedmean", "lasttoken")
    return rows.select("vec_id", "dim", *[F.round(F.get("v", F.col("dim") + 8 * i), 6).alias(n) for i, n in enumerate(names)])


@query("""WITH t AS (SELECT vec_id, d.d, list_max(list_transform(range(0, vec_id % 8 + 1), lambda i: CAST(embedding[i * 8 + d.d + 1] AS DOUBLE))) AS x FROM embeddings, (SELECT unnest(range(0, 8)) AS d) d WHERE d.d <> 3),
r AS (SELECT vec_id, d, ln(1 + x) AS v, row_number() OVER (PARTITION BY vec_id ORDER BY ln(1 + x) DESC, d) AS r FROM t WHERE x > 0)
SELECT vec_id, CAST(d AS INTEGER) AS "index", round(v, 6) AS value FROM r WHERE r <= 4""")
def sparse_model_head(spark, sf_dir):
    """Log-saturated largest logits, without a special id, the four heaviest."""
    states = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.col("vec_id") % 8).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(pooling.sparse_logits(states, mask, (3,), 4)).alias("x"))
    return rows.select("vec_id", "x.index", F.round("x.value", 6).alias("value"))


DETECTED = ("de", "en", "es", "fr")

@query()
def language_at_ingestion(spark, sf_dir):
    code = language.language_code(F.col("text"), detect=True, confidence=0.3, default="xx", languages=DETECTED)
    return catalog.texts(spark, sf_dir).select("doc_id", code.alias("language"))

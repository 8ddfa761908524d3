"""Last-writer-wins ingestion: change rows reduced to a snapshot, in batches or micro-batches; and the queue of changes.

A change row has id, op ('upsert' or 'delete'), ts, seq (the order of arrival) and the payload. A snapshot has id, ts and
the payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TRIES = {"vectorization": 4, "database": 200}
CLAIM = 192
MAX_BACKOFF = 20.0


def newest(changes: DataFrame, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """One change an id: the latest ts, of equal ones the first to arrive. An aggregate, so hot ids reduce before the shuffle."""
    rest = [c for c in changes.columns if c not in ids]
    best = F.min_by(F.struct(*rest), F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("late"), "seq"))
    return changes.groupBy(*ids).agg(best.alias("x")).select(*ids, *[F.col(f"x.{c}").alias(c) for c in rest])


def classified(snapshot: DataFrame, changes: DataFrame, texts: tuple[str, ...] = ("content",)) -> DataFrame:
    """The newest change of each id, with what becomes of it: insert, vectorize, patch, delete, absent or skipped.

    A change at or before the stored ts is skipped; one whose texts are as stored only patches the payload.
    """
    stored = snapshot.select("id", F.col("ts").alias("_ts"), *[F.col(c).alias(f"_{c}") for c in texts], F.lit(True).alias("_stored"))
    joined = newest(changes).join(stored, "id", "left")
    there = F.col("_stored").isNotNull()
    same = F.lit(True)
    for c in texts:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    stale = there & (F.col("ts") <= F.col("_ts"))
    fate = (F.when(stale, "skipped").when((F.col("op") == "delete") & ~there, "absent").when(F.col("op") == "delete", "delete")
            .when(~there, "insert").when(same, "patch").otherwise("vectorize"))
    return joined.withColumn("fate", fate).drop("_ts", "_stored", *[f"_{c}" for c in texts])


def merged(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after a batch of changes. Deletes leave no trace: an older upsert that comes later brings a row back."""
    decided = classified(snapshot, changes, ()).where("fate not in ('skipped', 'absent')")
    kept = snapshot.join(decided.select("id"), "id", "left_anti")
    return kept.unionByName(decided.where("op = 'upsert'").select(snapshot.columns))


def replayed(changes: DataFrame) -> DataFrame:
    """The snapshot that a whole change log gives."""
    return newest(changes).where("op = 'upsert'").drop("op", "seq")


def cancelled_by_delete(queue: DataFrame, deletes: DataFrame) -> DataFrame:
    """The queue without upserts that a delete of the same id supersedes. deletes: (id, request_ts)."""
    latest = deletes.groupBy("id").agg(F.max("request_ts").alias("request_ts"))
    gone = queue.where("op = 'upsert' and status in ('queued', 'requeued')").join(latest, "id").where(F.col("ts") <= F.col("request_ts")).select("queue_id")
    return queue.join(gone, "queue_id", "left_anti")


def cleared(queue: DataFrame, which: Column) -> DataFrame:
    """The queue without the entries for which a condition holds; one that is unknown keeps its entry."""
    return queue.where(~F.coalesce(which, F.lit(False)))


def looked_up(queue: DataFrame, wanted: DataFrame, missing_ok: bool = True) -> DataFrame:
    """The entries of wanted (queue_id), once each; with missing_ok=False an id that isn't queued is an error."""
    wanted = wanted.select("queue_id").distinct()
    if missing_ok:
        return queue.join(wanted, "queue_id", "left_semi")
    found = wanted.join(queue.withColumn("_there", F.lit(True)), "queue_id", "left")
    error = F.raise_error(F.concat(F.lit("not queued: "), F.col("queue_id").cast("string")))
    return found.where(F.when(F.col("_there").isNull(), error.cast("boolean")).otherwise(F.lit(True))).select(queue.columns)


def with_status(queue: DataFrame, updates: DataFrame, status: str, info: str, now: Column) -> DataFrame:
    """The queue after entries were given a status. updates: (queue_id, try_count); of several for one entry the largest count holds."""
    new = updates.groupBy("queue_id").agg(F.max("try_count").alias("_tries"))
    joined, hit = queue.join(new, "queue_id", "left"), F.col("_tries").isNotNull()
    changed = {"status": F.lit(status), "info": F.lit(info), "ts": now, "try_count": F.col("_tries")}
    kinds = dict(queue.dtypes)
    return joined.select(*[F.when(hit, changed[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in queue.columns])


def acknowledged(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without entries that were worked on. done: (queue_id)."""
    return queue.join(done.select("queue_id").distinct(), "queue_id", "left_anti")


def reverified(claimed: DataFrame, queue: DataFrame, collections: DataFrame) -> DataFrame:
    """The claimed entries that are still queued, for a collection that is still the one they were made for.

    collections: (collection_name, collection_id) as they are now.
    """
    pending = queue.where("status in ('queued', 'requeued')").select("queue_id")
    return claimed.join(pending, "queue_id", "left_semi").join(collections, ["collection_name", "collection_id"], "left_semi")


def idle_wait(empty_polls: Column, first: float = 1.0, most: float = 16.0) -> Column:
    """Seconds to wait after so many polls in a row that found nothing: doubling."""
    return F.when(empty_polls <= 0, 0.0).otherwise(F.least(first * F.pow(F.lit(2.0), empty_polls - 1), F.lit(most)))


def updated_averages(stats: DataFrame, updates: DataFrame) -> DataFrame:
    """(slot, doc_count, avgdl) after a batch of documents, from the running averages alone.

    stats: (slot, doc_count, avgdl). updates: rows (slot, new_docs, old_length, new_length, updated_length), token lengths
    that go, that come with new documents and that replace the old ones; summed by slot. No documents left: 0.
    """
    sums = updates.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("new_docs", "old_length", "new_length", "updated_length")])
    joined = stats.join(sums, "slot", "full")
    had, avg = F.coalesce("doc_count", F.lit(0)), F.coalesce("avgdl", F.lit(0.0))
    n = had + F.coalesce("new_docs", F.lit(0))
    total = avg * had - F.coalesce("old_length", F.lit(0)) + F.coalesce("new_length", F.lit(0)) + F.coalesce("updated_length", F.lit(0))
    return joined.select("slot", F.greatest(n, F.lit(0)).alias("doc_count"), F.when(n > 0, total / n).otherwise(0.0).alias("avgdl"))


def queue_info(queue: DataFrame) -> DataFrame:
    """Counts of queued, requeued and failed entries by operation, and in all."""
    counts = {f"{s}_{o}": F.count_if((F.col("status") == s) & (F.col("op") == o)) for s in ("queued", "requeued", "failed") for o in ("upsert", "delete")}
    return queue.agg(*[c.alias(n) for n, c in counts.items()], F.count("*").alias("total"))


def document_status(docs: DataFrame, queue: DataFrame, id_value) -> DataFrame:
    """A document's states, newest first: indexed, and its queue entries."""
    indexed = docs.where(F.col("id") == id_value).select("id", F.lit("indexed").alias("status"), "ts")
    queued = queue.where(F.col("id") == id_value).select("id", "status", "ts")
    return indexed.unionByName(queued).orderBy(F.desc("ts"), "status")


def claimed(queue: DataFrame, limit: int = CLAIM) -> DataFrame:
    """The next entries to work on: those never tried first, then retries, each oldest first."""
    return queue.where("status in ('queued', 'requeued')").orderBy(F.col("try_count") > 0, "created_at", "queue_id").limit(limit)


def jitter(tries: Column) -> Column:
    """Between 0.1 and 1.5 seconds, and always the same for a number of tries."""
    return 0.1 + F.pmod(tries.cast("long") * 2654435761, F.lit(1000)) / 1000.0 * 1.4


def backoff(tries: Column) -> Column:
    return F.least(2.0 * tries + jitter(tries), F.lit(MAX_BACKOFF))


def eligible(queue: DataFrame, now: Column) -> DataFrame:
    """Pending entries whose wait is over. now and updated_at: timestamps."""
    waited = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 1e6
    return queue.where(F.col("status").isin("queued", "requeued") & ((F.col("try_count") == 0) | (waited >= backoff(F.col("try_count")))))


def routed(queue: DataFrame, error: Column) -> DataFrame:
    """Where an entry goes after an error of a kind: failed at once, or requeued while tries are left; done without one."""
    tries = F.col("try_count") + 1
    left = F.lit(False)
    for kind, most in MAX_TRIES.items():
        left = left | ((error == kind) & (tries < most))
    status = F.when(error.isNull(), "done").when(F.coalesce(left, F.lit(False)), "requeued").otherwise("failed")
    return queue.withColumns({"next_status": status, "next_try_count": F.when(error.isNull(), F.col("try_count")).otherwise(tries)})


def stream_into(changes: DataFrame, store, checkpoint: str, **trigger):
    """Run a stream of change rows into a collection store (`sources.collections.Store`); returns the query.

    Every micro-batch becomes one version of the snapshot, named by the batch, so that a replayed batch changes nothing.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, batch_id)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

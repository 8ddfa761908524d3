"""Windowed metrics: 5-second buckets, sliding snapshots, and 1- and 5-minute roll-ups, in batch and as streams.

Events have key, dims, ts and value; a key is either summed or averaged, and averages carry (value, n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETENTION = "24 hours"


def bucket_start(ts: Column, seconds: int) -> Column:
    at = F.unix_seconds(ts.cast("timestamp"))
    return at - F.pmod(at, F.lit(seconds))


def buckets(events: DataFrame, keys: list[str], seconds: int = 5, ts: str = "ts", value: str = "value") -> DataFrame:
    """(keys, bucket_start, bucket_seconds, value, n): sums and counts by tumbling windows."""
    return events.groupBy(*keys, bucket_start(F.col(ts), seconds).alias("bucket_start")).agg(F.sum(value).alias("value"), F.count(value).alias("n")).withColumn("bucket_seconds", F.lit(seconds).cast("long"))


def rolled_up(fine: DataFrame, keys: list[str], seconds: int, until: Column | None = None) -> DataFrame:
    """Coarser buckets of finer ones; only slots that `until` (epoch seconds) has passed, if it is given."""
    start = F.col("bucket_start") - F.pmod(F.col("bucket_start"), F.lit(seconds))
    out = fine.groupBy(*keys, start.alias("bucket_start")).agg(F.sum("value").alias("value"), F.sum("n").alias("n")).withColumn("bucket_seconds", F.lit(seconds).cast("long"))
    return out if until is None else out.where(F.col("bucket_start") + seconds <= until)


def sliding(fine: DataFrame, keys: list[str], window: int = 60, step: int = 5) -> DataFrame:
    """For every step at which a bucket may be seen, the sum of those that start within the window before its end."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(window // step - 1)), lambda i: F.col("bucket_start") + i * step)
    return fine.select(*keys, "value", "n", F.explode(ends).alias("at")).groupBy(*keys, "at").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def snapshot(fine: DataFrame, keys: list[str], now: Column, window: int = 60, step: int = 5) -> DataFrame:
    """The sums over the window up to the current bucket."""
    current = now - F.pmod(now, F.lit(step))
    recent = fine.where((F.col("bucket_start") >= current - window + step) & (F.col("bucket_start") <= current))
    return recent.groupBy(*keys).agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def averaged(rolled: DataFrame) -> DataFrame:
    return rolled.withColumn("average", F.when(F.col("n") > 0, F.col("value") / F.col("n")))


def of_one_kind(events: DataFrame, kind: str = "kind") -> DataFrame:
    """Events whose key is used in one way only, summed or averaged, by its first use."""
    first = events.groupBy("key").agg(F.min_by(kind, F.struct("ts", kind)).alias("_kind"))
    return events.join(first, "key").where(F.col(kind) == F.col("_kind")).drop("_kind")


def retained(rolled: DataFrame, now: Column, seconds: int = 86_400) -> DataFrame:
    return rolled.where(F.col("bucket_start") >= now - seconds)


def minute_stream(events: DataFrame, keys: list[str], late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """A stream's 1-minute sums, each once its minute is over."""
    seen = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return seen.groupBy(F.window(ts, "1 minute"), *keys).agg(F.sum(value).alias("value"), F.count(value).alias("n"))


def five_minute_stream(minutes: DataFrame, keys: list[str]) -> DataFrame:
    """5-minute sums of `minute_stream`."""
    return minutes.groupBy(F.window(F.window_time("window"), "5 minutes"), *keys).agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def buffered(events: DataFrame, capacity: int = 100_000, seconds: int = 5, ts: str = "ts", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(events' columns, kept): what a buffer that is drained every so many seconds takes; what comes when it is full is dropped."""
    arrived = F.row_number().over(Window.partitionBy(bucket_start(F.col(ts), seconds)).orderBy(*order))
    return events.withColumn("kept", arrived <= capacity)


def overflow_warnings(events: DataFrame, seconds: int = 5, ts: str = "ts") -> DataFrame:
    """(bucket_start, dropped) of `buffered` events: one row where dropping began, not one a bucket that goes on dropping."""
    counts = events.groupBy(bucket_start(F.col(ts), seconds).alias("bucket_start")).agg(F.count_if(~F.col("kept")).alias("dropped"))
    before = counts.select((F.col("bucket_start") + seconds).alias("bucket_start"), F.col("dropped").alias("_before"))
    return counts.join(before, "bucket_start", "left").where((F.col("dropped") > 0) & (F.coalesce("_before", F.lit(0)) == 0)).drop("_before")


def live(fine: DataFrame, now: Column, window: int = 60) -> DataFrame:
    """The fine buckets that a sliding window still needs; series without any are forgotten with them."""
    return fine.where(F.col("bucket_start") >= now - window - F.col("bucket_seconds"))


def deduplicated_sink(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket rows after an idempotent upsert: a bucket written again replaces itself."""
    names = [*keys, "bucket_start", "bucket_seconds"]
    return stored.join(batch.select(*names), names, "left_anti").unionByName(batch.dropDuplicates(names))

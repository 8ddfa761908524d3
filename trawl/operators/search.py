"""Ranked retrieval: arms, fusion, facets, groups.

An arm ranks a collection for each query by one vector over one field and keeps a prefetch of candidates. Arms are
unions of (query_id, id, arm, weight, score, rank); fusion is an aggregate over them, so payload columns join last, on
the few ids that are left. Scores are rounded before they are ordered, and ids break ties, so ranks don't depend on
the order of summing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import dense, postings as made, text
from trawl.sources.layout import spread, written

RRF_K = 2
DIGITS = 6
#: Tokens that pruning leaves of a text.
TOP_K = 128
#: Rows of a query side that may be broadcast to a scan: tokens, or vectors, of a batch of queries.
QUERY_ROWS = 500_000


def postings(docs: DataFrame, vector: Column, id_col: str = "id") -> DataFrame:
    """(token, id, weight) of a collection's sparse vectors."""
    return docs.select(F.col(id_col).alias("id"), F.explode(vector).alias("x")).select("x.token", "id", "x.weight")


def token_statistics(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count("*").alias("n_with"))


def sparse_scores(posted: DataFrame, queries: DataFrame, n_docs: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): the products of shared tokens' weights.

    queries: (query_id, token, weight). n_docs: the collection's size, which turns inverse document frequencies on;
    they are of the whole collection, whatever is allowed. allowed: ids that a filter lets through.
    """
    small = queries.count() <= QUERY_ROWS
    side = lambda x: F.broadcast(x) if small else x
    met = posted.join(side(queries.select("token").distinct()), "token", "left_semi")
    if n_docs is not None:
        rare = token_statistics(met).select("token", text.idf(F.lit(n_docs), F.col("n_with")).alias("idf"))
        queries = queries.join(rare, "token").select("query_id", "token", (F.col("weight") * F.col("idf")).alias("weight"))
    if allowed is not None:
        met = met.join(allowed.select("id"), "id", "left_semi")
    joined = met.join(side(queries).withColumnRenamed("weight", "query_weight"), "token")
    return joined.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("query_weight")), DIGITS).alias("score"))


def text_postings(docs: DataFrame, vector: Callable[..., Callable], wanted: frozenset[str] | None = None) -> DataFrame:
    """(token, id, weight) of docs (id, txt). vector: `made.whitespace` or `made.trigrams`. wanted: the only tokens to return."""
    return made.made(spread(docs).select("id", text.preprocessed(F.col("txt")).alias("txt")), vector(text.DEFAULT_AVGDL, TOP_K, wanted))


def text_scores(docs: DataFrame, vector: Callable[..., Callable], queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """`sparse_scores` of docs (id, txt), whose texts are tokenized once: frequencies and scores read the postings that queries meet."""
    wanted = frozenset(r[0] for r in queries.select("token").distinct().collect()) if queries.count() <= QUERY_ROWS else None
    return sparse_scores(written(text_postings(docs, vector, wanted)), queries, docs.count(), allowed)


def dense_scores(vectors: DataFrame, queries: DataFrame, distance: str = "cosine", block: int = 2000) -> DataFrame:
    """(query_id, id, score) of every query of a stated batch against every vector (id, embedding).

    Queries are dealt into blocks of bounded size, to each of which the vectors are joined by the block's number: one block is
    broadcast, more are shuffled.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    side = queries.select("query_id", F.col("embedding").alias("query_embedding"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    dealt = vectors.select("id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = dealt.join(F.broadcast(side) if blocks == 1 else side, "block")
    score = F.round(dense.similarity(F.col("embedding"), F.col("query_embedding"), distance), DIGITS)
    return pairs.select("query_id", "id", score.alias("score")).where("score is not null")


def arm(scores: DataFrame, name: str, weight: float, prefetch: int, threshold: float | None = None) -> DataFrame:
    """The best candidates of each query, with their rank from 1."""
    if threshold is not None:
        scores = scores.where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= prefetch).select("query_id", "id", F.lit(name).alias("arm"), F.lit(float(weight)).alias("weight"), "score", "rank")


def arms(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reciprocal_rank_fusion(candidates: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, tie): ties go to the larger sum of raw scores."""
    return candidates.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), DIGITS).alias("score"), F.round(F.sum("score"), DIGITS).alias("tie"))


def linear_fusion(candidates: DataFrame) -> DataFrame:
    """(query_id, id, score, tie): min-max normalised scores, 1 where an arm's are all equal; ties go to the id alone."""
    own = Window.partitionBy("query_id", "arm")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    return candidates.withColumn("scaled", scaled).groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("scaled")), DIGITS).alias("score"), F.lit(0.0).alias("tie"))


def ordered(fused: DataFrame, limit: int | None = None, threshold: float | None = None) -> DataFrame:
    """fused with its place in each query's result."""
    if threshold is not None:
        fused = fused.where(F.col("score") >= threshold)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("tie"), "id"))
    fused = fused.withColumn("place", place)
    return fused.where(F.col("place") <= limit) if limit is not None else fused


def fuse(candidates: DataFrame, mode: str = "rrf", limit: int = 10, threshold: float | None = None) -> DataFrame:
    fused = linear_fusion(candidates) if mode == "linear" else reciprocal_rank_fusion(candidates)
    return ordered(fused, limit, threshold)


def raw_scores(candidates: DataFrame) -> DataFrame:
    """(query_id, id, vector_scores): what each arm gave, by arm. An arm's name is field_vector, split at the first _."""
    field, vector = F.substring_index("arm", "_", 1), F.expr("substr(arm, instr(arm, '_') + 1)")
    return candidates.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("arm", field.alias("field"), vector.alias("vector"), "score", "rank"))).alias("vector_scores"))


def grouped(fused: DataFrame, groups: DataFrame, group_max: int = 3, limit: int = 10) -> DataFrame:
    """At most group_max results a value of (id, group_value), in fused order, then the limit; a missing value is a group.

    Exact: over all fused candidates.
    """
    joined = ordered(fused).drop("place").join(groups, "id", "left")
    own = Window.partitionBy("query_id", "group_value").orderBy(F.desc("score"), F.desc("tie"), "id")
    capped = joined.withColumn("in_group", F.row_number().over(own)).where(F.col("in_group") <= group_max)
    return ordered(capped, limit)


def refetched(scores: dict[str, tuple[DataFrame, float]], groups: DataFrame, fusion: str = "rrf", group_max: int = 3, limit: int = 10, prefetch: int = 15, rounds: int = 2) -> DataFrame:
    """Group caps in rounds of bounded prefetches: (query_id, id, score, tie, group_value, place).

    scores: each arm's name to its (query_id, id, score) and weight. groups: (id, group_value). A round takes the best
    `prefetch` of each arm that isn't in a group that is full, adds what an arm hasn't had to its list (ranks are places in that
    list), and fuses all lists anew. A query is done once it has `limit` results, no group of it is full, or no arm had
    `prefetch` candidates; the last round ends all. Nothing is collected: done queries just get no more candidates. The scores
    and each round's lists are written, so no round makes again what one before it made.
    """
    lists, full, done, kept = None, None, None, None
    valued = reduce(DataFrame.unionByName, [s.select("query_id", "id", "score", F.lit(name).alias("arm"), F.lit(float(w)).alias("weight")) for name, (s, w) in scores.items()]).join(groups, "id", "left")
    valued = written(valued)  # each round reads it, and the last one's plan holds those before it
    for number in range(rounds):
        pool = valued
        if full is not None:
            blocked = full.select("query_id", F.col("group_value").alias("_full"))
            pool = pool.join(blocked, (pool["query_id"] == blocked["query_id"]) & pool["group_value"].eqNullSafe(F.col("_full")), "left_anti").join(done, "query_id", "left_anti")
        rank = F.row_number().over(Window.partitionBy("query_id", "arm").orderBy(F.desc("score"), "id"))
        got = pool.withColumn("at", rank).where(F.col("at") <= prefetch).withColumn("round", F.lit(number))
        fetched = got.groupBy("query_id", "arm").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.max("n").alias("most"))
        if lists is not None:
            got = got.join(lists.select("query_id", "arm", "id"), ["query_id", "arm", "id"], "left_anti")
        lists = written(got if lists is None else lists.unionByName(got))
        place = F.row_number().over(Window.partitionBy("query_id", "arm").orderBy("round", "at"))
        fused = fuse(lists.withColumn("rank", place).select("query_id", "id", "arm", "weight", "score", "rank"), fusion, limit=None)
        kept = grouped(fused.drop("place"), groups, group_max, limit)
        if number + 1 < rounds:
            counts = kept.groupBy("query_id", "group_value").agg(F.count("*").alias("n"))
            full = counts.where(F.col("n") >= group_max).select("query_id", "group_value")
            state = kept.groupBy("query_id").agg(F.count("*").alias("n")).join(full.select("query_id").distinct().withColumn("any_full", F.lit(True)), "query_id", "left").join(fetched, "query_id", "left")
            over = (F.col("n") >= limit) | F.col("any_full").isNull() | (F.coalesce("most", F.lit(0)) < prefetch)
            over_now = state.where(over).select("query_id")
            done = over_now if done is None else done.union(over_now).distinct()
    return kept


def facet_counts(candidates: DataFrame, docs: DataFrame, fields: dict[str, str], most: int = 10) -> DataFrame:
    """(query_id, field, value, n): how many candidates of any arm have each value; the most frequent ones, then by value.

    fields: facet name to its typed column in docs. Nulls are not counted.
    """
    pool = candidates.select("query_id", "id").distinct().join(docs, "id")
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), facet_key(F.col(column), dict(docs.dtypes)[column]).alias("value")) for name, column in sorted(fields.items())])
    counts = pool.select("query_id", F.explode(pairs).alias("x")).select("query_id", "x.field", "x.value").where("value is not null").groupBy("query_id", "field", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id", "field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= most).drop("place")


def facet_key(value: Column, kind: str, declared: str | None = None) -> Column:
    """How a value reads as a facet: whole numbers of an integer field, a point in each float, booleans in lower case.

    declared: the field's declared type, where it differs from the column's.
    """
    number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if declared == "integer" and number:
        return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("string")
    if number and (declared == "float" or declared is None and kind in ("float", "double")):
        value = value.cast("double")
        plain = value.cast("decimal(38,18)").cast("string")  # never an exponent within the range in which both agree
        short = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
        return F.when((F.abs(value) < 1e16) & ((F.abs(value) >= 1e-4) | (value == 0)), F.when(value.cast("string").contains("E"), short).otherwise(value.cast("string"))).otherwise(F.regexp_replace(F.lower(value.cast("string")), r"\.0e", "e"))
    return F.lower(value.cast("string")) if kind == "boolean" else value.cast("string")

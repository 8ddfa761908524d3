"""Exact top-k search: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of bounded size. Within a block, every dimension has its list of candidates sorted by
component, made once. The queries stream past each block in batches: only candidates are held, and only queries are
copied, once a block. A query walks all its lists in step (descending where its component is positive, ascending where it
is negative), scores what it meets, and stops once the bound, the score a vector at the present depth of every list
would have, is below its kth best score; or below the kth best score of the one block that it walked before all others,
for what can't beat that is in no result. The blocks' best k then meet in a window per query.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, as queries or
candidates; vectors are only compared with vectors of the same length; equal scores go to the smaller id; of rows
that share an id each is a candidate for every other id and the better one counts; a null id takes no part. An empty
table gives an empty result. Extra columns are ignored, whatever their names. Scores beyond 2^53, which doubles don't
hold exactly, are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import table, written

CANDIDATE_BLOCK = 8192
EXACT = 1 << 53
#: Depths of the sorted lists at which the bound is compared with the kth score.
FIRST_DEPTH = 16


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(score) > 4 * k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= kth)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


def threshold_top_k(ids: np.ndarray, rows: np.ndarray, qid: int, q: np.ndarray, order: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows for one query in one block, those below `floor` left out or not. order: each dimension's rows by ascending component."""
    n, dims = rows.shape
    up = np.where(q > 0, -1, 1)  # the direction in which the query reads each list
    used = np.flatnonzero(q)
    seen = np.zeros(n, bool)
    seen[ids == qid] = True
    found_ids, found = np.empty(0, np.int64), np.empty(0, np.int64)
    done, depth = 0, FIRST_DEPTH
    if not len(used):
        used = np.array([0])
    while True:
        depth = min(depth, n)
        met = np.concatenate([order[d, n - depth:n - done] if up[d] < 0 else order[d, done:depth] for d in used])
        fresh = np.zeros(n, bool)
        fresh[met] = True
        fresh &= ~seen
        fresh = np.flatnonzero(fresh)
        if len(fresh):
            seen[fresh] = True
            score = (rows[fresh] @ q).astype(np.int64)
            found_ids, found = np.concatenate([found_ids, ids[fresh]]), np.concatenate([found, score])
            # of rows with one id the best counts
            by = np.lexsort((-found, found_ids))
            found_ids, found = found_ids[by], found[by]
            first = np.r_[True, found_ids[1:] != found_ids[:-1]]
            found_ids, found = found_ids[first], found[first]
            best = _best(found, found_ids, k)
            found_ids, found = found_ids[best], found[best]
        if depth == n:
            return found_ids, found
        edge = np.array([order[d, n - depth] if up[d] < 0 else order[d, depth - 1] for d in used])
        bound = float(rows[edge, used] @ q[used])
        if bound < floor or len(found) == k and bound < found[-1]:
            return found_ids, found
        done, depth = depth, depth * 4


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows (id, x) with x = floor(scale * component), without the vectors that take no part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fit = F.col(id_col).isNotNull() & F.coalesce(
        (F.size(F.col(vector_col)) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return df.where(fit).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("x"))


class Block:
    """Candidates with their sorted lists."""

    def __init__(self, ids: list[int], rows: list[list[float]]):
        self.ids, self.rows = np.array(ids, np.int64), np.array(rows, np.float64)
        self.order = np.ascontiguousarray(np.argsort(self.rows, axis=0, kind="stable").T)
        self.most = np.abs(self.rows).max(axis=0)

    def best(self, qid: int, x: list[float], k: int, floor: float) -> tuple[list[int], list[int]]:
        q = np.array(x, np.float64)
        if float(self.most @ np.abs(q)) >= EXACT:
            raise ValueError(f"scores of query {qid} may exceed 2^53")
        found, score = threshold_top_k(self.ids, self.rows, qid, q, self.order, k, floor)
        return found.tolist(), score.tolist()


def _near(dealt: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k best of each block for each query. dealt: block, dim, floor (null: a candidate), id, x."""
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, block = None, [], [], None
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for key, is_query, floor, i, x in zip(zip(*(c.to_pylist() for c in batch.columns[:2])), *(c.to_pylist() for c in batch.columns[2:])):
                if key != at:
                    at, ids, rows, block = key, [], [], None
                if not is_query:
                    ids.append(i)
                    rows.append(x)
                    continue
                if not ids:
                    continue
                block = Block(ids, rows) if block is None else block
                found, score = block.best(i, x, k, -np.inf if floor is None else floor)
                out[0].extend([i] * len(found))
                out[1].extend(found)
                out[2].extend(score)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return dealt.select("block", "dim", "is_query", "floor", "id", "x").mapInArrow(search, "query_id long, id long, score long")


def top_k(df: DataFrame, k: int = 5, *, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, id, score) of the k best candidates of each query; a query's own id isn't its candidate.

    is_query: a condition on the columns id and x.
    """
    vectors = integer_vectors(df, id_col, vector_col, scale).select("id", "x", F.size("x").alias("dim"))
    vectors = written(vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    blocks = max(1, -(-vectors.count() // candidate_block))
    # the row's content takes part in the dealing, so that rows with one id don't meet in one block
    block = F.pmod(F.xxhash64("id", "x", F.lit(1)), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("double")
    candidates = vectors.select(block.alias("block"), "dim", F.lit(False).alias("is_query"), none.alias("floor"), "id", "x")
    queries = written(vectors.where("is_query").select("id", "x", "dim").distinct())

    def walked(asked: DataFrame) -> DataFrame:
        """Each block's candidates, followed by the queries (block, dim, floor, id, x) that walk it."""
        dealt = candidates.unionByName(asked.withColumn("is_query", F.lit(True)))
        return _near(dealt.repartition(blocks, "block", "dim").sortWithinPartitions("block", "dim", "is_query"), k)

    first = F.pmod(F.xxhash64("id", "x", F.lit(2)), F.lit(blocks)).cast("int")
    near = written(walked(queries.select(first.alias("block"), "dim", none.alias("floor"), "id", "x")))
    if blocks > 1:
        kth = near.groupBy("query_id").agg(F.count_distinct("id").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
        floors = kth.select(F.col("query_id").alias("id"), F.col("kth").cast("double").alias("floor"))
        rest = F.array_except(F.sequence(F.lit(0), F.lit(blocks - 1)), F.array(first))
        near = near.unionByName(walked(queries.join(floors, "id", "left").select(F.explode(rest).alias("block"), "dim", "floor", "id", "x")))
    near = near.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.select("query_id", rank.cast("int").alias("rank"), "id", "score").where(F.col("rank") <= k)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), 5, is_query=F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

"""Near-duplicate groups: one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

A document's set holds its distinct word shingles as 64-bit hashes. One hash function deals a set into 128 bins by its
leading bits, the least value of a bin is its entry, and an empty bin borrows from the first filled one in a random
order of its own (the same for all documents). Bands of five bins are hashed to bucket keys: at a similarity of 0.85 a
pair of independent bins shares no key with probability 4e-7.

Equal sets are one class, of which only the document with the smallest id goes on. In each bucket the members are
ordered by how many others they meet in all their buckets (ties to the smaller id), so that an original comes before
its copies, and the first is the bucket's hub: only pairs of a member with the hub are candidates, at most one a bucket
row. Links are confirmed on full sets, and the groups are the connected components, by alternating large and small
stars with a written table each round.

A star misses the links between members that aren't linked with their hub. They are found in one more join, over all
documents that met another one in some bucket. A shingle counts there if documents of different groups hold it; what
can't be linked by the shingles that count goes. A pair that is linked has one of the rarest of them in common, so many
of the rarest as the threshold lets it miss and one more. Only pairs of different groups that meet by such a shingle are
looked at, and within the join they are ruled out by exact bounds: of the sizes, of what is left after the shingle's
place in either order, and of the shingles counted by parts of their hashes. What passes is confirmed on full sets. So
every pair that shares a bucket is tried, connected or ruled out, a group of copies costs a star, and the join gives no
more rows than pairs near the threshold. A hot key is split by the sort-merge join, so no hint lets it become a
broadcast of unsplit partitions.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; repeated rows, and
all rows that share an id, are one document; a null id is linked with nothing, has a null component and is kept; an
empty table gives an empty result; extra columns are ignored, whatever their names; a text of any length is one set,
held in a worker's memory (8 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import batch_of, discard, few, rows_of, table, written

WORDS = 5
BIN_BITS, ROWS, BANDS = 7, 5, 25
BINS = 1 << BIN_BITS
#: Parts of the hashes by which shingles in common are bounded.
PARTS = 32
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 85

_rng = np.random.default_rng(7)
#: For each bin, the order in which it looks for a filled one.
PROBES = np.argsort(_rng.random((BINS, BINS)), axis=1)
_odd = _rng.integers(1 << 62, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of a text's shingles, as 64-bit hashes; fewer words than a shingle has are one."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: lowers A-Z, splits at ASCII white space
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total += h[i:i + n] * _odd[i]
    return np.unique(mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin has that of the first filled one in its own order."""
    at = np.searchsorted(hashes, _EDGES)
    filled = at < np.r_[at[1:], len(hashes)]
    source = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = PROBES[empty]
        source[empty] = probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]
    return hashes[at[source]]


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[:BANDS * ROWS].reshape(BANDS, ROWS)
    return mixed((rows * _odd[8:8 + ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _odd[20]).astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if it is empty), band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            out = []
            for doc_id, text in rows:
                hashes = shingles(text)
                full = len(hashes) > 0
                out.append((doc_id, len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()) if full else None, band_keys(signature(hashes)) if full else None))
            yield batch_of(out, schema)

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, digest, n, items) of the documents with these ids, once for each set that an id has."""
    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("items", pa.list_(pa.int64()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            out, size = [], 0
            for doc_id, text in rows:
                hashes = shingles(text)
                if len(hashes):
                    out.append((doc_id, xxhash.xxh3_128_digest(hashes.tobytes()), hashes.view(np.int64)))
                    size += len(hashes)
                if size > 1 << 20:
                    yield batch_of(out, schema)
                    out, size = [], 0
            yield batch_of(out, schema)

    texts = docs.select("doc_id", "text").join(few(ids, 8).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    found = texts.mapInArrow(sets, "id long, digest binary, items array<long>")
    return found.groupBy("id", "digest").agg(F.first("items").alias("items")).select("id", F.size("items").cast("long").alias("n"), "digest", "items")


def linked(common: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m are linked with so many in common; what holds for some number holds for a larger one."""
    return 100 * common >= percent * (n + m - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of the pairs (id, hub) that are linked, by full sets: a written table. pairs: written."""
    rows = pairs.count()
    hubs = few(written(pairs.select(F.col("hub").alias("id")).distinct()), 8)
    own = sets.join(few(pairs, 16, rows), "id").select("id", "hub", "n", "items")
    others = sets.join(hubs, "id", "left_semi").select(F.col("id").alias("hub"), F.col("n").alias("m"), F.col("items").alias("others"))
    common = F.size(F.array_intersect("items", "others")).cast("long")
    sized = linked(F.least("n", "m"), F.col("n"), F.col("m"), percent)
    return written(own.join(others.hint("merge"), "hub").where(sized & linked(common, F.col("n"), F.col("m"), percent)).select(F.col("id").alias("a"), F.col("hub").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the smallest id it reaches."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    rows, seen = edges.count(), None
    while True:
        # large star: the larger neighbours of a node point to its least neighbour
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(few(least, 16, 2 * rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: a node and its smaller neighbours point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(few(least, 16, rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, written(small)
        discard(before)
        rows, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (rows, mark) == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        seen = (rows, mark)


def stars(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The ids that meet another in some bucket, and the pairs (id, hub) of each with the first of its buckets: written tables."""
    rows = classes.select("id", "n", F.explode(F.array_distinct("bands")).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = rows.join(sizes.hint("merge"), "key").groupBy("id", "n").agg(F.sum("size").alias("degree"), F.collect_list("key").alias("keys"))  # BANDS keys at most
    met = written(met)
    placed = met.select("id", "n", F.explode("keys").alias("key"), F.struct("degree", (-F.col("id")).alias("order"), "n").alias("place"))
    first = placed.groupBy("key").agg(F.max("place").alias("hub"))
    pairs = placed.join(first.hint("merge"), "key").where((F.col("id") != -F.col("hub.order")) & linked(F.least("n", "hub.n"), F.col("n"), F.col("hub.n"), percent))
    return written(met.select("id").distinct()), written(pairs.select("id", (-F.col("hub.order")).alias("hub")).distinct())


def near_rest(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(id, hub) of the pairs of different groups that may still be linked. A written table; groups: (id, component), written."""
    named = sets.join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "digest", "n", "items")
    held = named.select("id", "component", "digest", "n", F.explode("items").alias("item"))
    across = held.groupBy("item").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("holders")).where("low < high").select("item", "holders")
    kept = held.join(across.hint("merge"), "item").groupBy("id", "component", "digest", "n").agg(F.collect_list("item").alias("items"), F.collect_list("holders").alias("holders"))
    kept = kept.where(100 * F.size("items") >= percent * F.col("n")).select("id", "component", "n", "items", "holders")
    schema = pa.schema([("id", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("item", pa.int64()), ("at", pa.int64()), ("parts", pa.list_(pa.int32()))])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            out = []
            for doc_id, component, n, items, holders in rows:
                item = np.array(items, np.int64)
                missed = len(item) - -(-percent * n // 100)  # of those that count, a linked pair misses no more
                first = item[np.lexsort((item, np.array(holders)))[:missed + 1]]
                parts = np.bincount(item % PARTS, minlength=PARTS).astype(np.int32)
                out += [(doc_id, component, n, len(item), x, i, parts) for i, x in enumerate(first.tolist())]
                if len(out) > 1 << 16:
                    yield batch_of(out, schema)
                    out = []
            yield batch_of(out, schema)

    prefixes = written(kept.mapInArrow(rarest, "id long, component long, n long, shared long, item long, at long, parts array<int>"))
    a, b = prefixes.alias("a"), prefixes.alias("b").hint("merge")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    may = lambda most: linked(most, x("n"), y("n"), percent)
    placed = F.least(x("at"), y("at")) + F.least(x("shared") - x("at"), y("shared") - y("at"))
    by_part = F.aggregate(F.zip_with(x("parts"), y("parts"), lambda i, j: F.least(i, j)), F.lit(0), lambda t, i: t + i).cast("long")
    found = a.join(b, (x("item") == y("item")) & (x("id") < y("id")) & (x("component") != y("component")) & may(F.least(x("shared"), y("shared"))) & may(placed) & may(by_part))
    return written(found.select(x("id").alias("id"), y("id").alias("hub")).distinct())


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept."""
    signed = written(signatures(docs))
    least = F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x")
    classes = written(signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(least).select("digest", F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), "x.bands"))
    met, pairs = stars(classes, percent)
    sets = written(sets_of(docs, met))
    links = confirmed(pairs, sets, percent)
    groups = written(components(links))
    more = near_rest(sets, groups, percent)
    if not more.isEmpty() and not (more := confirmed(more, sets, percent)).isEmpty():
        groups = written(components(more.union(groups.where("id <> component").select("id", "component"))))
    named = classes.select("digest", "id").join(groups, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without those that aren't the first of their group."""
    dropped = written(near_duplicates(docs, percent).where("not kept").select("doc_id").distinct())
    return docs.join(few(dropped, 8), "doc_id", "left_anti").select(docs.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS items FROM w),
n AS (SELECT doc_id, CAST(len(items) AS BIGINT) AS n, items FROM s),
e AS (SELECT doc_id, n, hash(unnest(items)) AS item FROM n),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.item = y.item AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON n.doc_id = m.doc_id
"""

"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks boundaries in the UTF-8 text. Chunking is normalised: below the usual size a
boundary needs more zero bits, above it fewer, so sizes gather around the usual one. Boundaries depend on content
alone, so text that moves keeps its chunks. A fingerprint is the set of (digest, length) of the chunks, and the
likeness of one to another is its containment: the length of its chunks that the other has too, over all its length.

For the next document, rows are ordered by id and a hash of the text, and dealt into ranges of that order, as many as
the input has partitions (RANGES times), so a range doesn't grow with the table. The ends of the ranges come from a
sample of (id, hash), of which the driver holds 16 bytes a row, SAMPLED rows a range; each range also gets the first row of
the next one. The rows of one id are split between ranges by their texts; equal rows stay together, and cost one
fingerprint.

Defined results: a null text is an empty one, whose fingerprint is empty, alike (1) to another empty one and unlike
(0) any other; documents are followed by the next by id, then by a hash of the text; null ids come first; the last is
followed by the first, and a single document by itself; extra columns are ignored; an empty table gives an empty result;
a text of any length is chunked whole, in a worker's memory.
"""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import batch_of, rows_of, table

LEAST, USUAL, MOST = 24, 64, 256
HARD, EASY = 7, 4  # zero bits asked for below and above the usual size
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Ranges for each partition of the input, and rows of the sample for each range.
RANGES, SAMPLED = 4, 20


def gear(data: bytes) -> np.ndarray:
    """The gear hash at each byte: h = (h << 1) + GEAR[byte], 32 bits wide, so of the last 32 bytes."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h over k bytes becomes h over 2k bytes
        if len(h) <= k:
            break
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h = wider
    return h


def chunks(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of the chunks of data."""
    h = gear(data)
    easy = np.flatnonzero(h >> np.uint32(32 - EASY) == 0)
    hard = easy[h[easy] >> np.uint32(32 - HARD) == 0].tolist()
    easy, n, at, out = easy.tolist(), len(data), 0, []
    n_hard, n_easy = len(hard), len(easy)
    while at < n:
        end = n
        i = bisect_left(hard, at + LEAST - 1)
        if i < n_hard and hard[i] < at + USUAL - 1:
            end = hard[i] + 1
        else:
            i = bisect_left(easy, at + USUAL - 1)
            if i < n_easy and easy[i] < at + MOST - 1:
                end = easy[i] + 1
            else:
                end = min(n, at + MOST)
        out.append((at, end))
        at = end
    return out


def fingerprint(text: str) -> dict[str, int]:
    """{digest: length} of the text's chunks."""
    data = text.encode("utf-8", "surrogatepass")
    return {f"{xxhash.xxh3_64_intdigest(data[a:b]) >> 16:012x}": b - a for a, b in chunks(data)}


def written_out(chunk_set: dict[str, int]) -> str:
    return ",".join(f"{d}:{n}" for d, n in sorted(chunk_set.items()))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """The part of a, by length, that b has too."""
    if not a:
        return 0.0 if b else 1.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def followed(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, range, ahead), dealt so that a task has whole ranges, sorted, each closed by a row of the next range (ahead)."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id"), F.lit(-sys.maxsize - 1)).cast("long").alias("id_key"), F.xxhash64(text).alias("hash"))
    n = keyed.count()
    ranges = RANGES * docs.rdd.getNumPartitions() if ranges is None else ranges
    wide = 1 << 30
    chosen = keyed.where(F.pmod(F.xxhash64("id_key", "hash", F.lit("ends")), F.lit(wide)) < min(wide, -(-SAMPLED * ranges * wide // max(n, 1))))
    sample = sorted({(r[0], r[1]) for r in chosen.select("id_key", "hash").distinct().collect()})
    ends = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []  # the first row of each range but one
    end_ids, end_hashes = (np.array(x, np.int64) for x in zip(*ends)) if ends else (np.empty(0, np.int64),) * 2

    def range_of(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """How many ends are at or before each row."""
        low, high = np.searchsorted(end_ids, ids, side="left"), np.searchsorted(end_ids, ids, side="right")
        out = low.copy()
        for i in np.flatnonzero(low < high):  # an id that ranges begin within
            out[i] = low[i] + np.searchsorted(end_hashes[low[i]:high[i]], hashes[i], side="right")
        return out

    own = F.pandas_udf(lambda ids, hashes: pd.Series(range_of(ids.to_numpy(np.int64), hashes.to_numpy(np.int64)), dtype="int64"), "long")
    firsts = sorted((r[0], tuple(r[1])) for r in keyed.groupBy(own("id_key", "hash")).agg(F.min(F.struct("id_key", "hash"))).collect())  # a row a range
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        ids, hashes = ids.to_numpy(np.int64), hashes.to_numpy(np.int64)
        return pd.Series([[int(r), before[key]] if (key := (i, h)) in before else [int(r)] for r, i, h in zip(range_of(ids, hashes), ids.tolist(), hashes.tolist())])

    dealt = keyed.select("doc_id", "id_key", "hash", "text", F.posexplode(F.pandas_udf(places, "array<long>")("id_key", "hash")).alias("ahead", "range"))
    return dealt.repartition(max(1, ranges), "range").sortWithinPartitions("range", "ahead", "id_key", "hash", "text").select("doc_id", "text", "range", "ahead")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row a row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    names = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(k, kinds[v]) for k, v in names.items()])

    def pair(text: str, have: dict[str, int], following: str, then: dict[str, int]) -> tuple:
        other = edited(text, following)
        changed = fingerprint(other)
        return (len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), written_out(have), written_out(changed), containment(have, changed), containment(have, then))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # doc_id, text, fingerprint
        closed = None
        same = (None, None, None)  # two texts that followed each other, and their row
        for rows in rows_of(batches):
            out = []
            for doc_id, text, place, ahead in rows:
                if place == closed:
                    continue
                have = last[2] if last is not None and last[1] == text else fingerprint(text)
                if last is not None:
                    if same[0] != last[1] or same[1] != text:
                        same = (last[1], text, pair(last[1], last[2], text, have))
                    out.append((last[0], *same[2]))
                last, closed = (None, place) if ahead else ((doc_id, text, have), closed)
            yield batch_of(out, schema)

    return followed(docs, ranges).mapInArrow(compare, ", ".join(f"{k} {v}" for k, v in names.items()))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

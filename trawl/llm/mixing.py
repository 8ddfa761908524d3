"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words: its weight's part of `share` times all words, stopped at `most` times its own
words, the excess reshared by weight. A source with target ratio r takes floor(r) whole copies of each document for
certain. What is left of its target is drawn by unequal probabilities, in proportion to size: a document's inclusion
probability is p = min(1, c * size), with c such that the expected words, the sum of p * size, are what is left; so
long documents, of which a source's words mostly are, come in first, and the certain ones (p = 1) are whole copies too.
The sample is drawn in Pareto order: documents rank by the random odds over the inclusion odds,
(u / (1 - u)) / (p / (1 - p)), u a uniform hash of the id, and the first ones that fill what is left of the target are
taken. The size is fixed in words, not in documents, so a source comes within one document of its target whatever its
lengths.

The rank q is used as q / (1 + q), in 52 bits. The cut in each source's order is found without sorting a source: words
are summed in 4096 intervals of the rank, then in 4096 intervals of the one that the cut falls into, and only that one's
rows (one in 16 million) are ordered. c is found from sums by distinct size.

Defined results: a null or blank text has size 0 and is taken 0 words; a null source is a source, last in order;
repeated rows are sampled one by one (rows that share an id also share u, and follow one another in the order); equal
ranks go by id, then size; an empty table gives an empty result; extra columns are carried only where `carry` names
them, whatever their names (a carried one can't be named as a column of the result); a text of any length counts whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import WORD, few_bytes, table, written

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # 150 % as a fraction
MOST = 2
#: Bits of the interval number in each of the two rounds of summing.
BITS = 12
UNIT = 1 << 52


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target), one row a source. Sums are exact integers; each target is one division."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", w.alias("w"))
    # sources fill up in the order of size / weight; the first that stays below its stop sets the level
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.select("*", F.sum("source_size").over(everything).alias("all_s"), F.sum("w").over(everything).alias("all_w"),
                     F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"),
                     F.row_number().over(fill).alias("k"))
    num, den = share
    per = per.select("*", (num * F.col("all_s") - den * most * F.col("s0")).alias("left_s"), (den * (F.col("all_w") - F.col("w0"))).alias("left_w"))
    below = F.col("left_s") * F.col("w") <= most * F.col("source_size") * F.col("left_w")
    level = per.select("*", F.min_by(F.struct("k", "left_s", "left_w"), F.when(below, F.col("k"))).over(everything).alias("level"))
    target = F.when(F.col("level.k").isNull() | (F.col("k") < F.col("level.k")), (most * F.col("source_size")).cast("double")).otherwise(
        (F.col("level.left_s") * F.col("w")).cast("double") / F.col("level.left_w").cast("double"))
    return level.select("source", "source_size", target.alias("target"))


def probabilities(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(key, certain, rate): of a source's documents those above the size `certain` have p = 1, the others rate * size."""
    per = sized.groupBy("key", "size").agg(F.count("*").alias("n")).where("size > 0")  # a row a distinct size
    words, squares = F.col("size") * F.col("n"), (F.col("size") * F.col("size") * F.col("n")).cast("decimal(38,0)")
    larger = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(0, Window.unboundedFollowing)
    per = per.select("key", "size", F.coalesce(F.sum(words).over(larger), F.lit(0)).cast("double").alias("above"), F.sum(squares).over(rest).cast("double").alias("squares"))
    per = per.join(few_bytes(goals.select("key", "left"), F.octet_length("key") + 16), "key").withColumn("rate", (F.col("left") - F.col("above")) / F.col("squares"))
    fits = (F.col("rate") > 0) & (F.col("rate") * F.col("size").cast("double") <= 1)
    return per.where(fits).groupBy("key").agg(F.max(F.struct("size", "rate")).alias("x")).select("key", F.col("x.size").alias("certain"), "x.rate")


def rank(u: Column, p: Column) -> Column:
    """q / (1 + q) of the Pareto rank q, as an integer below UNIT; u in units of 1 / UNIT."""
    u = (u.cast("double") + 0.5) / float(UNIT)
    top = u * (1 - p)
    return F.least(F.floor(top / (top + p * (1 - u)) * float(UNIT)).cast("long"), F.lit(UNIT - 1))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs' ids with size, source_size, target, copies, p and taken; one row a row of docs, with the carried columns."""
    if clash := {"doc_id", "size", "source_size", "target", "copies", "taken", "p"} & {c.lower() for c in carry}:
        raise ValueError(f"columns named as the result's: {sorted(clash)}")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null is a source
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")
    sized = written(docs.select("doc_id", "source", size.alias("size"), u.alias("u"), key.alias("key"), kept.alias("kept")))
    targets = source_targets(sized, weights, share, most).withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long"))
    goals = written(targets.select(key.alias("key"), "source_size", "target", "whole", (F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")).alias("left")))
    goals = written(goals.join(probabilities(sized, goals), "key", "left"))
    by_key = lambda df: few_bytes(df, F.octet_length("key") + 80)
    chance = F.when(F.col("size") > F.col("certain"), 1.0).otherwise(F.coalesce(F.col("rate") * F.col("size").cast("double"), F.lit(0.0)))
    chance = F.when(F.col("rate").isNull(), 0.0).otherwise(F.least(chance, F.lit(1.0)))
    # a rank is asked of what may be drawn: the rest come last
    at = F.when(F.col("p") > 0, rank(F.col("u"), F.col("p"))).otherwise(F.lit(UNIT - 1))
    ranked = sized.join(by_key(goals.select("key", "certain", "rate")), "key").withColumn("p", chance).withColumn("at", at).drop("certain", "rate")
    slot = lambda shift: F.shiftright("at", 52 - shift)
    ahead = lambda by: Window.partitionBy("key").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)

    def crossing(sums: DataFrame, to_fill: DataFrame, by: str) -> DataFrame:
        """The interval into which each source's cut falls, and the words before it."""
        sums = sums.select("key", by, "words", F.coalesce(F.sum("words").over(ahead(by)), F.lit(0)).alias("before"))
        sums = sums.join(to_fill, "key").where((F.col("filled") + F.col("before")).cast("double") < F.col("left"))
        return sums.groupBy("key").agg(F.max_by(F.struct(F.col(by), (F.col("filled") + F.col("before")).alias("filled")), F.col(by)).alias("x")).select("key", f"x.{by}", "x.filled")

    start = goals.select("key", "left", F.lit(0).cast("long").alias("filled"))
    rows = ranked.select("key", "doc_id", "size", "at")
    first = written(crossing(rows.groupBy("key", slot(BITS).alias("a")).agg(F.sum("size").alias("words")), start, "a"))
    inner = rows.join(by_key(first), "key").where(slot(BITS) == F.col("a"))
    second = written(crossing(inner.groupBy("key", slot(2 * BITS).alias("b")).agg(F.sum("size").alias("words")),
                              goals.join(first, "key").select("key", "left", "filled"), "b"))
    last = rows.join(by_key(second), "key").where(slot(2 * BITS) == F.col("b")).join(by_key(goals.select("key", "left")), "key")
    order = Window.partitionBy("key").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("key", "b", "at", "doc_id", "size", "left", (F.col("filled") + F.coalesce(F.sum("size").over(order), F.lit(0))).alias("before"))
    # a row is in if that brings the source nearer to its target than leaving it out
    fits = (F.col("before").cast("double") + F.col("size").cast("double") / 2) <= F.col("left")
    cut = last.groupBy("key").agg(F.first("b").alias("b"), F.max(F.when(fits, F.struct("at", "doc_id", "size"))).alias("cut"))
    ends = by_key(written(goals.select("key", "source_size", "target", "whole").join(cut, "key", "left")))
    joined = ranked.join(ends, "key", "left")
    taken = F.when(F.col("b").isNull(), False).when(slot(2 * BITS) < F.col("b"), True).when(slot(2 * BITS) > F.col("b"), False).otherwise(
        F.coalesce(F.struct("at", "doc_id", "size") <= F.col("cut"), F.lit(False)))
    copies = F.coalesce(F.col("whole"), F.lit(0)) + taken.cast("long")
    own = ("doc_id", "size", "source_size", "target")
    return joined.select(*own, (copies * F.col("size")).alias("taken"), copies.alias("copies"), "p", *[F.col(f"kept.`{c}`") for c in carry])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS u FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM p),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_s, CAST(sum(w) OVER () AS BIGINT) AS all_w,
    CAST(coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS s0, CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS w0,
    row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST) AS k FROM w
  WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, 3 * all_s - 4 * s0 AS left_s, 2 * (all_w - w0) AS left_w FROM f),
l AS (SELECT k AS k0, left_s AS ls, left_w AS lw FROM g WHERE left_s * w <= 2 * source_size * left_w ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN k < k0 THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(ls * w AS DOUBLE) / CAST(lw AS DOUBLE) END AS target FROM g, l),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 2) AS BIGINT) ELSE 0 END AS whole FROM t),
h2 AS (SELECT *, target - CAST(whole * source_size AS DOUBLE) AS rest FROM h),
z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
y AS (SELECT source, size, CAST(coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS above,
    CAST(sum(size * size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS squares FROM z),
x AS (SELECT y.source, y.size, (h2.rest - above) / squares AS rate FROM y JOIN h2 ON y.source IS NOT DISTINCT FROM h2.source),
r AS (SELECT source, max(size) AS certain, max_by(rate, size) AS rate FROM x WHERE rate > 0 AND rate * CAST(size AS DOUBLE) <= 1 GROUP BY source),
q AS (SELECT d.*, h2.source_size, h2.target, h2.whole, h2.rest,
    CASE WHEN r.rate IS NULL THEN 0.0::DOUBLE WHEN d.size > r.certain THEN 1.0::DOUBLE ELSE least(r.rate * CAST(d.size AS DOUBLE), 1.0::DOUBLE) END AS p,
    (CAST(u AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS v
  FROM d JOIN h2 ON d.source IS NOT DISTINCT FROM h2.source LEFT JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, CASE WHEN p > 0 THEN least(CAST(floor((v * (1 - p)) / ((v * (1 - p)) + p * (1 - v)) * 4503599627370496.0::DOUBLE) AS BIGINT), 4503599627370495) ELSE 4503599627370495 END AS place FROM q),
o AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM k),
c AS (SELECT *, whole + CASE WHEN CAST(before AS DOUBLE) < rest AND CAST(before AS DOUBLE) + CAST(size AS DOUBLE) / 2 <= rest THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, p FROM c
"""

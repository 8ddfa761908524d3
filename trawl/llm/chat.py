"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A conversation may be logged anew after every turn, so that shorter logs prefix longer ones. Each row has a 120-bit hash
of its turn number, role and text; the sum of the hashes up to a row, in the order of number, role and hash, is the hash
of that prefix. A conversation whose whole hash is that of a proper prefix of another is dropped by an anti-join; of
equal ones the smallest id stays. What is left is rendered, a row a conversation.

Hashes stand for the texts until only the kept conversations are left: no other texts are shuffled. Rolling
sums are taken within blocks of turn numbers and then over the blocks, and rendering goes by the same blocks, which are
joined at the end: only the text that is returned has to fit in memory.

Defined results: equal rows of a conversation count once; rows with one turn number and other texts follow one another
by role (nulls first), then by hash; a null turn number comes first (as -1), a null text is an empty one, a null role is
`none`; both differ from the empty text and role; rows without a conv_id belong to no conversation and are left out; an
empty table gives an empty result; extra columns are ignored; a text of any length is rendered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import few, table, written

BLOCK = 256
#: What two rows of one turn number are ordered by, after it.
ORDER = ("turn", "role", "digest")
OPEN, CLOSE = "<|", "|>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, turn, role, digest, text), with repeated rows."""
    marked = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    rows = conversations.where("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), "role", "text")
    digest = F.md5(F.concat_ws("\x1f", F.col("turn").cast("string"), F.length(marked("role")).cast("string"), marked("role"), marked("text")).cast("binary"))
    return rows.select("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"), "turn", "role", digest.alias("digest"), "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, block, row, prefix): the hash of the conversation up to and with a row, in its order; one row a distinct row of turns."""
    turns = turns.select("conv_id", "block", "turn", "role", "digest").distinct()
    each = turns.select("*", *[F.conv(F.substring("digest", 1 + 10 * i, 10), 16, 10).cast("long").alias(f"h{i}") for i in range(3)])  # 40 bits each
    block = Window.partitionBy("conv_id", "block").orderBy(*ORDER)
    within = block.rowsBetween(Window.unboundedPreceding, 0)
    each = written(each.select("conv_id", "block", F.row_number().over(block).alias("row"), *[F.sum(f"h{i}").over(within).alias(f"h{i}") for i in range(3)]))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = each.groupBy("conv_id", "block").agg(F.max(F.struct("row", "h0", "h1", "h2")).alias("x"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.sum(f"x.h{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in range(3)])
    return each.join(blocks, ["conv_id", "block"]).select("conv_id", "block", "row", F.concat_ws(":", *[(F.col(f"h{i}") + F.col(f"b{i}")).cast("string") for i in range(3)]).alias("prefix"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_copies) of the conversations that no other one continues; of equal ones the first."""
    rolled = written(prefixes(turns))
    whole = rolled.groupBy("conv_id").agg(F.max_by("prefix", F.struct("block", "row")).alias("prefix"))
    ends = whole.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    passed = rolled.groupBy("prefix").agg(F.count("*").alias("n"))
    ends = written(ends)
    continued = ends.join(passed, "prefix").where(F.col("n") > F.col("n_copies")).select("prefix")
    return ends.join(continued, "prefix", "left_anti").select("conv_id", "n_copies")


def rendered(role: Column, text: Column) -> Column:
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |"))  # a text can't open a turn of its own
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("none")), F.lit(CLOSE + "\n"), plain, F.lit("\n" + OPEN + "end" + CLOSE + "\n"))


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: a row for each maximal conversation."""
    turns = turns_of(conversations)
    kept = few(written(maximal(turns)), 16)
    # a set: repeated rows are one before they are shuffled
    rows = turns.join(kept, "conv_id").groupBy("conv_id", "block", "n_copies").agg(F.array_sort(F.collect_set(F.struct(*ORDER, "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: rendered(x["role"], x["text"])), "")
    blocks = rows.select("conv_id", "n_copies", F.size("turns").cast("long").alias("n"), F.struct("block", text.alias("text")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "")
    return blocks.groupBy("conv_id", "n_copies").agg(F.sum("n").alias("n_turns"), whole.alias("rendered")).select("conv_id", "n_turns", "n_copies", "rendered")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH r AS (SELECT conv_id, CAST(coalesce(turn, -1) AS BIGINT) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT DISTINCT *, md5(concat(turn, chr(31), length(coalesce('=' || role, '')), chr(31), coalesce('=' || role, ''), chr(31), coalesce('=' || text, ''))) AS digest FROM r),
p AS (SELECT conv_id, turn, string_agg(digest, ',') OVER w AS prefix,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC NULLS LAST, digest DESC) AS back FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE back = 1 GROUP BY prefix),
k AS (SELECT conv_id, n_copies FROM e WHERE prefix NOT IN (SELECT prefix FROM p WHERE back > 1))
SELECT t.conv_id, count(*) AS n_turns, n_copies,
  string_agg(concat('<|', coalesce(role, 'none'), '|>', chr(10), replace(coalesce(text, ''), '<|', '< |'), chr(10), '<|end|>', chr(10)), '' ORDER BY turn, role NULLS FIRST, digest) AS rendered
FROM t JOIN k ON t.conv_id = k.conv_id GROUP BY 1, 3
"""

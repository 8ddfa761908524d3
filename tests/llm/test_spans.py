"""Spans and rewritten texts against plain Python, at sizes where quadratic work would not end."""

import random
import re

from pyspark.sql import functions as F

from trawl.llm import pii, secrets, spans


def rewritten(text, found):
    out, at = "", 0
    for a, b, by in sorted(found):
        if a >= at:
            out += text[at:a] + by
        at = max(at, b)
    return out + text[at:]


def test_spans_of_random_texts(spark):
    rng, rows = random.Random(1), []
    texts = ["".join(rng.choice("ab1 é𝒳\n'") for _ in range(rng.randrange(0, 4000))) for _ in range(40)] + ["", "1", "a1", "x" * 5000 + "1" + "y" * 5000]
    for t in texts:
        found = []
        for _ in range(rng.randrange(0, 30) if t else 0):
            a = rng.randrange(len(t))
            found.append((a, min(len(t), a + rng.randrange(1, 1500 if rng.random() < .1 else 9)), f"[{rng.randrange(3)}]"))
        rows.append((t, found))
    df = spark.createDataFrame(rows, "t string, s array<struct<start:int,end:int,by:string>>")
    own = df.select("t", "s", spans.matches(F.col("t"), "[0-9']+").alias("m"), spans.matches(F.col("t"), F.lit("[0-9']+")).alias("n"),
                    spans.replaced(F.col("t"), F.col("s")).alias("r"), spans.blanked(F.col("t"), F.col("s")).alias("b"))
    for r in own.collect():
        assert [(x.start, x.end, x.match) for x in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9']+", r.t)] == [(x.start, x.end, x.match) for x in r.n]
        assert r.r == rewritten(r.t, [tuple(x) for x in r.s])
        blank = list(r.t)
        for x in r.s:
            blank[x.start:x.end] = " " * (x.end - x.start)
        assert r.b == "".join(blank)


def test_one_text_of_many_matches(spark):
    """5 MB with 200 000 addresses, and with as many secrets."""
    text = "a@b.example some words  " * 200_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    clean = pii.sanitised(docs, spark.createDataFrame([], "term string, kind string, disclosure double")).first().text
    assert clean == text.replace("a@b.example", "[email]")
    keys = "token=abcdefghijklmnop plain " * 180_000
    found = secrets.found(spark.createDataFrame([(1, keys)], "doc_id long, text string")).first().spans
    assert len(found) == 180_000 and [(s.start, s.end) for s in found[:2] + found[-1:]] == [(0, 22), (29, 51), (29 * 179_999, 29 * 179_999 + 22)]

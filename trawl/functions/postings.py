"""The sparse vectors of whole collections as (token, id, weight) rows, by Arrow functions.

`text` has the same vectors as columns, whose lambdas are interpreted for each token: right for queries, and for a vector
that is kept with its row. Here a row's tokens are counted, weighted and pruned in Python; lower case and white space stay
Spark's, so tokens are the same, and so are the weights to the last bit.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions import stem, text

#: Rows whose postings are made at once.
ROWS = 500
#: Characters from which trigrams are counted by sorting their code points.
LONG = 200


def saturated(tf: int, length: int, avgdl: float, base: float = 1.0) -> float:
    """`text.saturated` of numbers."""
    return base * tf * (text.K1 + 1) / (tf + text.K1 * ((1 - text.B) + text.B * length / avgdl))


def heaviest(weights: dict[str, float], k: int) -> dict[str, float]:
    """The k heaviest, ties to the smaller token."""
    if len(weights) <= k:
        return weights
    if k < 1:
        return {}
    last = sorted(weights.values(), reverse=True)[k - 1]
    kept = {t: w for t, w in weights.items() if w > last}
    for t in sorted(t for t, w in weights.items() if w == last)[:k - len(kept)]:
        kept[t] = last
    return kept


def weighted(tf: dict[str, int], length: int, avgdl: float, base: float = 1.0) -> dict[str, float]:
    of = {n: saturated(n, length, avgdl, base) for n in set(tf.values())}
    return {t: of[n] for t, n in tf.items()}


def frequent_grams(padded: str, k: int) -> dict[str, int]:
    """The k most frequent character trigrams, ties to the smaller one."""
    if len(padded) < LONG:
        return heaviest(Counter(map("".join, zip(padded, padded[1:], padded[2:]))), k)
    points = np.frombuffer(padded.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    found, n = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)  # in the tokens' order
    best = np.argsort(-n, kind="stable")[:max(k, 0)]
    return {chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF): c for g, c in zip(found[best].tolist(), n[best].tolist())}


def whitespace(avgdl: float, top_k: int, wanted: frozenset[str] | None = None, stop: tuple[str, ...] = ()) -> Callable[[str], dict[str, float]]:
    """text: preprocessed. wanted: the only tokens to return; pruning is by all."""
    stop = frozenset(stop)

    def vector(value: str) -> dict[str, float]:
        words = value.split(" ")
        if wanted is not None and wanted.isdisjoint(words):
            return {}
        return _of_tokens([w for w in words if w and w not in stop], avgdl, top_k, wanted)

    return vector


def trigrams(avgdl: float, top_k: int, wanted: frozenset[str] | None = None) -> Callable[[str], dict[str, float]]:
    def vector(value: str) -> dict[str, float]:
        if not value:
            return {}
        padded = f"  {value}  "
        tf = frequent_grams(padded, top_k)
        return weighted(tf if wanted is None else {t: n for t, n in tf.items() if t in wanted}, len(padded) - 2, avgdl)

    return vector


def _of_tokens(tokens: list[str], avgdl: float, top_k: int, wanted: frozenset[str] | None = None) -> dict[str, float]:
    tf = heaviest(Counter(tokens), top_k)
    return weighted(tf if wanted is None else {t: n for t, n in tf.items() if t in wanted}, len(tokens), avgdl)


def full_text(avgdl: float, top_k: int, stop: tuple[str, ...] = ()) -> Callable[[str, str | None], dict[str, float]]:
    """text: in lower case. language: two letters, or None."""
    stop = frozenset(stop)

    def vector(value: str, language: str | None) -> dict[str, float]:
        tf = stems(value, language, stop)
        return weighted(heaviest(tf, top_k), sum(tf.values()), avgdl)

    return vector


@lru_cache(maxsize=2)
def word_pattern(last: int = 0xFFFF) -> re.Pattern:
    """`text.WORD` in Python's syntax, which has no classes by category, for characters up to `last`: classes within 16 bits are bitmaps."""
    def members(kind: str, last: int) -> str:
        found, begin = [], None
        for i in range(last + 2):
            inside = i <= last and unicodedata.category(chr(i))[0] == kind
            if inside and begin is None:
                begin = i
            elif not inside and begin is not None:
                found.append(f"\\U{begin:08x}-\\U{i - 1:08x}")
                begin = None
        return "".join(found)

    pattern = text.WORD
    for kind in "LNM":
        own = members(kind, last)
        pattern = pattern.replace(f"(?<=\\p{{{kind}}})", f"(?<=[{members(kind, 0xFFFF)}])")  # Java looks back by 16 bits
        pattern = pattern.replace(f"(?=\\p{{{kind}}})", f"(?=[{own}])").replace(f"\\p{{{kind}}}", own)
    return re.compile(pattern)


def found_words(value: str) -> list[str]:
    wide = len(value.encode("utf-16-le")) != 2 * len(value) and any(c > "\uffff" and unicodedata.category(c)[0] in "LNM" for c in value)
    return word_pattern(sys.maxunicode if wide else 0xFFFF).findall(value)


def stems(value: str, language: str | None, stop: frozenset[str] = frozenset()) -> dict[str, int]:
    """How often `text.word_tokens` and `stem.stemmed` give each stem: of words with a letter or digit, each stemmed once."""
    tf: dict[str, int] = {}
    for w, n in Counter(found_words(value)).items():
        if (w.isalnum() or any(c.isalnum() for c in w)) and w not in stop:
            s = stem.stem(w, language)
            tf[s] = tf.get(s, 0) + n
    return tf


def multilevel(avgdl: float, top_k: int, word_ratio: int, trigram_weight: float, stop: tuple[str, ...] = ()) -> Callable[[str, str | None, float], dict[str, float]]:
    """`text.multilevel_vector`. text: preprocessed. boost: `length_boost` of the text."""
    word_k, stop = top_k * word_ratio // 100, frozenset(stop)

    def vector(value: str, language: str | None, boost: float) -> dict[str, float]:
        if not value:
            return {}
        all_stems, words = stems(value, language), [w for w in value.split(" ") if w and w not in stop]
        n, chars = sum(all_stems.values()), float(len(value))

        def channel(tf: dict[str, int], prefix: str, base: float) -> dict[str, float]:
            out = {}
            of = {c: saturated(c, n, avgdl, base) for c in set(tf.values())}
            for t, c in tf.items():
                size = len(t) if t.isascii() else len(t.encode())
                out[prefix + t] = of[c] + size / chars * boost if size >= 3 else of[c]
            return out

        rest = {t: c for t, c in Counter(words).items() if t not in all_stems}
        made = heaviest(channel(rest, "#", text.WORD_WEIGHT) | channel(all_stems, "##", text.STEM_WEIGHT), word_k)
        tri = frequent_grams(f" {' '.join(words)} ", top_k - word_k) if words else {}
        return made | {"###" + t: w for t, w in weighted(tri, n, avgdl, trigram_weight).items()}

    return vector


def length_boost(value: Column) -> Column:
    """The weight of a word's share of a text, by the text's length."""
    return F.lit(text.LENGTH_BOOST) * F.least(F.lit(1.0), 1 / F.greatest(F.lit(1.0), F.log10(F.length(value).cast("double"))))


def made(rows: DataFrame, vector: Callable[..., dict[str, float]]) -> DataFrame:
    """(token, id, weight). rows: the id, whatever its name and type, then the vector's arguments."""
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("id", rows.schema.fields[0].dataType), T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                tokens, weights, sizes = [], [], []
                for args in zip(*(c.to_pylist() for c in part.columns[1:])):
                    found = vector(*args)
                    tokens.extend(found.keys())
                    weights.extend(found.values())
                    sizes.append(len(found))
                if tokens:
                    ids = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                    yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), ids, pa.array(weights, pa.float64())], names=["token", "id", "weight"])

    return rows.mapInArrow(run, schema)

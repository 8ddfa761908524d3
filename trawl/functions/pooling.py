"""What turns a model's token output into vectors: pooling of token states, and sparse vectors of token logits.

A row's states are an array of tokens, each an array of numbers, with a mask of 1 and 0 a token. The maths is column
functions; `dense_model` and `sparse_model` put any encoder before it, called with batches of texts on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.config import ConfigError
from trawl.functions import dense

MODES = ("cls", "max", "mean", "mean_sqrt_len_tokens", "weightedmean", "lasttoken")
MODEL_BATCH = 8


def _shown(states: Column, mask: Column) -> Column:
    """(state, place from 1) of the tokens that the mask keeps."""
    rows = F.zip_with(F.transform(states, lambda x, i: F.struct(x.alias("state"), (i + 1).alias("place"))), mask, lambda x, m: F.struct(x["state"].alias("state"), x["place"].alias("place"), m.alias("m")))
    return F.filter(rows, lambda x: x["m"] != 0)


def _sums(shown: Column, size: Column, weight: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda d: F.aggregate(shown, F.lit(0.0), lambda t, x: t + F.get(x["state"], d) * weight(x)))


def pooled(states: Column, mask: Column, modes: tuple[str, ...] = ("mean",)) -> Column:
    """The pooled vectors of the modes, one after the other. Without a token that the mask keeps, sums are 0 and means divide by one."""
    if unknown := set(modes) - set(MODES):
        raise ConfigError(f"unknown pooling {sorted(unknown)}")

    def vectors(x: Column) -> Column:
        shown, size = x["shown"], F.size(F.get(x["states"], F.lit(0)))
        n = F.greatest(F.size(shown), F.lit(1)).cast("double")
        weights = F.greatest(F.aggregate(shown, F.lit(0.0), lambda t, y: t + y["place"]), F.lit(1.0))
        one = lambda y: F.lit(1.0)
        none = F.transform(F.sequence(F.lit(0), size - 1), lambda d: F.lit(0.0))
        made = {
            "cls": lambda: F.get(x["states"], F.lit(0)),
            "max": lambda: F.transform(F.sequence(F.lit(0), size - 1), lambda d: F.array_max(F.transform(shown, lambda y: F.get(y["state"], d)))),
            "mean": lambda: F.transform(_sums(shown, size, one), lambda v: v / n),
            "mean_sqrt_len_tokens": lambda: F.transform(_sums(shown, size, one), lambda v: v / F.sqrt(n)),
            "weightedmean": lambda: F.transform(_sums(shown, size, lambda y: y["place"].cast("double")), lambda v: v / weights),
            "lasttoken": lambda: F.coalesce(F.get(shown, F.size(shown) - 1)["state"], none),
        }
        return F.concat(*[made[m]() for m in modes])

    doubles = F.transform(states, lambda x: x.cast("array<double>"))
    return F.transform(F.array(F.struct(doubles.alias("states"), _shown(doubles, mask).alias("shown"))), vectors)[0]


def sparse_logits(logits: Column, mask: Column, special: tuple[int, ...] = (), top_k: int = 128) -> Column:
    """Array of (index, value): log(1 + max(0, the largest logit of kept tokens)) of each place that isn't special, the largest top_k, ties to the smaller index."""
    shown = _shown(F.transform(logits, lambda x: x.cast("array<double>")), mask)
    size = F.size(F.get(logits, F.lit(0)))
    scores = F.transform(F.sequence(F.lit(0), size - 1), lambda d: F.struct(
        F.log1p(F.greatest(F.coalesce(F.array_max(F.transform(shown, lambda y: F.get(y["state"], d))), F.lit(0.0)), F.lit(0.0))).alias("value"), d.alias("index")))
    kept = F.filter(scores, lambda x: (x["value"] > 0) & (~x["index"].isin(*special) if special else F.lit(True)))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct((-x["value"]).alias("less"), x["index"].alias("index"))))
    return F.transform(F.slice(ordered, 1, top_k), lambda x: F.struct(x["index"].alias("index"), (-x["less"]).alias("value")))


Encoder = Callable[[list[str]], list[tuple[list[list[float]], list[int]]]]


def encoded(docs: DataFrame, text: str, encoder: Encoder, batch: int = MODEL_BATCH) -> DataFrame:
    """docs with _states and _mask, as the encoder gives them for batches of texts; null texts are empty ones."""
    @F.pandas_udf("states array<array<float>>, mask array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            texts = texts.fillna("").tolist()
            out = [x for at in range(0, len(texts), batch) for x in encoder(texts[at:at + batch])]
            yield pd.DataFrame(out, columns=["states", "mask"])

    return docs.withColumn("_encoded", run(F.col(text))).select("*", F.col("_encoded.states").alias("_states"), F.col("_encoded.mask").alias("_mask")).drop("_encoded")


def dense_model(docs: DataFrame, text: str, encoder: Encoder, modes: tuple[str, ...] = ("mean",), normalize: bool = True, name: str = "embedding") -> DataFrame:
    """docs with an embedding of a text column."""
    vector = pooled(F.col("_states"), F.col("_mask"), modes)
    return encoded(docs, text, encoder).withColumn(name, dense.normalised(vector) if normalize else vector).drop("_states", "_mask")


def sparse_model(docs: DataFrame, text: str, encoder: Encoder, special: tuple[int, ...] = (), top_k: int = 128, name: str = "sparse") -> DataFrame:
    """docs with a sparse vector (index, value) of a text column, from an encoder whose states are logits over a vocabulary."""
    return encoded(docs, text, encoder).withColumn(name, sparse_logits(F.col("_states"), F.col("_mask"), special, top_k)).drop("_states", "_mask")

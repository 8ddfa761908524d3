"""Dense vectors in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """a over its length; a as it is where that is nothing."""
    length = norm(a)
    return F.when(length > 1e-9, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def similarity(a: Column, b: Column, distance: str) -> Column:
    """Larger is nearer: cosine (null for a zero vector), dot, or the negative Euclidean distance."""
    if distance == "dot":
        return dot(a, b)
    if distance == "cosine":
        lengths = norm(a) * norm(b)
        return F.when(lengths > 0, dot(a, b) / lengths)
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.lit(0.0) - F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))

"""Nested joins between collections: every parent keeps its row and gets an array of matching children.

Syntax: `collection[$id = $$.meta.key](filter)`, `$` for the parent and `$$` for the child; keys are id = id without
brackets. Keys match by type: keys declared with different types never match.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.config import ID, ConfigError
from trawl.operators import filters

_KEY = r"id|\.?meta\.[A-Za-z0-9_-]+"
_SPEC = re.compile(rf"\s*([A-Za-z0-9_-]+)\s*(?:\[\s*\$({_KEY})\s*=\s*\$\$({_KEY})\s*\])?\s*(?:\((.*)\))?\s*", re.S)


class JoinError(ConfigError):
    """A join that can't be read or planned."""


@dataclass(frozen=True)
class JoinSpec:
    collection: str
    parent_key: str | None = None  # None: the id
    child_key: str | None = None
    filter: object = None


def _key(text: str | None) -> str | None:
    return None if text in (None, "id") else text.lstrip(".").removeprefix("meta.")


def parse(text: str) -> JoinSpec:
    m = _SPEC.fullmatch(text)
    if not m or not ID.fullmatch(m[1]):
        raise JoinError(f"invalid join {text!r}")
    keys = _key(m[2]), _key(m[3])
    if any(k is not None and len(k) > 100 for k in keys):
        raise JoinError("a join key is too long")
    return JoinSpec(m[1], *keys, filters.parse(m[4]) if m[4] and m[4].strip() else None)


def parse_all(texts: str | list[str] | tuple[str, ...]) -> list[JoinSpec]:
    specs = [parse(t) for t in ([texts] if isinstance(texts, str) else texts)]
    if not specs or len({s.collection for s in specs}) < len(specs):
        raise JoinError("joins need at least one collection, and each once")
    return specs


def validate(spec: JoinSpec, collections: Mapping[str, Mapping[str, str]]) -> None:
    """collections: the declared types of each collection's metadata."""
    if spec.collection not in collections:
        raise JoinError(f"unknown collection {spec.collection!r}")
    types = collections[spec.collection]
    if spec.child_key is not None and spec.child_key not in types:
        raise JoinError(f"child key {spec.child_key!r} isn't indexed")
    if spec.filter is not None:
        filters.validate(spec.filter, types)


def key_column(key: str | None) -> Column:
    return F.col("id") if key is None else F.col(f"meta_{key}")


def attach(parents: DataFrame, children: DataFrame, spec: JoinSpec, types: Mapping[str, str], columns: list[str], *, parent_types: Mapping[str, str] | None = None, cap: int | None = None) -> DataFrame:
    """parents with joined_<collection>: an array of structs of the children's columns, by child id; empty without any.

    cap: the most children in all (the parents' limit each, together), the first by id; None attaches every child.
    """
    name = f"joined_{spec.collection}"
    kinds = ("string" if spec.parent_key is None else (parent_types or {}).get(spec.parent_key), "string" if spec.child_key is None else types.get(spec.child_key))
    same = kinds[0] is None or kinds[1] is None or kinds[0] == kinds[1]
    if spec.filter is not None:
        children = children.where(filters.compiled(spec.filter, types))
    child_key = key_column(spec.child_key)
    children = children.where(child_key.isNotNull() if same else F.lit(False))
    keys = parents.select(key_column(spec.parent_key).alias("_key")).where("_key is not null").distinct()
    found = children.withColumn("_key", child_key).join(keys, "_key", "left_semi")
    if cap is not None and spec.child_key is not None:
        found = found.orderBy("id").limit(cap)
    nested = found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in columns if c != "id"]))).alias(name))
    joined = parents.withColumn("_key", key_column(spec.parent_key)).join(nested, "_key", "left").drop("_key")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(dict(nested.dtypes)[name])))


def semi_join_reduction(children: DataFrame, parents: DataFrame, parent_key: Column, child_key: str) -> DataFrame:
    """Children whose key is among the parents' distinct keys."""
    return children.join(parents.select(parent_key.alias(child_key)).where(F.col(child_key).isNotNull()).distinct(), child_key, "left_semi")


def capped_children(found: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` children of each key, the first by id."""
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where(F.col("_n") <= most).drop("_n")

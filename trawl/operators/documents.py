"""Point lookups, cursor scans, payload shaping and templates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.config import ConfigError


def multi_get(docs: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """A row for each id, in their order (pos from 0), null where there is none. ids: a request's list."""
    kind = dict(docs.dtypes)[id_col]
    wanted = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, {id_col} {kind}")
    found = docs.join(F.broadcast(wanted.select(id_col).distinct()), id_col, "left_semi")
    return wanted.join(found.withColumn("found", F.lit(True)), id_col, "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("pos")


def fetch_page(docs: DataFrame, page_size: int = 100, after=None, where: Column | None = None, id_col: str = "id") -> DataFrame:
    """A page in id order; `more` tells whether another one follows, whose `after` is the page's last id."""
    if not 1 <= page_size <= 1000:
        raise ConfigError("page_size must be from 1 to 1000")
    rows = docs if where is None else docs.where(where)
    if after is not None:
        rows = rows.where(F.col(id_col) > after)
    ahead = rows.orderBy(id_col).limit(page_size + 1)
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy())  # of at most page_size + 1 rows
    place = F.row_number().over(Window.orderBy(id_col))
    return ahead.withColumns({"_n": n, "_place": place}).where(F.col("_place") <= page_size).withColumn("more", F.col("_n") > page_size).drop("_n", "_place")


def fetch_by_values(docs: DataFrame, column: str, values: list, where: Column | None = None, limit: int | None = None, id_col: str = "id") -> DataFrame:
    """Documents with one of a request's values, that a filter lets through, the first by id."""
    rows = docs.where(F.col(column).isin(*dict.fromkeys(values)))
    rows = rows if where is None else rows.where(where)
    return rows.orderBy(id_col).limit(limit) if limit is not None else rows


def excluded(docs: DataFrame, exclude: tuple[str, ...]) -> DataFrame:
    """docs with the excluded fields null, in joined children too; they stay in the schema."""
    out = {}
    for f in docs.schema.fields:
        if f.name in exclude or (f.name.startswith("meta_") and "metadata" in exclude):
            out[f.name] = F.lit(None).cast(f.dataType)
        elif f.name.startswith("joined_") and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            child = f.dataType.elementType
            out[f.name] = F.transform(f.name, _without(child, exclude))
    return docs.withColumns(out) if out else docs


def _without(child: T.StructType, exclude: tuple[str, ...]) -> Callable[[Column], Column]:
    hidden = [f for f in child.fields if f.name in exclude or (f.name.startswith("meta_") and "metadata" in exclude)]

    def hide(x: Column) -> Column:
        for f in hidden:
            x = x.withField(f.name, F.lit(None).cast(f.dataType))
        return x

    return hide


def needed_columns(docs: DataFrame, exclude: tuple[str, ...], also: tuple[str, ...] = ()) -> DataFrame:
    """Only what a result shows, and what joins, groups and facets need though it's hidden."""
    hidden = {c for c in docs.columns if c in exclude or (c.startswith("meta_") and "metadata" in exclude)} - set(also)
    return docs.select(*[c for c in docs.columns if c not in hidden])


def flattened_metadata(value: Column, kind: str = "string") -> Column:
    """A variant value, or the value in a wrapper {"value": v, "type": t} of just these two keys."""
    keys = F.json_object_keys(F.to_json(value))
    wrapped = F.coalesce(F.array_sort(keys) == F.array(F.lit("type"), F.lit("value")), F.lit(False))
    return F.when(wrapped, F.try_variant_get(value, "$.value", kind)).otherwise(F.try_variant_get(value, "$", kind))


def without_content(docs: DataFrame, hashed: Column | None = None) -> DataFrame:
    """Collections that don't store content keep its hash."""
    return docs.withColumn("content_hash", hashed if hashed is not None else F.coalesce("content_hash", F.xxhash64("content").cast("string"))).drop("content")


_PLACE = re.compile(r"\{(\w+|\.meta\.[A-Za-z0-9_-]+)\}")


def document_text(template: str, columns: dict[str, str]) -> Column:
    """A template's text: {name} {description} {content} {.meta.key}; nulls are empty, arrays are joined by spaces.

    columns: the Spark types of the columns (`dict(df.dtypes)`). All blank gives the empty text for the whole.
    """
    parts, values, at = [], [], 0
    for m in _PLACE.finditer(template):
        name = m[1].replace(".meta.", "meta_")
        if name not in columns or not (name in ("name", "description", "content") or m[1].startswith(".meta.")):
            raise ConfigError(f"unknown place {m[0]} in template")
        parts.append(F.lit(template[at:m.start()]))
        kind = columns[name]
        value = F.array_join(F.col(name).cast("array<string>"), " ") if kind.startswith("array") else F.lit("") if kind.startswith(("struct", "map")) else F.col(name).cast("string")
        values.append(F.coalesce(value, F.lit("")))
        parts.append(values[-1])
        at = m.end()
    if not values:
        raise ConfigError("a template needs a place")
    parts.append(F.lit(template[at:]))
    return F.when(F.trim(F.concat(*values)) != "", F.concat(*parts)).otherwise("")


def query_text(template: str, query: str) -> str:
    if template.count("{query}") != 1:
        raise ConfigError("a query template has {query} once")
    return template.replace("{query}", query)

"""Metadata and tag filters: a small language, its tree form, static typing, and two-valued Spark columns.

A comparison is false where the key is missing or null, and NOT turns that into true. Precedence is NOT, AND, OR;
keywords are words of their own, in any case; an expression must be read to its end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.config import ConfigError

OPS = {"=": "eq", "==": "eq", "!=": "neq", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}
TOKEN = re.compile(r"""\s*(?:
    (?P<string>"(?:[^"\\]|\\.)*") | (?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.]) |
    (?P<op><=|>=|!=|==|=|<|>) | (?P<bracket>[()]) | (?P<word>[A-Za-z0-9][A-Za-z0-9_-]*)(?![\w.]) )""", re.X)


@dataclass(frozen=True)
class Comparison:
    key: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Node:
    """A conjunction of: all of `all`, any of `any` (if given), and the negation of `no` (if given)."""

    all: tuple = ()
    any: tuple = ()
    no: object = None


class FilterError(ConfigError):
    """A filter that can't be read, or doesn't fit the declared types."""


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise FilterError(f"invalid filter at {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def take(self) -> tuple[str | None, str]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *names: str) -> bool:
        kind, value = self.peek()
        if kind == "word" and value.upper() in names:
            self.at += 1
            return True
        return False

    def whole(self):
        tree = self.any_of()
        if self.at < len(self.tokens):
            raise FilterError(f"unexpected {self.peek()[1]!r} in filter")
        return tree

    def any_of(self):
        parts = [self.all_of()]
        while self.word("OR"):
            parts.append(self.all_of())
        return parts[0] if len(parts) == 1 else Node(any=tuple(parts))

    def all_of(self):
        parts = [self.unary()]
        while self.word("AND"):
            parts.append(self.unary())
        return parts[0] if len(parts) == 1 else Node(all=tuple(parts))

    def unary(self):
        if self.word("NOT"):
            return Node(no=self.unary())
        if self.peek() == ("bracket", "("):
            self.take()
            tree = self.any_of()
            if self.take() != ("bracket", ")"):
                raise FilterError("a bracket isn't closed in filter")
            return tree
        kind, key = self.take()
        if kind != "word" and not (kind == "number" and key.isdigit()):  # a key may be digits alone
            raise FilterError(f"expected a key, found {key!r}")
        if self.word("IS"):
            negated = self.word("NOT")
            if not self.word("NULL"):
                raise FilterError("expected NULL after IS")
            return Node(no=Comparison(key, "is_null")) if negated else Comparison(key, "is_null")
        kind, op = self.take()
        if kind != "op":
            raise FilterError(f"expected a comparison after {key!r}")
        return Comparison(key, OPS[op], self.value())

    def value(self):
        kind, text = self.take()
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "number":
            return float(text) if re.search("[.eE]", text) else int(text)
        if kind == "word" and text.lower() in ("true", "false"):
            return text.lower() == "true"
        if kind == "word" and text.lower() == "null":
            return None
        raise FilterError(f"expected a value, found {text!r}")


def parse(text: str):
    return _Parser(text).whole()


def from_tree(tree: Mapping):
    """The tree form {and: [], or: [], not: {}, key, op, value}; several of them in one node are a conjunction."""
    parts = []
    if tree.get("key") is not None:
        if tree.get("op") not in (*OPS.values(), "is_null"):
            raise FilterError(f"unknown operator {tree.get('op')!r}")
        parts.append(Comparison(tree["key"], tree["op"], tree.get("value")))
    parts += [from_tree(x) for x in tree.get("and") or ()]
    some = tuple(from_tree(x) for x in tree.get("or") or ())
    no = from_tree(tree["not"]) if tree.get("not") else None
    if not (parts or some or no):
        raise FilterError("an empty filter node")
    if len(parts) == 1 and not some and no is None:
        return parts[0]
    return Node(all=tuple(parts), any=some, no=no)


def as_instant(text: str) -> datetime:
    """An ISO-8601 moment; one without a zone is UTC."""
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        try:
            at = datetime.combine(date.fromisoformat(text), datetime.min.time())
        except ValueError as error:
            raise FilterError(f"{text!r} is no ISO-8601 date") from error
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


def _typed(test: Comparison, types: Mapping[str, str]) -> str:
    """The declared type, or an error if the test doesn't fit it."""
    if test.key not in types:
        raise FilterError(f"metadata key {test.key!r} isn't indexed")
    kind, value = types[test.key], test.value
    if test.op == "is_null":
        return kind
    if kind in ("string", "boolean") and test.op not in ("eq", "neq"):
        raise FilterError(f"{test.op} doesn't apply to {kind} key {test.key!r}")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"string": isinstance(value, str), "boolean": isinstance(value, bool), "integer": number and float(value).is_integer(), "float": number, "datetime": isinstance(value, str)}
    if not fits[kind]:
        raise FilterError(f"{value!r} doesn't fit {kind} key {test.key!r}")
    if kind == "datetime":
        as_instant(value)
    return kind


def validate(tree, types: Mapping[str, str]) -> None:
    if isinstance(tree, Comparison):
        _typed(tree, types)
        return
    for x in (*tree.all, *tree.any, *((tree.no,) if tree.no is not None else ())):
        validate(x, types)


def compiled(tree, types: Mapping[str, str], column: Callable[[str], Column] | None = None) -> Column:
    """The filter as a column that is never null. column: the typed column of a key (default: meta_<key>).

    Moments are compared in UTC, without a zone (TIMESTAMP_NTZ), so the session's zone doesn't matter.
    """
    column = column or (lambda key: F.col(f"meta_{key}"))
    if isinstance(tree, Comparison):
        kind, c = _typed(tree, types), column(tree.key)
        if tree.op == "is_null":
            return c.isNull()
        if kind == "datetime":
            value = F.lit(as_instant(tree.value).strftime("%Y-%m-%d %H:%M:%S.%f"))
            value = F.to_timestamp_ntz(value)
        elif kind == "integer":
            value = F.lit(int(tree.value)).cast("bigint")
        else:
            value = F.lit(float(tree.value)) if kind == "float" else F.lit(tree.value)
        test = {"eq": c == value, "neq": c == value, "lt": c < value, "lte": c <= value, "gt": c > value, "gte": c >= value}[tree.op]
        test = F.coalesce(test, F.lit(False))
        return ~test if tree.op == "neq" else test
    parts = [compiled(x, types, column) for x in tree.all]
    if tree.any:
        parts.append(reduce(lambda a, b: a | b, [compiled(x, types, column) for x in tree.any]))
    if tree.no is not None:
        parts.append(~compiled(tree.no, types, column))
    return reduce(lambda a, b: a & b, parts)


def metadata_filter(given: str | Mapping, types: Mapping[str, str], column: Callable[[str], Column] | None = None) -> Column:
    return compiled(parse(given) if isinstance(given, str) else from_tree(given), types, column)


def tags_filter(tags: tuple[str, ...], match_all: bool = False, column: str = "tags") -> Column:
    """Documents with any, or all, of the tags; without tags, all documents."""
    if not tags:
        return F.lit(True)
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(tags)])
    if match_all:
        return F.coalesce(F.size(F.array_except(wanted, F.col(column))) == 0, F.lit(False))
    return F.coalesce(F.arrays_overlap(F.col(column), wanted), F.lit(False))

"""Spans of regular expressions as Spark columns: code points, end exclusive. All take time in proportion to the text and its matches.

The functions' bodies are SQL lambdas, each parsed at once: a tree of that size takes seconds to build call by call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,match:string,left:string,right:string>"
#: Bits of the number of characters in a block of a text that is cut.
BLOCK = 10


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _applied(body: str, **values: Column) -> Column:
    """The SQL body, in which v.<name> is each value."""
    return F.get(F.call_function("transform", F.array(F.struct(*[v.alias(k) for k, v in values.items()])), F.expr(f"v -> {body}")), F.lit(0))


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(values: str, combine: Callable[[str, str], str]) -> str:
    """Each of the integers combined with all before it; combine is commutative.

    In rounds, of which each combines 16 neighbours, then 16 of these, and so on: growing an array in a fold would copy it at each step.
    """
    steps = ", ".join(str(16 ** k) for k in range(7))
    back = f"aggregate(sequence(1, least(15, int(i div step))), y, (t, j) -> {combine('t', 'get(a, i - j * step)')})"
    return f"aggregate(array({steps}), {values}, (a, step) -> if(size(a) > step, transform(a, (y, i) -> if(i >= step, {back}, y)), a))"


def matches(text: Column, pattern: str | Column, *, around: int = 0) -> Column:
    """The leftmost non-overlapping matches as an array of SPAN; left and right hold up to `around` + 1 characters beside each.

    The pieces between the matches give the positions. A side that is cut by neither the text's end nor a match has one
    character more than `around`, so that a caller can tell whether a word is whole.
    """
    values, regex = ({"t": text}, _literal(pattern)) if isinstance(pattern, str) else ({"t": text, "p": pattern}, "v.p")
    sides = (f"substring(concat(' ', get(pieces, i)), {-around - 1}, {around + 1})", f"substring(concat(get(pieces, i + 1), ' '), 1, {around + 1})") if around else ("''", "''")
    row = f"named_struct('match', m, 'size', length(m), 'step', length(get(pieces, i)) + length(m), 'left', {sides[0]}, 'right', {sides[1]})"
    span = "named_struct('start', e - x.size, 'end', e, 'match', x.match, 'left', x.left, 'right', x.right)"
    placed = f"zip_with(rows, {_running('transform(rows, x -> x.step)', lambda x, y: f'{x} + {y}')}, (x, e) -> {span})"
    rows = _let("pieces", f"split(v.t, {regex}, -1)", f"transform(regexp_extract_all(v.t, {regex}, 0), (m, i) -> {row})")
    return _applied(f"if(coalesce(rlike(v.t, {regex}), false), {_let('rows', rows, placed)}, cast(array() as array<{SPAN}>))", **values)


def named(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _cut(start: str, end: str) -> str:
    """The characters from start to end (exclusive) of the blocks b: looks at the blocks that it takes only."""
    first, last, within = f"shiftright({start}, {BLOCK})", f"shiftright({end}, {BLOCK})", (1 << BLOCK) - 1
    block = lambda i: f"coalesce(get(b, {i}), '')"
    one = f"substring({block(first)}, ({start} & {within}) + 1, {end} - {start})"
    more = f"concat(substring({block(first)}, ({start} & {within}) + 1), array_join(slice(b, {first} + 2, greatest({last} - {first} - 1, 0)), ''), substring({block(last)}, 1, {end} & {within}))"
    return f"if({first} = {last}, {one}, {more})"


def _rewritten(text: Column, spans: Column, by: str) -> Column:
    """text with its spans replaced: by is SQL of the first span x of those that overlap, and of the end `until` of the last."""
    heads = "filter(transform(v.s, (x, i) -> named_struct('x', x, 'after', if(i > 0, get(ends, i - 1), 0))), h -> h.x.start >= h.after)"  # an overlapping one belongs to its head
    piece = f"concat({_cut('h.after', 'h.x.start')}, {_let('x', 'h.x', _let('until', 'coalesce(get(heads, i + 1).after, element_at(ends, -1))', by))})"
    rest = _cut("element_at(ends, -1)", "greatest(length(v.t), element_at(ends, -1))")
    whole = _let("b", f"regexp_extract_all(v.t, '(?s).{{1,{1 << BLOCK}}}', 0)", f"concat(array_join(transform(heads, (h, i) -> {piece}), ''), {rest})")
    ends = _running("transform(v.s, x -> x.end)", lambda x, y: f"greatest({x}, {y})")
    return F.when(F.size(spans) > 0, _applied(_let("ends", ends, _let("heads", heads, whole)), t=text, s=F.array_sort(spans))).otherwise(text)


def replaced(text: Column, spans: Column) -> Column:
    """text with each of its spans (struct<start:int,end:int,by:string>) replaced by its `by`; of overlapping ones the first stands for all."""
    return _rewritten(text, spans, "x.by")


def blanked(text: Column, spans: Column) -> Column:
    """text, as long as it was, with spaces in place of its spans (struct<start:int,end:int,..>)."""
    plain = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return _rewritten(text, plain, "repeat(' ', until - x.start)")

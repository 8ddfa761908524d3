"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: a disjunction of sets of (lower-case) trigrams
of which every match holds one whole set. The index has a posting (trigram, text) for each trigram that a query names
and each text that holds it; queries are answered by intersecting postings, and only their candidates are verified by
the expression itself. Rules without a mandatory trigram scan every text.

A text's key in the index is a hash of the text: equal texts share postings, and a clash only adds a candidate.
Postings are joined to the queries, which are as few as the rules, and reduced to one row a text before anything
meets the texts again.

Defined results: a null text is an empty one, without spans; repeated rows are treated one by one; spans that begin at
one place are ordered by rule; an empty table gives an empty result; extra columns are kept by `found`, whatever their
names; a text of any length takes time in proportion to it and its matches.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import few, packed, table, written
from trawl.llm.spans import let, listed, matches

#: Strings up to which a part of an expression is spelled out.
SPELLED = 64


@dataclass(frozen=True)
class Rule:
    """pattern is read by the JVM's engine and by Python's; least: characters asked of group `of` of a match."""

    name: str
    pattern: str
    least: int = 0
    of: int = 0

    def column(self, order: int) -> Column:
        """The rule as a value, so that one expression serves all rules."""
        return F.struct(F.lit(order).alias("order"), F.lit(self.name).alias("kind"), F.lit(self.pattern).alias("pattern"), F.lit(self.least).alias("least"), F.lit(self.of).alias("of"), F.lit(1 << order).cast("long").alias("bit"))


def spans_of(text: Column, rule: Column) -> Column:
    """(start, order, kind, end) of a rule's matches that are long enough."""
    part = lambda x: F.call_function("regexp_extract", x["match"], rule["pattern"], rule["of"])
    long = F.filter(matches(text, rule["pattern"]), lambda x: (rule["least"] == 0) | (F.length(part(x)) >= rule["least"]))
    return F.transform(long, lambda x: F.struct(x["start"].alias("start"), rule["order"].alias("order"), rule["kind"].alias("kind"), x["end"].alias("end")))


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_password", r"[a-z][a-z0-9+]{1,9}://[^\s:/@]++:[^\s:/@]++@"),
)

Query = frozenset[frozenset[str]]  # a disjunction of conjunctions; with an empty conjunction it holds for all texts
ALL: Query = frozenset({frozenset()})


def _absorbed(clauses: Iterable[frozenset[str]]) -> Query:
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > SPELLED:
        return a if len(a) <= len(b) else b  # either alone is a condition too
    return _absorbed(x | y for x, y in product(a, b))


def _of_strings(strings: Iterable[str]) -> Query:
    return _absorbed(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _spelled(node) -> set[str] | None:
    """All strings that a node matches, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _spelled_all(arg[3])
    if op is sre.BRANCH:
        parts = [_spelled_all(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
        once = _spelled_all(arg[2])
        if once is None or len(once) ** arg[1] > SPELLED:
            return None
        return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(once, repeat=n)}
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}
    return None


def _spelled_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        part = _spelled(node)
        if part is None or len(out) * len(part) > SPELLED:
            return None
        out = {a + b for a in out for b in part}
    return out


def _derived(nodes) -> Query:
    query, run = ALL, {""}
    for node in nodes:
        part = _spelled(node)
        if part is not None and len(run) * len(part) <= SPELLED:
            run = {a + b for a in run for b in part}
            continue
        query, run = _both(query, _of_strings(run)), part if part is not None and len(part) <= SPELLED else {""}
        if part is None:
            op, arg = node
            if op is sre.SUBPATTERN:
                query = _both(query, _derived(arg[3]))
            elif op is sre.BRANCH:
                query = _both(query, _absorbed(c for x in arg[1] for c in _derived(x)))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
                query = _both(query, _derived(arg[2]))
    return _both(query, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """Every text in which pattern matches holds, in lower case, all trigrams of one of the sets."""
    return _derived(parser.parse(pattern))


def index(docs: DataFrame, trigrams: Iterable[str]) -> DataFrame:
    """Postings (trigram, text_key) of the trigrams: a row for each of them that a text holds."""
    held = let(F.lower("text"), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in sorted(trigrams)])))
    return docs.where("text is not null").select(F.explode(held).alias("trigram"), F.xxhash64("text").alias("text_key"))


def candidates(postings: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(text_key, rules): bit r of rules is set if the text answers queries[r]."""
    clauses = [(rule, clause) for rule, query in sorted(queries.items()) for clause in sorted(query, key=sorted)]
    rows = [(t, k, 1 << i) for k, (_, clause) in enumerate(clauses) for i, t in enumerate(sorted(clause))]
    terms = postings.sparkSession.createDataFrame(rows, "trigram string, clause int, bit long")  # a row a trigram of a rule
    met = postings.join(F.broadcast(terms), "trigram").groupBy("text_key", "clause").agg(F.bit_or("bit").alias("bits"))
    wanted = F.lit(False)
    rule_bit = F.lit(0).cast("long")
    for k, (rule, clause) in enumerate(clauses):
        wanted = wanted | ((F.col("clause") == k) & (F.col("bits") == (1 << len(clause)) - 1))
        rule_bit = F.when(F.col("clause") == k, F.lit(1 << rule).cast("long")).otherwise(rule_bit)
    return met.where(wanted).groupBy("text_key").agg(F.bit_or(rule_bit).alias("rules"))


def found(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """row (docs' columns) and spans, an array of (start, order, kind, end) of all rules, by start."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ALL and frozenset() not in q}
    text = F.coalesce(F.col("row.text"), F.lit(""))
    joined = packed(docs).withColumn("rules", F.lit(0).cast("long"))
    if queries:
        chosen = few(written(candidates(index(docs, {t for q in queries.values() for c in q for t in c}), queries)), 16)
        joined = packed(docs).withColumn("text_key", F.xxhash64(text)).join(chosen, "text_key", "left")
    always = [let(r.column(i), lambda rule: spans_of(text, rule)) for i, r in enumerate(rules) if i not in queries]
    asked = F.array(*[r.column(i) for i, r in enumerate(rules) if i in queries]) if queries else None
    if asked is not None:
        mask = F.coalesce(F.col("rules"), F.lit(0))
        always.append(F.flatten(F.transform(F.filter(asked, lambda rule: mask.bitwiseAND(rule["bit"]) != 0), lambda rule: spans_of(text, rule))))
    return joined.select("row", F.array_sort(F.concat(*always)).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(spans: Column) -> Column:
        count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
        base = listed(F.filter(spans, lambda x: x["order"] < len(BASE)))
        return F.struct(*[count(r.name).alias(f"n_{r.name}") for r in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans"))

    return rows.select("row.doc_id", F.inline(F.transform(F.array("spans"), digest)))  # spans are made once


def _sql_rule(order: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("(?<![0-9a-f])", "").replace("++", "+").replace("'", "''")
    size = f"len(regexp_extract(m[i], '{pattern}', {rule.of}))" if rule.of else "len(m[i])"
    return (f"SELECT doc_id, {order} AS o, '{rule.name}' AS kind, CAST(list_sum(list_transform(s[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS a, len(m[i]) AS n "
            f"FROM (SELECT doc_id, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS s FROM documents)) WHERE {size} >= {rule.least}")


OP4_SQL = "WITH h AS (" + " UNION ALL ".join(_sql_rule(i, r) for i, r in enumerate(BASE + MORE)) + """),
g AS (SELECT doc_id, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2,
    string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, o) AS spans, string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, o) FILTER (o < 3) AS base FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

"""Personal data: information-theoretic sanitisation, in DataFrame functions only.

Protected entities are the e-mail and network addresses, card and phone numbers that regular expressions and their
checks find. A corpus shows how far a term discloses an entity: with p(c) the share of documents that hold entity c,
p(t) of those that hold term t, and p(c, t) of those in which t stands within WINDOW characters of c, the disclosure is
PMI(c; t) / IC(c) = log(p(c, t) / (p(c) p(t))) / -log p(c), 1 when the term gives the entity away. Terms at or above
GENERALISE are replaced by the kind of entity they point to, those at or above REMOVE are removed, wherever they stand.
A pair of SUPPORT documents or more has p(c | t) as counted. Most entities stand in a document or two, so rarer pairs
count too, smoothed towards p(c): p(c | t) = (n(c, t) + PRIOR p(c)) / (n(t) + PRIOR), PRIOR documents in which the term
says nothing. An entity that half of all documents hold is no secret.

Counts are of all documents, and are summed before they are shuffled. Only terms of pairs that can reach GENERALISE are
counted in the whole corpus. Exact copies count as documents each: run it after deduplication if they should not.
Terms are looked for in a text whose entities are blanked.

Defined results: a null text is an empty one, without spans (`sanitised` keeps it null); repeated rows are treated
one by one; ties between entities of a term go to the kind that sorts first; an empty table gives an empty result; extra
columns are kept by `sanitised`, whatever their names; a text of any length takes time in proportion to it and its matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import few_bytes, packed, table, written
from trawl.llm.spans import SPAN, blanked, let, listed, matches, named, replaced

WINDOW = 48
SUPPORT = 3
PRIOR = 1
GENERALISE, REMOVE = 0.8, 0.95

TERM = r"\p{L}{3,}"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Kind:
    """pattern: matches what the plain one does and no prefix twice (possessive), so it takes time in proportion to the text."""

    name: str
    pattern: str
    hint: str  # a cheaper condition that each match meets

    def fits(self, match: Column) -> Column:
        digits = F.regexp_replace(match, "[^0-9]", "")
        return {"email": F.lit(True), "ip": match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), "card": F.call_function("luhn_check", digits),
                "phone": F.length(digits).between(8, 15)}[self.name]

    def entity(self, match: Column) -> Column:
        """The form in which equal entities are equal."""
        plain = F.lower(match) if self.name == "email" else match if self.name == "ip" else F.regexp_replace(match, "[^0-9]", "")
        return F.concat(F.lit(f"{self.name}:"), plain)


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    # whole runs of digits, single spaces and dashes, of 16 to 19 digits
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)


def entities(text: Column, kind: Kind, around: int = 0) -> Column:
    found = F.filter(matches(text, kind.pattern, around=around), lambda x: kind.fits(x["match"]))
    return F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(F.array().cast(f"array<{SPAN}>")) if kind.hint else found


def near_terms(kind: Kind, x: Column) -> Column:
    """(entity, term) of a match with its sides, and (entity, null)."""
    clean = lambda side: F.regexp_replace(F.lower(side), r"[^\s]*[@0-9][^\s]*", " ")
    terms = F.concat(F.regexp_extract_all(clean(x["left"]), F.lit(r"(?<=[^\p{L}])" + TERM), F.lit(0)), F.regexp_extract_all(clean(x["right"]), F.lit(TERM + r"(?=[^\p{L}])"), F.lit(0)), F.array(F.lit(None).cast("string")))
    entity = kind.entity(x["match"])
    return F.transform(terms, lambda t: F.struct(entity.alias("entity"), t.alias("term")))


def contexts(text: Column) -> Column:
    """The text's distinct (entity, term), with a null term for each entity and a null entity for each term."""
    def of(kind: Kind) -> Column:
        return F.flatten(F.transform(entities(text, kind, WINDOW), lambda x: near_terms(kind, x)))

    def with_terms(pairs: Column) -> Column:
        alone = F.transform(F.filter(pairs, lambda x: x["term"].isNotNull()), lambda x: F.struct(F.lit(None).cast("string").alias("entity"), x["term"].alias("term")))
        return F.array_distinct(F.concat(pairs, alone))

    return F.transform(F.array(F.concat(*map(of, KINDS))), with_terms)[0]  # the pairs are made once


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def few_terms(df: DataFrame, *names: str) -> DataFrame:
    """df, a written table of strings and numbers, marked for broadcast if it is small."""
    return few_bytes(df, sum((F.octet_length(x) for x in names), F.lit(32)))


def disclosed(df: Column, both: Column, held: Column, n: int, support: int = SUPPORT) -> Column:
    """PMI over information content, of counts among n documents; it falls with df."""
    share = F.when(both >= support, both / df).otherwise((both + PRIOR * held / F.lit(float(n))) / (df + PRIOR))
    return 1 + F.log(share) / F.log(F.lit(float(n)) / held)


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(term, kind, disclosure) of the terms at or above the threshold: a written table."""
    texts = docs.where("text is not null").select("text")
    n = docs.count()
    seen = texts.where(F.col("text").rlike("[0-9@]")).select(F.explode(contexts(F.col("text"))).alias("x")).select("x.entity", "x.term")
    counted = written(seen.groupBy("entity", "term").agg(F.count("*").alias("both")))
    held = counted.where("entity is not null and term is null").select("entity", F.col("both").alias("held")).where(2 * F.col("held") <= n)
    # a term stands in at least as many texts as beside entities: what that rules out needs no count in the corpus
    near = counted.where("entity is null").select("term", F.col("both").alias("near"))
    pairs = counted.where("entity is not null and term is not null").join(few_terms(held, "entity"), "entity").join(few_terms(near, "term"), "term")
    pairs = written(pairs.where(disclosed(F.col("near"), F.col("both"), F.col("held"), n, support) >= generalise).drop("near"))
    wanted = few_terms(written(pairs.select("term").distinct()), "term")
    df = texts.select(F.explode(terms_of(F.col("text"))).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    disclosure = disclosed(F.col("df"), F.col("both"), F.col("held"), n, support)
    told = pairs.join(df, "term").select("term", F.substring_index("entity", ":", 1).alias("kind"), disclosure.alias("disclosure")).where(F.col("disclosure") >= generalise)
    best = F.min(F.struct((-F.col("disclosure")).alias("less"), "kind"))
    return written(told.groupBy("term").agg(best.alias("x")).select("term", F.col("x.kind").alias("kind"), (-F.col("x.less")).alias("disclosure")))


def found(docs: DataFrame, disclosing: DataFrame, remove: float = REMOVE) -> DataFrame:
    """row (docs' columns), entities and terms, arrays of (order, kind, start, end[, by]); a row a row of docs."""
    by = F.when(F.col("disclosure") >= remove, F.lit("")).otherwise(F.concat(F.lit("["), "kind", F.lit(" holder]")))
    told = docs.where("text is not null").select(F.xxhash64("text").alias("key"), F.explode(terms_of(F.col("text"))).alias("term")).join(few_terms(disclosing, "term"), "term")
    held = written(told.groupBy("key").agg(F.collect_set(F.struct("term", by.alias("by"))).alias("held")))
    held = few_bytes(held, F.aggregate("held", F.lit(32), lambda n, x: n + F.octet_length(x["term"]) + 48))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    joined = packed(docs).withColumn("key", F.xxhash64(text)).join(held, "key", "left")
    joined = joined.withColumn("entities", F.concat(*[named(entities(text, kind), kind.name, i) for i, kind in enumerate(KINDS)]))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("held", lambda x: x["term"]), "|"), F.lit(r")(?!\p{L})"))
    terms = let(F.map_from_entries("held"), lambda held_by: F.transform(matches(blanked(text, F.col("entities")), pattern), lambda x: F.struct(
        F.lit(len(KINDS)).alias("order"), F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        F.coalesce(F.element_at(held_by, F.lower(x["match"])), F.lit("")).alias("by"))))
    none = F.array().cast("array<struct<order:int,kind:string,start:int,end:int,by:string>>")
    return joined.select("row", "entities", F.when(F.col("held").isNotNull(), terms).otherwise(none).alias("terms"))


def sanitised(docs: DataFrame, disclosing: DataFrame | None = None) -> DataFrame:
    """docs with entities replaced by their kind and disclosing terms generalised or removed in text."""
    disclosing = disclosing_terms(docs) if disclosing is None else disclosing
    span = lambda x, by: F.struct(x["start"].alias("start"), x["end"].alias("end"), by.alias("by"))
    spans = F.concat(F.transform("entities", lambda x: span(x, F.concat(F.lit("["), x["kind"], F.lit("]")))), F.transform("terms", lambda x: span(x, x["by"])))
    rows = found(docs, disclosing).select("row", spans.alias("spans"))
    text = F.when(F.col("row.text").isNotNull(), replaced(F.coalesce(F.col("row.text"), F.lit("")), F.col("spans")))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = found(docs, disclosing_terms(docs))

    def digest(x: Column) -> Column:
        count = lambda kind: F.size(F.filter(x["entities"], lambda e: e["kind"] == kind)).cast("long")
        base, terms = listed(x["entities"]), listed(x["terms"])
        return F.struct(*[count(k.name).alias(f"n_{k.name}") for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms)).alias("spans"))

    return rows.select("row.doc_id", F.inline(F.transform(F.array(F.struct("entities", "terms")), digest)))  # spans are made once

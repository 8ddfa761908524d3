"""The registered queries and their SQL. Each one applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.config import CollectionConfig, SearchOption, SearchQuery, VectorConfig, arms_of
from trawl.functions import hashing, postings, text
from trawl.operators import documents, filters, joins, search
from trawl.sources.layout import spread
from trawl.streaming import changelog, metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for queries that build a vector of each text."""
    return spread(table(spark, sf_dir, "documents"))


# Collections over the tables

DOC_TYPES = {"lang": "string", "source": "string", "n_chars": "integer", "quality": "integer", "toxic": "integer"}


def document_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("meta_quality"), F.col("toxic").alias("meta_toxic"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"),
                                                    F.col("lang").alias("meta_lang"), F.col("source").alias("meta_source"), F.col("n_chars").alias("meta_n_chars"))
    return docs.join(labels, "id", "left")


DOCS_SQL = "(SELECT d.doc_id AS id, text AS content, [lang, source] AS tags, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def filtered(expression: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return document_collection(spark, sf_dir).where(filters.metadata_filter(expression, DOC_TYPES)).select(F.col("id").alias("doc_id"), "meta_quality")
    return run


def _filters() -> None:
    for name, expression, where in (
        ("filter_eq", 'lang = "de"', "lang = 'de'"),
        ("filter_neq_missing", "quality != 1", "coalesce(quality <> 1, true)"),
        ("filter_range", "n_chars >= 500 AND n_chars < 2000", "n_chars >= 500 AND n_chars < 2000"),
        ("filter_and_or_not", '(lang = "en" OR lang = "fr") AND NOT (quality = 1 OR n_chars > 5000)', "lang IN ('en', 'fr') AND NOT (coalesce(quality = 1, false) OR n_chars > 5000)"),
        ("filter_is_null", 'toxic IS NULL OR NOT lang != "es"', "toxic IS NULL OR lang = 'es'"),
        ("filter_is_not_null", "toxic IS NOT NULL AND toxic = 0", "toxic IS NOT NULL AND toxic = 0"),
    ):
        QUERIES[name] = filtered(expression)
        ORACLES[name] = f"SELECT id AS doc_id, quality AS meta_quality FROM {DOCS_SQL} WHERE {where}"


_filters()


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03 12:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def filter_datetime(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("meta_ts", F.col("ts"))
    kept = filters.metadata_filter('ts >= "2024-01-03T13:00:00+01:00" AND ts < "2024-01-20"', {"ts": "datetime"})
    return events.where(kept).select("event_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000.5 AND o_totalprice <= 250000 AND o_orderstatus <> 'F'")
def filter_tree(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumns({"meta_price": F.col("o_totalprice"), "meta_status": F.col("o_orderstatus")})
    tree = {"and": [{"key": "price", "op": "gt", "value": 1000.5}, {"key": "price", "op": "lte", "value": 250000}], "not": {"key": "status", "op": "eq", "value": "F"}}
    return orders.where(filters.metadata_filter(tree, {"price": "float", "status": "string"})).select("o_orderkey", "o_totalprice")


@query(f"SELECT id AS doc_id FROM {DOCS_SQL} WHERE list_has_any(tags, ['de', 'src1'])")
def tags_any(spark, sf_dir):
    return document_collection(spark, sf_dir).where(filters.tags_filter(("de", "src1"))).select(F.col("id").alias("doc_id"))


@query(f"SELECT id AS doc_id FROM {DOCS_SQL} WHERE list_has_all(tags, ['en', 'src1']) AND n_chars > 1000")
def tags_all(spark, sf_dir):
    kept = filters.tags_filter(("en", "src1"), True) & filters.metadata_filter("n_chars > 1000", DOC_TYPES)
    return document_collection(spark, sf_dir).where(kept).select(F.col("id").alias("doc_id"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def props_meta_filter(spark, sf_dir):
    k = documents.flattened_metadata(F.variant_get(F.parse_json("props"), "$.k", "variant"), "bigint")
    events = table(spark, sf_dir, "events").withColumn("meta_k", k)
    return events.where(filters.metadata_filter("k > 50", {"k": "integer"})).select("event_id", F.col("meta_k").alias("k"))


# Text

def ws_sql(source: str, avgdl: float, top_k: int = 128, name: str = "") -> str:
    """CTEs {name}tok, {name}len, {name}w: whitespace tokens of source(id, txt), their weights, pruned."""
    return _weights_sql(f"SELECT id, unnest(list_filter(string_split(trim(regexp_replace(lower(coalesce(txt, '')), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')) AS token FROM {source}", avgdl, top_k, name)


def tri_sql(source: str, avgdl: float, top_k: int = 128, name: str = "") -> str:
    padded = "'  ' || trim(regexp_replace(lower(coalesce(txt, '')), '\\s+', ' ', 'g')) || '  '"
    return _weights_sql(f"SELECT id, substr(p, i, 3) AS token FROM (SELECT id, p, unnest(range(1, len(p) - 1)) AS i FROM (SELECT id, {padded} AS p FROM {source}) WHERE len(p) > 4)", avgdl, top_k, name)


def _weights_sql(tokens: str, avgdl: float, top_k: int, name: str) -> str:
    return f"""{name}tok AS ({tokens}),
{name}tf AS (SELECT id, token, CAST(count(*) AS DOUBLE) AS tf FROM {name}tok GROUP BY 1, 2),
{name}len AS (SELECT id, CAST(sum(tf) AS DOUBLE) AS n FROM {name}tf GROUP BY 1),
{name}w AS (SELECT id, token, weight FROM (SELECT t.id, token, 1.0 * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / CAST({avgdl} AS DOUBLE))) AS weight,
    row_number() OVER (PARTITION BY t.id ORDER BY 1.0 * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / CAST({avgdl} AS DOUBLE))) DESC, token) AS rn FROM {name}tf t JOIN {name}len l ON t.id = l.id) WHERE rn <= {top_k})"""


@query("WITH " + ws_sql("(SELECT doc_id AS id, text AS txt FROM documents)", 50.0) + " SELECT id AS doc_id, token, round(weight, 6) AS weight FROM w")
def tok_whitespace(spark, sf_dir):
    posted = search.text_postings(docs_of(spark, sf_dir), postings.whitespace)
    return posted.select(F.col("id").alias("doc_id"), "token", F.round("weight", 6).alias("weight"))


@query("WITH " + tri_sql("(SELECT p_partkey AS id, p_name AS txt FROM part)", 50.0) + " SELECT id AS p_partkey, token, round(weight, 6) AS weight FROM w")
def tok_trigrams(spark, sf_dir):
    posted = search.text_postings(parts_of(spark, sf_dir), postings.trigrams)
    return posted.select(F.col("id").alias("p_partkey"), "token", F.round("weight", 6).alias("weight"))


STOP = ("the", "of", "and", "to", "in", "a", "is")
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query(f"SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda t: t <> '' AND NOT list_contains({STOP_SQL}, t)), ' ') AS words FROM documents")
def stopwords_removed(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.array_join(text.whitespace_tokens(F.col("text"), STOP), " ").alias("words"))


@query("WITH " + ws_sql("(SELECT doc_id AS id, text AS txt FROM documents)", 50.0) + " SELECT round(avg(n), 6) AS avgdl, count(*) AS n_docs FROM (SELECT id, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY id)")
def avgdl_stats(spark, sf_dir):
    n = text.pruned_length(text.whitespace_tokens(F.col("text")), 128)
    return texts(spark, sf_dir).select(n.cast("double").alias("n")).where("n > 0").agg(F.round(F.avg("n"), 6).alias("avgdl"), F.count("*").alias("n_docs"))


@query("WITH " + ws_sql("(SELECT doc_id AS id, text AS txt FROM documents)", 50.0) + " SELECT token, count(*) AS n_with, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM w GROUP BY token")
def df_idf_stats(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    counted = search.token_statistics(search.text_postings(docs, postings.whitespace))
    return counted.select("token", "n_with", F.round(text.idf(F.lit(docs.count()), F.col("n_with")), 6).alias("idf"))


@query()
def fulltext_stem(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("txt"), "lang")
    return postings.made(rows, postings.full_text(50.0, 128)).select(F.col("id").alias("doc_id"), "token", F.round("weight", 6).alias("weight"))


@query()
def wmtr(spark, sf_dir):
    plain = text.preprocessed(F.col("text"))
    rows = texts(spark, sf_dir).select("doc_id", plain.alias("plain"), "lang", postings.length_boost(plain).alias("boost"))
    return postings.made(rows, postings.multilevel(50.0, 128, 80, 1.0)).select(F.col("id").alias("doc_id"), "token", F.round("weight", 6).alias("weight"))


@query()
def content_hash(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"))


@query()
def token_hash(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select(F.explode(text.trigram_tokens(F.col("p_name"))).alias("token")).distinct()
    return tokens.select("token", hashing.token_id_column(F.concat(F.lit("###"), "token")).alias("token_id"))


# Retrieval

TEXT_QUERY = "thre the anre tion hand Ereser ouen thntshan"


def query_vector(spark: SparkSession, queries: DataFrame, tokens, top_k: int = 128) -> DataFrame:
    """(query_id, token, weight) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(text.sparse_vector(tokens(F.col("text")), text.QUERY_AVGDL, top_k)).alias("x")).select("query_id", "x.token", "x.weight")


def one_query(spark: SparkSession, words: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(words).alias("text"))


def ws_arm_scores(spark: SparkSession, docs: DataFrame, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """docs: (id, txt)."""
    return search.text_scores(docs, postings.whitespace, query_vector(spark, queries, text.whitespace_tokens), allowed)


def tri_arm_scores(spark: SparkSession, docs: DataFrame, queries: DataFrame) -> DataFrame:
    return search.text_scores(docs, postings.trigrams, query_vector(spark, queries, text.trigram_tokens))


def score_sql(name: str, kind, docs: str, queries: str) -> str:
    """CTE {name}s(query_id, id, score)."""
    return (kind(docs, 50.0, 128, name + "d") + ",\n" + kind(queries, 5.0, 128, name + "q") + f""",
{name}i AS (SELECT token, ln(1 + ((SELECT count(*) FROM {docs}) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {name}dw GROUP BY token),
{name}s AS (SELECT q.id AS query_id, d.id, round(sum(d.weight * (q.weight * idf)), 6) AS score FROM {name}dw d JOIN {name}qw q ON d.token = q.token JOIN {name}i i ON i.token = d.token GROUP BY 1, 2)""")


def arm_sql(name: str, weight: float, prefetch: int, scores: str) -> str:
    return f"(SELECT query_id, id, '{name}' AS arm, CAST({weight} AS DOUBLE) AS weight, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {scores}) WHERE rank <= {prefetch})"


RRF_SQL = "(SELECT query_id, id, round(sum(weight / (2 + rank)), 6) AS score, round(sum(score), 6) AS tie FROM arms GROUP BY 1, 2)"
LINEAR_SQL = """(SELECT query_id, id, round(sum(weight * CASE WHEN high = low THEN 1.0 ELSE (score - low) / (high - low) END), 6) AS score, 0.0 AS tie
  FROM (SELECT *, min(score) OVER (PARTITION BY query_id, arm) AS low, max(score) OVER (PARTITION BY query_id, arm) AS high FROM arms) GROUP BY 1, 2)"""
DOC_SOURCE = "(SELECT doc_id AS id, text AS txt FROM documents)"
PART_SOURCE = "(SELECT p_partkey AS id, p_name AS txt FROM part)"
ONE_SQL = f"(SELECT 0 AS id, '{TEXT_QUERY}' AS txt)"
PART_QUERY = "small blue ring widgets"
PART_SQL = f"(SELECT 0 AS id, '{PART_QUERY}' AS txt)"


def docs_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("txt"))


def parts_of(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("txt"))


@query("WITH " + score_sql("x", ws_sql, DOC_SOURCE, ONE_SQL) + ", arms AS " + arm_sql("content_ws", 1.0, 10, "xs") + " SELECT id AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM arms")
def sparse_topk(spark, sf_dir):
    found = search.arm(ws_arm_scores(spark, docs_of(spark, sf_dir), one_query(spark, TEXT_QUERY)), "content_ws", 1.0, 10)
    return found.select(F.col("id").alias("doc_id"), "score", "rank")


@query("WITH " + score_sql("x", ws_sql, DOC_SOURCE, ONE_SQL) + " SELECT id AS doc_id, score FROM xs WHERE score >= 1.0")
def sparse_threshold(spark, sf_dir):
    scores = ws_arm_scores(spark, docs_of(spark, sf_dir), one_query(spark, TEXT_QUERY))
    return scores.where(F.col("score") >= 1.0).select(F.col("id").alias("doc_id"), "score")


@query("WITH " + score_sql("x", ws_sql, DOC_SOURCE, ONE_SQL) + ", arms AS " + arm_sql("content_ws", 1.0, 15, "(SELECT s.* FROM xs s JOIN documents d ON s.id = d.doc_id WHERE d.lang = 'en' AND d.source = 'src1')") + " SELECT id AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM arms")
def sparse_prefiltered(spark, sf_dir):
    """The filter comes before the ranking; frequencies stay those of the whole collection."""
    allowed = document_collection(spark, sf_dir).where(filters.tags_filter(("en", "src1"), True))
    found = search.arm(ws_arm_scores(spark, docs_of(spark, sf_dir), one_query(spark, TEXT_QUERY), allowed), "content_ws", 1.0, 15)
    return found.select(F.col("id").alias("doc_id"), "score", "rank")


@query("""WITH v AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS dim, unnest(embedding) AS x FROM embeddings),
q AS (SELECT dim, CAST(x AS DOUBLE) AS x FROM v WHERE id = 7 AND x > 0.1),
s AS (SELECT v.id, round(sum(CAST(v.x AS DOUBLE) * q.x), 6) AS score FROM v JOIN q ON v.dim = q.dim WHERE v.x > 0.1 GROUP BY 1)
SELECT id AS vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 20""")
def sparse_custom(spark, sf_dir):
    """Caller's own sparse vectors: the larger components of the embeddings, without inverse frequencies."""
    vectors = table(spark, sf_dir, "embeddings")
    posted = vectors.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("dim", "x")).where("x > 0.1D").select(F.col("dim").cast("string").alias("token"), "id", F.col("x").cast("double").alias("weight"))
    asked = posted.where("id = 7").select(F.lit(0).cast("long").alias("query_id"), "token", "weight")
    return search.arm(search.sparse_scores(posted, asked), "v", 1.0, 20).select(F.col("id").alias("vec_id"), "score", "rank")


def _dense() -> None:
    for name, expression in (
        ("cosine", "list_sum(list_transform(range(1, 65), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"),
        ("dot", "list_sum(list_transform(range(1, 65), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))"),
        ("euclid", "0.0 - sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) * (CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)))))"),
    ):
        def run(spark: SparkSession, sf_dir: str, distance: str = name) -> DataFrame:
            vectors = table(spark, sf_dir, "embeddings")
            asked = vectors.where("vec_id in (3, 4, 5)").select(F.col("vec_id").alias("query_id"), "embedding")
            scores = search.dense_scores(vectors.select(F.col("vec_id").alias("id"), "embedding"), asked, distance)
            return search.arm(scores, "v", 1.0, 10).select("query_id", F.col("id").alias("vec_id"), "score", "rank")

        QUERIES[f"dense_{name}"] = run
        ORACLES[f"dense_{name}"] = f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round({expression}, 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id IN (3, 4, 5)) q)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


_dense()

PART_CONFIG = CollectionConfig("part", (VectorConfig("ws", "whitespace", ("name",)), VectorConfig("tri", "trigrams", ("name",))))


def part_arms(spark, sf_dir, asked: SearchQuery) -> DataFrame:
    """The arms that a search plans over the part names."""
    kinds = {"whitespace": ws_arm_scores, "trigrams": tri_arm_scores}
    queries, parts = one_query(spark, asked.text), parts_of(spark, sf_dir)
    return search.arms([search.arm(kinds[v.type](spark, parts, queries), f"{f}_{v.name}", o.weight, asked.prefetch, o.raw_score_threshold) for v, f, o in arms_of(PART_CONFIG, asked)])


OPTIONS = (SearchOption("ws", "name", 1.0), SearchOption("tri", "name", 0.5))
PART_ARMS_SQL = ("WITH " + score_sql("x", ws_sql, PART_SOURCE, PART_SQL) + ",\n" + score_sql("y", tri_sql, PART_SOURCE, PART_SQL)
                 + ",\narms AS (" + arm_sql("name_ws", 1.0, 15, "xs") + " UNION ALL " + arm_sql("name_tri", 0.5, 15, "ys") + ")")


def fused_sql(fused: str, limit: int = 10, where: str = "true", arms: str = PART_ARMS_SQL) -> str:
    return f"{arms} SELECT id AS p_partkey, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie DESC, id) AS place FROM {fused} WHERE {where}) WHERE place <= {limit}"


def placed(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("p_partkey"), "score", "place")


@query(fused_sql(RRF_SQL))
def fuse_rrf(spark, sf_dir):
    asked = SearchQuery(PART_QUERY, OPTIONS)
    return placed(search.fuse(part_arms(spark, sf_dir, asked), asked.fusion, asked.limit))


@query(fused_sql(LINEAR_SQL))
def fuse_linear(spark, sf_dir):
    asked = SearchQuery(PART_QUERY, OPTIONS, fusion="linear")
    return placed(search.fuse(part_arms(spark, sf_dir, asked), asked.fusion, asked.limit))


@query(fused_sql(LINEAR_SQL, 10, "score >= 0.7"))
def fuse_threshold(spark, sf_dir):
    asked = SearchQuery(PART_QUERY, OPTIONS, fusion="linear", score_threshold=0.7)
    return placed(search.fuse(part_arms(spark, sf_dir, asked), asked.fusion, asked.limit, asked.score_threshold))


@query(fused_sql(RRF_SQL, arms="WITH " + score_sql("x", ws_sql, PART_SOURCE, PART_SQL) + ", arms AS " + arm_sql("name_ws", 1.0, 15, "xs")))
def zero_weight_arm(spark, sf_dir):
    asked = SearchQuery(PART_QUERY, (SearchOption("ws", "name", 1.0), SearchOption("tri", "name", 0.0)))
    return placed(search.fuse(part_arms(spark, sf_dir, asked), asked.fusion, asked.limit))


@query(fused_sql(RRF_SQL, arms=PART_ARMS_SQL.replace("CAST(1.0 AS DOUBLE) AS weight", "CAST(0.5 AS DOUBLE) AS weight")))
def default_arms(spark, sf_dir):
    """Without options every vector and field is an arm, in equal parts."""
    asked = SearchQuery(PART_QUERY)
    return placed(search.fuse(part_arms(spark, sf_dir, asked), asked.fusion, asked.limit))


@query(f"{PART_ARMS_SQL}, top AS (SELECT id FROM (SELECT *, row_number() OVER (ORDER BY score DESC, tie DESC, id) AS place FROM {RRF_SQL}) WHERE place <= 10) SELECT a.id AS p_partkey, 'name' AS field, substr(arm, 6) AS vector, score, CAST(rank AS INTEGER) AS rank FROM arms a JOIN top ON a.id = top.id")
def raw_scores(spark, sf_dir):
    asked = SearchQuery(PART_QUERY, OPTIONS, raw_scores=True)
    candidates = part_arms(spark, sf_dir, asked)
    found = search.fuse(candidates, asked.fusion, asked.limit).join(search.raw_scores(candidates), ["query_id", "id"])
    return found.select(F.col("id").alias("p_partkey"), F.explode("vector_scores").alias("x")).select("p_partkey", "x.field", "x.vector", "x.score", "x.rank")


BATCH_SQL = "(SELECT item_id AS id, text AS txt FROM benchmark)"


@query("WITH " + score_sql("x", ws_sql, DOC_SOURCE, BATCH_SQL) + ", arms AS " + arm_sql("content_ws", 1.0, 15, "xs")
       + f" SELECT query_id, id AS doc_id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie DESC, id) AS place FROM {RRF_SQL}) WHERE place <= 10")
def batch_search(spark, sf_dir):
    """All benchmark items as one batch of queries over the documents."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    candidates = search.arm(ws_arm_scores(spark, docs_of(spark, sf_dir), queries), "content_ws", 1.0, 15)
    return search.fuse(candidates, "rrf", 10).select("query_id", F.col("id").alias("doc_id"), "score", "place")


FACET_ARMS = "WITH " + score_sql("x", ws_sql, DOC_SOURCE, ONE_SQL) + ", arms AS " + arm_sql("content_ws", 1.0, 50, "xs")


@query(FACET_ARMS + """, pool AS (SELECT DISTINCT d.doc_id, d.lang, d.source FROM arms a JOIN documents d ON a.id = d.doc_id),
f AS (SELECT 'lang' AS field, lang AS value FROM pool UNION ALL SELECT 'source', source FROM pool),
c AS (SELECT field, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT field, value, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM c) WHERE r <= 5""")
def facets(spark, sf_dir):
    asked = SearchQuery(TEXT_QUERY, facets=("lang", "source"), facet_values=5)
    candidates = search.arm(ws_arm_scores(spark, docs_of(spark, sf_dir), one_query(spark, asked.text)), "content_ws", 1.0, asked.prefetch)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return search.facet_counts(candidates, docs, {"lang": "lang", "source": "source"}, asked.facet_values).select("field", "value", "n")


@query(f"""WITH {score_sql("x", ws_sql, DOC_SOURCE, ONE_SQL)}, arms AS {arm_sql("content_ws", 1.0, 1000000000, "xs")}, g AS (SELECT f.*, d.source FROM {RRF_SQL} f JOIN documents d ON f.id = d.doc_id),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, tie DESC, id) AS r FROM g),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, tie DESC, id) AS place FROM c WHERE r <= 2)
SELECT id AS doc_id, source, score, CAST(place AS INTEGER) AS place FROM p WHERE place <= 20""")
def group_cap(spark, sf_dir):
    """At most two results a source, over all that match."""
    candidates = search.arm(ws_arm_scores(spark, docs_of(spark, sf_dir), one_query(spark, TEXT_QUERY)), "content_ws", 1.0, 1_000_000_000)
    groups = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group_value"))
    found = search.grouped(search.reciprocal_rank_fusion(candidates), groups, 2, 20)
    return found.select(F.col("id").alias("doc_id"), F.col("group_value").alias("source"), "score", "place")


# Joins

def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("long").alias("meta_nation"), "c_name")


def nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").cast("long").alias("meta_key"), F.col("n_name").alias("name"))


def suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("long").alias("meta_nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("meta_balance"))


def orders_of(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("meta_customer"), F.col("o_totalprice").alias("meta_price"), F.col("o_orderstatus").alias("meta_status"))


def flat(joined: DataFrame, name: str, key: str = "id") -> DataFrame:
    return joined.select(F.col(key).alias("parent"), F.array_join(F.transform(name, lambda x: x["id"]), ",").alias(name), F.size(name).alias(f"n_{name}"))


@query("SELECT c_custkey::VARCHAR AS parent, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR), '') AS joined_orders, CAST(count(o_orderkey) AS INTEGER) AS n_joined_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_by_meta(spark, sf_dir):
    spec = joins.parse("orders[$id = $$.meta.customer]")
    types = {"customer": "string", "price": "float", "status": "string"}
    return flat(joins.attach(customers(spark, sf_dir), orders_of(spark, sf_dir), spec, types, ["meta_price"]), "joined_orders")


@query("SELECT c_custkey::VARCHAR AS parent, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR), '') AS joined_orders, CAST(count(o_orderkey) AS INTEGER) AS n_joined_orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F') o ON c_custkey = o_custkey GROUP BY c_custkey")
def join_filtered(spark, sf_dir):
    spec = joins.parse('orders[$id = $$.meta.customer](price > 100000 AND status != "F")')
    types = {"customer": "string", "price": "float", "status": "string"}
    return flat(joins.attach(customers(spark, sf_dir), orders_of(spark, sf_dir), spec, types, ["meta_price"]), "joined_orders")


@query("SELECT s_suppkey::VARCHAR AS parent, n_nationkey::VARCHAR AS joined_nations, CAST(1 AS INTEGER) AS n_joined_nations FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_meta_to_meta(spark, sf_dir):
    spec = joins.parse("nations[$.meta.nation = $$.meta.key]")
    return flat(joins.attach(suppliers(spark, sf_dir), nations(spark, sf_dir), spec, {"key": "integer"}, ["name"], parent_types={"nation": "integer"}), "joined_nations")


@query("SELECT c_custkey::VARCHAR AS parent, coalesce(s_suppkey::VARCHAR, '') AS joined_suppliers, CAST(CASE WHEN s_suppkey IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_joined_suppliers FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def join_by_id(spark, sf_dir):
    return flat(joins.attach(customers(spark, sf_dir), suppliers(spark, sf_dir), joins.parse("suppliers"), {}, ["name"]), "joined_suppliers")


@query("""SELECT n_nationkey::VARCHAR AS parent, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)::INTEGER AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0)::INTEGER AS n_suppliers FROM nation""")
def join_multi(spark, sf_dir):
    one, two = joins.parse_all(["customers[$.meta.key = $$.meta.nation]", "suppliers[$.meta.key = $$.meta.nation](balance > 0)"])
    types = {"nation": "integer", "balance": "float"}
    parents = {"key": "integer"}
    joined = joins.attach(nations(spark, sf_dir), customers(spark, sf_dir), one, types, [], parent_types=parents)
    joined = joins.attach(joined, suppliers(spark, sf_dir), two, types, [], parent_types=parents)
    return joined.select(F.col("id").alias("parent"), F.size("joined_customers").alias("n_customers"), F.size("joined_suppliers").alias("n_suppliers"))


@query("SELECT n_nationkey::VARCHAR AS parent, CAST(0 AS INTEGER) AS n_suppliers FROM nation")
def join_type_strict(spark, sf_dir):
    """A string key matches no integer key, whatever they say."""
    joined = joins.attach(nations(spark, sf_dir), suppliers(spark, sf_dir), joins.parse("suppliers[$id = $$.meta.nation]"), {"nation": "integer"}, [])
    return joined.select(F.col("id").alias("parent"), F.size("joined_suppliers").alias("n_suppliers"))


# Scans and payloads

@query("SELECT o_orderkey, o_totalprice, true AS more FROM (SELECT * FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100)")
def fetch_page(spark, sf_dir):
    page = documents.fetch_page(table(spark, sf_dir, "orders"), 100, 100, F.col("o_orderstatus") == "O", "o_orderkey")
    return page.select("o_orderkey", "o_totalprice", "more")


@query("SELECT CAST(pos AS INTEGER) AS pos, w.id AS o_orderkey, o_totalprice, o_orderkey IS NOT NULL AS found FROM (VALUES (0, 33), (1, -1), (2, 7), (3, 33)) AS w(pos, id) LEFT JOIN orders ON o_orderkey = w.id")
def multi_get(spark, sf_dir):
    return documents.multi_get(table(spark, sf_dir, "orders"), [33, -1, 7, 33], "o_orderkey").select("pos", "o_orderkey", "o_totalprice", "found")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice > 50000")
def fetch_in_list(spark, sf_dir):
    found = documents.fetch_by_values(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW", "1-URGENT"], F.col("o_totalprice") > 50000)
    return found.select("o_orderkey", "o_orderpriority")


@query("SELECT doc_id, NULL::VARCHAR AS content, NULL::VARCHAR AS meta_lang, n_chars FROM documents")
def exclude_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("meta_lang"), "n_chars")
    return documents.excluded(docs, ("content", "metadata"))


@query("SELECT p_partkey, p_name || ' (' || p_brand || ', ' || p_size || ')' AS text FROM part")
def template_text(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("meta_brand"), F.col("p_size").alias("meta_size"))
    return part.select("p_partkey", documents.document_text("{name} ({.meta.brand}, {.meta.size})", dict(part.dtypes)).alias("text"))


# Change log

def change_rows(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return events.select(F.col("user_id").cast("string").alias("id"), op.alias("op"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("payload"))


CHANGES_SQL = "(SELECT user_id::VARCHAR AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, ts, event_id AS seq, value AS payload FROM events)"
LAST_SQL = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq) AS r FROM {src}) WHERE r = 1)"


@query(f"SELECT id, ts, payload FROM {LAST_SQL.format(src=CHANGES_SQL)} WHERE op = 'upsert'")
def lww_upsert(spark, sf_dir):
    return changelog.replayed(change_rows(spark, sf_dir))


HALF = "timestamp_ntz '2024-01-15 00:00:00'"
OLD_SQL = f"(SELECT id, ts, payload FROM {LAST_SQL.format(src='(SELECT * FROM ' + CHANGES_SQL + ' WHERE seq % 2 = 0)')} WHERE op = 'upsert')"
NEW_SQL = LAST_SQL.format(src="(SELECT * FROM " + CHANGES_SQL + " WHERE seq % 2 = 1)")
FATE_SQL = f"""SELECT n.id, n.op, n.ts, n.payload, CASE WHEN o.id IS NOT NULL AND n.ts <= o.ts THEN 'skipped' WHEN n.op = 'delete' AND o.id IS NULL THEN 'absent' WHEN n.op = 'delete' THEN 'delete'
  WHEN o.id IS NULL THEN 'insert' WHEN n.payload IS NOT DISTINCT FROM o.payload THEN 'patch' ELSE 'vectorize' END AS fate FROM {NEW_SQL} n LEFT JOIN {OLD_SQL} o ON n.id = o.id"""


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A stored snapshot of every other change, and the other changes on top of it."""
    changes = change_rows(spark, sf_dir)
    return changelog.replayed(changes.where("seq % 2 = 0")), changes.where("seq % 2 = 1")


@query(f"WITH f AS ({FATE_SQL}) SELECT id, ts, payload FROM f WHERE fate IN ('insert', 'patch', 'vectorize') UNION ALL SELECT o.id, o.ts, o.payload FROM {OLD_SQL} o LEFT JOIN f ON o.id = f.id AND f.fate <> 'skipped' AND f.fate <> 'absent' WHERE f.id IS NULL")
def lww_delete(spark, sf_dir):
    return changelog.merged(*halves(spark, sf_dir))


@query(f"SELECT id, op, fate FROM ({FATE_SQL})")
def ingest_fates(spark, sf_dir):
    return changelog.classified(*halves(spark, sf_dir), ("payload",)).select("id", "op", "fate")


@query(f"SELECT id, op, ts, seq, payload FROM {LAST_SQL.format(src=CHANGES_SQL)}")
def batch_dedup(spark, sf_dir):
    return changelog.newest(change_rows(spark, sf_dir))


def queue_rows(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    status = F.element_at(F.array(F.lit("queued"), F.lit("requeued"), F.lit("failed")), (F.col("event_id") % 3 + 1).cast("int"))
    return change_rows(spark, sf_dir).join(events.select(F.col("event_id").alias("seq"), status.alias("status")), "seq").select(
        F.col("seq").alias("queue_id"), "id", "op", "ts", "status", F.when(F.col("status") == "queued", 0).otherwise(F.col("seq") % 7).cast("int").alias("try_count"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))


QUEUE_SQL = f"(SELECT seq AS queue_id, id, op, ts, status, CAST(CASE WHEN status = 'queued' THEN 0 ELSE seq % 7 END AS INTEGER) AS try_count, ts AS created_at FROM (SELECT *, ['queued', 'requeued', 'failed'][seq % 3 + 1] AS status FROM {CHANGES_SQL}))"


@query("SELECT " + ", ".join(f"count(*) FILTER (status = '{s}' AND op = '{o}') AS {s}_{o}" for s in ("queued", "requeued", "failed") for o in ("upsert", "delete")) + f", count(*) AS total FROM {QUEUE_SQL}")
def queue_info(spark, sf_dir):
    return changelog.queue_info(queue_rows(spark, sf_dir))


@query(f"SELECT queue_id, id, try_count FROM {QUEUE_SQL} WHERE status IN ('queued', 'requeued') ORDER BY try_count > 0, created_at, queue_id LIMIT 192")
def queue_claim(spark, sf_dir):
    return changelog.claimed(queue_rows(spark, sf_dir)).select("queue_id", "id", "try_count")


@query(f"SELECT queue_id, try_count FROM {QUEUE_SQL} WHERE status IN ('queued', 'requeued') AND (try_count = 0 OR epoch(TIMESTAMP '2024-01-15 00:00:00' - ts) >= least(2.0 * try_count + 0.1 + ((try_count::BIGINT * 2654435761) % 1000) / 1000.0 * 1.4, 20.0))")
def retry_eligibility(spark, sf_dir):
    return changelog.eligible(queue_rows(spark, sf_dir), F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))).select("queue_id", "try_count")


ERROR_SQL = "[NULL, 'validation', 'vectorization', 'database'][queue_id % 4 + 1]"


@query(f"SELECT queue_id, CASE WHEN e IS NULL THEN 'done' WHEN e = 'vectorization' AND try_count + 1 < 4 THEN 'requeued' WHEN e = 'database' AND try_count + 1 < 200 THEN 'requeued' ELSE 'failed' END AS next_status FROM (SELECT *, {ERROR_SQL} AS e FROM {QUEUE_SQL})")
def failure_routing(spark, sf_dir):
    error = F.element_at(F.array(F.lit(None).cast("string"), F.lit("validation"), F.lit("vectorization"), F.lit("database")), (F.col("queue_id") % 4 + 1).cast("int"))
    return changelog.routed(queue_rows(spark, sf_dir), error).select("queue_id", "next_status")


@query(f"SELECT '8' AS id, 'indexed' AS status, ts FROM {OLD_SQL} WHERE id = '8' UNION ALL SELECT id, status, ts FROM {QUEUE_SQL} WHERE id = '8'")
def doc_status(spark, sf_dir):
    return changelog.document_status(halves(spark, sf_dir)[0], queue_rows(spark, sf_dir), "8")


@query(f"SELECT queue_id, id, op FROM {QUEUE_SQL} q WHERE NOT (op = 'upsert' AND status IN ('queued', 'requeued') AND EXISTS (SELECT 1 FROM {CHANGES_SQL} d WHERE d.op = 'delete' AND d.id = q.id AND q.ts <= d.ts))")
def cancelled_upserts(spark, sf_dir):
    deletes = change_rows(spark, sf_dir).where("op = 'delete'").select("id", F.col("ts").alias("request_ts"))
    return changelog.cancelled_by_delete(queue_rows(spark, sf_dir), deletes).select("queue_id", "id", "op")


# Metrics

FIVE_SQL = "(SELECT event_type, CAST(floor(epoch(ts) / 5) * 5 AS BIGINT) AS bucket_start, sum(value) AS value, count(value) AS n FROM events GROUP BY 1, 2)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def five(spark, sf_dir):
    return metrics.buckets(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"])


@query(f"SELECT event_type, bucket_start, round(value, 6) AS value, n, CAST(5 AS BIGINT) AS bucket_seconds FROM {FIVE_SQL}")
def bucket_5s(spark, sf_dir):
    return rounded(five(spark, sf_dir), "value")


def rollup_sql(seconds: int, source: str = FIVE_SQL) -> str:
    return f"SELECT event_type, CAST(bucket_start - bucket_start % {seconds} AS BIGINT) AS bucket_start, round(sum(value), 6) AS value, CAST(sum(n) AS BIGINT) AS n, CAST({seconds} AS BIGINT) AS bucket_seconds FROM {source} GROUP BY 1, 2"


@query(rollup_sql(60))
def rollup_1m(spark, sf_dir):
    return rounded(metrics.rolled_up(five(spark, sf_dir), ["event_type"], 60), "value")


@query(rollup_sql(300))
def rollup_5m(spark, sf_dir):
    return rounded(metrics.rolled_up(metrics.rolled_up(five(spark, sf_dir), ["event_type"], 60), ["event_type"], 300), "value")


@query(f"SELECT event_type, \"at\", round(sum(value), 6) AS value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, bucket_start + 5 * unnest(range(0, 12)) AS \"at\" FROM {FIVE_SQL}) GROUP BY 1, 2")
def sliding_60s(spark, sf_dir):
    return rounded(metrics.sliding(five(spark, sf_dir), ["event_type"]), "value")


@query(f"SELECT event_type, round(sum(value) / sum(n), 6) AS average FROM {FIVE_SQL} GROUP BY 1")
def metric_averages(spark, sf_dir):
    whole = five(spark, sf_dir).groupBy("event_type").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    return rounded(metrics.averaged(whole), "average").select("event_type", "average")

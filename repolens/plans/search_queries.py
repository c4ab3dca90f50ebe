"""Retrieval queries: tokens, postings, BM25, vectors, fusion, reranking, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.functions.tokenize import SQL_TOKENS, tokens, weighted_tokens
from repolens.operators import ranking, vectors
from repolens.operators.bm25 import bm25_scores, corpus_stats, index_scores, postings, top_k
from repolens.plans.registry import register, tasks_for

QUERY_TERMS = ["ththe", "nterti", "ouen", "retitioning", "elle"]
INTENT_QUERY = "cold widget Brand standard copper"
PATH_QUERY = "blog page index en 7"
TASK_BYTES = 8_000_000  #: of text whose terms one task counts


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt by their key before their words are taken apart: a text passes one exchange, and neither its terms' counts nor their ranking
    need another. Their number follows the texts' bytes, so that a task's tables of terms stay of one size."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return docs.repartition(tasks_for(spark, size, TASK_BYTES), "doc_id")


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_TOKS = SQL_TOKENS.format(text="text")
_POSTINGS = f"""
WITH toks AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {_TOKS} AS t FROM documents)),
tf AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS pos FROM toks GROUP BY doc_id, term)
SELECT doc_id, term, tf FROM tf QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, pos) <= 64"""


@register("tokenize_terms", f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOKS}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with its frequency and its number of documents."""
    per_doc = postings(_by_doc(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("terms")), "doc_id", "terms", top=None)
    return per_doc.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("docs"))


@register("postings_tf", _POSTINGS)
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of the documents."""
    return postings(_by_doc(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("terms")), "doc_id", "terms")


@register("doc_stats", f"SELECT count(*) AS doc_count, avg(n) AS avg_doc_length FROM (SELECT len({_TOKS}) AS n FROM documents) WHERE n > 0")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus statistics."""
    return corpus_stats(_docs(spark, sf_dir).select(tokens(F.col("text")).alias("terms")), "terms")


_PART_TOKS = {c: SQL_TOKENS.format(text=c) for c in ("p_name", "p_brand", "p_type")}


@register("weighted_doc_tokens", f"""
SELECT p_partkey, array_to_string(list_concat(list_concat(list_concat(m, m), list_concat(o, s)), list_filter(p, lambda x, i: i % 2 = 1)), ' ') AS tokens
FROM (SELECT p_partkey, {_PART_TOKS['p_name']} AS m, {_PART_TOKS['p_brand']} AS o, {_PART_TOKS['p_type']} AS s,
  {SQL_TOKENS.format(text="p_type || '/' || p_brand || '/' || p_name")} AS p FROM part)""")
def weighted_doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-weighted token streams of parts: name as method, brand as owner, type as signature."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.concat_ws("/", "p_type", "p_brand", "p_name")
    composed = weighted_tokens(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(None).cast("string"), path)
    return p.select("p_partkey", F.array_join(composed, " ").alias("tokens"))


BM25_SQL = f"""
WITH toks AS (SELECT doc_id, unnest({_TOKS}) AS term FROM documents),
lens AS (SELECT doc_id, count(*) AS dl FROM toks GROUP BY doc_id),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term IN ({_sql_list(QUERY_TERMS)}) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
  FROM tf JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN stats GROUP BY tf.doc_id)
SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored
QUALIFY rank <= 20"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("terms"))
    return top_k(bm25_scores(docs, "doc_id", "terms", QUERY_TERMS), "doc_id", 20)


@register("bm25_topk", BM25_SQL)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for a fixed list of terms."""
    return _bm25(spark, sf_dir)


_VECTOR = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_VECTOR_SQL = f"""
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]), 6) AS score
FROM embeddings WHERE len(embedding) = 64"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cosine_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", _VECTOR, 20)


@register("vector_topk", f"SELECT * FROM ({_VECTOR_SQL}) ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to a fixed query."""
    return _vectors(spark, sf_dir)


@register("rrf_fusion", f"""
WITH b AS ({BM25_SQL}), v AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({_VECTOR_SQL}) QUALIFY rank <= 20),
u AS (SELECT doc_id AS id, 1.0 / (60 + rank)::DOUBLE AS part FROM b UNION ALL SELECT vec_id, 1.0 / (60 + rank)::DOUBLE FROM v)
SELECT id, round(sum(part), 6) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 25""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of the two rankings above."""
    v = _vectors(spark, sf_dir).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    return ranking.reciprocal_rank_fusion([_bm25(spark, sf_dir).select(F.col("doc_id").alias("id"), "rank"), v.select(F.col("vec_id").alias("id"), "rank")], "id", 25)


_PLACE = "(('0x' || md5(t)[1:6])::BIGINT % 128)"


@register("hashed_vectors", f"""
WITH t AS (SELECT p_partkey, unnest(list_concat({_PART_TOKS['p_name']}, {_PART_TOKS['p_type']})) AS t FROM part),
e AS (SELECT p_partkey, {_PLACE} AS i, sum(CASE WHEN md5(t)[32] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 1 ELSE -1 END)::DOUBLE AS n FROM t GROUP BY ALL HAVING n <> 0)
SELECT p_partkey, i::INTEGER AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)), 6) AS value FROM e""")
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed vectors of parts' names and types, component by component."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(tokens(F.col("p_name")), tokens(F.col("p_type"))).alias("terms"))
    made = vectors.hashed_vectors(p, "p_partkey", "terms").select("p_partkey", F.posexplode("vector").alias("place", "value"))
    return made.where("value <> 0").select("p_partkey", "place", F.round("value", 6).alias("value"))


@register("bm25_index_topk", f"""
WITH p AS ({_POSTINGS}), lens AS (SELECT doc_id, len({_TOKS}) AS dl FROM documents WHERE len({_TOKS}) > 0), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
tf AS (SELECT * FROM p WHERE term IN ({_sql_list(QUERY_TERMS)})), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
  FROM tf JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN stats GROUP BY tf.doc_id)
SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 20""")
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same terms against postings of 64 terms a document, as the tools search them."""
    docs = _by_doc(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("terms"))
    lengths = docs.select("doc_id", F.size("terms").alias("doc_length")).where("doc_length > 0")
    scores = index_scores(postings(docs, "doc_id", "terms"), lengths, "doc_id", QUERY_TERMS)
    return top_k(scores.withColumn("score", F.round("score", 4)), "doc_id", 20)


_KINDS = ["method", "function", "class", "interface", "trait", "enum", "struct"]
_ASKED = "['cold', 'widget', 'brand', 'standard', 'copper']"


@register("bm25_intent_rerank", f"""
WITH p AS (
  SELECT p_partkey, ln(p_retailprice) AS base, ['method', 'function', 'class', 'interface', 'trait', 'enum', 'struct'][p_size % 7 + 1] AS type,
    {_PART_TOKS['p_name']} AS m, {_PART_TOKS['p_brand']} AS o, {_PART_TOKS['p_type']} AS s, CASE WHEN p_size % 5 = 0 THEN 1.10 ELSE 1.0 END AS marked FROM part),
f AS (SELECT *, list_has_any(m, {_ASKED}) AS named, list_has_any(s, {_ASKED}) AS sig, list_has_any(o, {_ASKED}) AS own FROM p)
SELECT p_partkey, type, round(base * CASE type WHEN 'method' THEN 1.15 WHEN 'function' THEN 1.05 WHEN 'class' THEN 0.9 WHEN 'interface' THEN 0.75
  WHEN 'trait' THEN 0.75 WHEN 'enum' THEN 0.85 ELSE 1.0 END * CASE WHEN named THEN 1.55 ELSE 1.0 END
  * CASE WHEN own AND NOT named AND NOT sig THEN 0.65 ELSE 1.0 END * marked, 4) AS score FROM f ORDER BY score DESC, p_partkey LIMIT 200""")
def bm25_intent_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent reranking of parts: brand as owner, name as method, type as signature, the price's logarithm as the first score."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("p_size") % 7 + 1).cast("int"))
    signature = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("@get "), F.col("p_type"))).otherwise(F.col("p_type"))
    owner = F.regexp_replace("p_brand", "#", "_")
    hits = p.select("p_partkey", F.log("p_retailprice").alias("score"), kind.alias("type"), F.concat_ws(".", owner, "p_name").alias("short_name"), signature.alias("signature"), F.lit("").alias("docstring"))
    ranked = ranking.intent_rerank(hits, INTENT_QUERY)
    return ranked.select("p_partkey", "type", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(200)


def _page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    file = F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1)
    host = F.regexp_extract("url", r"^https?://([^/]*)", 1)
    first = F.when(F.col("page_id") % 6 == 0, "tests/").when(F.col("page_id") % 6 == 1, "docs/").when(F.col("page_id") % 6 == 2, "examples/").otherwise("")
    return pages.select("page_id", F.concat(first, file).alias("file"), host.alias("short_name"), (1000.0 / (1 + F.abs(F.col("page_id") - 100))).alias("score"))


_PATH_HITS = r"""
h AS (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'tests/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'examples/' ELSE '' END || regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS file,
    regexp_extract(url, '^https?://([^/]*)', 1) AS short_name, 1000.0::DOUBLE / (1 + abs(page_id - 100)) AS score FROM pages),
g AS (SELECT *, CASE page_id % 6 WHEN 0 THEN 'test' WHEN 1 THEN 'docs' WHEN 2 THEN 'example' ELSE 'source' END AS path_role,
    regexp_replace(lower(short_name), '[^a-z0-9]+', '', 'g') AS cs, regexp_replace(lower(file), '[^a-z0-9]+', '', 'g') AS cp,
    regexp_split_to_array(lower(short_name), '\W+') AS st, regexp_split_to_array(lower(regexp_extract(file, '([^/]*)$', 1)), '\W+') AS bt FROM h),
m AS (SELECT *, CASE WHEN contains(short_name, '.') AND false THEN 1 ELSE 1.0 END
    * CASE WHEN ends_with(lower(short_name), '.index') OR lower(short_name) = 'index' THEN 1.18 ELSE 1.0 END
    * CASE WHEN contains(cs, 'page') OR contains(cp, 'page') THEN 1.10 ELSE 1.0 END AS match,
    score * CASE path_role WHEN 'source' THEN 1.12 WHEN 'test' THEN 0.72 WHEN 'docs' THEN 0.45 ELSE 0.35 END
    * CASE WHEN list_has_any(st, ['blog', 'page', 'index', 'en', '7']) THEN 1.1 WHEN list_has_any(bt, ['blog', 'page', 'index', 'en', '7']) THEN 1.03 ELSE 1.0 END
    * CASE WHEN """ + " OR ".join(f"contains({c}, '{t}')" for t in ("7", "blog", "en", "index", "page") for c in ("cs", "cp")) + r""" THEN 1.08 ELSE 1.0 END AS adjusted FROM g),
r AS (SELECT page_id, path_role, short_name, round(match, 4) AS framework_match_score, round(adjusted * match, 4) AS adjusted_score FROM m)"""


@register("path_role_rerank", f"WITH {_PATH_HITS} SELECT page_id, path_role, framework_match_score, adjusted_score FROM r")
def path_role_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and framework reranking of pages, URLs as files and hosts as symbols."""
    return ranking.path_rerank(_page_hits(spark, sf_dir), PATH_QUERY).select("page_id", "path_role", "framework_match_score", "adjusted_score")


@register("query_resolution", f"""
WITH {_PATH_HITS},
o AS (SELECT *, row_number() OVER (ORDER BY path_role = 'source' DESC, adjusted_score DESC, short_name DESC, page_id) AS n FROM r),
t AS (SELECT * FROM o WHERE n = 1), x AS (SELECT max(adjusted_score) AS s2 FROM o WHERE n <> 1),
j AS (SELECT page_id, adjusted_score, round(adjusted_score - coalesce(s2, 0), 4) AS score_gap, CASE WHEN s2 <> 0 THEN round(adjusted_score / greatest(s2, 0.0001), 4) END AS score_ratio,
  path_role, framework_match_score AS f, s2 FROM t, x)
SELECT page_id, adjusted_score, score_gap, score_ratio, path_role, CASE WHEN score_gap >= 1.0 THEN 'strong' ELSE 'moderate' END AS selection_confidence FROM j
WHERE adjusted_score >= 0.5 AND NOT (path_role <> 'source' AND score_gap < 1.0 AND (score_ratio IS NULL OR score_ratio < 1.35))
  AND NOT CASE WHEN s2 IS NOT NULL AND score_gap < 0.35 AND (score_ratio IS NULL OR score_ratio < 1.12) THEN f < 1.15 WHEN s2 IS NOT NULL AND score_gap < 0.2 THEN f < 1.25 ELSE false END""")
def query_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one clear target of a query, or none."""
    ranked = ranking.path_rerank(_page_hits(spark, sf_dir), PATH_QUERY).orderBy(F.desc("adjusted_score"), F.desc("short_name"), "page_id")
    best = ranked.where("path_role = 'source'").limit(24).unionByName(ranked.where("path_role <> 'source'").limit(24))
    return ranking.resolve_query(best, "page_id").select("page_id", "adjusted_score", "score_gap", "score_ratio", "path_role", "selection_confidence")

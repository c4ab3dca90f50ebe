"""BM25 over an inverted index, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, TOP_TERMS = 1.5, 0.75, 64


def postings(docs: DataFrame, key: str, terms: str, top: int | None = TOP_TERMS) -> DataFrame:
    """(key, term, tf): term frequencies, the ``top`` most frequent of each document (ties: first seen)."""
    exploded = docs.select(key, F.posexplode(terms).alias("pos", "term"))
    counted = exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos"))
    if top is not None:
        order = Window.partitionBy(key).orderBy(F.desc("tf"), "pos")
        counted = counted.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top)
    return counted.select(key, "term", "tf")


def corpus_stats(docs: DataFrame, terms: str) -> DataFrame:
    """One row (doc_count, avg_doc_length) over documents that have a term."""
    n = F.when(F.col("n") > 0, F.col("n"))  # a filter would be pushed below the projection and take the terms apart once more
    return docs.select(F.size(terms).alias("n")).agg(F.count(n).alias("doc_count"), F.avg(n).alias("avg_doc_length"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_scores(docs: DataFrame, key: str, terms: str, query: list[str]) -> DataFrame:
    """(key, score) of the documents that hold a query term. ``terms`` is an array column, ``key`` is unique and not null.

    Documents are read and their terms counted once: a document becomes its length and its counts of the query's terms, and those small rows
    pass one exchange, which both the corpus statistics (one row) and the scores read.
    """
    wanted = list(dict.fromkeys(query))
    times = lambda term: F.size(F.filter("hits", lambda x: x == term))
    hit = docs.select(F.col(key), F.size(terms).alias("dl"), F.filter(terms, lambda x: x.isin(wanted)).alias("hits"))
    sized = hit.select(key, "dl", F.array(*map(times, wanted)).alias("tf")).repartition(F.col(key))
    some = F.col("dl") > 0  # not a filter: it would be pushed below the projection and take the terms apart once more
    held = lambda i: F.sum(F.when(F.col("tf")[i] > 0, 1).otherwise(0)).alias(f"df{i}")
    stats = sized.agg(F.count(F.when(some, F.col(key))).alias("n"), F.avg(F.when(some, F.col("dl"))).alias("avgdl"), *[held(i) for i in range(len(wanted))])
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf = F.col("tf")[i]
        norm = tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
        score = score + idf(F.col("n"), F.col(f"df{i}")) * tf * (K1 + 1) / norm
    # a hit scores above 0; a test of the counts would be pushed below the exchange, and then the two sides could not share it
    return sized.crossJoin(F.broadcast(stats)).select(key, F.round(score, 4).alias("score"), score.alias("_s")).where("_s > 0").drop("_s")


def index_scores(index: DataFrame, lengths: DataFrame, key: str, query: list[str], stats: DataFrame | None = None) -> DataFrame:
    """The same from a stored index: postings (key, term, tf), of which only the query's terms are read, and lengths (key, doc_length).
    ``stats`` is one row (doc_count, avg_doc_length), where it is known."""
    hits = index.where(F.col("term").isin(list(dict.fromkeys(query))))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_length").alias("avgdl")) if stats is None else stats.select(F.col("doc_count").alias("n"), F.col("avg_doc_length").alias("avgdl"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("doc_length") / F.col("avgdl"))
    joined = hits.join(lengths.select(key, "doc_length"), key).join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    return joined.groupBy(key).agg(F.sum(idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / norm).alias("score"))


def top_k(scores: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows with their rank, ties by key."""
    best = scores.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))

"""The registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import conversations, hardnegatives, htmltext, languagemodel, mixing, orderminhash, packing, personal, quality, sharding, substrings, urlrules, vafile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op2_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return vafile.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    import public_tokenizers

    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, under the law ``key``."""
    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    judged = quality.judge(_table(spark, sf_dir, "documents"), lang="lang")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return orderminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document."""
    scored = languagemodel.score_documents(_table(spark, sf_dir, "documents"))
    return scored.withColumn("base_score", F.round("base_score", 6))  # a sum's last digits depend on its order


def op9_lempel_ziv_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What substring dedup removes from every document."""
    return substrings.digests(_table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page."""
    return urlrules.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each positive of every vector whose id is divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, by form and by context."""
    return personal.find(_table(spark, sf_dir, "documents"))


def op13_trie_shared_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage."""
    return conversations.repair(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_suffix_array_text, op2_va_file_top_k, op3_hilbert_packing, op4_hash_tree_shards, op5_water_filling, op6_quality_rules, op7_order_minhash, op8_elias_fano_lm,
        op9_lempel_ziv_spans, op10_url_rules, op11_bit_sliced_negatives, op12_bootstrapped_pii, op13_trie_shared_repair,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    sql6 = "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM (" + quality.SQL + ")"
    return {
        "op2_va_file_top_k": vafile.SQL, "op4_hash_tree_shards": sharding.SQL, "op5_water_filling": mixing.SQL, "op6_quality_rules": sql6, "op8_elias_fano_lm": languagemodel.SQL,
        "op9_lempel_ziv_spans": substrings.SQL, "op10_url_rules": urlrules.SQL, "op11_bit_sliced_negatives": hardnegatives.SQL, "op13_trie_shared_repair": conversations.SQL,
    }

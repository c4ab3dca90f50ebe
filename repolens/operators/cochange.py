"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_COMMITS, MIN_FILES, MAX_FILES = 500, 2, 30


def cochange_pairs(changes: DataFrame, commit: str, file: str, position: str, date: str, max_files: int = MAX_FILES, tasks: int | None = None) -> DataFrame:
    """(file_a, file_b, count, last_seen) over commits of 2 to ``max_files`` distinct files.

    ``position`` counts from the newest commit; last_seen is the date of the newest commit that has both. The cap on a commit's files bounds
    the join: a commit gives fewer than ``max_files`` squared pairs, and none is a hot key. ``tasks`` share the pairs; without it Spark decides.
    """
    baskets = changes.groupBy(F.col(commit).alias("_commit")).agg(F.array_sort(F.collect_set(file)).alias("files"), F.min(position).alias("pos"), F.first(date).alias("day"))
    fit = baskets.where(F.size("files").between(MIN_FILES, max_files))
    pairs = fit.select("pos", "day", "files", F.posexplode("files").alias("i", "file_a")).select("pos", "day", "file_a", F.explode(F.expr("slice(files, i + 2, size(files))")).alias("file_b"))
    if tasks is not None:
        pairs = pairs.repartition(tasks, "file_a", "file_b")
    return pairs.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("count"), F.min_by("day", "pos").alias("last_seen"))


def only_indexed(pairs: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Pairs whose files are both known."""
    known = files.select(F.col(path).alias("_f")).dropDuplicates()
    return pairs.join(known, F.col("file_a") == F.col("_f"), "left_semi").join(known, F.col("file_b") == F.col("_f"), "left_semi")


def peers(pairs: DataFrame, target, limit: int = 7) -> DataFrame:
    """(peer, count, last_seen) of one file, most frequent and newest first."""
    mine = pairs.where((F.col("file_a") == target) | (F.col("file_b") == target))
    other = F.when(F.col("file_a") == target, F.col("file_b")).otherwise(F.col("file_a"))
    return mine.select(other.alias("peer"), "count", "last_seen").orderBy(F.desc("count"), F.desc("last_seen"), "peer").limit(limit)


def risk_gate(top_peers: DataFrame, strong_count: int = 2, strong_peers: int = 5, hot_count: int = 4) -> DataFrame:
    """One row (strong, max_count, fires) for a list of peers."""
    strong = F.sum(F.when(F.col("count") >= strong_count, 1).otherwise(0))
    found = top_peers.agg(F.coalesce(strong, F.lit(0)).alias("strong"), F.coalesce(F.max("count"), F.lit(0)).alias("max_count"))
    return found.withColumn("fires", (F.col("strong") >= strong_peers) | (F.col("max_count") >= hot_count))

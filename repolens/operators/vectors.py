"""Symbol vectors without a model: hashed term frequencies of unit length. Any other array column of one length works in their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 128


def place(term: Column, dimensions: int = DIMENSIONS) -> Column:
    """Which component a term counts in, by the first hexadecimal digits of its digest."""
    return (F.conv(F.substring(F.md5(term), 1, 6), 16, 10).cast("long") % dimensions).cast("int")


def sign(term: Column) -> Column:
    """Whether it adds or subtracts, so that terms that share a component cancel out on average."""
    return F.when(F.substring(F.md5(term), 32, 1).isin(*"02468ace"), 1).otherwise(-1)


def hashed_vectors(docs: DataFrame, key: str, terms: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vector) of rows that have a term and don't cancel out to nothing. Components are added up before rows are gathered."""
    each = docs.select(F.col(key), F.explode(terms).alias("t")).groupBy(key, place(F.col("t"), dimensions).alias("i")).agg(F.sum(sign(F.col("t"))).cast("double").alias("n")).where("n <> 0")
    held = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("held"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    component = lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0.0)) / F.col("norm")
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), component).alias("vector"))

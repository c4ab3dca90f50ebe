"""A stream of changed rows kept as a table: each batch replaces the rows of its keys, and writes only the buckets that these are in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repolens.operators.project import upsert

BUCKETS = 32


def latest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the largest ``order``."""
    row = F.struct(*[F.col(c) for c in batch.columns])
    return batch.groupBy(key).agg(F.max_by(row, order).alias("_r")).select("_r.*")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """The newest finished batch of each bucket; with ``before`` of the batches before that."""
    try:
        done = spark.read.schema("batch long, bucket int").parquet(f"{table}/done")
        rows = (done if before is None else done.where(F.col("batch") < before)).groupBy("bucket").agg(F.max("batch").alias("batch")).collect()
    except Exception as e:  # Spark has one class for a missing path and for others
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return {r["bucket"]: r["batch"] for r in rows}


def _rows(spark: SparkSession, table: str, schema, versions: dict[int, int]) -> DataFrame:
    paths = [f"{table}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, table: str, schema) -> DataFrame:
    """The table after the newest finished batch; empty before the first."""
    return _rows(spark, table, schema, _versions(spark, table))


def start(stream: DataFrame, table: str, key: str, order: str, checkpoint: str, available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Write the buckets of every micro-batch's keys as new versions, then mark them done. A batch that is repeated after a failure starts from the
    batches before it and writes the same rows to the same place. A table keeps the number of ``buckets`` that it began with."""
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch, key, order).persist()
        try:
            touched = [r["b"] for r in fresh.select(_bucket(key, buckets).alias("b")).distinct().collect()]  # ``buckets`` at most
            if not touched:
                return
            versions = {b: v for b, v in _versions(spark, table, before=number).items() if b in set(touched)}
            merged = upsert(_rows(spark, table, schema, versions), fresh, key).withColumn("bucket", _bucket(key, buckets))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/batch={number}")
            spark.createDataFrame([(number, b) for b in touched], "batch long, bucket int").coalesce(1).write.mode("append").parquet(f"{table}/done")
        finally:
            fresh.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

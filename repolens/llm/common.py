"""Shared parts: white space, lambda-bound values, shared scratch tables, distributed running numbers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters that separate words, for Java's regular expressions and for DuckDB's. ``bytes.split()`` splits at the same ones.
SPACE = r"[ \t-\r]"
NOT_SPACE = r"[^ \t-\r]+"
SQL_NOT_SPACE = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: a lambda variable can't be inlined where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, null as none. Only the first can be empty, so it alone is tested."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words, as long; null has none."""
    return F.size(words(text)).cast("long")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. One of our own only on a single machine; elsewhere each machine would have another."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="repolens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_WRITTEN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder, so that lost executors cost no recomputation."""
    scratch_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    at = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if at.isDefined():
        _remember(at.get())
    return out


def stash(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: columns that a reader leaves out aren't read."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _remember(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """The same rows, as a join's side that stays in the executors. Else a table that Spark finds small enough is collected and hashed in the driver, and
    several of these at once are more than a small driver holds."""
    return df.hint("merge")


def _remember(path: str) -> None:
    if not _WRITTEN:
        atexit.register(_at_exit)
    _WRITTEN.append(path)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be going down too
            clean_scratch(spark)


def scratch_mark() -> int:
    """How many tables and checkpoints there are; ``clean_scratch`` can spare them."""
    return len(_WRITTEN)


def clean_scratch(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> None:
    """Delete the tables and checkpoints that ``stash`` and ``cut`` have written, but for the first ``since`` and the files of ``keep``.

    Call it when results that were built from them are written; what is left goes when the program ends.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kept = {jvm.org.apache.hadoop.fs.Path(f).getParent().toUri().getPath() for f in (keep.inputFiles() if keep is not None else [])}
    left = _WRITTEN[:since]
    for written in _WRITTEN[since:]:
        path = jvm.org.apache.hadoop.fs.Path(written)
        if path.toUri().getPath() in kept:
            left.append(written)
        else:
            path.getFileSystem(conf).delete(path, True)
    _WRITTEN[:] = left


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give a Python worker's freed memory back: a worker lives on beside the executor's heap, and its pools would keep what a group took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batch_count(spark: SparkSession, chars: int, most: int, least: int = 1_000_000) -> int:
    """How many batches a corpus falls into: of ``most`` characters, or smaller ones (not below ``least``) where that leaves tasks idle."""
    return max(int(chars // most), min(shuffle_width(spark), int(chars // least))) + 1


def numbered(df: DataFrame, order: list[Column], out: str, within: str | None = None, span: int = 200_000) -> DataFrame:
    """``df`` with a gapless number from 0 in ``out``, by ``order`` (within each value of ``within``), without one task seeing all rows.

    The rows fall into ranges of their order columns, about ``span`` rows each; a range's rows are numbered by a window, and only the ranges'
    counts are summed in one place. The numbers are those of one sort at every size. Rows with equal order columns are in one range.
    """
    rows = cut(df)
    ranges = rows.count() // span + 1
    ranged = cut(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))  # bounds are sampled: written once
    keys = [F.col(within)] if within else []
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    here = Window.partitionBy(*keys, "_range").orderBy(*order)
    ranked = ranged.withColumn("_rank", F.row_number().over(here))
    joined = ranked.join(starts, [*([within] if within else []), "_range"])
    return joined.withColumn(out, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_range", "_rank", "_start")

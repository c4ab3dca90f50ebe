"""Index tables on disk, in segments: a build writes one, a change writes a small one with the files that it covers, and a manifest names those that count.

A row of a segment counts unless a later segment covers its file. So the work of a change is that of the changed files; when there are more than
``MAX_SEGMENTS``, they are merged into one. Manifests are appended: a reader sees the one before or the new one, never a mixture.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 9
#: Tables whose rows belong to a file (column ``path``).
BY_PATH = ["files", "symbols", "calls", "names", "inherits", "search_docs", "search_postings", "search_vectors", "identifiers", "gram_files", "snapshot"]
#: A segment's other table: its rows count as far as ``gram_files`` does. And tables that every version has whole.
BY_BLOCK, WHOLE = ["grams"], ["cochanges", "totals"]
MAX_SEGMENTS = 8

_MANIFEST = "seq long, ordinal int, segment string, whole string, schema_version int, schemas string"
WRITERS = 6  #: tables that are written at a time


def _manifest(spark: SparkSession, path: str) -> list:
    """The rows of the newest manifest, oldest segment first; none where there is none or it has another schema version."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests")
        last = rows.join(rows.agg(F.max("seq").alias("seq")), "seq").orderBy("ordinal").collect()
    except Exception as e:  # Spark has one class for a missing path and for others
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return last if last and all(r["schema_version"] == SCHEMA_VERSION for r in last) else []


def _point(spark: SparkSession, path: str, segments: list[str], whole: str, schemas: str) -> None:
    try:
        seq = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests").agg(F.max("seq")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        seq = 0
    rows = [(seq + 1, i, s, whole, SCHEMA_VERSION, schemas) for i, s in enumerate(segments)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifests")
    _vacuum(spark, path)


def _vacuum(spark: SparkSession, path: str) -> None:
    """Delete what neither the newest manifest nor the one before names; a reader may still be on that one."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests").collect()
    recent = sorted({r["seq"] for r in rows})[-2:]
    kept = {r[c] for r in rows if r["seq"] in recent for c in ("segment", "whole")}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder, column in (("segments", "segment"), ("versions", "whole")):
        for name in {r[column] for r in rows} - kept:
            gone = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}/{name}")
            gone.getFileSystem(conf).delete(gone, True)


def at_once(spark: SparkSession, jobs: list[Callable[[], object]]) -> None:
    """Run jobs, none of which waits for another, a few at a time."""
    thread = inheritable_thread_target(spark)
    with ThreadPoolExecutor(WRITERS) as pool:
        for done in [pool.submit(thread(job)) for job in jobs]:
            done.result()


def _write(tables: dict[str, DataFrame], path: str, covers: DataFrame) -> tuple[str, str, str]:
    """The names of the new segment and version, and the tables' schemas: a reader needn't open a file to learn them."""
    segment, whole = uuid.uuid4().hex, uuid.uuid4().hex
    parts = {f"segments/{segment}/{name}": tables[name] for name in BY_PATH + BY_BLOCK} | {f"segments/{segment}/covers": covers.select("path")} | {f"versions/{whole}/{name}": tables[name] for name in WHOLE}
    at_once(covers.sparkSession, [partial(df.write.parquet, f"{path}/{name}") for name, df in parts.items()])
    return segment, whole, json.dumps({name.split("/")[-1]: df.schema.jsonValue() for name, df in parts.items()})


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Write all tables as one segment, then point to it."""
    segment, whole, schemas = _write(tables, path, tables["snapshot"])
    _point(tables["files"].sparkSession, path, [segment], whole, schemas)


def append(tables: dict[str, DataFrame], path: str, covers: DataFrame) -> None:
    """Add a segment with the tables of changed files. ``covers`` (path) are the changed, new and deleted files; their older rows count no longer."""
    spark = covers.sparkSession
    before = [r["segment"] for r in _manifest(spark, path)]
    segment, whole, schemas = _write(tables, path, covers)
    _point(spark, path, [*before, segment], whole, schemas)
    if len(before) + 1 > MAX_SEGMENTS:
        save(load(spark, path), path)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The current tables; None where there are none or they have another schema version."""
    rows = _manifest(spark, path)
    if not rows:
        return None
    at = [f"{path}/segments/{r['segment']}" for r in rows]
    schemas = {name: StructType.fromJson(x) for name, x in json.loads(rows[-1]["schemas"]).items()}
    read = lambda folder, name: spark.read.schema(schemas[name]).parquet(f"{folder}/{name}")
    covers = [read(s, "covers") for s in at]

    def live(name: str) -> DataFrame:
        parts = []
        for i, s in enumerate(at):
            part = read(s, name)
            if i + 1 < len(at) and name not in BY_BLOCK:
                part = part.join(reduce(DataFrame.unionByName, covers[i + 1 :]), "path", "left_anti")
            parts.append(part)
        return reduce(DataFrame.unionByName, parts)

    return {name: live(name) for name in BY_PATH + BY_BLOCK} | {name: read(f"{path}/versions/{rows[0]['whole']}", name) for name in WHOLE}


def drop(spark: SparkSession, path: str) -> None:
    """Delete the index."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    with contextlib.suppress(FileNotFoundError):
        for folder in ("manifests", "segments", "versions"):
            gone = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
            gone.getFileSystem(conf).delete(gone, True)

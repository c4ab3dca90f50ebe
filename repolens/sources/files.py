"""Properties of files from ``binaryFile`` rows: text by encoding, statistics, size classes, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions import paths
from repolens.functions.parsing.dispatch import OTHER, SPECIAL

# Upper bounds of size classes in bytes.
SIZE_CLASSES = [(1024, "tiny"), (10 * 1024, "small"), (100 * 1024, "medium"), (1024 * 1024, "large")]


def is_text(content: Column) -> Column:
    """No NUL byte in the first 8 KB."""
    return ~F.hex(F.substring(content, 1, 8192)).rlike("^(?:..)*00")


def decoded(content: Column) -> Column:
    """UTF-8 without a byte order mark, or Latin-1 where the bytes aren't UTF-8."""
    bytes_ = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2**31 - 1)).otherwise(content)
    return F.coalesce(F.try_validate_utf8(bytes_.cast("string")), F.decode(content, "ISO-8859-1"))


def size_class(length: Column) -> Column:
    out = F.lit("huge")
    for most, name in reversed(SIZE_CLASSES):
        out = F.when(length < most, name).otherwise(out)
    return out


def language(path: Column) -> Column:
    """The language that a suffix names; ``blade`` templates first."""
    out = F.lit("unknown")
    ext = paths.extension(path)
    for suffix, name in {**OTHER, **SPECIAL}.items():
        out = F.when(ext == suffix, name).otherwise(out)
    return F.when(F.lower(path).endswith(".blade.php"), "blade").otherwise(out)


def stats(files: DataFrame) -> DataFrame:
    """(path, length, size_class, language, is_text, line_count) of (path, content)."""
    text = is_text(F.col("content"))
    lines = F.when(text, F.size(F.split(decoded(F.col("content")), "\n")) - F.when(decoded(F.col("content")).endswith("\n"), 1).otherwise(0))
    length = F.octet_length("content")
    return files.select("path", length.alias("length"), size_class(length).alias("size_class"), language(F.col("path")).alias("language"), text.alias("is_text"), F.when(length == 0, 0).otherwise(lines).alias("line_count"))


def shallow(files: DataFrame, path: str) -> None:
    """The list of paths as text files."""
    files.select("path").write.mode("overwrite").text(path)


def load_json(spark: SparkSession, schemas: dict, path: str) -> dict[str, DataFrame]:
    """The tables that ``dump_json`` wrote, by their schemas."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def dump_json(tables: dict[str, DataFrame], path: str) -> None:
    """Index tables as JSON lines."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")

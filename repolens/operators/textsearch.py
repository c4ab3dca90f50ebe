"""Line search: literal, regular expression, word boundary; context, file patterns, paging; excerpts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import paths

STRONG = set("|()[]^$\\")
WEAK = (".*", ".+", ".?")
# Shapes that can run for very long.
UNSAFE = (r"\(\.\*\)\+", r"\(\.\+\)\+", r"\(\.\*\)\*")
MAX_PATTERN, MAX_BODY_LINES = 1000, 150


class SearchError(ValueError):
    """A pattern or a page that can't be searched."""


def lines_of(files: DataFrame, file: str, text: str, only: str | None = None) -> DataFrame:
    """(file, line, text): one row per line, numbers from 1, without trailing carriage returns. ``only`` is a column with the numbers that count; null is all."""
    each = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    if only is not None:
        some = F.transform(F.col(only), lambda i: F.struct((i - 1).alias("line"), F.get(each, i - 1).alias("text")))
        every = F.transform(each, lambda t, i: F.struct(i.alias("line"), t.alias("text")))
        exploded = files.select(F.col(file).alias("file"), F.inline(F.coalesce(some, every))).where("text IS NOT NULL")
    else:
        exploded = files.select(F.col(file).alias("file"), F.posexplode(each).alias("line", "text"))
    return exploded.select("file", (F.col("line") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def is_regex(pattern: str) -> bool:
    """Whether a pattern looks meant as a regular expression and has no runaway shape."""
    if any(re.search(u, pattern) for u in UNSAFE):
        return False
    return bool(STRONG & set(pattern)) or any(w in pattern for w in WEAK)


def matcher(text: Column, pattern: str, case_sensitive: bool = True, regex: bool = False, fuzzy: bool = False) -> Column:
    """The predicate on a line. ``fuzzy`` finds the pattern as a word, or as the start of one if it has three characters or more."""
    if not pattern or len(pattern) > MAX_PATTERN:
        raise SearchError("a pattern has 1 to 1000 characters")
    if regex and not is_regex(pattern):
        raise SearchError("not a safe regular expression")
    if not regex and not fuzzy:
        return text.contains(pattern) if case_sensitive else F.lower(text).contains(pattern.lower())
    if regex:
        body, guard = pattern, None
    else:
        quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in pattern)
        body = rf"\b{quoted}\b|{quoted}\b" if len(pattern) >= 3 else rf"\b{quoted}\b"
        # a substring test is far cheaper than the expression and comes first
        guard = text.contains(pattern) if case_sensitive else F.lower(text).contains(pattern.lower())
    found = text.rlike(body if case_sensitive else f"(?i){body}")
    return found if guard is None else guard & found


def search(lines: DataFrame, pattern: str, case_sensitive: bool = True, regex: bool = False, fuzzy: bool = False, file_pattern: str | None = None) -> DataFrame:
    """The matching lines, file filter first."""
    scanned = lines if file_pattern is None else lines.where(paths.basename(F.col("file")).rlike(paths.name_regex(file_pattern)))
    return scanned.where(matcher(F.col("text"), pattern, case_sensitive, regex, fuzzy))


def with_context(lines: DataFrame, hit: Column, k: int) -> DataFrame:
    """Lines within ``k`` of a hit; ``is_hit`` tells them apart. A file's lines are windowed together."""
    near = Window.partitionBy("file").orderBy("line").rowsBetween(-k, k)
    return lines.withColumn("is_hit", hit).withColumn("_near", F.max("is_hit").over(near)).where("_near").drop("_near")


def checked_page(start: int, size: int) -> None:
    if start < 0 or size < 1:
        raise SearchError("a page starts at 0 or later and holds a row or more")


def page(hits: DataFrame, start: int, size: int) -> DataFrame:
    """One page of hits by (file, line), with the place of each."""
    checked_page(start, size)
    some = hits.orderBy("file", "line").limit(start + size)
    return some.withColumn("place", F.row_number().over(Window.orderBy("file", "line")) - 1).where(F.col("place") >= start)


def edit_region(lines: DataFrame, start: int, end: int, context: int = 5) -> DataFrame:
    """Lines ``start`` to ``end`` of each file with context, formatted for editing."""
    some = lines.where(F.col("line").between(start - context, end + context))
    return some.select("file", "line", F.format_string("%4d | %s", "line", "text").alias("shown"), F.col("line").between(start, end).alias("inside"))


def symbol_body(lines: DataFrame, symbols: DataFrame, limit: int = MAX_BODY_LINES) -> DataFrame:
    """(file, symbol, start, end, body, truncated) for symbols (file, symbol, start, end): their lines joined, ``limit`` at most."""
    wanted = symbols.select(F.col("file").alias("_f"), "symbol", "start", F.coalesce("end", F.col("start") + 50).alias("end"))
    inside = lines.join(wanted, (F.col("file") == F.col("_f")) & F.col("line").between(F.col("start"), F.least(F.col("end"), F.col("start") + limit - 1)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return inside.groupBy("file", "symbol", "start", "end").agg(body.alias("body")).withColumn("truncated", F.col("end") - F.col("start") + 1 > limit)

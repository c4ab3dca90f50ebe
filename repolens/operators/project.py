"""Project metrics, hotspots, import graph, summaries and incremental upserts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import names

HOT_LINES, HOT_SYMBOLS = 200, 10


def count_by(files: DataFrame, **keys: Column) -> DataFrame:
    """(dimension, value, n): counts by several keys in one pass over the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in keys.items()]))
    return files.select(each.alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def hotspots(files: DataFrame, counts: DataFrame, file: str, lines: str, n: str, limit: int = 20, hot_lines: int = HOT_LINES, hot_symbols: int = HOT_SYMBOLS) -> DataFrame:
    """(file, lines, symbols) of long or crowded files, longest first. ``counts`` has a row for each file that has symbols."""
    joined = files.select(F.col(file).alias("file"), F.col(lines).alias("lines")).join(counts.select(F.col(file).alias("_f"), F.col(n).alias("_n")), F.col("file") == F.col("_f"), "left")
    sized = joined.select("file", "lines", F.coalesce("_n", F.lit(0)).alias("symbols"))
    return sized.where((F.col("lines") > hot_lines) | (F.col("symbols") > hot_symbols)).orderBy(F.desc("lines"), "file").limit(limit)


def import_graph(files: DataFrame, file: str, imports: str, max_files: int = 50, max_imports: int = 10) -> DataFrame:
    """(file, imports[:10], n_imports) of files that import something."""
    some = files.where(F.size(imports) > 0).orderBy(file).limit(max_files)
    return some.select(F.col(file).alias("file"), F.slice(imports, 1, max_imports).alias("imports"), F.size(imports).alias("n_imports"))


def owner_method_counts(symbols: DataFrame, file: list[str], name: str) -> DataFrame:
    """(file, owner, methods) of dotted names."""
    dotted = symbols.where(F.col(name).contains("."))
    return dotted.groupBy(*file, names.owner_first(F.col(name)).alias("owner")).agg(F.count(F.lit(1)).alias("methods"))


def file_summary(symbols: DataFrame, file: str, kind: str, signature: str, symbol_id: str, name: str, line: str) -> DataFrame:
    """(file, functions, classes, methods, symbol_count): names in line order; the count is before names are filtered."""
    group = names.listing_group(F.col(kind), F.col(signature), F.col(symbol_id))
    shown = names.is_identifier(F.col(name))
    pick = lambda g: F.transform(F.array_sort(F.collect_list(F.when(shown & (group == g), F.struct(F.col(line).alias("line"), F.col(name).alias("name"))))), lambda x: x["name"]).alias(g)
    return symbols.groupBy(F.col(file).alias("file")).agg(pick("functions"), pick("classes"), pick("methods"), F.count(F.lit(1)).alias("symbol_count"))


def upsert(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of the keys in ``fresh`` replaced."""
    return table.join(fresh.select(key).dropDuplicates(), key, "left_anti").unionByName(fresh)


def best_tier(rows: DataFrame, tier: str) -> DataFrame:
    """The rows of the lowest tier that any row reaches."""
    least = rows.agg(F.min(tier).alias("_least"))  # one row
    return rows.crossJoin(F.broadcast(least)).where(F.col(tier) == F.col("_least")).drop("_least")


def nearest_rank(values: DataFrame, value: str, group: list[str], shares: dict[str, float], spans: int = 64) -> DataFrame:
    """Percentiles by nearest rank on the rounded index (n - 1) * share; nulls come first.

    Rows are counted by value before anything else. A group's distinct values fall into ``spans`` ranges of about equal count, by approximate
    percentiles; ranges are summed up, and only the range that an index falls in is summed value by value: no task orders a group.
    """
    counted = values.groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    bounds = counted.groupBy(*group).agg(F.sum("_c").alias("_n"), F.percentile_approx("_v", [k / spans for k in range(1, spans)], 1000).alias("_b"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    keyed = bounds.select(*[F.col(g).alias(f"_{g}") for g in group], "_n", "_b")
    placed = counted.join(F.broadcast(keyed) if not group else keyed, reduce(and_, same, F.lit(True)))
    span = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_b", lambda b: b < F.col("_v"))))
    placed = placed.select(*group, "_n", "_v", "_c", span.alias("_s"))
    sums = placed.groupBy(*group, "_s").agg(F.sum("_c").alias("_c"), F.max("_n").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_s")  # a row for each of the few ranges
    ends = sums.withColumn("_end", F.sum("_c").over(before))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.round((F.col("_n") - 1) * F.lit(s)).alias("i")) for name, s in shares.items()]))
    hit = ends.select(*group, "_s", (F.col("_end") - F.col("_c")).alias("_start"), "_end", asked.alias("_a")).where((F.col("_a.i") >= F.col("_start")) & (F.col("_a.i") < F.col("_end")))
    right = hit.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_s").alias("__s"), "_start", "_a")
    inside = placed.join(right, reduce(and_, same, F.col("_s") == F.col("__s")))
    running = Window.partitionBy(*group, "_s", "_a.name").orderBy(F.asc_nulls_first("_v"))  # the distinct values of one range
    found = inside.withColumn("_to", F.col("_start") + F.sum("_c").over(running)).where((F.col("_a.i") < F.col("_to")) & (F.col("_a.i") >= F.col("_to") - F.col("_c")))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("_a.name") == name, F.col("_v"))).alias(name) for name in shares])

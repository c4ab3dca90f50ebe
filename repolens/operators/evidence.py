"""Ranked unions of evidence about related files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lanes in order of precedence (the first that has a file decides), with the role, certainty and priority of each.
LANES = ["indirect", "direct_caller", "definition", "ripple", "file_impact", "framework_entrypoint", "co_change", "semantic_related"]
GRADES = {
    "definition": ("definition", "certain", 100), "direct_caller": ("direct_caller", "certain", 90), "indirect": ("indirect_dependent", "probable", 70), "ripple": ("ripple", "probable", 60),
    "file_impact": ("file_impact", "probable", 50), "framework_entrypoint": ("framework_entrypoint", "probable", 55), "co_change": ("co_change", "inferred", 40),
    "semantic_related": ("semantic_related", "inferred", 30),
}
STRUCTURAL = ["direct_caller", "indirect_dependent", "ripple", "file_impact"]
FRAMEWORK_LEAST, SEMANTIC_BELOW = 76, 3
# Usages that prove a caller even if only a scan found them; usages by which frameworks wire files; frameworks that wire by name.
PROVING = ["extends_or_implements", "import", "instantiation", "static_call", "type_hint"]
WIRING = ["module_script", "method_call", "reference"]
FRAMEWORKS = ["laravel", "symfony", "nestjs", "express", "node", "spring", "flutter", "reactnative"]
WIRED_CATEGORIES = ["routes", "navigation", "router", "middleware", "controllers"]
WIRED_FOLDERS = ["bootstrap", "config"]
HINT_CHARS, HINT_LEAST, MAX_HINTS, MAX_CANDIDATES = 12_000, 4, 6, 30
SCHEMA = "file string, lane string, role string, certainty string, priority int"


def _grade(role, certainty: str, priority) -> Column:
    return F.struct(
        (role if isinstance(role, Column) else F.lit(role)).alias("role"), F.lit(certainty).alias("certainty"), (priority if isinstance(priority, Column) else F.lit(priority)).cast("int").alias("priority")
    )


def lane_grade(lane: Column) -> Column:
    """struct(role, certainty, priority) of a lane where nothing more is known."""
    out = _grade("other", "inferred", 0)
    for name, grade in GRADES.items():
        out = F.when(lane == name, _grade(*grade)).otherwise(out)
    return out


def caller_grade(strongest: Column, source: Column, category: Column, entry: Column) -> Column:
    """The same for a file that uses the target itself: what proves it counts, not only that it was found.

    Entry points of a framework are wired; calls from a file's top level are callers of their own kind. An edge of the index or a usage that
    needs the name makes a caller certain; what a scan takes for a call is probable, and so is a generic call in a migration.
    """
    generic = strongest.isin("method_call", "reference") & (F.coalesce(category, F.lit("other")) == "migrations")
    proven = ((source == "index") | strongest.isin(PROVING)) & ~generic
    return (
        F.when(entry & strongest.isin(WIRING), _grade("framework_entrypoint", "probable", 82))
        .when(strongest == "module_script", _grade("file_scope_caller", "certain", 80))
        .when(proven, _grade("direct_caller", "certain", 90))
        .otherwise(_grade("direct_caller", "probable", 78))
    )


def indirect_grade(entry: Column) -> Column:
    return F.when(entry, _grade("framework_entrypoint", "probable", 75)).otherwise(_grade(*GRADES["indirect"]))


def impact_grade(entry: Column) -> Column:
    return F.when(entry, _grade(*GRADES["framework_entrypoint"])).otherwise(_grade(*GRADES["file_impact"]))


def hints(target: str, canonical: str | None, callers: list[str]) -> list[str]:
    """What a framework's files would call the target: its file's stem, plain and without role words, its symbol's ends, two callers' stems."""
    stem = lambda path: path.rsplit("/", 1)[-1].split(".", 1)[0]
    own, name = stem(target), canonical or ""
    found = [own, own.replace("Controller", ""), own.replace("Service", ""), name.split(".", 1)[0], name.split(".")[-1], *map(stem, callers[:2])]
    return list(dict.fromkeys(h for h in (w.strip().lower() for w in found) if len(h) >= HINT_LEAST))[:MAX_HINTS]


def wired_files(files: DataFrame, folders: list[str], wanted: list[str], target: str, path: str = "path", text: str = "text", also: Column | None = None) -> DataFrame:
    """(file): of the first files by path in the wiring ``folders``, and of those that ``also`` holds for, the ones whose beginning has a hint."""
    inside = F.lit(False)
    for folder in folders:
        inside = inside | F.col(path).startswith(folder.rstrip("/") + "/")
    some = files.where(inside).orderBy(path).limit(MAX_CANDIDATES).select(path, text)
    if also is not None:
        some = some.unionByName(files.where(also).select(path, text))
    lowered = F.lower(F.substring(F.col(text), 1, HINT_CHARS))
    held = F.lit(False)
    for hint in wanted:
        held = held | F.contains(lowered, F.lit(hint))
    return some.where((F.col(path) != target) & held).select(F.col(path).alias("file")).dropDuplicates()


def related_reasons(lanes: DataFrame, target, limit: int = 10, file: str = "file", lane: str = "lane", grade: Column | None = None, wired: Column | None = None) -> DataFrame:
    """(file, role, certainty, priority, rank): one lane per file, highest priority first, ties by file descending.

    ``grade`` is a struct (role, certainty, priority) of a lane's row. Files that are ``wired`` become entry points of ``FRAMEWORK_LEAST`` or more.
    The semantic lane counts only where fewer than ``SEMANTIC_BELOW`` files are related by structure.
    """
    order = F.lit(len(LANES))
    for i, name in enumerate(LANES):
        order = F.when(F.col(lane) == name, i).otherwise(order)
    graded = lane_grade(F.col(lane)) if grade is None else grade
    known = lanes.where(F.col(file) != target).select(F.col(file).alias("file"), graded.alias("_g"), (F.lit(False) if wired is None else wired).alias("_w"), order.alias("_o"))
    first = Window.partitionBy("file").orderBy("_o", F.desc("_g.priority"))
    one = known.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("file", "_g.role", "_g.certainty", "_g.priority", "_w")
    raised = F.col("_w") & (F.col("role") != "semantic_related")
    one = one.select(
        "file", F.when(raised, "framework_entrypoint").otherwise(F.col("role")).alias("role"), F.when(raised, "probable").otherwise(F.col("certainty")).alias("certainty"),
        F.when(raised, F.greatest("priority", F.lit(FRAMEWORK_LEAST))).otherwise(F.col("priority")).alias("priority"),
    )
    structural = one.where(F.col("role").isin(STRUCTURAL)).agg(F.count(F.lit(1)).alias("_s"))  # one row
    one = one.crossJoin(F.broadcast(structural)).where((F.col("role") != "semantic_related") | (F.col("_s") < SEMANTIC_BELOW)).drop("_s")
    best = [F.desc("priority"), F.desc("file")]
    return one.orderBy(*best).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*best)))


def related_files(parts: list[DataFrame], limit: int, file: str = "file", position: str = "pos") -> DataFrame:
    """(file, rank): files of several ordered lists, list after list, each file at its first place."""
    merged = None
    for i, part in enumerate(parts):
        one = part.select(F.col(file).alias("file"), F.struct(F.lit(i).alias("part"), F.col(position).cast("long").alias("pos")).alias("at"))
        merged = one if merged is None else merged.unionByName(one)
    first = merged.groupBy("file").agg(F.min("at").alias("at")).orderBy("at", "file").limit(limit)
    return first.select("file", F.row_number().over(Window.orderBy("at", "file")).alias("rank"))


def confidence(complete: Column, has_symbol: Column, has_blast: Column, direct: Column, indirect: Column, source_query: Column, indexed: Column, symbol_missing: Column, penalty: Column) -> tuple[Column, Column]:
    """(score between 0 and 1 to two places, level)."""
    gain = lambda c, v: F.when(c, v).otherwise(0.0)
    raw = 0.45 + gain(complete, 0.2) + gain(has_symbol, 0.15) + gain(has_blast, 0.1) + F.least(F.lit(0.08), 0.03 * direct) + F.least(F.lit(0.05), 0.02 * indirect) + gain(source_query, 0.05)
    raw = raw - F.when(indexed, 0.0).otherwise(0.2) - gain(symbol_missing, 0.25) - penalty
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 2)
    return score, F.when(score >= 0.8, "high").when(score >= 0.55, "medium").otherwise("low")

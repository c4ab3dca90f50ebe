"""Who extends, implements or mixes in whom: one expression over a whole text, so that headers may go on over lines; edges are kept by both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions import paths

# How languages write inheritance, by extension. The first group is the child, the second the parents.
NAME = r"[A-Za-z_$][\w$\\.]*"
RULES = [
    ("extends", (".php", ".js", ".jsx", ".mjs", ".ts", ".tsx", ".java", ".dart"), rf"\b(?:class|interface)\s+({NAME})(?:<[^>]*>)?\s+extends\s+({NAME}(?:\s*,\s*{NAME})*)"),
    ("implements", (".php", ".ts", ".tsx", ".java", ".dart"), rf"\bclass\s+({NAME})[^{{;]{{0,400}}?\bimplements\s+({NAME}(?:\s*,\s*{NAME})*)"),
    ("extends", (".py", ".pyw"), r"(?m)^\s*class\s+(\w+)\(([^)]+)\)\s*:"),
    ("extends", (".kt", ".kts", ".cs"), rf"\b(?:class|interface|struct|record|object)\s+({NAME})(?:<[^>]*>)?(?:\([^)]*\))?\s*:\s*({NAME}(?:\([^)]*\))?(?:\s*,\s*{NAME}(?:\([^)]*\))?)*)"),
    ("extends", (".rb",), r"\bclass\s+(\w+)\s*<\s*([\w:]+)"),
]
TRAIT = rf"^\s+use\s+({NAME}(?:\s*,\s*{NAME})*)\s*[;{{]"
# Traits of the framework that say nothing about a class.
COMMON_TRAITS = ["HasFactory", "Notifiable", "SoftDeletes"]
PLAIN_BASES = ["object"]
SUFFIXES = sorted({s for _, suffixes, _ in RULES for s in suffixes})


def _split(parents: Column) -> Column:
    """Parent names without arguments, generics and namespaces."""
    written = F.filter(F.split(parents, ","), lambda p: ~p.contains("="))  # keyword arguments are no parents
    bare = F.transform(written, lambda p: F.regexp_replace(F.trim(p), r"[(<\[].*$", ""))
    return F.filter(F.transform(bare, lambda p: F.element_at(F.split(p, r"[\\.]"), -1)), lambda p: (p != "") & ~p.isin(PLAIN_BASES))


def edges(texts: DataFrame, extension: Column) -> DataFrame:
    """(file, kind, child, parent) of whole texts or of lines (file, text)."""
    found = F.array().cast("array<struct<kind:string,child:string,parents:string>>")
    for kind, suffixes, pattern in RULES:
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("c"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("p"))
        label = F.lit(kind).alias("kind")
        hits = F.transform(pairs, lambda x: F.struct(label, x["c"].alias("child"), x["p"].alias("parents")))  # noqa: B023  the plan is built here
        found = F.concat(found, F.when(extension.isin(list(suffixes)), hits).otherwise(F.array().cast("array<struct<kind:string,child:string,parents:string>>")))
    exploded = texts.select("file", F.explode(found).alias("e"))
    return exploded.select("file", "e.kind", F.element_at(F.split("e.child", r"[\\.]"), -1).alias("child"), F.explode(_split(F.col("e.parents"))).alias("parent")).dropDuplicates()


def traits(lines: DataFrame, classes: DataFrame, extension: Column) -> DataFrame:
    """(file, kind, child, parent) of traits used inside PHP classes (file, child, start, end)."""
    used = lines.where((extension == ".php") & F.col("text").rlike(TRAIT)).select("file", "line", F.explode(_split(F.regexp_extract("text", TRAIT, 1))).alias("parent"))
    inside = used.join(classes.withColumnRenamed("file", "_f"), (F.col("file") == F.col("_f")) & F.col("line").between(F.col("start"), F.col("end")))
    return inside.where(~F.col("parent").isin(COMMON_TRAITS)).select("file", F.lit("mixes_in").alias("kind"), "child", "parent").dropDuplicates()


def by_ends(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(end, direction, name, kind, path): every edge once for its child, as the way to a parent, and once for its parent. ``texts`` has (file, text),
    ``symbols`` the classes that traits may be in."""
    ext = paths.extension(F.col("file"))
    inside = texts.where(ext == ".php").where(F.col("text").rlike("(?m)" + TRAIT))
    lines = inside.select("file", F.posexplode(F.split("text", "\n")).alias("line", "text")).select("file", (F.col("line") + 1).alias("line"), "text")
    classes = symbols.where(F.col("type").isin("class", "trait")).select(F.col("path").alias("file"), F.col("short_name").alias("child"), F.col("line").alias("start"), F.coalesce("end_line", "line").alias("end"))
    found = edges(texts, ext).unionByName(traits(lines, classes, ext)).dropDuplicates()
    end = lambda direction, at, other: F.struct(F.lit(direction).alias("direction"), F.col(at).alias("end"), F.col(other).alias("name"))
    both = found.select(F.explode(F.array(end("parent", "child", "parent"), end("child", "parent", "child"))).alias("e"), "kind", F.col("file").alias("path"))
    return both.select("e.end", "e.direction", "e.name", "kind", "path")


def around(all_edges: DataFrame, name: str) -> DataFrame:
    """(direction, kind, name, file) of the parents and children of one class."""
    up = all_edges.where(F.col("child") == name).select(F.lit("parent").alias("direction"), "kind", F.col("parent").alias("name"), "file")
    down = all_edges.where(F.col("parent") == name).select(F.lit("child").alias("direction"), "kind", F.col("child").alias("name"), "file")
    return up.unionByName(down).dropDuplicates()

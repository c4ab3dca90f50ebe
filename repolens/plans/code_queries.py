"""Usage classification over document lines; parsing and indexing of source files that are made from the tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions.syntax import SYNTAX, classify_usage, usage_sql
from repolens.functions.tokenize import SQL_TOKENS
from repolens.operators import textindex, textsearch
from repolens.plans import index
from repolens.plans.registry import register, tasks_for
from repolens.sources import store, tree

_LINES = "lines AS (SELECT doc_id AS file, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents)"
SYMBOL = "tion"
TASK_FILES = 5_000  #: source files that one task parses


@register("usage_classify", f"WITH {_LINES}, k AS (SELECT file, {usage_sql('trim(t)', SYMBOL, SYNTAX['java'])} AS kind FROM lines) SELECT file, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL")
def usage_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a symbol is used on every line, by file and kind."""
    lines = textsearch.lines_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    kinds = lines.select("file", classify_usage(F.col("text"), SYMBOL, SYNTAX["java"]).alias("kind"))
    return kinds.where("kind IS NOT NULL").groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"))


@register("usage_classify_php", f"WITH {_LINES}, v AS (SELECT file, CASE file % 5 WHEN 0 THEN 'use App\\\\tion; ' WHEN 1 THEN 'new tion ' WHEN 2 THEN '$x->tion ' WHEN 3 THEN 'tion::' ELSE 'class A extends tion ' END || t AS t FROM lines), k AS (SELECT file, {usage_sql('trim(t)', SYMBOL, SYNTAX['php'])} AS kind FROM v) SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL")
def usage_classify_php(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for lines that start like PHP."""
    lines = textsearch.lines_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    k = F.col("file") % 5
    head = F.when(k == 0, "use App\\\\tion; ").when(k == 1, "new tion ").when(k == 2, "$x->tion ").when(k == 3, "tion::").otherwise("class A extends tion ")
    kinds = lines.select(classify_usage(F.concat(head, "text"), SYMBOL, SYNTAX["php"]).alias("kind"))
    return kinds.where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# What each language writes around a symbol; a file's language is its number's.
_AROUND = {
    "php": "$x->{}();", "python": "from app import {}", "javascript": "return new {}(x)", "typescript": "class A implements {} {{", "dart": "{} x = make();", "go": "x := pkg.{}(1)", "rust": "let x = {}::new();",
    "java": "class A extends {} {{", "ruby": "class A < {}",
}
_KIND = "CASE file % 9 " + " ".join(f"WHEN {i} THEN {usage_sql('trim(t)', SYMBOL, SYNTAX[name])}" for i, name in enumerate(_AROUND)) + " END"
_HEAD = "CASE file % 9 " + " ".join(f"WHEN {i} THEN '{line.format(SYMBOL)}'" for i, line in enumerate(_AROUND.values())) + " END"


@register("usage_classify_languages", f"""
WITH {_LINES}, v AS (SELECT file, t FROM lines UNION ALL SELECT doc_id, {_HEAD.replace("file", "doc_id")} FROM documents),
k AS (SELECT file % 9 AS language, {_KIND} AS kind FROM v) SELECT language, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL""")
def usage_classify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages by kind in all nine languages: every line of every document, and a line of each language's own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, line) in enumerate(_AROUND.items()):
        head = F.when(F.col("doc_id") % 9 == i, line.format(SYMBOL)).otherwise(head)
        kind = F.when(F.col("file") % 9 == i, classify_usage(F.col("text"), SYMBOL, SYNTAX[name])).otherwise(kind)
    lines = textsearch.lines_of(docs, "doc_id", "text").select("file", "text").unionByName(docs.select(F.col("doc_id").alias("file"), head.alias("text")))
    return lines.select((F.col("file") % 9).alias("language"), kind.alias("kind")).where("kind IS NOT NULL").groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each part as a source file with one function, Python or Go by its key, which calls the parts on the lines after its own."""
    line = lambda k: spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_linenumber") - k).alias("n"), F.col("l_partkey").alias(f"part{k}"))
    calls = line(0).join(line(1), ["l_orderkey", "n"]).where("part0 <> part1").groupBy("part0").agg(F.array_sort(F.collect_set("part1")).alias("calls"))  # a part is on few lines
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k")).join(calls, F.col("k") == F.col("part0"), "left")
    body = lambda indent: F.array_join(F.transform(F.coalesce("calls", F.array().cast("array<bigint>")), lambda c: F.format_string(f"{indent}part_%d(x)\n", c)), "")
    python = F.concat(F.format_string("def part_%d(x):\n", "k"), body("    "), F.lit("    return x\n"))
    go = F.concat(F.format_string("package parts\n\nfunc part_%d(x int) int {\n", "k"), body("\t"), F.lit("\treturn x\n}\n"))
    odd = F.col("k") % 2 == 1
    path = F.format_string("parts/%d/part_%d.%s", F.floor(F.col("k") / 1000), F.col("k"), F.when(odd, "go").otherwise("py"))
    return part.select(path.alias("path"), F.when(odd, go).otherwise(python).cast("binary").alias("content"))


# What those files hold: symbols with their places, and who calls them.
_SYMBOLS = """
e AS (
  SELECT DISTINCT a.l_partkey AS caller, b.l_partkey AS called FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
n AS (SELECT caller AS k, count(*) AS calls FROM e GROUP BY caller),
s AS (
  SELECT p_partkey AS k, 'parts/' || p_partkey // 1000 || '/part_' || p_partkey || CASE WHEN p_partkey % 2 = 1 THEN '.go' ELSE '.py' END AS path, 'part_' || p_partkey AS short_name, 'function' AS type,
    CASE WHEN p_partkey % 2 = 1 THEN 3 ELSE 1 END::INTEGER AS line, CASE WHEN p_partkey % 2 = 0 THEN coalesce(calls, 0) + 2 END::INTEGER AS end_line,
    CASE WHEN p_partkey % 2 = 1 THEN 'func part_' || p_partkey || '(x int) int' ELSE 'def part_' || p_partkey || '(x):' END AS signature FROM part LEFT JOIN n ON k = p_partkey),
r AS (SELECT o.path AS origin, o.short_name AS symbol, c.path AS file, c.short_name AS caller, c.line, 'method_call' AS kind FROM e JOIN s o ON o.k = e.called JOIN s c ON c.k = e.caller)"""


def _built(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of those files. Several of them are asked for by one query, so what the parsers found is kept on the executors' disks: a file is parsed once."""
    files = max(spark.sparkContext.defaultParallelism, tasks_for(spark, spark.read.parquet(f"{sf_dir}/part.parquet").count(), TASK_FILES))
    parsed = tree.parse_files(_sources(spark, sf_dir).repartition(files)).persist(StorageLevel.DISK_ONLY)
    parsed.count()  # before the tables ask for it at once, each in a stage of its own
    return index.build(parsed)


@register("parse_symbols", f"""
WITH {_SYMBOLS}, callers AS (SELECT origin, list_sort(list(file || '::' || caller)) AS called_by FROM r GROUP BY origin)
SELECT path || '::' || short_name AS symbol_id, path, short_name, type, line, end_line, signature, coalesce(called_by, []) AS called_by FROM s LEFT JOIN callers ON origin = path""")
def parse_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of the parts' source files, with their callers."""
    tables = _built(spark, sf_dir)
    return index.with_callers(tables, tables["symbols"]).select("symbol_id", "path", "short_name", "type", "line", "end_line", "signature", "called_by")


@register("index_references", f"WITH {_SYMBOLS} SELECT * FROM r")
def index_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their call graph."""
    return index.edges(_built(spark, sf_dir))


@register("index_usages", f"WITH {_SYMBOLS} SELECT file, caller, line, kind, count(*)::BIGINT AS times FROM r WHERE origin LIKE '%.py' GROUP BY ALL")
def index_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls any part in Python, and how many of these."""
    tables = _built(spark, sf_dir)
    return index.usages(tables, tables["symbols"].where(F.col("path").endswith(".py")))


_FIELD = {c: SQL_TOKENS.format(text=c) for c in ("short_name", "signature", "path")}


@register("index_postings", f"""
WITH {_SYMBOLS}, t AS (SELECT path || '::' || short_name AS symbol_id, unnest(list_concat(list_concat({_FIELD['short_name']}, {_FIELD['short_name']}),
  list_concat({_FIELD['signature']}, list_filter({_FIELD['path']}, lambda x, i: i % 2 = 1)))) AS term FROM s)
SELECT symbol_id, term, count(*) AS tf FROM t GROUP BY ALL""")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their inverted index."""
    return _built(spark, sf_dir)["search_postings"].select("symbol_id", "term", "tf")


@register("index_metadata", f"""
WITH {_SYMBOLS} SELECT count(*) AS indexed_files, list_sort(list(DISTINCT CASE WHEN path LIKE '%.go' THEN 'go' ELSE 'python' END)) AS languages, count(*) AS special_files,
  ['function=' || count(*)] AS symbol_types, count(*) AS total_symbols, {store.SCHEMA_VERSION}::INTEGER AS schema_version, 0::BIGINT AS fallback_files FROM s""")
def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their totals."""
    kinds = F.array_sort(F.transform(F.map_entries("symbol_types"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return index.metadata(_built(spark, sf_dir)).withColumn("symbol_types", kinds)


@register("trigram_candidates", """
SELECT doc_id::VARCHAR AS path FROM documents WHERE contains(lower(coalesce(text, '')), 'ationth') OR contains(lower(coalesce(text, '')), '@mail')""")
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold one of two literals: those that meet the trigram condition of the expression, verified."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    n = docs.count()
    found = textindex.gram_index(textindex.by_block(docs, n), n).persist()  # both tables come from one pass
    some = textindex.candidates(found.where("gram IS NOT NULL"), found.where("path IS NOT NULL").select("block", "number", "path"), textindex.regex_condition("ationth|@mail", False))
    text = F.lower(F.col("content").cast("string"))
    return docs.join(some, "path", "left_semi").where(text.contains("ationth") | text.contains("@mail")).select("path")

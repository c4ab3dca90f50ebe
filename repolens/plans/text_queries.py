"""Line search, paths and excerpts over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions import names, paths
from repolens.operators import project, textsearch
from repolens.plans.registry import register

_LINES = """lines AS (SELECT doc_id AS file, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""
REGEX = r"(tion|ment)\s[a-z]+ing"
FOLDERS = {"english": "en", "german": "de", "french": "fr", "spanish": "es"}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.lines_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1).alias("path"))


_PATHS = "paths AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS path FROM pages)"


@register("search_literal", f"WITH {_LINES} SELECT file, line, text FROM lines WHERE contains(text, 'tionha')")
def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a string."""
    return textsearch.search(_lines(spark, sf_dir), "tionha")


@register("search_ignore_case", f"WITH {_LINES} SELECT file, line, text FROM lines WHERE contains(lower(text), 'tionha')")
def search_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, whatever the case."""
    return textsearch.search(_lines(spark, sf_dir), "TionHa", case_sensitive=False)


@register("search_regex", rf"WITH {_LINES} SELECT file, line, text FROM lines WHERE regexp_matches(text, '(tion|ment)\s[a-z]+ing')")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match an expression."""
    return textsearch.search(_lines(spark, sf_dir), REGEX, regex=True)


@register("search_fuzzy", rf"WITH {_LINES} SELECT file, line, text FROM lines WHERE regexp_matches(text, '\bthere\b|there\b')")
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word or the end of one."""
    return textsearch.search(_lines(spark, sf_dir), "there", fuzzy=True)


@register("search_context", f"""
WITH {_LINES}, h AS (SELECT *, contains(text, 'tionha') AS is_hit FROM lines)
SELECT file, line, text, is_hit FROM h QUALIFY max(is_hit) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with two lines around."""
    return textsearch.with_context(_lines(spark, sf_dir), textsearch.matcher(F.col("text"), "tionha"), 2)


@register("search_page", f"""
WITH {_LINES} SELECT file, line, text, CAST(row_number() OVER (ORDER BY file, line) - 1 AS INTEGER) AS place FROM lines WHERE contains(text, 'tion')
QUALIFY place >= 20 AND place < 45""")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of hits."""
    return textsearch.page(textsearch.search(_lines(spark, sf_dir), "tion"), 20, 25)


@register("find_files_glob", rf"""
WITH {_PATHS}, t AS (SELECT page_id, path, CASE WHEN regexp_matches(path, '^[^/]*7\.html$') OR regexp_matches(path, '^.*/[^/]*7\.html$') THEN 0 END AS tier FROM paths)
SELECT page_id, path, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def find_files_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiered file search by a glob."""
    tiered = _paths(spark, sf_dir).withColumn("tier", paths.match_tier(F.col("path"), "*7.html"))
    return project.best_tier(tiered, "tier")


@register("find_files_folded", rf"""
WITH {_PATHS}, t AS (SELECT page_id, upper(path) AS path, CASE WHEN regexp_matches(path, '^.*/[^/]*7\.html$') THEN 2 END AS tier FROM paths)
SELECT page_id, path, tier FROM t WHERE tier = 2""")
def find_files_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glob that only matches when case is ignored."""
    tiered = _paths(spark, sf_dir).select("page_id", F.upper("path").alias("path")).withColumn("tier", paths.match_tier(F.col("path"), "*7.html"))
    return project.best_tier(tiered, "tier")


_CATEGORY = "CASE " + " ".join(f"WHEN starts_with(path, '{d}/') THEN '{c}'" for c, d in FOLDERS.items()) + " END"


@register("categorize_path", f"WITH {_PATHS} SELECT page_id, {_CATEGORY} AS category FROM paths")
def categorize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of every path, the first folder that holds it."""
    return _paths(spark, sf_dir).select("page_id", paths.category(F.col("path"), FOLDERS).alias("category"))


_VARIED = """v AS (SELECT page_id, ['tests/', 'src/a/test/', 'docs/', 'Examples/', 'evals/fixtures/', '', './src/', 'config/', 'app/routes/'][page_id % 9 + 1] || path AS path FROM paths)"""


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ["tests/", "src/a/test/", "docs/", "Examples/", "evals/fixtures/", "", "./src/", "config/", "app/routes/"]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("page_id") % 9 + 1).cast("int"))
    return _paths(spark, sf_dir).select("page_id", F.concat(head, "path").alias("path"))


@register("path_role", f"""WITH {_PATHS}, {_VARIED} SELECT page_id, path, CASE WHEN regexp_matches('/' || lower(path), '/(tests|test|__tests__)/') THEN 'test'
WHEN regexp_matches(lower(path), '^(evals/fixtures|fixtures)/') THEN 'fixture' WHEN regexp_matches(lower(path), '^(examples|example|samples|sample)/') THEN 'example'
WHEN regexp_matches(lower(path), '^(docs|doc)/') THEN 'docs' ELSE 'source' END AS role FROM v""")
def path_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, test, fixture, example or docs."""
    return _varied(spark, sf_dir).select("page_id", "path", paths.path_role(F.col("path")).alias("role"))


@register("framework_role", f"""WITH {_PATHS}, {_VARIED} SELECT page_id, CASE WHEN regexp_matches(path, '^(bootstrap|config)/')
OR regexp_matches(path, '/(routes|router|navigation|middleware|bootstrap|config)/') THEN 'framework_entrypoint' END AS role FROM v""")
def framework_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framework entry points among the paths."""
    return _varied(spark, sf_dir).select("page_id", paths.framework_role(F.col("path"), F.lit(None).cast("string")).alias("role"))


@register("path_filter", rf"""WITH {_PATHS}, v AS (SELECT page_id, ['node_modules/', '.git/', 'src/', '', '.env/', 'a/.hidden/'][page_id % 6 + 1] || path || ['.py', '.log', '', '.PY', '.bak'][page_id % 5 + 1] AS path FROM paths)
SELECT page_id, path FROM v WHERE NOT regexp_matches(path, '(^|/)(node_modules|\.git|\.hidden)/') AND regexp_matches(lower(path), '[^/]\.(py|html)$')""")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a scan accepts."""
    heads, tails = ["node_modules/", ".git/", "src/", "", ".env/", "a/.hidden/"], [".py", ".log", "", ".PY", ".bak"]
    pick = lambda some, n: F.element_at(F.array(*[F.lit(h) for h in some]), (F.col("page_id") % n + 1).cast("int"))
    v = _paths(spark, sf_dir).select("page_id", F.concat(pick(heads, 6), "path", pick(tails, 5)).alias("path"))
    return v.where(paths.accepted(F.col("path")))


@register("edit_region", f"WITH {_LINES} SELECT file, line, printf('%4d | %s', line, text) AS shown, line BETWEEN 6 AND 8 AS inside FROM lines WHERE line BETWEEN 4 AND 10")
def edit_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 6 to 8 of every document with two around."""
    return textsearch.edit_region(_lines(spark, sf_dir), 6, 8, 2)


@register("symbol_body", f"""WITH {_LINES} SELECT file, 'body' AS symbol, string_agg(text, chr(10) ORDER BY line) AS body, 200 - 3 + 1 > 150 AS truncated FROM lines
WHERE line BETWEEN 3 AND 152 GROUP BY file""")
def symbol_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 of lines 3 to 200 of every document."""
    symbols = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file"), F.lit("body").alias("symbol"), F.lit(3).alias("start"), F.lit(200).alias("end"))
    return textsearch.symbol_body(_lines(spark, sf_dir), symbols).select("file", "symbol", "body", "truncated")


_BLANK = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"  #: white space of any script, for an engine that only knows ASCII's
_WORDLY = r"\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"


@register("clean_names", rf"""
WITH w AS (SELECT DISTINCT unnest(list_concat(string_split(text, ' '), [source || '.' || lang, lang || chr(160) || 'x', 'na' || chr(239) || 've', chr(233) || 't' || chr(233)])) AS name FROM documents)
SELECT name, regexp_matches(name, '^[a-zA-Z_$][{_WORDLY}$]*(\.[a-zA-Z_$][{_WORDLY}$]*)*$') AS is_identifier FROM w
WHERE length(name) BETWEEN 1 AND 128 AND NOT regexp_matches(name, '[{_BLANK}(){{}}\[\]";,`'']')""")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of any script that the index keeps, and which of them summaries show."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = F.array(F.concat_ws(".", "source", "lang"), F.concat("lang", F.lit("\u00a0x")), F.lit("na\u00efve"), F.lit("\u00e9t\u00e9"))
    words = docs.select(F.explode(F.concat(F.split("text", " "), odd)).alias("name")).dropDuplicates()
    return words.where(names.is_clean(F.col("name"))).select("name", names.is_identifier(F.col("name")).alias("is_identifier"))


@register("qualified_names", rf"WITH {_PATHS} SELECT page_id, replace(regexp_replace(path, '\.[^./]+$', ''), '/', '.') || '.ns.f' AS qualified FROM paths WHERE NOT ends_with(path, '/')")
def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names of a function in every path."""
    return _paths(spark, sf_dir).where(~F.col("path").endswith("/")).select("page_id", names.qualified(F.col("path"), F.lit("f"), F.lit("ns")).alias("qualified"))


@register("file_stats", """
SELECT doc_id, strlen(text) AS length, CASE WHEN strlen(text) < 1024 THEN 'tiny' WHEN strlen(text) < 10240 THEN 'small' WHEN strlen(text) < 102400 THEN 'medium' WHEN strlen(text) < 1048576 THEN 'large' ELSE 'huge' END AS size_class,
  NOT contains(text, chr(0)) AS is_text, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END::INTEGER AS line_count FROM documents""")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, size class and lines of every document, as of a file."""
    from repolens.sources import files

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return files.stats(docs).select(F.col("path").cast("long").alias("doc_id"), F.col("length").cast("long").alias("length"), "size_class", "is_text", "line_count")

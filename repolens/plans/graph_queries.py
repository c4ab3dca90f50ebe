"""Co-change, call-graph, risk and evidence queries over the star schema and the pages.

Orders stand for commits or files, parts for files or symbols, a part's orders for its callers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.functions import names, risk
from repolens.operators import cochange, evidence, graph, project
from repolens.plans.registry import register, tasks_for

TARGET = 7  #: a part or a file that always exists
TASK_ROWS = 250_000  #: of lines that one task pairs or dedups
_R = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _R(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = _R(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    tasks = tasks_for(spark, lines.count(), TASK_ROWS)
    changes = lines.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    newest_first = F.struct(-F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey"))
    return cochange.cochange_pairs(changes.withColumn("pos", newest_first), "l_orderkey", "l_partkey", "pos", "o_orderdate", tasks=tasks)


_PAIRS = """
b AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS f FROM lineitem),
s AS (SELECT k FROM b GROUP BY k HAVING count(*) BETWEEN 2 AND 30),
p AS (
  SELECT x.f AS file_a, y.f AS file_b, count(*) AS count, arg_min(o_orderdate, (-epoch_us(o_orderdate), o_orderkey)) AS last_seen
  FROM b x JOIN b y ON x.k = y.k AND x.f < y.f JOIN s ON s.k = x.k JOIN orders ON o_orderkey = x.k GROUP BY ALL)"""


@register("cochange_pairs", f"WITH {_PAIRS} SELECT * FROM p")
def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are ordered together."""
    return _pairs(spark, sf_dir)


_PEERS = f"""t AS (SELECT CASE WHEN file_a = {TARGET} THEN file_b ELSE file_a END AS peer, count, last_seen FROM p WHERE {TARGET} IN (file_a, file_b)
  ORDER BY count DESC, last_seen DESC, peer LIMIT 7)"""


@register("cochange_peers", f"WITH {_PAIRS}, {_PEERS} SELECT * FROM t")
def cochange_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts most often ordered with one part."""
    return cochange.peers(_pairs(spark, sf_dir), TARGET)


@register("cochange_risk", f"WITH {_PAIRS}, {_PEERS} SELECT coalesce(sum((count >= 2)::BIGINT), 0)::BIGINT AS strong, coalesce(max(count), 0)::BIGINT AS max_count, strong >= 5 OR max_count >= 4 AS fires FROM t")
def cochange_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether those are enough for a warning."""
    return cochange.risk_gate(cochange.peers(_pairs(spark, sf_dir), TARGET))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _R(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"))


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hosts = _hosts(spark, sf_dir)
    symbols = hosts.select(F.concat_ws("::", F.col("page_id").cast("string"), "host").alias("symbol_id"), F.col("host").alias("short_name"))
    called = F.when(F.col("page_id") % 3 == 0, F.concat_ws("::", F.col("page_id").cast("string"), "host")).when(F.col("page_id") % 3 == 1, F.col("host")).otherwise(F.expr("substring_index(host, '.', -3)"))
    return hosts.select(F.col("page_id").alias("caller"), called.alias("called")), symbols


_CALLS = r"""
h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages),
sym AS (SELECT page_id::VARCHAR || '::' || host AS symbol_id, host AS short FROM h),
c AS (SELECT page_id AS caller, CASE page_id % 3 WHEN 0 THEN page_id::VARCHAR || '::' || host WHEN 1 THEN host
  ELSE array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 2), len(string_split(host, '.'))), '.') END AS called FROM h),
x AS (
  SELECT DISTINCT caller, called, symbol_id, CASE WHEN called = symbol_id THEN 0 WHEN called = short THEN 1 ELSE 2 END AS tier FROM c JOIN sym
  ON called = symbol_id OR called = short OR ends_with(short, '.' || called)),
r AS (SELECT * FROM x QUALIFY tier = min(tier) OVER (PARTITION BY called))"""


@register("resolve_calls", f"WITH {_CALLS} SELECT * FROM r")
def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by id, by name or by dotted suffix, hosts as symbols."""
    calls, symbols = _calls(spark, sf_dir)
    return graph.resolve_calls(calls, symbols, "caller", "called", "symbol_id", "short_name")


@register("resolve_calls_unique", f"WITH {_CALLS} SELECT * FROM r QUALIFY count(DISTINCT symbol_id) OVER (PARTITION BY called) = 1")
def resolve_calls_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, ambiguous names left out."""
    calls, symbols = _calls(spark, sf_dir)
    return graph.resolve_calls(calls, symbols, "caller", "called", "symbol_id", "short_name", unique_only=True)


@register("callee_match", "WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages) SELECT page_id, host FROM h WHERE host = 'example.net' OR ends_with(host, '.example.net')")
def callee_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that an owner-qualified name means."""
    return graph.callee_match(_hosts(spark, sf_dir), "net", "host", owner="example")


def _refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders call parts; both are symbols with a path and a line."""
    lines = _R(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("caller_symbol_id"), F.concat(F.lit("p"), "l_partkey").alias("called_symbol_id")).dropDuplicates()
    orders = _R(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("symbol_id"), F.concat(F.lit("c"), "o_custkey").alias("path"), F.col("o_orderpriority").alias("short_name"), (F.col("o_orderkey") % 100).cast("int").alias("line"))
    parts = _R(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("symbol_id"), F.col("p_brand").alias("path"), F.col("p_name").alias("short_name"), F.col("p_size").alias("line"))
    return lines, orders.unionByName(parts)


@register("find_callers", """
WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT 'o' || l_orderkey AS caller_symbol_id, 'p' || l_partkey AS called_symbol_id, 'c' || o_custkey AS caller_path, o_orderpriority AS caller_short_name,
  (o_orderkey % 100)::INTEGER AS caller_line, p_brand AS called_path, p_name AS called_short_name, p_size AS called_line
FROM e JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""")
def find_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of all parts with both ends' places."""
    refs, symbols = _refs(spark, sf_dir)
    return graph.callers_of(refs, symbols, symbols.where("symbol_id LIKE 'p%'"))


_KINDS = ["method_call", "reference", "import", "instantiation", "type_hint", "static_call", "extends_or_implements"]
_CATS = ["routes", "controllers", "models", "services", "tests", "other", "views", "middleware", "migrations"]
_KIND_SQL = "['method_call', 'reference', 'import', 'instantiation', 'type_hint', 'static_call', 'extends_or_implements'][l_linenumber % 7 + 1]"
_CAT_SQL = "['routes', 'controllers', 'models', 'services', 'tests', 'other', 'views', 'middleware', 'migrations'][l_suppkey % 9 + 1]"
_USE = f"""u AS (SELECT l_partkey AS origin, l_suppkey % 5 AS sym, CASE WHEN l_suppkey % 11 = 0 THEN 'auth/' ELSE 'app/' END || l_suppkey AS file, l_orderkey AS line,
  {_KIND_SQL} AS kind, {_CAT_SQL} AS category FROM lineitem)"""


def _usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages of parts (symbols) by suppliers (files)."""
    pick = lambda some, c: F.element_at(F.array(*[F.lit(s) for s in some]), (F.col(c) % len(some) + 1).cast("int"))
    file = F.concat(F.when(F.col("l_suppkey") % 11 == 0, "auth/").otherwise("app/"), F.col("l_suppkey"))
    lines = _R(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_partkey").alias("origin"), (F.col("l_suppkey") % 5).alias("sym"), file.alias("file"), F.col("l_orderkey").alias("line"), pick(_KINDS, "l_linenumber").alias("kind"), pick(_CATS, "l_suppkey").alias("category"))


@register("usages_by_file", f"WITH {_USE} SELECT file, count(*) AS count, list_transform(list_sort(list((line, kind))), lambda x: x[1] || ':' || x[2]) AS usages FROM u WHERE origin = {TARGET} GROUP BY file")
def usages_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol's usages, file by file."""
    grouped = graph.usages_by_file(_usages(spark, sf_dir).where(F.col("origin") == TARGET), "file", "line", "kind")
    return grouped.select("file", "count", F.transform("usages", lambda x: F.concat_ws(":", x["line"].cast("string"), x["type"])).alias("usages"))


_RISK = f"""
w AS (SELECT origin, file, category, count(*) AS count, sum({risk.case_sql('kind', risk.USAGE_WEIGHTS)})::BIGINT AS us FROM u GROUP BY ALL),
k AS (SELECT origin, file, category, count, ((10000 + least(10, count) * 3500 + us * 20) * ({risk.case_sql('category', risk.CATEGORY_WEIGHTS)}) * 125
  * CASE WHEN contains(file, 'auth') THEN 14 ELSE 10 END + 500000)::BIGINT // 1000000 AS score FROM w),
g AS (SELECT origin, ((sum(score)::BIGINT + 5) // 10)::DOUBLE / 100 AS risk_score, count(*) AS files, sum(count)::BIGINT AS usages, sum((score >= 6000)::BIGINT)::BIGINT AS high_risk_files FROM k GROUP BY origin)"""


@register("weighted_risk", f"WITH {_USE}, {_RISK} SELECT *, {risk.level_sql('risk_score', risk.RISK_LEVELS)} AS risk_level FROM g")
def weighted_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted risk of a signature change, for every symbol."""
    scored = graph.weighted_risk(_usages(spark, sf_dir), ["origin"], "file", "kind", "category", "signature_change")
    return graph.risk_summary(scored, ["origin"])


@register("blast_radius", f"""WITH {_USE}, {_RISK}, c AS (SELECT origin, count(DISTINCT category) AS n FROM k GROUP BY origin), b AS (SELECT g.origin, (round(risk_score * 100)::BIGINT + (files // 2) * 90 + n * 50)::DOUBLE / 100 AS score
  FROM g JOIN c USING (origin)) SELECT origin, score, {risk.level_sql('score', risk.BLAST_LEVELS)} AS level FROM b""")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blast radius of every symbol; half of its files stand for indirect ones."""
    scored = graph.weighted_risk(_usages(spark, sf_dir), ["origin"], "file", "kind", "category", "signature_change")
    totals = scored.groupBy("origin").agg(graph.hundredths(F.sum("score")).alias("r"), F.count(F.lit(1)).alias("files"), F.countDistinct("category").alias("n"))
    score, level = graph.blast_radius(F.col("r"), F.floor(F.col("files") / 2), F.col("n"))
    return totals.select("origin", score.alias("score"), level.alias("level"))


@register("direct_callers", f"""
WITH {_USE}, w AS (SELECT *, ({risk.case_sql('kind', risk.USAGE_WEIGHTS)})::DOUBLE AS wt FROM u WHERE origin = {TARGET}),
f AS (SELECT file, first(category) AS category, count(*) AS count, max(wt) AS mw, arg_min(kind, (-wt, kind)) AS strongest_usage, array_to_string(list_sort(list(DISTINCT kind)), ',') AS usage_types FROM w GROUP BY file)
SELECT file, category, count, strongest_usage, usage_types, CAST(row_number() OVER (ORDER BY {risk.case_sql('category', risk.CATEGORY_WEIGHTS)} DESC, mw DESC, count DESC, file) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""")
def direct_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest ten files that use one symbol."""
    found = graph.direct_callers(_usages(spark, sf_dir).where(F.col("origin") == TARGET), "file", "line", "kind", "category")
    return found.select("file", "category", "count", "strongest_usage", F.array_join("usage_types", ",").alias("usage_types"), "rank")


_FILES = """e AS (SELECT l_partkey AS origin, l_linenumber AS symbol, l_orderkey AS file FROM lineitem),
i AS (SELECT origin, symbol, count(DISTINCT file) AS referenced_in, count(*) AS total_usages, list_slice(list_sort(list(DISTINCT file)), 1, 10) AS files FROM e WHERE origin <> file GROUP BY ALL)"""


def _file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _R(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("origin"), F.col("l_linenumber").alias("symbol"), F.col("l_orderkey").alias("file"))


@register("impact", f"WITH {_FILES} SELECT origin, symbol, referenced_in, total_usages, files FROM i")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file's symbols reach in other files."""
    return graph.impact(_file_edges(spark, sf_dir), "origin", "symbol", "file")


@register("affected_files", "SELECT l_partkey AS origin, count(DISTINCT l_orderkey) AS affected, CASE WHEN affected <= 3 THEN 'low' WHEN affected <= 8 THEN 'medium' WHEN affected <= 15 THEN 'high' ELSE 'critical' END AS risk FROM lineitem WHERE l_partkey <> l_orderkey GROUP BY origin")
def affected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct files that a file's change affects, with the level of their count."""
    return graph.affected(_file_edges(spark, sf_dir), "origin", "file")


@register("ripple", f"""WITH {_USE}, f AS (SELECT file, category, count(*) AS n FROM u WHERE origin = {TARGET} GROUP BY ALL)
SELECT category, count(*) AS files, sum(n)::BIGINT AS usages, list_sort(list(file)) AS names FROM f GROUP BY category""")
def ripple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol's external usages by category."""
    return graph.ripple(_usages(spark, sf_dir).where(F.col("origin") == TARGET), "file", "line", "kind", "category").drop("examples")


_DIRECT = f"""d AS (SELECT file AS via FROM e WHERE origin = {TARGET} AND file <> {TARGET} GROUP BY file ORDER BY count(*) DESC, file LIMIT 6)"""


@register("indirect_dependents", f"""
WITH {_FILES}, {_DIRECT}, r AS (SELECT via, symbol, unnest(files) AS file FROM i JOIN d ON origin = via)
SELECT file, list_slice(list_sort(list(DISTINCT via)), 1, 3) AS via, list_slice(list_sort(list(DISTINCT symbol)), 1, 5) AS symbols, count(DISTINCT via)::INTEGER AS count
FROM r WHERE file <> {TARGET} AND file NOT IN (SELECT via FROM d) GROUP BY file""")
def indirect_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files two steps from one file."""
    edges = _file_edges(spark, sf_dir)
    direct = edges.where((F.col("origin") == TARGET) & (F.col("file") != TARGET)).groupBy("file").count().orderBy(F.desc("count"), "file").limit(graph.MAX_EXPANDED)
    return graph.indirect_dependents(direct, graph.impact(edges, "origin", "symbol", "file"), TARGET)


_LANES = ["definition", "direct_caller", "indirect", "ripple", "file_impact", "framework_entrypoint", "co_change", "semantic_related"]
_LANE_SQL = "['definition', 'direct_caller', 'indirect', 'ripple', 'file_impact', 'framework_entrypoint', 'co_change', 'semantic_related'][l_linenumber % 8 + 1]"
_ORDER_SQL = "list_position(['indirect', 'direct_caller', 'definition', 'ripple', 'file_impact', 'framework_entrypoint', 'co_change', 'semantic_related'], lane)"


@register("related_reasons", f"""
WITH l AS (SELECT l_suppkey AS file, {_LANE_SQL} AS lane FROM lineitem),
o AS (SELECT file, lane AS role FROM l WHERE file <> 3 QUALIFY row_number() OVER (PARTITION BY file ORDER BY {_ORDER_SQL}) = 1),
g AS (SELECT file, role = 'semantic_related' AS weak, file % 4 = 0 AND role <> 'semantic_related' AS wired, CASE role WHEN 'indirect' THEN 'indirect_dependent' ELSE role END AS lane,
  CASE role WHEN 'definition' THEN 100 WHEN 'direct_caller' THEN 90 WHEN 'indirect' THEN 70 WHEN 'ripple' THEN 60 WHEN 'file_impact' THEN 50 WHEN 'framework_entrypoint' THEN 55 WHEN 'co_change' THEN 40 ELSE 30 END AS base FROM o),
w AS (SELECT file, weak, CASE WHEN wired THEN 'framework_entrypoint' ELSE lane END AS role, CASE WHEN wired THEN 'probable' WHEN lane IN ('definition', 'direct_caller') THEN 'certain'
  WHEN lane IN ('indirect_dependent', 'ripple', 'file_impact', 'framework_entrypoint') THEN 'probable' ELSE 'inferred' END AS certainty, (CASE WHEN wired THEN greatest(base, 76) ELSE base END)::INTEGER AS priority FROM g),
p AS (SELECT file, role, certainty, priority FROM w WHERE NOT weak OR (SELECT count(*) FROM w WHERE role IN ('direct_caller', 'indirect_dependent', 'ripple', 'file_impact')) < 3)
SELECT *, CAST(row_number() OVER (ORDER BY priority DESC, file DESC) AS INTEGER) AS rank FROM p QUALIFY rank <= 40""")
def related_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of evidence lanes, one reason per file."""
    lane = F.element_at(F.array(*[F.lit(x) for x in _LANES]), (F.col("l_linenumber") % 8 + 1).cast("int"))
    lanes = _R(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), lane.alias("lane"))
    return evidence.related_reasons(lanes, 3, limit=40, wired=F.col("file") % 4 == 0)


_SOURCE_SQL = "CASE WHEN l_partkey % 2 = 0 THEN 'index' ELSE 'scan' END"
_STRONGEST_SQL = "['method_call', 'reference', 'import', 'instantiation', 'type_hint', 'static_call', 'extends_or_implements', 'module_script'][l_linenumber % 8 + 1]"


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda some, c: F.element_at(F.array(*[F.lit(s) for s in some]), (F.col(c) % len(some) + 1).cast("int"))
    return _R(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pick([*_KINDS, "module_script"], "l_linenumber").alias("kind"), pick(_CATS, "l_suppkey").alias("category"),
        F.when(F.col("l_partkey") % 2 == 0, "index").otherwise("scan").alias("source"),
    )


@register("caller_grades", f"""
WITH u AS (SELECT l_orderkey, l_linenumber, {_STRONGEST_SQL} AS kind, {_CAT_SQL} AS category, {_SOURCE_SQL} AS source FROM lineitem),
g AS (SELECT *, category IN ('routes', 'middleware') AND kind IN ('module_script', 'method_call', 'reference') AS wired, category = 'migrations' AND kind IN ('method_call', 'reference') AS vague,
  source = 'index' OR kind NOT IN ('module_script', 'method_call', 'reference') AS proof FROM u)
SELECT l_orderkey, l_linenumber, CASE WHEN wired THEN 'framework_entrypoint' WHEN kind = 'module_script' THEN 'file_scope_caller' ELSE 'direct_caller' END AS role,
  CASE WHEN wired THEN 'probable' WHEN kind = 'module_script' OR (proof AND NOT vague) THEN 'certain' ELSE 'probable' END AS certainty,
  (CASE WHEN wired THEN 82 WHEN kind = 'module_script' THEN 80 WHEN proof AND NOT vague THEN 90 ELSE 78 END)::INTEGER AS priority FROM g""")
def caller_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How certain a caller is by its usage, its source of evidence and its category."""
    grade = evidence.caller_grade(F.col("kind"), F.col("source"), F.col("category"), F.col("category").isin("routes", "middleware"))
    return _graded(spark, sf_dir).select("l_orderkey", "l_linenumber", grade.alias("g")).select("l_orderkey", "l_linenumber", "g.*")


_NAME_SQL = "['index', 'total', 'Up', 'save', 'show'][l_partkey % 5 + 1]"
_FOLDER_SQL = "['app/', 'migrations/', 'config/', 'database/migrations/', 'bootstrap/', 'src/config/'][l_orderkey % 6 + 1]"


@register("usage_guards", f"""
WITH u AS (SELECT l_orderkey, l_linenumber, {_NAME_SQL} AS symbol, {_KIND_SQL} AS kind, {_CAT_SQL} AS category, CASE WHEN l_suppkey % 2 = 0 THEN 'index' ELSE 'scan' END AS source, {_FOLDER_SQL} || 'f.php' AS file FROM lineitem),
g AS (SELECT *, lower(symbol) IN ('index', 'up', 'show') AS vague, kind IN ('method_call', 'reference') AS generic, starts_with(file, 'migrations/') OR starts_with(file, 'database/migrations/') AS migration FROM u),
s AS (SELECT *, category = 'migrations' AND generic AS scoped_out, CASE WHEN source = 'index' THEN category = 'migrations' OR migration END AS index_out,
  (kind = 'reference' AND category IN ('tests', 'docs', 'views')) OR (generic AND (migration OR starts_with(file, 'bootstrap/') OR starts_with(file, 'config/'))) AS open_out FROM g)
SELECT l_orderkey, l_linenumber, NOT (vague AND coalesce(index_out, scoped_out OR open_out)) AS open, NOT (vague AND coalesce(index_out, scoped_out)) AS scoped FROM s""")
def usage_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which usages of names that many things have are trusted, in an open search and in one scoped by an owner."""
    pick = lambda some, c: F.element_at(F.array(*[F.lit(s) for s in some]), (F.col(c) % len(some) + 1).cast("int"))
    rows = _R(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", pick(["index", "total", "Up", "save", "show"], "l_partkey").alias("symbol"), pick(_KINDS, "l_linenumber").alias("kind"), pick(_CATS, "l_suppkey").alias("category"),
        F.when(F.col("l_suppkey") % 2 == 0, "index").otherwise("scan").alias("source"),
        F.concat(pick(["app/", "migrations/", "config/", "database/migrations/", "bootstrap/", "src/config/"], "l_orderkey"), F.lit("f.php")).alias("file"),
    )
    judged = lambda scoped: graph.trusted(F.col("symbol"), F.col("kind"), F.col("source"), F.col("category"), F.col("file"), scoped)
    return rows.select("l_orderkey", "l_linenumber", judged(False).alias("open"), judged(True).alias("scoped"))


@register("related_files", """
WITH u AS (SELECT l_suppkey AS file, (0, l_orderkey) AS first_at FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT l_suppkey, (1, l_orderkey) FROM lineitem WHERE l_partkey = 8
  UNION ALL SELECT l_suppkey, (2, l_orderkey) FROM lineitem WHERE l_partkey = 9), f AS (SELECT file, min(first_at) AS place FROM u GROUP BY file)
SELECT file, CAST(row_number() OVER (ORDER BY place, file) AS INTEGER) AS rank FROM f QUALIFY rank <= 30""")
def related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered distinct union of three lists."""
    lines = _R(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("pos"))
    return evidence.related_files([lines.where(F.col("l_partkey") == k) for k in (7, 8, 9)], 30)


@register("confidence_score", """
WITH c AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS b, o_orderkey % 5 = 0 AS d, o_custkey % 4 AS n, o_custkey % 7 AS m, o_orderkey % 7 = 0 AS q,
  o_orderkey % 11 <> 0 AS x, o_orderkey % 13 = 0 AS y, CASE o_orderkey % 4 WHEN 1 THEN 0.18 WHEN 2 THEN 0.12 WHEN 3 THEN 0.08 ELSE 0.0 END::DOUBLE AS pen FROM orders),
s AS (SELECT k, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.45::DOUBLE + CASE WHEN a THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN b THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN d THEN 0.1::DOUBLE ELSE 0 END
  + least(0.08::DOUBLE, 0.03::DOUBLE * n) + least(0.05::DOUBLE, 0.02::DOUBLE * m) + CASE WHEN q THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN x THEN 0 ELSE 0.2::DOUBLE END
  - CASE WHEN y THEN 0.25::DOUBLE ELSE 0 END - pen)), 2) AS score FROM c)
SELECT k, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS level FROM s""")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of an answer from what is known, one case per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    penalty = F.when(k % 4 == 1, 0.18).when(k % 4 == 2, 0.12).when(k % 4 == 3, 0.08).otherwise(0.0)
    score, level = evidence.confidence(k % 2 == 0, k % 3 == 0, k % 5 == 0, c % 4, c % 7, k % 7 == 0, k % 11 != 0, k % 13 == 0, penalty)
    return _R(spark, sf_dir, "orders").select(k.alias("k"), score.alias("score"), level.alias("level"))


@register("owner_method_counts", "SELECT p_type AS file, split_part(p_brand, '#', 1) || p_size AS owner, count(*) AS methods FROM part GROUP BY ALL")
def owner_method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names by owner."""
    name = F.concat(F.split("p_brand", "#")[0], F.col("p_size"), F.lit("."), F.col("p_name"))
    return project.owner_method_counts(_R(spark, sf_dir, "part").select(F.col("p_type").alias("file"), name.alias("n")), ["file"], "n")


@register("symbol_counts", "SELECT p_brand AS file, count(*) AS n FROM part WHERE p_size % 7 IN (0, 1, 2, 3) GROUP BY p_brand")
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the listed types by file."""
    return _R(spark, sf_dir, "part").where((F.col("p_size") % 7).isin(0, 1, 2, 3)).groupBy(F.col("p_brand").alias("file")).agg(F.count(F.lit(1)).alias("n"))


@register("file_summary", """
WITH s AS (SELECT l_orderkey AS file, l_linenumber AS line, 'n' || l_partkey || CASE WHEN l_suppkey % 6 = 0 THEN '-x' ELSE '' END AS name, l_suppkey AS k FROM lineitem),
g AS (SELECT *, CASE k % 5 WHEN 0 THEN 'functions' WHEN 1 THEN 'classes' WHEN 2 THEN 'methods' WHEN 3 THEN 'functions' ELSE 'classes' END AS g, k % 6 <> 0 AS shown FROM s)
SELECT file, count(*) AS symbol_count, coalesce(list(name ORDER BY line, name) FILTER (shown AND g = 'functions'), []) AS functions,
  coalesce(list(name ORDER BY line, name) FILTER (shown AND g = 'classes'), []) AS classes, coalesce(list(name ORDER BY line, name) FILTER (shown AND g = 'methods'), []) AS methods FROM g GROUP BY file""")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, classes and methods of every file in line order."""
    k = F.col("l_suppkey") % 5
    sig = F.when(k == 0, "def f()").when(k == 1, "class C").when(k == 2, "x()").otherwise("")
    kind = F.when(k == 2, "method").when(k == 4, "class").otherwise("function")
    name = F.concat(F.lit("n"), "l_partkey", F.when(F.col("l_suppkey") % 6 == 0, "-x").otherwise(""))
    symbols = _R(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), name.alias("name"), sig.alias("sig"), kind.alias("kind"), F.lit("a::b").alias("id"))
    return project.file_summary(symbols, "file", "kind", "sig", "id", "name", "line")


@register("language_stats", "SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language and by source in one pass."""
    return project.count_by(_R(spark, sf_dir, "documents"), lang=F.col("lang"), source=F.col("source"))


@register("snapshot_metrics", r"""
WITH p AS (SELECT regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS path FROM pages)
SELECT 'extension' AS dimension, regexp_extract(path, '(\.[a-z]+)$', 1) AS value, count(*) AS n FROM p GROUP BY value UNION ALL
SELECT 'category', split_part(path, '/', 1), count(*) FROM p GROUP BY 2""")
def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by extension and by folder."""
    from repolens.functions import paths

    p = _R(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1).alias("path"))
    return project.count_by(p, extension=paths.extension(F.col("path")), category=F.substring_index("path", "/", 1))


@register("hotspots", """
WITH f AS (SELECT doc_id AS file, len(string_split(text, chr(10))) AS lines FROM documents), c AS (SELECT conv_id AS file, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT f.file, lines::INTEGER AS lines, coalesce(n, 0) AS symbols FROM f LEFT JOIN c USING (file) WHERE lines > 40 OR coalesce(n, 0) > 4 ORDER BY lines DESC, f.file LIMIT 20""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest or most crowded documents; a conversation's turns stand for symbols."""
    files = _R(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.size(F.split("text", "\n")).alias("lines"))
    counts = _R(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return project.hotspots(files, counts, "file", "lines", "n", hot_lines=40, hot_symbols=4)


@register("import_graph", r"""
WITH i AS (SELECT page_id AS file, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS im FROM pages)
SELECT file, list_slice(im, 1, 10) AS imports, len(im)::INTEGER AS n_imports FROM i WHERE len(im) > 0 ORDER BY file LIMIT 50""")
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the first fifty pages that have any."""
    files = _R(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), 1).alias("imports"))
    return project.import_graph(files, "file", "imports")


_CLASSES = ["class A{k} extends B{s}", "class A{k}(B{s}, mod.C{s}, metaclass=M):", "class A{k}(val x: Int) : B{s}(x), C{s}", "export class A{k}<T> extends B{s} implements C{s}, ns.D{s} {", "class A{k} < B{s}", "class A{k}"]
_SUFFIXES = [".php", ".py", ".kt", ".ts", ".rb", ".java"]


@register("class_hierarchy", """
WITH l AS (SELECT l_linenumber % 6 AS n, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) || ['.php', '.py', '.kt', '.ts', '.rb', '.java'][l_linenumber % 6 + 1] AS file, 'A' || l_linenumber AS child, l_suppkey::VARCHAR AS s FROM lineitem),
e AS (
  SELECT file, 'extends' AS kind, child, 'B' || s AS parent FROM l
  UNION ALL SELECT file, CASE n WHEN 3 THEN 'implements' ELSE 'extends' END, child, 'C' || s FROM l WHERE n IN (1, 2, 3)
  UNION ALL SELECT file, 'implements', child, 'D' || s FROM l WHERE n = 3)
SELECT DISTINCT * FROM e""")
def class_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who extends and implements whom, as six languages write it; the last header of a file goes on over two lines."""
    from repolens.functions import paths
    from repolens.operators import hierarchy

    lines = _R(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    tasks = tasks_for(spark, lines.count(), TASK_ROWS)
    pick = lambda some: F.element_at(F.array(*[F.lit(x) for x in some]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    text = F.replace(F.replace(pick(_CLASSES), F.lit("{k}"), F.col("l_linenumber").cast("string")), F.lit("{s}"), F.col("l_suppkey").cast("string"))
    file = F.concat(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]), pick(_SUFFIXES))
    rest = F.when(F.col("l_linenumber") % 6 == 5, F.concat(F.lit("\n    extends B"), F.col("l_suppkey"), F.lit(" {"))).otherwise("")
    # a file is its four keys: dealt by it, repeated lines and edges meet in one task and are dropped there at once
    return hierarchy.edges(lines.select(file.alias("file"), F.concat(text, rest).alias("text")).repartition(tasks, "file"), paths.extension(F.col("file")))


@register("reindex_upsert", """
SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de') UNION ALL SELECT doc_id, 9, 9 FROM documents WHERE lang = 'de'""")
def reindex_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the rows of the German documents replaced, which are the batch that is re-indexed."""
    fresh = _R(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return project.upsert(_R(spark, sf_dir, "labels"), fresh, "doc_id")


@register("latency_percentiles", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = round((n - 1) * 0.5::DOUBLE)) AS p50, max(value) FILTER (i = round((n - 1) * 0.95::DOUBLE)) AS p95, max(value) FILTER (i = round((n - 1) * 0.99::DOUBLE)) AS p99 FROM r GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of event values by type."""
    return project.nearest_rank(_R(spark, sf_dir, "events"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})

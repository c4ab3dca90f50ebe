"""The call graph: resolution of calls, callers, impact and indirect dependents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import names, paths, risk

MAX_EXPANDED, MAX_SYMBOL_FILES = 6, 10
PIECE = 1000  #: callers of one name that one row holds until each is paired with its symbols; a multiple of 8, see ``_paired``
SIDE = 2000  #: symbols of one name that a piece meets at a time
TASK_PAIRS = 8_000_000  #: rows that one task makes of pieces and symbols


def dotted_suffixes(name: Column) -> Column:
    """All proper suffixes of a dotted name: ``a.b.c`` -> [``b.c``, ``c``]."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def callable_names(symbol_id: Column, short_name: Column) -> Column:
    """What a call may name a symbol by, as (name, tier): its id, its short name, the dotted suffixes of that."""
    named = lambda name, tier: F.struct(name.alias("name"), F.lit(tier).alias("tier"))
    return F.concat(F.array(named(symbol_id, 0), named(short_name, 1)), F.transform(dotted_suffixes(short_name), lambda s: named(s, 2)))


def resolve_calls(calls: DataFrame, symbols: DataFrame, caller: str, called: str, symbol_id: str, short_name: str, unique_only: bool = False) -> DataFrame:
    """(caller, called, symbol_id, tier): calls matched to symbols by id, else by short name, else by dotted suffix.

    A name's matches are those of its first tier. All of them count, or with ``unique_only`` none where there are several. Distinct called names are
    resolved once and joined back.
    """
    pairs = calls.select(F.col(caller).alias("caller"), F.col(called).alias("called")).where("called IS NOT NULL").dropDuplicates()
    known = symbols.select(F.col(symbol_id).alias("symbol_id"), F.inline(callable_names(F.col(symbol_id), F.col(short_name)))).withColumnRenamed("name", "called")
    wanted = known.join(pairs.select("called").dropDuplicates(), "called", "left_semi").groupBy("called", "symbol_id").agg(F.min("tier").alias("tier"))
    name = Window.partitionBy("called")
    matches = wanted.withColumn("_first", F.min("tier").over(name)).where("tier = _first").select("called", "symbol_id", "tier")
    if unique_only:
        matches = matches.withColumn("_n", F.count(F.lit(1)).over(name)).where("_n = 1").drop("_n")
    return _paired(pairs, matches)


def _paired(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """(caller, called, symbol_id, tier): every caller of a name with every symbol of it.

    The rows are callers times symbols, far more than the input where a name is common. A piece of the callers is one row, which meets the symbols a block at a
    time; so tasks follow the rows that they make, and none holds more than a piece. Symbol after symbol stands beside the same callers in the same order:
    columns that stay, or recur after whole bytes, take next to no room in a file, where all symbols beside each caller are written out every time.
    """
    sizes = pairs.groupBy("called").agg(F.count(F.lit(1)).alias("callers")).join(matches.groupBy("called").agg(F.count(F.lit(1)).alias("symbols")), "called")
    made = sizes.agg(F.sum(F.col("callers") * F.col("symbols"))).first()[0] or 0
    wide = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(wide, -(-made // TASK_PAIRS))
    shares = sizes.select("called", F.ceil(F.col("callers") / PIECE).alias("pieces"), F.ceil(F.col("symbols") / SIDE).alias("blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = pairs.join(shares, "called").withColumn("piece", F.floor((F.row_number().over(Window.partitionBy("called").orderBy("caller")) - 1) / PIECE))
    packed = dealt.groupBy("called", "blocks", "piece").agg(F.collect_list(F.struct("caller")).alias("callers"))  # structs: lists leave out nulls
    blocked = matches.join(shares, "called").withColumn("block", F.pmod(F.xxhash64("symbol_id"), "blocks"))
    # dealt before they are copied, or one task would copy all of a common name
    packed = packed.repartition(wide, "called", "piece").select("called", "piece", each("blocks").alias("block"), "callers")
    spread = blocked.repartition(wide, "called", "block").select("called", each("pieces").alias("piece"), "block", "symbol_id", "tier")
    # a merge join streams its left side; the number of tasks is given, as the bytes of the sides say little of the rows
    key = ["called", "piece", "block"]
    met = spread.repartition(tasks, *key).join(packed.repartition(tasks, *key).hint("merge"), key)
    return met.select("called", "symbol_id", "tier", F.inline("callers")).select("caller", "called", "symbol_id", "tier")


def callee_match(symbols: DataFrame, name: str, short_name: str = "short_name", owner: str | None = None) -> DataFrame:
    """Symbols that a bare or owner-qualified name means: the name itself or a dotted name that ends in it."""
    wanted = f"{owner}.{name}" if owner else name
    return symbols.where((F.col(short_name) == wanted) | F.col(short_name).endswith("." + wanted))


def callers_of(refs: DataFrame, symbols: DataFrame, callees: DataFrame | None = None, caller: str = "caller_symbol_id", called: str = "called_symbol_id", more: tuple[str, ...] = ()) -> DataFrame:
    """Edges, or those into ``callees`` (column symbol_id), with both ends' path, short name, line and ``more``."""
    hit = refs if callees is None else refs.join(callees.select(F.col("symbol_id").alias(called)).dropDuplicates(), called, "left_semi")
    side = lambda p, key: symbols.select(F.col("symbol_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("path", "short_name", "line", *more)])
    return hit.join(side("caller", caller), caller).join(side("called", called), called)


def usages_by_file(usages: DataFrame, file: str, line: str, kind: str, group: list[str] | None = None, times: str | None = None) -> DataFrame:
    """([group], file, usages sorted by line, count); ``times`` as in ``direct_callers``."""
    some = F.array_sort(F.collect_list(F.struct(F.col(line).alias("line"), F.col(kind).alias("type"))))
    return usages.groupBy(*(group or []), F.col(file).alias("file")).agg(some.alias("usages"), _count(times).alias("count"))


def ripple(usages: DataFrame, file: str, line: str, kind: str, category: str, shown: int = 5, times: str | None = None) -> DataFrame:
    """(category, files, usages, names, examples): a symbol's external usages by category; each example has a file's first ``shown`` usages."""
    per_file = usages_by_file(usages.withColumn("category", F.col(category)), file, line, kind, ["category"], times)
    example = F.struct("file", F.slice("usages", 1, shown).alias("usages"))
    return per_file.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.sum("count").alias("usages"), F.array_sort(F.collect_list("file")).alias("names"), F.array_sort(F.collect_list(example)).alias("examples"))


def affected(edges: DataFrame, origin: str, file: str) -> DataFrame:
    """(origin, affected, risk): distinct other files that use anything of a file, with the level of their number."""
    counted = edges.where(F.col(origin) != F.col(file)).groupBy(F.col(origin).alias("origin")).agg(F.countDistinct(file).alias("affected"))
    return counted.withColumn("risk", risk.file_count_level(F.col("affected")))


def impact(edges: DataFrame, origin: str, symbol: str, file: str, max_files: int = MAX_SYMBOL_FILES) -> DataFrame:
    """(origin, symbol, referenced_in, total_usages, files[:max]) of edges (origin file, symbol, referencing file) from other files."""
    outside = edges.where(F.col(origin) != F.col(file))
    key = ["origin", "symbol"]
    per_file = outside.groupBy(F.col(origin).alias("origin"), F.col(symbol).alias("symbol"), F.col(file).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    totals = per_file.groupBy(*key).agg(F.count(F.lit(1)).alias("referenced_in"), F.sum("n").alias("total_usages"))
    # only a few files of a symbol are gathered, however many use it; the limit is applied before the exchange
    first = per_file.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("file"))).where(F.col("_r") <= max_files)
    few = first.groupBy(*key).agg(F.array_sort(F.collect_list("file")).alias("files"))
    return totals.join(few, key)


def indirect_dependents(direct: DataFrame, impacts: DataFrame, target, file: str = "file", limit: int | None = None) -> DataFrame:
    """(file, via[:3], symbols[:5], count): files that reference a direct caller's symbols and are neither the target nor direct.

    ``direct`` is the bounded list of callers to expand; ``impacts`` has (origin, symbol, files).
    """
    callers = direct.select(F.col(file).alias("via"))
    reached = impacts.join(F.broadcast(callers), F.col("origin") == F.col("via")).select("via", "symbol", F.explode("files").alias("file"))
    outside = reached.where(F.col("file") != target).join(F.broadcast(callers.withColumnRenamed("via", "file")), "file", "left_anti")
    out = outside.groupBy("file").agg(F.array_sort(F.collect_set("via")).alias("via"), F.array_sort(F.collect_set("symbol")).alias("symbols"))
    out = out.select("file", F.slice("via", 1, 3).alias("via"), F.slice("symbols", 1, 5).alias("symbols"), F.size("via").alias("count"))
    return out if limit is None else out.orderBy(F.desc("count"), "file").limit(limit)


def trusted(symbol: Column, kind: Column, source: Column, category: Column, file: Column, scoped: bool = False) -> Column:
    """Whether a usage counts: names that many things have (``names.AMBIGUOUS``) need more than their text.

    In migrations they mean the schema, found by the index or by a scan. A scan's bare mention in tests, docs and views says nothing, nor do its
    calls in migration, bootstrap and config folders, unless the search is ``scoped`` by an owner or a file.
    """
    path, generic = F.lower(paths.normalised(file)), kind.isin("method_call", "reference")
    schema = path.rlike("^(database/migrations|migrations)/")
    group = F.coalesce(category, F.lit("other"))
    by_index = (group == "migrations") | schema
    by_scan = (group == "migrations") & generic
    if not scoped:
        by_scan = by_scan | ((kind == "reference") & group.isin("tests", "docs", "views")) | (generic & (schema | path.rlike("^(bootstrap|config)/")))
    return ~(F.lower(F.trim(symbol)).isin(names.AMBIGUOUS) & F.when(source == "index", by_index).otherwise(by_scan))


def in_scope(category: Column, file: Column, scope: str) -> Column:
    """A scope is a category or the beginning of a path."""
    return (category == scope) | paths.normalised(file).startswith(scope.rstrip("/") + "/")


def direct_callers(usages: DataFrame, file: str, line: str, kind: str, category: str, limit: int = 10, source: str | None = None, times: str | None = None) -> DataFrame:
    """(file, category, count, strongest_usage, usage_types, rank) of the strongest referencing files; with ``source`` also (evidence_source, snippets).

    ``times`` is a column with how many usages a row stands for.
    """
    more = []
    if source is not None:
        more = [F.min(source).alias("evidence_source"), F.slice(F.array_sort(F.collect_list(F.struct(F.col(line).alias("line"), F.col(kind).alias("type")))), 1, 3).alias("snippets")]
    weight = risk.weight(F.col(kind), risk.USAGE_WEIGHTS)
    grouped = usages.groupBy(F.col(file).alias("file")).agg(
        F.first(category).alias("category"), _count(times).alias("count"), F.max(weight).alias("_w"),
        F.min_by(F.col(kind), F.struct(-weight, F.col(kind))).alias("strongest_usage"), F.array_sort(F.collect_set(kind)).alias("usage_types"), *more,
    )
    order = [F.desc(risk.weight(F.col("category"), risk.CATEGORY_WEIGHTS)), F.desc("_w"), F.desc("count"), F.col("file")]
    best = grouped.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_w")


def _count(times: str | None) -> Column:
    return F.count(F.lit(1)) if times is None else F.sum(times)


def weighted_risk(usages: DataFrame, group: list[str], file: str, kind: str, category: str, change: str = "modify", times: str | None = None) -> DataFrame:
    """(group, file, category, count, score): each referencing file's weighted risk in thousandths; ``times`` as in ``direct_callers``."""
    whole = risk.whole_weight(F.col(kind), risk.USAGE_WEIGHTS) * (F.lit(1) if times is None else F.col(times))
    weighed = usages.groupBy(*group, F.col(file).alias("file"), F.col(category).alias("category")).agg(_count(times).alias("count"), F.sum(whole).alias("_u"))
    return weighed.withColumn("score", risk.file_score(F.col("category"), F.col("_u"), F.col("count"), F.col("file"), change)).drop("_u")


def hundredths(thousandths: Column) -> Column:
    """Thousandths as a double with two places, rounded half up."""
    return F.floor((thousandths + 5) / F.lit(10).cast("decimal(4,0)")).cast("double") / 100


def risk_summary(scored: DataFrame, group: list[str]) -> DataFrame:
    """(group, risk_score, risk_level, files, usages, high_risk_files)."""
    out = scored.groupBy(*group).agg(
        hundredths(F.sum("score")).alias("risk_score"), F.count(F.lit(1)).alias("files"), F.sum("count").alias("usages"),
        F.sum(F.when(F.col("score") >= 1000 * risk.HIGH_RISK, 1).otherwise(0)).alias("high_risk_files"),
    )
    return out.withColumn("risk_level", risk.level(F.col("risk_score"), risk.RISK_LEVELS))


def blast_radius(risk_score: Column, indirect_files: Column, n_categories: Column) -> tuple[Column, Column]:
    """(score, level)."""
    score = (F.round(risk_score * 100).cast("long") + indirect_files * 90 + n_categories * 50).cast("double") / 100
    return score, risk.level(score, risk.BLAST_LEVELS)

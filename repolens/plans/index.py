"""The index: tables that belong to files, and what is derived from them when it is asked for.

Each table is made from the parsed files alone, row by row, so a changed file changes only its own rows. References aren't stored as pairs: a name that
many symbols have and many callers use would be their product. ``calls`` has what each caller calls by name, ``names`` what each symbol can be called;
a question joins the two for the symbols that it is about.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import names
from repolens.functions.tokenize import weighted_tokens
from repolens.operators import cochange, graph
from repolens.operators.bm25 import postings
from repolens.operators.vectors import hashed_vectors
from repolens.sources.store import SCHEMA_VERSION

FEW = 300  #: symbols about which ``few`` answers


class Some(NamedTuple):
    """Names by which calls mean some symbols, (called, symbol_id) of what they mean, and the symbols; local relations."""

    names: list[str]
    means: DataFrame
    callees: DataFrame


def ordered(df: DataFrame, *columns: str, few: bool = False) -> DataFrame:
    """Rows sorted over all tasks, so that a scan finds a value by the bounds of its row groups; a common value is spread by the last column.
    ``few`` rows stay in one task."""
    return (df.coalesce(1) if few else df.repartitionByRange(*columns)).sortWithinPartitions(*columns)


def derive(parsed: DataFrame, few: bool = False) -> dict[str, DataFrame]:
    """The tables by file of ``sources.tree.parse_files``. Nothing is run here. ``few`` says that they are small."""
    files = parsed.select("path", "language", "special", "line_count", "imports", "exports", "package", "docstring")
    each = parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.*").where(names.is_clean(F.col("name")))
    symbols = each.select(
        F.concat_ws("::", "path", "name").alias("symbol_id"), "path", F.col("name").alias("short_name"), "type", "line", "end_line", "signature", "docstring", F.coalesce("called_by", F.array().cast("array<string>")).alias("called_by")
    ).dropDuplicates(["symbol_id"])
    calls = parsed.select("path", F.explode("pending").alias("c")).where("c.called IS NOT NULL").select("path", F.concat_ws("::", "path", "c.caller").alias("caller"), F.col("c.called").alias("called")).dropDuplicates()
    named = symbols.select("path", "symbol_id", F.explode(graph.callable_names(F.col("symbol_id"), F.col("short_name"))).alias("n")).select("n.name", "n.tier", "symbol_id", "path").dropDuplicates()
    searched = symbols.where("type <> 'module'").select(
        F.struct("symbol_id", "path").alias("at"), weighted_tokens(names.member(F.col("short_name")), F.when(F.col("short_name").contains("."), names.owner_first(F.col("short_name"))), F.col("signature"), F.col("docstring"), F.col("path")).alias("terms")
    ).where(F.size("terms") > 0)
    return {
        "files": files, "symbols": symbols, "calls": ordered(calls, "called", "caller", few=few),
        "names": ordered(named, "name", "symbol_id", few=few), "search_docs": searched.select("at.symbol_id", F.size("terms").alias("doc_length"), "at.path"),
        "search_postings": ordered(postings(searched, "at", "terms").select("at.symbol_id", "term", "tf", "at.path"), "term", "symbol_id", few=few),
        "search_vectors": hashed_vectors(searched, "at", "terms").select("at.symbol_id", "vector", "at.path"),
    }


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(key, n): counts that add up over files, so those of a change can be added and taken away."""
    pair = lambda key, n: F.struct(key.alias("key"), n.cast("long").alias("n"))
    of_files = F.array(pair(F.lit("files"), F.lit(1)), pair(F.lit("special"), F.col("special").cast("int")), pair(F.concat(F.lit("language:"), "language"), F.lit(1)))
    of_docs = F.array(pair(F.lit("docs"), F.lit(1)), pair(F.lit("doc_terms"), F.col("doc_length")))
    rows = [tables["files"].select(F.explode(of_files).alias("x")), tables["symbols"].select(pair(F.concat(F.lit("type:"), "type"), F.lit(1)).alias("x")), tables["search_docs"].select(F.explode(of_docs).alias("x"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("x.key").agg(F.sum("x.n").alias("n"))


def moved_totals(before: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """Totals after a change, by key: what was, without what the changed files had, with what they have."""
    every = before.unionByName(gone.withColumn("n", -F.col("n"))).unionByName(fresh)
    return every.groupBy("key").agg(F.sum("n").alias("n")).where("n <> 0")


def metadata(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: files, languages, symbols by type and in all, schema version."""
    t = tables["totals"]
    after = lambda prefix: F.substring_index("key", prefix, -1)
    total = lambda key: F.coalesce(F.sum(F.when(F.col("key") == key, F.col("n"))), F.lit(0)).cast("long")
    types = F.array_sort(F.collect_list(F.when(F.col("key").startswith("type:"), F.struct(after("type:").alias("k"), F.col("n")))))
    return t.agg(
        total("files").alias("indexed_files"), F.array_sort(F.collect_list(F.when(F.col("key").startswith("language:"), after("language:")))).alias("languages"), total("special").alias("special_files"),
        F.map_from_entries(types).alias("symbol_types"), F.coalesce(F.sum(F.when(F.col("key").startswith("type:"), F.col("n"))), F.lit(0)).cast("long").alias("total_symbols"),
        F.lit(SCHEMA_VERSION).alias("schema_version"), (total("files") - total("special")).alias("fallback_files"),
    )


def search_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row (doc_count, avg_doc_length)."""
    total = lambda key: F.coalesce(F.sum(F.when(F.col("key") == key, F.col("n"))), F.lit(0))
    docs, terms = total("docs"), total("doc_terms")
    return tables["totals"].agg(docs.alias("doc_count"), F.when(docs > 0, terms / docs).alias("avg_doc_length"))


def cochanges(log: DataFrame, files: DataFrame) -> DataFrame:
    return cochange.only_indexed(cochange.cochange_pairs(log, "pos", "file", "pos", "date"), files, "path")


def build(parsed: DataFrame, log: DataFrame | None = None) -> dict[str, DataFrame]:
    """``derive`` with totals and, from a git log if there is one, pairs of files that change together."""
    tables = derive(parsed)
    if log is None:
        log = parsed.sparkSession.createDataFrame([], "pos int, date string, file string")
    return tables | {"cochanges": cochanges(log, tables["files"]), "totals": totals(tables)}


def matched(tables: dict[str, DataFrame], callees: DataFrame, unique_only: bool = False) -> DataFrame:
    """(called, symbol_id) of the names by which a call means one of ``callees`` (symbol_id, short_name): of a name's symbols those of its best tier count,
    with ``unique_only`` only where there is one."""
    own = callees.select("symbol_id", F.explode(graph.callable_names(F.col("symbol_id"), F.col("short_name"))).alias("n")).select("n.name", "n.tier", "symbol_id").dropDuplicates()
    rivals = tables["names"].join(own.select("name").dropDuplicates(), "name", "left_semi").groupBy("name", "tier").agg(F.count(F.lit(1)).alias("n"))
    best = rivals.groupBy("name").agg(F.min(F.struct("tier", "n")).alias("best"))
    kept = own.join(best, "name").where(F.col("tier") == F.col("best.tier"))
    return (kept.where("best.n = 1") if unique_only else kept).select(F.col("name").alias("called"), "symbol_id")


def refs(tables: dict[str, DataFrame], callees: DataFrame | None = None, unique_only: bool = False) -> DataFrame:
    """(caller_symbol_id, called_symbol_id), of all symbols or into ``callees``; both ends are symbols."""
    means = matched(tables, tables["symbols"] if callees is None else callees, unique_only)
    pairs = tables["calls"].join(means, "called").select(F.col("caller").alias("caller_symbol_id"), F.col("symbol_id").alias("called_symbol_id")).dropDuplicates()
    return pairs.join(tables["symbols"].select(F.col("symbol_id").alias("caller_symbol_id")), "caller_symbol_id", "left_semi")


def with_callers(tables: dict[str, DataFrame], symbols: DataFrame, unique_only: bool = False) -> DataFrame:
    """``symbols`` with all callers in ``called_by``: those of the same file, then those that refer to it."""
    more = refs(tables, symbols, unique_only).groupBy("called_symbol_id").agg(F.array_sort(F.collect_set("caller_symbol_id")).alias("more"))
    joined = symbols.join(more, F.col("symbol_id") == F.col("called_symbol_id"), "left")
    return joined.withColumn("called_by", F.array_distinct(F.concat("called_by", F.coalesce("more", F.array().cast("array<string>"))))).drop("more", "called_symbol_id")


def few(tables: dict[str, DataFrame], callees: DataFrame) -> Some | None:
    """What ``matched`` says about ``FEW`` symbols or fewer, in the driver; None if there are more. With it a question reads only the rows of some names."""
    rows = callees.select("symbol_id", "short_name", "path").limit(FEW + 1).collect()
    if len(rows) > FEW:
        return None
    spark, parts = callees.sparkSession, {r["symbol_id"]: r["short_name"].split(".") for r in rows}
    own = {(n, t, i) for i, p in parts.items() for n, t in [(i, 0), (".".join(p), 1), *((".".join(p[k:]), 2) for k in range(1, len(p)))]}
    wanted = sorted({n for n, _, _ in own})
    best = {r["name"]: r["tier"] for r in tables["names"].where(F.col("name").isin(wanted)).groupBy("name").agg(F.min("tier").alias("tier")).collect()}
    means = sorted({(n, i) for n, t, i in own if best.get(n) == t})
    table = lambda names, rows: spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows], pa.string()) for k, n in enumerate(names)})).coalesce(1)
    return Some(sorted({n for n, _ in means}), table(["called", "symbol_id"], means), table(["symbol_id", "short_name", "path"], [tuple(r) for r in rows]))


def _calls(tables: dict[str, DataFrame], some: Some | None) -> DataFrame:
    return tables["calls"] if some is None else tables["calls"].where(F.col("called").isin(some.names))


def _callers(tables: dict[str, DataFrame]) -> DataFrame:
    kind = F.when(F.col("type") == "module", "module_script").otherwise("method_call")
    return tables["symbols"].select(F.col("symbol_id").alias("caller"), F.col("path").alias("file"), F.col("short_name").alias("caller_name"), "line", kind.alias("kind"))


def edges(tables: dict[str, DataFrame], callees: DataFrame | None = None, some: Some | None = None) -> DataFrame:
    """(origin, symbol, file, caller, line, kind): references with both ends' files, of all symbols or into ``callees`` (rows of ``symbols``), of
    which ``some`` is what ``few`` said."""
    to = tables["symbols"] if callees is None else callees if some is None else some.callees
    called = to.select("symbol_id", F.col("path").alias("origin"), F.col("short_name").alias("symbol"))
    means = matched(tables, to) if some is None else some.means
    pairs = _calls(tables, some).join(means, "called").select("caller", "symbol_id").dropDuplicates()
    return pairs.join(called, "symbol_id").join(_callers(tables), "caller").select("origin", "symbol", "file", F.col("caller_name").alias("caller"), "line", "kind")


def usages(tables: dict[str, DataFrame], callees: DataFrame, some: Some | None = None) -> DataFrame:
    """(file, caller, line, kind, times): the callers of any of ``callees``, ``times`` being how many of them a caller means. No row for each pair:
    a name with many symbols and many callers costs as much as both, not as their product."""
    means = matched(tables, callees) if some is None else some.means
    by_name = means.groupBy("called").agg(F.count(F.lit(1)).alias("n"))
    each = _calls(tables, some).join(by_name, "called").groupBy("caller").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n"), F.collect_set("called").alias("called"))
    # only who calls by several of the names may mean one symbol twice
    several = each.where("forms > 1").select("caller", F.explode("called").alias("called")).join(means, "called").groupBy("caller").agg(F.countDistinct("symbol_id").alias("distinct"))
    counted = each.join(several, "caller", "left").select("caller", F.coalesce("distinct", "n").alias("times"))
    return counted.join(_callers(tables), "caller").select("file", F.col("caller_name").alias("caller"), "line", "kind", "times")

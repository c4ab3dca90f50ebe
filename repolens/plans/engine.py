"""The tool surface over an index: nine calls that return plain dictionaries.

Plans do the work; what reaches the driver is bounded by the answer (a page of hits, ten related files). The file-level edges of the index are
cached once per build and every answer about callers, impact and risk is derived from them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions import names, paths, risk, syntax, validation
from repolens.functions.pytokens import tokenize, word_tokens
from repolens.operators import bm25, cochange, evidence, graph, hierarchy, project, ranking, textindex, textsearch, vectors
from repolens.plans import index
from repolens.sources import config, settings, store, tree
from repolens.sources import files as file_columns

# What a caller may ask for, and the keys of an answer that stay when it is spilled.
INTENTS = {"project", "file", "symbol", "before_edit", "impact"}
CHANGES = {"modify", "rename", "delete", "signature_change", "contract_change"}
SPILL_CHARS, SPILLS_KEPT = 3500, 20
ONE_TASK = 64  #: changed files that are indexed in one task
CACHED_SYMBOLS = 200_000  #: of an index whose tables of symbols, names and calls are cached
SMALL, KNOWN = 10_000, 64  #: rows of an intermediate result that the driver holds, and how many of those it keeps
SPILL_KEYS = [
    "status", "intent", "change_type", "project", "target", "overview", "confidence", "confidence_details", "blast_radius", "risk_reasons", "safe_edit_hints", "related_files",
    "missing_context", "edit_plan", "suggested_next_steps",
]
#: What an answer says about a related file, by role: its evidence and a sentence.
EVIDENCE = {
    "definition": ("definition", "The file under edit."), "direct_caller": ("cross_file_reference", "Uses the target itself."),
    "file_scope_caller": ("cross_file_reference", "Uses the target from its top level, outside any function."), "indirect_dependent": ("dependency_expansion", "Depends on a direct caller."),
    "ripple": ("ripple_model", "Among the files that a change of the symbol reaches."), "file_impact": ("file_impact", "Uses other symbols of the file."),
    "framework_entrypoint": ("framework_wiring", "An entry point of the framework that names the target."), "co_change": ("history", "Changes together with the file."),
    "semantic_related": ("semantic_search", "Its symbols read alike."),
}
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
STRENGTH = {"certain": "strong", "probable": "medium", "inferred": "light"}
USAGE_REASONS = {
    "extends_or_implements": "Other types inherit from or implement this symbol.", "instantiation": "The way this symbol is constructed matters elsewhere.",
    "static_call": "It is called statically by name.", "method_call": "Method calls elsewhere rely on its behaviour.",
}


#: What a project can set, and what holds where it sets nothing.
SETTINGS = {"hybrid": False, "git_window": tree.GIT_WINDOW, "spill_chars": SPILL_CHARS, "max_related": 10}
TOOLS = {"set_project_path", "search_code", "find_files", "get_symbol_body", "refresh_index", "build_deep_index", "get_edit_region", "get_project_snapshot", "get_context"}


class Engine:
    """One project and its index. ``store_path`` keeps the index between sessions."""

    def __init__(self, spark: SparkSession, store_path: str | None = None, hybrid: bool = False, settings_path: str | None = None):
        """``hybrid`` fuses symbol search with a search of the stored vectors; ``settings_path`` is where settings of projects are kept."""
        self.spark, self.store_path, self.hybrid, self.settings_path = spark, store_path, hybrid, settings_path
        self._held: list[DataFrame] = []
        self._pinned: list[DataFrame] = []
        self._cached: list[DataFrame] = []
        self._session = spark
        self._known: dict[tuple, pa.Table] = {}
        self.root: str | None = None
        self.structure: config.Structure | None = None
        self.tables: dict[str, DataFrame] | None = None
        self.files: DataFrame | None = None
        self.settings: dict[str, Any] = {}
        self._stale: DataFrame | None = None
        self._scan_languages: list[syntax.Syntax] | None = None

    # project and index

    def set_project_path(self, path: str) -> str:
        if not os.path.isdir(path):
            return f"Error: {path} is not a directory"
        self.root, self.structure = os.path.abspath(path), config.structure_of(path)
        self.settings = settings.load(self.settings_path, self.root) if self.settings_path else {}
        self.hybrid = bool(self.settings.get("hybrid", self.hybrid))
        self._load()
        self.refresh_index()
        return f"Project {self.root}: {self.files.count()} files"

    def configure(self, **values: Any) -> dict[str, Any]:
        """Keep settings of the project; None removes one. ``SETTINGS`` says which there are."""
        if wrong := sorted(set(values) - set(SETTINGS)):
            return {"status": "error", "message": f"no setting {', '.join(wrong)}; there are {sorted(SETTINGS)}"}
        if bad := sorted(k for k, v in values.items() if v is not None and type(v) is not type(SETTINGS[k])):
            return {"status": "error", "message": f"a setting of another type: {', '.join(bad)}"}
        kept = settings.save(self.settings_path, self._root(), **values) if self.settings_path else {k: v for k, v in (self.settings | values).items() if v is not None}
        self.settings, self.hybrid = kept, bool(kept.get("hybrid", self.hybrid))
        return {"status": "success", "settings": kept}

    def setting(self, name: str) -> Any:
        return self.settings.get(name, SETTINGS[name])

    def refresh_index(self) -> str:
        """List the files again; no content is read."""
        for held in (self.files, self._stale):
            if held is not None:
                held.unpersist()
        self.files, self._scan_languages, self._stale = tree.listing(self.spark, self._root()).persist(StorageLevel.MEMORY_AND_DISK), None, None
        return f"{self.files.count()} files listed"

    def build_deep_index(self) -> str:
        """Read every file, build all tables, and swap them in."""
        self.refresh_index()
        return self._swap(self._derived(self.files), None)

    def update_index(self) -> str:
        """Index the files that were changed, added or deleted since they were indexed, and only them."""
        if self.tables is None:
            return self.build_deep_index()
        self.refresh_index()
        suspects = self._differing().join(self.files, "path", "left_semi")
        digests = self._read(self.files.join(suspects, "path", "left_semi")).select("path", F.sha2("content", 256).alias("now"))
        known = self.tables["snapshot"].select("path", "digest")
        changed = digests.join(known, "path", "left").where("digest IS NULL OR NOT now <=> digest").select("path")
        return self._apply(changed.unionByName(known.select("path").join(self.files, "path", "left_anti")))

    def reindex_file(self, file_path: str) -> str:
        """Read one changed, new or deleted file again; the rows of the others stay as they are."""
        if self.tables is None:
            return self.build_deep_index()
        self.refresh_index()
        return self._apply(self._frame([(file_path,)], "path string"))

    def _apply(self, covers: DataFrame) -> str:
        covers = covers.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._report() if covers.isEmpty() else self._swap(self._derived(self.files.join(covers, "path", "left_semi")), covers)
        finally:
            covers.unpersist()

    def _differing(self) -> DataFrame:
        """(path) of listed files that the index lacks, or knows with another size or time."""
        known = self.tables["snapshot"].select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"))
        return self.files.join(known, "path", "left").where("_l IS NULL OR length <> _l OR modified <> _m").select("path")

    def _derived(self, files: DataFrame) -> dict[str, DataFrame]:
        """The tables by file of some listed files."""
        files = files.persist(StorageLevel.MEMORY_AND_DISK)
        n, ext = files.count(), paths.extension(F.col("path"))
        few = n <= ONE_TASK
        read = lambda some: tree.contents(some.coalesce(1), self._root()) if few else self._read(some)
        parsed = tree.parse_files(read(files)).persist(StorageLevel.MEMORY_AND_DISK)
        grams = textindex.gram_index(read(files) if few else tree.contents(textindex.by_block(files, n), self._root()), n).persist(StorageLevel.MEMORY_AND_DISK)
        tables = index.derive(parsed, few)
        scanned = files.where(~paths.has_indexed_edges(F.col("path")) & ext.isin([e for lang in syntax.SYNTAX.values() for e in lang.extensions]))
        texts = self._decoded(read(files.where(ext.isin(hierarchy.SUFFIXES)))).select(F.col("path").alias("file"), "text")
        lists = grams.where("gram IS NOT NULL").select("block", "gram", "numbers")
        numbered = grams.where("path IS NOT NULL").select("block", "number", "path", "digest")
        self._held = [files, parsed, grams]
        return tables | {
            "grams": index.ordered(lists, "gram", "block", few=few), "gram_files": numbered.drop("digest"), "identifiers": index.ordered(textindex.identifiers(read(scanned)), "identifier", "path", few=few),
            "inherits": index.ordered(hierarchy.by_ends(texts, tables["symbols"]), "end", "path", few=few), "snapshot": files.select("path", "length", "modified").join(numbered.select("path", "digest"), "path"),
        }

    def _swap(self, fresh: dict[str, DataFrame], covers: DataFrame | None) -> str:
        """Make the tables of all files, or those of the changed files ``covers``, the index's."""
        log, old = tree.git_log(self.spark, self._root(), self.setting("git_window")), self.tables
        if covers is None:
            built = fresh | {"totals": index.totals(fresh), "cochanges": index.cochanges(log, fresh["files"])}
        else:
            gone = index.totals({k: old[k].join(covers, "path", "left_semi") for k in ("files", "symbols", "search_docs")})
            files = old["files"].select("path").join(covers, "path", "left_anti").unionByName(fresh["files"].select("path"))
            built = fresh | {"totals": index.moved_totals(old["totals"], gone, index.totals(fresh)), "cochanges": index.cochanges(log, files)}
        if self.store_path:
            if covers is None:
                store.save(built, self.store_path)
            else:
                store.append(built, self.store_path, covers)
            self._load()
        else:
            keep = lambda k, df: df if covers is None or k in store.WHOLE else (old[k] if k in store.BY_BLOCK else old[k].join(covers, "path", "left_anti")).unionByName(df)
            self.tables = {k: keep(k, df).persist(StorageLevel.MEMORY_AND_DISK) for k, df in built.items()}
            store.at_once(self.spark, [df.count for df in self.tables.values()])  # before what they are made from goes
        for held in self._held:
            held.unpersist()
        if self._stale is not None:
            self._stale.unpersist()
        self._held, self._stale, self._known = [], None, {}
        return self._report()

    def _load(self) -> None:
        """The stored tables; those that every answer reads are cached if the index is small by its own totals."""
        for df in self._cached:
            df.unpersist()
        self._known = {}
        self.tables, self._cached, self._session = store.load(self.spark, self.store_path) if self.store_path else None, [], self.spark
        if self.tables is not None and index.metadata(self.tables).first()["total_symbols"] <= CACHED_SYMBOLS:
            self._session = self.spark.newSession()  # answers from a small index gain nothing from plans that are made anew while they run
            self._session.conf.set("spark.sql.adaptive.enabled", "false")
            self._session.conf.set("spark.sql.shuffle.partitions", "2")
            self.tables = store.load(self._session, self.store_path)
            for name in ("files", "symbols", "names", "calls"):
                self.tables[name] = self.tables[name].persist(StorageLevel.MEMORY_AND_DISK)
                self._cached.append(self.tables[name])

    def _report(self) -> str:
        meta = index.metadata(self.tables).first()
        return f"Indexed {meta['indexed_files']} files, {meta['total_symbols']} symbols"

    def _root(self) -> str:
        if self.root is None:
            raise ValueError("set_project_path first")
        return self.root

    @property
    def _scanned(self) -> list[syntax.Syntax]:
        """Languages whose usages are searched in text, as the index lacks some of their calls; only those that the project has."""
        if self._scan_languages is None:
            here = {r["e"] for r in self.files.where(~paths.has_indexed_edges(F.col("path"))).select(paths.extension(F.col("path")).alias("e")).distinct().collect()}
            self._scan_languages = [lang for lang in syntax.SYNTAX.values() if here & set(lang.extensions)]
        return self._scan_languages

    def _edges(self, callees: DataFrame, *key: str) -> DataFrame:
        """Edges into some symbols; ``key`` names them."""
        return self._small(lambda: index.edges(self.tables, callees, index.few(self.tables, callees)), "edges", *key)

    def _small(self, made: Callable[[], DataFrame], *key: str | None) -> DataFrame:
        """The same rows as a local relation if there are few, so that what is built on them costs no scan, and kept for the next question about the
        same ``key`` until the index changes; else kept until the next answer."""
        if (rows := self._known.get(key)) is None:
            df = made()
            rows = df.limit(SMALL + 1).toArrow()
        if rows.num_rows <= SMALL:
            self._known[key] = rows
            if len(self._known) > KNOWN:
                self._known.pop(next(iter(self._known)))
            return self._session.createDataFrame(rows).coalesce(1)  # one partition needs no exchange
        self._pinned.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def _own(self, path: str) -> DataFrame:
        return self.tables["symbols"].where(F.col("path") == path)

    def _category(self, path):
        return F.coalesce(paths.category(path, self.structure.folders), F.lit("other"))

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        """A few rows of the driver as a local relation: it costs no job."""
        fields = [f.split(" ") for f in schema.split(", ")]
        return self._session.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], ARROW[kind]) for i, (name, kind) in enumerate(fields)})).coalesce(1)

    def _read(self, files: DataFrame) -> DataFrame:
        """(path, content) of listed files."""
        return tree.contents(files.repartition(2 * self.spark.sparkContext.defaultParallelism), self._root())

    def _texts(self, files: DataFrame, one: bool = False) -> DataFrame:
        """(path, text) of those listed files that are text; ``one`` where there is one file at most."""
        return self._decoded(tree.contents(files.coalesce(1), self._root()) if one else self._read(files))

    def _decoded(self, read: DataFrame) -> DataFrame:
        return read.where(file_columns.is_text(F.col("content"))).select("path", file_columns.decoded(F.col("content")).alias("text"))

    def _lines(self, files: DataFrame, one: bool = False) -> DataFrame:
        return textsearch.lines_of(self._texts(files, one), "path", "text")

    def _lines_of(self, path: str) -> DataFrame:
        return self._lines(self.files.where(F.col("path") == path), one=True)

    @property
    def stale(self) -> DataFrame | None:
        """(path) of files that changed since they were indexed; None if there are none."""
        if self._stale is None:
            self._stale = self._differing().persist(StorageLevel.MEMORY_AND_DISK)
        return None if self._stale.isEmpty() else self._stale

    def _meeting(self, condition: textindex.Condition) -> DataFrame:
        """The listed files that can hold a match: by the index those that meet the condition, and what it doesn't know yet."""
        if self.tables is None:
            return self.files
        found = textindex.candidates(self.tables["grams"], self.tables["gram_files"], condition)
        if self.stale is not None:
            found = found.unionByName(self.stale)
        return self.files.join(found, "path", "left_semi")

    def _entry(self, path):
        """Whether a file is one of the framework's entry points."""
        return paths.framework_role(path, paths.category(path, self.structure.folders)).isNotNull()

    def call(self, tool: str, **arguments: Any) -> Any:
        """A tool by name, its arguments checked, a large answer spilled."""
        if tool not in TOOLS:
            return {"status": "error", "message": f"no tool {tool}; there are {sorted(TOOLS)}"}
        checks = {
            "file_path": validation.file_path, "pattern": lambda p: validation.search_pattern(p, bool(arguments.get("regex"))) if tool == "search_code" else validation.glob(p),
            "target": lambda p: validation.file_path(p) if p else None,
        }
        for name, check in checks.items():
            if name in arguments and (wrong := check(arguments[name])):
                return {"status": "error", "message": wrong}
        if tool == "search_code" and (wrong := validation.page(arguments.get("start_index", 0), arguments.get("max_results", 10))):
            return {"status": "error", "message": wrong}
        answer = getattr(self, tool)(**arguments)
        return self.spilled(answer) if isinstance(answer, dict) and tool == "get_context" else answer

    # text

    def search_code(self, pattern: str, case_sensitive: bool = True, context_lines: int = 0, file_pattern: str | None = None, fuzzy: bool = False, regex: bool | None = None, start_index: int = 0, max_results: int = 10) -> dict[str, Any]:
        if regex is None:
            regex = not fuzzy and textsearch.is_regex(pattern)
        try:
            hit = textsearch.matcher(F.col("text"), pattern, case_sensitive, regex, fuzzy)
            textsearch.checked_page(start_index, max_results)
        except textsearch.SearchError as e:
            return {"status": "error", "message": str(e)}
        asked = textindex.regex_condition(pattern, case_sensitive) if regex else textindex.literal_condition(pattern, case_sensitive)
        files = self._meeting(asked)
        if file_pattern:
            files = files.where(paths.basename(F.col("path")).rlike(paths.name_regex(file_pattern)))
        hits = self._lines(files).where(hit).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            total = hits.count()
            rows = [r.asDict() for r in textsearch.page(hits, start_index, max_results).orderBy("place").collect()]
        finally:
            hits.unpersist()
        if context_lines and rows:
            here = self._lines(self.files.where(F.col("path").isin(sorted({r["file"] for r in rows}))))  # the files of one page
            around = textsearch.with_context(here, hit, context_lines).orderBy("file", "line").collect()
            for r in rows:
                r["context"] = [{"line": x["line"], "text": x["text"]} for x in around if x["file"] == r["file"] and abs(x["line"] - r["line"]) <= context_lines]
        return {"status": "success", "results": [{k: v for k, v in r.items() if k != "place"} for r in rows], "total_matches": total, "returned": len(rows), "has_more": start_index + len(rows) < total}

    def find_files(self, pattern: str) -> list[str]:
        tiered = self.files.select("path").withColumn("tier", paths.match_tier(F.col("path"), pattern)).where("tier IS NOT NULL")
        return [r["path"] for r in project.best_tier(tiered, "tier").orderBy("path").collect()]

    def _symbol(self, path: str, name: str, owner: str | None) -> dict | None:
        """The symbol that a name means in a file: with its owner, exactly, or as the end of a dotted name."""
        tier = F.when(F.col("short_name") == f"{owner}.{name}", 0).when(F.col("short_name") == name, 1).when(F.col("short_name").endswith("." + name), 2) if owner else F.when(F.col("short_name") == name, 1).when(F.col("short_name").endswith("." + name), 2)
        row = self.tables["symbols"].where(F.col("path") == path).withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "line").first()
        return None if row is None else row.asDict()

    def _code(self, path: str, symbol: dict) -> str | None:
        """A symbol's lines, cut where they are too many; None if the file is gone."""
        wanted = self.spark.range(1).select(F.lit(path).alias("file"), F.lit(symbol["short_name"]).alias("symbol"), F.lit(symbol["line"]).cast("int").alias("start"), F.lit(symbol["end_line"]).cast("int").alias("end"))
        row = textsearch.symbol_body(self._lines_of(path), wanted).first()
        return None if row is None else row["body"] + ("\n..." if row["truncated"] else "")

    def get_symbol_body(self, file_path: str, symbol_name: str, compact: bool = False, owner: str | None = None) -> dict[str, Any]:
        if self.tables is None:
            return {"status": "needs_deep_index"}
        found = self._symbol(file_path, symbol_name, owner)
        code = found and self._code(file_path, found)
        if code is None:
            return {"status": "error", "message": f"{symbol_name} not found in {file_path}"}
        out = {"status": "success", "symbol": found["short_name"], "type": found["type"], "line": found["line"], "end_line": found["end_line"] or found["line"] + 50, "match": ["owner_qualified", "exact", "qualified_suffix"][found["tier"]], "code": code}
        if not compact:
            calls = self._edges(self._own(file_path).where(F.col("short_name") == found["short_name"]), file_path, found["short_name"]).where(F.col("file") != file_path).select("file", "caller", "line").orderBy("file", "line").limit(10)
            out |= {"signature": found["signature"], "docstring": found["docstring"], "called_by": [r.asDict() for r in calls.collect()]}
        return out

    def get_edit_region(self, file_path: str, symbol: str | None = None, start_line: int | None = None, end_line: int | None = None, context_lines: int = 5) -> dict[str, Any]:
        if os.path.isabs(file_path) or ".." in file_path.split("/"):
            return {"status": "error", "message": "the path leaves the project"}
        if symbol:
            found = self._symbol(file_path, symbol, None) if self.tables else None
            if found is None:
                return {"status": "error", "message": f"{symbol} not found"}
            start_line, end_line = found["line"], found["end_line"] or found["line"]
        if not start_line:
            return {"status": "error", "message": "a symbol or a start line is needed"}
        end_line = end_line or start_line
        own = self._lines_of(file_path)
        shown = textsearch.edit_region(own, start_line, end_line, context_lines).orderBy("line").collect()
        if not shown and own.isEmpty():
            return {"status": "error", "message": f"{file_path} not found"}
        return {"status": "success", "start_line": start_line, "end_line": end_line, "text": "\n".join(r["shown"] for r in shown)}

    # retrieval

    def search_symbols(self, query: str, limit: int = 10) -> list[dict]:
        """BM25 over the stored index, fused with vectors if asked for, then reranking by intent."""
        asked = tokenize(query)
        if not asked or self.tables is None:
            return []
        most = max(5 * limit, 100)
        scores = bm25.index_scores(self.tables["search_postings"], self.tables["search_docs"], "symbol_id", asked, index.search_stats(self.tables))
        if self.hybrid:
            own = vectors.hashed_vectors(self._frame([(0, asked)], "k int, terms array<string>"), "k", "terms").first()
            near = ranking.cosine_top_k(self.tables["search_vectors"], "symbol_id", "vector", own["vector"], most) if own else None
            lists = [bm25.top_k(scores, "symbol_id", most)] + ([bm25.top_k(near, "symbol_id", most)] if own else [])
            scores = ranking.reciprocal_rank_fusion([x.select("symbol_id", "rank") for x in lists], "symbol_id", most)
        else:
            scores = scores.orderBy(F.desc("score"), "symbol_id").limit(most)
        hits = scores.join(self.tables["symbols"].select("symbol_id", F.col("path").alias("file"), "short_name", "type", "line", "signature", "docstring"), "symbol_id")
        ranked = ranking.intent_rerank(hits, query).withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "symbol_id").limit(limit)
        return [r.asDict() for r in ranked.collect()]

    def _reranked(self, query: str, limit: int) -> list[dict]:
        """Hits with their path role, framework match and adjusted score, best first."""
        hits = self.search_symbols(query, limit)
        if not hits:
            return []
        frame = self._frame([(h["symbol_id"], h["file"], h["short_name"], float(h["score"])) for h in hits], "symbol_id string, file string, short_name string, score double")
        ranked = ranking.path_rerank(frame, query, category=paths.category(F.col("file"), self.structure.folders))
        return [r.asDict() for r in ranked.orderBy(F.desc("adjusted_score"), F.desc(ranking.role_priority(F.col("path_role"))), F.desc("short_name"), "symbol_id").collect()]

    def _candidates(self, query: str, limit: int = 8) -> list[dict]:
        keys = ("symbol_id", "file", "short_name", "score", "adjusted_score", "path_role")
        return [{k: h[k] for k in keys} for h in self._reranked(query, limit)]

    def _resolve(self, query: str) -> dict | None:
        hits = self._reranked(query, 24)
        if not hits:
            return None
        schema = "symbol_id string, file string, short_name string, score double, path_role string, framework_match_score double, adjusted_score double"
        frame = self._frame([tuple(h[f.split(" ")[0]] for f in schema.split(", ")) for h in hits], schema)
        auxiliary = any(some & set(word_tokens(query)) for some in ranking.AUXILIARY_WORDS.values())
        row = ranking.resolve_query(frame, "symbol_id", auxiliary).first()
        if row is None:
            return None
        best = next(h for h in hits if h["symbol_id"] == row["symbol_id"])
        others = [h for h in hits if h is not best][:5]
        margin = f", {row['score_gap']} above {others[0]['short_name']}" if others else ""
        return {
            "query": query, "target": best["file"], **{k: row[k] for k in ("symbol", "owner", "adjusted_score", "score_gap", "score_ratio", "path_role", "selection_confidence")}, "match_symbol_id": best["symbol_id"],
            "selection_reason": f"{best['short_name']} in {best['file']}, a {row['path_role']} path{margin}.",
            "alternatives": [{k: h[k] for k in ("symbol_id", "file", "short_name", "adjusted_score", "path_role")} | {"rejected_reason": _rejected(best, h)} for h in others],
        }

    # graph

    def find_references(self, symbol: str, file_path: str | None = None, owner: str | None = None, scope: str | None = None) -> DataFrame:
        """(file, category, line, kind, source, times) of usages: index edges, ``times`` being how many definitions a call may mean, and lines of
        files whose calls the index lacks: those that its identifiers name."""
        bare = symbol.rsplit(".", 1)[-1]
        means = graph.callee_match(self.tables["symbols"], bare, owner=owner)
        if file_path:
            means = means.where(F.col("path") == file_path)
        found = lambda: index.usages(self.tables, means, index.few(self.tables, means)).select("file", "line", "kind", F.lit("index").alias("source"), "times")
        both = self._small(found, "usages", bare, owner, file_path)
        if self._scanned:
            scanned = self._scanned_usages(bare, owner).select("file", "line", "kind", F.lit("scan").alias("source"), F.lit(1).cast("long").alias("times"))
            both = both.unionByName(scanned.join(both.select("file").dropDuplicates(), "file", "left_anti"))
        both = both.withColumn("category", self._category(F.col("file")))
        both = both.where(graph.trusted(F.lit(bare), F.col("kind"), F.col("source"), F.col("category"), F.col("file"), scoped=bool(owner)))
        return both if scope is None else both.where(graph.in_scope(F.col("category"), F.col("file"), scope))

    def _scanned_usages(self, bare: str, owner: str | None) -> DataFrame:
        """(file, line, kind) by the text of lines, of files that the index's edges don't cover; their lines are those of the identifier."""
        word = textindex.key_word(bare)
        if word:
            at = self.tables["identifiers"].where(F.col("identifier") == word).select("path", "lines")
        else:
            at = textindex.candidates(self.tables["grams"], self.tables["gram_files"], textindex.literal_condition(bare)).select("path", F.lit(None).cast("array<int>").alias("lines"))
        if self.stale is not None:  # all lines of what changed since
            at = at.join(self.stale, "path", "left_anti").unionByName(self.stale.select("path", F.lit(None).cast("array<int>").alias("lines")))
        files = self.files.where(~paths.has_indexed_edges(F.col("path"))).join(at.select("path"), "path", "left_semi")
        texts = self._texts(files)
        if owner:
            # a scan can't tell whose method it is: only files that name the owner count
            texts = texts.where(F.col("text").contains(owner))
        lines = textsearch.lines_of(texts.join(at, "path"), "path", "text", only="lines")
        kind = F.lit(None).cast("string")
        for lang in self._scanned:
            kind = F.when(paths.extension(F.col("file")).isin(list(lang.extensions)), syntax.classify_usage(F.col("text"), bare, lang)).otherwise(kind)
        return lines.where(F.col("text").contains(bare)).select("file", "line", kind.alias("kind")).where("kind IS NOT NULL")

    def _change(self, path: str, symbol: dict, change: str, limit: int) -> dict[str, Any]:
        name, owner = names_of(symbol["short_name"])
        usages = self.find_references(name, None if owner is None else path, owner).where(F.col("file") != path).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            keys = ("file", "category", "count", "evidence_source", "strongest_usage", "usage_types")
            found = graph.direct_callers(usages, "file", "line", "kind", "category", limit, source="source", times="times").orderBy("rank").collect()
            callers = [{k: r[k] for k in keys} | {"snippets": [s.asDict() for s in r["snippets"]]} for r in found]
            indirect = []
            if callers:
                frame = self._frame([(c["file"],) for c in callers], "file string")
                via = [c["file"] for c in callers][: graph.MAX_EXPANDED]
                impacts = graph.impact(self._edges(self.tables["symbols"].where(F.col("path").isin(via) & (F.length("short_name") > 2)), "via", *via), "origin", "symbol", "file")
                beyond = graph.indirect_dependents(frame.limit(graph.MAX_EXPANDED), impacts, path).join(F.broadcast(frame), "file", "left_anti").withColumn("category", self._category(F.col("file")))
                order = [F.desc(risk.weight(F.col("category"), risk.CATEGORY_WEIGHTS)), F.desc("count"), "file"]
                indirect = [r.asDict() for r in beyond.orderBy(*order).limit(limit).collect()]
            categories = sorted({c["category"] for c in callers + indirect})
            scored = graph.weighted_risk(usages, [], "file", "kind", "category", change, times="times")
            top = scored.orderBy(F.desc("score"), "file").limit(10).agg(F.sort_array(F.collect_list(F.struct("score", "file", "category", "count")), asc=False).alias("top"))
            kinds = usages.agg(F.collect_set("kind").alias("kinds"))
            one = graph.risk_summary(scored, []).crossJoin(top).crossJoin(kinds)  # one row each
            combined, level = graph.blast_radius(F.coalesce("risk_score", F.lit(0.0)), F.lit(len(indirect)), F.lit(len(categories)))
            total = one.select("*", combined.alias("combined"), level.alias("blast_level")).first()
        finally:
            usages.unpersist()
        high = [{"file": r["file"], "category": r["category"], "score": r["score"] / 1000, "count": r["count"]} for r in total["top"] if r["score"] >= 1000 * risk.HIGH_RISK][:5]
        return {
            "direct_callers": callers, "indirect_dependents": indirect, "kinds": set(total["kinds"]), "risk_level": total["risk_level"] or "low", "ripple": [r["file"] for r in total["top"]],
            "blast_radius": {"risk_level": total["blast_level"], "risk_score": total["combined"], "direct_files": len(callers), "direct_usages": total["usages"] or 0, "indirect_files": len(indirect), "total_files": len(callers) + len(indirect), "categories": categories, "high_risk_files": high},
        }

    def get_class_hierarchy(self, name: str, start_index: int = 0, max_results: int = 1000) -> dict[str, Any]:
        """What a class extends, implements and mixes in, and what does so with it; a page of ``total`` relations."""
        found = self.tables["inherits"].where(F.col("end") == name).select("direction", "kind", "name", F.col("path").alias("file")).dropDuplicates()
        out: dict[str, Any] = {"class": name, "extends": [], "implements": [], "mixes_in": [], "extended_by": [], "implemented_by": [], "mixed_into": []}
        keys = {"parent": {"extends": "extends", "implements": "implements", "mixes_in": "mixes_in"}, "child": {"extends": "extended_by", "implements": "implemented_by", "mixes_in": "mixed_into"}}
        sized = found.orderBy("name", "file", "direction", "kind").offset(start_index).limit(max_results).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))  # one row
        rows = sized.orderBy("name", "file", "direction", "kind").collect()
        out["total"] = rows[0]["total"] if rows else found.count() if start_index else 0
        for r in rows:
            out[keys[r["direction"]][r["kind"]]].append({"name": r["name"], "file": r["file"]} if r["direction"] == "child" else r["name"])
        return out

    def get_impact_analysis(self, file_path: str) -> dict[str, Any]:
        """Which other files use a file's symbols."""
        own = self._edges(self._own(file_path), file_path)
        found = graph.impact(own.where(F.length("symbol") > 2), "origin", "symbol", "file")
        rows = [r.asDict() for r in found.orderBy(F.desc("referenced_in"), "symbol").collect()]
        reached = graph.affected(own, "origin", "file").first()
        return {"status": "success", "file": file_path, "impacts": rows, "affected_files": reached["affected"] if reached else 0, "risk_level": reached["risk"] if reached else "low"}

    def get_ripple_effect(self, file_path: str, symbol: str, change_type: str = "modify", owner: str | None = None) -> dict[str, Any]:
        """A symbol's external usages by category, with their weighted risk."""
        usages = self.find_references(symbol, None if owner is None else file_path, owner).where(F.col("file") != file_path)
        scored = graph.weighted_risk(usages, [], "file", "kind", "category", change_type, times="times")
        weights = scored.groupBy("category").agg(F.sum("score").alias("s"))
        rows = graph.ripple(usages, "file", "line", "kind", "category", times="times").join(weights, "category").orderBy(F.desc("s"), "category").collect()
        total = graph.risk_summary(scored, []).first()
        listed = [{"category": r["category"], "files": r["files"], "usages": r["usages"], "names": r["names"][:15], "examples": [{"file": e["file"], "usages": [u.asDict() for u in e["usages"]]} for e in r["examples"][:15]]} for r in rows]
        return {"status": "success", "risk_score": total["risk_score"] or 0.0, "risk_level": total["risk_level"] or "low", "categories": listed}

    def get_project_snapshot(self) -> dict[str, Any]:
        counts = project.count_by(self.files, extension=paths.extension(F.col("path")), category=self._category(F.col("path"))).collect()
        out: dict[str, Any] = {"status": "success", "language": self.structure.language, "framework": self.structure.framework, "total_files": self.files.count()}
        for dimension in ("extension", "category"):
            out[f"by_{dimension}"] = {r["value"]: r["n"] for r in sorted(counts, key=lambda r: (-r["n"], r["value"])) if r["dimension"] == dimension}
        if self.tables is not None:
            s, f = self.tables["symbols"], self.tables["files"]
            methods = project.owner_method_counts(s.where(F.col("type").isin("method", "function")), ["path"], "short_name").select(F.col("path").alias("_p"), "owner", "methods")
            listed = s.where("type = 'class'").join(methods, (F.col("path") == F.col("_p")) & (F.col("short_name") == F.col("owner")), "left").select("path", "short_name", "line", F.coalesce("methods", F.lit(0)).alias("methods"))
            out["classes"] = [r.asDict() for r in listed.orderBy("path", "line").limit(100).collect()]
            per_file = s.where(F.col("type").isin("class", "function", "method", "interface")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
            out["hotspots"] = [r.asDict() for r in project.hotspots(f, per_file, "path", "line_count", "n").collect()]
            out["import_graph"] = {r["file"]: r["imports"] for r in project.import_graph(f, "path", "imports").collect()}
        return out

    def get_context(self, target: str = "", intent: str = "before_edit", symbol: str | None = None, include_source: bool = True, max_related: int | None = None, change_type: str = "modify", owner: str | None = None, query: str | None = None) -> dict[str, Any]:
        for df in self._pinned:
            df.unpersist()
        self._pinned = []
        max_related = self.setting("max_related") if max_related is None else max_related
        intent, change = (intent or "before_edit").strip().lower(), (change_type or "modify").strip().lower()
        if intent not in INTENTS:
            return {"status": "error", "message": f"unknown intent {intent}; there are {sorted(INTENTS)}"}
        if change not in CHANGES:
            return {"status": "error", "message": f"unknown change type {change}; there are {sorted(CHANGES)}"}
        if target.startswith(os.path.join(".repolens", "output")):
            if wrong := validation.file_path(target):
                return {"status": "error", "message": wrong}
            with open(os.path.join(self._root(), target), encoding="utf-8") as f:
                return json.load(f)
        resolution = self._resolve(query) if query and not target else None
        if resolution:
            target, symbol, owner = resolution["target"], symbol or resolution["symbol"], owner or resolution["owner"] or None
        s = self.structure
        out: dict[str, Any] = {
            "status": "success", "intent": intent, "change_type": change,
            "project": {"root_name": os.path.basename(self._root()), "language": s.language, "framework": s.framework, "scan_dirs": s.folders},
            "target": {"file_path": target or None, "symbol": symbol, "canonical_symbol": None, "category": None},
            "overview": "", "file_context": {}, "symbol_context": {}, "relationship_context": {}, "impact_context": {}, "direct_callers": [], "indirect_dependents": [],
            "blast_radius": {}, "risk_reasons": [], "safe_edit_hints": [], "related_files": [], "related_file_reasons": [],
            "relationship_buckets": {"certain": [], "probable": [], "inferred": []}, "missing_context": [], "confidence": "high", "confidence_details": {}, "edit_plan": {},
            "suggested_next_steps": [],
        }
        if resolution:
            out["query_resolution"] = resolution
        if intent == "project":
            return out | {"project_snapshot": self.get_project_snapshot(), "overview": f"{s.language} project, framework {s.framework}"}
        if not target:
            if query:
                return out | {"status": "needs_target", "candidates": self._candidates(query)}
            return {"status": "error", "message": "a target or a query is needed"}
        if self.tables is None:
            out["missing_context"].append("deep_index")
            return self._finished(out, 0.0)
        row = self.tables["files"].where(F.col("path") == target).withColumn("category", self._category(F.col("path"))).withColumn("role", paths.path_role(F.col("path"))).first()
        if row is None:
            return {"status": "error", "message": f"{target} is not in the index"}
        out["target"]["category"] = row["category"]
        mine = self.tables["symbols"].where(F.col("path") == target)
        summary = project.file_summary(mine, "path", "type", "signature", "symbol_id", "short_name", "line").first()
        out["file_context"] = {k: row[k] for k in ("language", "line_count", "imports", "exports", "package")} | ({k: summary[k] for k in ("functions", "classes", "methods", "symbol_count")} if summary else {})
        own = self._edges(self._own(target), target)
        level = graph.affected(own, "origin", "file").select(F.col("origin").alias("_o"), F.col("affected"), "risk")
        impacts = graph.impact(own.where(F.length("symbol") > 2), "origin", "symbol", "file").join(F.broadcast(level), F.col("origin") == F.col("_o"), "right")  # one row
        used = impacts.withColumn("generic", names.is_generic_hook(F.col("symbol"))).orderBy(F.desc("referenced_in"), "symbol").limit(50).collect()
        symbols = [{k: r[k] for k in ("origin", "symbol", "referenced_in", "total_usages", "files")} for r in used if r["symbol"] is not None]
        out["impact_context"] = {"symbols": symbols[:5], "affected_files": used[0]["affected"] if used else 0, "risk_level": used[0]["risk"] if used else "low"}
        lanes: list[tuple] = [(f, "file_impact", None, None, None) for f in sorted({f for r in used if r["symbol"] is not None and not r["generic"] for f in r["files"]})]
        if summary and summary["classes"] and intent in ("file", "impact"):
            out["relationship_context"] = self.get_class_hierarchy(summary["classes"][0].rsplit(".", 1)[-1])
        if symbol and intent != "file":
            found = self._symbol(target, symbol, owner)
            out["symbol_context"] = {"found": found is not None, "symbol": symbol}
            if found:
                out["target"]["canonical_symbol"] = found["short_name"]
                out["symbol_context"] |= {"canonical_name": found["short_name"], "type": found["type"], "line": found["line"], "signature": found["signature"], "docstring": found["docstring"], **({"source": self._code(target, found) or ""} if include_source else {})}
                changed = self._change(target, found, change, max_related)
                for k in ("direct_callers", "indirect_dependents", "blast_radius"):
                    out[k] = changed[k]
                lanes += [(c["file"], "direct_caller", c["strongest_usage"], c["evidence_source"], c["category"]) for c in out["direct_callers"]]
                lanes += [(c["file"], "indirect", None, None, c["category"]) for c in out["indirect_dependents"]] + [(f, "ripple", None, None, None) for f in changed["ripple"]]
                out["risk_reasons"], out["safe_edit_hints"] = self._advice(target, out, changed)
        mates = cochange.peers(self.tables["cochanges"], target, 7)
        peers = mates.crossJoin(F.broadcast(cochange.risk_gate(mates))).orderBy(F.desc("count"), F.desc("last_seen"), "peer").collect()  # the gate is one row
        lanes += [(p["peer"], "co_change", None, None, None) for p in peers if p["count"] >= 2]
        if peers and peers[0]["fires"]:
            out["risk_reasons"] = (out["risk_reasons"] + [f"History changes it together with {peers[0]['strong']} files, most with {', '.join(p['peer'] for p in peers[:3])}."])[:8]
        wired = self._wired(target, out["target"]["canonical_symbol"] or symbol, [c["file"] for c in out["direct_callers"]], sorted({f for f, *_ in lanes}))
        lanes += [(f, "framework_entrypoint", None, None, None) for f in wired]
        near = {f for f, lane, *_ in lanes if lane in ("direct_caller", "indirect", "ripple", "file_impact")} - set(wired)
        if len(near) < evidence.SEMANTIC_BELOW:
            lanes += [(f, "semantic_related", None, None, None) for f in self._alike(target, row["role"], out, max_related)]
        reasons = [{"file": target, "role": "definition", "certainty": "certain", "priority": 100}]
        if lanes:
            frame = self._frame(lanes, "file string, lane string, strongest string, source string, category string")
            entry, lane = self._entry(F.col("file")), F.col("lane")
            grade = (
                F.when(lane == "direct_caller", evidence.caller_grade(F.col("strongest"), F.col("source"), F.col("category"), entry)).when(lane == "indirect", evidence.indirect_grade(entry))
                .when(lane == "file_impact", evidence.impact_grade(entry)).otherwise(evidence.lane_grade(lane))
            )
            named = entry & F.col("file").isin(wired) if wired else F.lit(False)
            for r in evidence.related_reasons(frame, target, max(1, max_related - 1), grade=grade, wired=named).orderBy("rank").collect():
                reasons.append({k: r[k] for k in ("file", "role", "certainty", "priority")})
        for r in reasons:
            r["evidence_type"], r["reason"] = EVIDENCE[r["role"]]
            r["evidence_strength"] = STRENGTH[r["certainty"]]
        out["related_file_reasons"] = reasons
        for r in reasons:
            out["relationship_buckets"][r["certainty"]].append(r["file"])
        listed = [[target], [c["file"] for c in out["direct_callers"]], [c["file"] for c in out["indirect_dependents"]], [r["file"] for r in reasons]]
        merged = evidence.related_files([self._frame(list(enumerate(some)), "pos long, file string") for some in listed if some], max_related)
        out["related_files"] = [r["file"] for r in merged.orderBy("rank").collect()]
        penalty = 0.0
        if resolution:
            penalty = 0.18 * (resolution["path_role"] != "source") + 0.12 * (resolution["score_gap"] < 0.35) + 0.08 * ((resolution["score_ratio"] or 9) < 1.12)
        return self._finished(out, penalty)

    def _wired(self, target: str, canonical: str | None, callers: list[str], known: list[str]) -> list[str]:
        """Files by which the framework wires the target: of its wiring folders, and known entry points, those that name it."""
        if self.structure.framework not in evidence.FRAMEWORKS or not (wanted := evidence.hints(target, canonical, callers)):
            return []
        folders = [self.structure.folders[c] for c in evidence.WIRED_CATEGORIES if c in self.structure.folders] + evidence.WIRED_FOLDERS
        also = F.col("path").isin(known) & self._entry(F.col("path")) if known else None
        inside = reduce(or_, [F.col("path").startswith(f.rstrip("/") + "/") for f in folders])
        source = self._texts(self.files.where(self.structure.holds(F.col("path")) & (inside if also is None else inside | also)))
        return sorted(r["file"] for r in evidence.wired_files(source, folders, wanted, target, also=also).collect())

    def _alike(self, target: str, role: str, out: dict, limit: int) -> list[str]:
        """Files whose symbols read like the target's name and docstring; for a source file only source files."""
        about = [out["target"]["canonical_symbol"] or out["symbol_context"].get("symbol"), (out["symbol_context"].get("docstring") or "")[:160]]
        query = " ".join(x for x in about if x) or os.path.basename(target)
        hits = [h["file"] for h in self._reranked(query, 2 * limit) if h["file"] != target and (role != "source" or h["path_role"] == "source")]
        return list(dict.fromkeys(hits))[:limit]

    def _advice(self, path: str, out: dict, changed: dict) -> tuple[list[str], list[str]]:
        direct, indirect, kinds = out["direct_callers"], out["indirect_dependents"], changed["kinds"]
        files = [c["file"] for c in direct + indirect]
        categories = set(out["blast_radius"]["categories"])
        reasons = [f"{len(direct)} files use it directly."] if len(direct) >= 3 else []
        reasons += [f"{len(indirect)} more files depend on those."] if indirect else []
        reasons += [text for kind, text in USAGE_REASONS.items() if kind in kinds]
        reasons += ["Entry points depend on it."] if categories & {"controllers", "routes", "middleware"} else []
        reasons += ["Domain code depends on it."] if categories & {"models", "services"} else []
        reasons += ["Tests cover the affected path."] if any("test" in f.lower() for f in files) else []
        reasons += ["Sensitive paths (auth, payment, webhook) are affected."] if any(k in f.lower() for f in files for k in ("auth", "payment", "webhook")) else []
        reasons += ["Some files carry a high risk of their own."] if out["blast_radius"]["high_risk_files"] else []
        hints = [f"Look at {', '.join(c['file'] for c in direct[:3])} first."] if direct else []
        hints += ["Keep the contract, or change its subtypes with it."] if "extends_or_implements" in kinds else []
        hints += ["Keep how it is constructed, or change the places that do."] if "instantiation" in kinds else []
        hints += ["Keep its name and signature unless all callers change with it."] if kinds & {"static_call", "method_call"} else []
        hints += ["Check what depends on its callers too."] if indirect else []
        hints += ["Change it in small steps."] if changed["risk_level"] in ("high", "critical") else []
        return (reasons or [f"The change looks local to {path}."])[:6], hints[:6]

    def _finished(self, out: dict, penalty: float) -> dict:
        found, missing = out["symbol_context"].get("found", False), out["missing_context"]
        known = [not missing, found, bool(out["blast_radius"]), len(out["direct_callers"]), len(out["indirect_dependents"]), out.get("query_resolution", {}).get("path_role") == "source", "deep_index" not in missing, bool(out["target"]["symbol"]) and not found, penalty]
        score, level = self._session.range(1).select(*evidence.confidence(*map(F.lit, known))).first()
        out["confidence"], out["confidence_details"] = level, {"score": score, "level": level, "missing_context": missing}
        target, related = out["target"], [r for r in out["related_file_reasons"] if r["role"] != "definition"]
        coordinated = out["change_type"] in ("rename", "signature_change", "contract_change")
        tests = [r["file"] for r in related if r["role"] in ("direct_caller", "file_scope_caller", "indirect_dependent") and "test" in r["file"].lower()]
        steps = [f"Edit {target['file_path']}."] + (["Change all direct callers in the same patch."] if coordinated and out["direct_callers"] else []) + (["Then check the indirect dependents."] if out["indirect_dependents"] else [])
        out["edit_plan"] = {
            "change_type": out["change_type"], "coordination_level": "high" if coordinated or out["change_type"] == "delete" else out["blast_radius"].get("risk_level", "low"),
            "primary_file": target["file_path"], "primary_symbol": target["canonical_symbol"] or target["symbol"], "touch_files": [target["file_path"], *(r["file"] for r in related)][:6],
            "verification_targets": tests[:6], "steps": steps + ([f"Run {', '.join(tests[:3])}."] if tests else ["Read the related files again."]),
        }
        out["overview"] = f"{target['canonical_symbol'] or target['file_path']}: {len(out['direct_callers'])} direct callers, {len(out['indirect_dependents'])} indirect, risk {out['blast_radius'].get('risk_level', 'unknown')}."
        out["suggested_next_steps"] = ["build_deep_index"] if missing else [f"get_edit_region {target['file_path']}"]
        return out

    def spilled(self, out: dict[str, Any]) -> dict[str, Any]:
        """A large answer goes to a file in the project; the main keys and the path remain."""
        if len(text := json.dumps(out, default=str)) < self.setting("spill_chars"):
            return out
        folder = os.path.join(self._root(), ".repolens", "output")
        os.makedirs(folder, exist_ok=True)
        name = f"{uuid.uuid4().hex}.json"
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
        old = sorted(os.listdir(folder), key=lambda n: os.path.getmtime(os.path.join(folder, n)), reverse=True)
        for n in old[SPILLS_KEPT:]:
            os.remove(os.path.join(folder, n))
        return {k: out[k] for k in SPILL_KEYS if k in out} | {"detail_file": f".repolens/output/{name}"}


def names_of(short_name: str) -> tuple[str, str | None]:
    """The member and the owner of a dotted name."""
    owner, _, member = short_name.rpartition(".")
    return member, owner or None


def _rejected(best: dict, other: dict) -> str:
    """Why a hit isn't the target of a query."""
    if best["path_role"] == "source" != other["path_role"]:
        return f"A {other['path_role']} path, and there is a source path."
    if other["adjusted_score"] < best["adjusted_score"]:
        return f"A lower score: {other['adjusted_score']} under {best['adjusted_score']}."
    return "Equal, but later in order."

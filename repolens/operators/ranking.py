"""Vector search, rank fusion, reranking and query resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import names, paths
from repolens.functions.tokenize import compact, tokens, words

RRF_K = 60
# Factors of the rerankers.
TYPE_WEIGHTS = {"method": 1.15, "function": 1.05, "class": 0.90, "interface": 0.75, "trait": 0.75, "enum": 0.85}
FRAMEWORK_MARKERS = [
    "@injectable", "@controller", "@service", "@component", "@route", "@get", "@post", "@put", "@patch", "@delete", "@restcontroller", "@app.route", "@router.", "#[route",
]
ROLE_FACTORS = {"test": 0.72, "docs": 0.45, "example": 0.35, "fixture": 0.18, "generated": 0.08}
ROLE_PRIORITY = {"source": 5, "test": 4, "docs": 3, "example": 2, "fixture": 1, "generated": 0}
# Words by which a query asks for paths that aren't source.
AUXILIARY_WORDS = {
    "test": {"test", "tests", "spec", "specs"}, "fixture": {"fixture", "fixtures", "eval", "evals"}, "example": {"example", "examples", "sample", "samples"},
    "docs": {"doc", "docs", "documentation"}, "generated": {"generated", "build", "dist", "cache", "output"},
}
# Words that name a language.
LANGUAGE_WORDS = {"php", "python", "javascript", "typescript", "java", "kotlin", "dart", "flutter", "go", "golang", "zig", "csharp", "node", "nodejs", "reactnative"}
# Words that name a framework's files.
FRAMEWORK_WORDS = {
    "route", "routes", "router", "web", "api", "controller", "controllers", "middleware", "navigation", "screen", "page", "pages", "homepage", "home", "index",
    "bootstrap", "config", "entrypoint", "method",
}


def cosine_top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(key, score): cosines with one query vector, ties by key; vectors of another length or without length are skipped."""
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    q = F.array(*[F.lit(float(x) / norm if norm else 0.0) for x in query])
    summed = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    wide = vectors.where(F.size(vector) == len(query)).select(key, F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    measured = wide.select(key, summed(F.zip_with("_v", q, lambda a, b: a * b)).alias("_dot"), F.sqrt(summed(F.transform("_v", lambda x: x * x))).alias("_norm"))
    return measured.where("_norm > 0").select(key, F.round(F.col("_dot") / F.col("_norm"), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def reciprocal_rank_fusion(rankings: list[DataFrame], key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """(key, score) from rankings with (key, rank from 1), each a bounded top list."""
    merged = None
    for r in rankings:
        part = r.select(key, (1.0 / (k + F.col("rank"))).alias("part"))
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy(key).agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)]) if values else F.array().cast("array<string>")


def intent_factor(query: str, short: Column, signature: Column, docstring: Column, kind: Column) -> Column:
    """What a hit's score is multiplied by: its type, a name match, an owner-only match, a framework marker."""
    from repolens.functions.pytokens import tokenize

    asked = _literals(set(tokenize(query)))
    method, owner = tokens(names.member(short)), tokens(names.owner(short))
    named = F.arrays_overlap(method, asked)
    content = named | F.arrays_overlap(tokens(signature), asked) | F.arrays_overlap(tokens(docstring), asked)
    factor = F.lit(1.0)
    for name, w in TYPE_WEIGHTS.items():
        factor = F.when(F.lower(kind) == name, w).otherwise(factor)
    marked = F.lit(False)
    for marker in FRAMEWORK_MARKERS:
        marked = marked | F.lower(F.coalesce(signature, F.lit(""))).contains(marker)
    return (
        factor * F.when(named, 1.55).otherwise(1.0) * F.when(F.arrays_overlap(owner, asked) & ~content, 0.65).otherwise(1.0) * F.when(marked, 1.10).otherwise(1.0)
    )


def intent_rerank(hits: DataFrame, query: str, score: str = "score", short: str = "short_name", signature: str = "signature", docstring: str = "docstring", kind: str = "type") -> DataFrame:
    """``hits`` with its score weighed by intent; untouched if the query has no tokens."""
    from repolens.functions.pytokens import tokenize

    if not tokenize(query):
        return hits
    return hits.withColumn(score, F.col(score) * intent_factor(query, F.col(short), F.col(signature), F.col(docstring), F.col(kind)))


def path_rerank(hits: DataFrame, query: str, score: str = "score", file: str = "file", short: str = "short_name", category: Column | None = None) -> DataFrame:
    """``hits`` with path_role, framework_match_score and adjusted_score."""
    from repolens.functions.pytokens import word_tokens

    asked = set(word_tokens(query))
    wanted = {role for role, some in AUXILIARY_WORDS.items() if some & asked}
    languages, frameworks = asked & LANGUAGE_WORDS, asked & FRAMEWORK_WORDS
    path, name = F.col(file), F.col(short)
    role = paths.path_role(path)
    small_name, small_path = compact(name), compact(path)
    has = lambda some, *where: F.lit(False) if not some else _any([w.contains(t) for t in sorted(some) for w in where])
    by_role = F.when(role == "source", 1.12)
    for r, f in ROLE_FACTORS.items():
        by_role = by_role.when(role == r, 1.02 if r in wanted else f)
    adjusted = F.col(score) * by_role.otherwise(1.0)
    everything = _literals(asked)
    adjusted = adjusted * F.when(F.arrays_overlap(words(name), everything), 1.1).when(F.arrays_overlap(words(paths.basename(path)), everything), 1.03).otherwise(1.0)
    plain = {"".join(c for c in t if c.isascii() and c.isalnum()) for t in asked} - {""}
    adjusted = adjusted * F.when(has(plain, small_name, small_path), 1.08).otherwise(1.0)
    if languages:
        adjusted = adjusted * F.when(has(languages, small_name, small_path), 1.35).otherwise(0.88)
    cat = F.lower(F.coalesce(category, F.lit(""))) if category is not None else F.lit("")
    lower = F.lower(name)
    steps = [
        (bool(frameworks), cat.isin("controllers", "routes", "router", "navigation", "middleware"), 1.14),
        (bool(frameworks & {"controller", "controllers"}), (cat == "controllers") | small_path.contains("controller"), 1.16),
        (bool(frameworks & {"route", "routes", "router", "web", "api"}), cat.isin("routes", "router") | has({"route", "router", "web"}, small_path), 1.08),
        (bool(frameworks & {"middleware", "navigation", "bootstrap", "config"}), has({"middleware", "navigation", "bootstrap", "config"}, small_path), 1.08),
        ("method" in frameworks, name.contains("."), 1.06),
        ("index" in frameworks, lower.endswith(".index") | (lower == "index"), 1.18),
        (bool(frameworks & {"home", "homepage"}), has({"home"}, small_name, small_path), 1.14),
        (bool(frameworks & {"page", "pages"}), has({"page"}, small_name, small_path), 1.10),
    ]
    match = F.lit(1.0)
    for applies, condition, factor in steps:
        if applies:
            match = match * F.when(condition, factor).otherwise(1.0)
    return hits.withColumn("path_role", role).withColumn("framework_match_score", F.round(match, 4)).withColumn("adjusted_score", F.round(adjusted * match, 4))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def role_priority(role: Column) -> Column:
    out = F.lit(0)
    for name, p in ROLE_PRIORITY.items():
        out = F.when(role == name, p).otherwise(out)
    return out


def resolve_query(ranked: DataFrame, key: str, wants_auxiliary: bool = False) -> DataFrame:
    """At most one row: the best of a bounded ranked list (``path_rerank``'s columns) if it is clear enough.

    A source hit is preferred unless the query asks for something else. Weak or close calls give no row.
    """
    # The gaps, ratios and framework scores below which a hit is no clear target.
    order = [F.desc("adjusted_score"), F.desc(role_priority(F.col("path_role"))), F.desc("short_name"), F.col(key)]
    first = [F.desc(F.col("path_role") == "source"), *order] if not wants_auxiliary else order
    place = ranked.withColumn("_top", F.row_number().over(Window.orderBy(*first))).withColumn("_rest", F.row_number().over(Window.orderBy(F.col("_top") == 1, *order)))
    top = place.where("_top = 1")
    second = place.where("_top <> 1 AND _rest = 1").select(F.col("adjusted_score").alias("_second"))
    both = top.crossJoin(second.agg(F.max("_second").alias("_second")))  # one row each
    score, other = F.col("adjusted_score"), F.coalesce("_second", F.lit(0.0))
    gap = F.round(score - other, 4)
    ratio = F.when(other != 0, F.round(score / F.greatest(other, F.lit(0.0001)), 4))
    close = lambda most: ratio.isNull() | (ratio < most)
    has_second = F.col("_second").isNotNull()
    weak = has_second & (gap < 0.35) & close(1.12)
    unclear = F.when(weak, F.col("framework_match_score") < 1.15).when(has_second & (gap < 0.2), F.col("framework_match_score") < 1.25).otherwise(False)
    off = (F.col("path_role") != "source") & (gap < 1.0) & close(1.35)
    return both.where((score >= 0.5) & ~off & ~unclear).select(
        F.col(key), score.alias("adjusted_score"), gap.alias("score_gap"), ratio.alias("score_ratio"), "path_role",
        F.when(gap >= 1.0, "strong").otherwise("moderate").alias("selection_confidence"), names.member(F.col("short_name")).alias("symbol"), names.owner(F.col("short_name")).alias("owner"),
    )

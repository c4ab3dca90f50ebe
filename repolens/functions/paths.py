"""Predicates and classifications of paths as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the path filters accept and leave out.
EXTENSIONS = """
.py .pyw .js .jsx .ts .tsx .mjs .cjs .java .c .cpp .h .hpp .cxx .cc .hxx .hh .cs .go .m .mm .rb .php .swift .kt .kts .rs .scala .sh .bash .zsh .ps1
.bat .cmd .r .R .pl .pm .lua .dart .hs .ml .mli .fs .fsx .clj .cljs .vim .zig .zon .html .htm .css .scss .sass .less .stylus .styl .md .mdx .json .jsonc
.xml .yml .yaml .vue .svelte .astro .jsp .jspx .jspf .tag .tagx .gsp .properties .gradle .groovy .proto .hbs .handlebars .ejs .pug .ftl .mustache .liquid
.erb .sql .ddl .dml .mysql .postgresql .psql .sqlite .mssql .oracle .ora .db2 .proc .procedure .func .function .view .trigger .index .migration .seed
.fixture .schema .cql .cypher .sparql .gql .liquibase .flyway
""".split()
EXCLUDED_DIRS = """
.git .svn .hg .bzr node_modules __pycache__ .venv venv vendor bower_components test_env dist build target out bin obj storage .idea .vscode .vs
.sublime-workspace .pytest_cache .coverage .tox .nyc_output coverage htmlcov .DS_Store Thumbs.db desktop.ini
""".split()
EXCLUDED_FILES = ["*.tmp", "*.temp", "*.swp", "*.swo", "*.bak", "*~", "*.orig", "*.log", "package-lock.json", "yarn.lock", "Pipfile.lock"]
VISIBLE_HIDDEN = [".env", ".gitignore"]
INDEXED_EDGE_EXTENSIONS = [".py", ".pyw", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".kt", ".kts", ".cs", ".dart", ".go"]
ENTRY_CATEGORIES = ["routes", "router", "navigation", "middleware", "bootstrap", "config"]


def normalised(path: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: ``**`` crosses slashes, ``*`` and ``?`` don't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = pattern[i]
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r".^$+{}[]|()\\" else c)
        i += 1
    return f"^{out}$"


def name_regex(pattern: str) -> str:
    """fnmatch-style: ``*`` crosses everything."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or ("\\" + c if c in r".^$+{}[]|()\\" else c) for c in pattern) + "$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix of the base name with its dot, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))


def accepted(path: Column) -> Column:
    """The scan's filter: no excluded or hidden folder above, a supported extension, no excluded or hidden name."""
    parts = F.split(normalised(path), "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    hidden = lambda p: p.startswith(".") & ~F.array_contains(listed(VISIBLE_HIDDEN), p)
    clean = ~F.exists(above, lambda p: (p != "") & (hidden(p) | F.array_contains(listed(EXCLUDED_DIRS), p)))
    name = basename(path)
    unwanted = hidden(name)
    for pattern in EXCLUDED_FILES:
        unwanted = unwanted | name.rlike(name_regex(pattern))
    return clean & extension(path).isin([e.lower() for e in EXTENSIONS]) & ~unwanted


def pruned(name: str) -> bool:
    """Whether a folder of this name is left out with all that is below it; the rule of ``accepted``, for walking a tree."""
    return name in EXCLUDED_DIRS or (name.startswith(".") and name not in VISIBLE_HIDDEN)


def match_tier(path: Column, pattern: str) -> Column:
    """0 to 2 for the tiers of ``find_files``, null for no match. Only the best tier that any path reaches counts."""
    exact, nested = glob_regex(pattern), glob_regex("**/" + pattern)
    if pattern == "*":
        return F.lit(0)
    if "/" in pattern:
        return F.when(path.rlike(exact), 0)
    folded = F.lower(path)
    return F.when(path.rlike(exact) | path.rlike(nested), 0).when(folded.rlike(exact.lower()), 1).when(folded.rlike(nested.lower()), 2)


def category(path: Column, folders: Mapping[str, str]) -> Column:
    """The first category, in the mapping's order, whose folder holds the path; null if none does."""
    out = None
    for name, folder in folders.items():
        hit = path.startswith(folder.rstrip("/") + "/")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(None).cast("string") if out is None else out


def path_role(path: Column) -> Column:
    """source, test, fixture, example, docs or generated."""
    whole = F.lower(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"))
    p = F.regexp_replace(whole, "^[./]+", "")
    rooted = F.concat(F.lit("/"), p)
    starts = lambda *heads: p.rlike("^(" + "|".join(heads) + ")/")
    return (
        F.when(whole.rlike(r"^(\./)?\.repolens/output/"), "generated")
        .when(rooted.rlike("/(tests|test|__tests__)/") | starts("src/test", "src/androidtest"), "test")
        .when(starts("evals/fixtures", "fixtures"), "fixture")
        .when(starts("examples", "example", "samples", "sample"), "example")
        .when(starts("docs", "doc"), "docs")
        .otherwise("source")
    )


def framework_role(path: Column, categories: Column) -> Column:
    """``framework_entrypoint`` or null."""
    named = categories.isin(ENTRY_CATEGORIES) | path.rlike("^(bootstrap|config)/") | path.rlike("/(routes|router|navigation|middleware|bootstrap|config)/")
    return F.when(F.coalesce(named, F.lit(False)), "framework_entrypoint")


def has_indexed_edges(path: Column) -> Column:
    """Whether the language's cross-file calls are all in the index."""
    return ~F.lower(path).endswith(".blade.php") & extension(path).isin(INDEXED_EDGE_EXTENSIONS)

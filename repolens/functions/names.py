"""Symbol names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that say nothing about what they do.
GENERIC_HOOKS = ["__construct", "__destruct", "__init__", "__new__", "__call__", "__call", "constructor", "__file_scope__"]
AMBIGUOUS = """
__construct __invoke boot create delete destroy down edit get handle index list mount process render resolve run set show store update up
""".split()


def short_name(symbol_id: Column) -> Column:
    return F.element_at(F.split(symbol_id, "::"), -1)


def is_clean(name: Column) -> Column:
    """1 to 128 characters, none of white space, brackets, quotes, semicolon or comma."""
    return F.length(name).between(1, 128) & ~name.rlike(r"(?U)[\s(){}\[\]\"';,`]")


def is_identifier(name: Column) -> Column:
    """A dotted name whose parts start with an ASCII letter, ``_`` or ``$``."""
    return name.rlike(r"(?U)^[a-zA-Z_$][\w$]*(\.[a-zA-Z_$][\w$]*)*$")


def owner_first(name: Column) -> Column:
    """What is before the first dot; the name itself without one."""
    return F.substring_index(name, ".", 1)


def owner(name: Column) -> Column:
    """What is before the last dot; empty without one."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def member(name: Column) -> Column:
    """What is after the last dot."""
    return F.element_at(F.split(name, r"\."), -1)


def is_generic_hook(name: Column) -> Column:
    return member(name).isin(GENERIC_HOOKS)


def qualified(path: Column, name: Column, namespace: Column) -> Column:
    """``a/b.py``, ``f``, ``ns`` -> ``a.b.ns.f``; null or empty parts are left out."""
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./|/)+", ""), r"\.[^./]+$", "")
    parts = F.array(F.regexp_replace(module, "/", "."), namespace, name)
    return F.concat_ws(".", F.filter(parts, lambda p: p != ""))


def listing_group(kind: Column, signature: Column, symbol_id: Column) -> Column:
    """functions, classes or methods, in the order in which a file's summary lists symbols."""
    sig = F.coalesce(signature, F.lit(""))
    return (
        F.when(sig.startswith("def ") & sig.contains("::"), "methods")
        .when(sig.startswith("def "), "functions")
        .when(sig.startswith("class ") | (kind == "class"), "classes")
        .when(kind == "method", "methods")
        .otherwise("functions")
    )

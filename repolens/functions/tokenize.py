"""Identifier-aware tokenisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in queries about code.
STOP_WORDS = [
    "the", "and", "for", "with", "from", "this", "that", "into", "not", "def", "class", "function", "return", "self", "init", "get", "set", "var", "let",
    "const", "new", "if", "else", "while", "public", "private", "protected", "static", "void", "final", "async", "await", "true", "false", "null", "none", "nil",
]
MIN_LENGTH, MAX_LENGTH = 2, 48

_INNER = r"[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"  #: a word to be split inside, without look-around
_SPLIT = r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def tokens(text: Column) -> Column:
    """Lower-case sub-words of identifiers in ``text``; null gives an empty array."""
    text = F.coalesce(text, F.lit(""))
    # most prose has no word to be split inside; the plain split is far cheaper
    parts = F.when(text.rlike(_INNER), F.split(text, _SPLIT)).otherwise(F.split(text, "[^A-Za-z0-9]+"))
    lowered = F.transform(parts, F.lower)
    # a list this long is a hash lookup; array_contains would compare with every word
    return F.filter(lowered, lambda t: F.length(t).between(MIN_LENGTH, MAX_LENGTH) & ~t.isin(STOP_WORDS))


def weighted_tokens(method: Column, owner: Column, signature: Column, docstring: Column, path: Column) -> Column:
    """A symbol's search tokens: its own name twice, owner, signature and docstring once, every other token of the path."""
    own = tokens(method)
    return F.concat(own, own, tokens(owner), tokens(signature), tokens(docstring), F.filter(tokens(path), lambda _, i: i % 2 == 0))


def words(text: Column) -> Column:
    """Lower-case runs of word characters, letters of any script included."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\W+"), F.lower), lambda t: t != "")


def compact(text: Column) -> Column:
    """Lower case, only ASCII letters and digits left."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: The same in DuckDB, whose regular expressions have no look-around; format with text=<expression>.
SQL_TOKENS = (
    r"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(coalesce({text}, ''), "
    r"'([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda t: lower(t)), "
    f"lambda t: length(t) BETWEEN {MIN_LENGTH} AND {MAX_LENGTH} AND NOT list_contains([{_STOP_SQL}], t))"
)

"""Checks of arguments before anything is planned. Each gives a message, or None if all is well."""

from __future__ import annotations

import re

MAX_PAGE = 1000


def file_path(path: str | None) -> str | None:
    if not path or not path.strip():
        return "a file path is needed"
    if path.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", path):
        return "the path has to be relative to the project"
    if ".." in re.split(r"[\\/]", path):
        return "the path leaves the project"
    return "the path has a NUL character" if "\0" in path else None


def glob(pattern: str | None) -> str | None:
    if not pattern or not pattern.strip():
        return "a pattern is needed"
    if ".." in re.split(r"[\\/]", pattern) or pattern.startswith("/"):
        return "the pattern leaves the project"
    return None


def search_pattern(pattern: str | None, regex: bool = False) -> str | None:
    if not pattern:
        return "a pattern is needed"
    if len(pattern) > 1000:
        return "a pattern has 1000 characters at most"
    if regex:
        try:
            re.compile(pattern)
        except re.error as e:
            return f"not a regular expression: {e}"
        if re.search(r"\(\?<?[=!]", pattern):
            return "look-around isn't supported"
    return None


def page(start: int, size: int) -> str | None:
    if not isinstance(start, int) or start < 0:
        return "a page starts at 0 or later"
    if not isinstance(size, int) or not 1 <= size <= MAX_PAGE:
        return f"a page holds 1 to {MAX_PAGE} rows"
    return None


def extensions(values: list[str]) -> str | None:
    bad = [v for v in values if not re.fullmatch(r"\.[A-Za-z0-9_.+-]+", v)]
    return f"not extensions: {', '.join(bad)}" if bad else None

"""Per-file symbol extraction.

``parse(path, text)`` gives one file's language, symbols, imports and the calls that its own symbols don't answer. It sees one file at a time, so it
runs inside ``mapInArrow``; everything that needs other files is a join on its output.
"""

from __future__ import annotations

from repolens.functions.parsing.dispatch import parse

__all__ = ["parse"]

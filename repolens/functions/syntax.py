"""What languages look like: keywords, accessors and declaration patterns; usages of a symbol on a line."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Syntax:
    name: str
    extensions: tuple[str, ...]
    imports: tuple[str, ...]
    instance: str = "."
    static: str = "."
    variable: str = ""
    comment: str = "//"
    other_comment: str | None = None
    extends: str = "extends"
    implements: str = ""
    mixins: tuple[str, ...] = ()
    class_pattern: str = ""
    function_pattern: str = ""
    import_pattern: str = ""


# The languages' keywords, accessors and patterns.
SYNTAX = {
    s.name: s
    for s in (
        Syntax("php", (".php",), ("use",), "->", "::", "$", implements="implements", mixins=("use",), class_pattern=r"\bclass\s+(\w+)", function_pattern=r"\bfunction\s+(\w+)\s*\(", import_pattern=r"\buse\s+([^;]+);"),
        Syntax("python", (".py", ".pyw"), ("import", "from"), comment="#", other_comment="#", extends="", class_pattern=r"\bclass\s+(\w+)", function_pattern=r"\bdef\s+(\w+)\s*\(", import_pattern=r"\bimport\s+(.+)"),
        Syntax("javascript", (".js", ".jsx", ".mjs", ".cjs"), ("import", "require"), class_pattern=r"\bclass\s+(\w+)", function_pattern=r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*=>)", import_pattern=r"\bfrom\s+['\"]([^'\"]+)"),
        Syntax("typescript", (".ts", ".tsx"), ("import",), implements="implements", class_pattern=r"\bclass\s+(\w+)", function_pattern=r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*=>)", import_pattern=r"\bfrom\s+['\"]([^'\"]+)"),
        Syntax("dart", (".dart",), ("import", "export", "part"), implements="implements", mixins=("with", "mixin"), class_pattern=r"^\s*(?:(?:abstract|base|sealed|final)\s+)?class\s+(\w+)", function_pattern=r"^\s*(?:static\s+)?(?:[\w<>?\[\],]+\s+)+(\w+)\s*\([^;\n]*\)\s*(?:async\s*)?(?:\{|=>)", import_pattern=r"\b(?:import|export|part)\s+['\"]([^'\"]+)"),
        Syntax("go", (".go",), ("import",), extends="", class_pattern=r"\btype\s+(\w+)\s+struct\b", function_pattern=r"\bfunc\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", import_pattern=r"\"([^\"]+)\""),
        Syntax("rust", (".rs",), ("use",), static="::", extends="", mixins=("impl",), class_pattern=r"\bstruct\s+(\w+)", function_pattern=r"\bfn\s+(\w+)", import_pattern=r"\buse\s+([^;]+);"),
        Syntax("java", (".java",), ("import",), implements="implements", class_pattern=r"\bclass\s+(\w+)", function_pattern=r"\b(?:public|protected|private)\s+(?:static\s+)?[\w<>]+\s+(\w+)\s*\(", import_pattern=r"\bimport\s+([^;]+);"),
        Syntax("ruby", (".rb",), ("require", "require_relative", "include"), static="::", variable="@", comment="#", other_comment="#", extends="<", mixins=("include", "extend", "prepend"), class_pattern=r"\bclass\s+(\w+)", function_pattern=r"\bdef\s+(?:self\.)?(\w+[?!=]?)", import_pattern=r"\brequire(?:_relative)?\s+['\"]([^'\"]+)"),
    )
}


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def is_comment(line: Column, syntax: Syntax) -> Column:
    out = line.startswith(syntax.comment) | line.startswith("/*") | line.startswith("*")
    return out if syntax.other_comment is None else out | line.startswith(syntax.other_comment)


def usage_rules(syntax: Syntax, symbol: str) -> list[tuple[str, str]]:
    """(kind, expression) in the order in which they apply. A language without a keyword has no rule of its kind."""
    s = _quoted(symbol)
    rules = []
    if syntax.name == "php":
        rules += [("mixin_include", rf"^use\s+(?:[\w\\]+\s*,\s*)*{s}\s*(?:,[^;]*)?;"), ("import", rf"^use\s+[\w\\\s,]*\b{s}\b[^;]*;")]
    rules += [("import", rf"\b{kw}\b.*\b{s}\b") for kw in syntax.imports]
    if syntax.extends:
        start = rf"\b{syntax.extends}" if syntax.extends.isalpha() else syntax.extends
        rules.append(("extends_or_implements", rf"{start}\s+{s}\b"))
    if syntax.implements:
        rules.append(("extends_or_implements", rf"\b{syntax.implements}\s+.*\b{s}\b"))
    rules.append(("instantiation", rf"\bnew\s+{s}\b"))
    if syntax.name in ("javascript", "typescript"):
        rules.append(("instantiation", rf"<\s*/?\s*{s}\b"))
    rules.append(("static_call", rf"\b{s}{_quoted(syntax.static)}"))
    rules.append(("method_call", rf"{_quoted(syntax.instance)}{s}\b"))
    rules.append(("type_hint", rf"\b{s}\s+{_quoted(syntax.variable)}\w+"))
    rules.append(("reference", rf"\b{s}\b"))
    return rules


def classify_usage(line: Column, symbol: str, syntax: Syntax) -> Column:
    """How ``symbol`` is used on a line; null for comments and for lines without it. The substring test runs first."""
    text = F.trim(line)
    out = F.when(~text.contains(symbol) | is_comment(text, syntax), F.lit(None).cast("string"))
    for kind, pattern in usage_rules(syntax, symbol):
        out = out.when(text.rlike("(?U)" + pattern), kind)
    return out


_LETTER = r"\pL\pN_"


def _re2(pattern: str) -> str:
    """The pattern with word boundaries and word characters of any script, for an engine that only knows ASCII ones."""
    # one character may end the first word and begin the second
    pattern = pattern.replace(r"\b.*\b", "\x00").replace(r"\s+.*\b", "\x01")
    out = ""
    for i, part in enumerate(pattern.split(r"\b")):
        if i:
            out += f"(?:$|[^{_LETTER}])" if out and (out[-1].isalnum() or out[-1] == "_") else f"(?:^|[^{_LETTER}])"
        out += part
    out = out.replace("\x00", f"(?:[^{_LETTER}]|[^{_LETTER}].*[^{_LETTER}])").replace("\x01", rf"(?:\s+|\s+.*[^{_LETTER}])")
    return out.replace(r"[\w\\\s,]", rf"[{_LETTER}\\\s,]").replace(r"[\w\\]", rf"[{_LETTER}\\]").replace(r"\w+", f"[{_LETTER}]+")


def usage_sql(text: str, symbol: str, syntax: Syntax) -> str:
    """``classify_usage`` in DuckDB, whose expressions have no look-around either."""
    comment = " OR ".join(f"starts_with({text}, '{c}')" for c in dict.fromkeys([syntax.comment, "/*", "*"]))
    whens = " ".join(f"WHEN regexp_matches({text}, '{_re2(p)}') THEN '{k}'" for k, p in usage_rules(syntax, symbol))
    return f"CASE WHEN NOT contains({text}, '{symbol}') OR {comment} THEN NULL {whens} END"


def declarations(text: str, syntax: Syntax) -> list[tuple[str, str, int]]:
    """(kind, name, line) of the classes and functions in a text."""
    out = []
    for kind, pattern in (("class", syntax.class_pattern), ("function", syntax.function_pattern)):
        for m in re.finditer(pattern, text, re.M):
            name = next((g for g in m.groups() if g), None)
            if name:
                out.append((kind, name, text.count("\n", 0, m.start()) + 1))
    return out

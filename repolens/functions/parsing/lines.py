"""Languages that are read by line patterns: Objective-C, Blade templates, and everything without a parser of its own."""

from __future__ import annotations

import re

from repolens.functions.parsing.model import Parsed, Symbol
from repolens.functions.syntax import SYNTAX


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _count(text: str) -> int:
    return len(text.split("\n")) - text.endswith("\n") if text else 0


def parse_objective_c(text: str) -> Parsed:
    """Classes, their methods and C functions; calls only within the file, by name."""
    out = Parsed("objective-c", _count(text))
    owner, bodies, last = None, [], None
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if m := re.match(r"@(?:interface|implementation|protocol)\s+(\w+)", line):
            owner = m[1]
            if owner not in out.symbols:
                out.add(Symbol(owner, "class", n, None, line))
        elif line.startswith("@end"):
            owner = last = None
        elif m := re.match(r"[-+]\s*\([^)]*\)\s*(\w+)", line):
            last = out.add(Symbol(f"{owner}.{m[1]}" if owner else m[1], "method", n, None, line.rstrip("{; ")))
        elif m := re.match(r"(?:static\s+|inline\s+)*[\w*]+[\s*]+(\w+)\s*\([^;]*\)\s*\{?$", line):
            if m[1] not in ("if", "for", "while", "switch", "return"):
                last = out.add(Symbol(m[1], "function", n, None, line.rstrip("{ ")))
        elif line.startswith(("#import", "#include", "@import")):
            out.imports.append(re.sub(r"^[#@](?:import|include)\s*|[\"<>;]", "", line).strip())
        elif last is not None:
            bodies.append((last.name, line))
    for name, line in bodies:
        for other in out.symbols.values():
            short = other.name.rsplit(".", 1)[-1]
            if other.name != name and other.kind != "class" and re.search(rf"\b{re.escape(short)}\b", line) and name not in other.called_by:
                other.called_by.append(name)
    return out


_Q = r"['\"]([^'\"]+)['\"]"
# What Blade templates declare: the symbol's prefix, its type, the pattern, and how its signature is written.
BLADE = [
    ("section", "section", rf"@section\(\s*{_Q}", "@section('{}')"), ("component", "component", r"<x-(?!slot\b)([\w.:-]+)", "<x-{}>"), ("component", "component", rf"@component\(\s*{_Q}", "@component('{}')"),
    ("component", "component", rf"@livewire\(\s*{_Q}", "@livewire('{}')"), ("component", "component", r"<livewire:([\w.-]+)", "<livewire:{}>"),
    ("alpine", "alpine_component", r"x-data=['\"]\s*([a-zA-Z_]\w*)\s*\(", 'x-data="{}()"'), ("alpine-global", "alpine_global_component", rf"Alpine\.data\(\s*{_Q}", "Alpine.data('{}')"),
    ("alpine-store", "alpine_store", rf"Alpine\.store\(\s*{_Q}", "Alpine.store('{}')"), ("slot", "slot", rf"<x-slot\s+name={_Q}", "<x-slot:{}>"), ("slot", "slot", r"<x-slot:([\w-]+)", "<x-slot:{}>"),
    ("slot", "slot", rf"@slot\(\s*{_Q}", "<x-slot:{}>"),
]
# What a template takes in, and what else it names, by pattern.
BLADE_IMPORTS = [("extends", rf"@extends\(\s*{_Q}"), ("include", rf"@(?:include(?:If|When|Unless|First)?|each)\(\s*{_Q}"), ("push", rf"@push\(\s*{_Q}")]
BLADE_FACTS = [
    ("yield", rf"@yield\(\s*{_Q}"), ("stack", rf"@stack\(\s*{_Q}"), ("dispatch", rf"\$dispatch\(\s*{_Q}"), ("event", r"(?:x-on:|\s@)([a-zA-Z][\w.-]*?)(?=\.[\w.]+\s*=|\s*=)"), ("model", r'x-model(?:\.[\w.]+)?="([^"]+)"'),
    ("ref", r'x-ref="([^"]+)"'), ("ref", r"\$refs\.(\w+)"), ("store", r"\$store\.(\w+)"), ("teleport", r'x-teleport="([^"]+)"'), ("route", rf"\broute\(\s*{_Q}"),
]
_PROPS = re.compile(r"@props\(\s*\[((?:[^\[\]]|\[[^\]]*\])*)\]\s*\)")
_INLINE = re.compile(r"x-data\s*=\s*([\"'])\s*(?=\{)")
_COMPONENT = re.compile(r"<x-(?!slot\b)([\w.:-]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")


def _object_end(text: str, start: int, outer: str) -> int | None:
    """Behind the brace that closes the one at ``start``; strings and what is escaped don't count, the attribute's own quote ends it."""
    depth, inside = 0, ""
    for m in re.compile(r"\\.|[{}'\"`]", re.S).finditer(text, start):
        c = m[0]
        if inside or c[0] == "\\":
            inside = "" if c == inside else inside
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return m.end()
        elif c == outer:
            return None
        else:
            inside = c
    return None


def parse_blade(text: str) -> Parsed:
    """Sections, components, slots, properties and Alpine parts as symbols; parents and includes as imports; the rest as exported facts."""
    out = Parsed("blade", _count(text))

    def add(name: str, kind: str, at: int, signature: str, end: int | None = None) -> None:
        if name not in out.symbols:
            out.add(Symbol(name, kind, _line(text, at), None if end is None else _line(text, end), signature[:200]))

    for prefix, kind, pattern, signature in BLADE:
        for m in re.finditer(pattern, text):
            add(f"{prefix}:{m[1]}", kind, m.start(), signature.format(m[1]))
    for m in _INLINE.finditer(text):
        if (end := _object_end(text, m.end(), m[1])) is not None:
            body = text[m.end() : end]
            keys = re.findall(r"(?:^\{|[,\n])\s*(\w+)\s*(?::|\([^)]*\)\s*\{)", body)
            add(f"alpine-inline:{_line(text, m.start())}", "alpine_inline", m.start(), f'x-data="{{ {", ".join(keys[:5])}{", ..." if len(keys) > 5 else ""} }}"', end - 1)
    for m in _PROPS.finditer(text):
        named = re.findall(r"['\"](\w+)['\"]\s*=>", m[1])
        plain = re.findall(r"['\"](\w+)['\"]", re.sub(r"['\"]\w+['\"]\s*=>[^,\n]*", "", m[1]))
        add("props", "props", m.start(), f"@props([{', '.join(plain + named)}])", m.end() - 1)
    out.imports = list(dict.fromkeys(f"{kind}:{m[1]}" for kind, pattern in BLADE_IMPORTS for m in re.finditer(pattern, text)))
    facts = [f"{kind}:{m[1]}" for kind, pattern in BLADE_FACTS for m in re.finditer(pattern, text)]
    facts += [f"attribute:{m[1]}.{a[1]}{a[2]}" for m in _COMPONENT.finditer(text) for a in re.finditer(r"(:?)([\w._-]+)\s*=\s*[\"']", m[2])]
    out.exports = list(dict.fromkeys([*facts, *(["slot"] if re.search(r"\{\{\s*\$slot\s*\}\}", text) else [])]))
    return out


MARKUP = {"html", "css", "markdown", "json", "yaml", "xml", "sql", "vue", "svelte"}


def parse_fallback(language: str, path: str, text: str) -> Parsed:
    """Classes and functions by the language's patterns; a symbol for the file itself in markup and configuration."""
    out = Parsed(language, _count(text))
    if language in SYNTAX:
        for kind, pattern in (("class", SYNTAX[language].class_pattern), ("function", SYNTAX[language].function_pattern)):
            for m in re.finditer(pattern, text, re.M) if pattern else ():
                if name := next((g for g in m.groups()[:2] if g), None):
                    out.add(Symbol(name, kind, _line(text, m.start(1) if m[1] else m.start()), None, m[0].strip()[:200]))
        for m in re.finditer(SYNTAX[language].import_pattern or r"(?!)", text, re.M):
            out.imports.append(m[1].strip())
    elif language in MARKUP:
        out.add(Symbol(f"file:{path.rsplit('/', 1)[-1]}", "file", 1, out.line_count))
    return out

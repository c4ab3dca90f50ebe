"""Python sources, by the standard library's syntax tree.

Functions inside methods are left out with their calls; nested functions elsewhere are functions of their own. A file that doesn't parse is a
file without symbols.
"""

from __future__ import annotations

import ast

from repolens.functions.parsing.model import Parsed, Symbol


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = node.args
    shown = [x.arg for x in a.args] + ([f"*{a.vararg.arg}"] if a.vararg else []) + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
    return f"def {node.name}({', '.join(shown)}):"


def _made(value: ast.AST | None) -> str | None:
    """The class that ``Foo()`` or ``a.Foo()`` makes."""
    if isinstance(value, ast.Call):
        if isinstance(value.func, ast.Name):
            return value.func.id
        if isinstance(value.func, ast.Attribute):
            return value.func.attr
    return None


class _Scan:
    def __init__(self, out: Parsed):
        self.out = out
        self.known: set[str] = set()  # full names and short method names seen so far
        self.types: list[dict[str, str]] = [{}]
        self.caller: str | None = None
        self.owner: str | None = None

    def define(self, node, name: str, kind: str) -> None:
        signature = None if kind == "class" else _signature(node)
        self.out.add(Symbol(name, kind, node.lineno, node.end_lineno, signature, ast.get_docstring(node)))
        self.known |= {name, node.name} if kind == "method" else {name}

    def body(self, nodes, caller: str | None) -> None:
        before, self.caller = self.caller, caller
        self.types.append({})
        for n in nodes:
            self.visit(n)
        self.types.pop()
        self.caller = before

    def visit(self, node: ast.AST) -> None:
        if isinstance(node, ast.ClassDef):
            self.define(node, node.name, "class")
            outer, self.owner = self.owner, node.name
            methods = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
            for m in methods:
                self.define(m, f"{node.name}.{m.name}", "method")
            for n in node.body:
                if n not in methods:
                    self.visit(n)
            for m in methods:
                self.body(m.body, f"{node.name}.{m.name}")
            self.owner = outer
            return
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if self.owner is None:
                self.define(node, node.name, "function")
                self.body(ast.iter_child_nodes(node), node.name)
            return
        if isinstance(node, ast.Import):
            self.out.imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            self.out.imports += [f"{node.module}.{a.name}" for a in node.names]
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and (made := _made(node.value)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    self.types[-1][target.id] = made
        elif isinstance(node, ast.Call) and self.caller and (called := self.called(node.func)):
            self.out.calls.append((self.caller, called))
        for child in ast.iter_child_nodes(node):
            self.visit(child)

    def called(self, func: ast.AST) -> str | None:
        if isinstance(func, ast.Name):
            return func.id if func.id in self.known or not func.id[:1].isupper() else f"{func.id}.__init__"
        if not isinstance(func, ast.Attribute):
            return None
        of = func.value
        if isinstance(of, ast.Call) and isinstance(of.func, ast.Name) and of.func.id == "super":
            return None
        receiver = None
        if isinstance(of, ast.Name):
            receiver = self.types[-1].get(of.id)
        elif isinstance(of, ast.Call):
            receiver = _made(of)
        elif isinstance(of, ast.Attribute):
            receiver = (self.types[-1].get(of.value.id) if isinstance(of.value, ast.Name) else None) or of.attr
        return f"{receiver}.{func.attr}" if receiver else func.attr


def parse_python(text: str) -> Parsed:
    out = Parsed("python", len(text.split("\n")) - text.endswith("\n") if text else 0)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    out.docstring = ast.get_docstring(tree)
    try:
        _Scan(out).visit(tree)
    except RecursionError:
        pass
    # a method's short name answers a bare call too
    return out.settle(keep_resolved=False)

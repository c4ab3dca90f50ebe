"""One scanner for languages with braces, driven by a small description of each.

It walks a file's tokens with a stack of scopes. A declaration opens a scope at its brace (or expression body), a call inside a function scope is
charged to that function. Receivers are typed from what the file says: parameters, properties, fields, ``new`` and constructor injection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from repolens.functions.parsing.lexer import Token, lex, matching
from repolens.functions.parsing.model import Parsed, Symbol

# Words that are followed by a parenthesis or a name but are neither calls nor types.
CONTROL = set("""
if else for while do switch case catch finally try return throw throws new delete typeof instanceof in of await async yield super with when is as not and or
function func fun fn class interface trait enum struct namespace import export using use require_once include_once isset unset foreach elseif static public
private protected internal final abstract override virtual sealed const let var val readonly void constructor defer extends implements try sizeof nameof goto
break continue default this self parent fallthrough comptime pub extern require include
""".split())
PRIMITIVES = set("""
string number boolean any unknown never void null undefined object symbol bigint int float bool double long short byte char str array iterable callable mixed
self static String Number Boolean Object Array Promise Map Set Record Partial Date Int Long Float Double Boolean List dynamic Future Unit Any
""".split())
PHP_CONSTRUCTS = {"list", "array", "match", "empty", "echo", "print", "declare", "exit", "die"}
GO_BUILTINS = set("append cap clear close complex copy delete imag len make max min new panic print println real recover string error any".split())


@dataclass(frozen=True)
class Language:
    name: str
    types: dict[str, str] = field(default_factory=dict)  #: keyword -> kind
    functions: tuple[str, ...] = ()  #: keywords before a function's name
    bare_methods: bool = False  #: methods have no keyword
    bare_functions: bool = False  #: nor have functions at the top
    arrows: bool = False  #: const f = () => ...
    typed_after: bool = False  #: name: Type
    calls: str = "typed"  #: typed, bare, pascal or none
    keep_resolved: bool = False
    constructs: str | None = None  #: what ``new T`` calls: "{}" is T
    annotations: bool = False  #: types in signatures are edges
    callbacks: bool = False
    file_scope: bool = False
    constructor: str | None = None
    constructors: bool = True


LANGUAGES = {
    "javascript": Language("javascript", {"class": "class"}, ("function",), bare_methods=True, arrows=True, constructs="{}", callbacks=True),
    "typescript": Language("typescript", {"class": "class", "interface": "interface", "enum": "enum"}, ("function",), bare_methods=True, arrows=True, typed_after=True, constructs="{}", annotations=True, callbacks=True),
    "java": Language("java", {"class": "class"}, bare_methods=True, calls="bare", keep_resolved=True, constructors=False),
    "kotlin": Language("kotlin", {"class": "class", "object": "class", "interface": "interface"}, ("fun",), typed_after=True, calls="pascal"),
    "csharp": Language("csharp", {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "record": "class"}, bare_methods=True, calls="pascal", constructs="{}.#ctor", constructor="#ctor"),
    "go": Language("go", {}, ("func",), calls="bare", keep_resolved=True),
    "dart": Language("dart", {"class": "class"}, bare_methods=True, bare_functions=True, calls="bare", keep_resolved=True),
    "php": Language("php", {"class": "class", "interface": "interface", "trait": "trait", "enum": "enum"}, ("function",), keep_resolved=True, constructs="{}", file_scope=True),
    "zig": Language("zig", {}, ("fn",), calls="none"),
}
FILE_SCOPE = "__file_scope__"


@dataclass
class _Scope:
    kind: str  # class, function or block
    name: str
    symbol: Symbol | None
    types: dict[str, str]
    close: int  # index of the token that ends it


class Scanner:
    def __init__(self, language: Language, text: str):
        self.lang, self.text = language, text
        self.tokens: list[Token] = lex(text, php=language.name == "php")
        self.pairs = matching(self.tokens)
        self.out = Parsed(language.name, len(text.split("\n")) - text.endswith("\n") if text else 0)
        self.scopes: list[_Scope] = []
        self.fields: dict[str, dict[str, str]] = {}
        self.imported: set[str] = set()
        self.sign_end = set()  # tokens inside declarations' headers

    # what is around a token
    def text_at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def owner(self) -> str | None:
        return next((s.name for s in reversed(self.scopes) if s.kind == "class"), None)

    def function(self) -> _Scope | None:
        for s in reversed(self.scopes):
            if s.kind == "function":
                return s
            if s.kind == "class":
                return None
        return None

    def after_generics(self, i: int) -> int:
        """Past ``<...>``, which must close before a brace or a semicolon."""
        if self.text_at(i) != "<":
            return i
        depth = 0
        for j in range(i, min(i + 80, len(self.tokens))):
            t = self.tokens[j].text
            depth += (t == "<") - (t == ">")
            if t in "{};" and t:
                return i
            if depth == 0:
                return j + 1
        return i

    def body_start(self, i: int) -> tuple[int, str] | None:
        """From behind a parameter list to what opens the body: ``{``, ``=>`` or ``=``; None if there is no body near."""
        j = i
        while j < min(i + 60, len(self.tokens)):
            t = self.tokens[j]
            if t.text == "{":
                if j > i and self.text_at(j - 1) in (":", "|", "&", "<", ","):  # a type literal
                    j = self.pairs.get(j, j) + 1
                    continue
                return j, "{"
            if t.text == "=>":
                return j, "=>"
            if t.text == "=" and self.lang.name == "kotlin":
                return j, "="
            if t.text in (";", "}", "=") or (t.text == ")" and t.kind == "sign"):
                return None
            if t.text in "([" and t.kind == "sign":
                j = self.pairs.get(j, j) + 1
                continue
            if t.kind in ("string", "number"):
                return None
            j += 1
        return None

    def expression_end(self, i: int) -> int:
        """The last token of an expression body."""
        j, line = i, self.tokens[i].line if i < len(self.tokens) else 0
        while j < len(self.tokens):
            t = self.tokens[j].text
            if t in ("(", "[", "{") and self.tokens[j].kind == "sign":
                j = self.pairs.get(j, j)
                line = self.tokens[j].line
            elif t in (";", ",", ")", "]", "}"):
                return j - 1
            elif self.lang.name == "kotlin" and self.tokens[j].line > line and self.text_at(j) not in (".", "?.", "+", "-", "*", "/"):
                return j - 1
            line = self.tokens[j].line
            j += 1
        return j - 1

    def line_start(self, i: int) -> int:
        """The first token of the declaration that token ``i`` names: modifiers and types on its line."""
        j = i
        while j > 0 and self.tokens[j - 1].line == self.tokens[i].line and self.text_at(j - 1) not in ("{", "}", ";"):
            j -= 1
        return j

    def open(self, kind: str, name: str, symbol: Symbol | None, start: int, how: str, types: dict[str, str] | None = None) -> None:
        close = self.pairs.get(start, len(self.tokens) - 1) if how == "{" else self.expression_end(start + 1)
        if how == "=>" and self.text_at(start + 1) == "{":
            close = self.pairs.get(start + 1, close)
        if symbol is not None and close < len(self.tokens):
            symbol.end_line = self.tokens[close].line
        self.scopes.append(_Scope(kind, name, symbol, types or {}, close))

    def parameters(self, start: int) -> tuple[dict[str, str], list[str], dict[str, str]]:
        """Of a parameter list at ``(``: names' types, all types named, and those of promoted properties."""
        types, named, promoted = {}, [], {}
        end, i = self.pairs.get(start, start), start + 1
        part: list[Token] = []
        depth = 0
        while i <= end:
            t = self.tokens[i]
            if (t.text == "," and depth == 0) or i == end:
                if part:
                    names = [p.text for p in part if p.kind == "name"]
                    words = [n for n in names if n not in CONTROL and not n.startswith("@")]
                    if self.lang.typed_after and any(p.text == ":" for p in part):
                        k = next(j for j, p in enumerate(part) if p.text == ":")
                        before = [p.text for p in part[:k] if p.kind == "name" and p.text not in CONTROL]
                        after = [p.text for p in part[k + 1 :] if p.kind == "name" and p.text not in CONTROL]
                        if before and after:
                            types[before[-1]] = after[0]
                            named += after
                            if {"private", "public", "protected", "readonly", "val", "var"} & {p.text for p in part[:k]}:
                                promoted[before[-1]] = after[0]
                    elif self.lang.name == "php":
                        variables = [n for n in names if n.startswith("$")]
                        kinds = [n for n in words if not n.startswith("$")]
                        if variables and kinds:
                            types[variables[0]] = kinds[-1]
                            named.append(kinds[-1])
                            if {"private", "public", "protected", "readonly"} & set(names):
                                promoted[variables[0][1:]] = kinds[-1]
                    elif not self.lang.typed_after and len(words) >= 2:
                        types[words[-1]] = words[0]
                        named.append(words[0])
                part = []
            else:
                depth += (t.text in "<([{" and t.kind == "sign") - (t.text in ">)]}" and t.kind == "sign")
                part.append(t)
            i += 1
        return types, named, promoted

    def declare_function(self, at: int, paren: int, name: str, kind: str, body: tuple[int, str] | None) -> int:
        """Register a function whose name is at ``at`` and parameters at ``paren``; gives the index to go on from."""
        owner = self.owner()
        full = f"{owner}.{name}" if owner and self.lang.name != "go" else name
        close = self.pairs.get(paren, paren)
        first = self.line_start(at)
        stop = body[0] if body else close + 1
        signature = " ".join(self.text[self.tokens[first].at : self.tokens[min(stop, len(self.tokens)) - 1].end].split())
        symbol = self.out.add(Symbol(full, kind, self.tokens[at].line, self.tokens[close].line, signature, self.comment_above(first)))
        types, named, promoted = self.parameters(paren)
        if owner and promoted and name in ("constructor", "__construct"):
            for k, v in promoted.items():
                self.fields.setdefault(owner, {}).setdefault(k, v)
        if self.lang.annotations:
            for n in named:
                if n not in PRIMITIVES and n[:1].isupper():
                    self.out.calls.append((full, n))
        if body is None:
            return close + 1
        self.open("function", full, symbol, body[0], body[1], types)
        return body[0] + 1

    def comment_above(self, first: int) -> str | None:
        """The comment that ends right above a declaration."""
        at = self.tokens[first].at
        head = self.text[:at].rstrip()
        if head.endswith("*/"):
            body = head[head.rfind("/*") :]
            lines = [x.strip().strip("/").lstrip("*").rstrip("*").strip() for x in body.split("\n")]
            return " ".join(x for x in lines if x) or None
        lines = []
        for x in reversed(head.split("\n")):
            if not x.strip().startswith("//"):
                break
            lines.append(x.strip().lstrip("/").strip())
        return " ".join(reversed(lines)) or None

    def scan(self) -> Parsed:
        i = 0
        self.prepare_fields()
        while i < len(self.tokens):
            while self.scopes and i > self.scopes[-1].close:
                self.scopes.pop()
            i = self.step(i)
        if self.lang.file_scope and any(c == FILE_SCOPE for c, _ in self.out.calls):
            self.out.add(Symbol(FILE_SCOPE, "module", 1, self.out.line_count))
        return self.out.settle(self.lang.keep_resolved)

    def step(self, i: int) -> int:
        t, lang = self.tokens[i], self.lang
        before, after = self.text_at(i - 1), self.text_at(i + 1)
        if t.kind != "name":
            return i + 1
        member = before in (".", "?.", "->", "?->", "::")
        if t.text in lang.types and not member and self.is_name(i + 1) and self.text_at(i + 1) not in CONTROL and after not in ("extends", "implements"):
            return self.declare_type(i)
        if t.text in ("struct", "union", "enum", "interface") and lang.name in ("zig", "go"):
            return self.declare_assigned_type(i)
        if lang.name in ("go", "java", "kotlin", "csharp", "php") and t.text in ("package", "namespace") and not member and self.out.package is None:
            return self.declare_package(i)
        if t.text in ("import", "use", "using", "export", "require", "require_once", "include", "include_once", "part") and not member and (done := self.read_import(i)):
            return done
        if t.text in lang.functions and not member:
            return self.declare_keyword_function(i)
        scope = self.scopes[-1] if self.scopes else None
        if t.text not in CONTROL or t.text == "constructor":
            paren = self.after_generics(i + 1)
            in_class = scope is not None and scope.kind == "class"
            if self.text_at(paren) == "(" and not member and before != "new" and ((in_class and lang.bare_methods) or (lang.bare_functions and (scope is None or in_class))):
                body = self.body_start(self.pairs.get(paren, paren) + 1)
                if body and (in_class or self.is_name(i - 1) or before in (">", "]", "?", "}", ";", "")):
                    name, kind = t.text, "method" if in_class else "function"
                    if in_class and name == (self.owner() or "").rsplit(".", 1)[-1]:
                        if not lang.constructors:
                            self.open("function", f"{self.owner()}.{name}", None, body[0], body[1], self.parameters(paren)[0])
                            return body[0] + 1
                        if lang.constructor:
                            name, kind = lang.constructor, "constructor"
                    return self.declare_function(i, paren, name, kind, body)
        if lang.arrows and self.text_at(i + 1) in ("=", ":") and before in ("const", "let", "var") and not self.function() and (done := self.declare_arrow(i)):
            return done
        if lang.arrows and scope is not None and scope.kind == "class" and self.text_at(i + 1) == "=" and (done := self.declare_arrow(i)):
            return done
        self.note_local(i)
        return self.read_call(i)

    def declare_type(self, i: int) -> int:
        name, kind = self.text_at(i + 1), self.lang.types[self.text_at(i)]
        if self.lang.name == "csharp" and self.out.package:
            name = f"{self.out.package}.{name}"
        symbol = self.out.add(Symbol(name, kind, self.tokens[i].line, self.tokens[i].line, None, self.comment_above(self.line_start(i))))
        j = self.after_generics(i + 2)
        if self.text_at(j) == "(":  # a primary constructor
            self.fields.setdefault(name, {}).update(self.parameters(j)[0])
            j = self.pairs.get(j, j) + 1
        while j < len(self.tokens) and self.text_at(j) not in ("{", ";", "}"):
            if self.lang.name == "kotlin" and self.tokens[j].line > self.tokens[j - 1].line and self.text_at(j) not in (":", ",") and self.text_at(j - 1) not in (":", ","):
                break
            j = self.pairs.get(j, j) + 1 if self.text_at(j) == "(" else j + 1
        symbol.signature = " ".join(self.text[self.tokens[self.line_start(i)].at : self.tokens[j - 1].end].split())
        if self.text_at(j) == "{":
            short = name.rsplit(".", 1)[-1] if self.lang.name != "csharp" else name
            self.open("class", short, symbol, j, "{")
            return j + 1
        return j

    def declare_assigned_type(self, i: int) -> int:
        """Go ``type X struct {`` and Zig ``const X = struct {``."""
        name = self.text_at(i - 1) if self.lang.name == "go" else self.text_at(i - 2)
        fits = self.text_at(i - 2) == "type" or (self.lang.name == "zig" and self.text_at(i - 1) == "=")
        if fits and name.isidentifier():
            j = i + 1
            while self.text_at(j) == "(":
                j = self.pairs.get(j, j) + 1
            symbol = self.out.add(Symbol(name, self.text_at(i), self.tokens[i].line, None, None, self.comment_above(self.line_start(i))))
            if self.lang.name == "zig" and j in self.pairs:
                symbol.end_line = self.tokens[self.pairs[j]].line
        return i + 1

    def declare_package(self, i: int) -> int:
        j = i + 1
        while j < len(self.tokens) and self.tokens[j].line == self.tokens[i].line and self.text_at(j) not in (";", "{"):
            j += 1
        self.out.package = self.text[self.tokens[i].end : self.tokens[j - 1].end].strip() or None
        if self.text_at(i) == "namespace" and self.text_at(j) == "{":
            self.open("block", "", None, j, "{")
            return j + 1
        return j

    def read_import(self, i: int) -> int | None:
        word, j = self.text_at(i), i + 1
        if word == "export" and not any(t.text == "from" for t in self.tokens[i : i + 40] if t.line == self.tokens[i].line):
            stop = next((k for k in range(i, min(i + 30, len(self.tokens))) if self.text_at(k) in ("{", "=", ";", "(")), i + 1)
            self.out.exports.append(" ".join(self.text[self.tokens[i].at : self.tokens[stop - 1].end].split()))
            return i + 1
        if word == "import" and self.text_at(j) == "(" and self.lang.name == "go":
            close = self.pairs.get(j, j)
            self.out.imports += [t.text.strip("\"`") for t in self.tokens[j:close] if t.kind == "string"]
            return close + 1
        if self.scopes and self.scopes[-1].kind == "function" and word in ("use", "using"):
            return None
        if self.scopes and self.scopes[-1].kind == "class" and word == "use":
            return next((k for k in range(i, len(self.tokens)) if self.text_at(k) in (";", "{")), i) + 1
        if word in ("require", "require_once", "include", "include_once"):
            found = next((t.text.strip("'\"") for t in self.tokens[i : i + 8] if t.kind == "string"), None)
            if found is not None:
                self.out.imports.append(found)
                start = next((k for k in range(i - 1, max(i - 12, -1), -1) if self.text_at(k) in ("const", "let", "var", ";")), None)
                if start is not None and self.text_at(start) != ";":
                    self.imported |= {t.text for t in self.tokens[start + 1 : i] if t.kind == "name"}
            return i + 1
        line = self.tokens[i].line
        while j < len(self.tokens) and self.text_at(j) != ";" and (self.tokens[j].line == line or self.text_at(j - 1) in ("{", ",") or self.text_at(j) in ("}", "from")):
            line = self.tokens[j].line
            j += 1
        names = [t.text for t in self.tokens[i + 1 : j] if t.kind == "name" and t.text not in ("from", "as", "type")]
        self.imported |= set(names)
        strings = [t.text.strip("'\"`") for t in self.tokens[i + 1 : j] if t.kind == "string"]
        raw = " ".join(self.text[self.tokens[i + 1].at : self.tokens[j - 1].end].split()) if j > i + 1 else ""
        self.out.imports.append(raw if self.lang.name in ("java", "kotlin", "csharp", "php") or not strings else (raw if word == "export" else strings[-1]))
        return j

    def declare_keyword_function(self, i: int) -> int:
        j = i + 1
        if self.lang.name == "go" and self.text_at(j) == "(":  # the receiver gives types but no name
            receiver = [t.text for t in self.tokens[j + 1 : self.pairs.get(j, j)] if t.kind == "name"]
            j = self.pairs.get(j, j) + 1
        else:
            receiver = []
        if self.lang.name == "kotlin":
            j = self.after_generics(j)
            while self.text_at(j + 1) == ".":
                j += 2
        if self.text_at(j) in ("&", "*"):
            j += 1
        if not self.is_name(j):
            return i + 1
        paren = self.after_generics(j + 1)
        if self.text_at(paren) == "[":
            paren = self.pairs.get(paren, paren) + 1
        if self.text_at(paren) != "(":
            return j + 1
        body = self.body_start(self.pairs.get(paren, paren) + 1)
        inside = self.scopes and self.scopes[-1].kind == "class"
        if self.function() is not None and self.lang.name in ("javascript", "typescript", "php") and not inside:
            return j + 1  # a local function's calls are its host's
        done = self.declare_function(j, paren, self.text_at(j), "method" if inside else "function", body)
        if receiver and len(receiver) > 1 and self.scopes and self.scopes[-1].kind == "function":
            self.scopes[-1].types[receiver[0]] = receiver[-1]
        if self.lang.name in ("go",) and (s := self.out.symbols.get(self.text_at(j))):
            s.end_line = None
        if self.lang.name == "zig" and body and (s := self.out.symbols.get(self.text_at(j))):
            s.signature = self.text[self.tokens[i].at : self.tokens[self.pairs.get(body[0], body[0])].end]
        return done

    def declare_arrow(self, i: int) -> int | None:
        j = i + 1
        if self.text_at(j) == ":":
            while j < len(self.tokens) and self.text_at(j) not in ("=", ";", "{"):
                j += 1
        if self.text_at(j) != "=":
            return None
        k = j + 1
        if self.text_at(k) == "async":
            k += 1
        if self.text_at(k) == "function":
            k += 1 + self.is_name(k + 1)
        k = self.after_generics(k)
        if self.text_at(k) == "(":
            body = self.body_start(self.pairs.get(k, k) + 1)
            if body and (body[1] == "=>" or self.text_at(k - 1) == "function" or self.text_at(k - 2) == "function"):
                return self.declare_function(i, k, self.text_at(i), "method" if self.scopes and self.scopes[-1].kind == "class" else "function", body)
        elif self.is_name(k) and self.text_at(k + 1) == "=>":
            symbol = self.out.add(Symbol(self.text_at(i), "function", self.tokens[i].line))
            self.open("function", self.text_at(i), symbol, k + 1, "=>")
            return k + 2
        if self.lang.name == "typescript" and not self.scopes and (self.text_at(k) == "new" or self.is_name(k)):
            self.out.add(Symbol(self.text_at(i), "function", self.tokens[i].line))
        return None

    def prepare_fields(self) -> None:
        """Types of properties, before any body is read: declarations, promoted parameters, assignments in bodies."""
        owner_stack: list[tuple[str, int]] = []
        for i, t in enumerate(self.tokens):
            while owner_stack and i > owner_stack[-1][1]:
                owner_stack.pop()
            if t.text in self.lang.types and self.is_name(i + 1) and self.text_at(i - 1) not in (".", "::"):
                brace = next((k for k in range(i, min(i + 80, len(self.tokens))) if self.text_at(k) in ("{", ";")), None)
                if brace is not None and brace in self.pairs:
                    owner_stack.append((self.text_at(i + 1), self.pairs[brace]))
                continue
            if not owner_stack:
                continue
            mine = self.fields.setdefault(owner_stack[-1][0], {})
            if t.text in ("constructor", "__construct") and self.text_at(i + 1) == "(":
                types, _, promoted = self.parameters(i + 1)
                for k, v in promoted.items():
                    mine.setdefault(k, v)
                start = self.pairs.get(i + 1, i + 1)
                brace = next((k for k in range(start, min(start + 10, len(self.tokens))) if self.text_at(k) == "{"), None)
                if brace is not None:
                    self.read_assignments(brace, self.pairs.get(brace, brace), types, mine)
            elif self.lang.typed_after and t.kind == "name" and self.text_at(i + 1) == ":" and self.is_name(i + 2) and self.text_at(i - 1) in ("private", "public", "protected", "readonly", ";", "{", "val", "var"):
                mine.setdefault(t.text, self.text_at(i + 2))
                k = i - 1
                while self.text_at(k) in ("private", "public", "protected", "readonly", "static"):
                    k -= 1
                if self.lang.annotations and self.text_at(k) in (";", "{", "}") and self.text_at(i + 2)[:1].isupper() and self.text_at(i + 2) not in PRIMITIVES:  # no parameter
                    self.out.calls.append((owner_stack[-1][0], self.text_at(i + 2)))
            elif self.lang.name == "php" and t.text.startswith("$") and self.is_name(i - 1) and self.text_at(i - 1) not in CONTROL and self.text_at(i + 1) in (";", "="):
                mine.setdefault(t.text[1:], self.text_at(i - 1).split("\\")[-1])
            elif t.kind == "name" and self.text_at(i + 1) == "=" and self.text_at(i + 2) == "new" and self.is_name(i + 3):
                mine.setdefault(t.text.lstrip("$"), self.text_at(i + 3))
            elif self.lang.bare_methods and not self.lang.typed_after and self.lang.name != "javascript" and t.kind == "name" and self.is_name(i + 1) and self.text_at(i + 2) in (";", "=") and t.text not in CONTROL:
                mine.setdefault(self.text_at(i + 1), t.text)

    def read_assignments(self, start: int, end: int, types: dict[str, str], mine: dict[str, str]) -> None:
        """``this.a = a`` and ``this.a = new A()`` in a constructor."""
        for i in range(start, end):
            if self.text_at(i) in ("this", "$this") and self.text_at(i + 1) in (".", "->") and self.text_at(i + 3) == "=":
                value = self.text_at(i + 4)
                made = self.text_at(i + 5) if value == "new" else types.get(value)
                if made:
                    mine.setdefault(self.text_at(i + 2), made.split("\\")[-1])

    def note_local(self, i: int) -> None:
        """The type of a variable from ``x = new T``, ``x: T =``, ``T x =`` or ``$x = T::make()``."""
        types = self.function().types if self.function() else self.top_types()
        name, j = self.text_at(i), i + 1
        if self.text_at(j) == ":" and self.lang.typed_after and self.is_name(j + 1) and self.text_at(i - 1) in ("const", "let", "var", "val"):
            types[name] = self.text_at(j + 1)
            return
        if self.text_at(j) == ":" and self.text_at(j + 1) == "=":  # Go
            j += 1
        if self.text_at(j) != "=" or self.text_at(j + 1) == "=":
            return
        k = j + 1 + (self.text_at(j + 1) in ("await", "&"))
        if self.text_at(k) == "new" and self.is_name(k + 1):
            types[name] = self.last_segment(k + 1)
        elif self.is_name(k) and self.text_at(k)[:1].isupper() and self.text_at(k + 1) in ("::", "(", "{"):
            types[name] = self.text_at(k)
        elif self.is_name(i - 1) and self.text_at(i - 1) not in CONTROL and self.text_at(i - 1)[:1].isupper():
            types[name] = self.text_at(i - 1)

    def top_types(self) -> dict[str, str]:
        return self.fields.setdefault("", {})

    def last_segment(self, k: int) -> str:
        """``A\\B\\C`` -> C, ``a.B`` -> B."""
        while self.text_at(k + 1) in ("\\", ".") and self.is_name(k + 2):
            k += 2
        return self.text_at(k)

    def read_call(self, i: int) -> int:
        lang, t = self.lang, self.tokens[i]
        if lang.calls == "none":
            return i + 1
        scope = self.function()
        caller = scope.name if scope else FILE_SCOPE if lang.file_scope and self.owner() is None else None
        if caller is None and lang.annotations and t.text == "new":
            caller = self.owner()  # a field's value is made by its class
        if caller is None:
            return i + 1
        if t.text == "new" and self.is_name(i + 1) and lang.constructs:
            made = self.last_segment(i + 1)
            if made not in CONTROL:
                self.out.calls.append((caller, lang.constructs.format(made)))
            return i + 2
        paren = i + 1 if lang.calls == "bare" and lang.name == "go" else self.after_generics(i + 1)
        if self.text_at(paren) != "(" or (t.text in CONTROL and self.text_at(i - 1) not in (".", "->", "?.", "?->", "::")) or t.text.startswith("$"):
            return i + 1
        if self.text_at(i - 1) == "new" or self.text_at(i - 2) == "new" and lang.name == "csharp":
            return i + 1
        if lang.name == "php" and t.text in PHP_CONSTRUCTS and self.text_at(i - 1) not in ("->", "::", "?->"):
            return i + 1
        if lang.name == "go" and t.text in GO_BUILTINS and self.text_at(i - 1) != ".":
            return i + 1
        called = self.called_name(i, scope)
        if called:
            self.out.calls.append((caller, called))
        if lang.callbacks:
            for k in range(paren + 1, self.pairs.get(paren, paren)):
                if self.is_name(k) and self.text_at(k) not in CONTROL and self.text_at(k - 1) in ("(", ",") and self.text_at(k + 1) in (",", ")"):
                    self.out.calls.append((caller, self.text_at(k)))
        return i + 1

    def called_name(self, i: int, scope: _Scope | None) -> str | None:
        lang, name, link = self.lang, self.text_at(i), self.text_at(i - 1)
        if link not in (".", "?.", "->", "?->", "::"):
            return name
        if lang.calls == "bare":
            return name
        receiver = self.text_at(i - 2)
        if lang.calls == "pascal":
            known = self.type_of(receiver, scope)
            return f"{known}.{name}" if known else f"{receiver}.{name}" if receiver[:1].isupper() else name
        if receiver == ")":  # (new A()).b() or f().b()
            start = next((k for k, v in self.pairs.items() if v == i - 2), None)
            if start is not None and self.text_at(start - 2) == "new":
                return f"{self.text_at(start - 1)}.{name}"
            return name if lang.name == "php" else None
        if receiver in ("this", "$this", "self", "static", "parent"):
            return None if receiver == "parent" else f"{self.owner()}.{name}" if self.owner() else name
        if self.text_at(i - 3) in (".", "->", "?.", "?->") and self.text_at(i - 4) in ("this", "$this"):
            known = self.fields.get(self.owner() or "", {}).get(receiver)
            return f"{known}.{name}" if known else (name if lang.name == "php" else None)
        known = self.type_of(receiver, scope)
        if known:
            return f"{known}.{name}"
        if link == "::" or receiver[:1].isupper():
            return f"{receiver}.{name}"
        if lang.name == "php" or receiver in self.imported:
            return name
        return f"{receiver}.{name}"

    def type_of(self, name: str, scope: _Scope | None) -> str | None:
        found = (scope.types if scope else {}).get(name) or self.top_types().get(name)
        if not found and not name.startswith("$"):
            found = self.fields.get(self.owner() or "", {}).get(name) if self.lang.calls == "pascal" else None
        return found if found and found not in PRIMITIVES else None


def parse_braces(language: str, text: str) -> Parsed:
    return Scanner(LANGUAGES[language], text).scan()

"""Tokens of brace languages: comments dropped, strings whole, a line number for each."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True, slots=True)
class Token:
    text: str
    kind: str  #: name, string, number or sign
    line: int
    at: int  #: where it starts
    end: int


_STRINGS = r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|`(?:\\[\s\S]|[^`\\])*(?:`|\Z)"
_LANGUAGE = {
    True: re.compile(rf"(?P<gap>\s+|//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|<\?(?:php\b|=)?|\?>)|(?P<string>{_STRINGS})|(?P<name>\$?[^\W\d][\w]*)|(?P<number>\d[\w.]*)|(?P<sign>\?->|\?\.|::|->|=>|\.\.\.|[\s\S])"),
    False: re.compile(rf"(?P<gap>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>{_STRINGS})|(?P<name>[@#$]?[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>\?\.|::|->|=>|\.\.\.|[\s\S])"),
}


def lex(text: str, php: bool = False) -> list[Token]:
    out, line, last = [], 1, 0
    for m in _LANGUAGE[php].finditer(text):
        line += text.count("\n", last, m.start())
        last = m.start()
        if m.lastgroup != "gap":
            out.append(Token(m[0], m.lastgroup or "sign", line, m.start(), m.end()))
    return out


def matching(tokens: list[Token]) -> dict[int, int]:
    """For each opening bracket's index the index of its partner."""
    pairs, stack = {}, []
    closing = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.kind != "sign":
            continue
        if t.text in "([{" and len(t.text) == 1:
            stack.append(i)
        elif t.text in closing:
            while stack:
                j = stack.pop()
                if tokens[j].text == closing[t.text]:
                    pairs[j] = i
                    break
    return pairs

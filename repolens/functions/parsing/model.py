"""What a parser gives."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Symbol:
    name: str
    kind: str
    line: int
    end_line: int | None = None
    signature: str | None = None
    docstring: str | None = None
    called_by: list[str] = field(default_factory=list)


@dataclass
class Parsed:
    """One file. ``calls`` are (caller name, called name) as the parser saw them; ``pending`` those left for other files."""

    language: str
    line_count: int
    symbols: dict[str, Symbol] = field(default_factory=dict)
    imports: list[str] = field(default_factory=list)
    exports: list[str] = field(default_factory=list)
    package: str | None = None
    docstring: str | None = None
    calls: list[tuple[str, str]] = field(default_factory=list)
    pending: list[tuple[str, str]] = field(default_factory=list)

    def add(self, symbol: Symbol) -> Symbol:
        """The last symbol of a name counts."""
        self.symbols[symbol.name] = symbol
        return symbol

    def settle(self, keep_resolved: bool) -> Parsed:
        """Answer calls from the file's own symbols: the name itself, else the first dotted name that ends in it.

        ``keep_resolved``: such calls are pending all the same.
        """
        endings: dict[str, str] = {}
        for name in self.symbols:
            parts = name.split(".")
            for i in range(1, len(parts)):
                endings.setdefault(".".join(parts[i:]), name)
        seen = set()
        for caller, called in self.calls:
            target = called if called in self.symbols else endings.get(called)
            if target is not None and self.symbols[target].kind in ("function", "method", "constructor") and caller not in self.symbols[target].called_by:
                self.symbols[target].called_by.append(caller)
            if (target is None or keep_resolved) and (caller, called) not in seen:
                seen.add((caller, called))
                self.pending.append((caller, called))
        return self

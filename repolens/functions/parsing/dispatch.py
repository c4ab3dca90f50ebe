"""Which parser reads which file."""

from __future__ import annotations

from repolens.functions.parsing.braces import parse_braces
from repolens.functions.parsing.lines import parse_blade, parse_fallback, parse_objective_c
from repolens.functions.parsing.model import Parsed
from repolens.functions.parsing.pysource import parse_python

# Languages with a parser of their own, and the names of others, by suffix.
SPECIAL = {
    ".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".go": "go", ".dart": "dart", ".m": "objective-c", ".mm": "objective-c", ".zig": "zig", ".zon": "zig", ".php": "php",
}
OTHER = {
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".rs": "rust", ".rb": "ruby", ".swift": "swift", ".scala": "scala", ".sh": "shell", ".bash": "shell",
    ".zsh": "shell", ".ps1": "powershell", ".r": "r", ".pl": "perl", ".lua": "lua", ".hs": "haskell", ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".less": "css",
    ".md": "markdown", ".mdx": "markdown", ".json": "json", ".yml": "yaml", ".yaml": "yaml", ".xml": "xml", ".sql": "sql", ".vue": "vue", ".svelte": "svelte",
}
MAX_BYTES, MAX_LINES, KEPT_LINES = 1_000_000, 10_000, 1000


def language_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    if name.endswith(".blade.php"):
        return "blade"
    suffix = "." + name.rsplit(".", 1)[-1] if "." in name else ""
    return SPECIAL.get(suffix) or OTHER.get(suffix) or "unknown"


def is_special(language: str) -> bool:
    return language == "blade" or language in SPECIAL.values()


def readable(content: bytes) -> str | None:
    """A file's text: none for binaries, the first lines of very large files."""
    if b"\0" in content[:8192]:
        return None
    text = content.decode("utf-8", "ignore").replace("\r\n", "\n")
    if len(content) > MAX_BYTES or text.count("\n") >= MAX_LINES:
        text = "\n".join(text.split("\n")[:KEPT_LINES])
    return text


def parse(path: str, text: str) -> Parsed:
    language = language_of(path)
    if language == "python":
        return parse_python(text)
    if language == "blade":
        return parse_blade(text)
    if language == "objective-c":
        return parse_objective_c(text)
    if language in SPECIAL.values():
        return parse_braces(language, text)
    return parse_fallback(language, path, text)

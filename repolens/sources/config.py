"""A project's configuration, language, framework and folders."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from fnmatch import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

# Files that name a project's language, in order; a star stands for any name.
LANGUAGE_FILES = {
    "python": ["requirements.txt", "setup.py", "pyproject.toml", "Pipfile", "poetry.lock"], "php": ["composer.json", "artisan"], "javascript": ["package.json"], "typescript": ["tsconfig.json"],
    "go": ["go.mod", "go.sum"], "rust": ["Cargo.toml"], "java": ["pom.xml", "build.gradle"], "kotlin": ["build.gradle.kts"], "ruby": ["Gemfile"], "csharp": ["*.csproj", "*.sln"], "dart": ["pubspec.yaml"],
}
# Fixed values: (framework, file, marks) by language, in order. A mark is a dependency in a JSON manifest, else a text; without marks the file is enough.
_NODE = [
    ("nextjs", "package.json", ["next"]), ("nestjs", "package.json", ["@nestjs/core"]), ("nuxt", "package.json", ["nuxt"]), ("sveltekit", "package.json", ["@sveltejs/kit"]),
    ("reactnative", "package.json", ["react-native", "expo"]), ("express", "package.json", ["express"]), ("node", "package.json", []),
]
FRAMEWORK_MARKS = {
    "php": [("symfony", "composer.json", ["symfony/framework-bundle"]), ("laravel", "artisan", [])], "javascript": _NODE, "typescript": _NODE,
    "python": [("django", "manage.py", []), ("django", "settings.py", []), *(("fastapi", f, ["fastapi", "flask"]) for f in ("requirements.txt", "pyproject.toml", "Pipfile"))],
    "ruby": [("rails", "config/routes.rb", [])], "go": [("go", "go.mod", ["gin-gonic", "echo", "go-chi"])], "rust": [("rust", "Cargo.toml", ["actix", "axum", "rocket"])],
    "java": [("spring", "pom.xml", ["spring-boot"]), ("spring", "build.gradle", ["spring-boot"])], "kotlin": [("spring", "build.gradle.kts", ["spring-boot"])],
    "csharp": [("aspnet", "*.csproj", ["Microsoft.AspNetCore", "Microsoft.NET.Sdk.Web"])], "dart": [("flutter", "pubspec.yaml", ["flutter:"])],
}
# Where frameworks keep things, in the order of CATEGORIES.
CATEGORIES = ["models", "controllers", "views", "services", "migrations", "routes", "middleware", "tests"]
_WEB = ["src/models", "src/controllers", "src/views", "src/services", "migrations", "src/routes", "src/middleware", "tests"]
_FOLDERS = {
    "laravel": ["app/Models", "app/Http/Controllers", "resources/views", "app/Services", "database/migrations", "routes", "app/Http/Middleware", "tests"],
    "django": [".", ".", "templates", ".", ".", ".", ".", "tests"],
    "rails": ["app/models", "app/controllers", "app/views", "app/services", "db/migrate", "config", "app/middleware", "test"],
    "nextjs": ["src/models", "src/app/api", "src/app", "src/services", "prisma/migrations", "src/app", "src/middleware", "__tests__"],
    "express": _WEB, "node": _WEB,
    "nestjs": ["src", "src", "src", "src", "src/migrations", "src", "src", "test"],
    "nuxt": ["server/models", "server/api", "pages", "composables", "server/migrations", "pages", "middleware", "test"],
    "sveltekit": ["src/lib/server", "src/routes", "src/routes", "src/lib", "migrations", "src/routes", "src", "tests"],
    "fastapi": ["app/models", "app/api", "templates", "app/services", "alembic/versions", "app/api", "app/middleware", "tests"],
    "symfony": ["src/Entity", "src/Controller", "templates", "src/Service", "migrations", "config/routes", "src/EventSubscriber", "tests"],
    "go": ["internal", "internal", "web", "internal", "migrations", "cmd", "internal/middleware", "tests"],
    "spring": ["src/main/java", "src/main/java", "src/main/resources/templates", "src/main/java", "src/main/resources/db/migration", "src/main/java", "src/main/java", "src/test/java"],
    "aspnet": ["Models", "Controllers", "Views", "Services", "Migrations", "Controllers", "Middleware", "Tests"],
    "flutter": ["lib/models", "lib/screens", "lib/screens", "lib/services", "migrations", "lib/router", "lib/middleware", "test"],
    "reactnative": ["src/models", "src/screens", "src/screens", "src/services", "migrations", "src/navigation", "src/middleware", "__tests__"],
}
FOLDERS = {framework: dict(zip(CATEGORIES, row, strict=True)) for framework, row in _FOLDERS.items()}
FOLDERS["laravel"]["requests"] = "app/Http/Requests"
# Folders that are categories of their own where they exist.
EXTRA_FOLDERS = [
    "app", "src", "lib", "pages", "api", "routes", "server", "client", "mobile", "web", "pkg", "internal", "cmd", "domain", "shared", "modules", "features", "hooks", "store", "stores", "services",
    "components", "screens", "navigation", "router", "providers", "contexts", "composables", "utils", "types", "tests", "test", "__tests__", "spec",
]
# Suffixes of source files by language and of templates by framework; folders that a structure leaves out.
LANGUAGE_SUFFIXES = {
    "php": [".php"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "typescript": [".ts", ".tsx"], "python": [".py", ".pyw"], "go": [".go"], "dart": [".dart"], "rust": [".rs"], "java": [".java"],
    "kotlin": [".kt", ".kts"], "csharp": [".cs"], "ruby": [".rb"], "swift": [".swift"],
}
TEMPLATE_SUFFIXES = {
    "laravel": [".blade.php"], "django": [".html", ".htm", ".txt"], "rails": [".erb", ".haml", ".slim"], "nextjs": [".tsx", ".jsx"], "express": [".ejs", ".hbs", ".pug"], "nuxt": [".vue"],
    "sveltekit": [".svelte"], "reactnative": [".tsx", ".jsx"],
}
LEFT_OUT = """
.git .svn .hg node_modules __pycache__ .venv venv vendor dist build target out bin obj .idea .vscode .vs .pytest_cache .tox .coverage .nyc_output
coverage htmlcov .DS_Store storage .next .nuxt
""".split()
WORKSPACES = ["apps", "packages", "services", "libs", "modules", "backend", "frontend", "server", "client", "web", "mobile"]
MANIFESTS = ["package.json", "pyproject.toml", "composer.json", "go.mod", "Cargo.toml", "pom.xml", "pubspec.yaml"]


@dataclass
class Structure:
    root: str
    language: str = "unknown"
    framework: str = "none"
    folders: dict[str, str] = field(default_factory=dict)
    workspaces: list[str] = field(default_factory=list)
    suffixes: list[str] = field(default_factory=list)
    left_out: list[str] = field(default_factory=list)

    def holds(self, path: Column) -> Column:
        """Whether a file is source or a template of the project's languages and frameworks, outside the folders left out."""
        ends = F.lit(False)
        for suffix in self.suffixes:
            ends = ends | F.lower(path).endswith(suffix)
        above = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
        return ends & ~F.arrays_overlap(above, F.array(*map(F.lit, self.left_out)))


def load_config(root: str) -> dict:
    """YAML, then YML, then JSON; a file that is broken, or holds anything but a mapping, counts as none."""
    for name in (".repolens.yaml", ".repolens.yml", ".repolens.json"):
        if not os.path.isfile(os.path.join(root, name)):
            continue
        text = _read(root, name)
        try:
            found = json.loads(text) if name.endswith(".json") else _yaml(text)
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}
    return {}


def _yaml(text: str):
    """A YAML document; without the library, the part that configurations use: keys, one level of nested keys, lists of plain values."""
    try:
        import yaml
    except ImportError:
        out: dict = {}
        key = None
        for line in text.splitlines():
            bare = line.split(" #")[0].rstrip()
            if not bare.strip() or bare.lstrip().startswith("#"):
                continue
            plain = lambda v: v.strip().strip("\"'")
            if not line.startswith((" ", "\t", "-")):
                key, _, value = bare.partition(":")
                out[key] = plain(value) if value.strip() else {}
            elif bare.strip().startswith("- "):
                out[key] = [*(out[key] or []), plain(bare.strip()[2:])]
            else:
                inner, _, value = bare.strip().partition(":")
                out[key][inner] = plain(value)
        return out
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def _read(root: str, name: str) -> str:
    try:
        with open(os.path.join(root, name), encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def _manifest(root: str, name: str) -> dict:
    try:
        found = json.loads(_read(root, name) or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _named(root: str, name: str) -> list[str]:
    """The files that a name with a star or a path means."""
    if "*" in name:
        return sorted(n for n in (os.listdir(root) if os.path.isdir(root) else []) if fnmatch(n, name))
    return [name] if os.path.isfile(os.path.join(root, name)) else []


def detect_language(root: str) -> str:
    found = next((language for language, names in LANGUAGE_FILES.items() if any(_named(root, n) for n in names)), "unknown")
    return "typescript" if found == "javascript" and _named(root, "tsconfig.json") else found


def detect_framework(root: str, language: str) -> str:
    for framework, name, marks in FRAMEWORK_MARKS.get(language, []):
        for file in _named(root, name):
            if not marks:
                return framework
            if file.endswith(".json"):
                manifest = _manifest(root, file)
                held = {k for part in ("require", "require-dev", "dependencies", "devDependencies") for k in (manifest.get(part) or {})}
                if held & set(marks):
                    return framework
            else:
                text = _read(root, file)
                if any(m in (text.lower() if language == "python" else text) for m in marks):
                    return framework
    return "none"


def detect_workspaces(root: str) -> list[str]:
    found = _manifest(root, "package.json").get("workspaces", [])
    found = found.get("packages", []) if isinstance(found, dict) else found
    if not found:
        found = re.findall(r"^\s*-\s*['\"]?([^'\"\n]+)", _read(root, "pnpm-workspace.yaml"), re.M)
    heads = [g.rstrip("/*") for g in found] or WORKSPACES
    out = []
    for head in heads:
        base = os.path.join(root, head)
        for name in sorted(os.listdir(base)) if os.path.isdir(base) else []:
            if any(os.path.isfile(os.path.join(base, name, m)) for m in MANIFESTS):
                out.append(f"{head}/{name}")
    return out


def _there(root: str, base: str, folder: str) -> str | None:
    """A default folder below ``base``, or the same without a leading ``src/``; None if neither is there."""
    ways = [folder, folder[4:]] if folder.startswith("src/") else [folder]
    return next((w for w in (os.path.normpath(os.path.join(base, w)) for w in ways) if os.path.isdir(os.path.join(root, w))), None)


def structure_of(root: str) -> Structure:
    """Configuration first, then the framework's folders, then well-known folders that are there, then workspaces with their own frameworks."""
    config = load_config(root)
    language = config.get("language") or detect_language(root)
    framework = config.get("framework") or detect_framework(root, language)
    folders = {k: _there(root, "", v) or v for k, v in FOLDERS.get(framework, {}).items()}
    folders |= config.get("scan_dirs") or {}
    for name in EXTRA_FOLDERS:
        if name not in folders and name not in folders.values() and os.path.isdir(os.path.join(root, name)):
            folders[name] = name
    workspaces = detect_workspaces(root)
    languages, frameworks = [language], [framework]
    for w in workspaces:
        at = os.path.join(root, w)
        own = detect_language(at)
        kind = detect_framework(at, own)
        folders.setdefault(os.path.basename(w), w)
        if kind not in frameworks:
            folders |= {f"{os.path.basename(w)}_{k}": there for k, v in FOLDERS.get(kind, {}).items() if (there := _there(root, w, v))}
        languages.append(own), frameworks.append(kind)
    suffixes = [x for name in languages for x in LANGUAGE_SUFFIXES.get(name, [])] + [x for name in frameworks for x in TEMPLATE_SUFFIXES.get(name, [])]
    if {".js", ".jsx", ".ts", ".tsx"} & set(suffixes):  # the two languages mix
        suffixes += LANGUAGE_SUFFIXES["javascript"] + LANGUAGE_SUFFIXES["typescript"]
    return Structure(root, language, framework, folders, workspaces, list(dict.fromkeys(suffixes)), [*LEFT_OUT, *(config.get("exclude_dirs") or [])])

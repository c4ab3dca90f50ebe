"""Files, configuration, validation and class hierarchies."""

import fnmatch
import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from repolens.functions import paths, validation
from repolens.operators import hierarchy, textsearch
from repolens.plans import index
from repolens.sources import config, files, tree


def test_file_statistics(spark):
    rows = [("a.py", b"x\ny\n"), ("b.bin", b"a\0b"), ("c.txt", "\ufeffhé".encode()), ("d.txt", b"h\xe9"), ("e.blade.php", b"")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r["path"]: r for r in files.stats(df).collect()}
    assert got["a.py"]["line_count"] == 2 and got["a.py"]["language"] == "python" and not got["b.bin"]["is_text"] and got["e.blade.php"]["language"] == "blade"
    text = {r["path"]: r["t"] for r in df.select("path", files.decoded(F.col("content")).alias("t")).collect()}
    assert text["c.txt"] == "hé" and text["d.txt"] == "hé"


def test_lists_and_dumps(spark, tmp_path):
    df = tree.from_tree(spark, {"a.py": "", "b.py": ""})
    files.shallow(df, str(tmp_path / "list"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "list")).collect()) == ["a.py", "b.py"]
    files.dump_json({"t": df.select("path")}, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/t")).count() == 2


@pytest.mark.parametrize(
    ("names", "language", "framework"),
    [
        ({"pyproject.toml": "dependencies=['fastapi']"}, "python", "fastapi"), ({"package.json": json.dumps({"dependencies": {"@nestjs/core": "1"}}), "tsconfig.json": "{}"}, "typescript", "nestjs"),
        ({"package.json": "{}"}, "javascript", "node"), ({"composer.json": json.dumps({"require": {"symfony/framework-bundle": "6"}})}, "php", "symfony"), ({"composer.json": "{}", "artisan": ""}, "php", "laravel"),
        ({"pubspec.yaml": "flutter:\n"}, "dart", "flutter"), ({"go.mod": ""}, "go", "none"), ({"go.mod": "require github.com/gin-gonic/gin"}, "go", "go"), ({"a.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web">'}, "csharp", "aspnet"), ({"a.csproj": ""}, "csharp", "none"),
        ({"Gemfile": "", "config/routes.rb": ""}, "ruby", "rails"), ({"build.gradle.kts": "spring-boot"}, "kotlin", "spring"), ({"package.json": json.dumps({"dependencies": {"expo": "1"}})}, "javascript", "reactnative"), ({}, "unknown", "none"), ({"package.json": "not json"}, "javascript", "node"),
    ],
)
def test_detection(tmp_path, names, language, framework):
    for name, text in names.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    s = config.structure_of(str(tmp_path))
    assert (s.language, s.framework) == (language, framework)


def test_configuration_wins_and_workspaces(tmp_path):
    (tmp_path / ".repolens.json").write_text(json.dumps({"language": "rust", "scan_dirs": {"services": "svc"}}))
    (tmp_path / "packages/a").mkdir(parents=True)
    (tmp_path / "packages/a/package.json").write_text("{}")
    s = config.structure_of(str(tmp_path))
    assert s.language == "rust" and s.folders["services"] == "svc" and s.workspaces == ["packages/a"]
    (tmp_path / ".repolens.json").write_text("[]")
    assert config.load_config(str(tmp_path)) == {}


def walked(root):
    """A plain walk with the same filters."""
    out = set()
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not (f in paths.EXCLUDED_DIRS or f.startswith("."))]
        for name in names:
            suffix = os.path.splitext(name)[1].lower()
            unwanted = any(fnmatch.fnmatchcase(name, p) for p in paths.EXCLUDED_FILES) or name.startswith(".")
            if suffix in {e.lower() for e in paths.EXTENSIONS} and not unwanted:
                out.add(os.path.relpath(os.path.join(folder, name), root))
    return out


NAMES = [
    "app/__init__.py", "app/__main__.py", "app/_util.py", "src/__tests__/a.test.js", "src/_app.tsx", "_private/_x/_y.py", "app/main.py", "web/a b+c%20d.py", "src/ü+.ts", "src/a b.py", "z.log", ".git/y.py",
    "src/.hidden/x.py", ".env.py", "deep/" + "/".join("abcdefghij") + "/k.go", "build/out.py", "data/dump.bin", "x.PY", "package-lock.json", "a~", "q?*[1].py",
]


@pytest.mark.parametrize("opened", [2000, 1])
def test_scan_finds_what_a_plain_walk_finds(spark, tmp_path, monkeypatch, opened):
    monkeypatch.setattr(tree, "WALKED", opened)
    for p in NAMES:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    (tmp_path / "app/loop").symlink_to(tmp_path / "app")
    (tmp_path / "app/gone.py").symlink_to(tmp_path / "nowhere.py")
    got = {r["path"]: bytes(r["content"]).decode() for r in tree.scan(spark, str(tmp_path)).collect()}
    assert set(got) == walked(tmp_path) - {"app/gone.py"} and "app/__init__.py" in got and "web/a b+c%20d.py" in got
    assert all(path == text for path, text in got.items())
    assert {r["path"] for r in tree.scan(spark, f"file://{tmp_path}").collect()} == set(got)
    listed = {r["path"]: r for r in tree.listing(spark, str(tmp_path)).collect()}
    assert all(listed[p]["length"] == len(p.encode()) and listed[p]["modified"] > 0 for p in got)


def test_scan_opens_nothing_that_is_excluded(spark, tmp_path):
    (tmp_path / "node_modules/m").mkdir(parents=True)
    os.mkfifo(tmp_path / "node_modules/m/x.js")  # to open it is to wait for ever
    os.mkfifo(tmp_path / "pipe.py")
    for large in ("data.sql", "node_modules/big.js", "big.bin"):
        with open(tmp_path / large, "wb") as f:
            f.truncate(3 * 2**30)
    (tmp_path / "a.py").write_text("x = 1\n")
    got = {r["path"]: r["content"] for r in tree.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "data.sql"} and got["data.sql"] is None and bytes(got["a.py"]) == b"x = 1\n"
    assert tree.scan(spark, str(tmp_path / "none")).count() == 0


def test_git_log_without_history(spark, tmp_path):
    assert tree.git_log(spark, str(tmp_path)).count() == 0


def test_hierarchy_edges(spark):
    source = {
        "a.php": "<?php\nclass Admin extends App\\User implements Logs, Saves {\n    use Audits, HasFactory;\n}\n", "b.py": "class B(A, metaclass=M):\n    pass\nclass C(pkg.A, object):\n    pass\n",
        "c.ts": "export class D<T> extends E<T> implements F {\n", "d.kt": "class G(val x: Int) : H(x), I\n", "e.cs": "public class J : K, L {\n", "f.rb": "class M < N::O\nend\n",
    }
    rows = spark.createDataFrame(list(source.items()), "file string, text string")
    lines = textsearch.lines_of(rows, "file", "text")
    ext = paths.extension(F.col("file"))
    got = {(r["kind"], r["child"], r["parent"]) for r in hierarchy.edges(lines, ext).collect()}
    assert {("extends", "Admin", "User"), ("implements", "Admin", "Logs"), ("implements", "Admin", "Saves"), ("extends", "C", "A"), ("extends", "D", "E"), ("implements", "D", "F")} <= got
    assert {("extends", "G", "H"), ("extends", "G", "I"), ("extends", "J", "K"), ("extends", "J", "L")} <= got
    classes = spark.createDataFrame([("a.php", "Admin", 2, 4)], "file string, child string, start int, end int")
    mixed = hierarchy.traits(lines, classes, ext)
    assert [(r["child"], r["parent"]) for r in mixed.collect()] == [("Admin", "Audits")]
    assert {(r["direction"], r["name"]) for r in hierarchy.around(hierarchy.edges(lines, ext), "A").collect()} == {("child", "B"), ("child", "C")}


def test_validation():
    assert validation.file_path("a/b.py") is None and validation.file_path("../a") and validation.file_path("C:\\a") and validation.file_path("")
    assert validation.glob("**/*.py") is None and validation.glob("/x")
    assert validation.search_pattern("a(b", regex=True) and validation.search_pattern("(?=x)", regex=True) and validation.search_pattern("x" * 1001)
    assert validation.page(0, 10) is None and validation.page(-1, 10) and validation.page(0, 0)
    assert validation.extensions([".py"]) is None and validation.extensions(["py"])


def test_folders_without_src_and_suffixes_of_workspaces(spark, tmp_path):
    for path, text in {"package.json": json.dumps({"dependencies": {"next": "1"}, "workspaces": ["apps/*"]}), "app/api/x.ts": "", "services/y.ts": "", "apps/shop/composer.json": "{}", "apps/shop/artisan": "", "apps/shop/app/Models/U.php": "", ".repolens.yaml": "exclude_dirs:\n  - legacy\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    s = config.structure_of(str(tmp_path))
    assert (s.framework, s.folders["controllers"], s.folders["services"], s.folders["models"]) == ("nextjs", "app/api", "services", "src/models")
    assert s.workspaces == ["apps/shop"] and s.folders["shop_models"] == "apps/shop/app/Models"
    paths = ["a.ts", "b.php", "c.blade.php", "d.cjs", "legacy/e.ts", "dist/f.ts", "g.py", "distance/h.jsx"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"] for r in df.where(s.holds(df["path"])).collect()} == {"a.ts", "b.php", "c.blade.php", "d.cjs", "distance/h.jsx"}


def test_broken_configuration_counts_as_none(tmp_path):
    (tmp_path / ".repolens.json").write_text("{broken")
    assert config.load_config(str(tmp_path)) == {}


def test_git_log_of_commits(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for n, names in enumerate((["a.py", "b c.py"], ["a.py"], ["a.py", "b c.py", "d.py"])):
        for name in names:
            (tmp_path / name).write_text(str(n))
        git("add", "-A"), git("commit", "-qm", f"{n}", "--date", f"2024-0{n + 1}-05T10:00:00")
    rows = sorted(tuple(r) for r in tree.git_log(spark, str(tmp_path)).collect())
    assert rows == [(0, "2024-03-05", "a.py"), (0, "2024-03-05", "b c.py"), (0, "2024-03-05", "d.py"), (1, "2024-02-05", "a.py"), (2, "2024-01-05", "a.py"), (2, "2024-01-05", "b c.py")]
    assert tree.git_log(spark, str(tmp_path), window=1).count() == 3
    pairs = index.cochanges(tree.git_log(spark, str(tmp_path)), spark.createDataFrame([("a.py",), ("b c.py",)], "path string"))
    assert pairs.count() > 0 and not any("d.py" in str(r) for r in pairs.collect())

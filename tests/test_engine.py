"""The tool surface on a tree on disk."""

import subprocess

import pytest
import trees

from repolens.plans.engine import Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in (trees.PYTHON | {"pyproject.toml": "[project]\nname='x'\n"}).items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "-A"), git("commit", "-qm", "one")
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    assert "6 files" in e.set_project_path(str(root)) or "files" in e.set_project_path(str(root))
    assert e.build_deep_index().startswith("Indexed 6 files")
    return e


def test_context_finds_direct_and_indirect(engine):
    c = engine.get_context("app/orders.py", symbol="total_for", change_type="signature_change")
    assert [x["file"] for x in c["direct_callers"]] == ["app/api.py"]
    assert [x["file"] for x in c["indirect_dependents"]] == ["tests/test_orders.py"]
    assert c["confidence"] in ("medium", "high") and c["edit_plan"]["steps"]
    assert {r["file"] for r in c["related_file_reasons"]} >= {"app/orders.py", "app/api.py", "tests/test_orders.py"}


def test_owner_keeps_callers_apart(engine):
    c = engine.get_context("app/models.py", symbol="save", owner="User")
    assert {x["file"] for x in c["direct_callers"]} == {"app/user_service.py"}


def test_search_and_files(engine):
    found = engine.search_code("total_for")
    assert found["total_matches"] == 3 and not found["has_more"]
    assert engine.search_code("total", regex=True)["status"] == "error"  # a plain word is no expression
    assert engine.find_files("*.py") and engine.find_files("API.PY") == ["app/api.py"]
    with_context = engine.search_code("return total_for", context_lines=1)
    assert [x["line"] for x in with_context["results"][0]["context"]] == [4, 5, 6]


def test_bodies_and_regions(engine):
    body = engine.get_symbol_body("app/orders.py", "total_for")
    assert body["code"].startswith("def total_for") and body["called_by"][0]["file"] == "app/api.py"
    region = engine.get_edit_region("app/orders.py", symbol="total_for", context_lines=0)
    assert region["text"].split("\n")[0] == "   1 | def total_for(order):"
    assert engine.get_edit_region("../x", start_line=1)["status"] == "error"


def test_queries_snapshot_and_errors(engine):
    assert engine.search_symbols("total for order")[0]["short_name"] == "total_for"
    snapshot = engine.get_project_snapshot()
    assert snapshot["language"] == "python" and snapshot["by_extension"][".py"] == 6
    assert engine.get_context(intent="project")["project_snapshot"]["total_files"] == 6
    assert engine.get_context("x.py", intent="nothing")["status"] == "error"
    assert engine.get_context()["status"] == "error"
    assert engine.get_context(query="zzzz qqqq")["status"] == "needs_target"


def test_large_answers_spill(engine):
    c = engine.get_context("app/orders.py", symbol="total_for")
    small = engine.spilled(c | {"filler": "x" * 5000})
    assert engine.get_context(small["detail_file"])["filler"]


def test_hierarchy_impact_and_ripple(engine):
    assert engine.get_class_hierarchy("User")["extended_by"] == []
    assert engine.get_impact_analysis("app/orders.py")["affected_files"] == 1
    ripple = engine.get_ripple_effect("app/orders.py", "total_for", "delete")
    assert ripple["categories"][0]["usages"] == 1 and ripple["risk_score"] > 0


def test_calls_are_checked(engine):
    assert engine.call("nothing")["status"] == "error"
    assert engine.call("get_symbol_body", file_path="/etc/passwd", symbol_name="x")["status"] == "error"
    assert engine.call("search_code", pattern="(", regex=True)["status"] == "error"
    assert engine.call("search_code", pattern="x", max_results=0)["status"] == "error"
    assert engine.call("search_code", pattern="total_for")["total_matches"] == 3
    assert engine.call("get_context", target="app/orders.py", symbol="total_for")["status"] == "success"


def project(spark, tmp_path, files, store=None):
    for path, text in files.items():
        (tmp_path / "p" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / path).write_text(text)
    e = Engine(spark, store)
    e.set_project_path(str(tmp_path / "p"))
    e.build_deep_index()
    return e


LARAVEL = {
    "composer.json": '{"require": {"laravel/framework": "^11"}}',
    "artisan": "",
    "app/Http/Controllers/HomeController.php": "<?php\nclass HomeController {\n    public function index() {\n        return 'ok';\n    }\n}\n",
    "app/Services/PricingService.php": "<?php\nclass PricingService {\n    public function rateFor($x) {\n        return $x;\n    }\n}\n",
    "app/Http/Controllers/CheckoutController.php": "<?php\nclass CheckoutController {\n    public function quote() {\n        return 1;\n    }\n}\n",
    "routes/web.php": "<?php\nRoute::get('/', [HomeController::class, 'index']);\nRoute::post('/checkout', [PricingService::class, 'quote']);\n",
    "bootstrap/app.php": "<?php\napp()->singleton(PricingService::class);\n",
    "database/migrations/2024_create_users.php": "<?php\nreturn new class {\n    public function up(): void {\n        Schema::table('users', function ($table) {\n            $table->index(['email']);\n        });\n    }\n};\n",
    "resources/views/home.blade.php": "<p>{{ $x }}</p>\n",
}


@pytest.fixture(scope="module")
def laravel(spark, tmp_path_factory):
    return project(spark, tmp_path_factory.mktemp("laravel"), LARAVEL)


def test_generic_names_in_migrations_are_no_callers(laravel):
    c = laravel.get_context("app/Http/Controllers/HomeController.php", symbol="index")
    assert c["symbol_context"]["found"]
    assert "database/migrations/2024_create_users.php" not in {x["file"] for x in c["direct_callers"]}


def test_framework_files_that_name_the_target_are_wired(laravel):
    c = laravel.get_context("app/Services/PricingService.php", symbol="rateFor", include_source=False)
    reasons = {r["file"]: r for r in c["related_file_reasons"]}
    for file in ("routes/web.php", "bootstrap/app.php"):
        assert reasons[file]["role"] == "framework_entrypoint" and reasons[file]["certainty"] == "probable" and reasons[file]["evidence_type"] == "framework_wiring"
        assert file in c["relationship_buckets"]["probable"]
    assert "app/Http/Controllers/HomeController.php" not in {f for f, r in reasons.items() if r["role"] == "framework_entrypoint"}


def test_callers_are_as_certain_as_their_evidence(spark):
    from pyspark.sql import functions as F

    from repolens.operators import evidence

    rows = [
        ("method_call", "index", "services", False, ("direct_caller", "certain", 90)), ("method_call", "scan", "services", False, ("direct_caller", "probable", 78)),
        ("instantiation", "scan", "other", False, ("direct_caller", "certain", 90)), ("method_call", "scan", "migrations", False, ("direct_caller", "probable", 78)),
        ("method_call", "index", "migrations", False, ("direct_caller", "probable", 78)), ("module_script", "index", "other", False, ("file_scope_caller", "certain", 80)),
        ("method_call", "index", "routes", True, ("framework_entrypoint", "probable", 82)),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "kind string, source string, category string, entry boolean")
    got = df.select(evidence.caller_grade(F.col("kind"), F.col("source"), F.col("category"), F.col("entry")).alias("g")).collect()
    assert [tuple(r["g"]) for r in got] == [r[4] for r in rows]


def test_hooks_are_no_impact_and_counts_are_whole(spark, tmp_path):
    files = {"app/base.py": "class Base:\n    def __init__(self):\n        pass\n\n    def work_done(self):\n        return 1\n"}
    files |= {f"app/user_{i:02d}.py": f"from app.base import Base\n\n\ndef use_{i}():\n    b = Base()\n    return b.work_done()\n" for i in range(60)}
    e = project(spark, tmp_path, files)
    c = e.get_context("app/base.py", symbol="work_done", owner="Base")
    assert c["impact_context"]["affected_files"] == 60 and c["impact_context"]["risk_level"] == "critical"
    assert e.get_impact_analysis("app/base.py")["affected_files"] == 60
    assert c["blast_radius"]["direct_usages"] == 60 and len(c["direct_callers"]) == 10


def test_excerpts_see_whole_files(spark, tmp_path):
    long = "".join(f"x{i} = {i}\n" for i in range(20_000)) + "def at_the_end():\n    return 1\n"
    e = project(spark, tmp_path, {"app/long.py": long, "app/short.py": "def short_one():\n    return 2\n"})
    assert e.get_edit_region("app/long.py", start_line=20_001, end_line=20_002, context_lines=0)["text"] == "20001 | def at_the_end():\n20002 |     return 1"
    assert e.get_edit_region("app/none.py", start_line=1)["status"] == "error"


def test_one_file_is_parsed_again(spark, tmp_path):
    e = project(spark, tmp_path, trees.PYTHON, str(tmp_path / "store"))
    (tmp_path / "p/app/api.py").write_text("from app.orders import total_for\n\n\ndef show_all(order):\n    return total_for(order)\n")
    (tmp_path / "p/app/models.py").unlink()
    assert "6 files" in e.reindex_file("app/api.py") and "5 files" in e.reindex_file("app/models.py")
    c = e.get_context("app/orders.py", symbol="total_for")
    assert [x["snippets"][0]["line"] for x in c["direct_callers"]] == [4] and e.search_symbols("show all")[0]["short_name"] == "show_all"
    assert e.search_symbols("User")[:1] == [] or e.search_symbols("User")[0]["file"] != "app/models.py"


def test_semantic_peers_of_source_are_source(spark, tmp_path):
    files = {"app/service.py": 'def greet(name):\n    """Greet a person by name."""\n    return name\n', "app/greeter_helpers.py": "def format_greet_name(x):\n    return x\n"}
    files |= {"tests/test_service.py": "def test_greet_name():\n    pass\n", "fixtures/demo_case.py": "def greet_name_case():\n    pass\n"}
    e = project(spark, tmp_path, files)
    c = e.get_context("app/service.py", symbol="greet")
    alike = {r["file"] for r in c["related_file_reasons"] if r["role"] == "semantic_related"}
    assert alike == {"app/greeter_helpers.py"}
    q = e.get_context(query="greet person name")
    assert q["query_resolution"]["target"] == "app/service.py" and q["query_resolution"]["selection_reason"] and all(a["rejected_reason"] for a in q["query_resolution"]["alternatives"])


def test_headers_over_two_lines_have_parents(spark, tmp_path):
    files = {"src/a.ts": "export class Derived\n  extends Base\n  implements Shape, Other {\n}\n", "src/b.ts": "export class Base {}\n"}
    h = project(spark, tmp_path, files).get_class_hierarchy("Derived")
    assert h["extends"] == ["Base"] and sorted(h["implements"]) == ["Other", "Shape"]


def test_scope_is_a_category_or_a_folder(engine):
    found = engine.find_references("total_for", scope="app")
    assert {r["file"] for r in found.collect()} == {"app/api.py"}
    assert engine.find_references("total_for", scope="tests").count() == 0


def test_hybrid_search_fuses_vectors(engine):
    plain = engine.search_symbols("total for order")
    engine.hybrid = True
    try:
        fused = engine.search_symbols("total for order")
    finally:
        engine.hybrid = False
    assert fused[0]["short_name"] == plain[0]["short_name"] == "total_for" and fused[0]["score"] != plain[0]["score"]


def test_settings_are_kept_by_project(tmp_path):
    from repolens.sources import settings

    assert settings.load(str(tmp_path), "/a") == {}
    assert settings.save(str(tmp_path), "/a", depth=3, theme="x") == {"depth": 3, "theme": "x"}
    assert settings.save(str(tmp_path), "/a", theme=None) == {"depth": 3} == settings.load(str(tmp_path), "/a")
    assert settings.load(str(tmp_path), "/b") == {}
    settings.clear(str(tmp_path), "/a")
    assert settings.load(str(tmp_path), "/a") == {}


def test_settings_steer_the_engine(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.py").write_text("def f():\n    pass\n")
    e = Engine(spark, settings_path=str(tmp_path / "s"))
    e.set_project_path(str(tmp_path / "p"))
    assert e.configure(nothing=1)["status"] == e.configure(git_window="x")["status"] == "error"
    assert e.configure(spill_chars=10, hybrid=True, max_related=3)["settings"] == {"hybrid": True, "max_related": 3, "spill_chars": 10}
    again = Engine(spark, settings_path=str(tmp_path / "s"))
    again.set_project_path(str(tmp_path / "p"))
    assert again.hybrid and again.setting("git_window") == 500 and "detail_file" in again.spilled({"status": "success", "x": "y" * 20})
    assert again.configure(spill_chars=None)["settings"] == {"hybrid": True, "max_related": 3} and again.setting("spill_chars") == 3500
    assert again.get_context(".repolens/output/../../../../etc/passwd")["status"] == "error"


def test_index_as_json(spark, tmp_path):
    from repolens.plans import index
    from repolens.sources import files, tree

    tables = index.build(tree.parse_files(tree.from_tree(spark, trees.PYTHON)))
    files.dump_json(tables, str(tmp_path))
    again = files.load_json(spark, {k: v.schema for k, v in tables.items()}, str(tmp_path))
    for name, df in tables.items():
        assert sorted(map(str, again[name].collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize(
    ("tree", "target", "symbol", "direct", "indirect"),
    [
        (trees.JAVASCRIPT | {"package.json": '{"dependencies": {"express": "4"}}'}, "src/services/pricing.js", "rateFor", {"src/controllers/api.js"}, {"tests/api.test.js"}),
        (trees.GO | {"go.mod": "module shop"}, "internal/pricing/service.go", "RateFor", {"internal/api/handler.go"}, {"internal/api/handler_test.go"}),
        (trees.DART | {"pubspec.yaml": "flutter:\n"}, "lib/services/pricing_service.dart", "rateFor", {"lib/screens/checkout_screen.dart"}, {"test/checkout_screen_test.dart"}),
        (trees.JAVA, "src/main/java/PricingService.java", "rateFor", {"src/main/java/CheckoutController.java"}, set()),
        (trees.PHP | {"composer.json": "{}"}, "src/SessionService.php", "refresh", {"bootstrap.php"}, set()),
    ],
    ids=["javascript", "go", "dart", "java", "php"],
)
def test_contexts_in_other_languages(spark, tmp_path, tree, target, symbol, direct, indirect):
    c = project(spark, tmp_path, tree).get_context(target, symbol=symbol)
    assert {x["file"] for x in c["direct_callers"]} == direct and {x["file"] for x in c["indirect_dependents"]} == indirect
    assert c["confidence"] in ("medium", "high") and c["edit_plan"]["steps"] and set(c["related_files"]) >= {target} | direct | indirect

"""The index after changes against a full build; searches through trigrams and identifiers against scans of all lines."""

import os
import random
import re

import pytest
import trees
from pyspark.sql import functions as F

from repolens.functions import paths, syntax
from repolens.operators import graph, textindex, textsearch
from repolens.plans import index
from repolens.plans.engine import Engine
from repolens.sources import store, tree

PHP_TREE = {
    "src/Base.php": "<?php\nclass Base {\n    public function save_all($x) {\n        return $x;\n    }\n}\n", "src/Größe.php": "<?php\n// Größe größe\nfunction größe() { return save_all(1); }\n",
    "src/Child.php": "<?php\nclass Child\n  extends Base {\n    use Logs;\n    public function go() { $b = new Base(); $b->save_all(2); Base::save_all(3); }\n}\n", "lib/run.rb": "x = Base.save_all\nsave_all!(3)\n# save_all\nputs unsave_all\n",
    "src/Main.java": "class Main extends Base {\n  void f(Base b) { b.save_all(1); }\n}\n",
}


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def contents_of(e):
    """All tables as plain rows; blocks by their files, posting lists by path."""
    out = {}
    for name in [*store.BY_PATH, *store.WHOLE]:
        df = e.tables[name]
        if name == "gram_files":
            lists = e.tables["grams"].select("block", "gram", F.explode("numbers").alias("number"))
            df = lists.join(df, ["block", "number"]).groupBy("path").agg(F.array_sort(F.collect_list("gram")).alias("grams"))
        elif name == "snapshot":
            df = df.drop("modified")
        out[name] = sorted(map(str, df.select(sorted(df.columns)).collect()))
    return out


def test_random_edits_equal_a_full_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MAX_SEGMENTS", 2)
    root, rng = tmp_path / "p", random.Random(7)
    files = trees.ALL | PHP_TREE
    write(root, files)
    e = Engine(spark, str(tmp_path / "store"))
    e.set_project_path(str(root))
    e.build_deep_index()
    for step in range(3):
        names = sorted(p for p in files if (root / p).exists())
        changed = rng.sample(names, 3)
        (root / changed[0]).unlink()
        (root / changed[1]).write_text((root / changed[1]).read_text() + f"\n# added {step}\n")
        os.utime(root / changed[2], (step, step))  # another time, the same content
        write(root, {f"new/_n{step}.py": f"from app.orders import total_for\n\n\ndef made_{step}():\n    return total_for({step})\n"})
        said = e.update_index()
    again = Engine(spark, str(tmp_path / "other"))
    again.set_project_path(str(root))
    assert again.build_deep_index() == said
    assert contents_of(e) == contents_of(again)
    assert index.metadata(e.tables).first() == index.metadata(again.tables).first()
    rows = sorted(map(str, index.edges(e.tables).collect()))
    assert rows == sorted(map(str, index.edges(again.tables).collect())) and rows
    segments = store._manifest(spark, e.store_path)
    assert len(segments) == 2, "three were merged, one was added"
    last = f"{e.store_path}/segments/{segments[-1]['segment']}"
    assert spark.read.parquet(f"{last}/snapshot").count() == 2 and spark.read.parquet(f"{last}/covers").count() == 3, "the changed file and the new one; the deleted one too"
    assert e.update_index() == said and len(store._manifest(spark, e.store_path)) == len(segments), "nothing changed"


def test_versions_of_the_schema(spark, tmp_path, monkeypatch):
    write(tmp_path / "p", trees.PYTHON)
    e = Engine(spark, str(tmp_path / "store"))
    e.set_project_path(str(tmp_path / "p"))
    e.build_deep_index()
    assert index.refs(store.load(spark, e.store_path)).count() == index.refs(e.tables).count() > 0
    monkeypatch.setattr(store, "SCHEMA_VERSION", store.SCHEMA_VERSION + 1)
    assert store.load(spark, e.store_path) is None and store.load(spark, str(tmp_path / "nowhere")) is None
    store.drop(spark, e.store_path)
    monkeypatch.undo()
    assert store.load(spark, e.store_path) is None


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("searched"), random.Random(3)
    words = ["alpha", "Beta", "gamma", "deltaX", "épsilon", "İstanbul", "Kelvin", "zeta_1", "foo.bar", "a+b", "x[0]", "ß", "==", "\t"]
    files = {f"d{i % 5}/f{i}.py": "".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(rng.randint(0, 12))) for i in range(60)}
    files |= {"rare.md": "a needle_in_haystack here\n", "latin.txt.py": "plain\n"} | PHP_TREE
    write(root, files)
    (root / "latin.py").write_bytes(b"caf\xe9 gamma\n")
    (root / "bin.py").write_bytes(b"gamma\0gamma\n")
    e = Engine(spark)
    e.set_project_path(str(root))
    e.build_deep_index()
    lines = textsearch.lines_of(e._texts(e.files), "path", "text").persist()
    lines.count()
    return e, lines


def test_search_equals_the_scan(searched):
    e, lines = searched
    asked = [("gamma", {}), ("GAMMA", {"case_sensitive": False}), ("kelvin", {"case_sensitive": False}), ("istanbul", {"case_sensitive": False}), ("é", {}), ("Beta gam|needle", {"regex": True}), ("(alpha|Beta) ?gamma", {"regex": True}),
             ("zeta_[0-9]$", {"regex": True}), ("beta", {"fuzzy": True}), ("al", {"fuzzy": True}), ("(?:ga){1,2}mm.*delta", {"regex": True, "case_sensitive": False}), ("nowhere at all", {})]
    for pattern, how in asked:
        got = e.search_code(pattern, max_results=1000, **({"regex": False} | how))
        hit = textsearch.matcher(F.col("text"), pattern, how.get("case_sensitive", True), how.get("regex", False), how.get("fuzzy", False))
        expected = sorted((r["file"], r["line"], r["text"]) for r in lines.where(hit).collect())
        assert [(r["file"], r["line"], r["text"]) for r in got["results"]] == expected and got["total_matches"] == len(expected), pattern


def test_a_rare_literal_reads_few_files(searched):
    e, _ = searched
    files = e._meeting(textindex.literal_condition("needle_in_haystack")).collect()
    assert [f["path"] for f in files] == ["rare.md"] and e.files.count() > 60


def test_conditions_hold_for_every_match():
    rng = random.Random(5)
    atoms = ["a", "b", "ab", "abc", ".", "[ab]", "a?", "(?:ab|c)", "(bc)+", "(?:abc)*", "c{2,3}", r"\w", r"\b", "^", "$", "(?:a|)", "(ab|bc)c", "B", "é", r"\.", "(?=ab)"]

    def meets(have, condition):
        if isinstance(condition, int):
            return condition in have
        return (all if condition[0] == "all" else any)(meets(have, c) for c in condition[1])

    useful = 0
    for _ in range(4000):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 6)))
        text = "".join(rng.choice("abcABé. ") for _ in range(rng.randint(0, 14)))
        for case in (True, False):
            condition = textindex.regex_condition(pattern, case)
            useful += condition != textindex.ANY
            if re.search(pattern if case else f"(?i){pattern}", text, re.A):
                assert meets(set(textindex.grams_of(text).tolist()), condition), (pattern, text)
    assert useful > 500
    for foreign in ("a++b", r"\Qabc\E", "[a[bc]d]ef", "[abc&&b]", "(?x)a b c", r"\p{L}abc", r"\habc", "(?<n>abc)"):
        assert textindex.regex_condition(foreign) == textindex.ANY


def test_references_by_identifier_equal_the_line_scan(searched):
    e, lines = searched
    for symbol, owner in (("save_all", None), ("save_all", "Base"), ("Base", None), ("größe", None), ("save_all!", None)):
        kind = F.lit(None).cast("string")
        for lang in syntax.SYNTAX.values():
            kind = F.when(paths.extension(F.col("file")).isin(list(lang.extensions)), syntax.classify_usage(F.col("text"), symbol, lang)).otherwise(kind)
        scan = lines.where(~paths.has_indexed_edges(F.col("file")) & F.col("text").contains(symbol)).select("file", "line", kind.alias("kind")).where("kind IS NOT NULL")
        if owner:
            scan = scan.join(lines.where(F.col("text").contains(owner)).select("file").dropDuplicates(), "file", "left_semi")
        got = sorted(map(tuple, e._scanned_usages(symbol, owner).collect()))
        assert got == sorted(map(tuple, scan.collect())) and (got or symbol[-1] == "!"), symbol


def test_files_changed_since_the_build_are_searched_too(spark, tmp_path):
    write(tmp_path, PHP_TREE)
    e = Engine(spark)
    e.set_project_path(str(tmp_path))
    e.build_deep_index()
    write(tmp_path, {"src/New.java": "class New { void f(Base b) { b.save_all(9); } }\n", "src/Main.java": "class Main { }\n"})
    e.refresh_index()
    assert {r["file"] for r in e.search_code("save_all(9)", regex=False)["results"]} == {"src/New.java"}
    found = {r["file"] for r in e._scanned_usages("save_all", None).collect()}
    assert "src/New.java" in found and "src/Main.java" not in found


def test_hierarchy_is_answered_from_the_index(searched):
    e, _ = searched
    h = e.get_class_hierarchy("Base")
    assert sorted(x["name"] for x in h["extended_by"]) == ["Child", "Main"] and h["total"] == 2
    assert e.get_class_hierarchy("Child")["mixes_in"] == ["Logs"] and e.get_class_hierarchy("Child")["extends"] == ["Base"]
    second = e.get_class_hierarchy("Base", start_index=1, max_results=1)
    assert len(second["extended_by"]) == 1 and second["total"] == 2
    e.files.unpersist()


def test_a_common_name_is_no_product(spark):
    """1,000 definitions and 10,000 calls of one name are 11,000 rows, and an answer about it too."""
    rows = [(f"d{i}.py", "def save():\n    pass\n") for i in range(1000)] + [(f"c{i}.py", "".join(f"def f{j}(x):\n    x.save()\n    save()\n\n\n" for j in range(100))) for i in range(100)]
    tables = index.derive(tree.parse_files(spark.createDataFrame([(p, bytearray(t, "utf-8")) for p, t in rows], "path string, content binary").repartition(4)))
    tables = {k: v.persist() for k, v in tables.items() if k in ("calls", "names", "symbols")}
    callers = tables["calls"].where("called = 'save'").select("caller").distinct().count()
    assert callers == 10_000 and tables["names"].where("name = 'save'").count() == 1000
    means = graph.callee_match(tables["symbols"], "save")
    assert index.few(tables, means) is None
    found = index.usages(tables, means)
    assert found.agg(F.count(F.lit(1)), F.min("times"), F.max("times")).first()[:] == (10_000, 1000, 1000)
    one = tables["symbols"].where("path = 'd7.py'")
    assert index.edges(tables, one, index.few(tables, one)).count() == index.refs(tables, one).count() == 10_000
    for df in tables.values():
        df.unpersist()


def test_a_caller_by_several_names_counts_a_symbol_once(spark):
    files = {"a.py": "class User:\n    def save(self):\n        pass\n", "b.py": "def save():\n    pass\n", "c.py": "from a import User\n\n\ndef go(x):\n    u = User()\n    u.save()\n    save()\n"}
    tables = index.derive(tree.parse_files(tree.from_tree(spark, files)))
    means = graph.callee_match(tables["symbols"], "save")
    pairs = index.refs(tables, means).groupBy("caller_symbol_id").count().collect()
    for some in (None, index.few(tables, means)):
        assert sorted(r["times"] for r in index.usages(tables, means, some).collect()) == sorted(r["count"] for r in pairs)

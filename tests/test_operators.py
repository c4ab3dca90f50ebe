"""Operators on small frames, and every registered query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from repolens.functions import names, paths
from repolens.functions.pytokens import tokenize
from repolens.functions.syntax import SYNTAX, classify_usage, declarations
from repolens.functions.tokenize import tokens
from repolens.operators import cochange, evidence, graph, project, textsearch
from repolens.plans import registry
from repolens.streaming import upserts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None:
        return "null"
    if isinstance(x, float):
        return f"{x:.4f}"
    if isinstance(x, (list, tuple)):
        return str([value(v) for v in x])
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    expected = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    order = [expected.columns.index(c) for c in columns]
    assert got == sorted(tuple(value(r[i]) for i in order) for r in expected.fetchall())


@pytest.mark.parametrize("text", ["HTTPServer fooBar", "snake_case x", "ABCd", "", "a1B2c3", "the Of getURLs"])
def test_tokens_agree_on_both_sides(spark, text):
    assert spark.range(1).select(tokens(F.lit(text)).alias("t")).first()["t"] == tokenize(text)


def test_globs_and_roles(spark):
    rows = spark.createDataFrame([(p,) for p in ("a.py", "src/a.py", "src/B.PY", "tests/a.py", ".repolens/output/x.json", "docs/a.md")], "path string")
    tier = {r["path"]: r["t"] for r in rows.select("path", paths.match_tier(F.col("path"), "a.py").alias("t")).collect()}
    assert tier["a.py"] == 0 and tier["src/a.py"] == 0 and tier["src/B.PY"] is None
    role = {r["path"]: r["r"] for r in rows.select("path", paths.path_role(F.col("path")).alias("r")).collect()}
    assert role["tests/a.py"] == "test" and role[".repolens/output/x.json"] == "generated" and role["docs/a.md"] == "docs"
    assert paths.glob_regex("a/**/b?.p*") == r"^a/.*/b[^/]\.p[^/]*$"


def test_names(spark):
    one = spark.createDataFrame([("a.b.c",), ("plain",), ("bad name",), ("Ödeme",)], "n string")
    got = {r["n"]: r for r in one.select("n", names.owner(F.col("n")).alias("o"), names.member(F.col("n")).alias("m"), names.is_clean(F.col("n")).alias("c"), names.is_identifier(F.col("n")).alias("i")).collect()}
    assert (got["a.b.c"]["o"], got["a.b.c"]["m"]) == ("a.b", "c") and not got["bad name"]["c"]
    assert got["Ödeme"]["c"] and not got["Ödeme"]["i"]


@pytest.mark.parametrize(
    ("language", "line", "kind"),
    [
        ("php", "use App\\Models\\User;", "import"), ("php", "use User;", "mixin_include"), ("php", "class A extends User {", "extends_or_implements"), ("php", "$u = new User();", "instantiation"),
        ("php", "User::find(1);", "static_call"), ("php", "$x->User();", "method_call"), ("php", "function f(User $u) {", "type_hint"), ("php", "// User", None), ("typescript", "<User name='x' />", "instantiation"),
        ("rust", "let a = make(User);", "reference"), ("python", "# User", None), ("java", "nothing here", None),
    ],
)
def test_usage_kinds(spark, language, line, kind):
    assert spark.range(1).select(classify_usage(F.lit(line), "User", SYNTAX[language]).alias("k")).first()["k"] == kind


def test_declarations():
    text = "export const load = async (x) => x\nclass A extends B {}\nfunction go() {}\n"
    assert declarations(text, SYNTAX["javascript"]) == [("class", "A", 2), ("function", "load", 1), ("function", "go", 3)]


def test_resolution_tiers(spark):
    symbols = spark.createDataFrame([("a::f", "f"), ("b::X.f", "X.f"), ("c::Y.X.f", "Y.X.f")], "symbol_id string, short string")
    calls = spark.createDataFrame([("c1", "f"), ("c2", "X.f"), ("c3", "a::f"), ("c4", "none"), ("c5", None)], "caller string, called string")
    got = {(r["caller"], r["symbol_id"], r["tier"]) for r in graph.resolve_calls(calls, symbols, "caller", "called", "symbol_id", "short").collect()}
    assert got == {("c1", "a::f", 1), ("c2", "b::X.f", 1), ("c3", "a::f", 0)}


def test_cochange_limits_commit_size(spark):
    rows = [(0, "d2", f"f{i}") for i in range(31)] + [(1, "d1", "a"), (1, "d1", "b"), (2, "d0", "a"), (2, "d0", "b"), (3, "d0", "a")]
    pairs = cochange.cochange_pairs(spark.createDataFrame(rows, "pos int, date string, file string"), "pos", "file", "pos", "date").collect()
    assert [tuple(p) for p in pairs] == [("a", "b", 2, "d1")]


def test_lane_precedence(spark):
    lanes = spark.createDataFrame([("x", "co_change"), ("x", "direct_caller"), ("y", "semantic_related"), ("t", "direct_caller"), ("z", "ripple")], "file string, lane string")
    got = [(r["file"], r["role"], r["priority"]) for r in evidence.related_reasons(lanes, "t").orderBy("rank").collect()]
    assert got == [("x", "direct_caller", 90), ("z", "ripple", 60), ("y", "semantic_related", 30)]


def test_search_guards():
    with pytest.raises(textsearch.SearchError):
        textsearch.matcher(F.lit("x"), "")
    assert not textsearch.is_regex("plain") and not textsearch.is_regex("(.*)+") and textsearch.is_regex("a.*b")


def test_best_tier_of_nothing(spark):
    assert project.best_tier(spark.createDataFrame([], "path string, tier int"), "tier").count() == 0


def test_streaming_upserts(spark, tmp_path):
    schema = "key long, seq long, v string"
    feed, table = tmp_path / "feed", str(tmp_path / "table")
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], schema).coalesce(1).write.parquet(str(feed / "0"))
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(feed))
    upserts.start(read(), table, "key", "seq", str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([(2, 5, "d"), (3, 1, "e")], schema).coalesce(1).write.parquet(str(feed / "1"))
    upserts.start(read(), table, "key", "seq", str(tmp_path / "check")).awaitTermination()
    got = {(r["key"], r["v"]) for r in upserts.current(spark, table, read().schema).collect()}
    assert got == {(1, "c"), (2, "d"), (3, "e")}
    first, second = sorted((tmp_path / "table" / "data").iterdir())
    buckets = lambda folder: {p.name for p in folder.iterdir() if p.is_dir()}
    assert len(buckets(first)) == 2 and len(buckets(second)) == 2, "the bucket of key 1 isn't written again"
    assert upserts.current(spark, str(tmp_path / "nothing"), read().schema).count() == 0


def test_percentiles_by_counts_equal_a_sort(spark):
    import random

    from repolens.operators import project

    rng = random.Random(2)
    rows = [(g, rng.choice([None, 1.5, *(rng.gauss(0, 9) for _ in range(9))])) for g in ("a", "b", None) for _ in range(700)] + [("one", 4.0), ("none", None)] + [("hot", 2.0)] * 3000 + [("hot", 3.0)] * 90
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    expected = set()
    for g in {g for g, _ in rows}:
        own = sorted((v for x, v in rows if x == g), key=lambda v: (v is not None, v or 0))
        expected.add((g, *(own[int(s * (len(own) - 1) + 0.5)] for s in shares.values())))
    df = spark.createDataFrame(rows, "g string, v double")
    assert {tuple(r) for r in project.nearest_rank(df, "v", ["g"], shares).collect()} == expected
    own = sorted((v for _, v in rows), key=lambda v: (v is not None, v or 0))
    assert [tuple(r) for r in project.nearest_rank(df, "v", [], {"p95": 0.95}).collect()] == [(own[int(0.95 * (len(own) - 1) + 0.5)],)]
    assert project.nearest_rank(df.where("false"), "v", ["g"], shares).count() == 0

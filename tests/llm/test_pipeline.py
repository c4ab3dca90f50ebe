"""The pipeline's stages and registry."""

import os
import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from test_corpus import brute_classes
from tokenizers import Tokenizer

import __spark_entry__
from repolens.llm import common, mixing, quality
from repolens.llm import queries as llm_queries


def test_stages_chain(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, source).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] == counts[2] and counts[-1] > 0


def test_empty_and_awkward_tables(spark, documents, nothing, tmp_path):
    for label, docs in (("nothing", nothing), ("awkward", documents)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / label / name))
            docs = spark.read.parquet(str(tmp_path / label / name))


def test_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


def without_repeats(rows):
    """{doc_id: text} without the words that 13-word windows of smaller documents cover; lines stay lines."""
    least, words = {}, {i: t.encode().split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, i), i)
    out = {}
    for i, t in rows:
        w, lines, at = words[i], [], 0
        gone = {k + j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for j in range(13)}
        for line in t.encode().split(b"\n"):
            own = line.split()
            left = [x for j, x in enumerate(own) if at + j not in gone]
            at += len(own)
            if left or not own:
                lines.append(b" ".join(left))
        out[i] = b"\n".join(lines).strip().decode() if gone else t
    return out


def test_run_equals_brute_force(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    fine = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    rows = [r for r in con.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall() if r[0] in fine]
    classes = brute_classes([(i, t) for i, t, _ in rows])
    heads = [(i, t) for i, t, _ in rows if classes[i] == i]
    texts, source = without_repeats(heads), {i: s for i, _, s in rows}
    con.execute("CREATE TABLE left_over (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO left_over VALUES (?, ?, ?)", [(i, t, source[i]) for i, t in texts.items()])
    taken = con.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL.replace('FROM documents', 'FROM left_over')})").fetchall()
    tok, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, size, n in taken:
        copies = [texts[i]] * (n // size if size else 0)
        if size and n % size:
            copies.append(" ".join(re.findall(r"[^ \t-\r]+", texts[i])[: n % size]))
        for text in copies:
            expected[i] += len(tok.encode(text, add_special_tokens=False).ids) + 1
    lengths, sequences = Counter(), defaultdict(list)
    for r in got:
        lengths[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(heads) < len(rows) < 200 and lengths == expected
    for parts in sequences.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(parts[-1]) <= 1024


def test_scratch_goes(spark, tmp_path):
    common.clean_scratch(spark)
    spark.range(20).selectExpr("id AS doc_id", "concat('the cat and the dog of the house number ', id, ' is in a garden with that bird for it and was on a tree ', id) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    other = common.stash(spark.range(5), "other")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert other.count() == 5  # what was there before the run stays
    held = [p for p in common._WRITTEN if "mix_sources" in p]
    assert len(held) == 1 and not any(n in p for p in common._WRITTEN for n in ("quality_rules", "near_dedup", "substring_dedup"))
    assert out.count() > 0
    common.clean_scratch(spark)
    assert not common._WRITTEN and not os.path.exists(held[0].removeprefix("file:"))


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    source, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{source}/{table}.parquet'")
    df = llm_queries.queries()[name](spark, source)
    found = con.execute(llm_queries.oracle_sql()[name])
    columns, names = sorted(df.columns), [d[0] for d in found.description]
    assert columns == sorted(names)
    value = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    expected = sorted(tuple(value(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(value(r[c]) for c in columns) for r in df.collect()) == expected

"""Extraction, search, packing, language model, substring and near-duplicate operators against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repolens.llm import htmltext, languagemodel, orderminhash, packing, substrings, vafile

PATH = public_tokenizers.path("byte_bpe_50k.json")

PAGE = """<html><head><title>T</title></head><body><header>Site <a href=/>home</a></header><nav><ul><li>a<li>b</ul></nav><div id="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><article><h1>T&eacute;st &lt;b&gt;</h1><p><b>One<br>two &nbsp; three<p>Four <a href=x>five</a>. a < b<form>mail</form><aside>side</aside><ul><li>i1<li>i2</ul>
<section class="comments"><p>first!</p></section></article><footer>f</footer><!-- <p>x</p> --><script>if (a<b) "</p>"</script></body></html>"""


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    return {(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(df).collect()}


def test_page_structure(spark):
    got = texts(spark, [(1, "http://h/1", PAGE), (2, None, None), (None, "u", ""), (3, "http://h/3", "plain words"), (3, "http://h/3", "plain words")])
    expected = "T\u00e9st <b>\nOne two three\nFour five. a < b\ni1\ni2"
    assert got == {(1, expected, len(expected)), (2, "", 0), (None, "", 0), (3, "plain words", 11)}
    assert texts(spark, []) == set()


def test_repeated_text_on_a_host_goes_and_unique_stays(spark):
    page = lambda i: f"<body><div>Welcome to the great site of all things</div><div>Only page {i} says number {i * i} in this unique way {i}</div><div>Terms of use apply to all visitors here</div></body>"
    got = texts(spark, [(i, f"http://one.example/{i}", page(i)) for i in range(12)] + [(99, "http://other.example/", page(99))])
    for i, text, _ in got:
        own = f"Only page {i} says number {i * i} in this unique way {i}"
        assert (text == own) if i < 99 else (text.count("\n") == 2 and own in text)


def test_copies_of_an_article_are_no_template(spark):
    got = texts(spark, [(i, f"http://h/{i}", "<article><p>the very same article text</p></article>") for i in range(30)])
    assert {t for _, t, _ in got} == {"the very same article text"}


def test_the_lead_in_an_articles_own_header_is_text(spark):
    page = "<body><article><header><h1>Title</h1><p>This is the lead of the whole article, in one sentence.</p><p>12 May</p><p class='byline'>By a person who writes about many things here.</p></header><p>Body text.</p></article></body>"
    assert {t for _, t, _ in texts(spark, [(1, "http://h/1", page)])} == {"Title\nThis is the lead of the whole article, in one sentence.\nBody text."}


def test_broken_pages_of_a_megabyte_take_linear_time():
    import time

    for page in ("<div><section>" * 40_000 + "</b></i></zz>" * 40_000, "<ul>" + "<div>" * 60_000 + "<li>x" * 60_000):
        began = time.perf_counter()
        htmltext.blocks(page)
        assert time.perf_counter() - began < 10


def boilerplate(streams, article):
    """Per stream the blocks that windows on enough pages cover, by brute force."""
    run, need = htmltext.MIN_RUN, htmltext.needed(len(streams), article)
    tokens = [[x for j, line in enumerate(lines) for x in [(None, -1), *((w, j) for w in line.split())]] + [(None, -1)] for lines in streams]
    where = defaultdict(set)
    for k, t in enumerate(tokens):
        for i in range(len(t) - run + 1):
            where[tuple(w for w, _ in t[i : i + run])].add(k)
    out = []
    for lines, t in zip(streams, tokens, strict=True):
        hit = {i + d for i in range(len(t) - run + 1) if len(where[tuple(w for w, _ in t[i : i + run])]) >= need for d in range(run)}
        gone = set()
        for j, line in enumerate(lines):
            n = len(line.split())
            covered = sum(i in hit for i, (_, b) in enumerate(t) if b == j)
            if n + 2 < run and sum(line in other for other in streams) >= need:
                covered = n
            if covered >= htmltext.COVER * n:
                gone.add(j)
        out.append([line for j, line in enumerate(lines) if j not in gone])
    return out


@pytest.mark.parametrize(("group_pages", "article"), [(2000, False), (7, False), (7, True), (1, False)])
def test_runs_against_brute_force_however_pages_are_dealt(spark, group_pages, article):
    rng = random.Random(5)
    template = [f"t{k}" for k in range(60)]
    streams = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(2, 6)):
            a = rng.randint(0, 45)
            kind = rng.random()
            lines.append(" ".join(template[a : a + rng.randint(3, 30)] if kind < 0.3 else template[:20] if kind < 0.5 else ["same", "line"] if kind < 0.6 else [f"u{i}.{rng.randint(0, 99)}" for _ in range(rng.randint(1, 20))]))
        streams.append(lines + ([" ".join(template[30:55])] if rng.random() < 0.95 else []))
    wrap = "<article>{}</article>" if article else "<body>{}</body>"
    rows = [(i, "http://h/x", wrap.format("".join(f"<p>{x}</p>" for x in lines))) for i, lines in enumerate(streams)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), group_pages=group_pages).collect()}
    assert got == {i: "\n".join(lines) for i, lines in enumerate(boilerplate(streams, article))}


def test_one_page_on_two_hosts(spark):
    rows = [(1, f"http://{h}/", "<p>our common line of words</p><p>unique words of one</p>") for h in "ab"]
    rows += [(i, "http://a/", f"<p>our common line of words</p><p>others {i}</p>") for i in range(2, 9)]
    assert {(t, n) for i, t, n in texts(spark, rows) if i == 1} == {("unique words of one", 19), ("our common line of words\nunique words of one", 44)}


def test_suffix_array():
    r = np.random.default_rng(0).integers(0, 3, 200)
    order, common = htmltext.suffix_array(r, 1024)
    assert order.tolist() == sorted(range(200), key=lambda i: r[i:].tolist())
    for k in range(1, 200):
        a, b, n = order[k - 1], order[k], 0
        while max(a, b) + n < 200 and r[a + n] == r[b + n]:
            n += 1
        assert common[k] == n


def test_exact_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 0, 0.3, 0.5, 1.0]) * rng.random() for _ in range(8)]) for i in range(90)]
    rows += [(100, None), (101, [1.0, None] * 4), (102, [float("nan")] * 8), (103, [float("inf")] * 8), (None, [1.0] * 8), (104, []), (105, [0.5] * 4), (120, [0.25] * 4), (60, rows[60][1]), (91, [0.0] * 8), (92, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank")
    got = [tuple(r) for r in vafile.top_k(df, df["vec_id"] % 20 == 0).collect()]
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, qv in dict((i, (i, v)) for i, v in usable if i % 20 == 0).values():
        scores = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(qv))[:20]
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert sorted(got) == sorted(expected)
    assert vafile.top_k(df.where("vec_id < 0"), df["vec_id"] % 20 == 0).count() == 0


@pytest.mark.parametrize("size", [1, 1e4, 2.3e7, 1e9])
def test_exact_top_k_of_large_values_and_repeated_ids(spark, size):
    rng = random.Random(2)
    first = lambda i: size if i % 20 else min(size, 2.3e7**2 / size)  # noqa: E731  queries so that 64 bits hold the products
    rows = [(i, [first(i) * rng.uniform(-1.5, 1.5), *(rng.uniform(-1.5, 1.5) for _ in range(7))]) for i in range(200)] + [(20, [1.5 * first(20)] + [1.5] * 7)] * 30
    scaled = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = []
    for q in range(0, 200, 20):
        for qv in {tuple(v) for i, v in scaled if i == q}:
            scores = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in scaled if i != q)[:20]
            expected += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert sorted(tuple(r) for r in vafile.top_k(df, df["vec_id"] % 20 == 0).collect()) == sorted(expected)


def test_bounds_skip_nearly_all_exact_vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (8000, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None] * rng.choice([1, 5000])).astype(np.int64)
    low, width, cells = vafile.approximate(x)
    assert len(cells) == len(x) * 64 * vafile.BITS / 8
    edge, ids, k = vafile.edges(low, width, cells, len(x)), np.arange(len(x)), 20
    assert ((edge <= x) & (x < edge + width)).all()
    read = 0
    for i, rows, upper, lows in vafile.scan(x[:50], ids[:50], low, width, edge, ids, k, np.full(50, -np.inf)):
        found, scores, n = vafile.read_exact(x[i], x, ids, rows, upper, k, lows[k - 1])
        exact = x @ x[i]
        exact[i] = -(2**62)
        order = np.lexsort((ids, -exact))[:k]
        assert found.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()
        read += n
    assert read < 0.02 * 50 * len(x)


def test_packing_round_trip(spark, documents, nothing):
    tok = Tokenizer.from_file(PATH)
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in packing.pack(documents, PATH).collect():
        got[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and r["length"] == len(r["ids"]) // 4 > 0
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024
    full = sum(sum(n for _, n in rows) == 1024 for rows in sequences.values())
    assert full >= len(sequences) - 1 and sorted(sequences) == list(range(len(sequences)))
    expected = Counter((r["doc_id"], np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for r in documents.collect())
    single = {k: v for k, v in expected.items() if Counter(d for d, _ in expected.elements())[k[0]] == 1}
    for doc, ids in single:
        assert b"".join(r["ids"] for r in sorted(got[doc], key=lambda r: r["start"])) == ids
    assert sum(r["length"] for rows in got.values() for r in rows) == sum(len(i) // 4 * n for (_, i), n in expected.items())
    assert packing.pack(nothing, PATH).count() == 0


def test_encoder_equals_library():
    tok = Tokenizer.from_file(PATH)
    odd = ["a  b\n\n c\t\td \n", "  ", "\n", " x", "don't  <|endoftext|> it's ok  z", "a\x1cb \x1d c", "\u00e9\u0085x  \u3000 y", "\r\n\r\nq  ", "x" * 150_000, ""]
    assert [i.tolist() for i in packing.Encoder(PATH)(odd)] == [tok.encode(t, add_special_tokens=False).ids for t in odd]


def test_hilbert_neighbours_are_adjacent():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert(grid, 3)
    walk = grid[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def check_scores(rows, got):
    """All columns against counts in dictionaries."""
    rows = [(i, (t or "").encode().lower().split() + [b"<e>"]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c, pairs, triples, docs = Counter(), Counter(), Counter(), 0
    around = lambda w: zip([b"<s>", b"<s>", *w[:-2]][: len(w)], [b"<s>", *w[:-1]], w, strict=True)
    for i, w in rows:
        if not held(i):
            docs += 1
            c.update(w)
            pairs.update(zip([b"<s>", *w[:-1]], w, strict=True)), triples.update(around(w))
    pairs[b"<s>", b"<s>"] = c[b"<s>"] = docs
    n, v = sum(c.values()) - docs, len(c) - 1
    p1 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    mu_2, mu_3 = languagemodel.MU_2, languagemodel.MU_3
    p2 = lambda v, w: (pairs[v, w] + mu_2 * p1(w)) / (c[v] + mu_2)
    p3 = lambda u, v, w: (triples[u, v, w] + mu_3 * p2(v, w)) / (pairs[u, v] + mu_3)
    expected = sorted((str(i), held(i), len(w), sum(x in c for x in w), n, round(sum(math.log10(p1(x)) for x in w), 6)) for i, w in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    by_id = {r["doc_id"]: r for r in got}
    for i, w in rows:
        assert abs(by_id[i]["score"] - sum(math.log10(p3(*x)) for x in around(w))) < 5e-4 * len(w)


def test_language_model(spark, documents, nothing):
    check_scores([(r["doc_id"], r["text"]) for r in documents.collect()], languagemodel.score_documents(documents).collect())
    assert languagemodel.score_documents(nothing).count() == 0


def test_language_model_with_more_words_than_a_short_product_holds(spark):
    rows = [(i, " ".join(f"w{(i * 7919 + k * k) % 250_000}" for k in range(9000))) for i in range(40)]
    check_scores(rows, languagemodel.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_elias_fano_and_trie():
    rng = np.random.default_rng(1)
    for n, u in ((0, 1), (1, 5), (1000, 10), (5000, 10**9), (300, 301), (70000, 2**40)):
        v = np.sort(rng.integers(0, u, n))
        e = languagemodel.EliasFano(languagemodel.EliasFano.encode(v, u))
        assert (e.get(np.arange(n)) == v).all() and (e.get(np.arange(n)[::-7]) == v[::-7]).all()
    w = 300
    pairs = np.unique(rng.integers(0, w * w, 4000))
    triples = np.unique(rng.integers(0, len(pairs) * w, 6000))
    trie = languagemodel.Trie(w, pairs // w, pairs % w, np.arange(len(pairs), dtype=np.uint16), triples // w, triples % w, np.arange(len(triples), dtype=np.uint16))
    asked = rng.permutation(w * w)
    found = trie.pairs(asked // w, asked % w)
    assert sorted(asked[found >= 0]) == pairs.tolist() and (pairs[found[found >= 0]] == asked[found >= 0]).all()
    asked = rng.permutation(len(pairs) * w)
    found = trie.triples(asked // w, asked % w)
    assert sorted(asked[found >= 0]) == triples.tolist() and (triples[found[found >= 0]] == asked[found >= 0]).all()
    assert trie.nbytes < 6 * (len(pairs) + len(triples)) + 8000


def test_language_model_packets_grow_with_the_batches_alone():
    pa, key = languagemodel.pa, (languagemodel.pa.scalar("b"),)
    for shards in (1, 7):
        for n in (50, 500):
            parsed = languagemodel._parsed([pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": [" ".join(f"{i}.{k}" for k in range(60)) for i in range(n)]})])
            asked = pa.Table.from_batches(languagemodel._word_asker(shards)(iter([parsed])))
            totals = [languagemodel._word_counter((pa.scalar(s),), asked.filter(pa.compute.equal(asked.column("shard"), s))) for s in range(shards)]
            totals = pa.concat_tables(totals)
            assert asked.num_rows == shards
            packets = languagemodel._gram_asker(shards, shards)(key, pa.Table.from_batches([parsed]), totals.filter(totals.column("batch").is_valid()))
            assert packets.num_rows == shards


def brute_spans(rows):
    """(doc_id, n_words, n_removed, digest) of each row."""
    least = {}
    big = float("inf")
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, big), big if i is None else i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {k + j for k in range(len(w) - 12) if i is not None and least[tuple(w[k : k + 13])] < i for j in range(13)}
        out.append((str(i), len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


def spans(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digests(df).collect())


def test_substrings(spark, documents, nothing, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert spans(documents) == brute_spans(rows)
    assert spans(nothing) == []
    unlike = spark.createDataFrame([(i, " ".join(f"{i}.{k}" for k in range(40))) for i in range(5)], "doc_id long, text string")
    assert [n for _, _, n, _ in spans(unlike)] == [0] * 5
    out = substrings.deduped(documents)
    assert out.columns == documents.columns and out.count() == documents.count()
    assert substrings.deduped(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substrings_random(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(6)]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 40))) for _ in range(6)]
    rows = [(rng.randint(0, 30), " ".join(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(words + ["z"], k=5)) for _ in range(rng.randint(0, 6)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert spans(df) == brute_spans(rows)


@pytest.mark.parametrize("hot_docs", [1, 3])
def test_common_anchors_are_split(spark, hot_docs):
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(30)]
    rows = [(i, " ".join([*rng.choices("abcdef", k=8), *passage[rng.randint(0, 5) : rng.randint(20, 30)], *rng.choices("abcdef", k=8)])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.digests(df, hot_docs=hot_docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_spans(rows)


def test_packets_grow_with_the_batches_alone():
    table = lambda n: substrings.pa.table({"doc_id": list(range(n)), "text_key": [0] * n, "text": [" ".join(f"{i}.{k}" for k in range(60)) for i in range(n)]})
    key = (substrings.pa.scalar(0),)
    for shards in (1, 7):
        sizes = [substrings._asker(shards)(key, table(n)).num_rows for n in (50, 500)]
        assert sizes == [shards, shards]


@pytest.mark.parametrize("seed", range(6))
def test_factors_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    ids = np.sort(rng.integers(0, 12, 25))
    seeds = [rng.integers(0, 3, 40) for _ in range(3)]
    pieces = [np.concatenate([s[rng.integers(0, 10) : rng.integers(20, 40)] for s in rng.permutation(seeds)[: rng.integers(1, 3)]]).astype(np.uint64) for _ in ids]
    words, piece = np.concatenate(pieces), np.repeat(np.arange(25), list(map(len, pieces)))
    start, count, origin = substrings.factors(words, piece, ids)
    grams = defaultdict(list)
    for x in range(len(words) - 12):
        if piece[x] == piece[x + 12]:
            grams[words[x : x + 13].tobytes()].append(x)
    expected = {x for g in grams.values() for x in g if ids[piece[g[0]]] < ids[piece[x]]}
    assert {x + k for x, n in zip(start, count, strict=True) for k in range(n)} == expected
    for x, n, o in zip(start, count, origin, strict=True):
        assert (words[x : x + n + 12] == words[o : o + n + 12]).all() and ids[piece[o]] < ids[piece[x]] and piece[o] == piece[o + n + 11]


def test_factors_follow_their_source():
    a = list(range(1, 31))
    words = np.array(a + [99] + a[5:25], np.uint64)
    piece = np.array([0] * 30 + [1] * 21)
    start, count, origin = substrings.factors(words, piece, np.array([1, 2]))
    assert (start.tolist(), count.tolist(), origin.tolist()) == ([31], [8], [5])


def brute_classes(rows):
    """{doc_id: class id} by comparing all pairs of distinct texts."""
    oldest = {}
    for i, t in rows:
        oldest[t] = min(oldest.get(t, i), i)
    found = list(oldest)
    kmers = [orderminhash.labelled_kmers(w) for w in orderminhash.word_hashes(found)]
    label = list(range(len(found)))
    for x in range(len(found)):
        for y in range(x):
            if orderminhash.similarity(kmers[x], kmers[y]) >= 0.8:
                a, b = label[x], label[y]
                label = [min(a, b) if k in (a, b) else k for k in label]
    least = {}
    for t, k in zip(found, label, strict=True):
        least[k] = min(least.get(k, oldest[t]), oldest[t])
    return {i: least[label[found.index(t)]] for i, t in rows}


def near_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    shared = rng.choices(vocabulary, k=40)
    rows = []
    for base in range(12):
        text = (shared if base % 3 == 0 else []) + rng.choices(vocabulary, k=rng.randint(30, 250))
        for copy in range(rng.randint(1, 7)):
            changed = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append((100 * copy + base, " ".join(changed)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in orderminhash.near_duplicates(df).collect()} == brute_classes(rows)
    kept = [r["doc_id"] for r in orderminhash.one_per_class(df).collect()]
    assert sorted(kept) == sorted(set(brute_classes(rows).values()))


def test_pairs_in_a_family_of_one_template(spark):
    # all share a template that gives 0.78; the planted pairs have four more words in common, which gives 0.81
    template, n, planted = " ".join(f"t{k}" for k in range(200)), 2000, 40
    tail = lambda i, a=0: " ".join(f"o{i}.{k}" for k in range(a, 27))
    shared = lambda i: " ".join(f"s{i}.{k}" for k in range(4))
    rows = [(i, f"{template} {tail(i)}") for i in range(n)]
    rows += [(x * 10_000 + i, f"{template} {shared(i)} {tail(x * 10_000 + i, 4)}") for i in range(planted) for x in (1, 2)]
    kmers = [orderminhash.labelled_kmers(w) for w in orderminhash.word_hashes([rows[0][1], rows[1][1], rows[n][1], rows[n + 1][1]])]
    assert 0.7 < orderminhash.similarity(kmers[0], kmers[1], 0.5) < 0.79 and 0.8 <= orderminhash.similarity(kmers[2], kmers[3]) < 0.85
    got = {r["doc_id"]: r["class_id"] for r in orderminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 10_000 if i >= 20_000 else i for i, _ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_prefix_filter_keeps_every_similar_pair(spark, seed):
    rng = random.Random(seed)
    template = rng.choices([f"t{k}" for k in range(90)], k=rng.choice([12, 60, 120]))
    rows = []
    for i in range(120):
        text = template + [f"{rng.randint(0, 20)}.{k}" for k in range(rng.randint(0, len(template) // 3))]
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = f"x{rng.randint(0, 3)}"
        rows.append((i, " ".join(text[rng.randint(0, 3) :])))
    kmers = [orderminhash.labelled_kmers(w) for w in orderminhash.word_hashes([t for _, t in rows])]
    similar = {(x, y) for x in range(len(rows)) for y in range(x) if orderminhash.similarity(kmers[x], kmers[y]) >= 0.8}
    held = spark.createDataFrame(rows, "nid long, text string")
    members = spark.createDataFrame([(i, len(kmers[i]), i) for i, _ in rows], "nid long, size int, label long")
    found = {(r["a"], r["b"]) for r in orderminhash._rest(members, held, 0.8).collect()}
    assert similar and similar <= found


def test_near_copies_of_five_thousand_rows_are_found(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(20_000)]
    rows, twins = [], []
    for i in range(2500):
        words = rng.choices(vocabulary, k=rng.randint(60, 200))
        copy = list(words)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, copy)]
        if len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1]):
            twins.append(i)
    got = {r["doc_id"]: r["class_id"] for r in orderminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(twins) > 1500 and sum(got[2 * i] == got[2 * i + 1] for i in twins) >= 0.99 * len(twins)
    assert all(got[i] // 2 == i // 2 for i, _ in rows)


def test_near_duplicates_edges(documents, nothing):
    rows = orderminhash.near_duplicates(documents).collect()
    assert len(rows) == documents.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add(r["class_id"])
    assert by_id[1] == by_id[2] == {1} and by_id[4] == {4} and by_id[5] == {5} and by_id[6] == {6}
    assert orderminhash.near_duplicates(nothing).count() == 0 and orderminhash.one_per_class(nothing).count() == 0
    assert orderminhash.one_per_class(documents).columns == documents.columns


def test_alignment_follows_order():
    words = [f"w{k}" for k in range(60)]
    a, b, c = (orderminhash.labelled_kmers(w) for w in orderminhash.word_hashes([" ".join(words), " ".join(words[:59]), " ".join(words[30:] + words[:30])]))
    assert orderminhash.similarity(a, b) > 0.95 and orderminhash.similarity(a, c) < 0.8


LONG = "This is a paragraph of the article itself, which has more than twenty-five words in two sentences. So it reads like text, and it has no links at all."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body class='has-sidebar'><article class='post comments-open no-ads'><header><h1>Title</h1><p>By me</p></header><p>Body</p><figure><img><figcaption>Caption</figcaption></figure></article>", "Title\nBody\nCaption"),
        ("<div id=wrap><div class=siteHeader>S</div><div class='main-content with-sidebar'><div class=post-header><h2>T</h2><span>meta</span></div><p>A<p>B</div><div class=sideBar>x</div><div class='widget-area'>w</div></div>", "T\nA\nB"),
        ("<main><h1>H</h1><p>x &amp; y</p><div role=alert>n</div><div style='display: none'>h</div><p hidden>z</p><ol><li>1</li><li>2</ol><nav>m</nav></main><aside>q</aside>", "H\nx & y\n1\n2"),
        ("<article><p>a<b>b</b>c</p><pre>  p\n q </pre><table><tr><td>1<td>2<tr><td>3</table><textarea>t</textarea><select><option>o</select><style>s{}</style></article>", "abc\np q\n1 2\n3"),
        ("<article><p>One</p><article class=comment><p>c</p></article><div id=disqus_thread>d</div><div class='ad ad-wide'>x</div><p>Two</article>", "One\nTwo"),
        ("<article class='post ad-free'><p>Text of it</p></article>", "Text of it"),
        ("<article><p>One.</p><section class='legal-analysis'><p>" + LONG + "</p></section><div class='search-results'><a href=1>a</a> <a href=2>b</a></div><section class=search-results><p>" + LONG + "</p></section></article>", f"One.\n{LONG}\n{LONG}"),
        ("<article><p>One.</p><section><h2>3 Comments</h2><p>" + LONG + "</p><div><p>me too</p></div></section><p>Two.</p></article>", "One.\nTwo."),
        ("<article><h1>T</h1><p>One.</p><h2>Comments (2)</h2><p>first!</p><h3>re</h3><p>second</p><h2>Sources</h2><p>Two.</p></article>", "T\nOne.\nSources\nTwo."),
        ("<article class=card><p>A teaser.</p></article><div id=content><p>" + LONG + "</p><p>" + LONG + "</p></div>", f"{LONG}\n{LONG}"),
        ('<article><p>go <a title="oops>here</a> now <b class="x">bold</b>', "go here now bold"),
        ('<article><p title="a > b" data-x="<i>">fine</p><p><a title="oops>end</a>', "fine\nend"),
        ("<div><p>See <a href=x>the whole long story of this here</a> now</p><ul><li><a href=y>Home</a><li><a href=z>About</a></ul></div>", "See the whole long story of this here now"),
        ("<div class=sidebar><p>" + LONG + "</p></div>", LONG),
        ("<article><p>" + "long " * 300_000 + "<a " + "x" * 100_000 + "></p>" + "<p title=\"y>z</p>" * 2000 + "</article>", ("long " * 300_000).strip() + "\nz" * 2000),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<article><p>unclosed <a href='x>y'>l</a> <!-- c > d --> end <img alt='>'> &#233;&#x41;&nosuchthing; 1<2 <button>b</button>tail</article>", "unclosed l end éA&nosuchthing; 1<2 tail"),
    ],
)
def test_tricky_pages(page, text):
    found, around = htmltext.blocks(page)
    inside, _ = htmltext.marked(found, around)
    assert "\n".join(b.text for j, b in enumerate(found) if inside[j]) == text

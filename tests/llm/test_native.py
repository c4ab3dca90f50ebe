"""Quality rules, URL rules, sharding and mixing against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from repolens.llm import mixing, quality, sharding, urlrules
from repolens.llm.common import numbered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts(documents):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(documents).collect())
    expected = Counter()
    for r in documents.collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        expected[(r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)] += 1
    assert got == expected


def test_clean_texts_of_any_language_stay(spark):
    rows = [
        (1, "W Szczebrzeszynie chrząszcz brzmi w trzcinie i Szczebrzeszyn z tego słynie, a woda w rzece jest czysta, bo nikt jej nie brudzi przez cały rok", None),
        (2, "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita e non so ben ridir come", None),
        (3, "人 人生 而 自由 在 尊严 和 权利 上 一律 平等 他们 赋有 理性 和 良心 并 应 以 兄弟 关系 的 精神 相对待 大家 都", None),
        (4, "Watu wote wamezaliwa huru hadhi zao sawa wote wamejaliwa akili dhamiri hivyo yapasa watendeane kindugu kila mmoja wao siku zote duniani kote pamoja", "sw"),
        (5, "qzv wxk plm trb gfd hjk zzq vbn mnb lkj hgf dsa poi uyt rew qaz wsx edc rfv tgb yhn ujm iko lpo", "en"),
        (6, "qzv wxk plm trb gfd hjk zzq vbn mnb lkj hgf dsa poi uyt rew qaz wsx edc rfv tgb yhn ujm iko lpo", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality.kept_documents(df).collect()} == {1, 2, 3, 4}


def test_quality_keeps_columns_and_verdicts(documents, nothing):
    kept = quality.kept_documents(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {11} | {r["doc_id"] for r in quality.judge(documents).where("kept").collect()}
    assert quality.kept_documents(nothing).count() == 0 and quality.judge(nothing).count() == 0


URLS = [
    "http://a.example.com/en/71?x", "https://EXAMPLE.com/en/8#t", "http://com/en/", "http://x.example.net/de/81/y", "http://net/de", "ftp://b.org/es/1", "no scheme", None, "", "http://",
    "http://www.spam-farm.example.org/", "http://antispam-farmer.org/", "http://h.net/de/1?u=http://x", "x://notcom/en/", "http://\u00c9.com/en/7", "http://a.com:80/en/1",
    "http://a.fr/WP-Admin/x", "http://a.fr/x/wp-admins", "http://a.fr/file.EXE?x", "http://a.fr/fileexe", "http://zip/x", "http://a.fr/p;jsessionid=7", "http://a.fr/?mysid=7&u=1", "http://a.fr/?u=1&sid=7", "http://a.fr/" + "y/" * 9000 + "login",
]


def expected_url(url):
    u = url or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(s), s, v) for v, s in urlrules.SITE_RULES if (host == s.partition("/")[0] or host.endswith("." + s.partition("/")[0])) and path.startswith("/" + s.partition("/")[2])]
    rule = max(fits) if fits else None
    low = u.lower() if u else ""
    rest = low.split("://", 1)[1] if "://" in low else None
    bad = any(re.search(rf"[?&;]{re.escape(k)}=", low) for k in urlrules.QUERY_KEYS)
    if rest is not None:
        site = re.split("[/?#]", rest, maxsplit=1)[0]
        tail = re.split("[?#]", rest[len(site) :], maxsplit=1)[0]
        bad |= any(re.search(rf"(^|[-.]){re.escape(w)}([-.:]|$)", site) for w in urlrules.HOST_WORDS)
        bad |= bool(set(tail.split("/")[1:]) & set(urlrules.PATH_SEGMENTS)) or any(tail.endswith("." + e) for e in urlrules.EXTENSIONS)
    return host, path, rule[1] if rule else None, rule[2] if rule else ("block" if bad else "allow")


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)] + [(0, URLS[0], "mine")], "page_id long, url string, verdict string")
    got = sorted(tuple(r) for r in urlrules.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect())
    assert [g[1:] for g in got] == [expected_url(URLS[g[0]]) for g in got] and len(got) == len(URLS) + 1
    assert urlrules.filter_urls(pages.where("page_id < 0")).count() == 0


def test_url_rules_of_any_number(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.b/x"), (2, "http://k77.b/x"), (3, "http://k7.b/" + "x" * 100_000 + "/k2999")], "page_id long, url string")
    with pytest.raises(ValueError):
        urlrules.filter_urls(pages, rules=[urlrules.Rule(None, "block", "url", ".", (), 1)])
    rules = [urlrules.host_word(f"k{i}") for i in range(2000)] + [urlrules.path_segment(f"k{i}") for i in range(2000, 3000)]
    for most in (urlrules.BROADCAST_RULES, 0):
        monkeypatch.setattr(urlrules, "BROADCAST_RULES", most)
        got = urlrules.filter_urls(pages, rules=urlrules.rules_table(spark, rules))
        assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "allow", 2: "block", 3: "block"}
    assert len(urlrules.RULES) >= 200


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(t,) for t in ["com"] * 5 + ["en"] * 9 + ["de"] * 2], "token string")
    table = urlrules.rules_table(spark, [urlrules.site_rule("block", s) for s in ("com/en/", "com/de/", "org/es/")])
    assert {r["name"]: r["token"] for r in urlrules.rule_index(urls, table).collect()} == {"com/en/": "com", "com/de/": "de", "org/es/": "es"}


def test_sharding_law(spark, documents, nothing):
    rows = sharding.assign(documents).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == documents.count()
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert sizes == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in documents.collect())
    assert sharding.assign(nothing).count() == 0
    many = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    counts = Counter(r["shard"] for r in sharding.assign(many).collect())
    assert len(counts) == 16 and max(counts.values()) < 1.25 * min(counts.values())


def test_weight_changes_move_rows_only_into_or_out_of_a_subtree(spark):
    many = spark.range(5000).selectExpr("id AS doc_id", "'t' AS text")
    before = {r["doc_id"]: r["shard"] for r in sharding.assign(many).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.assign(many, weights={5: 3.0}).collect()}
    moved = {k for k in before if before[k] != after[k]}
    assert moved and all(after[k] // 4 == 1 for k in moved)  # all end in the region whose weight rose


def expected_mix(rows):
    size = lambda t: len(WORD.findall(t or ""))
    totals = defaultdict(int)
    for _, t, s in rows:
        totals[s] += size(t)
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None] * (None in totals)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(totals.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * totals[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        open_ -= over
    return totals, target


def test_mixing(documents, nothing):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    totals, target = expected_mix(rows)
    got = mixing.mix(documents).collect()
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == totals[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents).collect()))
    assert mixing.mix(nothing).count() == 0
    out = mixing.mixed_documents(documents)
    assert out.columns == documents.columns
    assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == sum(taken.values())
    assert mixing.mixed_documents(nothing).count() == 0


def test_digest_order_is_md5(documents):
    row = documents.select(mixing._digest(documents["doc_id"], documents["text"], "s").alias("h"), "doc_id", "text").where("doc_id = 3").first()
    assert row["h"] == hashlib.md5(b"3/s/" + row["text"].encode()).hexdigest()


def test_sharding_equals_sql(spark):
    import duckdb

    source = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{source}'")
    got = sorted((r["doc_id"], r["size"], r["shard"], r["grown_shard"]) for r in sharding.assign(spark.read.parquet(source)).collect())
    assert got == sorted(con.sql(f"SELECT doc_id, size, shard, grown_shard FROM ({sharding.SQL})").fetchall())


def test_slots_follow_one_order_at_every_size(spark):
    rows = [(k * 7919 % 1000, k % 3) for k in range(1000)]
    df = spark.createDataFrame(rows, "x long, shard long").repartition(4)
    expected = {(x, g): i for g in range(3) for i, (x, _) in enumerate(sorted(r for r in rows if r[1] == g))}
    for span in (10_000, 100):
        got = {(r["x"], r["shard"]): r["slot"] for r in numbered(df, [df["x"]], "slot", within="shard", span=span).collect()}
        assert got == expected

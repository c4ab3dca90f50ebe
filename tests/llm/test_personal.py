"""Personal data: base patterns against plain regular expressions, the bootstrap against a plain loop over a graph in memory."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from repolens.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, spans string, uid long"


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def spans(text):
    return [f"{personal.KINDS[f.kind]}:{f.start}:{f.end}" for f in personal.base(text) if f.valid]


@pytest.mark.parametrize("alphabet", ["a1.@-", "0123.", "45 -", "+1 ().-9", "a.b@c.d@ \n", "1.@a+- é"])
def test_base_patterns_on_random_texts(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert spans(text) == plain(text), text


def test_base_patterns():
    text = "a@b.c, x.y+z@mail.example.com. 4111 1111 1111 1111 and 4111-1111-1111-1112; 10.0.0.256 10.1.2.3.4.5.6.7 +1 (487) 555-7209 é@b.c a@b@c.d +12 345"
    assert spans(text) == plain(text) and len(spans(text)) == 7
    for long in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "@" * 100_000, "+1" * 50_000, "a@" * 50_000, "1 " * 100_000, "é" * 100_000 + "1"):
        personal.scan(long)


def brute(texts):
    """Spans of each text: the graph in dictionaries, rounds as loops."""
    found = [personal.scan(t or "") for t in texts]
    kinds, fits, entities = defaultdict(set), set(), defaultdict(set)
    seen = defaultdict(set)
    for _, own in found:
        for e in own:
            for p in e["patterns"]:
                seen[p].add(e["entity"])
                kinds[p, e["entity"]].add(e["kind"])
                if e["fits"]:
                    fits.add((p, e["entity"]))
    state = {k: max(v) if max(v) >= 0 else min(v) for k, v in kinds.items()}
    wide = {p: es for p, es in seen.items() if len(es) >= personal.SUPPORT}
    believed = defaultdict(dict)
    for p, es in wide.items():
        for e in es:
            if state[p, e] >= 0:
                believed[e][state[p, e]] = 1.0
    seeds, lifted, last = {e: dict(v) for e, v in believed.items()}, {}, None
    for _ in range(personal.ROUNDS):
        patterns = {}
        for p, es in wide.items():
            for k in range(4):
                sure = sum(believed.get(e, {}).get(k, 0) for e in es)
                if sure >= personal.SUPPORT and sure / len(es) >= personal.CONFIDENCE:
                    patterns[p, k] = sure / len(es)
        doubt = defaultdict(float)
        for (p, k), c in patterns.items():
            for e in wide[p]:
                if state[p, e] == -1 and (p, e) in fits:
                    doubt[e, k] += math.log(max(1 - c, 1e-9))
        lifted = {ek: 1 - math.exp(x) for ek, x in doubt.items() if 1 - math.exp(x) >= personal.CONFIDENCE}
        now = (len(patterns), len(lifted))
        if now == last or not lifted:
            break
        last, believed = now, defaultdict(dict, {e: dict(v) for e, v in seeds.items()})
        for (e, k), c in lifted.items():
            believed[e][k] = c
    out = []
    for own_base, own in found:
        all_ = {(b["kind"], b["start"], b["end"]) for b in own_base}
        for e in own:
            if e["kind"] == -1 and e["fits"]:
                ks = [k for k in range(4) if (e["entity"], k) in lifted and any((p, k) in patterns for p in e["patterns"])]
                all_ |= {(min(ks), e["start"], e["end"])} if ks else set()
        out.append(",".join(f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in sorted(all_)))
    return out


def phone(rng):
    return f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"


def corpus():
    rng = random.Random(4)
    texts = [f"Hello from {rng.random()}, please call me at {phone(rng)} after lunch {i}" for i in range(20)]
    texts += [f"thing {i} please call me at 555-0{100 + i} after lunch" for i in range(3)]  # unseen form, known context
    texts += [f"item {i}: reach us under 555-0100 today, {i}" for i in range(3)] + [f"item x{i}: reach us under 555 09{i}1 today" for i in range(6)]
    texts += [f"mail to user{i}@mail.example.com or so" for i in range(8)] + ["mail to admin@localhost or so", "mail to admin@localhost or so"]
    texts += [f"card no. 4111 1111 1111 11{i:02d} please" for i in range(40)]  # few pass the check
    texts += [f"version 2.{i} of the year 20{10 + i} is out" for i in range(12)] + ["", None, " \n ", "x" * 30_000, "same +1 (222) 555-1234"] * 2
    return texts


def test_bootstrap_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i // 2, t, "mine", 7) for i, t in enumerate(texts)], SCHEMA)
    got = [r.asDict() for r in personal.find(df).collect()]
    expected = brute(texts)
    assert sorted((r["doc_id"], r["spans"]) for r in got) == sorted((i // 2, s) for i, s in enumerate(expected))
    for r in got:
        own = [s for s in r["spans"].split(",") if s]
        assert r["n_email"] <= sum(s.startswith("email") for s in own)
    hashes = sorted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got)
    count = lambda s, k: sum(x.startswith(k) for x in s)
    assert hashes == sorted((i // 2, *(count(plain(t or ""), k) for k in personal.KINDS), hashlib.sha256(",".join(plain(t or "")).encode()).hexdigest()) for i, t in enumerate(texts))
    text = lambda i, s: [texts[i][int(x.split(":")[1]) : int(x.split(":")[2])] for x in s.split(",") if x]
    for i in range(20, 23):
        assert text(i, expected[i]) == [f"555-0{80 + i}"], "an unseen form in a learnt context"
    assert all(expected[i] == "" for i, t in enumerate(texts) if t and t.startswith("version"))
    assert any(t == "mail to admin@localhost or so" and text(i, expected[i]) == ["admin@localhost"] for i, t in enumerate(texts))


def test_known_non_members_and_copies_are_no_evidence(spark):
    texts = ["ring +1 (222) 555-1234 now"] * 50 + ["ring 777-1234 now"] + [f"pay 4111 1111 1111 11{i:02d} now" for i in range(100)]
    got = {r["spans"] for r in personal.find(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert "phone:5:13" not in got and sum(s.startswith("card") for s in got) == 1
    assert personal.find(spark.createDataFrame([], SCHEMA)).count() == 0

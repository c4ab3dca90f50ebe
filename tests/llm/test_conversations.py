"""Conversation repair against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from repolens.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def damaged(rows):
    """{conv_id: rows in order after damage}; rows are (conv_id, turn, role, text)."""
    out = {}
    for uid, (c, t, role, text) in enumerate(rows):
        own = out.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(t, "user" if kind == 4 else role, text, uid)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode(), r[3])) for c, own in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text, _ in rows:
        end = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, output) by a search over whole edit scripts in the order of cost and edits."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        steps = [("I", 2, i, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text, _ = rows[i]
            steps.append(("D", 3, i + 1, None, None))
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                steps.append(("K", more, i + 1, role, f"{role}:{text}"))
                steps += [("R", 2 + more, i + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for edit, price, at, role, line in steps:
            if role is None:
                heapq.heappush(heap, (cost + price, audit + edit, at, state, out))
            elif (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                heapq.heappush(heap, (cost + price, audit + edit, at, role[:1], (*out, line)))


def brute(rows):
    out = []
    for c, own in damaged(rows).items():
        found = faults(own)
        turns = {r[0] for r in own if r[0] is not None}
        cost, audit, lines = cheapest(own, found)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, longest, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "unknown", "é"])
            text = rng.choice(["Yes.", "No", "ok!", "", " \t", None, f"A text {rng.random()}.", "one\ntwo.\n", "dots...  ", "x" * 3000 + "?"])
            rows.append((None if c == 3 else c, rng.choice([t, t, t, t // 2, None, t + 5]), role, text))
    rows += [(900, 1, "user", "same."), (900, 1, "user", "same."), (900, 1, "user", "same."), (901, None, None, None)]
    return rows


@pytest.mark.parametrize(("n", "longest", "bits"), [(150, 7, 9), (60, 12, 1), (4, 60, 2)])
def test_repair_against_brute_force(spark, monkeypatch, n, longest, bits):
    """Chunks of any size give the same result."""
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits)
    rows = made(n, longest, seed=longest)
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in conversations.repair(df).collect()), key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    table = df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by name
    con.execute("CREATE TABLE conversations AS SELECT * FROM \"table\"")
    assert sorted(con.execute(conversations.SQL).fetchall(), key=str) == got


def test_a_conversation_that_loses_all_rows_and_an_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", "")], SCHEMA)
    assert [tuple(r) for r in conversations.repair(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair(df.where("turn > 5")).count() == 0


def test_prefixes_are_computed_once(monkeypatch):
    """Layers are made once per node of the trie."""
    calls = []
    inner = conversations.advance
    monkeypatch.setattr(conversations, "advance", lambda layer, symbol: calls.append(symbol) or inner(layer, symbol))
    signatures = sorted({"^" + "".join(s) for n in range(7) for s in itertools.product("dg", repeat=n)})
    answers = dict(conversations.walk(iter(signatures)))
    assert len(calls) == len(signatures) - 1 == 2**7 - 2
    fresh = {s: next(conversations.walk(iter([s])))[1] for s in signatures}
    assert answers == fresh


def test_a_conversation_whose_roles_never_settle_its_parity():
    """Edit strings of a conversation whose roles never settle its parity are kept once per state."""
    chain = conversations._Chain()
    for k in range(20):
        layers = next(conversations.walk(iter([("^" if k == 0 else "+") + "j" * 100])))[1]
        chain.add(k, 100, [{"start": i, "state": j, "cost": s[0], "edits": s[1]} for i, x in enumerate(layers) for j, s in enumerate(x) if s])
    parts = list(chain.answer())
    assert [sum(e != "I" for e in edits) for _, edits, _ in parts] == [100] * 20 and parts[0][2] == 2 * 2000

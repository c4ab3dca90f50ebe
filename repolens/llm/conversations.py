"""Conversation structure repair: the cheapest edits to ``(s?(ua)+)?``, by one dynamic programme shared along a prefix trie.

A row of a conversation is a symbol: the class of its role's initial (s, u, a, other) and its fault (none, truncated, to be deleted). Conversations are
strings of symbols, and few of these strings differ, so the programme runs once per distinct string, and once per shared prefix of them:

1. The damaged rows are range-sorted by conversation and turn. Their running number cuts them into chunks of ``CHUNK`` rows at most.
2. The distinct chunk signatures are range-sorted, so that each task walks a prefix trie depth first. The layers on the way from the root to the
   present node are on a stack; a signature reuses those it shares with the one before and adds one for each symbol after that. At a signature's end the
   answers are emitted: cost and edits from every state before the chunk to every state after it.
3. A conversation's chunks are chained by those answers; it has one chunk, but for conversations over a chunk's edge or longer than one. What all
   surviving edit strings begin with is set aside, so that a step costs as much as its chunk.
4. The edits go back to the rows, and a conversation's text runs through SHA-256 chunk by chunk. That hash is one sequence by contract: a conversation's
   chunks pass one task one after the other, with one batch of them in memory. A text is never in a group.

Edits: keep (K) 0, another role (R) 2, delete (D) 3, insert (I) 2; a truncated row that stays adds 1. Among the cheapest, the ASCII-least string of edits.
No minimal string of edits at a state and a row is the beginning of another one of equal cost (more insertions cost more), so the least of each state is enough.

A null role or text is one space, in the key of the damage also a null id or turn. Rows with a null conversation id are one conversation. Rows of one turn
are ordered by role, then text; equal rows follow each other, so a repeated row that was there before damage is a duplicate as well. A conversation that
loses all rows, and an empty table, come out as the contract says. Columns besides the four aren't read.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import SPACE_CHARS, stash

CHUNK_BITS = 9  #: 512 rows in a chunk at most

#: States of the target pattern: nothing yet, after the system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  #: costs

#: A symbol is one letter: class of the initial times three plus the fault.
CLASSES, FAULTS = "sua.", "ktd"
State = tuple[int, str] | None
Layer = list[State]


def _more(state: State, cost: int, edit: str) -> State:
    return (state[0] + cost, state[1] + edit) if state else None


def _least(*states: State) -> State:
    return min((s for s in states if s), default=None)


def _inserted(layer: Layer) -> Layer:
    """The layer with insertions after its row: a user row wherever one may follow, then an assistant row."""
    empty, system, user, assistant = layer
    user = _least(user, _more(_least(empty, system, assistant), INSERT, "I"))
    return [empty, system, user, _least(assistant, _more(user, INSERT, "I"))]


def advance(layer: Layer, symbol: str) -> Layer:
    """The next layer: what each state costs after one more row, and its edits."""
    kind, fault = divmod(ord(symbol) - ord("a"), 3)
    empty, system, user, assistant = out = [_more(s, DELETE, "D") for s in layer]
    if FAULTS[fault] != "d":
        extra = TRUNCATED if FAULTS[fault] == "t" else 0
        before = _least(layer[EMPTY], layer[SYSTEM], layer[ASSISTANT])
        keep = {SYSTEM: layer[EMPTY], USER: before, ASSISTANT: layer[USER]}
        user, assistant = _least(user, _more(before, REROLE + extra, "R")), _least(assistant, _more(layer[USER], REROLE + extra, "R"))
        out = [empty, system, user, assistant]
        if kind < 3:
            out[kind + 1] = _least(out[kind + 1], _more(keep[kind + 1], KEEP + extra, "K"))
    return _inserted(out)


def _roots(mark: str) -> list[Layer]:
    """The layers before the first symbol: from the beginning (``^``), or from each state (``+``) for a chunk further on."""
    starts = [EMPTY] if mark == "^" else range(4)
    return [_inserted([(0, "") if s == start else None for s in range(4)]) for start in starts]


def walk(signatures: Iterator[str]) -> Iterator[tuple[str, list[Layer]]]:
    """The final layers of each signature, by start state. Sorted signatures share the layers of their common prefixes."""
    last, stack = "", []
    for signature in signatures:
        shared = len(os.path.commonprefix([last, signature]))
        del stack[shared:]
        for symbol in signature[shared:]:
            stack.append([advance(x, symbol) for x in stack[-1]] if stack else _roots(symbol))
        last = signature
        yield signature, stack[-1]


_ANSWERS = "signature string, answers array<struct<start: int, state: int, cost: bigint, edits: string>>"
_MOVE = pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("signature", pa.string()), ("answers", pa.list_(_MOVE))])
    held: list[tuple[str, list[dict]]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        names, answers = zip(*held, strict=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(answers, schema.types[1])], schema=schema)

    for signature, layers in walk(s for b in batches for s in b.column(0).to_pylist()):
        held.append((signature, [{"start": i, "state": j, "cost": s[0], "edits": s[1]} for i, layer in enumerate(layers) for j, s in enumerate(layer) if s]))
        size += sum(len(a["edits"]) for a in held[-1][1])
        if size > 4_000_000 or len(held) == 10_000:
            yield batch()
            size = 0
    if held:
        yield batch()


class _Chain:
    """One conversation: the states after its chunks so far. What their edits have in common is in ``done``."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.layer: Layer = [(0, ""), None, None, None]
        self.chunks: list[tuple[int, int]] = []

    def add(self, chunk: int, rows: int, answers: list[dict]) -> None:
        layer: Layer = [None] * 4
        for a in answers:
            layer[a["state"]] = _least(layer[a["state"]], _more(self.layer[a["start"]], a["cost"], a["edits"]))
        common = os.path.commonprefix([s[1] for s in layer if s])
        self.done.append(common)
        self.layer = [s and (s[0], s[1][len(common) :]) for s in layer]
        self.chunks.append((chunk, rows))

    def answer(self) -> Iterator[tuple[int, str, int]]:
        """(chunk, its edits, the conversation's cost): insertions before a row go with it, those at the end with the last chunk."""
        best = _least(self.layer[EMPTY], self.layer[ASSISTANT])
        edits, at = "".join(self.done) + best[1], 0
        for chunk, rows in self.chunks[:-1]:
            begin = at
            while rows:
                rows -= edits[at] != "I"
                at += 1
            yield chunk, edits[begin:at], best[0]
        yield self.chunks[-1][0], edits[at:], best[0]


_EDITS = "conv_id {}, chunk long, edits string, cost long"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and chunk to the edits of each chunk."""
    now: _Chain | None = None
    key: Any = None
    kind = None

    def rows() -> pa.RecordBatch:
        chunks, edits, costs = zip(*now.answer(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([key] * len(chunks), kind), pa.array(chunks, pa.int64()), pa.array(edits), pa.array(costs, pa.int64())], names=["conv_id", "chunk", "edits", "cost"])

    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != key:
                if now is not None:
                    out.append(rows())
                now, key = _Chain(), row["conv_id"]
            now.add(row["chunk"], len(row["signature"]) - 1, row["answers"])
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if now is not None:
        yield rows()


_DONE = "conv_id {}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


class _Repair:
    """One conversation on its way through the hash."""

    def __init__(self) -> None:
        self.hash, self.written, self.shift, self.last = hashlib.sha256(), 0, 0, ""
        self.sums, self.edits = [0, 0, 0, 0], []

    def add(self, row: dict) -> None:
        kinds = self.last + "".join(CLASSES[(ord(c) - ord("a")) // 3] for c in row["signature"][1:])
        self.last = kinds[-1]
        for i, n in enumerate(("blank", "duplicate", "truncated")):
            self.sums[i] += row[n]
        self.sums[3] += sum(kinds[i : i + 2] not in _LEGAL for i in range(len(kinds) - 1))
        self.edits.append(row["edits"])
        own = iter(row["rows"])
        for edit in row["edits"]:
            kept = None if edit == "I" else next(own)
            if edit == "D":
                continue
            if not self.written and edit == "K" and kept["role"][:1] == "s":
                self.shift = 1  # user rows are at odd places then
            role = kept["role"] if edit == "K" else ("user", "assistant")[(self.written - self.shift) % 2]
            self.hash.update(f"{chr(10) if self.written else ''}{role}:{kept['text'] if kept else ''}".encode("utf-8", "surrogatepass"))
            self.written += 1


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Repair | None = None
    key, cost, kind = None, 0, None

    def table(out: list[tuple]) -> pa.RecordBatch:
        names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        types = [kind, *[pa.int64()] * 5, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def row() -> tuple:
        return (key, *now.sums, cost, "".join(now.edits), now.hash.hexdigest())

    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if now is None or r["conv_id"] != key:
                if now is not None:
                    out.append(row())
                now, key, cost = _Repair(), r["conv_id"], r["cost"]
            now.add(r)
        if out:
            yield table(out)
    if now is not None:
        yield table([row()])


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after damage; a row with no copies is gone."""
    c, t = F.col(f"`{conv_id}`"), F.col(f"`{turn}`")
    kind = F.crc32(F.concat_ws(":", F.coalesce(c.cast("string"), F.lit(" ")), F.coalesce(t.cast("string"), F.lit(" "))).cast("binary")) % 20
    said = F.coalesce(F.col(f"`{text}`"), F.lit(" "))
    return conversations.select(
        c.alias("conv_id"), t.alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col(f"`{role}`"), F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _join(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join by conversation, null equal to null, and ``keys``; the keys of ``left`` stay."""
    other = right.select(F.col("conv_id").alias("_conv_id"), *(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in ("conv_id", *keys)))
    on = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return left.join(other, on, how).drop("_conv_id", *(f"_{k}" for k in keys))


def _ordered(damaged: DataFrame) -> DataFrame:
    """The rows that are left, with ``pos`` in their order over the whole table, written once: range bounds are sampled."""
    rows = damaged.withColumn("uid", F.monotonically_increasing_id()).withColumn("copy", F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1, copies) END")))
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("uid"), F.col("copy")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return stash(placed.select("conv_id", "pos", "role", "text", digest.alias("digest")), "turns")


def _chunks(rows: DataFrame) -> DataFrame:
    """(conv_id, chunk, signature, rows, blank, duplicate, truncated), written once."""
    said = rows.groupBy("conv_id", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    joined = _join(rows, said, "digest", how="left").select("conv_id", "pos", "role", "text", (F.col("pos") > F.col("first")).alias("again"))
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE_CHARS)), F.lit(1))
    fault = F.when(end == "", "blank").when(F.coalesce("again", F.lit(False)), "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    kind = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.instr(F.lit(CLASSES), F.left("role", F.lit(1))) - 1).otherwise(3)
    faulty = F.when(fault.isin("blank", "duplicate"), 2).when(fault == "truncated", 1).otherwise(0)
    marked = joined.withColumns({"fault": fault, "symbol": F.char(kind * 3 + faulty + ord("a")), "chunk": F.shiftright("pos", CHUNK_BITS)})
    counts = [F.count_if(F.col("fault") == n).alias(n) for n in ("blank", "duplicate", "truncated")]
    grouped = marked.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "symbol", "role", "text"))).alias("r"), *counts)
    rows_of = F.transform("r", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    out = grouped.select("conv_id", "chunk", F.array_join(F.transform("r", lambda x: x["symbol"]), "").alias("symbols"), rows_of.alias("rows"), "blank", "duplicate", "truncated")
    return stash(out, "chunks")


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conversation of the table."""
    damaged = damage(conversations, conv_id, turn, role, text)
    key = damaged.schema["conv_id"].dataType.simpleString()
    chunks = _chunks(_ordered(damaged))
    first = chunks.groupBy("conv_id").agg(F.min("chunk").alias("first"))
    mark = F.when(F.col("chunk") == F.col("first"), "^").otherwise("+")
    signed = _join(chunks, first).select("conv_id", "chunk", F.concat(mark, "symbols").alias("signature"))
    signed = stash(signed, "signatures")

    distinct = signed.select("signature").distinct()
    answers = stash(distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(_solve, _ANSWERS), "answers")
    solved = signed.join(answers, "signature").select("conv_id", "chunk", "signature", "answers")
    edits = solved.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_chain, _EDITS.format(key))
    edits = stash(edits, "edits")

    full = _join(chunks, edits, "chunk").select("conv_id", "chunk", F.concat(F.lit("^"), "symbols").alias("signature"), "rows", "blank", "duplicate", "truncated", "edits", "cost")
    repaired = full.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_repair, _DONE.format(key))

    left = F.when(F.col("copies") > 0, F.col("turn"))
    turns = damaged.groupBy("conv_id", "turn").agg(F.max(left).alias("t"))
    gaps = F.coalesce(F.max("t") - F.min("t") + 1 - F.count("t"), F.lit(0)).cast("long").alias("gaps")
    every = turns.groupBy("conv_id").agg(gaps)
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return _join(every, repaired, how="left").select("conv_id", "gaps", *zero, *nothing)


def _sql() -> str:
    """The programme as a recursive query: a state is its cost in nine digits and its edits."""
    more = lambda x, cost, edit: f"lpad((left({x}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{edit}'"
    kept = lambda x, kind: f"CASE WHEN f <> 'd' AND k = '{kind}' THEN {more(x, 'extra', 'K')} END"
    roled = lambda x: f"CASE WHEN f <> 'd' THEN {more(x, f'{REROLE} + extra', 'R')} END"
    inserted = f"""e, s, least(u, {more("least(e, s, a)", INSERT, "I")}) AS u2, least(a, {more("u2", INSERT, "I")}) AS a2"""
    return rf"""
WITH RECURSIVE tables AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS remainders),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS uid, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g,
    list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM conversations),
hashed AS (
  SELECT * EXCLUDE (bytes), xor(list_reduce(bytes, lambda c, x: xor(c >> 8, remainders[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS h FROM keyed, tables),
damaged AS (
  SELECT g, turn, uid, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
ordered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, uid, copy) AS i FROM damaged),
faults AS (
  SELECT g, turn, i, role, text, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '.' END AS k,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair FROM ordered),
whole AS (
  SELECT g, count(*) AS n, string_agg(k || CASE fault WHEN 'blank' THEN 'd' WHEN 'duplicate' THEN 'd' WHEN 'truncated' THEN 't' ELSE 'k' END, '' ORDER BY i) AS symbols,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM faults GROUP BY g),
layers AS (
  SELECT g, n, symbols, 0::BIGINT AS i, e, s, u2 AS u, a2 AS a
  FROM (SELECT *, {inserted} FROM (SELECT g, n, symbols, repeat('0', 9) AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM whole))
  UNION ALL
  SELECT g, n, symbols, i, e, s, u2, a2 FROM (SELECT g, n, symbols, i, {inserted} FROM (
    SELECT g, n, symbols, i + 1 AS i, {more("e", DELETE, "D")} AS e, least({more("s", DELETE, "D")}, {kept("e", "s")}) AS s,
      least({more("u", DELETE, "D")}, {kept("before", "u")}, {roled("before")}) AS u, least({more("a", DELETE, "D")}, {kept("u", "a")}, {roled("u")}) AS a
    FROM (SELECT *, least(e, s, a) AS before, substr(symbols, 2 * i::INT + 1, 1) AS k, substr(symbols, 2 * i::INT + 2, 1) AS f, (substr(symbols, 2 * i::INT + 2, 1) = 't')::BIGINT AS extra
      FROM layers WHERE i < n)))),
best AS (SELECT g, left(least(e, a), 9)::BIGINT AS cost, substr(least(e, a), 10) AS audit FROM layers WHERE i = n),
edits AS (SELECT g, unnest(range(1, length(audit) + 1)) AS j, unnest(string_split(audit, '')) AS edit FROM best WHERE audit <> ''),
placed AS (
  SELECT g, j, edit, count(*) FILTER (edit <> 'I') OVER p AS i, count(*) FILTER (edit <> 'D') OVER p - count(*) FILTER (edit <> 'D') OVER (PARTITION BY g) % 2 AS place
  FROM edits WINDOW p AS (PARTITION BY g ORDER BY j)),
repaired AS (
  SELECT g, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS hash
  FROM placed LEFT JOIN faults USING (g, i) WHERE edit <> 'D' GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM keyed) LEFT JOIN whole USING (g) LEFT JOIN best USING (g) LEFT JOIN repaired USING (g)"""


SQL = _sql()

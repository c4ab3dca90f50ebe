"""Personal data: base patterns by kind, and identifiers that only their context gives away.

The base finds four kinds by form: e-mail addresses, IPv4 addresses, card numbers, phone numbers. The bootstrap goes on from there:

1. Every base span is a seed entity of its kind. Every other token with digits or an ``@`` is a candidate: unlabelled, or, where it has the form of a kind
   but fails that kind's check, a known non-member.
2. Each occurrence of either gives lexical patterns, its context: one, two or three words or signs before it, one or two after it, or one on each side;
   lower case, digits as one sign. Patterns and entities are the two sides of a graph, with an edge for each pair that occurs.
3. Rounds over the graph, as joins and aggregates. A pattern's confidence in a kind is the mean of its distinct entities' confidence, all candidates
   counted; it is accepted from ``CONFIDENCE`` and ``SUPPORT`` distinct entities on. A candidate's confidence is 1 - product(1 - confidence) over its
   accepted patterns. What that lifts takes part in the next round, so patterns spread from entity to entity; ``ROUNDS`` rounds, or fewer once nothing changes.
4. Occurrences of a candidate whose confidence is ``CONFIDENCE`` or more in a kind, in one of that kind's accepted patterns, are spans of the kind.

A pattern with fewer distinct entities than ``SUPPORT`` can't be accepted, so its edges go first; that loses nothing. An entity occurs in a pattern once however
often it is copied, so copies of a document are no evidence. Ties between kinds go to the first as listed.

Whole texts are scanned in linear time, one batch of rows at a time; what is kept of a text are its spans and candidates, in a table with a number for each
row, so rows with equal ids stay apart. Null and blank texts have no spans. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import cut, stash

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE, SUPPORT, ROUNDS = 0.75, 4, 4
CONTEXT = 96  #: characters on either side that are looked at for context words
LONGEST, LEAST_DIGITS = 64, 4  #: of a candidate that may become a span, unless it has an @

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[A-Za-z0-9@._:/+#-]+")
_MORE = re.compile(r"(?:[\x20().-]{1,2}[0-9]+)+(?![A-Za-z0-9@])")
_EDGE = "._:/+#-@"
_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


class Found(NamedTuple):
    kind: int
    start: int
    end: int
    valid: bool


def _emails(text: str) -> Iterator[Found]:
    """Leftmost matches. Only one @ is in a match, so each @ with a domain takes the local part before it, as far as the last match's end."""
    last, reverse = 0, None
    for m in _DOMAIN.finditer(text):
        at = m.start()
        if at == last or not _LOCAL.match(text[at - 1]):
            continue
        if reverse is None:
            reverse = text[::-1]
        start = max(last, at - (_LOCAL.match(reverse, len(text) - at).end() - (len(text) - at)))
        yield Found(0, start, m.end(), True)
        last = m.end()


def _addresses(text: str) -> Iterator[Found]:
    """Of digits parted by single points, each four parts from the left are a match."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            yield Found(1, at, at + size, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four))
            at += size + 1


def _numbers(text: str) -> Iterator[Found]:
    for kind, pattern, least, most in ((2, _CARD, 16, 19), (3, _PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = "".join(_DIGITS.findall(m.group()))
            if least <= len(digits) <= most:
                yield Found(kind, m.start(), m.end(), kind == 3 or luhn(digits))


def base(text: str) -> list[Found]:
    """All matches by kind, then start; those of the right length that fail their check are not ``valid``."""
    if _MARK.search(text) is None:
        return []
    return [*_emails(text), *_addresses(text), *_numbers(text)]


def candidates(text: str, taken: list[Found]) -> Iterator[tuple[int, int]]:
    """Spans of tokens with a digit or an @ that meet no ``taken`` span. A token of digits alone takes in the groups of digits after it."""
    cover = sorted((f.start, f.end) for f in taken)
    at, k = 0, 0
    while (m := _MARK.search(text, at)) is not None:
        while k < len(cover) and cover[k][1] <= m.start():
            k += 1
        if k < len(cover) and cover[k][0] <= m.start():
            at = cover[k][1]
            continue
        start = m.start()
        while start > at and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in _EDGE):
            start -= 1
        token = _TOKEN.match(text, start)
        end = token.end()
        if not any(c.isalpha() or c == "@" for c in token.group()) and (more := _MORE.match(text, end)):
            end = more.end()
        if k < len(cover):
            end = min(end, cover[k][0])
        at = max(end, m.end())
        while start < end and text[start] in "._:/#-@":
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        if start < end:
            yield start, end


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of an occurrence: words and signs around it, at most three on the left and two on the right."""
    fold = lambda x: _DIGITS.sub("0", x.lower())
    left = [fold(x) for x in _WORD.findall(text[max(0, start - CONTEXT) : start])[-3:]]
    right = [fold(x) for x in _WORD.findall(text[end : end + CONTEXT])[:2]]
    out = [" ".join(left[-n:]) + " <>" for n in range(1, len(left) + 1)] + ["<> " + " ".join(right[:n]) for n in range(1, len(right) + 1)]
    return [*out, f"{left[-1]} <> {right[0]}"] if left and right else out


def _key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_ENTITY = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.int64()), ("fits", pa.bool_()), ("patterns", pa.list_(pa.int64()))])
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_SCANNED = "uid long, doc_id long, spans array<struct<kind: int, start: long, end: long>>, entities array<struct<kind: int, start: long, end: long, entity: long, fits: boolean, patterns: array<long>>>"


def scan(text: str) -> tuple[list[dict], list[dict]]:
    """(base spans, entities): kind is 0 to 3 for a seed, -1 for a candidate, -2 for a known non-member."""
    found = base(text)
    if not found and _MARK.search(text) is None:
        return [], []
    spans = [{"kind": f.kind, "start": f.start, "end": f.end} for f in found if f.valid]
    places = [(f.kind if f.valid else -2, f.start, f.end) for f in found] + [(-1, a, b) for a, b in candidates(text, found)]
    entities = []
    for kind, a, b in places:
        own = text[a:b]
        fits = kind == -1 and len(own) <= LONGEST and ("@" in own or sum(map(len, _DIGITS.findall(own))) >= LEAST_DIGITS)
        entities.append({"kind": kind, "start": a, "end": b, "entity": _key(own), "fits": fits, "patterns": [_key(p) for p in contexts(text, a, b)]})
    return spans, entities


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("spans", pa.list_(_SPAN)), ("entities", pa.list_(_ENTITY))])
    for batch in batches:
        found = [scan(t.as_py() or "") for t in batch.column("text")]
        columns = [batch.column("uid"), batch.column("doc_id"), pa.array([s for s, _ in found], schema.types[2]), pa.array([e for _, e in found], schema.types[3])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, doc_id, spans, entities) of each row, written once: the texts aren't read again."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return stash(rows.mapInArrow(_scanner, _SCANNED), "personal")


def graph(found: DataFrame) -> DataFrame:
    """(pattern, entity, kind, fits): the distinct edges of patterns with ``SUPPORT`` distinct entities or more, written once.

    An entity that is a seed of a kind anywhere is one in all its patterns; one that is a known non-member stays one.
    """
    e = found.select(F.explode("entities").alias("e")).select("e.entity", "e.kind", "e.fits", F.explode("e.patterns").alias("pattern"))
    edges = e.groupBy("pattern", "entity").agg(F.max("kind").alias("kind"), F.min("kind").alias("least"), F.bool_or("fits").alias("fits"))
    edges = stash(edges.select("pattern", "entity", F.when(F.col("kind") >= 0, F.col("kind")).when(F.col("least") == -2, -2).otherwise(-1).alias("kind"), "fits"), "edges")
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT).select("pattern", "n")
    return stash(edges.join(wide, "pattern"), "graph")


def bootstrap(found: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) of the accepted patterns, and (entity, kind, confidence) of the entities that these lift to ``confidence``."""
    edges = graph(found)
    believed = edges.where("kind >= 0").select("entity", "kind").distinct().withColumn("confidence", F.lit(1.0))
    seeds = believed
    links, unknown = edges.select("pattern", "entity", "n"), edges.where("kind = -1 AND fits").select("pattern", "entity")
    last = None
    for _ in range(rounds):
        scored = links.join(believed, "entity").groupBy("pattern", "kind").agg(F.sum("confidence").alias("sure"), F.max("n").alias("n"))
        scored = scored.select("pattern", "kind", (F.col("sure") / F.col("n")).alias("confidence"), "sure")
        patterns = cut(scored.where((F.col("confidence") >= confidence) & (F.col("sure") >= support)).select("pattern", "kind", "confidence"))
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        lifted = unknown.join(patterns, "pattern").groupBy("entity", "kind").agg((1 - F.exp(doubt)).alias("confidence"))
        lifted = cut(lifted.where(F.col("confidence") >= confidence))
        now = (patterns.count(), lifted.count())
        if now == last or not now[1]:
            break
        last, believed = now, seeds.unionByName(lifted)
    return patterns, lifted


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row for each row of ``docs``; counts and hash are of the base."""
    found = scanned(docs, doc_id, text)
    patterns, lifted = bootstrap(found)
    places = found.select("uid", F.explode("entities").alias("e")).where("e.kind = -1 AND e.fits").select("uid", "e.entity", "e.start", "e.end", "e.patterns")
    sure = places.join(lifted.select("entity", "kind"), "entity").withColumn("pattern", F.explode("patterns"))
    hits = sure.join(patterns.select("pattern", "kind"), ["pattern", "kind"]).groupBy("uid", "start", "end").agg(F.min("kind").alias("kind"))
    added = hits.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))  # of one text
    both = found.select("uid", "doc_id", "spans").join(added, "uid", "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    none = F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>")
    return both.select("doc_id", *counts, F.sha2(line(F.col("spans")), 256).alias("base_sha256"), line(F.concat("spans", F.coalesce("added", none))).alias("spans"))

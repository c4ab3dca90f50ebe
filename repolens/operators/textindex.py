"""Indexes of texts: trigrams of files for searches, and the lines of identifiers.

A text's trigrams are three successive bytes of its UTF-8 form, ASCII letters in lower case, none across lines; those of its lower-case form are added, so
that a search that ignores case finds its own. Files are numbered in blocks of about ``BLOCK_FILES``, and a trigram's posting list is the sorted
numbers of a block's files, so no list is longer than a block, however common its trigram. A search becomes a condition on trigrams that every file
with a match meets; only the files that meet it are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_FILES, SLICE = 2000, 16 * 2**20
_POSTINGS = "block string, gram int, numbers array<int>, number int, path string, digest string"


def text_of(content: bytes | None) -> str | None:
    """As ``files.is_text`` and ``files.decoded``: none for binaries; UTF-8 without a byte order mark, or Latin-1."""
    if content is None or b"\0" in content[:8192]:
        return None
    try:
        return content.removeprefix(b"\xef\xbb\xbf").decode()
    except UnicodeDecodeError:
        return content.decode("latin-1")


def grams_of(text: str) -> np.ndarray:
    """The distinct trigrams of a text, sorted."""
    found = np.zeros(0, np.int32)
    for form in {text, text.lower()}:
        raw = np.frombuffer(form.encode("utf-8", "surrogatepass").lower(), np.uint8)
        for a in range(0, len(raw), SLICE):
            b = raw[a : a + SLICE + 2].astype(np.int32)
            codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            within = (b[:-2] != 10) & (b[1:-1] != 10) & (b[2:] != 10)
            found = np.union1d(found, codes[within])
    return found.astype(np.int32)


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.string()), ("gram", pa.int32()), ("numbers", pa.list_(pa.int32())), ("number", pa.int32()), ("path", pa.string()), ("digest", pa.string())])
    last, names, digests, grams, numbers = None, [], [], [], []

    def block() -> pa.RecordBatch:
        name, n = uuid.uuid4().hex, len(names)
        all_grams, all_numbers = np.concatenate([*grams, np.zeros(0, np.int32)]), np.concatenate([*numbers, np.zeros(0, np.int32)])
        order = np.argsort(all_grams, kind="stable")  # files are in order already
        distinct, starts = np.unique(all_grams[order], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)].astype(np.int32)), pa.array(all_numbers[order].astype(np.int32)))
        nulls = lambda k, kind: pa.nulls(k, kind)
        g = len(distinct)
        columns = [
            pa.array([name] * (g + n)), pa.concat_arrays([pa.array(distinct.astype(np.int32)), nulls(n, pa.int32())]), pa.concat_arrays([lists, nulls(n, lists.type)]),
            pa.concat_arrays([nulls(g, pa.int32()), pa.array(np.arange(n, dtype=np.int32))]), pa.concat_arrays([nulls(g, pa.string()), pa.array(names, pa.string())]),
            pa.concat_arrays([nulls(g, pa.string()), pa.array(digests, pa.string())]),
        ]
        names.clear(), digests.clear(), grams.clear(), numbers.clear()
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    for batch in batches:
        for key, path, content in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), batch.column("content"), strict=True):
            if key != last and names:
                yield block()
            last = key
            raw = content.as_py()
            text = text_of(raw)
            digests.append(None if raw is None else hashlib.sha256(raw).hexdigest())
            found = grams_of(text) if text is not None else np.zeros(0, np.int32)
            grams.append(found), numbers.append(np.full(len(found), len(names), np.int32)), names.append(path)
    if names:
        yield block()


def gram_index(contents: DataFrame, n_files: int) -> DataFrame:
    """(block, gram, numbers) and (block, number, path, SHA-256 of the content) rows in one table. ``contents`` has (path, content); a file is read once, and neither its
    text nor its trigrams are shuffled if ``contents`` comes as ``by_block`` deals it."""
    keyed = contents.select(block_key(F.col("path"), n_files).alias("key"), "path", "content")
    return keyed.mapInArrow(_indexer, _POSTINGS)


def block_key(path: Column, n_files: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(n_files // BLOCK_FILES + 1))


def by_block(files: DataFrame, n_files: int) -> DataFrame:
    """Files dealt to tasks by block, and sorted by it."""
    key = block_key(F.col("path"), n_files)
    return files.repartition(n_files // BLOCK_FILES + 1, key).sortWithinPartitions(key, "path")


_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_]*")
LONGEST = 128


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["identifier", "path", "lines"]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            text = text_of(content.as_py())
            if not text:
                continue
            found: dict[str, list[int]] = {}
            for i, line in enumerate(text.split("\n"), 1):
                for word in set(_WORD.findall(line)):
                    found.setdefault(word, []).append(i)
            kept = {w: lines for w, lines in found.items() if len(w) <= LONGEST and not w[0].isdigit()}
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array([path] * len(kept)), pa.array(list(kept.values()), pa.list_(pa.int32()))], names=names)


def identifiers(contents: DataFrame) -> DataFrame:
    """(identifier, path, lines): each run of ASCII word characters of each text, with its lines."""
    return contents.select("path", "content").mapInArrow(_identifiers, "identifier string, path string, lines array<int>")


def key_word(symbol: str) -> str | None:
    """The longest run of ``symbol`` that ``identifiers`` has wherever the symbol stands as a word; None if it has none."""
    runs = [r for r in _WORD.findall(symbol) if len(r) <= LONGEST and not r[0].isdigit()]
    return max(runs, key=len, default=None)


# Conditions: ("all", parts), ("any", parts) or a trigram; ("all", []) holds for every file.
Condition = tuple | int
ANY: Condition = ("all", [])


def _literal(raw: bytes) -> Condition:
    raw = raw.lower()
    return ("all", sorted({(raw[i] << 16) | (raw[i + 1] << 8) | raw[i + 2] for i in range(len(raw) - 2) if 10 not in raw[i : i + 3]}))


def literal_condition(text: str, case_sensitive: bool = True) -> Condition:
    """What a file with ``text`` in a line has. Without case only ASCII counts: other letters may have several forms."""
    if case_sensitive:
        return _literal(text.encode("utf-8", "surrogatepass"))
    return ("all", [c for run in re.findall(r"[\x00-\x7f]+", text) for c in _literal(run.encode())[1]])


#: Where the two dialects of regular expressions differ in what a match must hold, nothing is concluded.
_FOREIGN = re.compile(r"\\[0QEpPhHvVRXGkxcNzZ]|\(\?(?!:|=|!|<=|<!)|\[[^\]]*\[|&&|\\\\.*\[|[*+?}]\+")


def _walk(parsed, case_sensitive: bool) -> Condition:
    parts: list[Condition] = []
    run: list[str] = []

    def close() -> None:
        if run:
            parts.append(literal_condition("".join(run), case_sensitive))
            run.clear()

    for kind, value in parsed:
        if kind is C.LITERAL:
            run.append(chr(value))
            continue
        if kind is C.AT:
            continue
        close()
        if kind is C.SUBPATTERN:
            parts.append(_walk(value[3], case_sensitive))
        elif kind is C.BRANCH:
            parts.append(("any", [_walk(p, case_sensitive) for p in value[1]]))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] >= 1:
            parts.append(_walk(value[2], case_sensitive))
    close()
    return _simple(("all", parts))


def _simple(condition: Condition) -> Condition:
    if isinstance(condition, int):
        return condition
    kind, parts = condition[0], [_simple(p) for p in condition[1]]
    if kind == "any":
        return ANY if ANY in parts or not parts else ("any", parts)
    flat: list[Condition] = []
    for p in parts:
        flat += p[1] if not isinstance(p, int) and p[0] == "all" else [p]
    return ("all", flat)


def regex_condition(pattern: str, case_sensitive: bool = True) -> Condition:
    """What a file with a match of the expression in a line has; ``ANY`` where that can't be told."""
    if _FOREIGN.search(pattern):
        return ANY
    try:
        return _walk(_parser.parse(pattern), case_sensitive)
    except (re.error, OverflowError, RecursionError):
        return ANY


def trigrams(condition: Condition) -> set[int]:
    return {condition} if isinstance(condition, int) else {g for p in condition[1] for g in trigrams(p)}


def _holds(have: Column, condition: Condition) -> Column:
    if isinstance(condition, int):
        return F.array_contains(have, condition)
    out = F.lit(condition[0] == "all")
    for p in condition[1]:
        out = out & _holds(have, p) if condition[0] == "all" else out | _holds(have, p)
    return out


def candidates(grams: DataFrame, gram_files: DataFrame, condition: Condition) -> DataFrame:
    """(path) of the files that meet a condition. Only the posting lists of its trigrams are read."""
    asked = sorted(trigrams(condition))
    if not asked:
        return gram_files.select("path")
    lists = grams.where(F.col("gram").isin(asked)).select("block", "gram", F.explode("numbers").alias("number"))
    have = lists.groupBy("block", "number").agg(F.collect_set("gram").alias("have")).where(_holds(F.col("have"), condition))
    return gram_files.join(have.select("block", "number"), ["block", "number"]).select("path")

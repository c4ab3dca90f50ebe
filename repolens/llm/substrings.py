"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``WINDOW`` consecutive words of one document. A window is a duplicate if its word sequence also starts in a document with a
smaller id. Documents are factored greedily against the reference blocks that could hold a source; a factor of at least one window becomes a
duplicate span, and parsing goes on ``WINDOW - 1`` words before the factor's end, so that the windows across its boundary are looked up too.

Which block can hold a source for a window? The block that its anchor names: the smallest hash of the ``ANCHOR``-word sequences in the window.
Equal windows have equal anchors, so every block that could match is asked and no other. Documents fall into batches of bounded size by hash.

1. Each batch sends its anchors, once each, to counting shards and learns which of them lie in two documents or more. The number of shards is
   the session's shuffle width, not a share of the corpus, so the packets grow with the batches alone.
2. Around those a batch cuts pieces: runs of windows with one anchor, with their words. A piece is a row that goes to its anchor's block. An anchor
   that more than ``HOT_DOCS`` documents hold would fill one block; its windows are pieces of their own instead and go to the blocks that the
   hashes of their words name, so what differs around a common passage spreads out. Pieces with the same words (compared word by word) go
   out once per batch, for the smallest document; the others are duplicates already. A piece that a document repeats is one row with its starts.
3. A block's reference is the pieces that it received, in document order, indexed by hash chains of their windows. It factors every piece
   against the smaller documents and returns the spans to the batches.

Words travel as 48-bit hashes; within a batch they are compared themselves. A window hash alone never makes a match: chains are split by their
words, and a factor runs as far as the words agree. A false match needs windows that agree but for words of equal hash.

Nulls: a null text has no words. A null id is neither smaller nor larger than another, so such rows lose nothing and are no source. Rows with the
same id aren't duplicates of each other. Texts of any length are parsed whole. Rows that repeat each get their result. Only the named columns are
read; others pass through in ``deduped``.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import batch_count, shuffle_width, trim

WINDOW, ANCHOR = 13, 6
BATCH_CHARS = 4_000_000
BLOCK_CHARS = 8_000_000  #: of text per reference block
SHARD_CHARS = 200_000_000  #: of text per counting shard at most; only more text than the shuffle width times this adds shards
HOT_DOCS = 1000
CHAIN = 4  #: sources of a window that are tried for a longer factor; one settles whether there is any
_B = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1


class Vocabulary(dict):
    """word -> index in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _joined(a: np.ndarray, n_b: int, b: np.ndarray, lag: int) -> np.ndarray:
    """Hashes of sequences: ``a`` followed after ``lag`` words by ``b``, which is ``n_b`` words long."""
    n = min(len(a), max(0, len(b) - lag))
    return a[:n] * np.uint64(pow(_B, n_b, 2**64)) + b[lag : lag + n]


def sequence_hashes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 6-word and all 13-word sequences of ``w``."""
    two = _joined(w, 1, w, 1)
    three = _joined(two, 1, w, 2)
    six = _joined(three, 3, three, 3)
    twelve = _joined(six, 6, six, 6)
    return _mixed(six), _mixed(_joined(twelve, 1, w, 12))


def _least(k: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values."""
    have, out = 1, k
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = n - have
    return (np.minimum(out[: len(out) - rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., lengths[0] of them, then the same for the next."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [a.tobytes() for a in arrays]
    kinds = "".join(a.dtype.char for a in arrays).encode()
    head = struct.pack(f"<B{len(parts)}s{len(parts)}Q", len(parts), kinds, *map(len, parts))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = raw[0]
    kinds, sizes = raw[1 : 1 + n].decode(), struct.unpack_from(f"<{n}Q", raw, 1 + n)
    out, at = [], 1 + 9 * n
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def packed_keys(keys: np.ndarray) -> np.ndarray:
    """Sorted 64-bit keys as gaps, equal bytes side by side: the high ones are mostly 0."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.ravel()


def unpacked_keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


_FLOW = "to int, batch int, payload binary"
_FLOW_ARROW = pa.schema([("to", pa.int32()), ("batch", pa.int32()), ("payload", pa.binary())])


def _flow(to: list[int], batch: list[int], payloads: list[bytes]) -> pa.Table:
    return pa.table([pa.array(to, pa.int32()), pa.array(batch, pa.int32()), pa.array(payloads, pa.binary())], schema=_FLOW_ARROW)


def _slices(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Where each value of a sorted array begins and ends."""
    if not len(sorted_):
        return []
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]).tolist()
    return list(zip(first, [*first[1:], len(sorted_)], strict=True))


class _Batch:
    """The runs of a batch of documents: windows that follow each other and have one anchor."""

    def __init__(self, table: pa.Table, n_shards: int):
        vocabulary = Vocabulary()
        ids, keys, texts = [], [], []
        for i, k, t in zip(table.column("doc_id").to_pylist(), table.column("text_key").to_pylist(), table.column("text"), strict=True):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
            if i is not None and len(words) >= WINDOW:
                ids.append(i), keys.append(k), texts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        self.ids, self.keys = np.array(ids, np.int64), np.array(keys, np.int64)
        self.local = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
        lengths = np.array([len(t) for t in texts], np.int64)
        del texts, vocabulary
        six, whole = sequence_hashes(self.hashes[self.local])
        anchor = _least(six, WINDOW - ANCHOR + 1)[: len(whole)]
        del six
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.place = (np.arange(len(self.local)) - (np.cumsum(lengths) - lengths)[doc]).astype(np.int32)
        n = len(whole)
        valid = (self.place + WINDOW <= lengths[doc])[:n] if n else np.zeros(0, bool)
        change = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[: n - 1]) | ~valid[:-1]] if n else valid
        self.first = np.flatnonzero(valid & change)
        stop = np.flatnonzero(valid & np.r_[change[1:] | ~valid[1:], True]) + 1 if n else self.first
        self.n_windows, self.doc, self.anchor = stop - self.first, doc[self.first], anchor[self.first]
        sums = np.r_[np.uint64(0), np.cumsum(whole, dtype=np.uint64)]
        # what tells runs apart: their windows' hashes and number
        self.mark = _mixed(whole[self.first] * np.uint64(3) + whole[stop - 1] * np.uint64(5) + sums[stop] - sums[self.first]) + self.n_windows.astype(np.uint64)
        self.whole = whole
        # distinct anchors in (shard, anchor) order, and how many documents of the batch have them
        shard = ((self.anchor >> np.uint64(17)) % np.uint64(n_shards)).astype(np.int64)
        order = np.lexsort((self.ids[self.doc], self.anchor, shard))
        head = np.r_[True, self.anchor[order][1:] != self.anchor[order][:-1]][: len(order)]
        group = np.cumsum(head) - 1
        self.of = np.empty(len(order), np.int64)
        self.of[order] = group
        self.distinct, self.shards = self.anchor[order][head], shard[order][head]
        owner = self.ids[self.doc][order]
        other = np.r_[True, owner[1:] != owner[:-1]][: len(order)] | head
        self.docs = np.minimum(np.bincount(group, weights=other, minlength=len(self.distinct)), 65535).astype(np.uint16)


def _asker(n_shards: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        b = _Batch(table, n_shards)
        rows = [(int(b.shards[x]), _pack(packed_keys(b.distinct[x:y]), b.docs[x:y])) for x, y in _slices(b.shards)]
        del b
        trim()
        return _flow([s for s, _ in rows], [key[0].as_py()] * len(rows), [p for _, p in rows])

    return run


def _counter(hot_docs: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """One counting shard: for each anchor of each batch 0, 1 if it lies in two documents, 2 if in more than ``hot_docs``."""
        unpacked = [_unpack(p) for p in table.column("payload").to_pylist()]
        keys = [unpacked_keys(k) for k, _ in unpacked]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        docs = np.bincount(at, weights=np.concatenate([n for _, n in unpacked]), minlength=len(distinct))
        kind = ((docs > 1).astype(np.uint8) + (docs > hot_docs))[at].astype(np.uint8)
        bounds = np.cumsum([0, *map(len, keys)]).tolist()
        return _flow(table.column("to").to_pylist(), table.column("batch").to_pylist(), [_pack(kind[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)])

    return run


_PIECES = "block int, batch int, doc_id long, text_key long, starts binary, length int, words binary"
_SPANS = "batch int, doc_id long, text_key long, starts binary, offset int, length int"
_WIDTH = 6  #: bytes of a word's hash in a piece


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value for each of ``counts`` rows, from so many of the ``values`` each."""
    values = np.ascontiguousarray(values)
    offsets = np.r_[0, np.cumsum(counts * (values.nbytes // max(len(values), 1)))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _rows(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``width`` bytes in a binary column, as rows of bytes, and how many each row has."""
    raw, counts = [np.zeros((0, width), np.uint8)], [np.zeros(0, np.int64)]
    for chunk in column.chunks:
        if len(chunk):
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
            data = chunk.buffers()[2]
            raw.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width) if data else raw[0]), counts.append(np.diff(offsets) // width)
    return np.concatenate(raw), np.concatenate(counts)


def _piece_words(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH]


def _read_words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all pieces, and each piece's number of words."""
    raw, counts = _rows(column, _WIDTH)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :_WIDTH] = raw
    return wide.view("<u8").ravel(), counts


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the ``lengths`` words from ``a`` on are those from ``b`` on."""
    if not len(a):
        return np.zeros(0, bool)
    equal = words[_spread(a, lengths)] == words[_spread(b, lengths)]
    return np.logical_and.reduceat(equal, np.cumsum(lengths) - lengths)


def _merged(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same words of each document as spans that don't touch: document, start, length."""
    if not len(doc):
        return doc, start, length
    scale = int((start + length).max()) + 1
    order = np.lexsort((start, doc))
    doc, begin = doc[order].astype(np.int64), start[order].astype(np.int64)
    reach = np.maximum.accumulate(doc * scale + begin + length[order])
    head = np.flatnonzero(np.r_[True, doc[1:] * scale + begin[1:] > reach[:-1]])
    last = np.r_[head[1:], len(doc)] - 1
    return doc[head], begin[head], reach[last] - doc[head] * scale - begin[head]


def _cutter(n_shards: int, n_blocks: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Pieces for blocks, and spans that the batch itself decides (``block`` is -1)."""
        b, me = _Batch(docs, n_shards), key[0].as_py()
        kind = np.zeros(len(b.distinct), np.uint8)
        bits = {s: _unpack(p)[0] for s, p in zip(answers.column("to").to_pylist(), answers.column("payload").to_pylist(), strict=True)}
        for x, y in _slices(b.shards):
            kind[x:y] = bits[int(b.shards[x])]
        kind = kind[b.of]
        runs, hot = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        first = np.r_[b.first[runs], _spread(b.first[hot], b.n_windows[hot])]
        doc = np.r_[b.doc[runs], np.repeat(b.doc[hot], b.n_windows[hot])]
        n = np.r_[b.n_windows[runs], np.ones(len(first) - len(runs), np.int64)]
        single = b.whole[first[len(runs) :]]
        route, mark = np.r_[b.anchor[runs], single], np.r_[b.mark[runs], _mixed(single)]
        order = np.lexsort((first, doc, b.ids[doc], mark, n))
        first, doc, n, route, mark = first[order], doc[order], n[order], route[order], mark[order]
        owner, length, m = b.ids[doc], n + WINDOW - 1, len(order)
        head = np.r_[True, (mark[1:] != mark[:-1]) | (n[1:] != n[:-1])][:m]
        source = np.flatnonzero(head)[np.cumsum(head) - 1] if m else head.astype(np.int64)
        same = _same(b.local, first, first[source], length)
        # a piece that a document repeats is one row with several starts
        row = np.flatnonzero(head | np.r_[True, doc[1:] != doc[:-1]][:m] | ~same | np.r_[True, ~same[:-1]][:m])
        copies = np.diff(np.r_[row, m])
        known = same[row] & (owner[row] > owner[source[row]])
        spans = _merged(doc[np.repeat(known, copies)], b.place[first][np.repeat(known, copies)], length[np.repeat(known, copies)])
        row, place = row[~known], b.place[first[np.repeat(~known, copies)]]
        block = ((route[row] >> np.uint64(17)) % np.uint64(n_blocks)).astype(np.int32)
        n_spans, of = len(spans[0]), np.r_[spans[0], doc[row]]
        sent = np.r_[np.zeros(n_spans, np.int64), length[row]]
        out = pa.table({
            "block": pa.array(np.r_[np.full(n_spans, -1, np.int32), block]), "batch": pa.array(np.full(len(of), me, np.int32)), "doc_id": pa.array(b.ids[of]), "text_key": pa.array(b.keys[of]),
            "starts": _binary(np.r_[spans[1], place].astype("<i4"), np.r_[np.ones(n_spans, np.int64), copies[~known]]), "length": pa.array(np.r_[spans[2], length[row]].astype(np.int32)),
            "words": _binary(_piece_words(b.hashes[b.local[_spread(first[row], length[row])]]), sent),
        })
        del b
        trim()
        return out

    return run


def _common(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many windows from ``a`` on are those from ``b`` on. ``kind`` tells windows apart; -1, also at its end, is none."""
    count, open_, at, width, last = np.zeros(len(a), np.int64), np.arange(len(a)), 0, 8, len(kind) - 1
    while len(open_):
        step = np.arange(at, at + width)
        x = kind[np.minimum(a[open_, None] + step, last)]
        same = (x == kind[np.minimum(b[open_, None] + step, last)]) & (x >= 0)
        whole = same.all(1)
        count[open_] += np.where(whole, width, same.argmin(1))
        open_, at, width = open_[whole], at + width, min(2 * width, 4096)
    return count


def factors(words: np.ndarray, piece: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy relative Lempel-Ziv factors of the pieces of one reference block.

    ``words``: the block's text as word hashes, piece after piece in the order of their documents; ``piece``: each word's piece; ``ids``: each
    piece's document, ascending. Gives where a factor begins, its number of windows, and where its source, in a smaller document, begins.

    Each piece is parsed from left to right, all pieces in step: at a window with a source, the first sources in its hash chain are followed
    for as long as the words agree, and the longest is the factor. Parsing goes on at the first window that isn't whole in the factor.
    """
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, none
    _, whole = sequence_hashes(words)
    chain = np.flatnonzero(piece[: len(whole)] == piece[WINDOW - 1 :])  # windows within a piece
    if not len(chain):
        return none, none, none
    chain = chain[np.argsort(whole[chain], kind="stable")]
    head = np.r_[True, whole[chain][1:] != whole[chain][:-1]]
    group = np.cumsum(head) - 1
    first = chain[head][group]
    equal = np.ones(len(chain), bool)
    for k in range(WINDOW):
        equal &= words[chain + k] == words[first + k]
    if not equal.all():  # different windows with one hash: chains of their own
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(group, group[~equal])):
            group[i] = known.setdefault(words[chain[i] : chain[i] + WINDOW].tobytes(), len(chain) + len(known))
        order = np.lexsort((chain, group))
        chain, group = chain[order], group[order]
        head = np.r_[True, group[1:] != group[:-1]]
        group = np.cumsum(head) - 1
        first = chain[head][group]
    kind = np.full(len(words) + 1, -1, np.int32)
    kind[chain] = group
    begin = np.r_[np.flatnonzero(head), len(chain)]
    owner = ids[piece]
    hits = np.sort(chain[owner[first] < owner[chain]])
    if not len(hits):
        return none, none, none
    at = hits[np.r_[True, piece[hits][1:] != piece[hits][:-1]]]
    starts, counts, sources = [], [], []
    while len(at):
        g = kind[at]
        source, longest = chain[begin[g]], np.zeros(len(at), np.int64)
        for k in range(CHAIN):
            place = begin[g] + k
            rows = np.flatnonzero(place < begin[g + 1])
            rows = rows[owner[chain[place[rows]]] < owner[at[rows]]]
            if not len(rows):
                break
            other = chain[place[rows]]
            n = _common(kind, at[rows], other)
            better = n > longest[rows]
            longest[rows[better]], source[rows[better]] = n[better], other[better]
        starts.append(at), counts.append(longest), sources.append(source)
        here, next_ = piece[at], np.searchsorted(hits, at + longest)
        going = next_ < len(hits)
        going[going] = piece[hits[next_[going]]] == here[going]
        at = hits[next_[going]]
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(sources)


def _parser(key: tuple, table: pa.Table) -> pa.Table:
    """One reference block: its pieces are factored against each other; spans go back to the batches."""
    if key[0].as_py() < 0:
        return table.select(["batch", "doc_id", "text_key", "starts"]).append_column("offset", pa.array(np.zeros(table.num_rows, np.int32))).append_column("length", table.column("length"))
    table = table.take(pc.sort_indices(table.column("doc_id")))
    word, lengths = _read_words(table.column("words"))
    ids = table.column("doc_id").to_numpy()
    piece = np.repeat(np.arange(len(lengths)), lengths)
    start, count, _ = factors(word, piece, ids)
    of = piece[start]
    found = table.select(["batch", "doc_id", "text_key", "starts"]).take(pa.array(of))
    found = found.append_column("offset", pa.array((start - (np.cumsum(lengths) - lengths)[of]).astype(np.int32)))
    found = found.append_column("length", pa.array((count + WINDOW - 1).astype(np.int32)))
    del table, word, piece
    trim()
    return found


def _with_spans(docs: DataFrame, finish, out: str, doc_id: str, text: str, row: list[str], hot_docs: int = HOT_DOCS) -> DataFrame:
    """``finish(table, removed)`` of every batch; ``removed`` has a mask of words, or None, for each of the table's rows."""
    spark = docs.sparkSession
    full = F.col(f"`{text}`")
    chars = docs.agg(F.sum(F.length(full))).first()[0] or 0
    n_batches, width = batch_count(spark, chars, BATCH_CHARS), shuffle_width(spark)
    n_shards, n_blocks = max(width, int(chars // SHARD_CHARS) + 1), max(width, int(chars // BLOCK_CHARS) + 1)
    read = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(full, F.length(full)).alias("text_key"), full.alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"), F.pmod(F.xxhash64(doc_id, full), F.lit(n_batches)).cast("int").alias("batch"),
    )
    batches = read.groupBy("batch")
    asked = batches.applyInArrow(_asker(n_shards), _FLOW)
    answers = asked.groupBy("to").applyInArrow(_counter(hot_docs), _FLOW)
    pieces = batches.cogroup(answers.groupBy("batch")).applyInArrow(_cutter(n_shards, n_blocks), _PIECES)
    # what a batch has decided needs no block: it stays with its batch
    spans = pieces.groupBy("block", F.when(F.col("block") < 0, F.col("batch"))).applyInArrow(_parser, _SPANS)

    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        rows: dict[tuple[int | None, int], list[int]] = {}
        for j, ik in enumerate(zip(table.column("doc_id").to_pylist(), table.column("text_key").to_pylist(), strict=True)):
            rows.setdefault(ik, []).append(j)
        edges: list[np.ndarray | None] = [None] * table.num_rows
        texts = table.column("text")
        raw, copies = _rows(found.column("starts"), 4)
        ids, keys, offsets, lengths = (np.repeat(found.column(c).to_numpy().astype(np.int64), copies) for c in ("doc_id", "text_key", "offset", "length"))
        order = np.lexsort((keys, ids))
        ids, keys, starts, lengths = ids[order], keys[order], (np.ascontiguousarray(raw).view("<i4").ravel() + offsets)[order], lengths[order]
        head = np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])][: len(ids)]
        for x, y in _slices(np.cumsum(head)):
            for j in rows[int(ids[x]), int(keys[x])]:
                if edges[j] is None:
                    edges[j] = np.zeros(len(texts[j].as_py().encode("utf-8", "surrogatepass").split()) + 1, np.int32)
                np.add.at(edges[j], starts[x:y], 1)
                np.add.at(edges[j], starts[x:y] + lengths[x:y], -1)
        return finish(table, [None if e is None else np.cumsum(e[:-1]) > 0 for e in edges])

    return batches.cogroup(spans.groupBy("batch")).applyInArrow(run, out)


def _digest(table: pa.Table, removed: list) -> pa.Table:
    n_words, n_removed, digests = [], [], []
    for t, mask in zip(table.column("text"), removed, strict=True):
        words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
        left = words if mask is None else [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
        n_words.append(len(words)), n_removed.append(len(words) - len(left)), digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
    ids = pc.struct_field(table.column("row").combine_chunks(), 0)
    return pa.table({"doc_id": ids.cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_docs: int = HOT_DOCS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    return _with_spans(docs, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", doc_id, text, [doc_id], hot_docs)


def _remove(table: pa.Table, removed: list) -> pa.Table:
    texts = []
    for t, mask in zip(table.column("text"), removed, strict=True):
        text = t.as_py()
        if mask is not None:
            lines, at = [], 0
            for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
                words = line.split()
                left = [w for w, m in zip(words, mask[at : at + len(words)].tolist(), strict=True) if not m]
                at += len(words)
                if left or not words:
                    lines.append(b" ".join(left))
            text = b"\n".join(lines).strip().decode("utf-8", "surrogatepass")
        texts.append(text)
    return pa.table({"row": table.column("row").combine_chunks(), "text": pa.array(texts, pa.string())})


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without duplicate spans; the lines of a text stay lines. ``n_chars`` follows the text where there is one."""
    rest = [c for c in docs.columns if c != text]
    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")).schema["row"].dataType.simpleString()
    out = _with_spans(docs, _remove, f"row {kind}, text string", doc_id, text, rest)
    cols = [F.col("text") if c == text else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*[c.alias(n) for c, n in zip(cols, docs.columns, strict=True)])


SQL = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM a WHERE len(w) >= 13)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM m, (SELECT unnest(range(0, 13)) AS k)),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM a),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT a.doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM a LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)"""

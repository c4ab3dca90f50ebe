"""Language-model scoring with Elias-Fano n-gram tries.

A trigram model over all training documents, smoothed step by step:

    p1(w) = (n(w) + 1/2) / (N + (V + 1)/2),  p2(w | v) = (n(v, w) + MU_2 p1(w)) / (n(v) + MU_2),  p3(w | u, v) = (n(u, v, w) + MU_3 p2(w | v)) / (n(u, v) + MU_3)

It sums to one over the words and one unknown, but for quantisation. A document's probability is that of its words and one end, from a start.

1. Documents are parsed once, in batches of bounded size: word numbers and the words' 64-bit hashes. That table is written.
2. Word counts: a batch sends its words to word shards, each word once, and gets the totals back, with numbers that are small for frequent words.
3. Tries: the n-grams are dealt to trie shards by the hash of their context (u, v), so that all successors of a context meet, and no frequent word
   is a key. A batch sends each distinct n-gram of training's words once with its training count, as word numbers. A shard adds up the counts of
   all batches and builds one trie of the n-grams that training has, and of no others.
4. Queries: each batch's n-grams, seen in training or not, are searched in their shard's trie, and the codes found go back to the batch.

A trie has three levels in one memory-mapped file of its task. Monotone pointers, an Elias-Fano sequence, lead from a word to its successors in
level 2, and from a pair to its successors in level 3. Successors are Elias-Fano coded too: context-relative ids become one monotone sequence by
adding the context's base. A pair has the quantised log of n(u, v) / N, which gives its back-off weight as well; a triple that of
n(u, v, w) / (n(u, v) + MU_3). Every query at every size goes through the pointers and bisects its context's successors.

The number of shards is the session's shuffle width, so packets grow with the batches alone; only a corpus beyond ``SHARD_CHARS`` times the width
has more. A context's load is one entry per batch and successor.

Nulls: a null text is empty and scores its end alone; a null id is hashed as an empty text, so it trains. Rows that repeat each count and each
get a score. Extra columns aren't read.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import shuffle_width, stash, trim
from repolens.llm.substrings import Vocabulary, _mixed, _pack, _slices, _unpack, packed_keys, unpacked_keys

MU_2, MU_3 = 1000.0, 5.0
BATCH_CHARS, SHARD_CHARS = 6_000_000, 24_000_000
STEP = 4096.0  #: quantised log10 probabilities are -code / STEP
UNSEEN = 65535
START, END = b" start", b" end"  #: no word has a space


class EliasFano:
    """A monotone sequence below ``universe``: low bits as they are, high bits in unary."""

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        low = max(0, int(universe // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
        bits[ones] = 1
        packed = np.packbits(bits, bitorder="little")
        rank = np.r_[0, np.cumsum(bits.reshape(-1, 64).sum(1, dtype=np.int64))]
        # the low parts, bit by bit; whole bytes in each round
        shifts, lows = np.arange(low, dtype=np.uint64), []
        for a in range(0, n if low else 0, 1 << 16):
            lows.append(np.packbits(((v[a : a + (1 << 16), None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        return {"low": np.concatenate([*lows, np.zeros(8, np.uint8)]), "high": packed, "rank": rank, "width": np.array([low, n], np.int64)}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.high, self.rank = parts["low"], parts["high"].view(np.uint64), parts["rank"]
        self.width, self.n = (int(x) for x in parts["width"])

    _SELECT = np.array([[([k for k in range(8) if byte >> k & 1] + [0] * 8)[j] for j in range(8)] for byte in range(256)], np.uint8)
    _ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        word = np.searchsorted(self.rank, i, side="right") - 1
        left, bits = (i - self.rank[word]).astype(np.uint64), self.high[word]
        # ones up to and with each byte of the word, then the byte that holds the one sought
        s = bits - ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))
        s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
        s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * self._ONES
        byte = np.bitwise_count(((left * self._ONES | self._TOPS) - s) & self._TOPS).astype(np.uint64) * np.uint64(8)
        left -= (s << np.uint64(8) >> byte) & np.uint64(255)
        high = word * 64 + byte.astype(np.int64) + self._SELECT[(bits >> byte) & np.uint64(255), left] - i
        return (high << self.width) | self._lows(i)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        start = at >> 3
        chunk = np.zeros(len(i), np.uint64)
        for k in range((self.width + 14) // 8):
            chunk |= self.low[start + k].astype(np.uint64) << np.uint64(8 * k)
        return ((chunk >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)).astype(np.int64)


def codes(logs: np.ndarray) -> np.ndarray:
    """Quantised log10 probabilities; the largest code stands for what isn't there."""
    return np.clip(np.rint(-logs * STEP), 0, UNSEEN - 1).astype(np.uint16)


class Trie:
    """Words, pairs and triples of an n-gram model in one memory-mapped temporary file."""

    def __init__(self, n_words: int, first: np.ndarray, second: np.ndarray, pair_code: np.ndarray, context: np.ndarray, third: np.ndarray, triple_code: np.ndarray):
        """Pairs (``first``, ``second``) of word numbers in order; triples (``context``, ``third``) in order, where a context is a pair's place."""
        sequences = {
            "p2": (np.searchsorted(first, np.arange(n_words + 1)), len(first) + 1), "s2": (first * n_words + second, max(1, n_words * n_words)),
            "p3": (np.searchsorted(context, np.arange(len(first) + 1)), len(third) + 1), "s3": (context * n_words + third, max(1, len(first) * n_words)),
        }
        parts = {f"{name}.{k}": v for name, (values, universe) in sequences.items() for k, v in EliasFano.encode(values, universe).items()}
        parts |= {"c2": pair_code, "c3": triple_code}
        self._file = tempfile.TemporaryFile()
        layout, at = {}, 0
        for name, a in parts.items():
            self._file.seek(at)
            self._file.write(a.tobytes())
            layout[name] = (at, a.dtype, len(a))
            at += (a.nbytes + 63) // 64 * 64
        self._file.truncate(max(at, 64))
        self._file.flush()
        mapped = np.memmap(self._file, np.uint8, "r", shape=(max(at, 64),))
        got = {name: mapped[o : o + n * d.itemsize].view(d) for name, (o, d, n) in layout.items()}
        self.n_words, self.nbytes = n_words, at
        self.p2, self.s2, self.p3, self.s3 = (EliasFano({k[3:]: v for k, v in got.items() if k.startswith(f"{name}.")}) for name in sequences)
        self.c2, self.c3 = got["c2"], got["c3"]

    def _search(self, pointers: EliasFano, successors: EliasFano, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The places of ``word`` among the successors of ``context``, -1 for those that aren't there."""
        target, out = context * self.n_words + word, np.full(len(context), -1, np.int64)
        low, high = pointers.get(context), pointers.get(context + 1)
        open_ = np.flatnonzero(low < high)
        low, high, target = low[open_], high[open_], target[open_]
        while len(open_):
            middle = (low + high) // 2
            value = successors.get(middle)
            hit, less = value == target, value < target
            out[open_[hit]] = middle[hit]
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            go = ~hit & (low < high)
            open_, low, high, target = open_[go], low[go], high[go], target[go]
        return out

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self._search(self.p2, self.s2, first, second)

    def triples(self, context: np.ndarray, third: np.ndarray) -> np.ndarray:
        return self._search(self.p3, self.s3, context, third)


def _split(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 with equal bytes side by side, as many as the largest needs."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return planes[:width].ravel()


def _join(planes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_split``."""
    wide = np.zeros((n, 8), np.uint8)
    if n:
        wide[:, : len(planes) // n] = planes.reshape(-1, n).T
    return wide.view("<i8").ravel()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the number of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=head[1:])
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(head, dtype=np.int32) - np.int32(1)
    return ordered[head], of


_PARSED = "batch string, ids array<long>, held binary, lengths binary, tokens binary, keys binary, counts binary"
_PARSED_ARROW = pa.schema([("batch", pa.string()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("held", "lengths", "tokens", "keys", "counts"))])


def _parsed(held_rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Documents as word numbers, frequent words first, then by hash; ``counts`` are those of the training documents."""
    table = pa.Table.from_batches(held_rows)
    vocabulary = Vocabulary()
    _ = vocabulary[START], vocabulary[END]
    ids = table.column("doc_id").to_pylist()
    held = np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i in ids], bool)
    docs, end = [], np.array([1], np.int32)
    for t in table.column("text"):
        words = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
        docs += [np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)), end]
    token = np.concatenate(docs)
    lengths = np.array([len(d) + 1 for d in docs[::2]], np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    order = np.lexsort((hashes, -np.bincount(token, minlength=len(hashes))))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    token = number[token]
    counts = np.bincount(token[np.repeat(~held, lengths)], minlength=len(order))
    values = [uuid.uuid4().hex, ids, _pack(held), _pack(lengths), _pack(_split(token)), _pack(packed_keys(hashes[order]), number[:2]), _pack(_split(counts))]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _PARSED_ARROW.types, strict=True)], schema=_PARSED_ARROW)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            held.append(whole.slice(a, 256))
            size += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
            if size > BATCH_CHARS:
                yield _parsed(held)
                held, size = [], 0
                trim()
    if held:
        yield _parsed(held)


_ASK = "shard int, batch string, payload binary"
_ASK_ARROW = pa.schema([("shard", pa.int32()), ("batch", pa.string()), ("payload", pa.binary())])


def _flow(shards: list[int], batch: str, payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([batch] * len(shards), pa.string()), pa.array(payloads, pa.binary())], schema=_ASK_ARROW)


def _by_shard(hashes: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the hashes by shard, and the shards in that order."""
    shard = ((hashes >> np.uint64(20)) % np.uint64(n_shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def _words_by_shard(hashes: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, by hash within a shard."""
    by_hash = np.argsort(hashes)
    order, shard = _by_shard(hashes[by_hash], n_shards)
    return by_hash[order], shard


def _word_asker(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                row = batch.slice(j, 1).to_pylist()[0]
                hashes = unpacked_keys(_unpack(row["keys"])[0])
                counts = _join(_unpack(row["counts"])[0], len(hashes))
                order, shard = _words_by_shard(hashes, n_shards)
                hashes, counts = hashes[order], counts[order]
                cuts = _slices(shard)
                yield _flow([int(shard[x]) for x, _ in cuts], row["batch"], [_pack(packed_keys(hashes[x:y]), counts[x:y].astype(np.uint32)) for x, y in cuts])

    return run


_TOTALS = "shard int, batch string, payload binary, n long, v long"


def _word_counter(key: tuple, table: pa.Table) -> pa.Table:
    """One word shard: totals over all batches and ranks by them in each batch's order; in a row without a batch training's tokens and words."""
    unpacked = [_unpack(p) for p in table.column("payload").to_pylist()]
    distinct, at = _distinct(np.concatenate([unpacked_keys(planes) for planes, _ in unpacked]))
    total = np.bincount(at, weights=np.concatenate([c for _, c in unpacked]), minlength=len(distinct)).astype(np.int64)
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
    bounds = np.cumsum([0, *(len(c) for _, c in unpacked)]).tolist()
    blobs = [_pack(_split(total[at[x:y]]), _split(rank[at[x:y]])) for x, y in zip(bounds, bounds[1:], strict=False)]
    m = len(blobs)
    return pa.table({
        "shard": pa.array([key[0].as_py()] * (m + 1), pa.int32()), "batch": pa.array([*table.column("batch").to_pylist(), None], pa.string()), "payload": pa.array([*blobs, None], pa.binary()),
        "n": pa.array([None] * m + [int(total.sum())], pa.int64()), "v": pa.array([None] * m + [int((total > 0).sum())], pa.int64()),
    })


class _Grams:
    """The pairs and triples of training's words in a parsed batch, in the order in which shards are asked."""

    def __init__(self, row: dict, totals: pa.Table, n_words_shards: int, n_shards: int):
        planes, marks = _unpack(row["keys"])
        hashes, (start, end) = unpacked_keys(planes), marks.tolist()
        order, shard = _words_by_shard(hashes, n_words_shards)
        got = sorted(zip(totals.column("shard").to_pylist(), totals.column("payload").to_pylist(), strict=True))
        known = [(s, _unpack(p)) for s, p in got]
        sizes = np.diff(np.r_[[x for x, _ in _slices(shard)], len(shard)]).tolist()
        count, number = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        count[order] = np.concatenate([_join(p[0], n) for (_, p), n in zip(known, sizes, strict=True)])
        number[order] = np.concatenate([1 + _join(p[1], n) * n_words_shards + s for (s, p), n in zip(known, sizes, strict=True)])
        held = _unpack(row["held"])[0]
        count[start], number[start] = count[end], 0  # every training document begins and ends once
        # words by their numbers, those without training last
        number[count == 0] = np.iinfo(np.int64).max
        order = np.argsort(number, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.count, self.number, self.start = count[order], number[order], int(place[start])
        n, trained, start = len(order), int((count > 0).sum()), self.start
        self.lengths, self.held = _unpack(row["lengths"])[0], held
        self.token = place[_join(_unpack(row["tokens"])[0], int(self.lengths.sum()))]
        first = np.cumsum(self.lengths) - self.lengths
        self.before = before = np.r_[start, self.token[:-1]] if len(self.token) else self.token
        before[first] = start
        train = np.repeat(~held, self.lengths)
        fits = np.flatnonzero((before < trained) & (self.token < trained))
        # the last key is the pair of two starts, from which documents begin
        some = int(trained > 0)
        pair, of = _distinct(np.r_[before[fits] * n + self.token[fits], [start * n + start] * some].astype(np.int64))
        self.pair_count = np.bincount(of, weights=np.r_[train[fits], [int((~held).sum())] * some], minlength=len(pair)).astype(np.int64)
        of = of.astype(np.int64)
        self.of_pair = np.full(len(self.token), -1)
        self.of_pair[fits] = of[: len(fits)]
        self.of_context = np.r_[-1, self.of_pair[:-1]] if len(self.token) else self.of_pair
        self.of_context[first] = of[-1] if some else -1
        fits = np.flatnonzero((self.of_context >= 0) & (self.token < trained))
        triple, of = _distinct(self.of_context[fits] * n + self.token[fits])
        self.triple_count = np.bincount(of[train[fits]], minlength=len(triple))
        self.of_triple = np.full(len(self.token), -1)
        self.of_triple[fits] = of
        self.first, self.second, self.context, self.third = pair // n, pair % n, triple // n, triple % n
        mixed = _mixed(self.number[self.first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mixed(self.number[self.second].astype(np.uint64)))
        self.pair_order, self.pair_shard = _by_shard(mixed, n_shards)
        shard = np.empty(len(pair), np.int32)
        shard[self.pair_order] = self.pair_shard
        self.triple_order = np.argsort(shard[self.context], kind="stable")
        self.triple_shard = shard[self.context][self.triple_order]

    def packets(self) -> Iterator[tuple[int, bytes]]:
        """(shard, payload): the words that it names, its pairs, and its pairs' successors, with training counts."""
        seen, short = np.zeros(len(self.number), bool), np.zeros(len(self.number), np.int64)
        cuts = _slices(self.triple_shard)
        triples = {int(self.triple_shard[x]): (x, y) for x, y in cuts}
        for x, y in _slices(self.pair_shard):
            shard = int(self.pair_shard[x])
            p, (a, b) = self.pair_order[x:y], triples.get(shard, (0, 0))
            t = self.triple_order[a:b]
            first, second, third = self.first[p], self.second[p], self.third[t]
            seen[first] = seen[second] = seen[third] = True
            used = np.flatnonzero(seen)
            seen[used] = False
            short[used] = np.arange(len(used))
            successors = np.bincount(np.searchsorted(p, self.context[t]), minlength=len(p))
            numbers = [np.diff(short[first], prepend=0), short[second], self.pair_count[p], successors, short[third], self.triple_count[t]]
            yield shard, _pack(np.array([len(p), len(t)]), packed_keys(self.number[used].astype(np.uint64)), *map(_split, numbers))


def _gram_asker(n_words_shards: int, n_shards: int):
    def run(key: tuple, parsed: pa.Table, totals: pa.Table) -> pa.Table:
        packets = list(_Grams(parsed.to_pylist()[0], totals, n_words_shards, n_shards).packets())
        trim()
        return pa.Table.from_batches([_flow([s for s, _ in packets], key[0].as_py(), [p for _, p in packets])])

    return run


def _trie_shard(n: int, mu: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Build the shard's trie from the training counts of all batches, then look every batch's pairs and triples up in it."""
        unpacked = [_unpack(p) for p in table.column("payload").to_pylist()]
        keys = [unpacked_keys(u[1]).astype(np.int64) for u in unpacked]
        words, number = _distinct(np.concatenate(keys))
        number = number.astype(np.int64)  # products of these don't fit 32 bits
        base = np.cumsum([0, *map(len, keys)])
        n_words = len(words)
        pair_ends, triple_ends = (np.cumsum([0, *(int(u[0][k]) for u in unpacked)]).tolist() for k in (0, 1))
        part = lambda k, of: [_join(u[k], int(u[0][of])) for u in unpacked]
        first = np.concatenate([number[b + np.cumsum(x)] for b, x in zip(base, part(2, 0), strict=False)])
        second, third = (np.concatenate([number[b + x] for b, x in zip(base, part(k, of), strict=False)]) for k, of in ((3, 0), (6, 1)))
        pair_count, successors, triple_count = (np.concatenate(part(k, of)) for k, of in ((4, 0), (5, 0), (7, 1)))
        del unpacked, keys, number, part
        pair, of = _distinct(first * n_words + second)
        context = np.repeat(of.astype(np.int64), successors)
        triple, of_triple = _distinct(context * n_words + third)
        del first, second, third, context, successors
        pair_total = np.bincount(of, weights=pair_count, minlength=len(pair))
        triple_total = np.bincount(of_triple, weights=triple_count, minlength=len(triple))
        # training's n-grams alone
        trained, known = pair_total > 0, triple_total > 0
        place = np.cumsum(trained) - 1
        context = triple // n_words
        trie = Trie(
            n_words, pair[trained] // n_words, pair[trained] % n_words, codes(np.log10(pair_total[trained] / max(n, 1))),
            place[context[known]], triple[known] % n_words, codes(np.log10(triple_total[known] / (pair_total[context[known]] + mu))),
        )
        del pair_total, triple_total, trained, known, place
        # every distinct query once, by its context
        at = trie.pairs(pair // n_words, pair % n_words)
        pair_code = np.where(at >= 0, trie.c2[np.maximum(at, 0)], UNSEEN).astype(np.uint16) if len(trie.c2) else np.full(len(pair), UNSEEN, np.uint16)
        triple_code = np.full(len(triple), UNSEEN, np.uint16)
        if len(trie.c3):
            asked = np.flatnonzero(at[context] >= 0)
            found = trie.triples(at[context[asked]], triple[asked] % n_words)
            triple_code[asked[found >= 0]] = trie.c3[found[found >= 0]]
        blobs = [_pack(pair_code[of[a:b]].view(np.uint8).reshape(-1, 2).T.ravel(), triple_code[of_triple[c:d]].view(np.uint8).reshape(-1, 2).T.ravel()) for a, b, c, d in zip(pair_ends, pair_ends[1:], triple_ends, triple_ends[1:], strict=False)]
        del trie, pair, triple, of, of_triple
        trim()
        return pa.table([table.column("shard").combine_chunks(), table.column("batch").combine_chunks(), pa.array(blobs, pa.binary())], schema=_ASK_ARROW)

    return run


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(n_words_shards: int, n_shards: int, n: int, v: int, mu_2: float, mu_3: float):
    def run(key: tuple, parsed: pa.Table, answers: pa.Table) -> pa.Table:
        row = parsed.to_pylist()[0]
        level = answers.column("level").to_numpy()
        g = _Grams(row, answers.filter(pa.array(level == 1)), n_words_shards, n_shards)
        grams = answers.filter(pa.array(level == 2))
        replies = [_unpack(p) for _, p in sorted(zip(grams.column("shard").to_pylist(), grams.column("payload").to_pylist(), strict=True))]
        none = np.zeros(0, np.uint16)
        # the last code of each is that of n-grams that can't be there
        pair_code, triple_code = np.full(len(g.pair_order) + 1, UNSEEN, np.uint16), np.full(len(g.triple_order) + 1, UNSEEN, np.uint16)
        for k, (code, order) in enumerate(((pair_code, g.pair_order), (triple_code, g.triple_order))):
            code[order] = np.concatenate([none, *(np.ascontiguousarray(p[k].reshape(2, -1).T).view(np.uint16).ravel() for p in replies)])
        base = (g.count + 0.5) / (n + 0.5 * (v + 1))
        pairs = np.where(pair_code < UNSEEN, n * 10.0 ** (-pair_code.astype(np.float64) / STEP), 0.0)
        two = (pairs[g.of_pair] + mu_2 * base[g.token]) / (g.count[g.before] + mu_2)
        three = np.where(triple_code < UNSEEN, 10.0 ** (-triple_code.astype(np.float64) / STEP), 0.0)[g.of_triple]
        cost = np.rint(-np.log10(three + mu_3 / (pairs[g.of_context] + mu_3) * two) * STEP)
        size = len(g.lengths)
        doc = np.repeat(np.arange(size), g.lengths)
        out = pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(g.held), "n_tokens": pa.array(g.lengths.astype(np.int64)),
            "n_known": pa.array(np.bincount(doc, weights=(g.count > 0)[g.token], minlength=size).astype(np.int64)),
            "base_score": pa.array(np.bincount(doc, weights=np.log10(base)[g.token], minlength=size)),
            "score": pa.array(-np.bincount(doc, weights=cost, minlength=size) / STEP),
        })
        del g
        trim()
        return out

    return run


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mu_2: float = MU_2, mu_3: float = MU_3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    chars = docs.agg(F.sum(F.length(full))).first()[0] or 0
    n_shards = max(shuffle_width(spark), int(chars // SHARD_CHARS) + 1)
    parsed = stash(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), full.alias("text")).mapInArrow(_parse, _PARSED), "parsed")
    words = parsed.select("batch", "keys", "counts").mapInArrow(_word_asker(n_shards), _ASK)
    totals = stash(words.groupBy("shard").applyInArrow(_word_counter, _TOTALS), "words")
    n, v = (int(x) for x in totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())
    replies = totals.where(F.col("batch").isNotNull()).select("shard", "batch", "payload")
    batches = parsed.drop("counts").groupBy("batch")
    asked = batches.cogroup(replies.groupBy("batch")).applyInArrow(_gram_asker(n_shards, n_shards), _ASK)
    found = asked.groupBy("shard").applyInArrow(_trie_shard(n, mu_3), _ASK)
    answers = replies.withColumn("level", F.lit(1)).unionByName(found.withColumn("level", F.lit(2)))
    scored = batches.cogroup(answers.groupBy("batch")).applyInArrow(_scorer(n_shards, n_shards, n, v, mu_2, mu_3), _OUT)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


#: The same in DuckDB, quantisation included; for tables that one machine holds.
SQL = rf"""
WITH t AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS remainders),
d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
    list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
h AS (
  SELECT doc_id, r, w, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, remainders[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 5 = 1 AS held_out FROM d, t),
k AS (
  SELECT r, held_out, unnest(list_concat(w, [' end'])) AS token, unnest(list_concat([' start'], w)) AS before,
    unnest(list_slice(list_concat([' start', ' start'], w), 1, len(w) + 1)) AS earlier FROM h),
c AS (SELECT token, count(*) AS n FROM k WHERE NOT held_out GROUP BY token),
f AS (SELECT before, count(*) AS m FROM k WHERE NOT held_out GROUP BY before),
g AS (SELECT sum(n)::BIGINT AS total, count(*) AS v FROM c),
p AS (
  SELECT a, b, n2, total * pow(10.0, -round(-log10(n2 / total) * {STEP}) / {STEP}) AS near FROM (
    SELECT before AS a, token AS b, count(*) AS n2 FROM k WHERE NOT held_out GROUP BY ALL
    UNION ALL SELECT ' start', ' start', count(*) FROM h WHERE NOT held_out HAVING count(*) > 0) CROSS JOIN g),
q AS (
  SELECT x.earlier, x.before, x.token, pow(10.0, -round(-log10(n3 / (n2 + {MU_3})) * {STEP}) / {STEP}) AS share
  FROM (SELECT earlier, before, token, count(*) AS n3 FROM k WHERE NOT held_out GROUP BY ALL) x JOIN p ON p.a = x.earlier AND p.b = x.before),
s AS (
  SELECT r, n, total, (coalesce(n, 0) + 0.5) / (total + 0.5 * (v + 1)) AS base, coalesce(share, 0) AS share, coalesce(ctx.near, 0) AS context, coalesce(here.near, 0) AS pair, coalesce(m, 0) AS m
  FROM k LEFT JOIN c USING (token) LEFT JOIN f USING (before) LEFT JOIN p here ON here.a = k.before AND here.b = k.token
    LEFT JOIN p ctx ON ctx.a = k.earlier AND ctx.b = k.before LEFT JOIN q USING (earlier, before, token) CROSS JOIN g),
e AS (
  SELECT r, count(*) AS n_tokens, count(n) AS n_known, any_value(total) AS train_tokens, round(sum(log10(base)), 6) AS base_score,
    -sum(round(-log10(share + {MU_3} / (context + {MU_3}) * ((pair + {MU_2} * base) / (m + {MU_2}))) * {STEP})) / {STEP} AS score FROM s GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM h JOIN e USING (r)"""

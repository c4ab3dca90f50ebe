"""Packing along a space-filling curve.

Every document is tokenised once into a table in the shared folder: its ids, their number, and the Hilbert key of its vector. The vector is
signed counts of hashed token ids, normalised and projected to ``DIMS`` dimensions with a fixed matrix, on a grid of ``BITS`` bits each.
The keys and lengths alone (no ids) are range-sorted along the curve and summed up: running sums within a range, range totals before it, so
each document knows its place in one long line of tokens. The line is cut every ``LENGTH`` tokens. All sequences but the last are full, and
each holds neighbours on the curve. Equal keys are ordered by row, so that copies of a document may fall into several ranges.

Nulls: a null text is empty and has its separator alone; a null id is carried. Repeated rows are packed one by one. No text is shortened.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.llm.common import apart, cut, stash

LENGTH, SEPARATOR, FEATURES, DIMS, BITS = 1024, 0, 256, 3, 10
RANGE_ROWS, GROUP = 200_000, 512
LONG = 100_000  #: characters without white space from which the slower library is safer
# Fixed value: the split pattern of byte-level BPE as GPT-2 published it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary's tokens as bytes. Its characters stand for bytes: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}


class Encoder:
    """Token ids of texts by a tokenizers file.

    Plain byte-level BPE files are run by tiktoken's faster loop over the same vocabulary, once the two agree on a probe; other files, and texts
    with extremely long words or with an added token in them, by the tokenizers library.
    """

    _PROBE = "It's  a probe,\n\n of 12 things: <|end|> \u00e9\u00df \u4e2d\u6587 don't\tstop \n"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4"
        spec = json.loads(Path(path).read_text())
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        split = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            return None
        import tiktoken

        ranks = byte_ranks({t: i for t, i in spec["model"]["vocab"].items() if t not in self.added})
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return fast if fast.encode_ordinary(self._PROBE) == self._slow(self._PROBE) else None

    def _slow(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if self.fast is None or any(a in t for a in self.added) or (len(t) > LONG and max(map(len, t.split()), default=len(t)) > LONG):
                out.append(np.array(self._slow(t), self.kind))
            else:
                out.append(self.fast.encode_to_numpy(t, disallowed_special=()).astype(self.kind))
        return out


def _scatter(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(FEATURES)).astype(np.int64), np.where(h >> np.uint64(20) & np.uint64(1), 1.0, -1.0)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The places of grid points (rows of ints below 2**bits) on the Hilbert curve, after Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(token_ids: list[np.ndarray]) -> np.ndarray:
    vectors = np.zeros((len(token_ids), FEATURES))
    for row, ids in zip(vectors, token_ids, strict=True):
        if len(ids):
            at, sign = _scatter(ids)
            row += np.bincount(at, weights=sign, minlength=FEATURES)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors /= np.where(norm > 0, norm, 1)
    matrix = np.random.default_rng(7).standard_normal((FEATURES, DIMS))
    low = vectors @ (matrix / np.linalg.norm(matrix, axis=0))
    grid = np.clip((low + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(grid, BITS)


_TOKENS = "uid long, doc_id long, key long, n long, ids binary"
_TOKENS_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _tokeniser(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze = Encoder(path), zstandard.ZstdCompressor(level=1)
        uid = TaskContext.get().partitionId() << 36
        for whole in batches:
            for a in range(0, whole.num_rows, GROUP):
                batch = whole.slice(a, GROUP)
                ids = encode([t or "" for t in batch.column(1).to_pylist()])
                keys = curve_keys(ids)
                full = [np.append(i, np.array([SEPARATOR], i.dtype)).astype(i.dtype) for i in ids]
                n = len(full)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), batch.column(0), pa.array(keys), pa.array([len(f) for f in full], pa.int64()), pa.array([squeeze.compress(f.tobytes()) for f in full])],
                    schema=_TOKENS_ARROW,
                )
                uid += n

    return run


def _line(tokens: DataFrame) -> DataFrame:
    """(uid, at): where each document starts in the line of all tokens."""
    light = tokens.select("uid", "key", "n")
    parts = int(light.count() // RANGE_ROWS) + 1
    ranged = cut(light.repartitionByRange(parts, "key", "uid").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy("_part").agg(F.sum("n").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    running = Window.partitionBy("_part").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_ahead", F.coalesce(F.sum("n").over(running), F.lit(0)))
    return placed.join(starts, "_part").select("uid", (F.col("_start") + F.col("_ahead")).alias("at"))


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _cutter(kind: str, with_ids: bool):
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(expand.decompress(blob), kind).astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, LENGTH)
                    piece = ids[start : start + LENGTH - offset].tobytes()
                    row = (doc, start, len(piece) // 4, zlib.crc32(piece), len(ids), sequence, offset, piece if with_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start += len(piece) // 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and its ids (little-endian unsigned 32 bits).

    ``tokenizer_path`` is a tokenizers file with GPT-2's split pattern, readable on every executor.
    """
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 65536 else "<u4"
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    tokens = stash(read.mapInArrow(_tokeniser(tokenizer_path), _TOKENS), "tokens")
    placed = tokens.select("uid", "doc_id", "ids").join(apart(_line(tokens)), "uid")
    return placed.select("doc_id", "at", "ids").mapInArrow(_cutter(kind, with_ids), _PIECES)

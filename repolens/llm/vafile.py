"""Exact top-k search with vector-approximation files.

Vectors become integers, floor(scale * x), and are kept in blocks of two files. The approximation has ``BITS`` bits a component, packed: the
cell between the block's smallest and largest value of that component. The exact file has the integers, in as few bytes as they need.

1. Scan. Blocks of queries meet blocks of approximations; exact vectors stay where they are. A cell's lower edge and width bound every inner
   product from both sides. A query keeps the vectors whose upper bound reaches its kth largest lower bound over the task's blocks, as row numbers of
   the block; its lower bounds leave the task once.
2. The kth largest lower bound over all blocks is no more than the kth result. What lies below it with its upper bound is out.
3. Read. Each block's exact vectors are read by row number for the queries that are left, in the order of their bounds, until a query's kth exact
   score is above every bound to come. A block that many queries ask for is dealt to several tasks. A ranking window merges the blocks.

Queries meet vectors as pairs of blocks of bounded size; no pair of rows is ever a row. Both files are written once to the shared folder, so
that row numbers hold if a task runs again.

Vectors that are null, or hold null or non-finite components, and rows with a null id take no part; empty vectors neither. Vectors are compared
with those of the same length. Rows with the query's id are its own and no candidates; repeated candidate rows each count; a query row that
repeats is answered once. Integers have 64 bits at most; what they can't hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.llm.common import shuffle_width, stash

BITS, BLOCK, QUERIES = 6, 8192, 1024
TASK_PAIRS = 256  #: pairs of blocks in a task at most
READS = 200_000  #: (query, block) rows in a task of exact reads, about
HELD_BYTES = 64 * 2**20  #: of rows that a scanning task holds before it writes some

_SHIFTS = np.arange(BITS, dtype=np.uint8)


def _integers(values: np.ndarray, scale: float) -> np.ndarray:
    x = np.floor(values * scale)
    if (np.abs(x) >= 2.0**63).any():
        raise OverflowError("a scaled component is beyond 64 bits")
    return x.astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as they need."""
    least, most = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // (n * dim)}").reshape(n, dim)


def approximate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Each component's least value and cell width in a block, and the packed cells."""
    low, u = x.min(0), x.view(np.uint64)
    span = x.max(0).view(np.uint64) - low.view(np.uint64)  # without overflow
    width = (span >> np.uint64(BITS)) + np.uint64(1)
    cells = ((u - low.view(np.uint64)) // width).astype(np.uint8)
    return low, width.view(np.int64), np.packbits(((cells[:, :, None] >> _SHIFTS) & 1).reshape(len(x), -1), axis=1).tobytes()


def edges(low: np.ndarray, width: np.ndarray, packed: bytes, n: int) -> np.ndarray:
    """The lower edges of a block's cells."""
    dim = len(low)
    bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(n, -1), axis=1, count=dim * BITS).reshape(n, dim, BITS)
    cells = (bits << _SHIFTS).sum(2, dtype=np.uint64)
    return (low.view(np.uint64) + cells * width.view(np.uint64)).view(np.int64)


def scan(q: np.ndarray, q_ids: np.ndarray, low: np.ndarray, width: np.ndarray, edge: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query with any: its number, the rows that may be among its k best, their upper bounds, and the k largest lower bounds.

    ``floor`` holds each query's kth largest lower bound so far (very small if it has fewer) and is raised.
    """
    size = np.abs(q.astype(np.float64)).sum(1)
    largest = float(np.abs(edge.astype(np.float64)).max(initial=0)) + float(width.max(initial=0))
    top = float(size.max(initial=0)) * largest
    fit = np.float32 if top < 2**24 else np.float64  # whole numbers that it holds
    about = (q.astype(fit) @ edge.astype(fit).T).astype(np.float64)
    room = (width - 1).astype(np.float64)
    up, down = np.maximum(q, 0).astype(np.float64) @ room, np.minimum(q, 0).astype(np.float64) @ room
    if top >= 2**52:  # no longer exact
        error = (q.shape[1] + 4) * 2.0**-50 * size * largest
        up, down = up + error, down - error
    about[ids[None, :] == q_ids[:, None]] = -np.inf
    if len(ids) > k:
        kth = np.partition(about, len(ids) - k, axis=1)[:, len(ids) - k] + down
    else:
        kth = np.where(np.isfinite(about).sum(1) >= k, about.min(1) + down, -np.inf)
    np.maximum(floor, kth, out=floor)
    for i in range(len(q)):
        rows = np.flatnonzero(about[i] + up[i] >= floor[i])
        rows = rows[np.isfinite(about[i, rows])]
        if len(rows):
            found = about[i, rows]
            lows = -np.sort(-found)[:k] + down[i]
            yield i, rows.astype(np.int32), found + up[i], lows


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products; those that might not fit by Python's integers, which raise OverflowError if the result is beyond 64 bits."""
    if float(np.abs(q.astype(np.float64)).sum()) * float(np.abs(x.astype(np.float64)).max(initial=0)) >= 2**62:
        return np.array([sum(a * b for a, b in zip(v, q.tolist(), strict=True)) for v in x.tolist()], object).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def read_exact(q: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, upper: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of a block's ``rows`` (ids, scores), and how many exact vectors were read; the kth result is ``least`` or more."""
    order = np.argsort(-upper, kind="stable")
    rows, upper = rows[order], upper[order]
    rows, at, step = rows[upper >= least], 0, 2 * k
    scores = np.zeros(0, np.int64)
    while at < len(rows) and not (len(scores) >= k and upper[at] < np.partition(scores, -k)[-k]):
        scores = np.r_[scores, _scores(x[rows[at : at + step]], q)]
        at += step
    rows = rows[: len(scores)]
    best = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows[best]], scores[best], len(rows)


_VECTORS = "block string, dim int, n int, ids binary, low binary, width binary, cells binary, exact binary"
_QUERIES = "q_dim int, q_n int, q_ids binary, q_keys binary, q_exact binary"


def _usable(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, their integers) of the vectors that take part."""
    vectors = batch.column("v")
    if not isinstance(vectors, pa.ListArray):
        vectors = vectors.cast(pa.list_(pa.float64()))
    values = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    usable = batch.column("id").is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    for dim in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == dim))
        x = values[starts[rows][:, None] + np.arange(dim)]
        fine = np.isfinite(x).all(1)
        yield dim, rows[fine], _integers(x[fine], scale)


def _packer(size: int, scale: float, flush, schema: pa.Schema):
    """Batches of rows as blocks of ``size`` rows of one length; ``flush(dim, columns, integers, number)`` makes a block's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}
        number = 0

        def block(dim: int, columns: list, rows: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            made = flush(dim, np.concatenate(columns), np.concatenate(rows), number)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, schema.types, strict=True)], schema=schema)

        for batch in batches:
            own = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "v"], 1)
            for dim, rows, x in _usable(batch, scale):
                for a in range(0, len(x), size):
                    columns, kept, n = held.pop(dim, ([], [], 0))
                    columns.append(own[rows[a : a + size]]), kept.append(x[a : a + size])
                    n += len(kept[-1])
                    if n >= size:
                        yield block(dim, columns, kept)
                    elif n:
                        held[dim] = (columns, kept, n)
        for dim, (columns, kept, _) in held.items():
            yield block(dim, columns, kept)

    return run


def _vector_blocks(scale: float):
    import uuid

    schema = pa.schema([("block", pa.string()), ("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "low", "width", "cells", "exact"))])

    def flush(dim: int, own: np.ndarray, x: np.ndarray, number: int) -> tuple:
        low, width, cells = approximate(x)
        return uuid.uuid4().hex, dim, len(x), own[:, 0].tobytes(), low.tobytes(), width.tobytes(), cells, _narrow(x).tobytes()

    return _packer(BLOCK, scale, flush, schema)


def _query_blocks(scale: float):
    schema = pa.schema([("q_dim", pa.int32()), ("q_n", pa.int32()), *((c, pa.binary()) for c in ("q_ids", "q_keys", "q_exact"))])

    def flush(dim: int, own: np.ndarray, x: np.ndarray, number: int) -> tuple:
        return dim, len(x), own[:, 0].tobytes(), own[:, 1].tobytes(), _narrow(x).tobytes()

    return _packer(QUERIES, scale, flush, schema)


_KEPT = "query_id long, query_key long, block string, rows binary, uppers binary, top double, lows array<double>"


def _scanner(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("block", pa.string()), ("rows", pa.binary()), ("uppers", pa.binary()), ("top", pa.float64()), ("lows", pa.list_(pa.float64()))])

    def kept(state: _Bounds, lows: bool) -> Iterator[pa.RecordBatch]:
        out = state.left(lows)
        for a in range(0, len(out), 4096):
            at, rows, uppers, block, top, low = zip(*out[a : a + 4096], strict=True)
            columns = [pa.array(state.ids[list(at)]), pa.array(state.keys[list(at)]), pa.array(block), pa.array(rows, pa.binary()), pa.array(uppers, pa.binary()), pa.array(top), pa.array(low, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[bytes, _Bounds] = {}
        last, now = None, None
        for batch in batches:
            for j in range(batch.num_rows):
                row = {c: batch.column(c)[j].as_py() for c in ("block", "dim", "q_dim")}
                if row["dim"] != row["q_dim"]:
                    continue
                if row["block"] != last:  # a block's queries follow each other
                    last, raw = row["block"], {c: batch.column(c)[j].as_py() for c in ("n", "ids", "low", "width", "cells")}
                    low, width, ids = (np.frombuffer(raw[c], np.int64) for c in ("low", "width", "ids"))
                    now = low, width, edges(low, width, raw["cells"], raw["n"]), ids
                q_n, q_keys, q_ids = batch.column("q_n")[j].as_py(), batch.column("q_keys")[j].as_py(), np.frombuffer(batch.column("q_ids")[j].as_py(), np.int64)
                q = _matrix(batch.column("q_exact")[j].as_py(), q_n, row["dim"])
                if q_keys not in states:
                    states[q_keys] = _Bounds(q_ids, np.frombuffer(q_keys, np.int64), k)
                state = states[q_keys]
                for i, r, u, lows in scan(q, q_ids, *now, k, state.floor):
                    state.add(i, row["block"], r, u, lows)
                if state.held > HELD_BYTES:
                    state.prune()
                    if state.held > HELD_BYTES // 2:
                        yield from kept(state, False)
        for state in states.values():
            yield from kept(state, True)

    return run


class _Bounds:
    """What a task knows of a block of queries: of each query its k largest lower bounds over the blocks so far, and the rows that may still qualify."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, k: int) -> None:
        self.ids, self.keys, self.k, self.held = ids, keys, k, 0
        self.floor = np.full(len(ids), -np.inf)
        self.lows = [np.zeros(0)] * len(ids)
        self.rows: list[tuple[int, str, np.ndarray, np.ndarray]] = []

    def add(self, i: int, block: str, rows: np.ndarray, upper: np.ndarray, lows: np.ndarray) -> None:
        self.lows[i] = -np.sort(-np.r_[self.lows[i], lows])[: self.k]
        if len(self.lows[i]) == self.k:
            self.floor[i] = max(self.floor[i], self.lows[i][-1])
        self.rows.append((i, block, rows, upper))
        self.held += rows.nbytes + upper.nbytes + 100

    def prune(self) -> None:
        rows = [(i, block, r[u >= self.floor[i]], u[u >= self.floor[i]]) for i, block, r, u in self.rows]
        self.rows = [x for x in rows if len(x[2])]
        self.held = sum(r.nbytes + u.nbytes + 100 for _, _, r, u in self.rows)

    def left(self, lows: bool) -> list[tuple]:
        """What is to be read by block, and once for each query, if ``lows``, its lower bounds; nothing of that stays."""
        self.prune()
        none: list[float] = []
        out = [(i, r.tobytes(), u.tobytes(), block, float(u.max()), none) for i, block, r, u in self.rows]
        if lows:  # a row of their own: the last of a query's rows may have gone out before
            out += [(i, b"", b"", "", -np.inf, x.tolist()) for i, x in enumerate(self.lows) if len(x)]
        self.rows, self.held = [], 0
        return out


_FOUND = "query_id long, query_key long, vec_id long, score long"


def _reader(k: int, scale: float):
    def run(key: tuple, asked: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and blocks.num_rows:
            block = blocks.select(["dim", "n", "ids", "exact"]).slice(0, 1).to_pylist()[0]
            x, ids = _matrix(block["exact"], block["n"], block["dim"]), np.frombuffer(block["ids"], np.int64)
            for row in asked.select(["query_id", "query_key", "rows", "uppers", "least", "v"]).to_pylist():
                q = _integers(np.array(row["v"], np.float64), scale)
                found, scores, _ = read_exact(q, x, ids, np.frombuffer(row["rows"], np.int32), np.frombuffer(row["uppers"], np.float64), k, row["least"])
                out.append((np.full(len(found), row["query_id"]), np.full(len(found), row["query_key"]), found, scores))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "query_key", "vec_id", "score"), columns, strict=True)})

    return run


def _dealt(n_blocks: int, n_queries: int, width: int) -> tuple[int, int]:
    """Into how many parts blocks and query blocks are dealt: every pair of parts is a task, and the data read by all tasks is about least."""
    tasks = max(4 * width, n_blocks * n_queries // TASK_PAIRS)
    queries = max(1, min(n_queries, round((tasks / 8) ** 0.5)))
    return max(1, min(n_blocks, -(-tasks // queries))), queries


def top_k(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a Column) holds for, the k largest inner products, ties to smaller ids."""
    spark = vectors.sparkSession
    own = [F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")]
    asked = vectors.where(is_query).select(*own).dropDuplicates().withColumn("key", F.xxhash64("id", "v"))
    n_queries, n_rows = asked.count(), vectors.count()
    blocks = stash(vectors.select(*own).repartition(int(n_rows // BLOCK) + 1).mapInArrow(_vector_blocks(scale), _VECTORS), "vectors")
    queries = stash(asked.select("id", "key", "v").repartition(int(n_queries // QUERIES) + 1).mapInArrow(_query_blocks(scale), _QUERIES), "queries")
    for_blocks, for_queries = _dealt(int(n_rows // BLOCK) + 1, int(n_queries // QUERIES) + 1, shuffle_width(spark))
    cells = blocks.select("block", "dim", "n", "ids", "low", "width", "cells").repartition(for_blocks)
    # the stated query set against all rows, block by block; lengths are compared in the task: as a join key they would send every block to one
    kept = stash(cells.crossJoin(queries.repartition(for_queries)).mapInArrow(_scanner(k), _KEPT), "kept")

    query = ["query_id", "query_key"]
    lows = kept.select(*query, F.explode("lows").alias("low"))
    ranked = lows.withColumn("place", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("low")))).where(F.col("place") == k)
    least = ranked.select(*query, F.col("low").alias("_least"))
    left = kept.where("block <> ''").drop("lows").join(least, query, "left").withColumn("least", F.coalesce("_least", F.lit(float("-inf")))).where(F.col("top") >= F.col("least"))
    texts = asked.select(F.col("id").alias("query_id"), F.col("key").alias("query_key"), "v")
    left = left.join(texts, query).select(*query, "block", "rows", "uppers", "least", "v")
    parts = left.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / READS).cast("int").alias("parts"))
    left = left.join(parts, "block").withColumn("part", F.pmod("query_key", F.col("parts")).cast("int")).drop("parts")
    exact = blocks.select("block", "dim", "n", "ids", "exact").join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = left.groupBy("block", "part").cogroup(exact.groupBy("block", "part")).applyInArrow(_reader(k, scale), _FOUND)
    order = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 20"""

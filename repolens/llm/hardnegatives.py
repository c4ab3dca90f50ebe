"""Hard negatives by bit-sliced integer products.

Vectors become integers, floor(scale * x), and are kept in blocks as bit planes: what a component is above the block's least value of it, one packed
plane for each bit, the most significant first. An anchor's product with the planes so far, and the most that the planes to come can add or take away,
give an interval for every score. Each plane tightens all of them, and candidates go as soon as their interval can't qualify:

1. Positives. Rows of the anchor's label whose upper bound is below the anchor's fifth largest lower bound go. After the last plane intervals are scores.
2. Negatives. A positive's score gives a window of scores. Rows of other labels stay while their interval meets a window, and isn't below three rows
   that are in that window for certain.

The first planes are products of matrices; once few candidates are left, each anchor goes on with its own. Blocks of anchors (the stated query set) meet
blocks of vectors, no pair of rows is ever a row, and no exchange is by label. A task keeps each anchor's best so far over its blocks, which is the floor
for the next block, and emits them once, so what is ranked afterwards has a few rows for each anchor and task.

Rows with a null id or label, and vectors that are null, empty, or hold null or non-finite components take no part. Vectors are compared with those of the
same length. Rows with the anchor's id are its own and neither positives nor negatives; repeated rows each count; an anchor that repeats is answered
once. Anchors without positives, and positives without negatives, have no rows. Integers have 64 bits at most; what they can't hold is an error. Extra columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.llm.common import shuffle_width, stash
from repolens.llm.vafile import _dealt, _matrix, _narrow, _packer

BLOCK, ANCHORS, SLICE = 4096, 1024, 256  #: rows of a block, anchors of a block, anchors in one product
FEW = 1 / 16  #: candidates left, as a share, from which each anchor goes on alone
POSITIVES, NEGATIVES = 5, 3


class Planes:
    """A block of integer vectors as bit planes. ``wide``: floats can't hold its products with the anchors, so they are Python's integers."""

    def __init__(self, n: int, low: np.ndarray, bits: int, packed: bytes) -> None:
        self.n, self.low, self.bits, self.dim = n, low, bits, len(low)
        self.packed, self.made = np.frombuffer(packed, np.uint8).reshape(bits, len(packed) // max(bits, 1)), {}

    def plane(self, bit: int) -> np.ndarray:
        if bit not in self.made:
            self.made[bit] = np.unpackbits(self.packed[self.bits - 1 - bit], count=self.n * self.dim).reshape(self.n, self.dim).astype(np.float32)
        return self.made[bit]

    def wide(self, q: np.ndarray) -> bool:
        most = max((abs(int(x)) for x in (self.low.min(initial=0), self.low.max(initial=0))), default=0) + (1 << self.bits)
        return float(np.abs(q.astype(np.float64)).sum(1).max(initial=0)) * most >= 2.0**52


def sliced(x: np.ndarray) -> tuple[np.ndarray, int, bytes]:
    """Each component's least value, the number of planes, and the planes."""
    low = x.min(0)
    above = x.view(np.uint64) - low.view(np.uint64)  # without overflow
    bits = int(above.max(initial=0)).bit_length()
    planes = [np.packbits(((above >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).reshape(-1)) for b in range(bits - 1, -1, -1)]
    return low, bits, b"".join(p.tobytes() for p in planes)


#: (numbers of the anchors, lower bounds, upper bounds) to the candidates that stay; matrices at first, then one anchor's
Sift = Callable[[np.ndarray | int, np.ndarray, np.ndarray], np.ndarray]


def products(q: np.ndarray, planes: Planes, rows: np.ndarray, sift: Sift, reads: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows that stay, their scores), for the anchors ``q`` with any. ``reads`` gets the number of candidates before each plane."""
    wide = planes.wide(q)
    kind = object if wide else np.float64
    exact = q.astype(object) if wide else q.astype(np.float64)
    less, more = np.minimum(exact, 0).sum(1), np.maximum(exact, 0).sum(1)
    small = np.float32 if not wide and float(np.abs(exact).sum(1).max(initial=0)) < 2**24 else kind  # whole numbers that it holds
    fit = q.astype(small)
    score = np.repeat((exact @ planes.low.astype(kind))[:, None], len(rows), 1)
    every, bit = np.arange(len(q)), planes.bits
    read = (lambda b, r: planes.plane(b)[r].astype(np.int64).astype(object)) if wide else (lambda b, r: planes.plane(b)[r].astype(small, copy=False))
    stay = sift(every, score + less[:, None] * ((1 << bit) - 1), score + more[:, None] * ((1 << bit) - 1))
    whole = len(rows) == planes.n
    while bit and stay.mean() > FEW:
        bit -= 1
        if reads is not None:
            reads.append(int(stay.sum()))
        score += (fit @ read(bit, slice(None) if whole else rows).T).astype(kind) * (1 << bit)
        left = (1 << bit) - 1
        stay &= sift(every, score + less[:, None] * left, score + more[:, None] * left)
    for i in np.flatnonzero(stay.any(1)):
        own = np.flatnonzero(stay[i])
        s = score[i, own]
        for b in range(bit - 1, -1, -1):
            s = s + (read(b, rows[own]) @ fit[i]).astype(kind) * (1 << b)
            left = (1 << b) - 1
            if reads is not None:
                reads.append(len(own))
            kept = sift(int(i), s + less[i] * left, s + more[i] * left)
            own, s = own[kept], s[kept]
            if not len(own):
                break
        if len(own):
            yield int(i), rows[own], s


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The kth largest of the last axis; very small where there are fewer."""
    if x.shape[-1] < k:
        return np.full(x.shape[:-1], -np.inf)
    return np.sort(x, axis=-1)[..., -k] if x.dtype == object else np.partition(x, -k, axis=-1)[..., -k]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), int)[:k] if scores.dtype == object else np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Positives:
    """The best rows of each anchor's label so far."""

    def __init__(self, anchors: np.ndarray, ids: np.ndarray, k: int = POSITIVES) -> None:
        self.q, self.ids, self.k = anchors, ids, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

    def floor(self, i: int) -> float:
        ids, scores = self.found[i]
        return scores[-1] if len(ids) == self.k else -np.inf

    def add(self, at: np.ndarray, planes: Planes, rows: np.ndarray, ids: np.ndarray, reads: list[int] | None = None) -> None:
        """The anchors ``at`` with the block's ``rows``; ``ids`` are the block's."""
        floors = np.array([self.floor(i) for i in at])
        own = ids[rows][None, :] == self.ids[at][:, None]

        def sift(i, lower, upper):
            if lower.ndim == 1:
                return upper >= max(floors[i], _kth(lower, self.k))
            lower = np.where(own, -np.inf, lower) if own.any() else lower
            return (upper >= np.maximum(floors, _kth(lower, self.k))[:, None]) & ~own

        for i, r, s in products(self.q[at], planes, rows, sift, reads):
            was = self.found[at[i]]
            self.found[at[i]] = _best(np.r_[was[0], ids[r]], np.r_[was[1], s], self.k)


class Negatives:
    """The best rows of other labels so far in each window of each anchor: (least score, largest score) for each of its positives."""

    def __init__(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, windows: list[list[tuple[int, int]]], k: int = NEGATIVES) -> None:
        self.q, self.ids, self.labels, self.windows, self.k = anchors, ids, labels, windows, k
        self.found = [[(np.zeros(0, np.int64), np.zeros(0))] * len(w) for w in windows]

    def least(self, i: int, w: int) -> float:
        scores = self.found[i][w][1]
        return max(self.windows[i][w][0], scores[-1]) if len(scores) == self.k else self.windows[i][w][0]

    def add(self, at: np.ndarray, planes: Planes, ids: np.ndarray, labels: np.ndarray, reads: list[int] | None = None) -> None:
        open_ = [[(w, self.least(i, w), self.windows[i][w][1]) for w in range(len(self.windows[i]))] for i in at]
        open_ = [[x for x in each if x[1] <= x[2]] for each in open_]
        kept = np.flatnonzero([bool(x) for x in open_])
        if not len(kept):
            return
        at, open_ = at[kept], [open_[i] for i in kept]
        low, high = np.array([min(x[1] for x in each) for each in open_])[:, None], np.array([max(x[2] for x in each) for each in open_])[:, None]
        other = (ids[None, :] != self.ids[at][:, None]) & (labels[None, :] != self.labels[at][:, None])

        def sift(i, lower, upper):
            if lower.ndim == 2:
                return other & (upper >= low) & (lower <= high)
            stay = np.zeros(len(lower), bool)
            for _, a, b in open_[i]:
                sure = lower[(lower >= a) & (upper <= b)]
                stay |= (upper >= max(a, _kth(sure, self.k))) & (lower <= b)
            return stay

        for i, r, s in products(self.q[at], planes, np.arange(planes.n), sift, reads):
            for w, a, b in open_[i]:
                inside = (s >= a) & (s <= b)
                if inside.any():
                    was = self.found[at[i]][w]
                    self.found[at[i]][w] = _best(np.r_[was[0], ids[r[inside]]], np.r_[was[1], s[inside]], self.k)


def windows(scores: list[int]) -> list[tuple[int, int]]:
    """For each positive's score p, the least and the largest whole s with 50 p <= 100 s <= 95 p."""
    return [(-(-p // 2), 95 * p // 100) for p in scores]


_BLOCKS = "block string, dim int, n int, bits int, ids binary, labels binary, low binary, planes binary"
_ANCHORS = "q_block string, q_dim int, q_n int, q_own binary, q_exact binary"


def _vector_blocks(scale: float):
    schema = pa.schema([("block", pa.string()), ("dim", pa.int32()), ("n", pa.int32()), ("bits", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "low", "planes"))])

    def flush(dim: int, own: np.ndarray, x: np.ndarray, number: int) -> tuple:
        low, bits, planes = sliced(np.ascontiguousarray(x))
        return uuid.uuid4().hex, dim, len(x), bits, own[:, 0].tobytes(), own[:, 1].tobytes(), low.tobytes(), planes

    return _packer(BLOCK, scale, flush, schema)


def _anchor_blocks(scale: float):
    schema = pa.schema([("q_block", pa.string()), ("q_dim", pa.int32()), ("q_n", pa.int32()), ("q_own", pa.binary()), ("q_exact", pa.binary())])

    def flush(dim: int, own: np.ndarray, x: np.ndarray, number: int) -> tuple:
        return uuid.uuid4().hex, dim, len(x), own.tobytes(), _narrow(x).tobytes()

    return _packer(ANCHORS, scale, flush, schema)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Planes, np.ndarray, np.ndarray, str, np.ndarray, np.ndarray]]:
    """(planes, ids, labels, name of the anchor block, its columns, its vectors) of each pair of blocks whose lengths agree."""
    last, now = None, None
    for batch in batches:
        for j in range(batch.num_rows):
            row = {c: batch.column(c)[j].as_py() for c in ("block", "dim", "q_dim", "q_block", "q_n")}
            if row["dim"] != row["q_dim"]:
                continue
            if row["block"] != last:  # a block's anchors follow each other
                last, raw = row["block"], {c: batch.column(c)[j].as_py() for c in ("n", "bits", "ids", "labels", "low", "planes")}
                low, ids, labels = (np.frombuffer(raw[c], np.int64) for c in ("low", "ids", "labels"))
                now = Planes(raw["n"], low, raw["bits"], raw["planes"]), ids, labels
            own = np.frombuffer(batch.column("q_own")[j].as_py(), np.int64).reshape(row["q_n"], -1)
            yield *now, row["q_block"], own, _matrix(batch.column("q_exact")[j].as_py(), row["q_n"], row["dim"]).astype(np.int64)


_FOUND = "anchor_id long, anchor_key long, place int, vec_id long, score long"


def _found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    names, types = ["anchor_id", "anchor_key", "place", "vec_id", "score"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    for a in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 50_000], strict=True), types, strict=True)], names=names)


def _positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, Positives]] = {}
    for planes, ids, labels, name, own, q in _pairs(batches):
        if name not in held:
            held[name] = own, Positives(q, own[:, 0])
        for label in np.intersect1d(own[:, 2], labels):
            at, rows = np.flatnonzero(own[:, 2] == label), np.flatnonzero(labels == label)
            for a in range(0, len(at), SLICE):
                held[name][1].add(at[a : a + SLICE], planes, rows, ids)
    yield from _found([(int(own[i, 0]), int(own[i, 1]), 0, int(v), int(s)) for own, best in held.values() for i, (ids, scores) in enumerate(best.found) for v, s in zip(ids, scores, strict=True)])


def _negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, Negatives]] = {}
    for planes, ids, labels, name, own, q in _pairs(batches):
        if name not in held:
            held[name] = own, Negatives(q, own[:, 0], own[:, 2], [windows(x[4 : 4 + x[3]]) for x in own.tolist()])
        for a in range(0, len(q), SLICE):
            held[name][1].add(np.arange(a, min(a + SLICE, len(q))), planes, ids, labels)
    rows = ((own, best, i, w) for own, best in held.values() for i in range(len(own)) for w in range(len(best.found[i])))
    yield from _found([(int(own[i, 0]), int(own[i, 1]), w + 1, int(v), int(s)) for own, best, i, w in rows for v, s in zip(*best.found[i][w], strict=True)])


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that ``is_anchor`` holds for, its five best rows of the
    same ``label``, and for each of these the three best rows of other labels with half its score or more, and 95 % or less."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_anchor.alias("asked"))
    rows = rows.where(F.col("label").isNotNull())
    asked = rows.where("asked").select("id", "label", "v").dropDuplicates().withColumn("key", F.xxhash64("id", "label", "v"))
    asked = stash(asked, "anchors")
    n_rows, n_asked = vectors.count(), asked.count()
    blocks = stash(rows.select("id", "label", "v").repartition(int(n_rows // BLOCK) + 1).mapInArrow(_vector_blocks(scale), _BLOCKS), "planes")
    for_blocks, for_anchors = _dealt(int(n_rows // BLOCK) + 1, int(n_asked // ANCHORS) + 1, shuffle_width(spark))

    def met(columns: list, anchors: DataFrame, run) -> DataFrame:
        # the stated query set against all rows, block by block; lengths are compared in the task
        packed = stash(anchors.select(*columns).repartition(int(n_asked // ANCHORS) + 1).mapInArrow(_anchor_blocks(scale), _ANCHORS), "anchor_blocks")
        return blocks.repartition(for_blocks).crossJoin(packed.repartition(for_anchors)).mapInArrow(run, _FOUND)

    own = ["id", "key", "label"]
    positives = _ranked(met([*own, "v"], asked, _positives), POSITIVES, "anchor_id", "anchor_key")
    positives = stash(positives.select("anchor_id", "anchor_key", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positives.groupBy("anchor_id", "anchor_key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # five at most
    with_scores = asked.join(scores, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key")))
    places = [F.coalesce(F.get("p", F.lit(i))["positive_score"], F.lit(0)).alias(f"p{i}") for i in range(POSITIVES)]
    found = met([*own, F.size("p").cast("long").alias("n"), *places, "v"], with_scores, _negatives)
    keys = ["anchor_id", "anchor_key", "place"]
    best = _ranked(found, NEGATIVES, *keys).join(positives, keys)
    return best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, d.vec_id, q.label = d.label AS same, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""

"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.llm import hardnegatives

LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank string"


def brute(rows):
    usable = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, v in {u for u in usable if u[0] % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in usable if j != i and len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(-s, k) for s, k, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, j, r, k, -p, s) for r, (s, k) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, label, "mine", "mine") for i, v, label in rows], SCHEMA)
    return sorted(tuple(r) for r in hardnegatives.mine(df, F.col("vec_id") % 50 == 0, F.expr(LABEL)).collect())


def made(n, seed, size=1.0, dim=6, clusters=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    return [(i, [size * (c + rng.gauss(0, 0.6)) for c in rng.choice(centres)], rng.randint(0, 3)) for i in range(n)]


@pytest.mark.parametrize(("block", "anchors", "size"), [(4096, 1024, 1.0), (16, 3, 1.0), (50, 2, 1e5), (50, 2, 8e5)])
def test_against_brute_force(spark, monkeypatch, block, anchors, size):
    monkeypatch.setattr(hardnegatives, "BLOCK", block)
    monkeypatch.setattr(hardnegatives, "ANCHORS", anchors)
    rows = made(400, 7, size)
    rows += [(401, None, 1), (402, [1.0, None] * 3, 1), (403, [float("nan")] * 6, 2), (404, [float("inf")] * 6, 2), (None, [1.0] * 6, 1), (450, [], 1), (500, [0.5] * 4, 1), (501, [0.5] * 4, 2), (502, [0.4] * 4, 1), (503, [0.3] * 4, 3), (550, [1.0] * 6, None)]
    rows += [rows[100], rows[100], (50, rows[50][1], 3), (600, [-x for x in rows[3][1]], 9), (601, [0.0] * 6, 2), (602, [0.0] * 6, 2), rows[7], rows[8], rows[8]]
    expected = brute(rows)
    assert mined(spark, rows) == expected and len(expected) > 60


def test_ties_hot_labels_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(hardnegatives, "BLOCK", 20)
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(0, 2)) / 4 for _ in range(3)], 5 if i % 3 else 6) for i in range(220)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, []) == []


def test_planes_tighten_and_few_bits_are_read():
    """With unit vectors of 64 dimensions most candidates go before the last planes."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (4000, 64))
    labels = rng.integers(0, 10, 4000)
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    low, bits, packed = hardnegatives.sliced(x)
    planes = hardnegatives.Planes(len(x), low, bits, packed)
    assert (low + sum(planes.plane(b).astype(np.int64) << b for b in range(bits)) == x).all()
    q, ids = x[:50], np.arange(4000)
    scores = q @ x.T
    best, reads = hardnegatives.Positives(q, ids[:50]), []
    for label in range(10):
        at, rows = np.flatnonzero(labels[:50] == label), np.flatnonzero(labels == label)
        if len(at):
            best.add(at, planes, rows, ids, reads)
    for i in range(50):
        own = np.flatnonzero((labels == labels[i]) & (ids != i))
        assert best.found[i][0].tolist() == own[np.lexsort((own, -scores[i, own]))][:5].tolist()
    windows = [hardnegatives.windows([int(s) for s in found[1]]) for found in best.found]
    worst, reads = hardnegatives.Negatives(q, ids[:50], labels[:50], windows), []
    worst.add(np.arange(50), planes, ids, labels, reads)
    assert sum(reads) < 0.7 * bits * 50 * 4000

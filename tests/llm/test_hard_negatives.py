"""Hard negatives and the tree below, against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readweave.llm import gnat, hard_negatives


def by_hand(rows, every=100, positives=5, negatives=10):
    """rows: vec_id, embedding, label."""
    own = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((vec_id, [int(np.floor(256.0 * np.float64(x))) for x in v], label))
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = Counter()
    for i, (a, v, label) in enumerate(own):
        if a is None or a % every:
            continue
        scored = [(b, sum(x * y for x, y in zip(v, w)), of) for j, (b, w, of) in enumerate(own) if j != i and len(w) == len(v)]
        for p in sorted((x for x in scored if x[2] == label), key=order)[:positives]:
            near = [x for x in scored if x[2] != label and 30 * p[1] <= 100 * x[1] <= 90 * p[1]]
            for k, x in enumerate(sorted(near, key=order)[:negatives], 1):
                out[(a, p[0], k, x[0], p[1], x[1])] += 1
    return out


def vectors(seed, n=500, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    rows = [(i, (centres[i % 8] + rng.normal(scale=0.4, size=dim)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    same = rows[3][1]
    rows += [(1000 + i, same, i % 3) for i in range(200)]  # a hot group of equal vectors
    rows += [(100, rows[0][1], 1), (100, rows[0][1], 1), (None, rows[5][1], 2), (None, rows[6][1], None), (-100, rows[7][1], 0)]
    rows += [(2000, None, 1), (2100, [None] * dim, 1), (2200, [float("nan")] * dim, 1), (2300, [float("inf")] * dim, 1), (2400, [], 1), (2401, [], 2), (2500, [0.0] * dim, 1), (2501, [0.0] * dim, 1), (2502, [0.0] * dim, 0)]
    rows += [(2600 + i, [0.1 * i, 0.2], i % 2) for i in range(12)]  # another length
    return rows


@pytest.mark.parametrize("seed,block,queries,leaf,points", [(1, 2048, 1024, 256, 256), (2, 64, 3, 8, 256), (3, 100, 1024, 16, 2), (4, 40, 5, 4, 0)])
def test_against_all_pairs(spark, monkeypatch, seed, block, queries, leaf, points):
    for name, value in (("BLOCK", block), ("QUERIES", queries), ("LEAF", leaf), ("POINTS", points)):
        monkeypatch.setattr(gnat, name, value)
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "vec_id long, embedding array<float>, label long, cell int, rid int").repartition(7)
    got = Counter(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())
    assert got == by_hand(rows)


def test_few_rows(spark):
    for rows in ([], [(0, [1.0, 2.0], 1)], [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")
        assert Counter(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()) == by_hand(rows)


def test_great_components(spark):
    """Products above 2^53 stay exact; rows too long for 64 bits take no part."""
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=4) * 2**20).astype(np.float32).tolist(), i % 2) for i in range(120)]
    far = [(5000, [3e38, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows + far, "vec_id long, embedding array<float>, label long")
    assert Counter(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 20 == 0).collect()) == by_hand(rows, 20)


def test_eliminated_cells_hold_no_hit():
    """Whatever the windows, every row within one is in a cell that stays open; narrow windows close some."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 3))
    centres *= 300 / np.linalg.norm(centres, axis=1, keepdims=True)
    x = (centres[rng.integers(0, 8, 2000)] + rng.normal(scale=15, size=(2000, 3))).astype(np.int64)
    radius = float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max())
    lifted = gnat.lifted(x, radius)
    assert np.allclose((lifted**2).sum(axis=1), radius**2)
    node = gnat.grown(lifted, np.arange(len(x)), gnat.SLACK * (radius + 1))
    q = x[:50]
    lo = rng.integers(-60_000, 60_000, size=(50, 2))
    lo[:, 1] = (q * q).sum(axis=1) - 3000
    hi = lo + rng.integers(0, 5000, size=(50, 2))
    opened = gnat.open_cells(gnat.distances(gnat.asked(q), node.points), *gnat.annuli(q, lo, hi, radius), node.least, node.most)
    scores = gnat.products(q, x)
    for j, under in enumerate(node.under):
        rows = np.concatenate([n.rows for n in leaves(under)])
        hits = ((scores[:, None, rows] >= lo[:, :, None]) & (scores[:, None, rows] <= hi[:, :, None])).any(axis=2)
        assert not (hits & ~opened[:, :, j]).any()
    assert opened[:, 1].mean() < 0.5


def leaves(node):
    return [node] if node.under is None else [x for u in node.under for x in leaves(u)]

"""Local alignments in small and in large numbers."""

import random

import numpy as np
from test_genome import by_hand

from readweave.operators import rescue as rs


def test_scores_of_any_size(monkeypatch):
    rng = random.Random(1)
    b = ["".join(rng.choices("ACGT", k=rng.randrange(1, 50))) for _ in range(40)]
    a = ["".join(x if rng.random() < 0.85 else rng.choice(["", "A", "CG"]) for x in t) + "T" for t in b]
    kinds, zeros = [], np.zeros
    monkeypatch.setattr(rs.np, "zeros", lambda shape, kind=float: kinds.append(kind) or zeros(shape, kind))
    for scores, kind in ((rs.Scores(), np.int16), (rs.Scores(1000, -800, 2000, 100), np.int32)):
        assert rs.local_alignments(a, b, scores).tolist() == [by_hand(x, y, scores) for x, y in zip(a, b)]
        assert kinds[0] is kind
        kinds.clear()

"""The language model against Katz backoff by brute force, of order two and three, in small batches and divided histories."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from readweave.llm import language_model as lm

K = lm.DISCOUNTED


def texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 90)))) for i in range(260)]
    long = " ".join(rng.choices(vocabulary, weights, k=7000))
    return [*rows, (900, long), (901, None), (902, ""), (903, "One w1  W2\tnew"), (903, "w0 w0"), (None, "w1 w2")]


class Katz:
    def __init__(self, docs, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for i, text in docs:
            if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
                ts = self.tokens(text)
                for k in range(order - 1, len(ts)):
                    for n in range(1, order + 1):
                        self.counts[n][tuple(ts[k - n + 1 : k + 1])] += 1
        self.d = [None] + [lm.discounts(np.array([sum(c == r for c in self.counts[n].values()) for r in range(1, K + 2)], float)) for n in range(1, order + 1)]
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for n in range(2, order + 1):
            for gram, c in self.counts[n].items():
                self.after[n][gram[:-1]][gram[-1]] = c
        self.total = sum(self.counts[1].values())
        self.memory = {}

    def tokens(self, text):
        return ["<s>"] * (self.order - 1) + (text or "").lower().split() + ["</s>"]

    def word(self, w):
        c = self.counts[1][(w,)]
        if c:
            return self.d[1][min(c, K + 1)] * c / self.total
        return sum(c * (1 - self.d[1][c]) for c in self.counts[1].values() if c <= K) / self.total

    def p(self, h, w):
        if not h:
            return self.word(w)
        seen = self.after[len(h) + 1].get(h)
        if not seen:
            return self.p(h[1:], w)
        d, c = self.d[len(h) + 1], sum(seen.values())
        if w in seen:
            kept = sum(d[min(x, K + 1)] * x for x in seen.values())
            scale = c / (c + 0.5) if 1 - kept / c < 1e-9 else 1
            return scale * d[min(seen[w], K + 1)] * seen[w] / c
        if h not in self.memory:
            left = 1 - sum(d[min(x, K + 1)] * x for x in seen.values()) / c
            left = 0.5 / (c + 0.5) if left < 1e-9 else left
            self.memory[h] = left / (1 - sum(self.p(h[1:], x) for x in seen))
        return self.memory[h] * self.p(h[1:], w)

    def score(self, text):
        ts = self.tokens(text)
        return sum(math.log10(self.p(tuple(ts[k - self.order + 1 : k]), ts[k])) for k in range(self.order - 1, len(ts)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, order):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scored, n = lm.score(docs, order=order, batch_tokens=700, split=400, part_tokens=1500)
    model = Katz(rows, order)
    assert n == model.total
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 7)) for r in scored.collect())
    assert got == sorted((str(i), len(model.tokens(t)) - order + 1, round(model.score(t), 7)) for i, t in rows)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(order):
    model = Katz(texts(), order)
    types = [w for (w,) in model.counts[1]] + ["never seen"]
    for h in [*list(model.after[order])[:50], ("never", "seen")[: order - 1]]:
        assert abs(sum(model.p(h, w) for w in types) - 1) < 1e-9


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a-1", "one two"), ("b-2", None), (None, "two")], "doc_id string, text string")
    scored, _ = lm.score(docs)
    assert {(r["doc_id"], r["n_tokens"]) for r in scored.collect()} == {("a-1", 3), ("b-2", 1), (None, 2)}

"""The factorization machine: a label that only a pair explains, a rare term, held-out accuracy, and its score by brute force."""

import math
import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from readweave.llm import toxicity

WORDS = [f"w{i}" for i in range(400)]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_a_pair_explains_the_label(spark):
    """Toxic if exactly one of two words stands there: neither word alone tells anything."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(rng.sample(WORDS, 20) + ["left"] * a + ["right"] * b)))
        labels.append((i, int(a != b)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    right = [(r["score"] >= 0.5) == bool(dict_of[r["doc_id"]]) for dict_of in [dict(labels)] for r in got if held_out(r["doc_id"])]
    assert sum(right) > 0.95 * len(right)


def test_a_rare_term_is_learnt():
    rng = random.Random(3)
    rows, y = [], []
    for i in range(3000):
        toxic = i % 8 == 0
        words = rng.sample(WORDS, 40) + (["insult"] if toxic and i % 400 else []) + (["slurword"] if toxic and i % 400 == 0 else [])
        rows.append(toxicity.terms(" ".join(words)))
        y.append(float(toxic))
    model = toxicity.learn(rows, np.array(y))
    clean = [model.score(" ".join(rng.sample(WORDS, 40))) for _ in range(200)]
    rare = [model.score(" ".join([*rng.sample(WORDS, 40), "slurword"])) for _ in range(200)]  # in 8 of 3,000 rows
    assert sum(s < toxicity.THRESHOLD for s in clean) > 195
    assert sum(s >= toxicity.THRESHOLD for s in rare) > 150


def test_score_by_brute_force():
    rng = np.random.default_rng(1)
    model = toxicity.Machine(0.3, rng.normal(0, 0.1, toxicity.BUCKETS).astype(np.float32), rng.normal(0, 0.1, (toxicity.BUCKETS, toxicity.RANK)).astype(np.float32))
    text = "One TWO three; beginnings and longerwords, one"
    at = toxicity.terms(text)
    z = 0.3 + sum(float(model.weights[i]) for i in at) + sum(float(model.factors[i] @ model.factors[j]) for i, j in combinations(at, 2))
    assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-5


def test_held_out_documents(spark):
    """On the shared tables: of held-out labelled documents most toxic ones are caught and clean ones left alone."""
    top = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{top}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).join(labels, "doc_id").filter("toxic IS NOT NULL").collect()
    own = [(r["score"] >= toxicity.THRESHOLD, r["toxic"]) for r in got if held_out(r["doc_id"])]
    caught = [p for p, t in own if t]
    false = [p for p, t in own if not t]
    print(f"caught {sum(caught)} of {len(caught)}, false {sum(false)} of {len(false)}")
    assert sum(caught) > 0.8 * len(caught) and sum(false) < 0.01 * len(false)


@pytest.mark.parametrize("ids", ["string", "long"])
def test_edge_cases(spark, ids):
    docs = spark.createDataFrame([("1", None), ("2", ""), ("2", ""), (None, "x")], "doc_id string, text string")
    docs = docs.select(docs["doc_id"].cast(ids).alias("doc_id"), "text")
    labels = spark.createDataFrame([("1", None)], "doc_id string, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels.select(labels["doc_id"].cast(ids).alias("doc_id"), "toxic"))).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {0.5}


def test_training_rows_are_bounded(spark, monkeypatch):
    """One id thirty thousand times: no more than max_rows rows reach the driver."""
    docs = spark.range(30_100).selectExpr("CASE WHEN id < 30000 THEN 2 ELSE id END AS doc_id", "concat('some text ', id % 7) AS text")
    labels = spark.range(30_100).selectExpr("CASE WHEN id < 30000 THEN 2 ELSE id END AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    assert toxicity.sampled(docs, 100, 30_100, "doc_id", "text").count() <= 100
    seen = []
    monkeypatch.setattr(toxicity, "learn", lambda rows, y: seen.append(len(rows)) or toxicity.Machine(0.0, np.zeros(toxicity.BUCKETS, np.float32), np.zeros((toxicity.BUCKETS, toxicity.RANK), np.float32)))
    toxicity.train(docs, labels, max_rows=100)
    assert sum(seen) <= 100

"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct words of a text (letters, digits and non-ASCII, A-Z lower-cased) and the beginnings of its longer
words, hashed to ``BUCKETS`` buckets. A document is the set of its buckets. The machine adds a weight for each bucket and,
through ``RANK`` factors, a weight for each pair of them, so a pair such as an insult and the mention of a group can count
for more, or for less, than both alone. Every bucket that the sample holds in two documents at least has a weight and
factors: none is chosen beforehand, so a pair is learnt whose members tell nothing by themselves.

Regularisation instead of a choice: a bucket's value in the additive part is z^2 / (z^2 + EVIDENCE^2), where z compares
its shares of either class, so weak evidence learns slowly and counts little; its value in pairs is n / (n + SEEN) of its
n documents, as rare buckets can't show an interaction; weights and factors decay. Rarer labels weigh more.

Learning is by AdaGrad on at most ``max_rows`` labelled rows (a documented bound), in small batches of sparse rows: ids are
chosen by a hash, then, where ids repeat, rows by a hash of the row. Only buckets that occur are trained; the model has a fixed
size, BUCKETS x (RANK + 1) numbers, whatever the corpus.

Defined results: null and empty texts score like a document without terms; a text of any length is read whole; identical
rows score the same, and a row that scores the threshold exactly counts as toxic; doc_id may be of any type; a null doc_id is
scored but not learnt from; labels that are null are not learnt from, of several labels of one id the largest holds, and each
sampled row of an id that repeats is learnt; with no labels, or one class only, every score is the
class's smoothed rate; extra columns are kept by `reject`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
RANK = 8
MAX_ROWS = 20_000
THRESHOLD = 0.7
SEED = 7
#: Words of more bytes than this also count by their first ones.
BEGINNING = 6
EVIDENCE, SEEN = 4.0, 200.0
#: Rows read in training, over all epochs; at most EPOCHS epochs.
VISITS, EPOCHS, BATCH = 60_000, 15, 64

#: ASCII bytes that are no letter or digit become blanks.
_BLANKED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> np.ndarray:
    """Sorted buckets of the distinct terms of a whole text."""
    ws = set((text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANKED).split())
    begun = {w[:BEGINNING] for w in ws if len(w) > BEGINNING}
    found = {zlib.crc32(w) % BUCKETS for w in ws}
    found.update(zlib.crc32(w, 1) % BUCKETS for w in begun)
    return np.array(sorted(found), np.int32)


@dataclass
class Machine:
    """Score of a set of buckets: sigmoid of bias, weights and pairs of factors."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, text: str | None) -> float:
        at = terms(text)
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        z = self.bias + float(self.weights[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def in_training(doc_id: Column) -> Column:
    """Rows to learn from: those whose crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def learn(rows: list[np.ndarray], labels: np.ndarray) -> Machine:
    """A machine from rows of buckets and labels of 0 and 1, both of which occur."""
    rng = np.random.default_rng(SEED)
    n, n1 = len(labels), float(labels.sum())
    n0 = n - n1
    size = np.array([len(r) for r in rows])
    first = np.cumsum(size) - size
    # buckets that occur are numbered anew
    used, flat = np.unique(np.concatenate(rows), return_inverse=True)
    flat = flat.astype(np.int32)
    seen = np.bincount(flat, minlength=len(used)).astype(float)
    toxic = np.bincount(flat[np.repeat(labels > 0, size)], minlength=len(used)).astype(float)
    share = seen / n
    z2 = (toxic / n1 - (seen - toxic) / n0) ** 2 / (share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    alone = np.where(seen > 1, z2 / (z2 + EVIDENCE**2), 0.0)
    paired = np.where(seen > 1, seen / (seen + SEEN), 0.0)
    heavier = min(10.0, max(0.1, n0 / n1))
    w, gw = np.zeros(len(used)), np.full(len(used), 1e-2)
    v, gv = rng.normal(0, 0.01, (len(used), RANK)), np.ones(len(used))
    bias, gb = float(np.log(n1 / n0)), 1.0
    for _ in range(int(np.clip(VISITS / n, 3, EPOCHS))):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            own = order[k : k + BATCH]
            count = size[own]
            at = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            ids, place = np.unique(flat[at], return_inverse=True)
            x = np.zeros((len(own), len(ids)), np.float32)
            x[np.repeat(np.arange(len(own)), count), place] = 1
            a, p = alone[ids], paired[ids][:, None]
            factors = v[ids] * p
            xv = x @ factors
            z = bias + x @ (w[ids] * a) + 0.5 * ((xv**2).sum(axis=1) - (x @ factors**2).sum(axis=1))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) * np.where(labels[own] > 0, heavier, 1.0)
            each = x.T @ d
            grad = each * a / len(own) + 1e-5 * w[ids]
            pairs = (x.T @ (d[:, None] * xv) - each[:, None] * factors) * p
            gb += d.sum() ** 2
            bias -= 0.3 * d.sum() / np.sqrt(gb)
            gw[ids] += grad**2
            w[ids] -= 0.3 * grad / np.sqrt(gw[ids])
            gv[ids] += (pairs**2).mean(axis=1)
            rate = 0.1 / np.sqrt(gv[ids])[:, None]
            v[ids] = (v[ids] - rate * pairs) / (1 + rate)
    weights, factors = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, RANK), np.float32)
    weights[used], factors[used] = w * alone, v * paired[:, None]
    return Machine(float(bias), weights, factors)


def sampled(rows: DataFrame, max_rows: int, n: int, *hashed: str) -> DataFrame:
    """At most ``max_rows`` of the n rows: all, or a share by a hash of the named columns and of the row's number, so low that
    their number stays below the bound (by four deviations)."""
    if n <= max_rows:
        return rows
    share = max(0.0, max_rows - 4 * max_rows**0.5) / n
    drawn = rows.withColumn("_no", F.monotonically_increasing_id())
    return drawn.filter(F.pmod(F.xxhash64(*hashed, "_no", F.lit(SEED)), F.lit(1 << 40)) < int(share * (1 << 40))).drop("_no")


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> Machine:
    """Learn from labelled rows for which `in_training` holds; of more than ``max_rows`` a hashed sample of no more than so many."""
    toxic = labels.filter(in_training(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = toxic.count()
    toxic = toxic.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(1e6 * min(1.0, max_rows / max(n, 1))))
    # about max_rows ids: a bounded table, so texts needn't be shuffled to meet it
    held = docs.select("doc_id", "text").join(F.broadcast(toxic), "doc_id")
    own = sampled(held, max_rows, held.count(), "doc_id", "text").select("text", F.col("toxic").cast("double").alias("y"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [terms(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), b.column(1)], ["at", "y"])

    # max_rows rows of bucket numbers at most
    seen = own.mapInArrow(found, "at array<int>, y double").toArrow()
    y = (seen["y"].to_numpy() > 0).astype(float)
    rows = [np.array(a.values) for a in seen["at"]]
    del seen
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n0 or not n1:
        rate = (n1 + 1) / (n0 + n1 + 2)
        return Machine(float(np.log(rate / (1 - rate))), np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, RANK), np.float32))
    order = sorted(range(len(rows)), key=lambda i: (xxhash.xxh64_intdigest(rows[i]), y[i]))  # an order of its own, so reruns agree
    return learn([rows[i] for i in order], y[order])


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, columns as they came."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def scored(texts):  # noqa: ANN001, ANN202
        return texts.map(model.score, na_action=None)

    return docs.filter(scored(F.col("text")) < threshold)

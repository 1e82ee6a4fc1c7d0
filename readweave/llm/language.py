"""Language identification: a bidirectional gated recurrent network over the bytes of the text.

The network reads the whole byte stream of a text, white space and all, from both ends, in windows of ``CORE`` bytes that
overlap their neighbours by ``MARGIN`` bytes on either side: states cross word borders, and the margins warm them up, so
every byte is labelled once, from what stands before and after it. Every position gets a probability for each label from
the two states there; a document's probabilities are the geometric mean over all its positions. The network is trained in
numpy by backpropagation through time, on at most ``WINDOWS`` windows of ``STEPS`` bytes, evenly spread, of each of at
most ``max_rows`` training documents, chosen by a hash of their rows, of the ``MAX_LANGUAGES`` most frequent languages (documented
bounds), so its size is bounded.

Defined results: null texts and texts without a letter are `und` with score 0; a text of any length is read whole;
identical rows get the same label, of labels that tie the first by name; null languages are not learnt; rows of an id that
repeats are all learnt; doc_id may be of any type; without any language to learn every text is `und`; short windows are
padded, and padding is never labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, WINDOWS = 64, 4
CORE, MARGIN = 224, 16
HIDDEN = 8
MAX_ROWS = 2_000
#: Labels of the output layer at most.
MAX_LANGUAGES = 256
ROUNDS = 300
#: Windows that are read together, and that are gathered to be sorted by length.
BATCH, GATHERED = 2048, 16_384
SEED = 11
UNKNOWN = "und"


@dataclass
class Network:
    """Per direction: inputs (3H x 256, by byte), recurrent (3H x H); out (L x 2H + 1, the last column is the bias)."""

    labels: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    x = _sigmoid(x)
    x *= 2
    x -= 1
    return x


def states(codes: np.ndarray, inputs: np.ndarray, recurrent: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, H, windows) of one direction over codes (steps, windows), zero where mask is; keep gets what the way back needs."""
    h = recurrent.shape[1]
    out = np.empty((len(codes), h, codes.shape[1]), recurrent.dtype)
    before = np.zeros((h, codes.shape[1]), recurrent.dtype)
    for t, x in enumerate(codes):
        a = np.take(inputs, x, axis=1)
        u = recurrent @ before
        a[: 2 * h] += u[: 2 * h]
        gates = _sigmoid(a[: 2 * h])
        r, z = gates[:h], gates[h:]
        new = u[2 * h :] * r
        new += a[2 * h :]
        new = _tanh(new)
        state = before - new
        state *= z
        state += new
        state *= mask[t]  # so a window's states don't depend on how far it is padded
        if keep is not None:
            keep.append((before, r.copy(), z.copy(), new, u[2 * h :].copy()))
        out[t] = before = state
    return out


def probabilities(net: Network, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(steps, labels, windows) of codes (steps, windows); mask (same shape) is 0 in the padding."""
    f = states(codes, net.inputs[0], net.recurrent[0], mask)
    b = states(codes[::-1], net.inputs[1], net.recurrent[1], mask[::-1])[::-1]
    h = f.shape[1]
    z = np.matmul(net.out[:, :h], f)
    z += np.matmul(net.out[:, h : 2 * h], b)
    z += net.out[:, 2 * h :]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def gradients(p: list[np.ndarray], c: np.ndarray, k: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the positions that the mask k leaves of windows c, and its gradient for each array of p, by
    backpropagation through time."""
    h, kept = p[2].shape[1], ([], [])
    f = states(c, p[0], p[2], k, kept[0])
    b = states(c[::-1], p[1], p[3], k[::-1], kept[1])[::-1]
    net, each = p[4], np.arange(c.shape[1])
    z = np.matmul(net[:, :h], f) + np.matmul(net[:, h : 2 * h], b) + net[:, 2 * h :]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    loss = float(-(np.log(z[:, target, each] + 1e-30) * k).sum() / k.sum())
    z[:, target, each] -= 1
    z *= k[:, None, :] / k.sum()
    g = [np.zeros_like(x) for x in p]
    g[4][:, :h] = np.einsum("tlb,thb->lh", z, f, optimize=True)
    g[4][:, h : 2 * h] = np.einsum("tlb,thb->lh", z, b, optimize=True)
    g[4][:, 2 * h] = z.sum(axis=(0, 2))
    for d, at, held in ((0, c, k), (1, c[::-1], k[::-1])):
        out = np.matmul(net[:, d * h : (d + 1) * h].T, z if d == 0 else z[::-1])
        carried = np.zeros((h, c.shape[1]), p[4].dtype)
        for t in range(len(at) - 1, -1, -1):
            before, r, zt, new, u = kept[d][t]
            dh = (out[t] + carried) * held[t]
            dz = dh * (before - new) * zt * (1 - zt)
            dn = dh * (1 - zt) * (1 - new**2)
            dr = dn * u * r * (1 - r)
            da = np.concatenate([dr, dz, dn])
            du = np.concatenate([dr, dz, dn * r])
            hot = np.zeros((256, c.shape[1]), p[4].dtype)
            hot[at[t], each] = 1
            g[d] += da @ hot.T
            g[2 + d] += du @ before.T
            carried = dh * zt + p[2 + d].T @ du
    return loss, g


def learn(codes: np.ndarray, mask: np.ndarray, y: np.ndarray, labels: list[str], rounds: int = ROUNDS, batch: int = 256) -> Network:
    """Train on windows (steps, n), their mask and their labels' indices; cross-entropy at every position, by Adam."""
    rng = np.random.default_rng(SEED)
    h, n_labels = HIDDEN, len(labels)
    p = [*(rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32) for _ in range(2)), *(rng.normal(0, 0.3, (3 * h, h)).astype(np.float32) for _ in range(2)), np.zeros((n_labels, 2 * h + 1), np.float32)]
    m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, rounds + 1):
        own = rng.integers(0, codes.shape[1], batch)
        _, g = gradients(p, codes[:, own], mask[:, own].astype(np.float32), y[own])
        rate = 0.02 * min(1.0, step / 20) * (1 - step / (rounds + 1))
        for i, grad in enumerate(g):
            m[i] = 0.9 * m[i] + 0.1 * grad
            s[i] = 0.99 * s[i] + 0.01 * grad**2
            p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-6)
    return Network(labels, p[:2], p[2:4], p[4])


def windows(text: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Windows of a text, with the first and the end of the positions that each labels."""
    for at in range(0, len(text), CORE):
        lo = max(0, at - MARGIN)
        yield text[lo : at + CORE + MARGIN], at - lo, min(len(text), at + CORE) - lo


def coded(ws: list[bytes], steps: int) -> np.ndarray:
    """Codes (steps, windows)."""
    return np.ascontiguousarray(np.frombuffer(b"".join(w.ljust(steps) for w in ws), np.uint8).reshape(-1, steps).T)


def window_logs(net: Network, ws: list[tuple[bytes, int, int]]) -> np.ndarray:
    """Sums of log probabilities over the labelled positions (windows, labels)."""
    found = np.zeros((len(ws), len(net.labels)), np.float32)
    lengths = np.array([len(w) for w, _, _ in ws], np.int64)
    lo, hi = (np.array([w[k] for w in ws], np.int64) for k in (1, 2))
    order = np.argsort(lengths, kind="stable")
    for k in range(0, len(order), BATCH):
        own = order[k : k + BATCH]
        steps = int(lengths[own[-1]])
        at = np.arange(steps)[:, None]
        logs = probabilities(net, coded([ws[i][0] for i in own], steps), (at < lengths[own]).astype(np.float32))
        logs += 1e-9
        np.log(logs, out=logs)
        logs *= ((at >= lo[own]) & (at < hi[own]))[:, None, :]
        found[own] = logs.sum(axis=0).T
    return found


def document_probabilities(net: Network, texts: Iterator[bytes], n: int) -> np.ndarray:
    """Probabilities (documents, labels) pooled over all positions; even for empty texts."""
    total, size = np.zeros((n, len(net.labels))), np.zeros(n)
    held: list[tuple[bytes, int, int]] = []
    owner: list[int] = []

    def add() -> None:
        logs = window_logs(net, held)
        for j in range(len(net.labels)):
            total[:, j] += np.bincount(owner, logs[:, j], n)
        held.clear()
        owner.clear()

    for i, t in enumerate(texts):
        size[i] = len(t)
        for w in windows(t):
            held.append(w)
            owner.append(i)
            if len(held) == GATHERED:
                add()
    if held:
        add()
    total = np.exp(total / np.maximum(1, size)[:, None])
    return total / total.sum(axis=1, keepdims=True)


def in_training(doc_id: Column) -> Column:
    """Rows to learn from: those whose crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, *, max_rows: int = MAX_ROWS) -> Network:
    """Learn from texts and languages; of each language a hashed sample of about the same share of ``max_rows``."""
    own = docs.filter(in_training(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    # a row for each language, and no more than MAX_LANGUAGES of them: the most frequent
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    nothing = Network([], [], [], np.zeros((0, 2 * HIDDEN + 1), np.float32))
    if not counts:
        return nothing
    labels = sorted(counts)
    # so low a share that the rows of a language stay below its part of max_rows (by four deviations), repeated ids or not
    part = max_rows / len(labels)
    shares = {k: 1.0 if counts[k] <= part else max(0.0, part - 4 * part**0.5) / counts[k] for k in labels}
    share = docs.sparkSession.createDataFrame([(k, int(shares[k] * (1 << 40))) for k in labels], "lang string, share long")
    numbered = own.withColumn("_no", F.monotonically_increasing_id()).join(F.broadcast(share), "lang")
    picked = numbered.filter(F.pmod(F.xxhash64("doc_id", "text", "_no", F.lit(SEED)), F.lit(1 << 40)) < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A few windows, evenly spread, of each picked document."""
        for b in batches:
            langs, codes = [], []
            for text, lang in zip(b.column(0), b.column(1)):
                t = text.as_py().encode("utf-8", "surrogatepass")
                for at in sorted({int(x) for x in np.linspace(0, max(0, len(t) - STEPS), WINDOWS)}):
                    langs.append(lang.as_py())
                    codes.append(t[at : at + STEPS])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(codes, pa.binary())], ["lang", "window"])

    # about WINDOWS x max_rows rows of STEPS bytes
    rows = picked.select("text", "lang").mapInArrow(run, "lang string, window binary").toPandas().sort_values(["lang", "window"])
    if not len(rows):
        return nothing
    ws = [bytes(w) for w in rows["window"]]
    mask = np.arange(STEPS)[:, None] < np.array([len(w) for w in ws])[None, :]
    return learn(coded(ws, STEPS), mask, np.searchsorted(np.array(labels), rows["lang"].to_numpy().astype(str)), labels)


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred and score (pooled probability of that label) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lettered = b.column(2).to_pylist()
            names, scores = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
            if net.labels:
                texts = (t.as_py().encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(b.column(1), lettered))
                found = document_probabilities(net, texts, b.num_rows)
                best = found.argmax(axis=1)
                names = [net.labels[i] if ok else UNKNOWN for i, ok in zip(best, lettered)]
                scores = [float(min(1.0, found[k, i])) if ok else 0.0 for k, (i, ok) in enumerate(zip(best, lettered))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    lettered = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    return docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")

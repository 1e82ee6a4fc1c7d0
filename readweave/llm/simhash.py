"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, exact Hamming checks, components.

Fingerprints that differ in at most ``max_bits`` = d bits are split in d + 2 pieces; such a pair differs in at most d
of them, so it agrees in two pieces at least. Every pair of pieces is a block key: fingerprints that share a key meet,
and their Hamming distance is verified. Equal fingerprints are one class and are compared once.

Defined results: null and empty texts and texts of white space have fingerprint zero and link like any other;
identical rows share a class; a null doc_id takes part, but names a component only if the component has no other; doc_id
may be of any type; a text of any length is read whole; `deduplicate` keeps one row of each component, that of the smallest
doc_id (null last) and, where several texts have that id, of the smallest hash of the text, with all its columns; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, components
from .store import cut

SHINGLE = 4
MAX_BITS = 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is set if it is set in more than half of the hashes of the shingles."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, and ASCII white space
    if not ws:
        return 0
    n = max(1, len(ws) - shingle + 1)
    # words are joined once; a shingle is a slice of the joined bytes
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]).tolist()
    starts = [0, *ends]
    view = memoryview(joined)
    one = xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        hashes = [one(joined, 42)]
    else:
        hashes = [one(view[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :])]
    total = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = np.array(hashes[k : k + (1 << 16)], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (long, the 64 bits of the fingerprint) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], ["doc_id", "text_key", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def _pieces(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of max_bits + 2 pieces of 64 bits."""
    edges = np.linspace(0, 64, max_bits + 3).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (src > dst, both fp) that connect all fingerprints within ``max_bits``, from distinct values in column fp."""
    parts = [F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1) for s, w in _pieces(max_bits)]
    width = max(w for _, w in _pieces(max_bits))
    keys = [F.shiftleft(F.lit(k).cast("long"), 2 * width) + F.shiftleft(parts[i], width) + parts[j] for k, (i, j) in enumerate(combinations(range(len(parts)), 2))]
    keyed = prints.select(F.explode(F.array(*keys)).alias("block"), F.col("fp").alias("id"))

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= max_bits

    return blocks.spanning_links(keyed, near)


def roots_of_prints(prints: DataFrame, max_bits: int) -> DataFrame:
    """fp and root (a fingerprint of the component) for every distinct fingerprint."""
    values = cut(prints.select("fp").distinct())
    roots = components.connected(links(values, max_bits))
    return values.join(roots, values["fp"] == roots["id"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id that links reach) for every row."""
    prints = cut(fingerprints(docs, shingle))
    return components.named(prints, roots_of_prints(prints, max_bits), "fp").select("doc_id", "fp", F.col("least.id").alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component stays."""
    prints = cut(fingerprints(docs, shingle))
    return components.kept(docs, components.named(prints, roots_of_prints(prints, max_bits), "fp"))

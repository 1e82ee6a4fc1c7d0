"""Pairs inside blocks: rows that share a block key are compared in vectorised cells of bounded size.

A block of more than ``cell`` rows is cut in chunks by a hash of the row's id, and each pair of chunks is a cell of its
own, so a block that holds a third of all rows is spread over many tasks. Within a cell only a spanning forest of the
links is emitted (at most one row for each member), or all links of a cell of a few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = 2048
#: Small cells are compared together, up to so many pairs at once.
PAIRS = 1 << 22
#: Cells of so many rows at most are small: each gives all its links.
STACKED = 32

Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def dealt(keyed: DataFrame, cell: int = CELL) -> DataFrame:
    """Rows of blocks with two members at least, dealt to cells (block, a, b) with the chunk each row is of."""
    sizes = keyed.groupBy("block").agg(F.count("*").alias("members")).filter("members > 1")
    sized = keyed.join(sizes, "block")
    chunks = F.ceil(F.col("members") / cell).cast("int")
    sized = sized.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    spread = sized.withColumn("other", F.explode(others))
    return spread.withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other")).drop("members", "chunks", "other")


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Bounds of the runs of equal keys in sorted columns."""
    n = len(keys[0])
    if not n:
        return np.array([0])
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]])


def sorted_cells(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of whole cells from batches sorted by ``keys``; only the last, unfinished cell is carried over."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = runs([t[k].to_numpy() for k in keys])[-2]
        if last:
            yield t.slice(0, last)
        held = t.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links i - j, as links to the least member."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for x, y in zip(i.tolist(), j.tolist()):
        a, b = find(x), find(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(parent) if find(x) != x]


def spanning_links(keyed: DataFrame, near: Near, cell: int = CELL) -> DataFrame:
    """Links (src, dst) that connect all pairs of a block for which ``near`` holds.

    keyed: block long, id long, ids distinct within a block. near: bools from two arrays of ids that broadcast.
    """
    spread = dealt(keyed, cell).select("block", "a", "b", "chunk", "id")
    ordered = spread.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_cells(batches, ("block", "a", "b")):
            keys = [t[k].to_numpy() for k in ("block", "a", "b")]
            bounds, ids, chunk = runs(keys), t["id"].to_numpy(), t["chunk"].to_numpy()
            sizes = np.diff(bounds)
            src, dst = [ids[:0]], [ids[:0]]
            # small cells of one size are compared together
            for size in np.unique(sizes[(sizes > 1) & (sizes <= STACKED)]).tolist():
                at = bounds[:-1][sizes == size]
                x, y = np.triu_indices(size, 1)
                step = max(1, PAIRS // len(x))
                for k in range(0, len(at), step):
                    left, right = (at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel()
                    ok = near(ids[left], ids[right]) & ((keys[1][left] == keys[2][left]) | (chunk[left] != chunk[right]))
                    src.append(ids[left][ok])
                    dst.append(ids[right][ok])
            for k in np.flatnonzero(sizes > STACKED).tolist():
                own, side, a, b = ids[bounds[k] : bounds[k + 1]], chunk[bounds[k] : bounds[k + 1]], keys[1][bounds[k]], keys[2][bounds[k]]
                left, right = (own, own) if a == b else (own[side == a], own[side == b])
                i, j = np.nonzero(near(left[:, None], right[None, :]))
                pairs = np.array(forest(left[i], right[j]), np.int64).reshape(-1, 2)
                src.append(pairs[:, 0])
                dst.append(pairs[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return ordered.mapInArrow(run, "src long, dst long").filter("src <> dst")

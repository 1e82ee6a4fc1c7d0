"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one class and are hashed once. Each table gives a class a code of ``bits`` signs; classes with the same
code of a table are a block. Only ids and signs travel to the blocks, in cells of bounded size (a large block is spread over
many); pairs that differ in too many signs for the threshold go. A cell with few pairs left gives those, and their vectors
are joined once; to a cell with more pairs than members the vectors travel, and what leaves it is a sum of links for each
member and a spanning forest, never the pairs. Cosines are in double precision. A pair that meets in several tables counts in
the first of them.

The number of tables is what a pair at the very threshold needs to meet with probability ``recall``; closer pairs meet
more surely. There is no cap on blocks or partners.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are their
own components; vectors of different lengths never link; identical rows link with one another; a null vec_id takes part
but names no component; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, components
from .store import cut

THRESHOLD = 0.9
RECALL = 0.97
BITS = 12
#: Blocks of random vectors hold about so many once there are more than 2^BITS times as many.
BLOCK = 64
SEED = 5
#: Signs that candidates are checked by before vectors are read, and deviations above the mean at the threshold that pass.
CHECKS, DEVIATIONS = 256, 4
CODES = ("c1", "c2", "c3", "c4")


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits and tables for n vectors."""
    bits = max(BITS, math.ceil(math.log2(max(2, n / BLOCK))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _units(lists: pa.Array) -> np.ndarray:
    """Vectors of one length at length one."""
    x = np.array(lists.to_pylist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """id, the block of each table, and signs of up to 256 planes in c1 to c4, for each class (id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                lengths = np.array([len(v) for v in b.column(1)])
                for d in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == d)
                    if d not in planes:
                        planes[d] = np.random.default_rng([SEED, d]).normal(size=(d, bits * tables))
                    signs = (_units(b.column(1).take(pa.array(own))) @ planes[d]) > 0
                    codes = (signs.reshape(len(own), tables, bits) * (1 << np.arange(bits))).sum(axis=2)
                    # the block's key holds length, table and code
                    key = ((d * tables + np.arange(tables))[None, :] << bits) + codes
                    check = np.zeros((len(own), CHECKS), bool)
                    check[:, : signs.shape[1]] = signs[:, :CHECKS]
                    c = np.packbits(check, axis=1).view(np.int64)
                    at = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, tables, dtype=np.int32)), pa.array(key.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), at, *[pa.array(np.ascontiguousarray(c[:, k])) for k in range(4)]], ["id", "blocks", *CODES])

    return classes.select("id", "vector").mapInArrow(run, "id long, blocks array<long>, c1 long, c2 long, c3 long, c4 long")


def _sides(own: np.ndarray, side: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    return (own, own) if a == b else (own[side[own] == a], own[side[own] == b])


def candidates(codes: DataFrame, most: int, cell: int = blocks.CELL) -> DataFrame:
    """Pairs (src, dst, block) of a cell that differ in at most ``most`` of the checked signs; of a dense cell only its key (src null, dst null, block, a, b)."""
    spread = blocks.dealt(codes.select(F.explode("blocks").alias("block"), "id", *CODES), cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks.sorted_cells(batches, ("block", "a", "b"), 1 << 16):
            keys = [t[k].to_numpy() for k in ("block", "a", "b")]
            ids, side = t["id"].to_numpy(), t["chunk"].to_numpy()
            c = np.stack([t[k].to_numpy() for k in CODES], axis=1).view(np.uint64)
            src, dst, at, dense = [], [], [], []
            bounds = blocks.runs(keys)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                left, right = _sides(np.arange(lo, hi), side, keys[1][lo], keys[2][lo])
                seen, parts, step = 0, [], max(1, (blocks.PAIRS >> 5) // max(1, len(right)))
                for r in range(0, len(left), step):
                    x = left[r : r + step]
                    i, j = np.nonzero(np.bitwise_count(c[x][:, None] ^ c[right][None, :]).sum(axis=2, dtype=np.int32) <= most)
                    i, j = x[i], right[j]
                    if keys[1][lo] == keys[2][lo]:
                        i, j = i[i < j], j[i < j]
                    parts.append((i, j))
                    seen += len(i)
                    if seen > hi - lo:
                        break
                if seen > hi - lo:
                    dense.append(lo)
                else:
                    for i, j in parts:
                        src.append(np.maximum(ids[i], ids[j]))
                        dst.append(np.minimum(ids[i], ids[j]))
                        at.append(keys[0][i])
            pairs = [pa.array(np.concatenate([*x, ids[:0]])) for x in (src, dst, at)]
            none = pa.nulls(len(pairs[0]), pa.int32())
            yield pa.RecordBatch.from_arrays([*pairs, none, none], ["src", "dst", "block", "a", "b"])
            none = pa.nulls(len(dense), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(keys[0][dense]), *[pa.array(k[dense].astype(np.int32)) for k in keys[1:]]], ["src", "dst", "block", "a", "b"])

    ordered = spread.select("block", "a", "b", "chunk", "id", *CODES).repartition("block", "a", "b").sortWithinPartitions("block", "a", "b")
    return ordered.mapInArrow(run, "src long, dst long, block long, a int, b int")


def linked_pairs(pairs: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """Links of pairs of sparse cells, as `linked_within` gives them; a pair that met before in a dense cell counts there."""
    least = pairs.groupBy("src", "dst").agg(F.min("block").alias("block"))  # blocks of a pair are ordered by table
    ends = [full.select(F.col("id").alias(k), F.col("n").alias(f"{k}_n"), F.col("vector").alias(f"{k}_v"), F.col("blocks").alias(f"{k}_b")) for k in ("src", "dst")]
    met = least.join(ends[0], "src").join(ends[1], "dst")
    first = F.element_at(F.filter(F.arrays_zip("src_b", "dst_b"), lambda x: x["src_b"] == x["dst_b"]), 1)["src_b"]
    met = met.filter(first == F.col("block")).select("src", "dst", "src_n", "dst_n", "src_v", "dst_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [bool((_units(b.column(4).slice(k, 1)) @ _units(b.column(5).slice(k, 1)).T)[0, 0] >= threshold) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(near, pa.bool_())) for k in range(4)], ["src", "dst", "src_n", "dst_n"])

    found = met.mapInArrow(run, "src long, dst long, src_n long, dst_n long")
    none = F.lit(None).cast("long")
    rows = [F.struct(F.col(u).alias("src"), v.alias("dst"), n.alias("links")) for u, v, n in (("src", none, F.col("dst_n")), ("dst", none, F.col("src_n")), ("src", F.col("dst"), F.lit(0).cast("long")))]
    return found.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def linked_within(dense: DataFrame, full: DataFrame, threshold: float, cell: int = blocks.CELL) -> DataFrame:
    """Links of dense cells. Rows (src, dst, links): with a dst, an edge of a spanning forest; without, links of src to be summed."""
    spread = blocks.dealt(full.select(F.explode("blocks").alias("block"), "id"), cell).join(dense, ["block", "a", "b"], "left_semi")
    ordered = spread.join(full, "id").select("block", "a", "b", "chunk", "id", "n", "blocks", "vector").repartition("block", "a", "b").sortWithinPartitions("block", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks.sorted_cells(batches, ("block", "a", "b"), 1 << 12):
            keys = [t[k].to_numpy() for k in ("block", "a", "b")]
            ids, n, side = (t[k].to_numpy() for k in ("id", "n", "chunk"))
            vectors, at = t["vector"].combine_chunks(), t["blocks"].combine_chunks()
            at = at.flatten().to_numpy().reshape(t.num_rows, -1)
            src, dst, links = [], [], []
            bounds = blocks.runs(keys)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                left, right = _sides(np.arange(lo, hi), side, keys[1][lo], keys[2][lo])
                x = _units(vectors.slice(lo, hi - lo))
                i, j = np.nonzero(x[left - lo] @ x[right - lo].T >= threshold)
                i, j = left[i], right[j]
                if keys[1][lo] == keys[2][lo]:
                    i, j = i[i < j], j[i < j]
                before = int(np.flatnonzero(at[lo] == keys[0][lo])[0])
                if before and len(i):  # met before, in an earlier table?
                    new = np.concatenate([~(at[i[k : k + 65536], :before] == at[j[k : k + 65536], :before]).any(axis=1) for k in range(0, len(i), 65536)])
                    i, j = i[new], j[new]
                if not len(i):
                    continue
                total = np.bincount(i - lo, n[j], hi - lo) + np.bincount(j - lo, n[i], hi - lo)
                for k in np.flatnonzero(total).tolist():
                    src.append(int(ids[lo + k]))
                    dst.append(None)
                    links.append(int(total[k]))
                for u, v in blocks.forest(ids[i], ids[j]):
                    src.append(u)
                    dst.append(v)
                    links.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(links, pa.int64())], ["src", "dst", "links"])

    return ordered.mapInArrow(run, "src long, dst long, links long")


def linked(classes: DataFrame, bits: int, tables: int, threshold: float, cell: int = blocks.CELL) -> DataFrame:
    """Links of all classes (id, n, vector): pairs of sparse cells meet their vectors, vectors travel to dense cells only."""
    codes = cut(hashed(classes, bits, tables))
    checked, p = min(CHECKS, bits * tables), math.acos(threshold) / math.pi
    most = math.ceil(checked * p + DEVIATIONS * math.sqrt(checked * p * (1 - p)))
    met = cut(candidates(codes, most, cell))
    full = classes.join(codes.select("id", "blocks"), "id")
    found = linked_pairs(met.filter("src IS NOT NULL"), full, threshold)
    dense = met.filter("src IS NULL").select("block", "a", "b")
    return found if dense.isEmpty() else found.unionByName(linked_within(dense, full, threshold, cell))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding)."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    key = F.when(usable, F.xxhash64(F.transform(v, lambda x: x.cast("double") + F.lit(0.0)), F.size(v)))
    own = vectors.select("vec_id", v.cast("array<double>").alias("vector"), key.alias("id"))
    classes = own.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.first("vector").alias("vector"))
    classes = cut(classes)
    bits, tables = shape(classes.count(), threshold, recall)
    found = cut(linked(classes.select("id", "n", "vector"), bits, tables, threshold))
    links = found.filter("dst IS NULL").groupBy("src").agg(F.sum("links").alias("links"))
    roots = components.connected(found.filter("dst IS NOT NULL"))
    named = classes.select("id", "n", "first_id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "root").join(links.withColumnRenamed("src", "id"), "id", "left")
    named = cut(named.select("id", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = own.select("vec_id", "id").join(named, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

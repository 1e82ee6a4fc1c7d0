"""A multiway hyperplane tree in the manner of GNAT, for windows of inner products.

A node has split points; each row belongs to the split point nearest to it. For each split point the node stores the least
and greatest distance to the rows of every sibling's subtree. All rows with an inner product in [lo, hi] with a query lie in
an annulus about it, so a subtree is eliminated if, for any split point, its stored range misses the distances which that
annulus allows. What isn't eliminated is searched down to exact leaves, where inner products are integers.

Inner products become distances by one coordinate more, which brings every row to the length of the longest one.

The top node is fitted on a bounded sample and known to all workers; its cells are cut into leaf blocks of bounded size, and
each block carries a tree of its own, built where it is searched. Queries are dealt to blocks in groups of bounded size, so
neither a hot cell nor a hot query is one task's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import sorted_cells, runs
from .store import cut

#: Rows of a leaf block, and queries that meet it at once.
BLOCK, QUERIES = 2048, 1024
#: Rows that the top node is fitted on, and its split points, at most.
SAMPLE, POINTS = 4096, 256
#: Split points of a block's nodes, and rows of an exact leaf.
FAN, LEAF = 8, 256
#: Rounding of distances, as a share of the longest row.
SLACK = 1e-5


def farthest(rows: np.ndarray, m: int) -> np.ndarray:
    """Up to m of the rows, each as far as can be from those before; fewer where rows repeat."""
    chosen = [0]
    gap = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < m and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def lifted(rows: np.ndarray, radius: float) -> np.ndarray:
    """Rows with one coordinate more, all of length ``radius``."""
    x = rows.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, radius * radius - (x * x).sum(axis=1)))])


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all points."""
    squares = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(0.0, squares))


def asked(queries: np.ndarray) -> np.ndarray:
    """Queries as points: the coordinate more is 0, so that inner products stay."""
    return np.column_stack([queries.astype(np.float64), np.zeros(len(queries))])


def annuli(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance (queries x windows) of rows with an inner product in [lo, hi]; an empty window gives an empty annulus."""
    own = (queries.astype(np.float64) ** 2).sum(axis=1)[:, None]
    squares = own + radius * radius
    near, far = squares - 2 * hi.astype(np.float64), squares - 2 * lo.astype(np.float64)
    slack = SLACK * (radius + 1)
    r1, r2 = np.sqrt(np.maximum(0.0, near)) - slack, np.sqrt(np.maximum(0.0, far)) + slack
    none = (lo > hi) | (far < -slack * slack)
    return np.where(none, np.inf, r1), np.where(none, -np.inf, r2)


def open_cells(delta: np.ndarray, r1: np.ndarray, r2: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Cells (queries x windows x cells) that no split point eliminates. delta: queries x points; least, most: points x cells."""
    first, last = np.maximum(r1[:, :, None] - delta[:, None, :], delta[:, None, :] - r2[:, :, None]), r2[:, :, None] + delta[:, None, :]
    out = np.ones((*r1.shape, least.shape[1]), bool)
    for i in range(least.shape[0]):
        out &= (first[:, :, i, None] <= most[i]) & (last[:, :, i, None] >= least[i])
    return out & (r1 <= r2)[:, :, None]


@dataclass
class Node:
    rows: np.ndarray
    points: np.ndarray | None = None
    least: np.ndarray | None = None
    most: np.ndarray | None = None
    under: list[Node] | None = None


def grown(x: np.ndarray, rows: np.ndarray, slack: float) -> Node:
    """The tree of the given rows of x; rows that can't be told apart are one leaf."""
    if len(rows) <= LEAF:
        return Node(rows)
    tried = rows[:: max(1, len(rows) // (3 * FAN))]
    points = x[tried[farthest(x[tried], FAN)]]
    d = distances(x[rows], points)
    cell = d.argmin(axis=1)
    kinds = np.unique(cell)
    if len(kinds) < 2:
        return Node(rows)
    parts = [cell == k for k in kinds]
    least = np.array([d[p].min(axis=0) for p in parts]).T - slack
    most = np.array([d[p].max(axis=0) for p in parts]).T + slack
    return Node(rows, points, least, most, [grown(x, rows[p], slack) for p in parts])


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; lengths multiply to less than 2^62."""
    reach = math.sqrt(float((queries.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) * float((rows.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    if reach < 2.0**52:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


class Block:
    """A leaf block: rows in the order that settles ties, searched for the k highest inner products within windows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, radius: float):
        self.rows, self.ids, self.labels, self.radius = rows, ids, labels, radius
        self.tree = grown(lifted(rows, radius), np.arange(len(rows)), SLACK * (radius + 1))

    def search(self, queries: np.ndarray, ids: np.ndarray, labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and rows (queries x windows x k; row -1: none) of the same or of another label; a query doesn't meet itself."""
        n, w = lo.shape
        self.scores, self.found = np.full((n, w, k), np.iinfo(np.int64).min), np.full((n, w, k), -1)
        self.queries, self.own, self.labelled, self.lo, self.hi, self.k, self.same = queries, ids, labels, lo.copy(), hi, k, same
        self.at = asked(queries)
        self._visit(self.tree, np.arange(n))
        return self.scores, self.found

    def _visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.under is None:
            for part in (node.rows[i : i + LEAF] for i in range(0, len(node.rows), LEAF)):
                self._leaf(part, who)
            return
        delta = distances(self.at[who], node.points)
        r1, r2 = annuli(self.queries[who], self.lo[who], self.hi[who], self.radius)
        opened = open_cells(delta, r1, r2, node.least, node.most).any(axis=1)
        for j in np.argsort(-opened.sum(axis=0), kind="stable"):
            self._visit(node.under[j], who[opened[:, j]])

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        scores = products(self.queries[who], self.rows[rows])
        fits = ((self.labelled[who][:, None] == self.labels[rows][None, :]) == self.same) & (self.own[who][:, None] != self.ids[rows][None, :])
        for w in range(self.lo.shape[1]):
            ok = fits & (scores >= self.lo[who, w][:, None]) & (scores <= self.hi[who, w][:, None])
            hit = np.flatnonzero(ok.any(axis=1))
            if not len(hit):
                continue
            own = who[hit]
            s = np.concatenate([self.scores[own, w], np.where(ok[hit], scores[hit], np.iinfo(np.int64).min)], axis=1)
            r = np.concatenate([self.found[own, w], np.where(ok[hit], rows[None, :], -1)], axis=1)
            order = np.lexsort((r, -np.maximum(s, np.iinfo(np.int64).min + 1)), axis=1)[:, : self.k]
            self.scores[own, w] = np.take_along_axis(s, order, axis=1)
            self.found[own, w] = np.take_along_axis(r, order, axis=1)
            full = self.found[own, w, -1] >= 0
            # from k hits on only as good ones count; at the same score a smaller id may still come
            self.lo[own[full], w] = self.scores[own[full], w, -1]


@dataclass
class Top:
    """The top node: split points by length of the vectors, and ranges between all points and cells."""

    radius: float
    points: dict[int, tuple[np.ndarray, np.ndarray]]  # length: numbers of the points, points
    least: np.ndarray
    most: np.ndarray


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), size)


def fitted(rows: DataFrame) -> Top:
    """Split points from a bounded sample of ``rows`` (rid, v), spread over the lengths as the sample is."""
    n, radius = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()
    if not n:
        return Top(0.0, {}, np.zeros((0, 0)), np.zeros((0, 0)))
    drawn = rows.filter(F.pmod(F.xxhash64(F.col("rid")), F.lit(1 << 30)) < F.lit(math.ceil((1 << 30) * min(1.0, 2 * SAMPLE / n)))).select("v").limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for (v,) in drawn:
        by_size.setdefault(len(v), []).append(v)
    cells = min(POINTS, math.ceil(2 * n / BLOCK))
    points, number = {}, 0
    for size, own in sorted(by_size.items(), key=lambda x: (-len(x[1]), x[0])):
        m = min(round(cells * len(own) / len(drawn)), POINTS - number)
        if m < 1:
            continue  # rare lengths are a cell each
        x = lifted(np.array(own, np.int64).reshape(len(own), size), radius)
        chosen = x[farthest(x[: max(1, 3 * m)], m)]
        points[size] = (np.arange(number, number + len(chosen)), chosen)
        number += len(chosen)
    return Top(radius, points, np.full((number, number), np.inf), np.full((number, number), -np.inf))


def placed(rows: DataFrame, top: Top) -> DataFrame:
    """``rows`` (rid, vec_id, label, v) with their cell; vectors of a length without split points are a cell of their own."""
    known = rows.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array(b.column(3).value_lengths().to_numpy(), np.int64)
            cell = -1 - sizes
            for size in np.unique(sizes).tolist():
                if size in known.value.points:
                    own = np.flatnonzero(sizes == size)
                    numbers, points = known.value.points[size]
                    cell[own] = numbers[distances(lifted(_matrix(b.column(3).take(pa.array(own)), size), known.value.radius), points).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    return rows.mapInArrow(run, "rid long, vec_id long, label long, v array<int>, cell long")


def ranged(rows: DataFrame, top: Top) -> Top:
    """The top node with its ranges: for each point and cell the least and greatest distance, over all rows."""
    if not top.points:
        return top
    known = rows.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            cells = b.column(1).to_numpy()
            for size, (numbers, points) in known.value.points.items():
                own = np.flatnonzero(np.isin(cells, numbers))
                if not len(own):
                    continue
                d = distances(lifted(_matrix(b.column(0).take(pa.array(own)), size), known.value.radius), points)
                for c in np.unique(cells[own]).tolist():
                    part = d[cells[own] == c]
                    a, z = held.get(c, (np.inf, -np.inf))
                    held[c] = np.minimum(a, part.min(axis=0)), np.maximum(z, part.max(axis=0))
        keys = list(held)
        first = {c: int(numbers[0]) for numbers, _ in known.value.points.values() for c in numbers.tolist()}
        out = [(first[c] + i, c, float(held[c][0][i]), float(held[c][1][i])) for c in keys for i in range(len(held[c][0]))]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["point", "cell", "least", "most"])

    parts = rows.filter("cell >= 0").select("v", "cell").mapInArrow(run, "point long, cell long, least double, most double")
    slack = SLACK * (top.radius + 1)
    for point, cell, least, most in parts.groupBy("point", "cell").agg(F.min("least"), F.max("most")).collect():  # POINTS^2 rows at most
        top.least[point, cell], top.most[point, cell] = least - slack, most + slack
    return top


def _windows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and bounds of each query's windows, as arrays of one width; empty windows fill up."""
    lengths = lists.value_lengths().to_numpy()
    width = int(lengths.max(initial=1))
    place = np.repeat(np.arange(len(lists)), lengths), np.concatenate([np.arange(x) for x in lengths] or [np.zeros(0, int)])
    flat = lists.flatten()
    out = []
    for name, empty in (("w", -1), ("lo", 1), ("hi", 0)):
        a = np.full((len(lists), max(1, width)), empty, np.int64)
        a[place] = flat.field(name).to_numpy()
        out.append(a)
    return tuple(out)


WINDOWS = "array<struct<w:int,lo:long,hi:long>>"


def routed(queries: DataFrame, top: Top) -> DataFrame:
    """``queries`` (rid, label, v, cell, chunk, windows) with each ``to``, a cell that their windows may have rows in."""
    known = queries.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                sizes = np.array(b.column(2).value_lengths().to_numpy(), np.int64)
                who, to = [np.arange(len(sizes))], [-1 - sizes]  # vectors of its length without split points; none where there are some
                for size, (numbers, points) in known.value.points.items():
                    own = np.flatnonzero(sizes == size)
                    if not len(own):
                        continue
                    part = b.take(pa.array(own))
                    q = _matrix(part.column(2), size)
                    _, lo, hi = _windows(part.column(5))
                    r1, r2 = annuli(q, lo, hi, known.value.radius)
                    opened = open_cells(distances(asked(q), points), r1, r2, known.value.least[np.ix_(numbers, numbers)], known.value.most[np.ix_(numbers, numbers)]).any(axis=1)
                    i, j = np.nonzero(opened)
                    who.append(own[i])
                    to.append(numbers[j])
                who, to = np.concatenate(who), np.concatenate(to)
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(who)).columns, pa.array(to)], [*b.schema.names, "to"])

    return queries.mapInArrow(run, f"rid long, label long, v array<int>, cell long, chunk int, windows {WINDOWS}, to long")


def searched(leaves: DataFrame, queries: DataFrame, radius: float, k: int, same: bool) -> DataFrame:
    """For each query (rid, label, v, windows; cell and chunk: the block it is sent to) the k best rows of that block in each
    window: rid, w, score, vec_id."""
    counts = queries.groupBy("cell", "chunk").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    groups = F.col("groups")
    asks = queries.join(counts, ["cell", "chunk"]).select("cell", "chunk", F.pmod(F.xxhash64("rid"), groups).cast("int").alias("part"), F.lit(1).alias("asks"), "rid", F.lit(None).cast("long").alias("vec_id"), "label", "v", "windows")
    told = leaves.join(counts, ["cell", "chunk"]).select("cell", "chunk", F.explode(F.sequence(F.lit(0), groups - 1)).alias("part"), F.lit(0).alias("asks"), "rid", "vec_id", "label", "v", F.array().cast(WINDOWS).alias("windows"))
    keys = ["cell", "chunk", "part"]
    both = told.unionByName(asks).repartition(*keys).sortWithinPartitions(*keys, "asks", F.col("vec_id").asc_nulls_last(), "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_cells(batches, tuple(keys), 1 << 14):
            bounds = runs([t[c].to_numpy() for c in keys])
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = t.slice(first, last - first).combine_chunks()
                n = int((own["asks"].to_numpy() == 0).sum())
                if not 0 < n < own.num_rows:
                    continue
                size = len(own["v"][0])
                v, rid, label = _matrix(own["v"].combine_chunks(), size), own["rid"].to_numpy(), own["label"].to_numpy()
                number, lo, hi = _windows(own["windows"].combine_chunks().slice(n))
                scores, found = Block(v[:n], rid[:n], label[:n], radius).search(v[n:], rid[n:], label[n:], lo, hi, k, same)
                q, w, at = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[n:][q]), pa.array(number[q, w].astype(np.int32)), pa.array(scores[q, w, at]), own["vec_id"].combine_chunks().take(pa.array(found[q, w, at]))],
                    ["rid", "w", "score", "vec_id"],
                )

    return both.mapInArrow(run, "rid long, w int, score long, vec_id long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query and window, with their rank: by score, then by vec_id, null last."""
    order = Window.partitionBy("rid", "w").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Index:
    """All rows (rid, vec_id, label, v) in leaf blocks under the top node. v: integers whose squares sum to less than 2^62."""

    def __init__(self, rows: DataFrame):
        self.top = fitted(rows)
        own = cut(placed(rows, self.top))
        self.top = ranged(own, self.top)
        sizes = own.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
        self.sizes = cut(sizes)
        self.leaves = cut(own.join(self.sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int")).drop("chunks"))

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """rid, w, score, vec_id and rank of the k best rows in each window of each query (rid, label, v, cell, chunk, windows),
        queries being rows of the index.

        A query meets its own block first; the k-th best there narrows its windows before other cells are chosen.
        """
        home = cut(searched(self.leaves, queries, self.top.radius, k, same))
        kth = home.groupBy("rid", "w").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
        bound = kth.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("least"))
        raised = F.transform("windows", lambda x: F.struct(x["w"].alias("w"), F.greatest(x["lo"], F.element_at("least", x["w"])).alias("lo"), x["hi"].alias("hi")))
        narrowed = queries.join(bound, "rid", "left").select("rid", "label", "v", "cell", "chunk", F.coalesce(raised, F.col("windows")).alias("windows"))
        away = routed(narrowed, self.top).join(self.sizes.withColumnRenamed("cell", "to"), "to")
        away = away.withColumn("next", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter((F.col("to") != F.col("cell")) | (F.col("next") != F.col("chunk")))
        away = cut(away.select("rid", "label", "v", F.col("to").alias("cell"), F.col("next").alias("chunk"), "windows"))
        return best(home.unionByName(searched(self.leaves, away, self.top.radius, k, same)), k)

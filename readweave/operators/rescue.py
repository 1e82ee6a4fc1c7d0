"""Missed read ends: local alignment of a read's clipped bases to the first or last bases of its chromosome.

Only candidates are aligned (clips of a bounded length beside an alignment that stops away from the end), many at once: the
table of a batch of pairs is filled row by row for all pairs together, and traced back for all together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .leftovers import clips


@dataclass(frozen=True)
class Scores:
    """Of a match, a mismatch, and of a gap's first and further bases."""

    match: int = 10
    mismatch: int = -8
    first: int = 20
    further: int = 1


#: Cells of the tables that are filled together; their rows stay near the processor.
CELLS = 1 << 22
#: Fields of an alignment: score, first base in either sequence (from 0), bases of either, columns, equal columns.
FIELDS = ("score", "a_start", "b_start", "a_bases", "b_bases", "columns", "same")
ALIGNMENT = "struct<" + ",".join(f"{f}:int" for f in FIELDS) + ">"


def _matrix(texts: list[str], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), fill, np.uint32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out


def local_alignments(a: list[str], b: list[str], scores: Scores = Scores()) -> np.ndarray:
    """The best local alignment with affine gaps of each pair: a row of FIELDS.

    Of equally good ones the one that ends first in a, then in b; on the way back equal or unequal bases come before gaps in
    b, and those before gaps in a. A pair without an equal base has a row of zeros.
    """
    x, y = _matrix(a, 0), _matrix(b, 1)
    p, n, m = len(a), x.shape[1], y.shape[1]
    # small numbers where the scores fit; the way back is read from the tables, at the few cells that it passes
    bound = max(map(abs, (scores.match, scores.mismatch))) * (min(n, m) + 1) + scores.further * (n + m + 1) + scores.first
    kind = np.int16 if bound < np.iinfo(np.int16).max // 2 else np.int32
    match, mismatch, first, further = (kind(v) for v in (scores.match, scores.mismatch, scores.first, scores.further))
    worst, at = kind(np.iinfo(kind).min // 2), np.arange(m + 1, dtype=kind) * further
    if max(x.max(), y.max()) < 256:
        x, y = x.astype(np.uint8), y.astype(np.uint8)
    full, down, right = (np.zeros((n + 1, p, m + 1), kind) for _ in range(3))
    down[0], right[:, :, 0] = worst, worst
    best, end_a, end_b = np.zeros(p, kind), np.zeros(p, np.int64), np.zeros(p, np.int64)
    rows = np.arange(p)
    for i in range(1, n + 1):
        before, here = full[i - 1], full[i]
        np.maximum(before - first, down[i - 1] - further, out=down[i])
        np.add(before[:, :-1], np.where(x[:, i - 1, None] == y, match, mismatch), out=here[:, 1:])
        np.maximum(here, down[i], out=here)
        np.maximum(here, 0, out=here)
        here[:, 0] = 0
        # gaps along the row: the best place to the left to open one
        np.subtract(np.maximum.accumulate(here[:, :-1] + at[:-1], axis=1), at[1:] + (first - further), out=right[i, :, 1:])
        np.maximum(here, right[i], out=here)
        j = here.argmax(axis=1)
        top = here[rows, j]
        better = top > best
        best, end_a, end_b = np.where(better, top, best), np.where(better, i, end_a), np.where(better, j, end_b)
    i, j, state = end_a.copy(), end_b.copy(), np.zeros(p, np.int64)
    columns, same, who = np.zeros(p, np.int64), np.zeros(p, np.int64), np.flatnonzero(best > 0)
    while len(who):
        who = who[(state[who] > 0) | (full[i[who], who, j[who]] > 0)]
        u, v = i[who], j[who]
        value, equal = full[u, who, v], x[who, u - 1] == y[who, v - 1]
        both = value == full[u - 1, who, v - 1] + np.where(equal, match, mismatch)
        s = np.where(state[who] > 0, state[who], np.where(both, 1, np.where(down[u, who, v] == value, 2, 3)))
        goes_down = down[u - 1, who, v] - further > full[u - 1, who, v] - first
        goes_right = right[u, who, v] > full[u, who, v - 1] - first
        same[who] += (s == 1) & equal
        columns[who] += 1
        state[who] = np.where(s == 1, 0, np.where(s == 2, np.where(goes_down, 2, 0), np.where(goes_right, 3, 0)))
        i[who] -= s != 3
        j[who] -= s != 2
    return np.column_stack([best, i, j, end_a - i, end_b - j, columns, same])


def aligned(a: Column, b: Column, scores: Scores = Scores()) -> Column:
    """Struct of FIELDS of the best local alignment of two columns; null if either is null or empty."""

    @F.pandas_udf(ALIGNMENT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            rows = np.full((len(x), len(FIELDS)), -1)
            order = [k for k in np.argsort(x.str.len().fillna(0).to_numpy(), kind="stable") if x[k] and y[k]]
            while order:
                # pairs of like length together, as many as the tables have room for
                n, m, k = 0, 0, 0
                while k < len(order):
                    n, m = max(n, len(x[order[k]])), max(m, len(y[order[k]]))
                    if k and (k + 1) * (n + 1) * (m + 1) > CELLS:
                        break
                    k += 1
                part, order = order[:k], order[k:]
                rows[part] = local_alignments([x[i] for i in part], [y[i] for i in part], scores)
            out = pd.DataFrame(rows, columns=list(FIELDS)).astype("Int32")
            out[out["score"] < 0] = None
            yield out

    found = run(a, b)
    return F.when(found["score"].isNotNull(), found)


def chromosome_ends(tiles: DataFrame, length: int = 500) -> DataFrame:
    """chrom, size (without a tail of A), five and three: the first and last bases of each chromosome, from its tiles."""
    size = F.max(F.col("st") + F.length("bases") - 1)
    first = tiles.filter(F.col("st") <= length).groupBy("chrom").agg(F.substring(_put(), 1, length).alias("five"))
    wide = tiles.groupBy("chrom").agg(size.alias("size"))
    near = tiles.join(wide, "chrom").filter(F.col("st") + F.length("bases") - 1 > F.col("size") - length).groupBy("chrom", "size").agg(_put().alias("_end"))
    near = near.select("chrom", "size", F.when(F.length("_end") > length, F.substring(F.col("_end"), F.length("_end") - length + 1, F.lit(length))).otherwise(F.col("_end")).alias("three"))
    tail = F.length("three") - F.length(F.regexp_replace("three", "A+$", ""))
    return near.join(first, "chrom").select("chrom", "size", (F.col("size") - F.when(tail >= 10, tail).otherwise(0)).alias("body"), "five", "three")


def _put() -> Column:
    """Bases of the grouped tiles in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("st", "bases"))), lambda t: t["bases"]), "")


def rescue_ends(reads: DataFrame, ends: DataFrame, five: tuple[int, int] = (20, 1000), three: tuple[int, int] = (20, 1000), away: int = 100, share: float = 0.85, scores: Scores = Scores()) -> DataFrame:
    """Reads with an exon more where a clip lies at its chromosome's end: read_id, chrom, st, en, breaks, five, three.

    reads: read_id, chrom, cigar, seq, st, en, breaks. A clip longer than the first bound and shorter than the second, beside
    an alignment that begins behind ``away`` (ends before the end less ``away``, a tail of A not counted), is aligned to that
    end; with more equal bases than ``share`` of the longer of clip and alignment, and beyond the read, its stretch becomes the
    first (last) exon. The other reads stay as they are; ``five`` and ``three`` say what was rescued.
    """
    left, right = clips(F.col("cigar"))
    own = reads.join(ends, "chrom", "left").withColumn("_l", left).withColumn("_r", right)
    try5 = (F.col("_l") > five[0]) & (F.col("_l") < five[1]) & (F.col("st") > away)
    try3 = (F.col("_r") > three[0]) & (F.col("_r") < three[1]) & (F.col("en") < F.col("body") - away)
    tried = own.filter(try5 | try3).select(
        "read_id",
        F.when(try5, F.substring(F.col("seq"), F.lit(1), F.col("_l"))).alias("_a5"),
        F.when(try3, F.substring(F.col("seq"), F.length("seq") - F.col("_r") + 1, F.col("_r"))).alias("_a3"),
        F.col("five").alias("_b5"), F.col("three").alias("_b3"),
        (F.col("size") - F.length("three")).alias("_offset"), "_l", "_r", "st", "en",
    )
    met = tried.withColumn("_x5", aligned(F.col("_a5"), F.col("_b5"), scores)).withColumn("_x3", aligned(F.col("_a3"), F.col("_b3"), scores))

    def good(x: Column, clip: Column) -> Column:
        return x["same"] > share * F.greatest(clip, x["columns"])

    st5 = F.col("_x5.b_start") + 1
    en5 = st5 + F.col("_x5.b_bases")
    st3 = F.col("_offset") + F.col("_x3.b_start") + 1
    en3 = st3 + F.col("_x3.b_bases")
    found = met.select(
        "read_id",
        F.when(good(F.col("_x5"), F.col("_l")) & (en5 < F.col("st")), F.struct(st5.cast("int").alias("st"), en5.cast("int").alias("en"))).alias("_new5"),
        F.when(good(F.col("_x3"), F.col("_r")) & (en3 > F.col("en")), F.struct(st3.cast("int").alias("st"), en3.cast("int").alias("en"))).alias("_new3"),
    ).filter("_new5 IS NOT NULL OR _new3 IS NOT NULL")
    none = F.array().cast("array<int>")
    before = F.when(F.col("_new5").isNotNull(), F.array("_new5.st", "_new5.en")).otherwise(none)
    behind = F.when(F.col("_new3").isNotNull(), F.array("_new3.st", "_new3.en")).otherwise(none)
    return reads.join(found, "read_id", "left").select(
        "read_id", "chrom",
        F.coalesce("_new5.st", "st").alias("st"), F.coalesce("_new3.en", "en").alias("en"),
        F.concat(before, F.col("breaks").cast("array<int>"), behind).alias("breaks"),
        F.col("_new5").isNotNull().alias("five"), F.col("_new3").isNotNull().alias("three"),
    )

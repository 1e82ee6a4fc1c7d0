"""Break-point matrices as coordinate tables: (source, chrom, level, left, right, n). A cell belongs to one chromosome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .genome import flanked
from .intervals import containing


#: What a cell of a matrix is known by.
CELL = ("source", "chrom", "level", "left", "right")


def gaps(exon_rows: DataFrame) -> DataFrame:
    """Each gap of a read: left, right and level, 0 for the first and 1 for later ones."""
    own = W.partitionBy("read_id").orderBy("exon")
    pairs = exon_rows.withColumn("right", F.lead("st").over(own)).filter("right IS NOT NULL")
    return pairs.select("read_id", "source", "chrom", F.when(F.col("exon") == 1, 0).otherwise(1).alias("level"), F.col("en").alias("left"), "right")


def breakpoint_counts(gap_rows: DataFrame) -> DataFrame:
    return gap_rows.groupBy(*CELL).agg(F.count("*").alias("n"))


def marginals(cells: DataFrame) -> DataFrame:
    """Sums by left (right null) and by right (left null) for each source, chromosome and level, in one pass."""
    own = [F.col(c) for c in CELL[:3]]
    sets = cells.groupingSets([[*own, F.col("left")], [*own, F.col("right")]], *[F.col(c) for c in CELL])
    return sets.agg(F.sum("n").alias("n"))


def marginal_check(cells: DataFrame, stored: DataFrame) -> DataFrame:
    """Marginals that differ from the stored ones: their key, the sum of the cells and the stored one; null where either has none."""
    own, there = marginals(cells).withColumnRenamed("n", "summed"), stored.select(*CELL, F.col("n").alias("stored"))
    # one side is null by design, so keys are compared with a mark in its place
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in CELL]
    both = own.select(*key, F.col("summed"), F.lit(None).cast("long").alias("stored")).unionByName(there.select(*key, F.lit(None).cast("long").alias("summed"), F.col("stored").cast("long")))
    met = both.groupBy(*[f"_{c}" for c in CELL]).agg(F.sum("summed").alias("summed"), F.sum("stored").alias("stored")).filter(~F.col("summed").eqNullSafe(F.col("stored")))
    side = lambda c: F.when(F.col(f"_{c}") != "", F.col(f"_{c}").try_cast("int")).alias(c)
    return met.select(F.col("_source").alias("source"), F.col("_chrom").alias("chrom"), F.col("_level").cast("int").alias("level"), side("left"), side("right"), "summed", "stored")


def fusion_breakpoints(alignments: DataFrame) -> DataFrame:
    """Breaks between chromosomes: (source, chrom, other, left, right, n).

    alignments: read_id, source, chrom, fwd, st, en on the chromosome, q1, q2 on the read. A read's alignments are taken in the
    order of the read; where two that follow each other are on different chromosomes, the break goes from where the first one
    ends in the direction of the read to where the next one begins. Alignments are compared within their read only.
    """
    order = W.partitionBy("read_id").orderBy("q1", "q2", "chrom", "st", "en")
    leaves, comes = F.when(F.col("fwd"), F.col("en")).otherwise(F.col("st")), F.when(F.col("fwd"), F.col("st")).otherwise(F.col("en"))
    following = alignments.select("read_id", "source", "chrom", leaves.alias("left"), F.lead("chrom").over(order).alias("other"), F.lead(comes).over(order).alias("right"))
    return following.filter("other <> chrom").groupBy("source", "chrom", "other", "left", "right").agg(F.count("*").alias("n"))


def breakpoint_cross(cells: DataFrame, observed: bool = True) -> DataFrame:
    """Left and right break pairs of a chromosome and level, over all sources: those seen, or every left with every right."""
    if observed:
        return cells.select("chrom", "level", "left", "right").distinct()
    return cells.select("chrom", "level", "left").distinct().join(cells.select("chrom", "level", "right").distinct(), ["chrom", "level"])


def depth_at_pairs(cells: DataFrame) -> DataFrame:
    """Count of each seen pair in every source, 0 where it isn't seen."""
    sources = F.broadcast(cells.select("source").distinct())
    totals = cells.groupBy("source", "chrom", "left", "right").agg(F.sum("n").alias("n"))
    every = totals.select("chrom", "left", "right").distinct().crossJoin(sources)
    return every.join(totals, ["chrom", "left", "right", "source"], "left").fillna(0, ["n"])


def break_subset(cells: DataFrame, left: tuple[int, int], right: tuple[int, int]) -> DataFrame:
    return cells.filter(F.col("left").between(*left) & F.col("right").between(*right))


def break_binning(cells: DataFrame, first: tuple[int, int], step: tuple[int, int]) -> DataFrame:
    """Counts by cell of a grid (the first edge at or above a position) and their density."""
    i, j = (F.ceil((F.col(c) - a) / w).cast("int") for c, a, w in zip(("left", "right"), first, step))
    return cells.groupBy("source", "chrom", i.alias("i"), j.alias("j")).agg(F.sum("n").alias("n"), (F.sum("n") / (step[0] * step[1])).alias("density"))


def weighted_moments(points: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    """Weighted mean and deviation, and the heaviest position with its weight (the lowest on ties)."""
    mean = F.sum(F.col(x) * F.col(w)) / F.sum(w)
    var = F.sum(F.col(x) * F.col(x) * F.col(w)) / F.sum(w) - mean * mean
    return points.groupBy(*keys).agg(mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), F.min_by(x, F.struct((-F.col(w)).alias("m"), F.col(x))).alias("at_max"), F.max(w).alias("max"))


def top_cells(cells: DataFrame, least: int, n: int) -> DataFrame:
    return cells.filter(F.col("n") >= least).orderBy(F.desc("n"), *CELL).limit(n)


def max_cells(binned: DataFrame, keys: list[str]) -> DataFrame:
    """All cells at the maximum of their group."""
    most = binned.groupBy(*keys).agg(F.max("n").alias("_most"))
    return binned.join(most, keys).filter(F.col("n") == F.col("_most")).drop("_most")


def max_cells_flanked(cells: DataFrame, tiled: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The cells (chrom, left, right) at the maximum of their group with k bases up to and behind both ends, - outside the chromosome."""
    top = max_cells(cells, keys)
    found = flanked(top, tiled, ["left", "right"], k, k)
    cut = [F.substring(f"{c}_flank", first, k).alias(f"{c}_{name}") for c in ("left", "right") for name, first in (("up", 1), ("on", k + 1))]
    return found.select(*top.columns, *cut)


def region_summary(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Weighted moments of the starts and of the ends of breaks within named regions (chrom, region, lo, hi), by source and side.

    A region meets the positions of its own chromosome that lie in it, by buckets; positions outside all regions don't count.
    """
    sides = F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("left").alias("p")), F.struct(F.lit("end").alias("side"), F.col("right").alias("p")))).alias("x")
    points = cells.select("source", "chrom", "n", sides).groupBy("source", "chrom", "x.side", "x.p").agg(F.sum("n").alias("n"))
    held = containing(points, "p", regions.select(F.col("chrom").alias("_chrom"), "region", "lo", "hi"), "lo", "hi")
    return weighted_moments(held, ["source", "chrom", "side", "region"], "p", "n")


def merge_duplicates_sum(rows: DataFrame, key: str, sums: list[str], firsts: list[str], order: str) -> DataFrame:
    """One row for each key: sums of some columns, the others from the first row in order."""
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], *[F.min_by(c, order).alias(c) for c in firsts])


def nearest_value(points: DataFrame, pos: str, values: Column) -> DataFrame:
    """Index (from 1) of the closest entry of a short literal list, and its distance."""
    best = F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - F.col(pos)).alias("d"), (i + 1).alias("i"))))
    return points.withColumn("nearest", best["i"]).withColumn("distance", best["d"])

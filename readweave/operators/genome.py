"""A genome in tiles: rows (chrom, tile, st, bases) of a fixed number of bases, met by an equi-join on chromosome and tile.

No row holds a chromosome, and no row of reads or breaks gets one: a range of bases is put together from the pieces of the
tiles that it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 4096
#: Tiles that are broadcast.
FEW = 2048


def tiles(genome: DataFrame, size: int = TILE) -> DataFrame:
    """chrom, tile, st (1-based), bases from sequences (name, seq), each cut where it is read."""
    n = F.ceil(F.length("seq") / size).cast("int")
    cut = genome.filter(F.length("seq") > 0).select(F.col("name").alias("chrom"), "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("tile"))
    return cut.select("chrom", "tile", (F.col("tile") * size + 1).alias("st"), F.substring(F.col("seq"), F.col("tile") * size + 1, F.lit(size)).alias("bases"))


def tiles_of_bases(bases: DataFrame, size: int = TILE) -> DataFrame:
    """The same from a row for each base (chrom, pos from 1, base); every position of a tile before its last must be there."""
    at = bases.groupBy("chrom", F.floor((F.col("pos") - 1) / size).cast("int").alias("tile"))
    put = at.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("bases"))
    return put.select("chrom", "tile", (F.col("tile") * size + 1).alias("st"), "bases")


def few(tiled: DataFrame) -> DataFrame:
    """Tiles to be broadcast if there are few of them."""
    return F.broadcast(tiled) if tiled.limit(FEW + 1).count() <= FEW else tiled


def with_bases(rows: DataFrame, tiled: DataFrame, keys: Sequence[str], ranges: dict[str, tuple[Column, Column]], size: int = TILE) -> DataFrame:
    """``rows`` (chrom; unique by ``keys``, which hold chrom) with the bases of each named range (first, last; 1-based, both
    included) in a column; parts outside the chromosome are left out, a range without bases is an empty string.

    Rows are exploded by the tiles that a range touches, meet those alone and are put together by their keys; they are read once.
    """
    keys = list(dict.fromkeys(["chrom", *keys]))
    others = [c for c in rows.columns if c not in keys]

    def touched(name: str) -> Column:
        first, last = F.greatest(F.lit(1), ranges[name][0]).cast("long"), ranges[name][1].cast("long")
        tile = F.sequence(F.floor((first - 1) / size), F.floor((last - 1) / size))
        each = F.transform(tile, lambda t: F.struct(F.lit(name).alias("_name"), first.alias("_first"), last.alias("_last"), t.cast("int").alias("_at")))
        return F.when(last >= first, each).otherwise(F.array().cast("array<struct<_name:string,_first:bigint,_last:bigint,_at:int>>"))

    spread = rows.select(*keys, *others, F.explode_outer(F.concat(*[touched(name) for name in ranges])).alias("_r")).select(*keys, *others, "_r.*")
    lo = F.greatest(F.lit(1).cast("long"), F.col("_first") - F.col("_st") + 1).cast("int")
    hi = F.least(F.length("_bases").cast("long"), F.col("_last") - F.col("_st") + 1).cast("int")
    own = few(tiled.select(F.col("chrom").alias("_chrom"), F.col("tile").alias("_tile"), F.col("st").alias("_st"), F.col("bases").alias("_bases")))
    met = spread.join(own, (F.col("chrom") == F.col("_chrom")) & (F.col("_at") == F.col("_tile")), "left")
    pieces = met.select(*keys, *others, "_name", "_at", F.when(hi >= lo, F.substring(F.col("_bases"), lo, hi - lo + 1)).alias("_piece"))
    put = pieces.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in others],
        *[
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_name") == name, F.struct("_at", "_piece")))), lambda x: x["_piece"]), "").alias(name)
            for name in ranges
        ],
    )
    return put.select(*rows.columns, *ranges)


def flanked(rows: DataFrame, tiled: DataFrame, positions: Sequence[str], before: int, behind: int) -> DataFrame:
    """``rows`` (chrom) with, for each named position p, p_flank: ``before`` bases up to p and ``behind`` bases from p + 1 on, -
    outside the chromosome. The bases of each place are looked up once, however many rows have it."""
    places = rows.select("chrom", F.explode(F.array(*[F.col(p).cast("long") for p in positions])).alias("_pos")).distinct()
    first = F.col("_pos") - before + 1
    found = with_bases(places, tiled, ["_pos"], {"_x": (first, first + before + behind - 1)})
    found = found.select(F.col("chrom").alias("_chrom"), "_pos", padded(F.col("_x"), first, before + behind).alias("_flank"))
    for p in positions:
        own = found.withColumnRenamed("_flank", f"{p}_flank")
        rows = rows.join(own, (F.col("chrom") == F.col("_chrom")) & (F.col(p) == F.col("_pos")), "left").drop("_chrom", "_pos")
    return rows


def padded(bases: Column, first: Column, width: int) -> Column:
    """Bases of a range of ``width`` that may begin before the chromosome or end behind it, with - outside."""
    before = F.greatest(F.lit(0), F.least(F.lit(width), 1 - first)).cast("int")
    return F.rpad(F.concat(F.repeat(F.lit("-"), before), bases), width, "-")

"""Depth and errors by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Positions of a tile: sums along positions are made inside tiles, and over one row for each tile.
TILE = 1 << 14


def depth_by_position(blocks: DataFrame, keys: list[str], st: str = "st", en: str = "en", mismatches: DataFrame | None = None) -> DataFrame:
    """Depth of every covered position: +1 where a block starts, -1 behind its end, summed along positions; with mismatches
    (keys, pos; a row for each) their number at each position as ``errors``.

    Blocks are cut at the borders of tiles, so each tile is swept by itself and no window holds more than its positions.
    Changes are summed by position first: a window sees positions, not reads. Stretches of equal depth are unrolled at the
    end. Mismatches outside blocks don't count.
    """
    tile = lambda c: F.floor(c / TILE)
    cut = blocks.filter(F.col(en) >= F.col(st)).select(*keys, st, en, F.explode(F.sequence(tile(F.col(st)), tile(F.col(en)))).alias("_tile"))
    lo, hi = F.greatest(F.col(st), F.col("_tile") * TILE), F.least(F.col(en), F.col("_tile") * TILE + TILE - 1)
    change = F.explode(F.array(F.struct(lo.alias("pos"), F.lit(1).alias("d")), F.struct((hi + 1).alias("pos"), F.lit(-1).alias("d")))).alias("x")
    changes = cut.select(*keys, "_tile", change).select(*keys, "_tile", F.col("x.pos").alias("pos"), F.col("x.d").alias("d"), F.lit(0).alias("e"))
    if mismatches is not None:
        own = mismatches.select(*keys, tile(F.col("pos")).alias("_tile"), F.col("pos").cast("long").alias("pos"), F.lit(0).alias("d"), F.lit(1).alias("e"))
        changes = changes.unionByName(own)
    summed = changes.groupBy(*keys, "_tile", "pos").agg(F.sum("d").alias("d"), F.sum("e").alias("e"))
    along = W.partitionBy(*keys, "_tile").orderBy("pos")
    swept = summed.withColumn("depth", F.sum("d").over(along.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("next", F.lead("pos").over(along))
    each = swept.filter("depth > 0").select(*keys, "depth", "e", F.posexplode(F.sequence(F.col("pos"), F.col("next") - 1)).alias("_i", "pos"))
    errors = [] if mismatches is None else [F.when(F.col("_i") == 0, F.col("e")).otherwise(0).cast("long").alias("errors")]
    return each.select(*keys, F.col("pos").cast("int").alias("pos"), "depth", *errors)


def cumulative_share(depth: DataFrame, keys: list[str]) -> DataFrame:
    """Column running: the sum of depth up to a position, in two levels: over tiles, then inside them."""
    tiled = depth.withColumn("_tile", F.floor(F.col("pos") / TILE))
    sums = tiled.groupBy(*keys, "_tile").agg(F.sum("depth").alias("_s"))
    up = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_tile").alias("_t"), F.coalesce(F.sum("_s").over(up), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_tile").orderBy("pos").rangeBetween(W.unboundedPreceding, W.currentRow)
    met = tiled.withColumn("_in", F.sum("depth").over(inside))
    on = F.col("_tile") == F.col("_t")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return met.join(offsets, on).select(*depth.columns, (F.col("_before") + F.col("_in")).alias("running"))


def start_end_counts(exon_rows: DataFrame, keys: list[str]) -> DataFrame:
    """How often a position is a start or an end, inner ones included."""
    each = F.explode(F.array(F.struct(F.col("st").alias("pos"), F.lit("start").alias("kind")), F.struct(F.col("en").alias("pos"), F.lit("end").alias("kind")))).alias("x")
    return exon_rows.select(*keys, each).groupBy(*keys, "x.kind", "x.pos").agg(F.count("*").alias("n"))


def full_add_by_position(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of positions, depths and errors added."""
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    return both.groupBy(*keys, "pos").agg(F.sum("depth").alias("depth"), F.sum("errors").alias("errors"))


def zero_gaps(depth: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Depth 0 on both sides of a gap between positions. Neighbours in other tiles come from a row for each tile."""
    tiled = depth.withColumn("_tile", F.floor(F.col("pos") / TILE))
    ends = tiled.groupBy(*keys, "_tile").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    line = W.partitionBy(*keys).orderBy("_tile")
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_tile").alias("_t"), F.lag("_last").over(line).alias("_before"), F.lead("_first").over(line).alias("_behind"))
    on = F.col("_tile") == F.col("_t")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    along = W.partitionBy(*keys, "_tile").orderBy("pos")
    met = tiled.withColumn("_l", F.lag("pos").over(along)).withColumn("_r", F.lead("pos").over(along)).join(ends, on)
    at_gap = (F.col("pos") - F.coalesce("_l", "_before") > gap) | (F.coalesce("_r", "_behind") - F.col("pos") > gap)
    return met.withColumn("depth", F.when(at_gap, 0).otherwise(F.col("depth"))).select(*depth.columns)


def local_smooth(depth: DataFrame, keys: list[str], half: int) -> DataFrame:
    """Tricube-weighted mean over the positions within ``half``; zeros stay zero.

    The weights depend on distance only, so the mean is a window over collected neighbours of a bounded range.
    """
    near = W.partitionBy(*keys).orderBy("pos").rangeBetween(-half, half)
    listed = depth.withColumn("_near", F.collect_list(F.struct("pos", "depth")).over(near))
    weight = lambda x: F.pow(1 - F.pow(F.abs(x["pos"] - F.col("pos")) / (half + 1), 3), 3)
    top = F.aggregate("_near", F.lit(0.0), lambda a, x: a + weight(x) * x["depth"])
    bottom = F.aggregate("_near", F.lit(0.0), lambda a, x: a + weight(x))
    return listed.withColumn("smooth", F.when(F.col("depth") == 0, 0.0).otherwise(top / bottom)).drop("_near")


def difference_to_previous(rates: DataFrame, sample: str, pos: str, value: str) -> DataFrame:
    """A sample's value minus the one before it (by sample); the first one's minus the second's."""
    along = W.partitionBy(pos).orderBy(sample)
    return rates.withColumn("difference", F.col(value) - F.coalesce(F.lag(value).over(along), F.lead(value).over(along)))


def depth_ratio(errors: Column, depth: Column) -> Column:
    return F.try_divide(errors, depth)


def downsample(depth: Column, errors: Column, to: int) -> tuple[Column, Column]:
    """Depth and errors scaled down to a depth, floored."""
    return F.least(depth, F.lit(to)), F.when(depth > to, F.floor(errors * to / depth)).otherwise(errors).cast("long")


def depth_valley(depth: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """First position with no depth, and the first behind it above a share of the maximum; by counts and joins, no windows."""
    first = depth.groupBy(*keys).agg(F.max("depth").alias("_max"), F.min(F.when(F.col("depth") == 0, F.col("pos"))).alias("zero_at"))
    rise = (F.col("pos") > F.col("zero_at")) & (F.col("depth") > share * F.col("_max"))
    return depth.join(first, keys).groupBy(*keys).agg(F.first("zero_at").alias("zero_at"), F.min(F.when(rise, F.col("pos"))).alias("rise_at"))


def absent_before(depth: DataFrame, keys: list[str], start: int, end: int, above: int = 20_000, least: int = 10) -> DataFrame:
    """Keys without any depth between ``above`` and ``start`` (both excluded) that go deeper than ``least`` from start to end."""
    before = F.coalesce(F.max(F.when((F.col("pos") > above) & (F.col("pos") < start), F.col("depth"))), F.lit(0))
    inside = F.max(F.when(F.col("pos").between(start, end), F.col("depth")))
    return depth.groupBy(*keys).agg(before.alias("_b"), inside.alias("peak")).filter((F.col("_b") == 0) & (F.col("peak") > least)).drop("_b")


def bh_adjust(tests: DataFrame, p: str, key: str) -> DataFrame:
    """Benjamini-Hochberg: p times m over rank, made monotone from the largest p down.

    Equal p values share the rank of the last of them, so ranks and minima need distinct p values only. They are dealt to
    buckets by their logarithm (at most about 1.1 million: what numbers in double precision allow), summed by bucket, and
    ranked inside, so no task sees them all.
    """
    m = F.broadcast(tests.filter(F.col(p).isNotNull()).agg(F.count("*").alias("m")))  # one row
    bucket = F.when(F.col(p) > 0, F.floor(F.log2(p) * 1024)).otherwise(-2_000_000)
    distinct = tests.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n")).withColumn("_bucket", bucket)
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = distinct.groupBy("_bucket").agg(F.sum("_n").alias("_s"))
    sums = sums.select("_bucket", (F.sum("_s").over(upto(W.orderBy("_bucket"))) - F.col("_s")).alias("_before"))
    ranked = distinct.join(sums, "_bucket").withColumn("_rank", F.col("_before") + F.sum("_n").over(upto(W.partitionBy("_bucket").orderBy(p)))).crossJoin(m)
    raw = ranked.withColumn("_raw", F.col(p) * F.col("m") / F.col("_rank"))
    least = raw.groupBy("_bucket").agg(F.min("_raw").alias("_l"))
    least = least.select("_bucket", F.min("_l").over(W.orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)).alias("_above"))
    inside = F.min("_raw").over(upto(W.partitionBy("_bucket").orderBy(F.desc(p))))
    padj = raw.join(least, "_bucket").withColumn("padj", F.least(F.lit(1.0), inside, "_above")).select(F.col(p).alias("_p"), "padj")
    return tests.join(padj, F.col(p) == F.col("_p"), "left").select(key, p, "padj")


def sample_correlation(depth: DataFrame, lo: int, hi: int) -> DataFrame:
    """Pearson correlation of depths between sources over the positions that both have."""
    own = depth.filter(F.col("pos").between(lo, hi))
    x, y = (own.select("pos", F.col("source").alias(f"source_{k}"), F.col("depth").alias(f"depth_{k}")) for k in "ab")
    return x.join(y, "pos").groupBy("source_a", "source_b").agg(F.corr("depth_a", "depth_b").alias("r"))

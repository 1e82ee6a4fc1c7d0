"""Transcript clusters and isoforms: two levels of grouping with counts by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .structure import bin_breaks, joined


def with_iso_key(keyed: DataFrame, size: int) -> DataFrame:
    """Column iso_key: the binned breaks."""
    return keyed.withColumn("iso_key", bin_breaks(F.col("breaks"), size))


def cluster_agg(keyed: DataFrame) -> DataFrame:
    """(chrom, cluster_key, source): reads, smallest start and largest end; counts are combined map-side."""
    return keyed.groupBy("chrom", "cluster_key", "source").agg(F.count("*").alias("n"), F.min("st").alias("st"), F.max("en").alias("en"))


def clusters_by_size(keyed: DataFrame) -> DataFrame:
    """Clusters over all sources with a rank by reads."""
    totals = keyed.groupBy("chrom", "cluster_key").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.min("st").alias("st"), F.max("en").alias("en"))
    return totals.orderBy(F.desc("n"), "chrom", "cluster_key")


def isoform_agg(keyed: DataFrame) -> DataFrame:
    """Second level: (chrom, cluster_key, iso_key, source); needs with_iso_key()."""
    return keyed.groupBy("chrom", "cluster_key", "iso_key", "source").agg(F.count("*").alias("n"))


def mean_breaks(keyed: DataFrame, first: str | None = None) -> DataFrame:
    """Element-wise rounded mean of the breaks of each isoform's reads.

    Members of an isoform have equally many breaks, so sums by position are combined map-side. With ``first``, a source that
    is a transcriptome, its reads alone count in the isoforms that it has.
    """
    each = keyed.select("chrom", "cluster_key", "iso_key", *([] if first is None else ["source"]), F.posexplode("breaks").alias("i", "b"))
    mean = F.avg("b") if first is None else F.coalesce(F.avg(F.when(F.col("source") == first, F.col("b"))), F.avg("b"))
    means = each.groupBy("chrom", "cluster_key", "iso_key", "i").agg(F.floor(mean + 0.5).cast("int").alias("m"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"])
    return means.groupBy("chrom", "cluster_key", "iso_key").agg(listed.alias("breaks"))


def isoform_ids(isoforms: DataFrame, reads: DataFrame | None = None, first: str | None = None) -> DataFrame:
    """Identifier <cluster>.t<k>: k numbers a cluster's isoforms by key. With ``reads`` (see with_iso_key()) and ``first``, a
    source that is a transcriptome, an isoform that it has is called like its read there, the first by name."""
    k = F.dense_rank().over(W.partitionBy("chrom", "cluster_key").orderBy("iso_key"))
    named = isoforms.withColumn("isoform_id", F.concat_ws(".t", "cluster_key", k.cast("string")))
    if reads is None:
        return named
    own = reads.filter(F.col("source") == first).groupBy("chrom", "cluster_key", "iso_key").agg(F.min(F.col("read_id").cast("string")).alias("_name"))
    return named.join(own, ["chrom", "cluster_key", "iso_key"], "left").withColumn("isoform_id", F.coalesce("_name", "isoform_id")).drop("_name")


def exon_counts(isoforms: DataFrame) -> DataFrame:
    """Distinct numbers of exons of a cluster's isoforms, joined."""
    n = (F.size("iso_key") / 2).cast("int")
    return isoforms.groupBy("chrom", "cluster_key").agg(joined(F.array_sort(F.collect_set(n))).alias("exons"), F.countDistinct("iso_key").alias("n_isoforms"))


def representative_isoform(isoforms: DataFrame) -> DataFrame:
    """The isoform with most reads over all sources; the lowest key on ties."""
    totals = isoforms.groupBy("chrom", "cluster_key", "iso_key").agg(F.sum("n").alias("n"))
    best = F.min_by(F.struct("iso_key", "n"), F.struct((-F.col("n")).alias("m"), "iso_key"))
    return totals.groupBy("chrom", "cluster_key").agg(best.alias("x")).select("chrom", "cluster_key", "x.iso_key", "x.n")


def feature_length(breaks: Column) -> Column:
    """Sum of end - start over the exons of an array of breaks."""
    odd = F.filter(F.transform(breaks, lambda b, i: F.when(i % 2 == 0, -b).otherwise(b)), lambda x: x.isNotNull())
    return F.aggregate(odd, F.lit(0), lambda a, x: a + x)


def top_isoforms_per_cluster(isoforms: DataFrame, n: int, least: int) -> DataFrame:
    """The n most frequent isoforms of each cluster in which some source has ``least`` reads of one isoform."""
    by_source = isoforms.groupBy("chrom", "cluster_key", "iso_key").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    own = W.partitionBy("chrom", "cluster_key")
    ranked = by_source.withColumn("peak", F.max("most").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "iso_key")))
    return ranked.filter((F.col("rank") <= n) & (F.col("peak") >= least)).select("chrom", "cluster_key", "iso_key", "n", "rank")


def cap_per_cluster(members: DataFrame, n: int, key: str, order: str) -> DataFrame:
    """At most n members of each cluster, in order."""
    return members.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(order))).filter(F.col("_rank") <= n).drop("_rank")


def big_clusters(members: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """The largest clusters of at least ``least`` members."""
    return members.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), key).limit(most)


def cluster_mean_sd(keyed: DataFrame) -> DataFrame:
    """Mean and population deviation of start, end, and the first gap's sides, by cluster."""
    left, right = F.try_element_at("breaks", F.lit(2)), F.try_element_at("breaks", F.lit(3))
    rows = keyed.select("chrom", "cluster_key", "st", "en", F.when(F.size("breaks") > 2, left).alias("left"), right.alias("right"))
    stats = [f(c).alias(f"{c}_{k}") for c in ("st", "en", "left", "right") for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return rows.groupBy("chrom", "cluster_key").agg(*stats)


#: Values that are counted together while a rank is looked for.
STEP = 4096


def at_rank(rows: DataFrame, keys: list[str], value: str, rank: Column, out: str) -> DataFrame:
    """keys and ``out``, the value at a rank (from 0) of each group of rows; ``rank`` is a column over keys and n, its number of rows.

    The rank's stretch of ``STEP`` values is found from counts by stretch, then the value from counts within that stretch: no
    task sorts the rows of a group.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c")).withColumn("_s", F.floor(F.col("_v") / STEP))
    sizes = counted.groupBy(*keys, "_s").agg(F.sum("_c").alias("_c"))
    own = W.partitionBy(*keys)
    upto = lambda c: own.orderBy(c).rowsBetween(W.unboundedPreceding, W.currentRow)
    stretches = sizes.withColumn("_to", F.sum("_c").over(upto("_s"))).withColumn("n", F.sum("_c").over(own)).withColumn("_rank", rank)
    held = stretches.filter((F.col("_to") > F.col("_rank")) & (F.col("_to") - F.col("_c") <= F.col("_rank"))).select(*keys, "_s", (F.col("_rank") - F.col("_to") + F.col("_c")).alias("_rank"))
    inside = counted.join(held, [*keys, "_s"]).withColumn("_to", F.sum("_c").over(upto("_v")))
    return inside.filter(F.col("_to") > F.col("_rank")).groupBy(*keys).agg(F.min("_v").alias(out))


def trim_cluster(members: DataFrame, keys: list[str], more_than: int, tol: int = 10, fold: float = 2.0, room: int = 20) -> DataFrame:
    """Members of a cluster that reach its middle start and end and whose breaks are near the mean, cut to these targets.

    members: keys, read_id, breaks (starts and ends of the exons in turn). The start target is the start at rank n // 2, the
    end target the end at rank n - n // 2 (the last, if there are no more), both from counts by value. A member stays if it
    starts before start target + tol, ends behind end target - tol, and the end of its first and the start of its last exon
    (0 without a gap) are within the larger of ``fold`` deviations and ``room`` of their means; it is cut to the targets, and
    goes if nothing is left. Clusters with ``more_than`` such members or fewer go. Columns: keys, read_id, st, en, and
    ``skip`` and ``drop``, the bases cut at either end.
    """
    size = F.size("breaks")
    own = members.select(*keys, "read_id", F.col("breaks")[0].alias("_st"), F.element_at("breaks", -1).alias("_en"), F.when(size > 2, F.col("breaks")[1]).otherwise(0).alias("_l"), F.when(size > 2, F.element_at("breaks", -2)).otherwise(0).alias("_r"))
    half = F.floor(F.col("n") / 2)
    targets = at_rank(own, keys, "_st", half, "st_to").join(at_rank(own, keys, "_en", F.least(F.col("n") - half, F.col("n") - 1), "en_to"), keys)
    moments = own.groupBy(*keys).agg(*[f(c).alias(f"{c}{k}") for c in ("_l", "_r") for k, f in (("_mean", F.avg), ("_sd", F.stddev_pop))])
    met = own.join(targets, keys).join(moments, keys)

    def near(c: str) -> Column:
        return F.abs(F.col(c) - F.col(f"{c}_mean")) <= F.greatest(F.col(f"{c}_sd") * fold, F.lit(room))

    kept = met.filter((F.col("_st") < F.col("st_to") + tol) & (F.col("_en") > F.col("en_to") - tol) & near("_l") & near("_r"))
    kept = kept.select(*keys, "read_id", F.greatest("_st", "st_to").alias("st"), F.least("_en", "en_to").alias("en"), F.greatest(F.lit(0), F.col("st_to") - F.col("_st")).alias("skip"), F.greatest(F.lit(0), F.col("_en") - F.col("en_to")).alias("drop")).filter("st <= en")
    enough = kept.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > more_than).select(*keys)
    return kept.join(enough, keys, "left_semi")


def stream_clusters(keyed: DataFrame) -> DataFrame:
    """Running counts by cluster; works on batches and, in update mode, on streams, where late rows update their key."""
    return keyed.groupBy("chrom", "cluster_key", "source").agg(F.count("*").alias("n"))

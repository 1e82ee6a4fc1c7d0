"""Base qualities and ordered values: gates, profiles and sliding statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

NO_QUALITY = 500.0


def mean_quality(q: Column) -> Column:
    """Quality of the mean error probability of an array of qualities; 500 where there are none."""
    total = F.aggregate(q, F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), -x / F.lit(10.0)))
    return F.when(F.size(q) > 0, -10 * F.log10(total / F.size(q))).otherwise(NO_QUALITY)


def median_of(a: Column) -> Column:
    """Median of an array; the mean of the middle two for even lengths; null when empty."""
    s, n = F.sort_array(a), F.size(a)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / F.lit(2.0)


def leftover_quality_gate(q: Column, least: float, firsts: tuple[int, ...] = (30, 50, 70, 100)) -> Column:
    """Whether the medians over the first 30, 50, 70, 100 and over all qualities reach ``least``."""
    whole = median_of(q) >= least
    for n in firsts:
        whole = whole & (median_of(F.slice(q, 1, n)) >= least)
    return F.coalesce(whole, F.lit(False))


def values(reads: DataFrame, key: str, q: str = "q") -> DataFrame:
    """key, i and x for each quality."""
    return reads.select(key, F.posexplode(q).alias("i", "x"))


def quality_profile(reads: DataFrame, q: str = "q") -> DataFrame:
    """Histogram of all qualities: x, n."""
    return reads.select(F.explode(q).alias("x")).groupBy("x").agg(F.count("*").alias("n"))


def quality_percentiles(profile: DataFrame, steps: int = 100) -> DataFrame:
    """Percentiles p of 0..steps, interpolated, from a histogram, which has a row for each distinct quality only."""
    shares = [i / steps for i in range(steps + 1)]
    one = profile.agg(F.percentile("x", F.array(*[F.lit(s) for s in shares]), F.col("n")).alias("v"))
    return one.select(F.posexplode("v").alias("p", "value"))


def range_percentile(reads: DataFrame, key: str, first: int, length: int, share: float, q: str = "q") -> DataFrame:
    """Interpolated percentile of a slice of each read's qualities."""
    return reads.select(key, F.explode(F.slice(q, first + 1, length)).alias("x")).groupBy(key).agg(F.percentile("x", share).alias("value"))


def _last(key: str, order: str, k: int):
    return W.partitionBy(key).orderBy(order).rowsBetween(-(k - 1), 0)


def sliding(rows: DataFrame, key: str, order: str, x: str, k: int, share: float | None = None) -> DataFrame:
    """Mean (or interpolated percentile) over each row and the k - 1 before it; the first k - 1 rows are dropped."""
    w = _last(key, order, k)
    stat = F.avg(x) if share is None else F.percentile(x, share)
    return rows.select(key, order, stat.over(w).alias("stat"), F.count("*").over(w).alias("_n")).filter(F.col("_n") == k).drop("_n")


def low_quality_window(rows: DataFrame, key: str, order: str, x: str, k: int, least: float, skip: int = 0, share: float | None = None) -> DataFrame:
    """key and low: whether any window after the first ``skip`` has a statistic below ``least``."""
    found = sliding(rows, key, order, x, k, share)
    return found.groupBy(key).agg(F.max((F.col(order) >= k - 1 + skip) & (F.col("stat") < least)).alias("low"))


def alignment_consistency(blocks: DataFrame, tol: int = 20) -> DataFrame:
    """read_id and bad: strand changes, a gap or overlap on the read above ``tol``, or an overlap on the reference above it."""
    w = W.partitionBy("read_id").orderBy("q1", "q2", "st", "en", "pk")
    turned = F.lag("fwd").over(w) != F.col("fwd")
    apart = F.abs(F.col("q1") - F.lag("q2").over(w) - 1) > tol
    over = F.lag("en").over(w) - F.col("st") + 1 > tol
    flagged = blocks.select("read_id", F.coalesce(turned | apart | over, F.lit(False)).alias("bad"))
    return flagged.groupBy("read_id").agg(F.max("bad").alias("bad"))


def interval_union_length(blocks: DataFrame, keys: list[str], lo: str = "q1", hi: str = "q2") -> DataFrame:
    """Covered length of the union of closed intervals by key."""
    before = F.max(hi).over(W.partitionBy(*keys).orderBy(lo, hi).rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col(hi) - F.greatest(F.coalesce(before, F.col(lo) - 1), F.col(lo) - 1))
    return blocks.select(*keys, new.alias("_new")).groupBy(*keys).agg(F.sum("_new").cast("long").alias("covered"))


def best_reference(covered: DataFrame, read: str, reference: str) -> DataFrame:
    """The reference that covers most of each read; ties go to the smallest name."""
    w = W.partitionBy(read).orderBy(F.desc("covered"), reference)
    return covered.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

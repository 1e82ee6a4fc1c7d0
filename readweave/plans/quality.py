"""Queries over qualities and ordered values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as ql
from ..registry import query
from .inputs import blocks, qualities, sql

_MEAN = "round(-10 * log10(list_sum(list_transform(q, lambda x: pow(10.0::DOUBLE, -x / 10.0::DOUBLE))) / len(q)), 6)"
_X = "x AS (SELECT vec_id, unnest(q) AS x, CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS i FROM q)"


@query("filter_mean_quality", sql("q", f"SELECT vec_id, {_MEAN} AS quality FROM q WHERE {_MEAN} >= 5.5"))
def filter_mean_quality(spark, sf_dir):
    return qualities(spark, sf_dir).select("vec_id", F.round(ql.mean_quality(F.col("q")), 6).alias("quality")).filter("quality >= 5.5")


@query("quality_profile", sql("q", f"WITH {_X} SELECT x, count(*) AS n FROM x GROUP BY x"))
def quality_profile(spark, sf_dir):
    return ql.quality_profile(qualities(spark, sf_dir))


@query("quality_percentiles", sql("q", f"WITH {_X}, p AS (SELECT unnest(range(0, 101)) AS p, unnest(v) AS v FROM (SELECT quantile_cont(x, list_transform(range(0, 101), lambda k: k / 100.0::DOUBLE)) AS v FROM x)) SELECT CAST(p AS INTEGER) AS p, round(v, 6) AS value FROM p").replace("list_transform(range(0, 101), lambda k: k / 100.0::DOUBLE)", "[" + ",".join(str(k / 100) for k in range(101)) + "]"))
def quality_percentiles(spark, sf_dir):
    return ql.quality_percentiles(ql.quality_profile(qualities(spark, sf_dir))).withColumn("value", F.round("value", 6))


@query("range_percentile", sql("q", "SELECT vec_id, round(quantile_cont(x, 0.25), 6) AS value FROM (SELECT vec_id, unnest(q[11:30]) AS x FROM q) GROUP BY 1"))
def range_percentile(spark, sf_dir):
    return ql.range_percentile(qualities(spark, sf_dir), "vec_id", 10, 20, 0.25).withColumn("value", F.round("value", 6))


@query("range_median", sql("q", "SELECT vec_id, median(x) AS value FROM (SELECT vec_id, unnest(q[1:30]) AS x FROM q) GROUP BY 1"))
def range_median(spark, sf_dir):
    return qualities(spark, sf_dir).select("vec_id", ql.median_of(F.slice("q", 1, 30)).alias("value"))


@query("sliding_mean", sql("q", f"WITH {_X} SELECT * FROM (SELECT vec_id, i, round(avg(x) OVER (PARTITION BY vec_id ORDER BY i ROWS 9 PRECEDING), 6) AS stat FROM x) WHERE i >= 9"))
def sliding_mean(spark, sf_dir):
    return ql.sliding(ql.values(qualities(spark, sf_dir), "vec_id"), "vec_id", "i", "x", 10).withColumn("stat", F.round("stat", 6))


@query("sliding_percentile", sql("q", f"WITH {_X} SELECT * FROM (SELECT vec_id, i, round(quantile_cont(x, 0.25) OVER (PARTITION BY vec_id ORDER BY i ROWS 9 PRECEDING), 6) AS stat FROM x) WHERE i >= 9"))
def sliding_percentile(spark, sf_dir):
    return ql.sliding(ql.values(qualities(spark, sf_dir), "vec_id"), "vec_id", "i", "x", 10, 0.25).withColumn("stat", F.round("stat", 6))


@query("sliding_median", sql("q", f"WITH {_X} SELECT * FROM (SELECT vec_id, i, median(x) OVER (PARTITION BY vec_id ORDER BY i ROWS 9 PRECEDING) AS stat FROM x) WHERE i >= 9"))
def sliding_median(spark, sf_dir):
    return ql.sliding(ql.values(qualities(spark, sf_dir), "vec_id"), "vec_id", "i", "x", 10, 0.5)


@query("low_quality_window", sql("q", f"WITH {_X}, s AS (SELECT vec_id, i, avg(x) OVER (PARTITION BY vec_id ORDER BY i ROWS 9 PRECEDING) AS stat FROM x) SELECT vec_id, bool_or(i >= 11 AND stat < 6) AS low FROM s WHERE i >= 9 GROUP BY 1"))
def low_quality_window(spark, sf_dir):
    return ql.low_quality_window(ql.values(qualities(spark, sf_dir), "vec_id"), "vec_id", "i", "x", 10, 6, skip=2)


@query("leftover_quality_gate", sql("q", "SELECT vec_id, list_aggregate(q, 'median') >= 8 AND list_aggregate(q[1:30], 'median') >= 8 AND list_aggregate(q[1:50], 'median') >= 8 AND list_aggregate(q[1:70], 'median') >= 8 AND list_aggregate(q[1:100], 'median') >= 8 AS passed FROM q"))
def leftover_quality_gate(spark, sf_dir):
    return qualities(spark, sf_dir).select("vec_id", ql.leftover_quality_gate(F.col("q"), 8).alias("passed"))


@query("alignment_consistency", sql("b", "WITH f AS (SELECT read_id, coalesce(lag(fwd) OVER w <> fwd OR abs(q1 - lag(q2) OVER w - 1) > 20 OR lag(en) OVER w - st + 1 > 20, false) AS bad FROM b WINDOW w AS (PARTITION BY read_id ORDER BY q1, q2, st, en, pk)) SELECT read_id, bool_or(bad) AS bad FROM f GROUP BY 1"))
def alignment_consistency(spark, sf_dir):
    return ql.alignment_consistency(blocks(spark, sf_dir))


_COVERED = "f AS (SELECT read_id, source, pk % 3 AS ref, greatest(0, q2 - greatest(coalesce(max(q2) OVER (PARTITION BY read_id, pk % 3 ORDER BY q1, q2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q1 - 1), q1 - 1)) AS new FROM b), u AS (SELECT read_id, ref, CAST(sum(new) AS BIGINT) AS covered FROM f GROUP BY ALL)"


def _covered(spark, sf_dir):
    return ql.interval_union_length(blocks(spark, sf_dir).withColumn("ref", F.col("pk") % 3), ["read_id", "ref"])


@query("interval_union_length", sql("b", f"WITH {_COVERED} SELECT * FROM u"))
def interval_union_length(spark, sf_dir):
    return _covered(spark, sf_dir)


@query("best_reference", sql("b", f"WITH {_COVERED} SELECT read_id, ref, covered FROM u QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY covered DESC, ref) = 1"))
def best_reference(spark, sf_dir):
    return ql.best_reference(_covered(spark, sf_dir), "read_id", "ref")

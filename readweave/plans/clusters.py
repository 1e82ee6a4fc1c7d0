"""Queries over clusters, break points and depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breakpoints as bp
from ..operators import clusters as cl
from ..operators import depth as dp
from ..operators import intervals as iv
from ..operators import rates as rt
from ..operators import structure as st
from ..registry import query
from ..sources import files
from . import inputs
from .inputs import blocks, genes, sql
from .structure import exons, per_read


def keyed(spark, sf_dir):
    """One row per read with its breaks and cluster key."""
    return iv.keyed_reads(exons(spark, sf_dir), genes(spark, sf_dir))


def isoforms(spark, sf_dir):
    return cl.isoform_agg(cl.with_iso_key(keyed(spark, sf_dir), 50))


_ISO = "i0 AS (SELECT *, list_transform(flatten(list_transform(list_zip(sts, ens), lambda x: [x[1], x[2]])), lambda b: b // 50) AS iso FROM kr), iso AS (SELECT chrom, cluster_key, iso, array_to_string(iso, ',') AS iso_key, source, count(*) AS n FROM i0 GROUP BY ALL)"


@query("cluster_agg", sql("kr", "SELECT chrom, cluster_key, source, count(*) AS n, min(st) AS st, max(en) AS en FROM kr GROUP BY ALL"))
def cluster_agg(spark, sf_dir):
    return cl.cluster_agg(keyed(spark, sf_dir))


@query("clusters_by_size", sql("kr", "SELECT chrom, cluster_key, count(*) AS n, count(DISTINCT source) AS n_sources, min(st) AS st, max(en) AS en FROM kr GROUP BY ALL"))
def clusters_by_size(spark, sf_dir):
    return cl.clusters_by_size(keyed(spark, sf_dir))


@query("stream_clusters", sql("kr", "SELECT chrom, cluster_key, source, count(*) AS n FROM kr GROUP BY ALL"))
def stream_clusters(spark, sf_dir):
    return cl.stream_clusters(keyed(spark, sf_dir))


@query("isoform_agg", sql("kr", f"WITH {_ISO} SELECT chrom, cluster_key, iso_key, source, n FROM iso"))
def isoform_agg(spark, sf_dir):
    return isoforms(spark, sf_dir).withColumn("iso_key", st.joined(F.col("iso_key")))


@query("mean_breaks", sql("kr", f"WITH {_ISO}, x AS (SELECT chrom, cluster_key, array_to_string(iso, ',') AS iso_key, unnest(flatten(list_transform(list_zip(sts, ens), lambda x: [x[1], x[2]]))) AS b, generate_subscripts(iso, 1) AS i FROM i0), m AS (SELECT chrom, cluster_key, iso_key, i, CAST(floor(avg(b) + 0.5) AS INTEGER) AS m FROM x GROUP BY ALL) SELECT chrom, cluster_key, iso_key, string_agg(m, ',' ORDER BY i) AS breaks FROM m GROUP BY ALL"))
def mean_breaks(spark, sf_dir):
    found = cl.mean_breaks(cl.with_iso_key(keyed(spark, sf_dir), 50))
    return found.select("chrom", "cluster_key", st.joined(F.col("iso_key")).alias("iso_key"), st.joined(F.col("breaks")).alias("breaks"))


@query("isoform_ids", sql("kr", f"WITH {_ISO} SELECT DISTINCT chrom, iso_key, cluster_key || '.t' || dense_rank() OVER (PARTITION BY chrom, cluster_key ORDER BY iso) AS isoform_id FROM iso"))
def isoform_ids(spark, sf_dir):
    return cl.isoform_ids(isoforms(spark, sf_dir).select("chrom", "cluster_key", "iso_key").distinct()).select("chrom", st.joined(F.col("iso_key")).alias("iso_key"), "isoform_id")


@query("mean_breaks_transcriptome", sql("kr", f"WITH {_ISO}, x AS (SELECT chrom, cluster_key, source, array_to_string(iso, ',') AS iso_key, unnest(flatten(list_transform(list_zip(sts, ens), lambda x: [x[1], x[2]]))) AS b, generate_subscripts(iso, 1) AS i FROM i0), m AS (SELECT chrom, cluster_key, iso_key, i, CAST(floor(coalesce(avg(b) FILTER (WHERE source = 's0'), avg(b)) + 0.5) AS INTEGER) AS m FROM x GROUP BY ALL) SELECT chrom, cluster_key, iso_key, string_agg(m, ',' ORDER BY i) AS breaks FROM m GROUP BY ALL"))
def mean_breaks_transcriptome(spark, sf_dir):
    found = cl.mean_breaks(cl.with_iso_key(keyed(spark, sf_dir), 50), "s0")
    return found.select("chrom", "cluster_key", st.joined(F.col("iso_key")).alias("iso_key"), st.joined(F.col("breaks")).alias("breaks"))


@query("isoform_ids_transcriptome", sql("kr", f"WITH {_ISO}, nm AS (SELECT chrom, cluster_key, iso, min(CAST(read_id AS VARCHAR)) FILTER (WHERE source = 's0') AS name FROM i0 GROUP BY ALL) SELECT chrom, array_to_string(iso, ',') AS iso_key, coalesce(name, cluster_key || '.t' || dense_rank() OVER (PARTITION BY chrom, cluster_key ORDER BY iso)) AS isoform_id FROM nm"))
def isoform_ids_transcriptome(spark, sf_dir):
    reads = cl.with_iso_key(keyed(spark, sf_dir), 50)
    found = cl.isoform_ids(cl.isoform_agg(reads).select("chrom", "cluster_key", "iso_key").distinct(), reads, "s0")
    return found.select("chrom", st.joined(F.col("iso_key")).alias("iso_key"), "isoform_id")


@query("exon_counts", sql("kr", f"WITH {_ISO}, x AS (SELECT chrom, cluster_key, len(iso) // 2 AS n, count(DISTINCT iso) AS k FROM iso GROUP BY ALL) SELECT chrom, cluster_key, string_agg(n, ',' ORDER BY n) AS exons, CAST(sum(k) AS BIGINT) AS n_isoforms FROM x GROUP BY ALL"))
def exon_counts(spark, sf_dir):
    return cl.exon_counts(isoforms(spark, sf_dir))


_TOT = "t AS (SELECT chrom, cluster_key, iso, iso_key, CAST(sum(n) AS BIGINT) AS n, max(n) AS most FROM iso GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY chrom, cluster_key ORDER BY n DESC, iso) AS rank, max(most) OVER (PARTITION BY chrom, cluster_key) AS peak FROM t)"


@query("representative_isoform", sql("kr", f"WITH {_ISO}, {_TOT} SELECT chrom, cluster_key, iso_key, n FROM o WHERE rank = 1"))
def representative_isoform(spark, sf_dir):
    return cl.representative_isoform(isoforms(spark, sf_dir)).withColumn("iso_key", st.joined(F.col("iso_key")))


@query("top_isoforms_per_cluster", sql("kr", f"WITH {_ISO}, {_TOT} SELECT chrom, cluster_key, iso_key, n, rank FROM o WHERE rank <= 3 AND peak >= 2"))
def top_isoforms(spark, sf_dir):
    return cl.top_isoforms_per_cluster(isoforms(spark, sf_dir), 3, 2).withColumn("iso_key", st.joined(F.col("iso_key")))


@query("feature_length", sql("e", "SELECT read_id, CAST(sum(en - st) AS INTEGER) AS length FROM e GROUP BY 1"))
def feature_length(spark, sf_dir):
    return per_read(spark, sf_dir).select("read_id", cl.feature_length(F.col("breaks")).alias("length"))


@query("total_counts", sql("rd", "SELECT chrom, source, count(*) AS n FROM rd GROUP BY ALL"))
def total_counts(spark, sf_dir):
    return per_read(spark, sf_dir).groupBy("chrom", "source").agg(F.count("*").alias("n"))


@query("cap_per_cluster", sql("r", "SELECT read_id, cluster FROM r QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY read_id) <= 20"))
def cap_per_cluster(spark, sf_dir):
    return cl.cap_per_cluster(inputs.reads(spark, sf_dir), 20, "cluster", "read_id").select("read_id", "cluster")


@query("big_clusters", sql("r", "SELECT cluster, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, cluster LIMIT 15"))
def big_clusters(spark, sf_dir):
    return cl.big_clusters(inputs.reads(spark, sf_dir), "cluster", 10, 15)


@query("cluster_mean_sd", sql("kr", "SELECT chrom, cluster_key, avg(st) AS st_mean, stddev_pop(st) AS st_sd, avg(en) AS en_mean, stddev_pop(en) AS en_sd, avg(CASE WHEN n_exons > 1 THEN ens[1] END) AS left_mean, stddev_pop(CASE WHEN n_exons > 1 THEN ens[1] END) AS left_sd, avg(sts[2]) AS right_mean, stddev_pop(sts[2]) AS right_sd FROM kr GROUP BY 1, 2"))
def cluster_mean_sd(spark, sf_dir):
    return cl.cluster_mean_sd(keyed(spark, sf_dir))


@query(
    "trim_cluster",
    sql(
        "kr",
        """WITH m AS (SELECT chrom, cluster_key, read_id, st, en, CASE WHEN n_exons > 1 THEN ens[1] ELSE 0 END AS l, CASE WHEN n_exons > 1 THEN sts[n_exons] ELSE 0 END AS r FROM kr),
        x AS (SELECT *, row_number() OVER (w ORDER BY st, read_id) - 1 AS s, row_number() OVER (w ORDER BY en, read_id) - 1 AS e, count(*) OVER w AS n, avg(l) OVER w AS lm, stddev_pop(l) OVER w AS ls, avg(r) OVER w AS rm, stddev_pop(r) OVER w AS rs FROM m WINDOW w AS (PARTITION BY chrom, cluster_key)),
        y AS (SELECT *, max(CASE WHEN s = n // 2 THEN st END) OVER w AS st_to, max(CASE WHEN e = least(n - n // 2, n - 1) THEN en END) OVER w AS en_to FROM x WINDOW w AS (PARTITION BY chrom, cluster_key)),
        z AS (SELECT *, count(*) OVER (PARTITION BY chrom, cluster_key) AS kept FROM y WHERE st < st_to + 10 AND en > en_to - 10 AND abs(l - lm) <= greatest(ls * 2.0, 20) AND abs(r - rm) <= greatest(rs * 2.0, 20) AND greatest(st, st_to) <= least(en, en_to))
        SELECT chrom, cluster_key, read_id, greatest(st, st_to) AS st, least(en, en_to) AS en, greatest(0, st_to - st) AS skip, greatest(0, en - en_to) AS "drop" FROM z WHERE kept > 1""".replace("(w ORDER BY", "(PARTITION BY chrom, cluster_key ORDER BY"),
    ),
)
def trim_cluster(spark, sf_dir):
    return cl.trim_cluster(keyed(spark, sf_dir), ["chrom", "cluster_key"], 1)


def cells(spark, sf_dir):
    return bp.breakpoint_counts(bp.gaps(exons(spark, sf_dir)))


_CELLS = 'g0 AS (SELECT *, lead(st) OVER (PARTITION BY read_id ORDER BY exon) AS rgt FROM e), cells AS (SELECT source, chrom, CASE WHEN exon = 1 THEN 0 ELSE 1 END AS level, en AS "left", rgt AS "right", count(*) AS n FROM g0 WHERE rgt IS NOT NULL GROUP BY ALL)'


def _cells(body: str) -> str:
    return sql("e", f"WITH {_CELLS} {body}" if not body.startswith("WITH ") else f"WITH {_CELLS}, {body[5:]}")


@query("breakpoint_counts", _cells("SELECT * FROM cells"))
def breakpoint_counts(spark, sf_dir):
    return cells(spark, sf_dir)


_SETS = 'SELECT source, chrom, level, "left", "right", CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY GROUPING SETS ((source, chrom, level, "left"), (source, chrom, level, "right"))'


@query("breakpoint_marginals", _cells(_SETS))
def breakpoint_marginals(spark, sf_dir):
    return bp.marginals(cells(spark, sf_dir))


@query("marginal_check", _cells(f'WITH own AS ({_SETS}), stored AS (SELECT source, chrom, level, "left", "right", n + CASE WHEN "left" % 10 = 0 THEN 1 ELSE 0 END AS n FROM own WHERE "right" IS NULL OR "right" % 7 <> 0) SELECT source, chrom, level, o."left", o."right", o.n AS summed, s.n AS stored FROM own o LEFT JOIN stored s USING (source, chrom, level) WHERE s."left" IS NOT DISTINCT FROM o."left" AND s."right" IS NOT DISTINCT FROM o."right" AND s.n <> o.n UNION ALL SELECT source, chrom, level, "left", "right", n, NULL FROM own WHERE "right" % 7 = 0'))
def marginal_check(spark, sf_dir):
    """Against a store that is one off for some left sides and lacks some right ones."""
    own = bp.marginals(cells(spark, sf_dir))
    stored = own.filter("right IS NULL OR right % 7 <> 0").withColumn("n", F.col("n") + F.when(F.col("left") % 10 == 0, 1).otherwise(0))
    return bp.marginal_check(cells(spark, sf_dir), stored)


_ALN = "al AS (SELECT read_id, source, concat('c', pk % 3) AS chrom, fwd, st, en, q1, q2 FROM b)"


@query("fusion_breakpoints", sql("b", f"WITH {_ALN}, x AS (SELECT source, chrom, CASE WHEN fwd THEN en ELSE st END AS \"left\", lead(chrom) OVER w AS other, lead(CASE WHEN fwd THEN st ELSE en END) OVER w AS \"right\" FROM al WINDOW w AS (PARTITION BY read_id ORDER BY q1, q2, chrom, st, en)) SELECT source, chrom, other, \"left\", \"right\", count(*) AS n FROM x WHERE other <> chrom GROUP BY ALL"))
def fusion_breakpoints(spark, sf_dir):
    """Blocks as alignments of their read to three chromosomes."""
    return bp.fusion_breakpoints(blocks(spark, sf_dir).withColumn("chrom", F.concat(F.lit("c"), F.col("pk") % 3)))


@query("breakpoint_cross", _cells('SELECT DISTINCT chrom, level, "left", "right" FROM cells'))
def breakpoint_cross(spark, sf_dir):
    return bp.breakpoint_cross(cells(spark, sf_dir))


@query("depth_at_pairs", _cells('WITH t AS (SELECT source, chrom, "left", "right", CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL) SELECT p.chrom, p."left", p."right", s.source, coalesce(t.n, 0) AS n FROM (SELECT DISTINCT chrom, "left", "right" FROM t) p CROSS JOIN (SELECT DISTINCT source FROM t) s LEFT JOIN t ON t.chrom = p.chrom AND t."left" = p."left" AND t."right" = p."right" AND t.source = s.source'))
def depth_at_pairs(spark, sf_dir):
    return bp.depth_at_pairs(cells(spark, sf_dir))


@query("break_subset", _cells('SELECT * FROM cells WHERE "left" BETWEEN 1200 AND 2400 AND "right" BETWEEN 1800 AND 3000'))
def break_subset(spark, sf_dir):
    return bp.break_subset(cells(spark, sf_dir), (1200, 2400), (1800, 3000))


@query("break_binning", _cells('SELECT source, chrom, CAST(ceil(("left" - 1000) / 100) AS INTEGER) AS i, CAST(ceil(("right" - 1000) / 200) AS INTEGER) AS j, CAST(sum(n) AS BIGINT) AS n, sum(n) / 20000.0 AS density FROM cells GROUP BY ALL'))
def break_binning(spark, sf_dir):
    return bp.break_binning(cells(spark, sf_dir), (1000, 1000), (100, 200))


@query("max_cells", _cells('WITH g AS (SELECT source, chrom, CAST(ceil(("left" - 1000) / 100) AS INTEGER) AS i, CAST(ceil(("right" - 1000) / 200) AS INTEGER) AS j, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY ALL) SELECT * FROM g QUALIFY rank() OVER (PARTITION BY source, chrom ORDER BY n DESC) = 1'))
def max_cells(spark, sf_dir):
    return bp.max_cells(bp.break_binning(cells(spark, sf_dir), (1000, 1000), (100, 200)).drop("density"), ["source", "chrom"])


def _flank(c: str, first: int) -> str:
    return " || ".join(f"CASE WHEN \"{c}\" + {o} BETWEEN 1 AND len(seq) THEN substr(seq, \"{c}\" + {o}, 1) ELSE '-' END" for o in range(first, first + 10))


@query("max_cells_flanked", sql("gn e", f'WITH {_CELLS}, m AS (SELECT * FROM cells QUALIFY rank() OVER (PARTITION BY source, chrom, level ORDER BY n DESC) = 1) SELECT source, chrom, level, "left", "right", n, {_flank("left", -9)} AS left_up, {_flank("left", 1)} AS left_on, {_flank("right", -9)} AS right_up, {_flank("right", 1)} AS right_on FROM m JOIN gn ON name = chrom'))
def max_cells_flanked(spark, sf_dir):
    return bp.max_cells_flanked(cells(spark, sf_dir), inputs.tiled(spark, sf_dir), ["source", "chrom", "level"]).select("source", "chrom", "level", "left", "right", "n", "left_up", "left_on", "right_up", "right_on")


@query("top_cells", _cells('SELECT * FROM cells WHERE n >= 1 ORDER BY n DESC, source, chrom, level, "left", "right" LIMIT 40'))
def top_cells(spark, sf_dir):
    return bp.top_cells(cells(spark, sf_dir), 1, 40)


_MOM = 'sum({0} * n) / sum(n) AS mean, sqrt(greatest(sum({0} * {0} * n) / sum(n) - (sum({0} * n) / sum(n)) ** 2, 0.0)) AS sd'


@query("weighted_moments", sql("d", "SELECT source, " + _MOM.format("pos").replace("n)", "depth)") + ", arg_min(pos, -depth * 1000000 + pos) AS at_max, max(depth) AS max FROM d GROUP BY 1"))
def weighted_moments(spark, sf_dir):
    return bp.weighted_moments(inputs.depth(spark, sf_dir), ["source"], "pos", "depth")


@query("breakpoint_region_summary", sql("a e", f"WITH {_CELLS}, x AS (SELECT source, chrom, 'start' AS side, \"left\" AS p, n FROM cells UNION ALL SELECT source, chrom, 'end', \"right\", n FROM cells), y AS (SELECT source, chrom, side, gene AS region, p, sum(n) AS n FROM x JOIN a ON g_chrom = chrom AND p BETWEEN g_st - 60 AND g_en GROUP BY ALL) SELECT source, chrom, side, region, " + _MOM.format("p") + ", arg_min(p, -n * 1000000 + p) AS at_max, CAST(max(n) AS BIGINT) AS max FROM y GROUP BY ALL"))
def breakpoint_region_summary(spark, sf_dir):
    """Regions: genes with 60 bases before them; they overlap."""
    regions = genes(spark, sf_dir).select(F.col("g_chrom").alias("chrom"), F.col("gene").alias("region"), (F.col("g_st") - 60).alias("lo"), F.col("g_en").alias("hi"))
    return bp.region_summary(cells(spark, sf_dir), regions)


@query("merge_duplicates_sum", sql("r", "SELECT cluster, CAST(sum(en - st) AS BIGINT) AS n, arg_min(source, read_id) AS source, arg_min(type, read_id) AS type FROM r GROUP BY 1"))
def merge_duplicates_sum(spark, sf_dir):
    return bp.merge_duplicates_sum(inputs.reads(spark, sf_dir).withColumn("n", F.col("en") - F.col("st")), "cluster", ["n"], ["source", "type"], "read_id")


@query("nearest_value", sql("d", "SELECT source, pos, (SELECT arg_min(i, abs(v - pos) * 10 + i) FROM (VALUES (1, 24), (2, 100), (3, 400), (4, 650)) t(i, v)) AS nearest, (SELECT min(abs(v - pos)) FROM (VALUES (24), (100), (400), (650)) t(v)) AS distance FROM d"))
def nearest_value(spark, sf_dir):
    return bp.nearest_value(inputs.depth(spark, sf_dir), "pos", F.array(*[F.lit(x) for x in (24, 100, 400, 650)])).select("source", "pos", "nearest", "distance")


@query("bin_membership", sql("d", "SELECT source, pos, CASE WHEN pos BETWEEN 0 AND 699 THEN pos // 50 END AS bin FROM d"))
def bin_membership(spark, sf_dir):
    return inputs.depth(spark, sf_dir).select("source", "pos", F.when(F.col("pos").between(0, 699), F.floor(F.col("pos") / 50)).alias("bin"))


@query("union_positions", _cells('SELECT DISTINCT chrom, "left" AS pos FROM cells UNION SELECT chrom, "right" FROM cells'))
def union_positions(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.select("chrom", F.col("left").alias("pos")).union(c.select("chrom", "right")).distinct()


_SWEEP = "p AS (SELECT source, chrom, unnest(range(st, en + 1)) AS pos FROM b), dpt AS (SELECT source, chrom, pos, count(*) AS depth FROM p GROUP BY ALL), er AS (SELECT source, chrom, st + pk % (en - st + 3) AS pos, count(*) AS errors FROM b WHERE pk % 3 = 0 GROUP BY ALL)"


def swept(spark, sf_dir):
    """Depth of all blocks, and errors: every third block has a mismatch, some of them behind its end."""
    b = blocks(spark, sf_dir)
    wrong = b.filter(F.col("pk") % 3 == 0).select("source", "chrom", (F.col("st") + F.col("pk") % (F.col("en") - F.col("st") + 3)).alias("pos"))
    return dp.depth_by_position(b, ["source", "chrom"], mismatches=wrong)


@query("depth_by_position", sql("b", f"WITH {_SWEEP} SELECT source, chrom, pos, depth, coalesce(errors, 0) AS errors FROM dpt LEFT JOIN er USING (source, chrom, pos)"))
def depth_by_position(spark, sf_dir):
    return swept(spark, sf_dir)


@query("start_end_counts", sql("e", "SELECT source, chrom, 'start' AS kind, st AS pos, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT source, chrom, 'end', en, count(*) FROM e GROUP BY ALL"))
def start_end_counts(spark, sf_dir):
    return dp.start_end_counts(exons(spark, sf_dir), ["source", "chrom"])


@query("full_add_by_position", sql("b", f"WITH {_SWEEP} SELECT chrom, pos, CAST(sum(depth) AS BIGINT) AS depth, CAST(sum(coalesce(errors, 0)) AS BIGINT) AS errors FROM dpt LEFT JOIN er USING (source, chrom, pos) GROUP BY ALL"))
def full_add_by_position(spark, sf_dir):
    """The depths of three sources, each a frame with positions of its own."""
    d = swept(spark, sf_dir)
    return dp.full_add_by_position([d.filter(F.col("source") == s).drop("source") for s in ("s0", "s1", "s2")], ["chrom"])


@query("depth_groups", sql("b", f"WITH {_SWEEP}, x AS (SELECT chrom, CASE WHEN source IN ('s0', 's2') THEN 'even' ELSE source END AS grp, pos, depth, coalesce(errors, 0) AS errors FROM dpt LEFT JOIN er USING (source, chrom, pos)) SELECT chrom, coalesce(grp, 'all') AS grp, pos, CAST(sum(depth) AS BIGINT) AS depth, CAST(sum(errors) AS BIGINT) AS errors FROM x GROUP BY GROUPING SETS ((chrom, grp, pos), (chrom, pos))"))
def depth_groups(spark, sf_dir):
    """What scan_depth_store does with the rows of a store."""
    return files.depth_groups(swept(spark, sf_dir), "chrom", None, {"s0": "even", "s2": "even"}, True)


@query("zero_gaps", sql("d", "SELECT source, pos, CASE WHEN pos - lag(pos) OVER w > 1 OR lead(pos) OVER w - pos > 1 THEN 0 ELSE depth END AS depth FROM d WINDOW w AS (PARTITION BY source ORDER BY pos)"))
def zero_gaps(spark, sf_dir):
    return dp.zero_gaps(inputs.depth(spark, sf_dir), ["source"], 1).select("source", "pos", "depth")


@query("local_smooth", sql("d", "SELECT x.source, x.pos, round(CASE WHEN any_value(x.depth) = 0 THEN 0 ELSE sum((1 - (abs(y.pos - x.pos) / 6.0) ** 3) ** 3 * y.depth) / sum((1 - (abs(y.pos - x.pos) / 6.0) ** 3) ** 3) END, 6) AS smooth FROM d x JOIN d y ON x.source = y.source AND y.pos BETWEEN x.pos - 5 AND x.pos + 5 GROUP BY 1, 2"))
def local_smooth(spark, sf_dir):
    return dp.local_smooth(inputs.depth(spark, sf_dir), ["source"], 5).select("source", "pos", F.round("smooth", 6).alias("smooth"))


@query("difference_to_previous", sql("d", "SELECT source, pos, round(errors / depth - coalesce(lag(errors / depth) OVER w, lead(errors / depth) OVER w), 9) AS difference FROM d WINDOW w AS (PARTITION BY pos ORDER BY source)"))
def difference_to_previous(spark, sf_dir):
    d = inputs.depth(spark, sf_dir).withColumn("rate", F.col("errors") / F.col("depth"))
    return dp.difference_to_previous(d, "source", "pos", "rate").select("source", "pos", F.round("difference", 9).alias("difference"))


@query("depth_ratios", sql("d", "SELECT source, pos, errors / nullif(depth, 0) AS ratio FROM d"))
def depth_ratios(spark, sf_dir):
    return inputs.depth(spark, sf_dir).select("source", "pos", dp.depth_ratio(F.col("errors"), F.col("depth")).alias("ratio"))


@query("depth_per_million", sql("d", "SELECT source, pos, depth / ((sum(depth) OVER (PARTITION BY source)) / 1e6) AS per_million FROM d"))
def depth_per_million(spark, sf_dir):
    d = inputs.depth(spark, sf_dir)
    totals = F.broadcast(d.groupBy("source").agg(F.sum("depth").alias("total")))
    return d.join(totals, "source").select("source", "pos", (F.col("depth") / (F.col("total") / 1e6)).alias("per_million"))


@query("downsample_counts", sql("d", "SELECT source, pos, least(depth, 5) AS depth, CASE WHEN depth > 5 THEN CAST(floor(errors * 5 / depth) AS BIGINT) ELSE errors END AS errors FROM d"))
def downsample_counts(spark, sf_dir):
    depth, errors = dp.downsample(F.col("depth"), F.col("errors"), 5)
    return inputs.depth(spark, sf_dir).select("source", "pos", depth.cast("long").alias("depth"), errors.alias("errors"))


@query("depth_valley", sql("d", "WITH m AS (SELECT source, pos, CASE WHEN depth <= 2 THEN 0 ELSE depth END AS depth FROM d), z AS (SELECT *, min(CASE WHEN depth = 0 THEN pos END) OVER (PARTITION BY source) AS z, max(depth) OVER (PARTITION BY source) AS mx FROM m) SELECT source, any_value(z) AS zero_at, min(CASE WHEN pos > z AND depth > 0.1 * mx THEN pos END) AS rise_at FROM z GROUP BY 1"))
def depth_valley(spark, sf_dir):
    d = inputs.depth(spark, sf_dir).withColumn("depth", F.when(F.col("depth") <= 2, 0).otherwise(F.col("depth")))
    return dp.depth_valley(d, ["source"])


@query("absent_before", sql("d", "SELECT source, max(depth) FILTER (WHERE pos BETWEEN 300 AND 600) AS peak FROM (SELECT concat(source, pos % 9) AS source, pos, depth FROM d WHERE pos % 5 <> 0) GROUP BY source HAVING coalesce(max(depth) FILTER (WHERE pos > 280 AND pos < 300), 0) = 0 AND max(depth) FILTER (WHERE pos BETWEEN 300 AND 600) > 2"))
def absent_before(spark, sf_dir):
    d = inputs.depth(spark, sf_dir).filter("pos % 5 <> 0").withColumn("source", F.concat("source", F.col("pos") % 9))
    return dp.absent_before(d, ["source"], 300, 600, 280, 2)


@query("filter_position_range", sql("d", "SELECT * FROM d WHERE pos BETWEEN 100 AND 300"))
def filter_position_range(spark, sf_dir):
    return inputs.depth(spark, sf_dir).filter(F.col("pos").between(100, 300))


_TEST = "x AS (SELECT pos, depth AS d0, errors AS e0 FROM d WHERE source = 'click'), y AS (SELECT pos, depth AS d1, errors AS e1 FROM d WHERE source = 'view'), t AS (SELECT *, d0 + d1 + e0 + e1 AS n FROM x JOIN y USING (pos) WHERE d0 > 1 AND d1 > 1)"
_STAT = "n * (greatest(abs(d0 * e1 - d1 * e0) - least(n / 2, abs(d0 * e1 - d1 * e0)), 0.0) ** 2) / nullif((d0 + e0) * (d1 + e1) * (d0 + d1) * (e0 + e1), 0)"


def rounded(df):
    return df.select("pos", F.round("statistic", 9).alias("statistic"), F.round("p_value", 9).alias("p_value"))


@query("error_rate_test", sql("d", f"WITH {_TEST} SELECT pos, round({_STAT}, 9) AS statistic FROM t"))
def error_rate_test(spark, sf_dir):
    return rounded(rt.error_rate_test(inputs.depth(spark, sf_dir), ["click", "view"], 1)).drop("p_value")


@query("error_rate_p_values")
def error_rate_p_values(spark, sf_dir):
    """No SQL: the error function; p is held against plain Python."""
    return rt.error_rate_test(inputs.depth(spark, sf_dir), ["click", "view"], 1)


_LOGS = "lgamma(d0 + d1 + 1) + lgamma(e0 + e1 + 1) + lgamma(d0 + e0 + 1) + lgamma(d1 + e1 + 1) - lgamma(n + 1)"


@query("error_rate_fisher", sql("d", f"WITH {_TEST}, k AS (SELECT *, unnest(range(greatest(0, d0 + d1 - d1 - e1), least(d0 + d1, d0 + e0) + 1)) AS a FROM t), l AS (SELECT pos, a = d0 AS own, exp({_LOGS} - lgamma(a + 1) - lgamma(d0 + d1 - a + 1) - lgamma(d0 + e0 - a + 1) - lgamma(e0 + e1 - d0 - e0 + a + 1)) AS p FROM k), o AS (SELECT pos, max(CASE WHEN own THEN p END) AS seen FROM l GROUP BY 1) SELECT pos, NULL::DOUBLE AS statistic, round(least(1.0, sum(p)), 9) AS p_value FROM l JOIN o USING (pos) WHERE p <= seen * (1 + 1e-7) GROUP BY 1"))
def error_rate_fisher(spark, sf_dir):
    return rounded(rt.error_rate_test(inputs.depth(spark, sf_dir), ["click", "view"], 1, "fisher"))


_THREE = ", ".join(f"max(CASE WHEN source = '{s}' THEN depth END) AS d{i}, max(CASE WHEN source = '{s}' THEN errors END) AS e{i}" for i, s in enumerate(("click", "purchase", "view")))


@query("error_rate_samples", sql("d", f"WITH w AS (SELECT pos, {_THREE} FROM d GROUP BY 1), t AS (SELECT *, d0 + d1 + d2 AS sd, e0 + e1 + e2 AS se, d0 + d1 + d2 + e0 + e1 + e2 AS n FROM w WHERE d0 > 1 AND d1 > 1 AND d2 > 1), s AS (SELECT pos, (" + " + ".join(f"(d{i} - sd * (d{i} + e{i})::DOUBLE / n) ** 2 / (d{i} + e{i})" for i in range(3)) + ") * n * (1.0 / sd + 1.0 / nullif(se, 0)) AS statistic FROM t) SELECT pos, round(statistic, 9) AS statistic, round(exp(-statistic / 2), 9) AS p_value FROM s"))
def error_rate_samples(spark, sf_dir):
    """Three samples: two degrees of freedom."""
    return rounded(rt.error_rate_test(inputs.depth(spark, sf_dir), ["click", "purchase", "view"], 1))


@query("bh_adjust", sql("d", "WITH p AS (SELECT source || ':' || pos AS id, (errors + 1) / (depth + 2) AS p FROM d), k AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM p), w AS (SELECT *, p * m / r AS raw FROM k) SELECT id, round(p, 9) AS p, round(least(1.0, min(raw) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS padj FROM w"))
def bh_adjust(spark, sf_dir):
    d = inputs.depth(spark, sf_dir).select(F.concat_ws(":", "source", F.col("pos").cast("string")).alias("id"), ((F.col("errors") + 1) / (F.col("depth") + 2)).alias("p"))
    return dp.bh_adjust(d, "p", "id").select("id", F.round("p", 9).alias("p"), F.round("padj", 9).alias("padj"))


@query("top_p_values", sql("d", "WITH p AS (SELECT source || ':' || pos AS id, (errors + 1) / (depth + 2) AS p FROM d), c AS (SELECT least(0.2, max(p)) AS cut FROM (SELECT p FROM p ORDER BY p LIMIT 20)) SELECT id, p FROM p, c WHERE p <= cut"))
def top_p_values(spark, sf_dir):
    d = inputs.depth(spark, sf_dir).select(F.concat_ws(":", "source", F.col("pos").cast("string")).alias("id"), ((F.col("errors") + 1) / (F.col("depth") + 2)).alias("p"))
    cut = F.broadcast(d.select("p").orderBy("p").limit(20).agg(F.least(F.lit(0.2), F.max("p")).alias("cut")))
    return d.crossJoin(cut).filter("p <= cut").select("id", "p")


@query("sample_correlation", sql("d", "SELECT x.source AS source_a, y.source AS source_b, round(corr(x.depth, y.depth), 9) AS r FROM d x JOIN d y USING (pos) WHERE pos BETWEEN 0 AND 500 GROUP BY ALL"))
def sample_correlation(spark, sf_dir):
    return dp.sample_correlation(inputs.depth(spark, sf_dir), 0, 500).withColumn("r", F.round("r", 9))


@query("cumulative_share", sql("d", "SELECT source, pos, CAST(sum(depth) OVER (PARTITION BY source ORDER BY pos) AS BIGINT) AS running FROM d"))
def cumulative_share(spark, sf_dir):
    return dp.cumulative_share(inputs.depth(spark, sf_dir), ["source"]).select("source", "pos", "running")


@query("top_clusters_by_peak", sql("d", "SELECT d.* FROM d SEMI JOIN (SELECT source FROM d GROUP BY 1 ORDER BY max(depth) DESC, source LIMIT 2) t USING (source)"))
def top_clusters_by_peak(spark, sf_dir):
    d = inputs.depth(spark, sf_dir)
    top = d.groupBy("source").agg(F.max("depth").alias("peak")).orderBy(F.desc("peak"), "source").limit(2)
    return d.join(F.broadcast(top), "source", "left_semi")

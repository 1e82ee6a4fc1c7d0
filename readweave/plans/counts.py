"""Queries over count matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as ct
from ..operators import rates as rt
from ..operators import structure as st
from ..registry import query
from .inputs import counts, reads, sql, table

SAMPLES = ["click", "error", "purchase", "signup", "view"]
_WIDE = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE sample = '{s}'), 0) AS BIGINT) AS {s}" for s in SAMPLES)
_T = "t AS (SELECT sample, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1)"
_M = "m AS (SELECT concat('u', id % 7, '_u', id % 3, ',g', id) AS id, sample, n FROM c)"


def named(spark, sf_dir):
    """Counts whose ids are keys: u<digit>_u<digit>,g<number>."""
    i = F.col("id")
    return counts(spark, sf_dir).select(F.concat(F.lit("u"), i % 7, F.lit("_u"), i % 3, F.lit(",g"), i).alias("id"), "sample", "n")


@query("sample_totals", sql("c", f"WITH {_T} SELECT * FROM t"))
def sample_totals(spark, sf_dir):
    return ct.sample_totals(counts(spark, sf_dir))


@query("lookup_totals", sql("c", f"WITH {_T} SELECT id, sample, n, total FROM c LEFT JOIN t USING (sample)"))
def lookup_totals(spark, sf_dir):
    c = counts(spark, sf_dir)
    return ct.lookup_totals(c, ct.sample_totals(c)).select("id", "sample", "n", "total")


@query("tpm", sql("c", f"WITH {_T} SELECT id, sample, n, round(n * 1e6 / total, 6) AS tpm FROM c JOIN t USING (sample)"))
def tpm(spark, sf_dir):
    return ct.tpm(counts(spark, sf_dir)).withColumn("tpm", F.round("tpm", 6))


@query("filter_any_sample_over", sql("c", "SELECT * FROM c WHERE id IN (SELECT id FROM c GROUP BY 1 HAVING max(n) > 4)"))
def filter_any_sample_over(spark, sf_dir):
    return ct.filter_any_sample_over(counts(spark, sf_dir), 4)


@query("filter_row_total", sql("c", "SELECT * FROM c WHERE id IN (SELECT id FROM c GROUP BY 1 HAVING sum(n) > 1.5 * (SELECT count(DISTINCT sample) FROM c) AND sum(n) >= 5)"))
def filter_row_total(spark, sf_dir):
    return ct.filter_row_total(counts(spark, sf_dir), 1.5, 5)


@query("top_ids", sql("c", "SELECT * FROM c WHERE id IN (SELECT id FROM c GROUP BY 1 ORDER BY sum(n) DESC, id LIMIT 20)"))
def top_ids(spark, sf_dir):
    return ct.top_ids(counts(spark, sf_dir), 20)


@query("widen", sql("c", f"SELECT id, {_WIDE} FROM c GROUP BY 1"))
def widen(spark, sf_dir):
    return ct.widen(counts(spark, sf_dir), SAMPLES)


@query("melt", sql("c", f"WITH w AS (SELECT id, {_WIDE} FROM c GROUP BY 1) UNPIVOT w ON {', '.join(SAMPLES)} INTO NAME sample VALUE n").replace(") UNPIVOT", ") SELECT id, sample, n FROM (UNPIVOT").__add__(")"))
def melt(spark, sf_dir):
    return ct.melt(ct.widen(counts(spark, sf_dir), SAMPLES), SAMPLES)


@query("sum_matched", sql("c", f"WITH {_M} SELECT sample, CAST(sum(n) AS BIGINT) AS total FROM m WHERE regexp_matches(id, '^u[12]_') GROUP BY 1"))
def sum_matched(spark, sf_dir):
    c = named(spark, sf_dir)
    return ct.sample_totals(c.filter(F.col("id").rlike("^u[12]_")))


@query("select_or", sql("c", f"WITH {_M} SELECT DISTINCT id FROM m WHERE regexp_matches(id, 'g1$') OR regexp_matches(id, '^u3')"))
def select_or(spark, sf_dir):
    return ct.select_or(named(spark, sf_dir), ["g1$", "^u3"])


@query("select_and", sql("c", f"WITH {_M} SELECT DISTINCT id FROM m WHERE regexp_matches(id, '_u1') AND regexp_matches(id, '^u3')"))
def select_and(spark, sf_dir):
    return ct.select_and(named(spark, sf_dir), ["_u1", "^u3"])


@query("select_and_not", sql("c", f"WITH {_M} SELECT DISTINCT id FROM m WHERE regexp_matches(id, '^u3') AND NOT regexp_matches(id, '_u1')"))
def select_and_not(spark, sf_dir):
    return ct.select_and_not(named(spark, sf_dir), "^u3", ["_u1"])


@query("select_terms", sql("kr", "SELECT read_id, cluster_key FROM kr WHERE len(cluster_key) - len(replace(cluster_key, ',', '')) > 1 OR regexp_matches(cluster_key, 'NATION_7') OR (st > 1500 AND en < 2500)"))
def select_terms(spark, sf_dir):
    from .clusters import keyed

    k = F.col("cluster_key")
    kind = st.end_type(F.col("st"), F.col("en"), 1500, 2500)
    chosen = ct.term(k, kind, "juncts>1") | ct.term(k, kind, "NATION_7") | ct.term(k, kind, "non5") & ct.term(k, kind, "non3")
    return keyed(spark, sf_dir).filter(chosen).select("read_id", "cluster_key")


@query("junctions", sql("k", "SELECT read_id, CAST(len(cluster_key) - len(replace(cluster_key, ',', '')) AS INTEGER) AS junctions FROM k"))
def junctions(spark, sf_dir):
    from .clusters import keyed

    return keyed(spark, sf_dir).select("read_id", ct.junctions(F.col("cluster_key")).alias("junctions"))


@query("category_index", sql("k", "SELECT CAST(len(cluster_key) - len(replace(cluster_key, ',', '')) AS INTEGER) AS junctions, count(DISTINCT cluster_key) AS keys, count(*) AS n FROM k GROUP BY 1"))
def category_index(spark, sf_dir):
    from .clusters import keyed

    return keyed(spark, sf_dir).groupBy(ct.junctions(F.col("cluster_key")).alias("junctions")).agg(F.count_distinct("cluster_key").alias("keys"), F.count("*").alias("n"))


@query("group_by_regex", sql("c", f"WITH {_M} SELECT CASE WHEN regexp_matches(id, '_u1') THEN '_u1' ELSE '! _u1' END AS grp, sample, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1, 2"))
def group_by_regex(spark, sf_dir):
    return ct.group_by_regex(named(spark, sf_dir), "_u1")


@query("merge_by_patterns", sql("c", f"WITH {_M}, l AS (SELECT *, CASE WHEN regexp_matches(id, '^u1') THEN '^u1' WHEN regexp_matches(id, '_u2') THEN '_u2' END AS grp FROM m) SELECT grp, sample, CAST(sum(n) AS BIGINT) AS n FROM l WHERE grp IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT id, sample, n FROM l WHERE grp IS NULL AND id IN (SELECT id FROM l WHERE grp IS NULL GROUP BY 1 ORDER BY sum(n) DESC, id LIMIT 5)"))
def merge_by_patterns(spark, sf_dir):
    return ct.merge_by_patterns(named(spark, sf_dir), ["^u1", "_u2"], 5)


_F = "l AS (SELECT id, sample, ln(n) AS l, count(*) OVER (PARTITION BY id) AS k, avg(ln(n)) OVER (PARTITION BY id) AS m FROM c), f AS (SELECT sample, exp(median(l - m)) AS factor FROM l WHERE k = (SELECT count(DISTINCT sample) FROM c) GROUP BY 1)"


@query("size_factor_normalise", sql("c", f"WITH {_F} SELECT id, sample, round(n / factor, 6) AS norm FROM c LEFT JOIN f USING (sample)"))
def size_factor_normalise(spark, sf_dir):
    return ct.size_factor_normalise(counts(spark, sf_dir)).withColumn("norm", F.round("norm", 6))


_Z = "z AS (SELECT id, coalesce(sum(n) FILTER (WHERE sample IN ('click', 'view')), 0) / 2 AS mean_a, 2 - count(*) FILTER (WHERE sample IN ('click', 'view')) AS zeros_a, coalesce(sum(n) FILTER (WHERE sample IN ('error', 'signup')), 0) / 2 AS mean_b, 2 - count(*) FILTER (WHERE sample IN ('error', 'signup')) AS zeros_b FROM c GROUP BY 1)"


@query("group_zero_counts", sql("c", f"WITH {_Z} SELECT *, mean_b - mean_a AS difference FROM z"))
def group_zero_counts(spark, sf_dir):
    return ct.group_zero_counts(counts(spark, sf_dir), ["click", "view"], ["error", "signup"])


# results of a comparison as a test would leave them: p by id comes with the table
_P = "pv AS (SELECT user_id AS id, (count(*) FILTER (WHERE value > 50) + 1) / (count(*) + 2) AS p FROM events GROUP BY 1)"
_DE = f"{_Z}, {_P}, rs AS (SELECT z.*, p, CASE WHEN mean_a > 0 AND mean_b > 0 THEN log2(mean_b / mean_a) END AS log2fc FROM z JOIN pv USING (id)), rk AS (SELECT *, p * count(*) OVER () / (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS raw FROM rs), ad AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS padj FROM rk)"


def results(spark, sf_dir):
    """Ids with means and zeros of two groups, p as it came, and log2 of the fold change (null where a mean is 0)."""
    p = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(((F.count_if(F.col("value") > 50) + 1) / (F.count("*") + 2)).alias("p"))
    groups = ct.group_zero_counts(counts(spark, sf_dir), ["click", "view"], ["error", "signup"])
    fold = F.when((F.col("mean_a") > 0) & (F.col("mean_b") > 0), F.log2(F.col("mean_b") / F.col("mean_a")))
    return groups.join(p, "id").withColumn("log2fc", fold)


@query("reversed_flags", sql("c", f"WITH {_DE} SELECT id, zeros_a > 0 AND zeros_b > 0 AS spurious, coalesce(sign(mean_b - mean_a) * sign(log2fc + 0.5) < 0, false) AS reversed FROM rs"))
def reversed_flags(spark, sf_dir):
    """Against fold changes that are half a step too high."""
    return ct.reversed_flags(results(spark, sf_dir).withColumn("log2fc", F.col("log2fc") + 0.5)).select("id", "spurious", "reversed")


@query("classify_de", sql("c", f"WITH {_DE} SELECT id, CASE WHEN zeros_a > 0 AND zeros_b > 0 THEN 'spurious' WHEN padj <= 0.9 AND log2fc >= 0.5 THEN 'up' WHEN padj <= 0.9 AND log2fc <= -0.5 THEN 'down' ELSE 'none' END AS class FROM ad WHERE id % 10 <> 3"))
def classify_de(spark, sf_dir):
    own = ct.with_padj(results(spark, sf_dir))
    return ct.classify(own, 0.9, 0.5, spurious="zeros_a > 0 AND zeros_b > 0", exclude="id % 10 = 3").select("id", "class")


@query("classify_de_by_p", sql("c", f"WITH {_DE} SELECT id, CASE WHEN p <= 0.4 AND log2fc >= 0.5 THEN 'up' WHEN p <= 0.4 AND log2fc <= -0.5 THEN 'down' ELSE 'none' END AS class FROM rs"))
def classify_de_by_p(spark, sf_dir):
    return ct.classify(results(spark, sf_dir), 0.4, 0.5, by="p").select("id", "class")


Z = rt.normal_quantile(0.95)
_CI = f"p AS (SELECT id, sample, n, total, n / total AS share FROM c JOIN t USING (sample)), ci AS (SELECT *, ({Z} * {Z}) AS z2 FROM p)"


@query("binomial_ci", sql("c", f"WITH {_T}, {_CI} SELECT id, sample, round(share, 9) AS share, round((share + z2 / (2 * total) - {Z} * sqrt(share * (1 - share) / total + z2 / (4 * total * total))) / (1 + z2 / total), 9) AS lower, round((share + z2 / (2 * total) + {Z} * sqrt(share * (1 - share) / total + z2 / (4 * total * total))) / (1 + z2 / total), 9) AS upper FROM ci"))
def binomial_ci(spark, sf_dir):
    c = counts(spark, sf_dir)
    share, lower, upper = rt.interval(F.col("n"), F.col("total"))
    return ct.lookup_totals(c, ct.sample_totals(c)).select("id", "sample", F.round(share, 9).alias("share"), F.round(lower, 9).alias("lower"), F.round(upper, 9).alias("upper"))


@query("log_ratio", sql("c", f"WITH {_T} SELECT id, sample, round(-log2(n / total), 6) AS log_ratio FROM c JOIN t USING (sample)"))
def log_ratio(spark, sf_dir):
    c = counts(spark, sf_dir)
    return ct.lookup_totals(c, ct.sample_totals(c)).select("id", "sample", F.round(ct.log_ratio(F.col("n") / F.col("total")), 6).alias("log_ratio"))


@query("comparison_pairs", sql("c", "SELECT DISTINCT 'click' AS base, sample AS other FROM c WHERE sample <> 'click'"))
def comparison_pairs(spark, sf_dir):
    return ct.comparison_pairs(counts(spark, sf_dir), "click")


@query("paired_abundance", sql("c", f"WITH w AS (SELECT id, {_WIDE} FROM c WHERE sample IN ('click', 'view') GROUP BY 1) SELECT id, click + 0.5::DOUBLE AS x, view + 0.5::DOUBLE AS y FROM w WHERE click + view >= 3 ORDER BY click + view DESC, id LIMIT 100"))
def paired_abundance(spark, sf_dir):
    return ct.paired_abundance(counts(spark, sf_dir), "click", "view", 0.5, 3, 100)


@query("xy_self_join", sql("c", "SELECT a.id, a.n AS n_x, b.n AS n_y FROM c a JOIN c b ON a.id = b.id AND a.sample = 'click' AND b.sample = 'view'"))
def xy_self_join(spark, sf_dir):
    c = counts(spark, sf_dir)
    x, y = (c.filter(F.col("sample") == s).select("id", F.col("n").alias(f"n_{k}")) for s, k in (("click", "x"), ("view", "y")))
    return x.join(y, "id")


@query("merge_inner", sql("c", "SELECT a.id, a.n AS a, b.n AS b FROM c a JOIN c b ON a.id = b.id AND a.sample = 'error' AND b.sample = 'signup'"))
def merge_inner(spark, sf_dir):
    c = counts(spark, sf_dir)
    a, b = (c.filter(F.col("sample") == s).select("id", F.col("n").alias(k)) for s, k in (("error", "a"), ("signup", "b")))
    return a.join(b, "id")


@query("merge_outer", sql("c", "SELECT id, coalesce(max(n) FILTER (WHERE sample = 'click'), 0) AS a, coalesce(max(n) FILTER (WHERE sample = 'view'), 0) AS b FROM c WHERE sample IN ('click', 'view') GROUP BY 1"))
def merge_outer(spark, sf_dir):
    c = counts(spark, sf_dir)
    return ct.merge_outer({"a": c.filter("sample = 'click'"), "b": c.filter("sample = 'view'")}, ["id"], "n")


@query("union_schema", sql("c", "SELECT id, n AS click, NULL::BIGINT AS view FROM c WHERE sample = 'click' UNION ALL SELECT id, NULL, n FROM c WHERE sample = 'view'"))
def union_schema(spark, sf_dir):
    c = counts(spark, sf_dir)
    return ct.stack_frames([c.filter(F.col("sample") == s).select("id", F.col("n").alias(s)) for s in ("click", "view")])


@query("stack_frames", sql("c", "SELECT * FROM c"))
def stack_frames(spark, sf_dir):
    c = counts(spark, sf_dir)
    return ct.stack_frames([c.filter(F.col("sample") == s) for s in SAMPLES])


@query("expand_sample_name", sql("c", "SELECT DISTINCT sample, sample AS molecule, 'vero' AS cell, concat(len(sample), 'hpi') AS time, CAST(len(sample) AS INTEGER) AS hours, concat(sample, '_vero') AS molecule_cell, concat('vero_', len(sample), 'hpi') AS cell_time FROM c"))
def expand_sample_name(spark, sf_dir):
    s = counts(spark, sf_dir).select("sample").distinct()
    whole = F.concat_ws("_", "sample", F.lit("vero"), F.concat(F.length("sample"), F.lit("hpi")))
    return s.select("sample", *[v.alias(k) for k, v in ct.expand_sample_name(whole).items()])


_PARTS = "p AS (SELECT DISTINCT sample, concat(CASE WHEN sample < 'm' THEN 'RNA' ELSE 'cDNA' END, '_', CASE len(sample) % 2 WHEN 0 THEN 'vero' ELSE 'calu' END, '_', len(sample), 'hpi') AS name FROM c)"


@query("order_samples", sql("c", f"WITH {_PARTS}, s AS (SELECT sample, string_split(name, '_') AS w, len(sample) AS h FROM p) SELECT sample, CAST(row_number() OVER (ORDER BY h, w[2], w[1], sample) AS INTEGER) AS by_time, CAST(row_number() OVER (ORDER BY w[2], h, w[1], sample) AS INTEGER) AS by_cell, CAST(row_number() OVER (ORDER BY w[1], w[2], h, sample) AS INTEGER) AS by_molecule, CAST(row_number() OVER (ORDER BY h DESC, w[2] DESC, w[1] DESC, sample DESC) AS INTEGER) AS reversed FROM s"))
def order_samples(spark, sf_dir):
    name = F.concat(F.when(F.col("sample") < "m", "RNA").otherwise("cDNA"), F.lit("_"), F.when(F.length("sample") % 2 == 0, "vero").otherwise("calu"), F.lit("_"), F.length("sample"), F.lit("hpi"))
    s = counts(spark, sf_dir).select("sample").distinct().withColumn("name", name)  # a row for each sample
    kinds = {"by_time": ("time", False), "by_cell": ("cell", False), "by_molecule": ("molecule", False), "reversed": ("time", True)}
    return s.select("sample", *[ct.sample_rank(F.col("name"), F.col("sample"), by, back).alias(k) for k, (by, back) in kinds.items()])


@query("scan_sample_decode", sql("c", "SELECT DISTINCT sample, CASE sample WHEN 'click' THEN 'RNA_click_0hpi' ELSE concat('cDNA_', sample, '_24hpi') END AS alias FROM c"))
def scan_sample_decode(spark, sf_dir):
    names = spark.createDataFrame([("click", "RNA_click_0hpi")], "sample string, known string")
    s = counts(spark, sf_dir).select("sample").distinct().join(F.broadcast(names), "sample", "left")
    return s.select("sample", ct.decoded(F.col("sample"), F.col("known")).alias("alias"))


@query("rename_ids", sql("c", f"WITH {_M} SELECT DISTINCT id, CASE WHEN split_part(split_part(id, ',', 1), '_', 1) = split_part(split_part(id, ',', 1), '_', 2) THEN replace(split_part(split_part(id, ',', 1), '_', 1), 'u', 'w') ELSE replace(split_part(id, ',', 1), 'u', 'w') END || ',' || split_part(id, ',', 2) AS renamed FROM m"))
def rename_ids(spark, sf_dir):
    return named(spark, sf_dir).select("id", ct.rename_ids(F.col("id"), {"u": "w"}).alias("renamed")).distinct()


@query("frequency_table", "SELECT 'none' AS value, 0::BIGINT AS n UNION ALL SELECT event_type, count(*) FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def frequency_table(spark, sf_dir):
    return ct.frequency_table(table(spark, sf_dir, "events"), "event_type", ["view", "click", "none"])


@query("sum_by_level", sql("r", "SELECT cluster, type, count(*) FILTER (WHERE source = 'F') + 1 AS f, count(*) FILTER (WHERE source = 'O') + 1 AS o FROM r GROUP BY 1, 2 HAVING count(*) > 3"))
def sum_by_level(spark, sf_dir):
    total = F.count("*")
    found = reads(spark, sf_dir).groupBy("cluster", "type").agg((F.count_if(F.col("source") == "F") + 1).alias("f"), (F.count_if(F.col("source") == "O") + 1).alias("o"), total.alias("_n"))
    return found.filter("_n > 3").drop("_n")


@query("order_by_padj", sql("c", f"WITH {_DE} SELECT id, round(log2fc, 9) AS log2fc, round(padj, 9) AS padj FROM ad ORDER BY padj NULLS LAST, id"))
def order_by_padj(spark, sf_dir):
    return ct.with_padj(results(spark, sf_dir)).orderBy(F.asc_nulls_last("padj"), "id").select("id", F.round("log2fc", 9).alias("log2fc"), F.round("padj", 9).alias("padj"))

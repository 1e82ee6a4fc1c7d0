"""Queries over read and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import intervals as iv
from ..operators import tables as tb
from ..registry import query
from .inputs import blocks, depth, genes, reads, sql
from .structure import exons

_FLAG = "fl AS (SELECT *, CASE blk % 4 WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 256 ELSE 2048 END AS flag FROM b)"


def flagged(spark, sf_dir):
    m = F.col("blk") % 4
    return blocks(spark, sf_dir).withColumn("flag", F.when(m == 0, 4).when(m == 1, 0).when(m == 2, 256).otherwise(2048))


@query("filter_mapped", sql("b", f"WITH {_FLAG} SELECT read_id, blk, pk, flag FROM fl WHERE flag & 4 = 0"))
def filter_mapped(spark, sf_dir):
    return tb.filter_mapped(flagged(spark, sf_dir)).select("read_id", "blk", "pk", "flag")


@query("filter_chroms", sql("b", "SELECT read_id, chrom, st FROM b WHERE chrom = 'c1' AND st BETWEEN 1200 AND 2000"))
def filter_chroms(spark, sf_dir):
    return tb.filter_chroms(blocks(spark, sf_dir), ["c0", "c1"], ["c0"], {"c1": (1200, 2000)}).select("read_id", "chrom", "st")


@query("filter_mapq", sql("b", "SELECT read_id, pk, mapq FROM b WHERE mapq >= 5"))
def filter_mapq(spark, sf_dir):
    return blocks(spark, sf_dir).filter("mapq >= 5").select("read_id", "pk", "mapq")


@query("filter_primary", sql("b", f"WITH {_FLAG}, w AS (SELECT *, lag(chrom) OVER (PARTITION BY read_id ORDER BY blk, st, en, pk) AS before FROM fl) SELECT read_id, blk, st, pk, flag FROM w WHERE flag & 2304 = 0 OR (flag & 2048 <> 0 AND mapq >= 4 AND before = chrom)"))
def filter_primary(spark, sf_dir):
    return tb.filter_primary(flagged(spark, sf_dir), ["blk", "st", "en", "pk"], 4).select("read_id", "blk", "st", "pk", "flag")


@query("filter_name_contains", sql("r", "SELECT read_id FROM r WHERE contains(CAST(read_id AS VARCHAR), '17')"))
def filter_name_contains(spark, sf_dir):
    return reads(spark, sf_dir).filter(F.col("read_id").cast("string").contains("17")).select("read_id")


@query("limit_reads", sql("r", "SELECT read_id, st FROM r ORDER BY read_id LIMIT 100"))
def limit_reads(spark, sf_dir):
    return reads(spark, sf_dir).orderBy("read_id").limit(100).select("read_id", "st")


@query("sample_reads", sql("r", "SELECT read_id, cluster, source, type, st, en FROM r WHERE (CAST(concat('0x', substr(md5(CAST(read_id AS VARCHAR)), 1, 8)) AS BIGINT)) % 1000000 < 250000"))
def sample_reads(spark, sf_dir):
    return tb.sample_reads(reads(spark, sf_dir), "read_id", 0.25)


@query("table_filter_eq", sql("r", "SELECT * FROM r WHERE source = 'F'"))
def table_filter_eq(spark, sf_dir):
    return reads(spark, sf_dir).filter("source = 'F'")


@query("table_limit", sql("r", "SELECT read_id, st FROM r WHERE st >= 1500 AND st <= 1900"))
def table_limit(spark, sf_dir):
    return tb.table_limit(reads(spark, sf_dir), "st", 1500, 1900).select("read_id", "st")


@query("table_project", sql("r", "SELECT type FROM r"))
def table_project(spark, sf_dir):
    return reads(spark, sf_dir).select("type")


@query("table_distinct", sql("r", "SELECT DISTINCT type FROM r"))
def table_distinct(spark, sf_dir):
    return reads(spark, sf_dir).select("type").distinct()


@query("table_replace", sql("r", "SELECT read_id, CASE source WHEN 'F' THEN 'full' WHEN 'O' THEN 'open' ELSE source || ';x' END AS source FROM r"))
def table_replace(spark, sf_dir):
    names = spark.createDataFrame([("F", "full"), ("O", "open")], "old string, new string")
    rows = reads(spark, sf_dir).select("read_id", F.concat("source", F.lit(";x")).alias("source"))
    return tb.table_replace(rows, "source", names)


@query("table_sort", sql("r", "SELECT read_id, en FROM r ORDER BY en DESC, read_id"))
def table_sort(spark, sf_dir):
    return reads(spark, sf_dir).orderBy(F.desc("en"), "read_id").select("read_id", "en")


@query("read_list_semi", sql("r b", "SELECT read_id, st FROM r WHERE read_id IN (SELECT read_id FROM b WHERE mapq >= 9)"))
def read_list_semi(spark, sf_dir):
    return reads(spark, sf_dir).join(blocks(spark, sf_dir).filter("mapq >= 9").select("read_id"), "read_id", "left_semi").select("read_id", "st")


@query("pool_tag", sql("r b", "WITH p AS (SELECT read_id, min(source) AS pool FROM b WHERE mapq >= 9 GROUP BY 1) SELECT r.read_id, coalesce(pool || '.', '') || cluster AS cluster FROM r LEFT JOIN p ON r.read_id = p.read_id"))
def pool_tag(spark, sf_dir):
    pools = blocks(spark, sf_dir).filter("mapq >= 9").groupBy("read_id").agg(F.min("source").alias("pool"))
    return tb.pool_tag(reads(spark, sf_dir).select("read_id", "cluster"), pools, "cluster")


_GROUPS = "g AS (SELECT type, string_agg(cluster, ';' ORDER BY cluster) AS ids, count(*) AS k FROM (SELECT type, cluster FROM r GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1)"


@query("extract_clusters", sql("r", f"WITH {_GROUPS}, x AS (SELECT concat(type, '_', k) AS label, unnest(string_split(ids, ';')) AS id FROM g) SELECT label, read_id FROM x JOIN r ON CAST(r.cluster AS VARCHAR) = x.id"))
def extract_clusters(spark, sf_dir):
    r = reads(spark, sf_dir)
    big = r.groupBy("type", "cluster").agg(F.count("*").alias("n")).filter("n >= 5")
    groups = big.groupBy("type").agg(F.array_join(F.array_sort(F.collect_set(F.col("cluster").cast("string"))), ";").alias("ids"))
    return tb.extract_clusters(r.select("read_id", "cluster"), groups, ["type"]).select("label", "read_id")


@query("merge_by_type_extract", sql("r", "WITH k AS (SELECT type, cluster, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 5) SELECT r.type, r.cluster, n, read_id FROM r JOIN k ON r.type = k.type AND r.cluster = k.cluster"))
def merge_by_type_extract(spark, sf_dir):
    r = reads(spark, sf_dir)
    big = r.groupBy("type", "cluster").agg(F.count("*").alias("n")).filter("n >= 5")
    return r.join(big, ["type", "cluster"]).select("type", "cluster", "n", "read_id")


@query("union_reads", sql("r", "SELECT read_id, 'first' AS source FROM r WHERE source = 'F' UNION ALL SELECT read_id, 'second' FROM r WHERE source = 'O'"))
def union_reads(spark, sf_dir):
    r = reads(spark, sf_dir)
    parts = [r.filter(F.col("source") == s).select("read_id", F.lit(n).alias("source")) for s, n in (("F", "first"), ("O", "second"))]
    return parts[0].unionByName(parts[1])


@query("length_histogram", sql("r", "SELECT source, CAST(floor((en - st) / 25) * 25 AS BIGINT) AS bin, count(*) AS n FROM r GROUP BY 1, 2"))
def length_histogram(spark, sf_dir):
    return tb.histogram(reads(spark, sf_dir), ["source"], F.col("en") - F.col("st"), 25)


@query("position_histogram", sql("r", "SELECT source, bin, n, round(n * 1e6 / sum(n) OVER (PARTITION BY source), 6) AS per_million FROM (SELECT source, CAST(floor(st / 100) * 100 AS BIGINT) AS bin, count(*) AS n FROM r GROUP BY 1, 2)"))
def position_histogram(spark, sf_dir):
    found = tb.histogram(reads(spark, sf_dir), ["source"], F.col("st"), 100)
    return found.withColumn("per_million", F.round(F.col("n") * 1e6 / F.sum("n").over(W.partitionBy("source")), 6))


@query("error_distribution", sql("d", "SELECT source, " + ", ".join(f"round(quantile_cont(errors / depth, {s}), 9) AS q{round(s * 100)}" for s in (0.25, 0.5, 0.75)) + " FROM d GROUP BY 1"))
def error_distribution(spark, sf_dir):
    found = tb.quantiles(depth(spark, sf_dir), ["source"], F.col("errors") / F.col("depth"))
    return found.select("source", *[F.round(c, 9).alias(c) for c in ("q25", "q50", "q75")])


@query("filter_second_quality", sql("a e rd b", "WITH q AS (SELECT read_id, min(mapq) AS mapq FROM b GROUP BY 1), h AS (SELECT DISTINCT read_id FROM e JOIN a ON g_chrom = chrom AND (st BETWEEN g_st - 5 AND g_en + 5 OR en BETWEEN g_st - 5 AND g_en + 5)) SELECT read_id, mapq FROM q WHERE mapq >= 3 OR read_id IN (SELECT read_id FROM h)"))
def filter_second_quality(spark, sf_dir):
    q = blocks(spark, sf_dir).groupBy("read_id").agg(F.min("mapq").alias("mapq"))
    return tb.filter_second_quality(q, iv.gene_span(exons(spark, sf_dir), genes(spark, sf_dir)), 3)


_LEFT, _RIGHT = r"^(NATION_[0-9]+|st\.c[01])", r"(NATION_[0-9]+|end\.c[01]|st\.c[01])$"


def transcripts(spark, sf_dir):
    """Reads with the first and the last label of their key."""
    from .clusters import keyed

    return keyed(spark, sf_dir).withColumn("left_gene", F.regexp_extract("cluster_key", _LEFT, 1)).withColumn("right_gene", F.regexp_extract("cluster_key", _RIGHT, 1))


_TRANSCRIPTS = f"t AS (SELECT *, regexp_extract(cluster_key, '{_LEFT}', 1) AS left_gene, regexp_extract(cluster_key, '{_RIGHT}', 1) AS right_gene FROM kr)"


@query("filter_transcripts", sql("kr", f"WITH {_TRANSCRIPTS} SELECT read_id, st, en, left_gene, right_gene FROM t WHERE st < 1500 AND 4000 - en >= 500 AND right_gene = 'NATION_22'"))
def filter_transcripts(spark, sf_dir):
    return tb.filter_transcripts(transcripts(spark, sf_dir), 4000, 1500, 500, (True, False), right="NATION_22").select("read_id", "st", "en", "left_gene", "right_gene")


@query("filter_transcripts_left", sql("kr", f"WITH {_TRANSCRIPTS} SELECT read_id, st, en, left_gene, right_gene FROM t WHERE left_gene = 'NATION_1' AND st >= 1150"))
def filter_transcripts_left(spark, sf_dir):
    return tb.filter_transcripts(transcripts(spark, sf_dir), 4000, 1150, None, (False, True), left="NATION_1").select("read_id", "st", "en", "left_gene", "right_gene")


@query("split_transcripts", sql("kr", "WITH l AS (SELECT n_exons - 1 AS n, ens[1] < 1096 AS leader FROM kr) SELECT CASE WHEN n = 0 THEN 'unspliced' ELSE CASE n WHEN 1 THEN 'spliced1' ELSE 'spliced2' END || CASE WHEN leader THEN '_leader' ELSE '_noleader' END END AS class, count(*) AS n FROM l GROUP BY 1"))
def split_transcripts(spark, sf_dir):
    from ..operators.structure import leader_flag

    n = (F.size("breaks") / 2 - 1).cast("int")
    return tb.split_transcripts(transcripts(spark, sf_dir), tb.spliced_class(n, leader_flag(F.col("breaks"), 1106, 10)))


@query("split_transcripts_ends", sql("rd", "SELECT CASE WHEN st < 1500 THEN '5' ELSE 'no5' END || CASE WHEN en > 2500 THEN '_3' ELSE '_no3' END AS class, count(*) AS n FROM rd GROUP BY 1"))
def split_transcripts_ends(spark, sf_dir):
    return tb.split_transcripts(transcripts(spark, sf_dir), tb.end_class(F.col("st"), F.col("en"), 4000, 1500))

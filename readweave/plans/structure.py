"""Queries over read structure and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import intervals as iv
from ..operators import structure as st
from ..operators.rescue import chromosome_ends
from ..registry import query
from . import inputs
from .inputs import GAP, blocks, genes, sql


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.exons(blocks(spark, sf_dir), GAP)


def per_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.read_breaks(exons(spark, sf_dir))


_CIGAR = "concat(l_linenumber, 'S', CAST(l_quantity AS INT), 'M', l_suppkey % 900 + 100, 'N', 40 + l_partkey % 60, 'M', 3, 'I', 20, 'M', l_suppkey % 7 + 1, 'D', 15, 'M')"
#: A read's id is its own keys and a number among the rows that share them.
_ID = "concat(l_orderkey, '.', l_linenumber, '.', row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity))"
_OPS = f"""WITH x AS (SELECT {_ID} AS read_id, l_linenumber AS pos, {_CIGAR} AS cigar FROM lineitem),
y AS (SELECT read_id, pos, unnest(regexp_extract_all(cigar, '([0-9]+)([MIDNSHPX=])', 1)) AS n, unnest(regexp_extract_all(cigar, '([0-9]+)([MIDNSHPX=])', 2)) AS op, generate_subscripts(regexp_extract_all(cigar, '([0-9]+)([MIDNSHPX=])', 1), 1) - 1 AS i FROM x),
o AS (SELECT read_id, CAST(i AS INTEGER) AS i, op, CAST(n AS INTEGER) AS length,
 CAST(pos + coalesce(sum(CASE WHEN op IN ('M','=','X','D','N') THEN CAST(n AS INTEGER) ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS ref_at,
 CAST(1 + coalesce(sum(CASE WHEN op IN ('M','=','X','I','S') THEN CAST(n AS INTEGER) ELSE 0 END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS read_at FROM y) """
_USED = "SELECT read_id, max(ref_at + CASE WHEN op IN ('M','=','X','D','N') THEN length ELSE 0 END) - 1 AS last_ref, max(read_at + CASE WHEN op IN ('M','=','X','I','S') THEN length ELSE 0 END) - 1 AS read_length FROM o GROUP BY read_id"


def _cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "lineitem").select(F.expr(_ID).alias("read_id"), F.col("l_linenumber").alias("pos"), F.expr(_CIGAR).alias("cigar"))


@query("cigar_ops", _OPS + "SELECT * FROM o")
def cigar_ops(spark, sf_dir):
    return st.cigar_ops(_cigars(spark, sf_dir))


@query("running_offsets", _OPS + _USED)
def running_offsets(spark, sf_dir):
    ops = st.cigar_ops(_cigars(spark, sf_dir))
    used = lambda kinds: F.when(F.col("op").isin(*kinds), F.col("length")).otherwise(0)
    return ops.groupBy("read_id").agg((F.max(F.col("ref_at") + used(st.ON_REFERENCE)) - 1).alias("last_ref"), (F.max(F.col("read_at") + used(st.ON_READ)) - 1).alias("read_length"))


@query("gap_islands", sql("b e0 e1", "SELECT read_id, blk, pk, st, en, exon FROM e1"))
def gap_islands(spark, sf_dir):
    return st.gap_islands(blocks(spark, sf_dir), GAP).select("read_id", "blk", "pk", "st", "en", "exon")


@query("read_breaks", sql("e", "SELECT read_id, string_agg(st || ',' || en, ',' ORDER BY exon) AS breaks, count(*) AS n_exons FROM e GROUP BY read_id"))
def read_breaks(spark, sf_dir):
    return per_read(spark, sf_dir).select("read_id", st.joined(F.col("breaks")).alias("breaks"), "n_exons")


@query("bin_breaks", sql("e", "SELECT read_id, string_agg(st // 10 || ',' || en // 10, ',' ORDER BY exon) AS iso_key FROM e GROUP BY read_id"))
def bin_breaks(spark, sf_dir):
    return per_read(spark, sf_dir).select("read_id", st.joined(st.bin_breaks(F.col("breaks"), 10)).alias("iso_key"))


@query("breaks_to_string", sql("e", "SELECT read_id, string_agg((st * 2 - 1) || ',' || (en * 2 - 1), ',' ORDER BY exon) AS breaks FROM e GROUP BY read_id"))
def breaks_to_string(spark, sf_dir):
    return per_read(spark, sf_dir).select("read_id", st.breaks_to_string(F.col("breaks"), -1, 2).alias("breaks"))


@query("trim_short_terminal_exons", sql("e", "WITH m AS (SELECT *, (exon = 1 OR exon = max(exon) OVER (PARTITION BY read_id)) AND en - st + 1 < 30 AS short, count(*) OVER (PARTITION BY read_id) AS n FROM e), t AS (SELECT *, n - sum(CAST(short AS INTEGER)) OVER (PARTITION BY read_id) AS kept FROM m) SELECT read_id, exon, st, en FROM t WHERE NOT short OR (kept = 0 AND exon = 1)"))
def trim_short(spark, sf_dir):
    return st.trim_short_terminal_exons(exons(spark, sf_dir), 30).select("read_id", "exon", "st", "en")


@query("end_type", sql("r", "SELECT read_id, concat(CASE WHEN st <= 500 THEN '5' ELSE 'no5' END, '_', CASE WHEN en >= 2300 THEN '3' ELSE 'no3' END) AS end_type FROM r"))
def end_type(spark, sf_dir):
    return inputs.reads(spark, sf_dir).select("read_id", st.end_type(F.col("st"), F.col("en"), 500, 2300).alias("end_type"))


@query("leader_flag", sql("rd", "SELECT read_id, ens[1] < 1106 - 10 OR coalesce(sts[2] - ens[1] > 900, false) AS leader FROM rd"))
def leader_flag(spark, sf_dir):
    return per_read(spark, sf_dir).select("read_id", st.leader_flag(F.col("breaks"), 1106, 10, 900).alias("leader"))


@query("cluster_key_unannotated", sql("rd", "SELECT read_id, CAST((CASE WHEN fwd THEN en ELSE st END) // 100 AS VARCHAR) AS cluster_key FROM rd"))
def key_unannotated(spark, sf_dir):
    return per_read(spark, sf_dir).select("read_id", st.cluster_key_unannotated(F.col("fwd"), F.col("st"), F.col("en"), 100).alias("cluster_key"))


@query("cluster_key_viral", sql("k", "SELECT read_id, cluster_key FROM k"))
def key_viral(spark, sf_dir):
    return iv.cluster_key_viral(exons(spark, sf_dir), genes(spark, sf_dir))


@query("strand_suffix", sql("kr", "SELECT read_id, cluster_key || CASE WHEN fwd THEN '+' ELSE '-' END AS cluster_key FROM kr"))
def strand_suffix(spark, sf_dir):
    keyed = iv.cluster_key_viral(exons(spark, sf_dir), genes(spark, sf_dir)).join(per_read(spark, sf_dir), "read_id")
    return keyed.select("read_id", st.strand_suffix(F.col("cluster_key"), F.col("fwd")).alias("cluster_key"))


@query("cluster_key_host", sql("a e rd", "WITH x AS (SELECT read_id, exon, gene, ord, abs(st - g_st) + abs(en - g_en) AS dist FROM e JOIN a ON g_chrom = chrom AND st >= g_st - 40 AND st <= g_en + 40 AND en <= g_en + 40), m AS (SELECT read_id, exon, arg_min(gene, dist * 1000 + ord) AS gene FROM x GROUP BY 1, 2 HAVING min(dist) <= 80), g AS (SELECT read_id, string_agg(DISTINCT gene, ';' ORDER BY gene) AS genes FROM m GROUP BY 1) SELECT read_id, coalesce(genes, chrom || '.' || (CASE WHEN fwd THEN en ELSE st END) // 100) AS cluster_key FROM rd LEFT JOIN g USING (read_id)"))
def key_host(spark, sf_dir):
    return iv.cluster_key_host(exons(spark, sf_dir), genes(spark, sf_dir), 40, 100)


_SUPP = "x AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY st, en, q1, q2) AS k FROM b WHERE blk > 2), p AS (SELECT read_id, list({'st': st, 'en': en, 'q1': q1, 'q2': q2}) AS held, 0::BIGINT AS k FROM b WHERE blk <= 2 GROUP BY 1)"
_FREE = "len(list_filter(held, lambda h: (h.st <= x.en AND x.st <= h.en) OR (h.q1 <= x.q2 AND x.q1 <= h.q2))) = 0"


@query("merge_supplementary", sql("b", f"WITH RECURSIVE {_SUPP}, m AS (SELECT read_id, held, k FROM p UNION ALL SELECT m.read_id, CASE WHEN {_FREE} THEN list_append(held, {{'st': x.st, 'en': x.en, 'q1': x.q1, 'q2': x.q2}}) ELSE held END, x.k FROM m JOIN x ON x.read_id = m.read_id AND x.k = m.k + 1), f AS (SELECT read_id, unnest(arg_max(held, k)) AS s FROM m GROUP BY 1) SELECT read_id, string_agg(s.st || ',' || s.en, ',' ORDER BY s.st, s.en) AS breaks FROM f GROUP BY 1"))
def merge_supplementary(spark, sf_dir):
    """A read's blocks are on one strand here; the test of literal rows has both."""
    b = blocks(spark, sf_dir)
    return st.merge_supplementary(b.filter("blk <= 2"), b.filter("blk > 2")).select("read_id", st.joined(F.col("breaks")).alias("breaks"))


@query("clip_class", sql("b", "SELECT read_id, blk, pk, CASE WHEN q1 > 200 AND 420 - q2 > 200 THEN 'both' WHEN q1 > 200 THEN '5' WHEN 420 - q2 > 200 THEN '3' ELSE 'none' END AS clip FROM b"))
def clip_class(spark, sf_dir):
    return blocks(spark, sf_dir).select("read_id", "blk", "pk", st.clip_class(F.col("q1"), 420 - F.col("q2"), 200).alias("clip"))


@query("asof_upstream", sql("a b", "SELECT read_id, blk, pk, coalesce((SELECT arg_max(gene, g_st) FROM a WHERE g_chrom = chrom AND g_st <= st + 5), 'st.' || chrom) AS label FROM b"))
def asof_upstream(spark, sf_dir):
    return iv.asof_upstream(blocks(spark, sf_dir), "st", genes(spark, sf_dir), "label").select("read_id", "blk", "pk", "label")


@query("asof_downstream", sql("a b", "SELECT read_id, blk, pk, coalesce((SELECT arg_min(gene, g_st) FROM a WHERE g_chrom = chrom AND g_fwd = fwd AND g_st >= en - 5), 'end.' || chrom) AS label FROM b"))
def asof_downstream(spark, sf_dir):
    return iv.asof_downstream(blocks(spark, sf_dir), "en", genes(spark, sf_dir), "label", strand=True).select("read_id", "blk", "pk", "label")


@query("snap_left", sql("a e rd", "WITH x AS (SELECT e.read_id, e.exon, e.en, (SELECT max(g_st) FROM a WHERE g_chrom = e.chrom AND g_st <= e.en) AS s, rd.st AS lo FROM e JOIN rd USING (read_id)) SELECT read_id, exon, CASE WHEN s >= lo AND en - s < 10000 THEN s ELSE en END AS at FROM x"))
def snap_left(spark, sf_dir):
    e = exons(spark, sf_dir).withColumn("lo", F.min("st").over(W.partitionBy("read_id")))
    return iv.snap_left(e, "en", "lo", genes(spark, sf_dir), "at").select("read_id", "exon", "at")


@query("snap_right", sql("a e rd", "WITH x AS (SELECT e.read_id, e.exon, e.st, (SELECT min(g_st) FROM a WHERE g_chrom = e.chrom AND g_st >= e.st) AS s, rd.en AS hi FROM e JOIN rd USING (read_id)) SELECT read_id, exon, CASE WHEN s <= hi AND s - st < 10000 THEN s ELSE st END AS at FROM x"))
def snap_right(spark, sf_dir):
    e = exons(spark, sf_dir).withColumn("hi", F.max("en").over(W.partitionBy("read_id")))
    return iv.snap_right(e, "st", "hi", genes(spark, sf_dir), "at").select("read_id", "exon", "at")


def _nearest(end: str, strand: str = "") -> str:
    return sql("a b", f"SELECT read_id, blk, pk, arg_min(gene, abs({end} - st) * 1000 + ord) AS gene, min(abs({end} - st)) AS distance FROM b JOIN a ON g_chrom = chrom {strand} AND st BETWEEN g_st - 10 AND g_en + 10 GROUP BY ALL")


@query("nearest_containing_up", _nearest("g_en"))
def nearest_up(spark, sf_dir):
    return iv.nearest_containing(blocks(spark, sf_dir), ["read_id", "blk", "pk"], "st", genes(spark, sf_dir), 10, "g_en")


@query("nearest_containing_down", _nearest("g_st", "AND g_fwd = fwd"))
def nearest_down(spark, sf_dir):
    return iv.nearest_containing(blocks(spark, sf_dir), ["read_id", "blk", "pk"], "st", genes(spark, sf_dir), 10, "g_st", strand=True)


@query("end_type_exon", sql("a b", "WITH x AS (SELECT read_id, blk, pk, st, arg_min(g_st, abs(g_st - st) * 1000 + ord) AS g FROM b LEFT JOIN a ON g_chrom = chrom AND st BETWEEN g_st - 10 AND g_en + 10 GROUP BY ALL) SELECT read_id, blk, pk, CASE WHEN g IS NULL THEN 'NA' WHEN abs(st - g) <= 20 THEN '5' ELSE 'no5' END AS end_type FROM x"))
def end_type_exon(spark, sf_dir):
    g = genes(spark, sf_dir).withColumn("gene", F.col("g_st"))
    b = blocks(spark, sf_dir)
    found = iv.nearest_containing(b, ["read_id", "blk", "pk", "st"], "st", g, 10, "g_st")
    both = b.select("read_id", "blk", "pk", "st").distinct().join(found, ["read_id", "blk", "pk", "st"], "left")
    return both.select("read_id", "blk", "pk", F.when(F.col("gene").isNull(), "NA").when(F.abs(F.col("st") - F.col("gene")) <= 20, "5").otherwise("no5").alias("end_type"))


@query("exon_match", sql("a e", "WITH x AS (SELECT read_id, exon, gene, ord, abs(st - g_st) + abs(en - g_en) AS dist FROM e JOIN a ON g_chrom = chrom AND st >= g_st - 40 AND st <= g_en + 40 AND en <= g_en + 40) SELECT read_id, exon, arg_min(gene, dist * 1000 + ord) AS gene, min(dist) AS distance FROM x GROUP BY 1, 2 HAVING min(dist) <= 80"))
def exon_match(spark, sf_dir):
    return iv.exon_match(exons(spark, sf_dir), genes(spark, sf_dir), 40)


@query("linked_exon_match", sql("a e", "WITH p AS (SELECT read_id, exon, chrom, en AS le, lead(st) OVER (PARTITION BY read_id ORDER BY exon) AS rs FROM e), l AS (SELECT transcript, g_chrom, ord, gene, g_en AS te, lead(g_st) OVER w AS ts, lead(gene) OVER w AS ng FROM a WINDOW w AS (PARTITION BY g_chrom, transcript ORDER BY g_st, ord)), m AS (SELECT read_id, exon, gene || ',' || ng AS genes, ord, abs(le - te) + abs(rs - ts) AS dist FROM p JOIN l ON g_chrom = chrom AND abs(le - te) <= 60 AND abs(rs - ts) <= 60) SELECT read_id, exon, arg_min(genes, dist * 1000 + ord) AS genes, min(dist) AS distance FROM m GROUP BY 1, 2"))
def linked_exon_match(spark, sf_dir):
    return iv.linked_exon_match(exons(spark, sf_dir), genes(spark, sf_dir), 60)


_SPAN = "ends AS (SELECT read_id, chrom, st AS pt FROM e UNION ALL SELECT read_id, chrom, en FROM e), sp AS (SELECT read_id, gene, count(*) AS n_breaks, list_sort(list(DISTINCT pt)) AS breaks FROM ends JOIN a ON g_chrom = chrom AND pt BETWEEN g_st - 5 AND g_en + 5 GROUP BY 1, 2)"


@query("gene_span", sql("a e", f"WITH {_SPAN} SELECT read_id, gene, n_breaks, array_to_string(breaks, ',') AS breaks FROM sp"))
def gene_span(spark, sf_dir):
    return iv.gene_span(exons(spark, sf_dir), genes(spark, sf_dir)).select("read_id", "gene", "n_breaks", st.joined(F.col("breaks")).alias("breaks"))


@query("gene_set_cover", sql("a e", f"WITH RECURSIVE {_SPAN}, o AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY n_breaks DESC, gene) AS k FROM sp), c AS (SELECT read_id, k, breaks AS held, gene AS genes FROM o WHERE k = 1 UNION ALL SELECT c.read_id, o.k, list_distinct(list_concat(held, breaks)), CASE WHEN len(list_filter(breaks, lambda x: NOT list_contains(held, x))) > 0 THEN genes || ';' || gene ELSE genes END FROM c JOIN o ON o.read_id = c.read_id AND o.k = c.k + 1) SELECT read_id, arg_max(genes, k) AS genes FROM c GROUP BY read_id"))
def gene_set_cover(spark, sf_dir):
    return iv.gene_set_cover(iv.gene_span(exons(spark, sf_dir), genes(spark, sf_dir)))


@query("gene_name_list", sql("a e rd", f"WITH {_SPAN}, n AS (SELECT read_id, string_agg(gene, ';' ORDER BY gene) AS g FROM sp GROUP BY 1) SELECT read_id, coalesce(g, '-') AS genes FROM rd LEFT JOIN n USING (read_id)"))
def gene_name_list(spark, sf_dir):
    span = iv.gene_span(exons(spark, sf_dir), genes(spark, sf_dir)).groupBy("read_id").agg(F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("g"))
    return per_read(spark, sf_dir).select("read_id").join(span, "read_id", "left").select("read_id", F.coalesce("g", F.lit("-")).alias("genes"))


@query("strand_consensus", sql("a e rd", "WITH ends AS (SELECT read_id, chrom, st AS pt FROM e UNION ALL SELECT read_id, chrom, en FROM e), s AS (SELECT read_id, count(DISTINCT g_fwd) AS n, bool_or(g_fwd) AS f FROM ends JOIN a ON g_chrom = chrom AND pt BETWEEN g_st - 5 AND g_en + 5 GROUP BY 1) SELECT read_id, CASE WHEN n = 1 AND f THEN '+' WHEN n = 1 THEN '-' ELSE 'N' END AS strand FROM rd LEFT JOIN s USING (read_id)"))
def strand_consensus(spark, sf_dir):
    span = iv.gene_span(exons(spark, sf_dir), genes(spark, sf_dir))
    found = span.groupBy("read_id").agg(F.countDistinct("g_fwd").alias("n"), F.bool_or("g_fwd").alias("f"))
    strand = F.when(F.col("n") != 1, "N").when(F.col("f"), "+").when(~F.col("f"), "-").otherwise("N")
    return per_read(spark, sf_dir).select("read_id").join(found, "read_id", "left").select("read_id", strand.alias("strand"))


_LAST = "l AS (SELECT read_id, arg_max(source, exon) AS source, any_value(chrom) AS chrom, arg_max(st, exon) AS last_st, min(st) AS st, max(en) AS en FROM e GROUP BY 1)"
_SPLICED = f"{_LAST}, sc AS (SELECT gene, source, count(*) FILTER (WHERE l.st <= 1500) AS spliced, count(*) FILTER (WHERE l.st > 1500) AS unspliced FROM l JOIN a ON g_chrom = chrom AND g_st >= last_st - 10 AND en > g_st + 100 GROUP BY 1, 2)"


def last_segments(spark, sf_dir):
    e = exons(spark, sf_dir)
    return e.groupBy("read_id").agg(F.first("source").alias("source"), F.first("chrom").alias("chrom"), F.max_by("st", "exon").alias("last_st"), F.min("st").alias("st"), F.max("en").alias("en"))


@query("spliced_counts_join", sql("a e", f"WITH {_SPLICED} SELECT * FROM sc"))
def spliced_counts_join(spark, sf_dir):
    return iv.spliced_counts_join(last_segments(spark, sf_dir), genes(spark, sf_dir), 1500)


@query("spliced_unspliced", sql("a e", f"WITH {_SPLICED} SELECT ord, gene, source, coalesce(spliced, 0) AS spliced, coalesce(unspliced, 0) AS unspliced FROM a CROSS JOIN (SELECT DISTINCT source FROM e) LEFT JOIN sc USING (gene, source)"))
def spliced_unspliced(spark, sf_dir):
    found = iv.spliced_counts_join(last_segments(spark, sf_dir), genes(spark, sf_dir), 1500)
    every = genes(spark, sf_dir).select("ord", "gene").crossJoin(blocks(spark, sf_dir).select("source").distinct())
    return every.join(found, ["gene", "source"], "left").fillna(0, ["spliced", "unspliced"])


@query("orf_cover_segment", sql("a e", "SELECT read_id, exon, gene, least(en, g_en) - greatest(st, g_st) + 1 AS held FROM e JOIN a ON g_chrom = chrom AND st <= g_st + 5 AND en >= g_en - 5 AND st <= g_en AND g_st <= en WHERE least(en, g_en) - greatest(st, g_st) + 1 >= 0.8 * (g_en - g_st + 1)"))
def orf_cover_segment(spark, sf_dir):
    return iv.orf_cover_segment(exons(spark, sf_dir), genes(spark, sf_dir)).select("read_id", "exon", "gene", "held")


@query("gene_label_of_position", sql("a d", "SELECT source, pos, coalesce(arg_min(gene, ord), 'none') AS gene FROM (SELECT source, pos, pos * 4 + 1000 AS pt, concat('c', pos % 2) AS chrom FROM d) LEFT JOIN a ON g_chrom = chrom AND pt BETWEEN g_st AND g_en GROUP BY 1, 2"))
def gene_label(spark, sf_dir):
    d = inputs.depth(spark, sf_dir).withColumn("at", F.col("pos") * 4 + 1000).withColumn("chrom", F.concat(F.lit("c"), F.col("pos") % 2))
    return iv.gene_label_of_position(d, "at", genes(spark, sf_dir), ["source", "pos"], "none")


@query("lookup_gene_position", sql("a k rd", "WITH x AS (SELECT read_id, regexp_extract(cluster_key, '(NATION_[0-9]+)$', 1) AS gene FROM k) SELECT read_id, coalesce(g_st, 0) AS position FROM x LEFT JOIN a USING (gene)"))
def lookup_gene_position(spark, sf_dir):
    keyed = iv.cluster_key_viral(exons(spark, sf_dir), genes(spark, sf_dir)).withColumn("gene", F.regexp_extract("cluster_key", "(NATION_[0-9]+)$", 1))
    return keyed.join(iv.side(genes(spark, sf_dir).select("gene", "g_st")), "gene", "left").select("read_id", F.coalesce("g_st", F.lit(0)).alias("position"))


@query("region_from_genes", sql("a", "WITH x AS (SELECT *, coalesce(lag(g_st) OVER (PARTITION BY g_chrom ORDER BY g_st, ord), 1) AS lo FROM a) SELECT g_chrom AS chrom, max(CASE WHEN gene = 'NATION_4' THEN g_st END) AS left_lo, max(CASE WHEN gene = 'NATION_4' THEN g_en END) AS left_hi, max(CASE WHEN gene = 'NATION_12' THEN lo END) AS right_lo, max(CASE WHEN gene = 'NATION_12' THEN g_st END) AS right_hi FROM x WHERE gene IN ('NATION_4', 'NATION_12') GROUP BY 1"))
def region_from_genes(spark, sf_dir):
    return iv.region_from_genes(genes(spark, sf_dir), "NATION_4", "NATION_12")


@query("region_from_ranges", sql("a", "WITH x AS (SELECT *, coalesce(lag(g_st) OVER (PARTITION BY g_chrom ORDER BY g_st, ord), 1) AS lo FROM a) SELECT g_chrom AS chrom, 60 AS left_lo, 80 AS left_hi, max(lo) AS right_lo, max(g_st) AS right_hi FROM x WHERE gene = 'NATION_7' GROUP BY 1"))
def region_from_ranges(spark, sf_dir):
    return iv.region_from_genes(genes(spark, sf_dir), "NATION_4", "NATION_7", left_range=(60, 80))


@query("gene_break_region", sql("a", "SELECT gene, greatest(g_st - 60, coalesce(lag(g_en) OVER w, 1)) AS lo, least(g_st + 60, coalesce(lead(g_st) OVER w, g_en)) AS hi FROM a WINDOW w AS (PARTITION BY g_chrom ORDER BY g_st, ord)"))
def gene_break_region(spark, sf_dir):
    order = W.partitionBy("g_chrom").orderBy("g_st", "ord")
    return genes(spark, sf_dir).select("gene", F.greatest(F.col("g_st") - 60, F.coalesce(F.lag("g_en").over(order), F.lit(1))).alias("lo"), F.least(F.col("g_st") + 60, F.coalesce(F.lead("g_st").over(order), F.col("g_en"))).alias("hi"))


@query("adjust_last_gene", sql("a gn", "WITH t AS (SELECT name, len(seq) - CASE WHEN len(regexp_extract(seq, 'A+$')) >= 10 THEN len(regexp_extract(seq, 'A+$')) ELSE 0 END AS body FROM gn) SELECT gene, CAST(CASE WHEN ord = arg_max(ord, g_st) OVER (PARTITION BY g_chrom) THEN least(g_en, body) ELSE g_en END AS INTEGER) AS g_en FROM a JOIN t ON name = g_chrom"))
def adjust_last_gene(spark, sf_dir):
    return iv.adjust_last_gene(genes(spark, sf_dir), chromosome_ends(inputs.tiled(spark, sf_dir))).select("gene", "g_en")

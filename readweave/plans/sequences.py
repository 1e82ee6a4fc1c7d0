"""Queries over sequences and intervals of reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as sq
from ..registry import query
from .inputs import blocks, halves, reads, sequences, sql


@query("reverse_complement", sql("s", "SELECT id, reverse(translate(seq, 'ACGTUacgtu', 'TGCAAtgcaa')) AS rc FROM s"))
def reverse_complement(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", sq.reverse_complement(F.col("seq")).alias("rc"))


@query("filter_min_length", sql("s", "SELECT id, CAST(len(seq) AS INTEGER) AS length FROM s WHERE len(seq) >= 500"))
def filter_min_length(spark, sf_dir):
    return sequences(spark, sf_dir).filter(F.length("seq") >= 500).select("id", F.length("seq").alias("length"))


@query("is_poly_tail", sql("s", "SELECT id, coalesce(greatest(len(regexp_replace(seq, '[^A]', '', 'g')), len(regexp_replace(seq, '[^T]', '', 'g')), len(regexp_replace(seq, '[^U]', '', 'g'))) / nullif(len(seq), 0) >= 0.4::DOUBLE, false) AS tail FROM s"))
def is_poly_tail(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", sq.is_poly_tail(F.col("seq"), 0.4).alias("tail"))


@query("poly_a_length", sql("s", "SELECT id, CAST(CASE WHEN len(regexp_extract(seq, 'A+$')) >= 2 THEN len(regexp_extract(seq, 'A+$')) ELSE 0 END AS INTEGER) AS n FROM s"))
def poly_a_length(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", sq.poly_a_length(F.col("seq"), 2).alias("n"))


@query("flank", sql("s", "SELECT id, substr(repeat('N', 20) || seq || repeat('N', 20), 5, 41) AS flank FROM s"))
def flank(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", sq.flank(F.col("seq"), F.lit(5), 20).alias("flank"))


@query("base_counts", sql("s", "SELECT id, CAST(len(left(seq, 50)) - len(replace(left(seq, 50), 'A', '')) AS INTEGER) AS first_a, CAST(len(right(seq, 50)) - len(replace(right(seq, 50), 'A', '')) AS INTEGER) AS last_a FROM s"))
def base_counts(spark, sf_dir):
    first, last = sq.base_counts(F.col("seq"), "A", 50)
    return sequences(spark, sf_dir).select("id", first.alias("first_a"), last.alias("last_a"))


@query("find_motif", sql("s", "SELECT id, CAST(i AS INTEGER) AS pos FROM (SELECT id, seq, unnest(range(1, len(seq) - 2)) AS i FROM s) WHERE substr(seq, i, 4) = 'ATAC'"))
def find_motif(spark, sf_dir):
    return sq.find_motif(sequences(spark, sf_dir), "id", "ATAC")


@query("extract_region", sql("s", "SELECT id, substr(seq, 11, 30) AS region FROM s"))
def extract_region(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", F.substring("seq", 11, 30).alias("region"))


@query("kmer_at", sql("s", "SELECT id, CASE WHEN m >= 2 THEN substr(seq, m - 1, 1) ELSE '-' END || CASE WHEN m >= 1 THEN substr(seq, m, 1) ELSE '-' END || CASE WHEN m + 1 <= len(seq) THEN substr(seq, m + 1, 1) ELSE '-' END AS kmer FROM (SELECT *, len(seq) // 2 AS m FROM s)"))
def kmer_at(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", sq.kmer_at(F.col("seq"), F.floor(F.length("seq") / 2).cast("int"), [-1, 0, 1]).alias("kmer"))


_KM = "km AS (SELECT source, substr(seq, i, 3) AS kmer FROM (SELECT source, seq, unnest(range(1, len(seq) - 1)) AS i FROM s)), n AS (SELECT kmer, count(*) AS all_n, count(*) FILTER (WHERE source = 'web') AS own_n FROM km GROUP BY 1)"


@query("kmer_enrichment", sql("s", f"WITH {_KM} SELECT kmer, own_n, all_n, round((own_n / nullif((SELECT sum(own_n) FROM n), 0)) / (all_n / (SELECT sum(all_n) FROM n)), 6) AS ratio FROM n"))
def kmer_enrichment(spark, sf_dir):
    found = sq.kmers(sequences(spark, sf_dir), ["source"], 3)
    return sq.kmer_enrichment(found, F.col("source") == "web").withColumn("ratio", F.round("ratio", 6))


@query("top_bottom_kmers", sql("s", f"WITH {_KM}, k AS (SELECT kmer, all_n FROM n WHERE substr(kmer, 2, 1) = 'C' AND substr(kmer, 1, 1) <> substr(kmer, 3, 1)) (SELECT 'top' AS side, * FROM k ORDER BY all_n DESC, kmer LIMIT 3) UNION ALL (SELECT 'bottom', * FROM k ORDER BY all_n, kmer LIMIT 3)"))
def top_bottom_kmers(spark, sf_dir):
    n = sq.kmers(sequences(spark, sf_dir), ["source"], 3).groupBy("kmer").agg(F.count("*").alias("all_n"))
    k = n.filter((F.substring("kmer", 2, 1) == "C") & (F.substring("kmer", 1, 1) != F.substring("kmer", 3, 1)))
    top = k.orderBy(F.desc("all_n"), "kmer").limit(3).select(F.lit("top").alias("side"), "kmer", "all_n")
    return top.unionByName(k.orderBy("all_n", "kmer").limit(3).select(F.lit("bottom").alias("side"), "kmer", "all_n"))


@query("position_frequency_matrix", sql("s", "SELECT CAST(i AS INTEGER) AS pos, " + ", ".join(f"count(*) FILTER (WHERE substr(seq, i, 1) = '{b}') AS {b.lower()}" for b in "ACGT") + " FROM (SELECT seq, unnest(range(11, 31)) AS i FROM s WHERE len(seq) >= 30) GROUP BY 1"))
def position_frequency_matrix(spark, sf_dir):
    return sq.position_frequency_matrix(sequences(spark, sf_dir), 11, 30)


@query("find_orfs")
def find_orfs(spark, sf_dir):
    return sq.find_orfs(sequences(spark, sf_dir), "id")


_PAIR = "p AS (SELECT id, substr(seq, 1, len(seq) // 2) AS a, substr(seq, len(seq) // 2 + 1, len(seq) // 2) AS b FROM s WHERE len(seq) >= 2)"


@query("identity", sql("s", f"WITH {_PAIR} SELECT id, round(len(list_filter(range(1, len(a) + 1), lambda i: substr(a, i, 1) = substr(b, i, 1))) / len(a), 9) AS share FROM p"))
def identity(spark, sf_dir):
    return halves(spark, sf_dir).select("id", F.round(sq.identity(F.col("a"), F.col("b")), 9).alias("share"))


@query("project_to_reference", sql("s", f"WITH {_PAIR} SELECT id, array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: substr(a, i, 1) <> 'T'), lambda i: CASE WHEN substr(a, i, 1) = substr(b, i, 1) THEN substr(b, i, 1) ELSE lower(substr(b, i, 1)) END), '') AS projected FROM p"))
def project_to_reference(spark, sf_dir):
    gapped = F.translate("a", "T", "-")
    return halves(spark, sf_dir).select("id", sq.project_to_reference(gapped, F.col("b")).alias("projected"))


@query("indels_from_pairs", sql("s", f"WITH {_PAIR}, c AS (SELECT id, a, b, unnest(range(1, len(a) + 1)) AS i FROM p), g AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run FROM c WHERE substr(a, i, 1) = 'T') SELECT id, CAST(len(replace(substr(any_value(a), 1, min(i) - 1), 'T', '')) AS INTEGER) AS pos, string_agg(substr(b, i, 1), '' ORDER BY i) AS bases FROM g GROUP BY id, run"))
def indels_fromhalves(spark, sf_dir):
    return sq.indels_from_pairs(halves(spark, sf_dir).withColumn("a", F.translate("a", "T", "-")), "id", "a", "b")


@query("nw_cost")
def nw_cost(spark, sf_dir):
    return sq.nw_cost(halves(spark, sf_dir), "a", "b").select("id", "cost")


@query("break_flanks", sql("s", "SELECT id, CAST(pos AS INTEGER) AS pos, CAST(k AS INTEGER) AS k, substr(seq, greatest(1, pos - k + 1), least(k, pos)) AS left, substr(seq, pos + 1, k) AS right FROM (SELECT id, seq, unnest([10, 40]) AS pos FROM s) CROSS JOIN (SELECT unnest([5, 10, 15, 20, 30]) AS k)").replace(" AS left,", ' AS "left",').replace(" AS right ", ' AS "right" '))
def break_flanks(spark, sf_dir):
    rows = sequences(spark, sf_dir).withColumn("breaks", F.array(F.lit(1), F.lit(10), F.lit(40), F.length("seq")))
    return sq.break_flanks(rows, "id", "breaks")


@query("overlap_length", sql("r", "SELECT read_id, greatest(0, least(en, 1500) - greatest(st, 1000) + 1) AS overlap, (en - st + 1) + 501 - greatest(0, least(en, 1500) - greatest(st, 1000) + 1) AS union_length, least(en - 1000, 1500 - st) AS gap FROM r"))
def overlap_length(spark, sf_dir):
    four = F.col("st"), F.col("en"), F.lit(1000), F.lit(1500)
    return reads(spark, sf_dir).select("read_id", sq.overlap_length(*four).alias("overlap"), sq.union_length(*four).alias("union_length"), sq.interval_gap(*four).alias("gap"))


@query("coord_label", sql("b", "SELECT read_id, concat(chrom, '.', CAST(floor(st / 100) AS BIGINT)) AS label FROM b"))
def coord_label(spark, sf_dir):
    return blocks(spark, sf_dir).select("read_id", sq.coord_label(F.col("chrom"), F.col("st"), 100).alias("label"))


@query("normalise_chrom", sql("b", "SELECT DISTINCT 'chr' || chrom AS chrom FROM b"))
def normalise_chrom(spark, sf_dir):
    return blocks(spark, sf_dir).select(sq.normalise_chrom(F.concat("chrom", F.lit(".1"))).alias("chrom")).distinct()

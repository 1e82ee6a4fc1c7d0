"""Queries over break points and read parts against the bases of a genome."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as sg
from ..operators import sequences as sq
from ..registry import query
from . import inputs
from .inputs import blocks, genes, sequences, sql, tiled
from .leftovers import _PAIR, kmer_error_table, matches

_PAIRS = 'ex AS (SELECT read_id, chrom, en AS "left", lead(st) OVER (PARTITION BY read_id ORDER BY exon) AS "right" FROM e), pr AS (SELECT chrom, "left", "right", count(*) AS n FROM ex WHERE "right" IS NOT NULL GROUP BY ALL)'


def pairs(spark, sf_dir):
    """Break pairs with their counts by chromosome, kept: queries read them several times."""
    from ..operators import breakpoints as bp
    from .structure import exons

    return bp.gaps(exons(spark, sf_dir)).groupBy("chrom", "left", "right").agg(F.count("*").alias("n")).persist()


@query("region_segments", sql("s", f"WITH {_PAIR} SELECT id, string_agg(base, '' ORDER BY pos) AS segment FROM m WHERE pos BETWEEN 110 AND 160 AND base <> '-' GROUP BY 1"))
def region_segments(spark, sf_dir):
    return sg.region_segments(matches(spark, sf_dir), "id", 110, 160)


def _at(c: str, o: int) -> str:
    return f"CASE WHEN \"{c}\" + {o} BETWEEN 1 AND len(seq) THEN substr(seq, \"{c}\" + {o}, 1) ELSE '-' END"


def _kmer(c: str, first: int, last: int) -> str:
    return " || ".join(_at(c, o) for o in range(first, last + 1))


@query("break_kmers", sql("gn e", f'WITH {_PAIRS} SELECT chrom, "left", "right", {_kmer("left", -3, 0)} AS left_before, {_kmer("left", 1, 4)} AS left_behind, {_kmer("right", -3, 0)} AS right_before, {_kmer("right", 1, 4)} AS right_behind, n FROM pr JOIN gn ON name = chrom'))
def break_kmers(spark, sf_dir):
    return sg.break_kmers(pairs(spark, sf_dir), tiled(spark, sf_dir), 4)


_K = ["ACA", "CAC", "TAT"]


@query("kmer_mean_fraction", sql("s", f"WITH {_PAIR}, k AS (SELECT *, base <> ref AS error, coalesce(lag(ref) OVER w, '-') || ref || coalesce(lead(ref) OVER w, '-') AS kmer FROM m WINDOW w AS (PARTITION BY id ORDER BY pos)), g AS (SELECT kmer, count(*) FILTER (WHERE error) AS e, count(*) AS d FROM k GROUP BY 1), f AS (SELECT kmer, e / (SELECT sum(e) FROM g) AS error_share, d / (SELECT sum(d) FROM g) AS depth_share FROM g) SELECT round(avg(error_share), 9) AS error_share, round(avg(depth_share), 9) AS depth_share FROM f WHERE kmer IN ('ACA', 'CAC', 'TAT')"))
def kmer_mean_fraction(spark, sf_dir):
    found = sg.kmer_mean_fraction(kmer_error_table(spark, sf_dir), _K, ["error_share", "depth_share"])
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query("waterfall", sql("s", "WITH x AS (SELECT 'start' AS side, left(seq, 3) AS kmer FROM s WHERE len(seq) >= 3 UNION ALL SELECT 'end', right(seq, 3) FROM s WHERE len(seq) >= 3), n AS (SELECT side, kmer, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, CAST(sum(n) OVER (PARTITION BY side ORDER BY n DESC, kmer ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM n WINDOW w AS (PARTITION BY side ORDER BY n DESC, kmer)) SELECT * FROM r WHERE rank <= 10"))
def waterfall(spark, sf_dir):
    s = sequences(spark, sf_dir).filter(F.length("seq") >= 3)
    ends = s.select(F.explode(F.array(F.struct(F.lit("start").alias("side"), F.left("seq", F.lit(3)).alias("kmer")), F.struct(F.lit("end").alias("side"), F.right("seq", F.lit(3)).alias("kmer")))).alias("x"))
    return sg.waterfall(ends.select("x.*"), 10)


_CODONS = "MAP {" + ", ".join(f"'{sq.BASES[i // 16]}{sq.BASES[i // 4 % 4]}{sq.BASES[i % 4]}': '{aa}'" for i, aa in enumerate(sq.CODE)) + "}"
_PROTEIN = f"array_to_string(list_transform(range(0, len(framed) // 3), lambda i: coalesce({_CODONS}[substr(framed, i * 3 + 1, 3)], 'X')), '')"
_ON = "(?:[ACGN][ACGTN]{2}|T[CTN][ACGTN]|TA[CTN]|TG[CGTN])"
_GENE = "(SELECT arg_min(gene, ord) FROM a WHERE g_chrom = chrom AND {c} BETWEEN g_st AND g_en)"
_ORFS = "o AS (SELECT *, CASE WHEN p > 0 AND g_st + p + 1 <= g_en THEN g_st + p - 1 END AS atg FROM (SELECT a.*, strpos(substr(seq, g_st), 'ATG') AS p FROM a JOIN gn ON name = g_chrom))"


@query(
    "joined_protein",
    sql(
        "a gn e",
        f"""WITH {_PAIRS}, {_ORFS},
        h AS (SELECT chrom, "left", "right", arg_min(gene, ord) AS left_gene, arg_min(coalesce(atg, -1), ord) AS first FROM pr LEFT JOIN o ON g_chrom = chrom AND "left" BETWEEN g_st AND g_en GROUP BY ALL),
        j AS (SELECT *, CASE WHEN first > 0 AND first + 2 <= "left" THEN first END AS atg, (SELECT min(g_st) FROM a WHERE g_chrom = chrom AND g_st >= greatest(1, "right" - 5)) AS next_st FROM h),
        f AS (SELECT *, CASE WHEN atg IS NULL THEN coalesce(next_st, "right") ELSE "right" END AS fr, CASE WHEN atg IS NULL THEN 0 ELSE "left" - atg + 1 END AS left_bases, unnest(CASE WHEN atg IS NULL AND next_st IS NOT NULL THEN [0] ELSE [0, 1, 2] END) AS frame FROM j),
        t AS (SELECT f.*, regexp_extract((CASE WHEN atg IS NULL THEN '' ELSE substr(seq, atg, left_bases) END) || repeat('N', frame) || substr(seq, fr), '^{_ON}*(?:TAA|TAG|TGA)?') AS framed FROM f JOIN gn ON name = chrom)
        SELECT chrom, "left", "right", CAST(frame AS INTEGER) AS frame, left_gene, {_GENE.format(c="fr")} AS right_gene, CASE WHEN atg IS NOT NULL THEN left_bases % 3 END AS phase, left_bases, {_PROTEIN} AS protein FROM t""",
    ),
)
def joined_protein(spark, sf_dir):
    return sg.joined_protein(pairs(spark, sf_dir), tiled(spark, sf_dir), genes(spark, sf_dir))


@query("break_similarity")
def break_similarity(spark, sf_dir):
    """No SQL: alignment costs; held against brute force."""
    return sg.break_similarity(pairs(spark, sf_dir), tiled(spark, sf_dir))


@query("clipped_reads", sql("b", "SELECT read_id, blk, pk, st FROM (SELECT *, CASE blk % 4 WHEN 0 THEN 4 ELSE 0 END AS flag FROM b) WHERE flag & 4 <> 0 OR q2 - q1 + 1 < 10 OR mapq < 2 OR q1 - 1 > 300 OR 500 - q2 > 300"))
def clipped_reads(spark, sf_dir):
    rows = blocks(spark, sf_dir).withColumn("flag", F.when(F.col("blk") % 4 == 0, 4).otherwise(0)).withColumn("read_length", F.lit(500))
    return sg.clipped_reads(rows, 10, 300, 2).select("read_id", "blk", "pk", "st")


@query("chimera_records", sql("b", "WITH p AS (SELECT read_id, chrom, min(st) AS st, max(en) AS en, min(q1) AS q1, max(q2) AS q2, string_agg(st || '-' || en, ',' ORDER BY st, en) AS bl FROM b GROUP BY ALL), s AS (SELECT read_id, chrom, bl, 'L' AS lo, st AS ap, q1 - 1 AS rs FROM p UNION ALL SELECT read_id, chrom, bl, 'R', en, 500 - q2 FROM p) SELECT read_id || '.' || lo AS name, 'LO:' || lo || ' AP:' || chrom || ':' || ap || ' FR:' || bl || ' RS:' || rs AS tags FROM s WHERE rs > 0"))
def chimera_records(spark, sf_dir):
    return sg.chimera_records(blocks(spark, sf_dir), F.lit(500))


@query("top_records_by_score", "SELECT concat('read', o_orderkey, ' score=', CAST(floor(o_totalprice) AS BIGINT)) AS name, floor(o_totalprice)::DOUBLE AS score FROM orders ORDER BY floor(o_totalprice) DESC, name LIMIT 50")
def top_records_by_score(spark, sf_dir):
    named = inputs.table(spark, sf_dir, "orders").select(F.concat(F.lit("read"), "o_orderkey", F.lit(" score="), F.floor("o_totalprice").cast("long")).alias("name"))
    return sg.top_records_by_score(named, "name", "score", 50)

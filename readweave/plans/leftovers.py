"""Queries over read ends, mismatches, error rates and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import counts as ct
from ..operators import leftovers as lo
from ..operators import rates as rt
from ..operators import rescue as rs
from ..registry import query
from .inputs import counts, depth, halves, sequences, sql, table, tiled

_PAIR = "p AS (SELECT id, substr(seq, 1, len(seq) // 2) AS a, substr(seq, len(seq) // 2 + 1, len(seq) // 2) AS b FROM s WHERE len(seq) >= 2), m AS (SELECT id, CAST(101 + i AS INTEGER) AS pos, substr(a, i + 1, 1) AS base, substr(b, i + 1, 1) AS ref FROM (SELECT *, unnest(range(0, len(a))) AS i FROM p))"


def matches(spark, sf_dir):
    """First halves of all sequences as reads, second halves as their reference."""
    return lo.base_matches(halves(spark, sf_dir), "id", F.lit(101))


@query("base_matches", sql("s", f"WITH {_PAIR} SELECT *, CAST(base <> ref AS INTEGER) AS error FROM m"))
def base_matches(spark, sf_dir):
    return matches(spark, sf_dir)


@query("read_error_ratio", sql("s", f"WITH {_PAIR} SELECT id, round(count(*) FILTER (WHERE base <> ref) / count(*), 9) AS ratio FROM m GROUP BY 1"))
def read_error_ratio(spark, sf_dir):
    return matches(spark, sf_dir).groupBy("id").agg(F.round(F.sum("error") / F.count("*"), 9).alias("ratio"))


@query("kmer_error_table", sql("s", f"WITH {_PAIR}, k AS (SELECT *, base <> ref AS error, coalesce(lag(ref) OVER w, '-') || ref || coalesce(lead(ref) OVER w, '-') AS kmer FROM m WINDOW w AS (PARTITION BY id ORDER BY pos)), g AS (SELECT kmer, count(*) FILTER (WHERE error) AS e, count(*) AS d FROM k GROUP BY 1) SELECT kmer, round(e / (SELECT sum(e) FROM g), 9) AS error_share, round(d / (SELECT sum(d) FROM g), 9) AS depth_share, round(d / (SELECT sum(d) FROM g), 9) AS position_share, round((e / (SELECT sum(e) FROM g)) / (d / (SELECT sum(d) FROM g)), 9) AS ratio FROM g"))
def kmer_error_table(spark, sf_dir):
    w = W.partitionBy("id").orderBy("pos")
    near = F.concat(F.coalesce(F.lag("ref").over(w), F.lit("-")), F.col("ref"), F.coalesce(F.lead("ref").over(w), F.lit("-")))
    found = lo.kmer_error_table(matches(spark, sf_dir).select(near.alias("kmer"), F.lit(1).alias("depth"), F.col("error").alias("errors")))
    return found.select("kmer", *[F.round(c, 9).alias(c) for c in found.columns[1:]])


# vowels become A, other letters than C, G and T go: reads with runs of A in clips of a third and a quarter
_TAILED = "f AS (SELECT doc_id AS id, regexp_replace(regexp_replace(upper(text), '[EIO]', 'A', 'g'), '[^ACGT]', '', 'g') AS seq FROM documents), c AS (SELECT id, seq, 0 AS side, 0 AS off, left(seq, len(seq) // 3) AS clip FROM f UNION ALL SELECT id, seq, 1, len(seq) - len(seq) // 4, right(seq, len(seq) // 4) FROM f)"
_RUNS = "x AS (SELECT id, side, off, len(seq) AS n, unnest(range(1, len(clip) + 1)) AS i, unnest(string_split(clip, '')) AS ch FROM c WHERE clip <> ''), p AS (SELECT *, sum(CASE ch WHEN 'A' THEN 10 ELSE -8 END) OVER (PARTITION BY id, side ORDER BY i) AS t FROM x), m AS (SELECT *, least(0, min(t) OVER (PARTITION BY id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low FROM p), g AS (SELECT *, t - coalesce(low, 0) AS gain, coalesce(max(CASE WHEN t <= coalesce(low, 0) THEN i END) OVER (PARTITION BY id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM m), b AS (SELECT id, side, off, n, first, i AS last, gain FROM g WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY id, side ORDER BY gain DESC, i) = 1), k AS (SELECT id, side, off + last AS cut FROM b WHERE last - first > CASE side WHEN 0 THEN 8 ELSE 6 END AND (gain + 8 * (last - first)) / 18 > 0.7 * (last - first) AND CASE side WHEN 0 THEN first > 10 ELSE off + last < n - 10 END), w AS (SELECT id, arg_min(cut, side) AS cut FROM k GROUP BY 1), o AS (SELECT f.id, seq, cut FROM f LEFT JOIN w ON w.id = f.id)"


@query("split_internal_polya", f"WITH {_TAILED}, {_RUNS} SELECT CAST(id AS VARCHAR) AS read_id, seq FROM o WHERE cut IS NULL UNION ALL SELECT id || '.L', substr(seq, 1, cut) FROM o WHERE cut IS NOT NULL UNION ALL SELECT id || '.R', substr(seq, cut + 1) FROM o WHERE cut IS NOT NULL")
def split_internal_polya(spark, sf_dir):
    seq = F.regexp_replace(F.regexp_replace(F.upper("text"), "[EIO]", "A"), "[^ACGT]", "")
    n = F.length("seq")
    l, r = F.floor(n / 3).cast("int"), F.floor(n / 4).cast("int")
    reads = table(spark, sf_dir, "documents").select("doc_id", seq.alias("seq")).withColumn("cigar", F.concat(l.cast("string"), F.lit("S"), (n - l - r).cast("string"), F.lit("M"), r.cast("string"), F.lit("S")))
    return lo.split_internal_polya(reads, "doc_id", 8, 6, 0.7)


def clipped(spark, sf_dir, clip: int = 40):
    """Every sequence of 2 x clip bases and more as a read that is aligned between clips of so many bases. Two of three reads have
    the bases of either chromosome end in their clips, with every thirteenth base of their own; the third has its own there."""
    ends = rs.chromosome_ends(tiled(spark, sf_dir))
    own = sequences(spark, sf_dir).filter(F.length("seq") >= 2 * clip).withColumn("chrom", F.concat(F.lit("c"), F.col("id") % 2)).join(ends, "chrom")
    at = (F.col("id") * 7 % (500 - clip)).cast("int")

    def mixed(end: str, first) -> F.Column:
        taken = F.split(F.substring(F.col(end), at + 1, F.lit(clip)), "")
        kept = F.transform(taken, lambda b, i: F.when(i % 13 == F.col("id") % 13, F.substring(F.col("seq"), first + i, F.lit(1))).otherwise(b))
        return F.when(F.col("id") % 3 == 0, F.substring(F.col("seq"), first, F.lit(clip))).otherwise(F.array_join(kept, ""))

    n = F.length("seq")
    seq = F.concat(mixed("five", F.lit(1)), F.substring(F.col("seq"), F.lit(clip + 1), n - 2 * clip), mixed("three", n - clip + 1))
    st = (600 + F.col("id") % 50).cast("int")
    en = (st + F.least(n - 2 * clip, F.lit(1500)) - 1).cast("int")
    cigar = F.concat(F.lit(f"{clip}S"), (n - 2 * clip).cast("string"), F.lit(f"M{clip}S"))
    return own.select(F.col("id").alias("read_id"), "chrom", cigar.alias("cigar"), seq.alias("seq"), st.alias("st"), en.alias("en"), F.array(st, en).alias("breaks")), ends


@query("rescue_ends")
def rescue_ends(spark, sf_dir):
    """No SQL: local alignments; held against plain Python."""
    reads, ends = clipped(spark, sf_dir)
    found = rs.rescue_ends(reads, ends)
    return found.withColumn("breaks", F.array_join(F.transform("breaks", lambda b: b.cast("string")), ","))


Z = rt.normal_quantile(0.95)
_CI = "({h} / {n} + {z2} / (2 * {n}) {sign} {z} * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + {z2} / (4.0::DOUBLE * {n} * {n}))) / (1 + {z2} / {n})"


def _ci(h: str, n: str) -> str:
    return ", ".join([f"round({h} / {n}, 9) AS share", *(f"round({_CI.format(h=h, n=n, z=Z, z2=Z * Z, sign=s)}, 9) AS {name}" for s, name in (("-", "lower"), ("+", "upper")))])


def _rounded(df, keys, h, n):
    return df.select(*keys, *[F.round(c, 9).alias(k) for c, k in zip(rt.interval(h, n), ("share", "lower", "upper"))])


@query("error_rate_ci", sql("d", f"SELECT source, pos, {_ci('errors', 'depth')} FROM d"))
def error_rate_ci(spark, sf_dir):
    return _rounded(depth(spark, sf_dir), ["source", "pos"], F.col("errors"), F.col("depth"))


def _logit(h: str, n: str, level: float = 0.95) -> str:
    """SQL of the logit interval: share, lower, upper."""
    z, rest = rt.normal_quantile(level), (1 - level) / 2
    end = f"1 / (1 + exp(-(ln({h} / ({n} - {h})) {{sign}} {z} * sqrt(1 / ({n} * ({h} / {n}) * (1 - {h} / {n}))))))"
    low = f"CASE WHEN {n} = 0 THEN NULL WHEN {h} = 0 THEN 0 WHEN {h} = {n} THEN pow({rest}::DOUBLE, 1 / {n}) ELSE {end.format(sign='-')} END"
    high = f"CASE WHEN {n} = 0 THEN NULL WHEN {h} = 0 THEN 1 - pow({rest}::DOUBLE, 1 / {n}) WHEN {h} = {n} THEN 1 ELSE {end.format(sign='+')} END"
    return f"round({h} / nullif({n}, 0), 9) AS share, round({low}, 9) AS lower, round({high}, 9) AS upper"


def _corrected(h: str, n: str) -> str:
    side, moved = f"({Z * Z} / (2 * {n}))", f"(least(0.5::DOUBLE, abs({h} - {n} / 2)) / {n})"
    low = f"CASE WHEN {h} / {n} - {moved} <= 0 THEN 0 ELSE greatest(0, ({h} / {n} - {moved} + {side} - {Z} * sqrt(({h} / {n} - {moved}) * (1 - {h} / {n} + {moved}) / {n} + {side} / (2 * {n}))) / (1 + 2 * {side})) END"
    high = f"CASE WHEN {h} / {n} + {moved} >= 1 THEN 1 ELSE least(1, ({h} / {n} + {moved} + {side} + {Z} * sqrt(({h} / {n} + {moved}) * (1 - {h} / {n} - {moved}) / {n} + {side} / (2 * {n}))) / (1 + 2 * {side})) END"
    return f"round({h} / {n}, 9) AS share, round({low}, 9) AS lower, round({high}, 9) AS upper"


def _interval(df, keys, h, n, method):
    return df.select(*keys, *[F.round(c, 9).alias(k) for c, k in zip(rt.interval(h, n, method), ("share", "lower", "upper"))])


@query("binomial_ci_logit", sql("d", f"SELECT source, pos, {_logit('errors', 'depth')} FROM d"))
def binomial_ci_logit(spark, sf_dir):
    return _interval(depth(spark, sf_dir), ["source", "pos"], F.col("errors"), F.col("depth"), "logit")


@query("binomial_ci_corrected", sql("d", f"SELECT source, pos, {_corrected('errors', 'depth')} FROM d"))
def binomial_ci_corrected(spark, sf_dir):
    return _interval(depth(spark, sf_dir), ["source", "pos"], F.col("errors"), F.col("depth"), "corrected")


def _activity_sql() -> str:
    from .structure import _SPLICED

    return sql("a e", f"WITH {_SPLICED}, x AS (SELECT gene, source, coalesce(spliced, 0) AS h, coalesce(spliced, 0) + coalesce(unspliced, 0) AS n FROM a CROSS JOIN (SELECT DISTINCT source FROM e) LEFT JOIN sc USING (gene, source)) SELECT gene, source, {_logit('h', 'n')} FROM x")


@query("transcription_activity", _activity_sql())
def transcription_activity(spark, sf_dir):
    """Share of spliced reads of each gene and source with its logit interval."""
    from .structure import spliced_unspliced

    found = spliced_unspliced(spark, sf_dir)
    return _interval(found, ["gene", "source"], F.col("spliced"), F.col("spliced") + F.col("unspliced"), "logit")


@query("top_variance_pca")
def top_variance_pca(spark, sf_dir, most: int = 500):
    """Two components of the samples over the ids of the highest variance, with their shares of it."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    norm = ct.size_factor_normalise(counts(spark, sf_dir)).select("id", "sample", F.log2(F.coalesce("norm", F.lit(0.0)) + 1).alias("x"))
    wide = norm.groupBy("id").agg(F.var_samp("x").alias("v")).orderBy(F.desc_nulls_last("v"), "id").limit(most)
    ranked = wide.select("id", (F.row_number().over(W.orderBy("id")) - 1).alias("i"))  # at most ``most`` rows
    each = norm.join(F.broadcast(ranked), "id").groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    rows = each.select("sample", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    p, share = vector_to_array("p"), model.explainedVariance.toArray().tolist()
    return model.transform(rows).select("sample", p[0].alias("pc1"), p[1].alias("pc2"), F.lit(share[0]).alias("share1"), F.lit(share[1]).alias("share2"))

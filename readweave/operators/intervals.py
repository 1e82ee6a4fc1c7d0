"""Joins of positions and intervals with an annotation.

Rows meet genes of their own chromosome only (``chrom`` of the rows, ``g_chrom`` of the genes) and, if ``strand`` is set,
of their own strand (``fwd`` and ``g_fwd``). An annotation, cut in buckets, is broadcast while it has at most ``SMALL``
rows (those after the cut, summed in one scan before it); beyond that the same joins run by shuffle. Interval joins are
equi-joins on chromosome and buckets with a check of the ends behind, so they never compare all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SMALL = 200_000
BUCKET = 256


def side(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def cut_side(df: DataFrame, lo: str, hi: str, width: int, name: str) -> DataFrame:
    """``df`` with a row for each bucket ``name`` that its intervals are in, to be broadcast if those are few."""
    rows = F.greatest(F.lit(0), F.floor(F.col(hi) / width) - F.floor(F.col(lo) / width)) + 1
    spread = df.withColumn(name, buckets(F.col(lo), F.col(hi), width))
    return F.broadcast(spread) if (df.agg(F.sum(rows)).first()[0] or 0) <= SMALL else spread


def buckets(lo: Column, hi: Column, width: int = BUCKET) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.greatest(F.floor(lo / width), F.floor(hi / width))))


def placed(genes: DataFrame, strand: bool, *columns: Column | str) -> DataFrame:
    """Columns of genes with what rows meet them by: _chrom and, if it counts, _fwd."""
    return genes.select(F.col("g_chrom").alias("_chrom"), *([F.col("g_fwd").alias("_fwd")] if strand else []), *columns)


def _meets(strand: bool) -> Column:
    own = F.col("chrom") == F.col("_chrom")
    return own & (F.col("fwd") == F.col("_fwd")) if strand else own


def containing(points: DataFrame, pos: str, intervals: DataFrame, lo: str, hi: str, how: str = "inner", width: int = BUCKET, strand: bool = False) -> DataFrame:
    """Rows of ``points`` with every interval (see `placed`) lo <= pos <= hi of their chromosome."""
    return _containing(points, pos, cut_side(intervals, lo, hi, width, "_bucket"), lo, hi, how, width, strand)


def _containing(points: DataFrame, pos: str, spread: DataFrame, lo: str, hi: str, how: str, width: int, strand: bool) -> DataFrame:
    keyed = points.withColumn("_bucket", F.floor(F.col(pos) / width))
    return keyed.join(spread, (keyed["_bucket"] == spread["_bucket"]) & _meets(strand) & (keyed[pos] >= spread[lo]) & (keyed[pos] <= spread[hi]), how).drop("_bucket", "_chrom", "_fwd")


def overlapping(left: DataFrame, st: str, en: str, right: DataFrame, lo: str, hi: str, width: int = BUCKET, strand: bool = False) -> DataFrame:
    """Pairs of rows whose intervals meet on their chromosome; a pair is taken in the first bucket that both are in."""
    spread = cut_side(right, lo, hi, width, "_b")
    keyed = left.withColumn("_a", buckets(F.col(st), F.col(en), width))
    met = keyed.join(spread, (F.col("_a") == F.col("_b")) & _meets(strand) & (F.col(st) <= F.col(hi)) & (F.col(lo) <= F.col(en)))
    return met.filter(F.col("_a") == F.greatest(F.floor(F.col(st) / width), F.floor(F.col(lo) / width))).drop("_a", "_b", "_chrom", "_fwd")


def shape(genes: DataFrame, strand: bool = False) -> tuple[bool, int]:
    """Whether the stretches between the starts of genes are few enough to be broadcast, and how wide their buckets are.

    A bucket is as wide as a stretch on average, up to twice, so a position meets few of them; buckets hold at most three
    rows for each gene. Joins with one annotation can share its shape.
    """
    span = (F.max("g_st") - F.min("g_st")).cast("long").alias("span")
    by = genes.groupBy("g_chrom", *(["g_fwd"] if strand else [])).agg(F.count("*").alias("n"), span)
    n, length = (x or 0 for x in by.agg(F.sum("n"), F.sum("span")).first())
    return 3 * n <= SMALL, 1 << (length // max(n, 1)).bit_length()


def _asof(points: DataFrame, pos: str, at: Column, genes: DataFrame, out: str, default: Column, strand: bool, upstream: bool, known: tuple[bool, int] | None) -> DataFrame:
    """Starts are turned into the stretches up to the next one (or from the last one), so a position meets one row; behind
    the last start of a chromosome (before the first) a row for each chromosome decides."""
    small, width = known or shape(genes, strand)
    sent = F.broadcast if small else (lambda df: df)
    keys = ["g_chrom", *(["g_fwd"] if strand else [])]
    order = W.partitionBy(*keys).orderBy("g_st", "ord" if upstream else F.desc("ord"))
    if upstream:
        lo, hi = F.col("g_st"), F.lead("g_st").over(order) - 1
        edge = genes.groupBy(*keys).agg(F.max_by("gene", F.struct("g_st", "ord")).alias("_edge_gene"), F.max("g_st").alias("_edge"))
    else:
        lo, hi = F.lag("g_st").over(order) + 1, F.col("g_st")
        edge = genes.groupBy(*keys).agg(F.min_by("gene", F.struct("g_st", F.col("ord"))).alias("_edge_gene"), F.min("g_st").alias("_edge"))
    stretch = placed(genes.withColumn("_lo", lo).withColumn("_hi", hi).filter("_hi >= _lo"), strand, F.col("gene").alias("_gene"), "_lo", "_hi")
    spread = sent(stretch.withColumn("_bucket", buckets(F.col("_lo"), F.col("_hi"), width)))
    met = _containing(points.withColumn("_at", at), "_at", spread, "_lo", "_hi", "left", width, strand)
    met = met.join(sent(placed(edge, strand, "_edge_gene", "_edge")), _meets(strand), "left")
    beyond = F.col("_at") >= F.col("_edge") if upstream else F.col("_at") <= F.col("_edge")
    label = F.when(beyond, F.col("_edge_gene")).otherwise(F.coalesce("_gene", default))
    return met.withColumn(out, F.when(F.col(pos).isNotNull(), label)).drop("_at", "_gene", "_lo", "_hi", "_edge", "_edge_gene", "_chrom", "_fwd")


def _named(default: str | None) -> Column:
    """``default`` with the chromosome behind it; null if there is none."""
    return F.lit(None) if default is None else F.concat_ws(".", F.lit(default), F.col("chrom"))


def asof_upstream(points: DataFrame, pos: str, genes: DataFrame, out: str, tol: int = 5, default: str | None = "st", strand: bool = False, known: tuple[bool, int] | None = None) -> DataFrame:
    """Column out: the last gene that starts at or before pos + tol, else ``default``.chrom; null for a null position."""
    return _asof(points, pos, F.col(pos) + tol, genes, out, _named(default), strand, True, known)


def asof_downstream(points: DataFrame, pos: str, genes: DataFrame, out: str, tol: int = 5, default: str | None = "end", strand: bool = False, known: tuple[bool, int] | None = None) -> DataFrame:
    """Column out: the first gene that starts at or after pos - tol, else ``default``.chrom; null for a null position."""
    return _asof(points, pos, F.col(pos) - tol, genes, out, _named(default), strand, False, known)


def _key_parts(exon_rows: DataFrame, genes: DataFrame, tol: int, strand: bool, carried: Sequence[str] = ()) -> DataFrame:
    """A row for each exon (i from 1, l its end, r the next start or null) and one for each read's start (i 0), with ``part``, its
    label, and carried columns; a read's rows stay where its exons are."""
    after = F.lead("st").over(W.partitionBy("read_id").orderBy("exon"))
    gap = F.struct(F.col("exon").alias("i"), F.col("en").alias("l"), F.col("_after").alias("r"))
    start = F.struct(F.lit(0).alias("i"), F.col("st").alias("l"), F.lit(None).cast("int").alias("r"))
    each = F.explode(F.when(F.col("exon") == 1, F.array(start, gap)).otherwise(F.array(gap)))
    own = list(dict.fromkeys(["read_id", "chrom", "fwd", *carried]))
    points = exon_rows.withColumn("_after", after).select(*own, each.alias("_x")).select(*own, "_x.*")
    known = shape(genes, strand)
    labelled = asof_downstream(asof_upstream(points, "l", genes, "up", tol, strand=strand, known=known), "r", genes, "down", tol, strand=strand, known=known)
    return labelled.withColumn("part", F.concat_ws(",", "up", "down"))


def cluster_key_viral(exon_rows: DataFrame, genes: DataFrame, tol: int = 5, *, start: bool = True, end: bool = True, strand: bool = False) -> DataFrame:
    """read_id and cluster_key: labels of the start, of both sides of each gap, and of the end, joined in their order;
    start and end can be left out."""
    parts = _key_parts(exon_rows, genes, tol, strand)
    kept = parts.filter((F.col("i") > 0) & (F.lit(end) | F.col("r").isNotNull()) | F.lit(start) & (F.col("i") == 0))
    keys = kept.groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "_").alias("cluster_key"))
    if start or end:
        return keys
    # reads without a gap have an empty key
    return exon_rows.select("read_id").distinct().join(keys, "read_id", "left").fillna("", ["cluster_key"])


def keyed_reads(exon_rows: DataFrame, genes: DataFrame, tol: int = 5) -> DataFrame:
    """Reads with their breaks (see read_breaks) and their key of all labels (see cluster_key_viral), from one pass over the exons."""
    parts = F.array_sort(F.collect_list(F.struct("i", "part", "st", "en")))
    found = _key_parts(exon_rows, genes, tol, False, ("source", "st", "en")).groupBy("read_id").agg(*[F.first(c).alias(c) for c in ("source", "chrom", "fwd")], F.min("st").alias("st"), F.max("en").alias("en"), parts.alias("_x"))
    breaks = F.flatten(F.transform(F.filter("_x", lambda x: x["i"] > 0), lambda x: F.array(x["st"], x["en"])))
    key = F.array_join(F.transform("_x", lambda x: x["part"]), "_")
    return found.select("read_id", "source", "chrom", "fwd", "st", "en", (F.size("_x") - 1).cast("long").alias("n_exons"), breaks.alias("breaks"), key.alias("cluster_key"))


def snap_left(points: DataFrame, pos: str, floor: str, genes: DataFrame, out: str, reach: int = 10_000) -> DataFrame:
    """Column out: the last gene start at or before pos, not before ``floor`` nor further than ``reach``; else pos."""
    found = asof_upstream(points, pos, genes.withColumn("gene", F.col("g_st")), "_start", 0, None)
    ok = (F.col("_start") >= F.col(floor)) & (F.col(pos) - F.col("_start") < reach)
    return found.withColumn(out, F.when(ok, F.col("_start")).otherwise(F.col(pos))).drop("_start")


def snap_right(points: DataFrame, pos: str, ceiling: str, genes: DataFrame, out: str, reach: int = 10_000) -> DataFrame:
    """Column out: the first gene start at or after pos, not behind ``ceiling`` nor further than ``reach``; else pos."""
    found = asof_downstream(points, pos, genes.withColumn("gene", F.col("g_st")), "_start", 0, None)
    ok = (F.col("_start") <= F.col(ceiling)) & (F.col("_start") - F.col(pos) < reach)
    return found.withColumn(out, F.when(ok, F.col("_start")).otherwise(F.col(pos))).drop("_start")


def _widened(genes: DataFrame, tol: int, strand: bool, *columns: str) -> DataFrame:
    return placed(genes, strand, *columns, (F.col("g_st") - tol).alias("_lo"), (F.col("g_en") + tol).alias("_hi"))


def nearest_containing(points: DataFrame, key: list[str], pos: str, genes: DataFrame, tol: int, end: str, strand: bool = False) -> DataFrame:
    """Of the genes that hold pos within ``tol`` the one whose ``end`` (g_st or g_en) is nearest, with the distance."""
    met = containing(points, pos, _widened(genes, tol, strand, "ord", "gene", "g_st", "g_en"), "_lo", "_hi", strand=strand).withColumn("distance", F.abs(F.col(end) - F.col(pos)))
    return met.groupBy(*key).agg(F.min_by("gene", F.struct("distance", "ord")).alias("gene"), F.min("distance").alias("distance"))


def exon_match(exon_rows: DataFrame, genes: DataFrame, tol: int, strand: bool = False) -> DataFrame:
    """For each exon inside a gene (within tol) the gene with the least difference of both ends, if at most 2 tol; lowest ord on ties."""
    inside = containing(exon_rows, "st", _widened(genes, tol, strand, "ord", "gene", "g_st", "g_en"), "_lo", "_hi", strand=strand).filter(F.col("en") <= F.col("_hi"))
    inside = inside.withColumn("distance", F.abs(F.col("st") - F.col("g_st")) + F.abs(F.col("en") - F.col("g_en")))
    best = inside.groupBy("read_id", "exon").agg(F.min_by("gene", F.struct("distance", "ord")).alias("gene"), F.min("distance").alias("distance"))
    return best.filter(F.col("distance") <= 2 * tol)


def linked_exon_match(exon_rows: DataFrame, genes: DataFrame, tol: int, strand: bool = False) -> DataFrame:
    """Two neighbouring exons of a read against two neighbouring genes of a transcript: the best pair for each."""
    own = W.partitionBy("read_id").orderBy("exon")
    pairs = exon_rows.select("read_id", "exon", "chrom", "fwd", F.col("en").alias("left_end"), F.lead("st").over(own).alias("right_start")).filter("right_start IS NOT NULL")
    line = W.partitionBy("g_chrom", "transcript").orderBy("g_st", "ord")
    linked = genes.withColumn("t_end", F.col("g_en")).withColumn("t_start", F.lead("g_st").over(line)).withColumn("next_gene", F.lead("gene").over(line)).filter("t_start IS NOT NULL")
    wide = placed(linked, strand, "ord", "gene", "t_end", "t_start", "next_gene", (F.col("t_end") - tol).alias("_lo"), (F.col("t_end") + tol).alias("_hi"))
    met = containing(pairs, "left_end", wide, "_lo", "_hi", strand=strand).filter(F.abs(F.col("right_start") - F.col("t_start")) <= tol)
    met = met.withColumn("distance", F.abs(F.col("left_end") - F.col("t_end")) + F.abs(F.col("right_start") - F.col("t_start")))
    return met.groupBy("read_id", "exon").agg(F.min_by(F.concat_ws(",", "gene", "next_gene"), F.struct("distance", "ord")).alias("genes"), F.min("distance").alias("distance"))


def gene_span(exon_rows: DataFrame, genes: DataFrame, tol: int = 5, strand: bool = False) -> DataFrame:
    """read_id, gene (with its strand g_fwd) and how many of the read's breaks (ends of exons) the gene touches."""
    ends = exon_rows.select("read_id", "chrom", "fwd", F.explode(F.array("st", "en")).alias("at"))
    return containing(ends, "at", _widened(genes, tol, strand, "gene", "g_fwd"), "_lo", "_hi", strand=strand).groupBy("read_id", "gene", "g_fwd").agg(F.count("*").alias("n_breaks"), F.array_sort(F.collect_set("at")).alias("breaks"))


def gene_set_cover(span: DataFrame) -> DataFrame:
    """Biggest-first cover of each read's touched breaks: genes by number of breaks, taken while they add a break."""
    ranked = span.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_breaks")).alias("n"), "gene", "breaks"))).alias("g"))
    empty = F.struct(F.array().cast("array<int>").alias("held"), F.array().cast("array<string>").alias("genes"))

    def take(acc: Column, x: Column) -> Column:
        adds = F.size(F.array_except(x["breaks"], acc["held"])) > 0
        return F.struct(F.when(adds, F.array_union(acc["held"], x["breaks"])).otherwise(acc["held"]).alias("held"), F.when(adds, F.concat(acc["genes"], F.array(x["gene"]))).otherwise(acc["genes"]).alias("genes"))

    return ranked.select("read_id", F.array_join(F.aggregate("g", empty, take, lambda acc: acc["genes"]), ";").alias("genes"))


def cluster_key_host(exon_rows: DataFrame, genes: DataFrame, tol: int, size: int, strand: bool = False) -> DataFrame:
    """Sorted genes of the exons that match one; a read without any gets the binned 3'-most end, by strand."""
    matched = exon_match(exon_rows, genes, tol, strand).groupBy("read_id").agg(F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("genes"))
    ends = exon_rows.groupBy("read_id").agg(F.first("chrom").alias("chrom"), F.first("fwd").alias("fwd"), F.min("st").alias("st"), F.max("en").alias("en"))
    coord = F.concat_ws(".", "chrom", F.floor(F.when(F.col("fwd"), F.col("en")).otherwise(F.col("st")) / size).cast("string"))
    return ends.join(matched, "read_id", "left").select("read_id", F.coalesce("genes", coord).alias("cluster_key"))


def spliced_counts_join(last_segments: DataFrame, genes: DataFrame, near_start: int, left: int = 10, right: int = 100) -> DataFrame:
    """Per gene and source how many reads of its chromosome reach it, spliced (the read begins near the start) or not.

    Reads are first summed by what the join looks at, so it meets distinct positions rather than reads; a read reaches the
    genes whose starts lie in an interval of its own, found by buckets of that interval.
    """
    spliced = (F.col("st") <= near_start).alias("spliced")
    summed = last_segments.groupBy("source", "chrom", spliced, "last_st", "en").agg(F.count("*").alias("n"))
    reach = summed.withColumn("_lo", F.col("last_st") - left).withColumn("_hi", F.col("en") - right - 1).filter("_hi >= _lo")
    at = placed(genes, False, "gene", "g_st", F.col("g_st").alias("_gene_end"))
    met = overlapping(reach, "_lo", "_hi", at, "g_st", "_gene_end")
    return met.groupBy("gene", "source").agg(F.sum(F.when(F.col("spliced"), F.col("n")).otherwise(0)).alias("spliced"), F.sum(F.when(F.col("spliced"), 0).otherwise(F.col("n"))).alias("unspliced"))


def orf_cover_segment(exon_rows: DataFrame, genes: DataFrame, tol: int = 5, share: float = 0.8, strand: bool = False) -> DataFrame:
    """Exons that hold a gene within ``tol``, with the length they share, if it is at least ``share`` of the gene."""
    met = overlapping(exon_rows, "st", "en", placed(genes, strand, "gene", "g_st", "g_en"), "g_st", "g_en", strand=strand).filter((F.col("st") <= F.col("g_st") + tol) & (F.col("en") >= F.col("g_en") - tol))
    held = F.least("en", "g_en") - F.greatest("st", "g_st") + 1
    return met.withColumn("held", held).filter(F.col("held") >= share * (F.col("g_en") - F.col("g_st") + 1))


def gene_label_of_position(points: DataFrame, pos: str, genes: DataFrame, key: list[str], default: str) -> DataFrame:
    """First gene (by ord) that holds a position, else ``default``."""
    met = containing(points, pos, placed(genes, False, "ord", "gene", "g_st", "g_en"), "g_st", "g_en", "left")
    return met.groupBy(*key).agg(F.coalesce(F.min_by("gene", "ord"), F.lit(default)).alias("gene"))


def region_from_genes(genes: DataFrame, left: str | None = None, right: str | None = None, left_range: tuple[int, int] | None = None, right_range: tuple[int, int] | None = None) -> DataFrame:
    """Rectangle of a break map by chromosome: the left gene from its start to its end, and from the start of the gene before
    the right one (1 if it is the first) to the right one's start. A given range takes the place of a gene's; a side with
    neither is null. Chromosomes without any of the named genes are left out, all are there if only ranges are given."""
    line = W.partitionBy("g_chrom").orderBy("g_st", "ord")
    each = genes.withColumn("_before", F.coalesce(F.lag("g_st").over(line), F.lit(1)))
    named = [g for g, r in ((left, left_range), (right, right_range)) if g is not None and r is None]

    def end(k: str, gene: str | None, given: tuple[int, int] | None, i: int, c: str) -> Column:
        if given is not None:
            return F.max(F.lit(given[i])).alias(k)
        return F.max(F.when(F.col("gene") == gene, F.col(c)) if gene is not None else F.lit(None).cast("int")).alias(k)

    sides = [end("left_lo", left, left_range, 0, "g_st"), end("left_hi", left, left_range, 1, "g_en"), end("right_lo", right, right_range, 0, "_before"), end("right_hi", right, right_range, 1, "g_st")]
    kept = each.filter(F.col("gene").isin(*named)) if named else each
    return kept.groupBy(F.col("g_chrom").alias("chrom")).agg(*sides)


def adjust_last_gene(genes: DataFrame, ends: DataFrame) -> DataFrame:
    """The end of each chromosome's last gene is cut where the chromosome's tail of A begins; ends: chrom, body (see rescue.py)."""
    body = ends.select(F.col("chrom").alias("g_chrom"), F.col("body").alias("_body"))
    last = genes.groupBy("g_chrom").agg(F.max_by("ord", F.struct("g_st", "ord")).alias("_last"))
    known = genes.join(last.join(body, "g_chrom", "left"), "g_chrom")
    return known.withColumn("g_en", F.when(F.col("ord") == F.col("_last"), F.least("g_en", F.coalesce("_body", "g_en"))).otherwise(F.col("g_en")).cast("int")).drop("_last", "_body")

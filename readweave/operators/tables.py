"""Result and read tables: filters, replacement through maps, list membership, extraction and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

UNMAPPED, SECONDARY, SUPPLEMENTARY = 0x4, 0x100, 0x800


def filter_mapped(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("flag").bitwiseAND(UNMAPPED) == 0)


def filter_chroms(rows: DataFrame, keep: list[str] | None = None, ignore: list[str] = (), ranges: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Rows on the chromosomes to keep (all if None) and not on those to ignore; on a chromosome with a range, starts inside it."""
    out = rows if keep is None else rows.filter(F.col("chrom").isin(*keep))
    if ignore:
        out = out.filter(~F.col("chrom").isin(*ignore))
    for c, (lo, hi) in (ranges or {}).items():
        out = out.filter((F.col("chrom") != c) | F.col("st").between(lo, hi))
    return out


def filter_primary(rows: DataFrame, order: list[str], least: int) -> DataFrame:
    """Primary records, and supplementary ones of mapping quality ``least`` or more on the chromosome of the record before."""
    w = W.partitionBy("read_id").orderBy(*order)
    extra = F.col("flag").bitwiseAND(SECONDARY | SUPPLEMENTARY) != 0
    follows = (F.col("flag").bitwiseAND(SUPPLEMENTARY) != 0) & (F.col("mapq") >= least) & (F.lag("chrom").over(w) == F.col("chrom"))
    return rows.withColumn("_keep", F.coalesce(~extra | follows, F.lit(False))).filter("_keep").drop("_keep")


def sample_reads(rows: DataFrame, key: str, share: float, seed: str = "") -> DataFrame:
    """A share of the keys, the same in every run and engine: by the first 32 bits of the MD5 of seed and key. A null key is never drawn."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.filter(bits % 1_000_000 < round(share * 1_000_000))


def table_limit(rows: DataFrame, c: str, least: int | None = None, most: int | None = None) -> DataFrame:
    out = rows if least is None else rows.filter(F.col(c) >= least)
    return out if most is None else out.filter(F.col(c) <= most)


def table_replace(rows: DataFrame, c: str, names: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """``c`` is replaced through (old, new) by its first ``;`` part; values without an entry stay. One entry for each old name."""
    if names.limit(most_broadcast + 1).count() <= most_broadcast:
        names = F.broadcast(names)
    found = rows.join(names, F.split(F.col(c), ";")[0] == F.col("old"), "left")
    return found.withColumn(c, F.coalesce("new", c)).drop("old", "new")


def pool_tag(rows: DataFrame, pools: DataFrame, key: str, only: bool = False) -> DataFrame:
    """Keys get the pool of their read as a prefix; ``only`` keeps reads of the pools alone. One pool for each read."""
    found = rows.join(pools, "read_id", "inner" if only else "left")
    return found.withColumn(key, F.concat(F.coalesce(F.concat("pool", F.lit(".")), F.lit("")), F.col(key).cast("string"))).drop("pool")


def extract_clusters(reads: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """Reads whose cluster stands in a ``;`` list of ids, labelled by the group's columns and the number of its ids."""
    ids = F.split("ids", ";")
    label = F.concat_ws("_", *columns, F.size(ids).cast("string"))
    each = groups.select(label.alias("label"), F.explode(ids).alias("cluster_id"))
    return reads.join(each, reads["cluster"].cast("string") == each["cluster_id"]).drop("cluster_id")


def histogram(rows: DataFrame, keys: list[str], x: Column, width: int) -> DataFrame:
    return rows.groupBy(*keys, (F.floor(x / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def quantiles(rows: DataFrame, keys: list[str], x: Column, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    q = rows.groupBy(*keys).agg(F.percentile(x, F.array(*[F.lit(s) for s in shares])).alias("_q"))
    return q.select(*keys, *[F.col("_q")[i].alias(f"q{round(s * 100)}") for i, s in enumerate(shares)])


def filter_transcripts(rows: DataFrame, length: int, start: int | None = None, end: int | None = None, below: tuple[bool, bool] = (True, True), left: str | None = None, right: str | None = None) -> DataFrame:
    """Transcripts (st, en, left_gene, right_gene) that start before ``start`` and end less than ``end`` before the sequence's
    end, or (where ``below`` is false) from there on; and, on request, whose left and right genes are the named ones."""
    out = rows
    for bound, at, less in ((start, F.col("st"), below[0]), (end, F.lit(length) - F.col("en"), below[1])):
        if bound is not None:
            out = out.filter(at < bound if less else at >= bound)
    for gene, c in ((left, "left_gene"), (right, "right_gene")):
        if gene is not None:
            out = out.filter(F.col(c) == gene)
    return out


def spliced_class(n_breaks: Column, leader: Column) -> Column:
    """unspliced, or spliced1 (one break) or spliced2 (more), with or without a leader."""
    side = F.when(F.coalesce(leader, F.lit(False)), "leader").otherwise("noleader")
    return F.when(n_breaks == 0, "unspliced").otherwise(F.concat_ws("_", F.when(n_breaks == 1, "spliced1").otherwise("spliced2"), side))


def end_class(st: Column, en: Column, length: int, margin: int = 100) -> Column:
    """5_3, 5_no3, no5_3 or no5_no3: whether a transcript starts and ends within ``margin`` of the sequence's ends."""
    return F.concat_ws("_", F.when(st < margin, "5").otherwise("no5"), F.when(en > length - margin, "3").otherwise("no3"))


def split_transcripts(rows: DataFrame, kind: Column) -> DataFrame:
    """Number of rows by class; classes without rows don't occur."""
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def filter_second_quality(reads: DataFrame, span: DataFrame, least: int) -> DataFrame:
    """Reads that touch no gene (see gene_span) need a quality of ``least``."""
    touched = span.select("read_id").distinct().withColumn("_touched", F.lit(True))
    found = reads.join(touched, "read_id", "left")
    return found.filter(F.col("_touched").isNotNull() | (F.col("mapq") >= least)).drop("_touched")

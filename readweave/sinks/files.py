"""Writers of read, cluster, isoform and sequence tables. Each is one Spark write; texts are made by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.genome import with_bases
from ..operators.sequences import reverse_complement


def sink_table(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Gzipped tab-separated files with a header; arrays are joined with commas."""
    flat = [F.concat_ws(",", c).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    writer = rows.select(*flat).write.partitionBy(*partition_by) if partition_by else rows.select(*flat).write
    writer.csv(path, sep="\t", header=True, compression="gzip")


def wide_counts(rows: DataFrame, keys: list[str], sources: list[str]) -> DataFrame:
    """count0... by source number in the order of ``sources``, and countTotal."""
    wide = rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).alias(f"count{i}") for i, s in enumerate(sources)])
    return wide.withColumn("countTotal", sum((F.col(f"count{i}") for i in range(len(sources))), F.lit(0)))


def sink_transcripts(isoforms: DataFrame, path: str, keys: list[str], sources: list[str]) -> None:
    """Isoforms or clusters with a count for each source."""
    sink_table(wide_counts(isoforms, keys, sources), path)


def sink_annot_counts(rows: DataFrame, path: str, sources: list[str]) -> None:
    """Gene with columns Spliced_<source> and Unspliced_<source>, from gene, source, spliced, unspliced."""
    cells = [F.coalesce(F.sum(F.when(F.col("source") == s, F.col(k))), F.lit(0)).alias(f"{k.title()}_{s}") for s in sources for k in ("spliced", "unspliced")]
    sink_table(rows.groupBy("gene").agg(*cells), path)


def sink_annotation_summary(genes: DataFrame, path: str) -> None:
    """Gene id, name, description and type, one line for each gene."""
    columns = ["id", "name", "description", "type"]
    sink_table(genes.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns]).dropDuplicates(["id"]), path)


def feature_counts(rows: DataFrame) -> DataFrame:
    """Geneid, Chr, Start, End, Strand, Length, with ``;``-joined exons, from id, chrom, fwd, sts, ens and counts."""
    strand = F.when(F.col("fwd"), "+").otherwise("-")
    each = {"Chr": F.array_repeat("chrom", F.size("sts")), "Start": F.col("sts"), "End": F.col("ens"), "Strand": F.array_repeat(strand, F.size("sts"))}
    length = F.aggregate(F.zip_with("sts", "ens", lambda s, e: e - s), F.lit(0), lambda a, x: a + x)
    counts = [c for c in rows.columns if c.startswith("count")]
    return rows.select(F.col("id").alias("Geneid"), *[F.concat_ws(";", v.cast("array<string>")).alias(k) for k, v in each.items()], length.alias("Length"), *counts)


def bed12(rows: DataFrame) -> DataFrame:
    """source and line of BED12 for every isoform with reads, from id, chrom, fwd, sts, ens, source, n (1-based, inclusive)."""
    start, end = F.array_min("sts") - 1, F.array_max("ens")
    sizes = F.concat_ws(",", F.zip_with("sts", "ens", lambda s, e: e - s + 1).cast("array<string>"))
    starts = F.concat_ws(",", F.transform("sts", lambda s: s - F.array_min("sts")).cast("array<string>"))
    fields = [F.col("chrom"), start, end, F.col("id"), F.col("n"), F.when(F.col("fwd"), "+").otherwise("-"), start, end, F.lit("0"), F.size("sts"), sizes, starts]
    return rows.filter("n > 0").select("source", F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("value"))


def gff3(rows: DataFrame) -> DataFrame:
    """Ordered lines of genes, transcripts and exons with parents and counts, from gene, id, chrom, fwd, sts, ens, n."""
    strand = F.when(F.col("fwd"), "+").otherwise("-")

    def line(kind: str, st: Column, en: Column, attributes: Column) -> Column:
        return F.concat_ws("\t", "chrom", F.lit("np"), F.lit(kind), st.cast("string"), en.cast("string"), F.lit("."), "strand", F.lit("."), attributes)

    own = rows.select("gene", "id", "chrom", strand.alias("strand"), "sts", "ens", "n")
    genes = own.groupBy("gene", "chrom", "strand").agg(F.min(F.array_min("sts")).alias("st"), F.max(F.array_max("ens")).alias("en"), F.sum("n").alias("n"))
    g = genes.select("chrom", "gene", F.lit("").alias("id"), F.lit(0).alias("i"), line("gene", F.col("st"), F.col("en"), F.concat(F.lit("ID="), "gene", F.lit(";count="), F.col("n").cast("string"))).alias("value"))
    t = own.select("chrom", "gene", "id", F.lit(0).alias("i"), line("transcript", F.array_min("sts"), F.array_max("ens"), F.concat(F.lit("ID="), "id", F.lit(";Parent="), "gene", F.lit(";count="), F.col("n").cast("string"))).alias("value"))
    x = own.select("chrom", "gene", "id", "strand", F.posexplode(F.arrays_zip("sts", "ens")).alias("k", "x"))
    e = x.select("chrom", "gene", "id", (F.col("k") + 1).alias("i"), line("exon", F.col("x.sts"), F.col("x.ens"), F.concat(F.lit("Parent="), "id")).alias("value"))
    return g.unionByName(t).unionByName(e)


def sink_gff3(rows: DataFrame, path: str) -> None:
    """Lines in order inside each part; all lines of a gene are in one part."""
    gff3(rows).repartition("chrom", "gene").sortWithinPartitions("chrom", "gene", "id", "i").select("value").write.text(path)


def sink_bed12(rows: DataFrame, path: str) -> None:
    bed12(rows).write.partitionBy("source").text(path)


def fasta(rows: DataFrame, tiled: DataFrame) -> DataFrame:
    """Spliced sequence of every isoform, from id, chrom, sts, ens and the genome's tiles: exons meet the tiles that they touch."""
    exons = rows.select("id", "chrom", F.posexplode(F.arrays_zip(F.col("sts").alias("st"), F.col("ens").alias("en"))).alias("exon", "x"))
    found = with_bases(exons, tiled, ["id", "exon"], {"bases": (F.col("x.st"), F.col("x.en"))})
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("exon", "bases"))), lambda x: x["bases"]), "")
    return found.groupBy("id").agg(put.alias("bases")).select(F.concat(F.lit(">"), "id", F.lit("\n"), "bases").alias("value"))


def sink_transcript_fasta(rows: DataFrame, tiled: DataFrame, path: str) -> None:
    fasta(rows, tiled).write.text(path)


def aln_class(flag: Column) -> Column:
    return F.when(flag.bitwiseAND(0x100) != 0, "secondary").when(flag.bitwiseAND(0x800) != 0, "supplementary").otherwise("primary")


def fastq(name: Column, seq: Column, qual: Column, turned: Column) -> Column:
    """A record in the read's own direction."""
    return F.concat(F.lit("@"), name, F.lit("\n"), F.when(turned, reverse_complement(seq)).otherwise(seq), F.lit("\n+\n"), F.when(turned, F.reverse(qual)).otherwise(qual))


def sink_fastq_subset(reads: DataFrame, path: str, chroms: list[str]) -> None:
    """FASTQ by chromosome, alignment class and source, from read_id, flag, chrom, seq, qual, source."""
    turned = F.col("flag").bitwiseAND(0x10) != 0
    own = reads.filter(F.col("chrom").isin(*chroms))
    own.select("chrom", aln_class(F.col("flag")).alias("aln_class"), "source", fastq(F.col("read_id"), F.col("seq"), F.col("qual"), turned).alias("value")).write.partitionBy("chrom", "aln_class", "source").text(path)


def sink_leftover(reads: DataFrame, path: str) -> None:
    """FASTQ by source, from read_id, seq, qual, source."""
    reads.select("source", fastq(F.col("read_id"), F.col("seq"), F.col("qual"), F.lit(False)).alias("value")).write.partitionBy("source").text(path)


def sink_cluster_sequences(members: DataFrame, path: str, most: int) -> None:
    """FASTA by cluster, at most so many sequences each (the operator's own limit), from cluster, read_id, seq."""
    w = W.partitionBy("cluster").orderBy("read_id", "seq")
    kept = members.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    kept.select("cluster", F.concat(F.lit(">"), "read_id", F.lit("\n"), "seq").alias("value")).write.partitionBy("cluster").text(path)


def sink_depth_store(depth: DataFrame, path: str, run: str, keys: list[str], threshold: int) -> None:
    """Depth of keys whose peak is above the threshold, added to the store as a run of its own."""
    deep = depth.groupBy(*keys).agg(F.max("depth").alias("_m")).filter(F.col("_m") > threshold)
    depth.join(deep, keys, "left_semi").withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def read_depth_store(spark, path: str, keys: list[str]) -> DataFrame:
    """Depth and errors over all runs of a store."""
    return spark.read.parquet(path).groupBy(*keys, "pos").agg(F.sum("depth").alias("depth"), F.sum("errors").alias("errors"))


def sink_isoform_store(isoforms: DataFrame, path: str, run: str, keys: list[str], threshold: int, total: int | None = None, each: int | None = None) -> None:
    """Isoforms (keys, n; source and iso_key if the others count), added to the store as a run of its own.

    A cluster goes in if one of its rows has ``threshold`` reads; with ``total`` an isoform only if all its sources together
    have so many, with ``each`` only if one of its sources has.
    """
    deep = isoforms.groupBy(*keys).agg(F.max("n").alias("_m")).filter(F.col("_m") >= threshold)
    kept = isoforms.join(deep, keys, "left_semi")
    if total is not None or each is not None:
        own = [*keys, "iso_key"]
        enough = isoforms.groupBy(*own).agg(F.sum("n").alias("_t"), F.max("n").alias("_e")).filter((F.col("_t") >= (total or 0)) & (F.col("_e") >= (each or 0)))
        kept = kept.join(enough, own, "left_semi")
    kept.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def sink_breakpoints(cells: DataFrame, path: str) -> None:
    """Cells of break matrices, with their marginals (a null side stands for the sum over it)."""
    sides = cells.cube("left", "right").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    sides.filter("level < 3").write.partitionBy("level").parquet(path)

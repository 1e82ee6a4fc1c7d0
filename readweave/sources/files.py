"""Readers of alignments, sequences, annotations and count tables, as DataFrames.

All are Spark readers over one or many paths, so files are split or dealt over tasks; lines that don't fit a format are
dropped where that is stated, else their fields are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.sequences import parse_attributes

Paths = str | list[str]


def file_source() -> Column:
    """Name of the file up to its first dot."""
    return F.substring_index(F.col("_metadata.file_name"), ".", 1)


def scan_alignments(spark: SparkSession, paths: Paths) -> DataFrame:
    """Records of SAM text without the header: the eleven fields, further tags as an array, and the source (file name)."""
    lines = spark.read.text(paths).select("value", file_source().alias("source")).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split("value", "\t")
    fields = {"read_id": "string", "flag": "int", "chrom": "string", "pos": "int", "mapq": "int", "cigar": "string", "mate_chrom": "string", "mate_pos": "int", "template_length": "int", "seq": "string", "qual": "string"}
    return lines.select(*[F.get(f, i).try_cast(t).alias(k) for i, (k, t) in enumerate(fields.items())], F.slice(f, 12, F.greatest(F.lit(0), F.size(f) - 11)).alias("tags"), "source")


def scan_fasta(spark: SparkSession, paths: Paths) -> DataFrame:
    """name, description and seq; records are cut at > at the start of a line."""
    whole = spark.read.option("lineSep", "\n>").text(paths)
    rec = F.regexp_replace("value", "^>", "")
    head = F.trim(F.substring_index(rec, "\n", 1))
    body = F.regexp_replace(F.when(rec.contains("\n"), F.expr("substring(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\n') + 1)")).otherwise(""), r"\s", "")
    named = whole.select(F.substring_index(head, " ", 1).alias("name"), F.regexp_extract(head, r"^\S+\s+(.*)$", 1).alias("description"), body.alias("seq"))
    return named.filter("name <> ''")


def numbered_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """value, file, source and no (of the line in its file, from 0).

    Lines are numbered inside each split of a file; splits, a row each, are summed to give their first numbers.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), file_source().alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("_n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy("file", "block").orderBy("_at")) - 1
    return lines.withColumn("_i", inside).join(first, ["file", "block"]).select("value", "file", "source", (F.col("_first") + F.col("_i")).alias("no"))


def scan_fastq(spark: SparkSession, paths: Paths) -> DataFrame:
    """name, description, seq, qual of four-line records, and the source; an unfinished last record is dropped."""
    lines = numbered_lines(spark, paths).withColumn("_k", F.col("no") % 4)
    four = [F.max(F.when(F.col("_k") == k, F.col("value"))).alias(f"l{k}") for k in (0, 1, 3)]
    rec = lines.groupBy("file", "source", F.floor(F.col("no") / 4).alias("rec")).agg(*four).filter("l3 IS NOT NULL")
    head = F.regexp_replace("l0", "^@", "")
    return rec.select(F.substring_index(head, " ", 1).alias("name"), F.regexp_extract(head, r"^\S+\s+(.*)$", 1).alias("description"), F.col("l1").alias("seq"), F.col("l3").alias("qual"), "source")


def scan_coordinates(spark: SparkSession, paths: Paths, enforce_strand: bool = False) -> DataFrame:
    """Flat annotation: gene, g_st, g_en, g_fwd and ord, that rises in the order of the file; ``both`` gives a row for each strand
    if strands count."""
    rows = spark.read.csv(paths, header=True)
    way = F.lower("Direction")
    strands = F.when(way == "forward", F.array(F.lit(True))).when(way == "reverse", F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)) if enforce_strand else F.array(F.lit(True)))
    return rows.select(F.col("gene"), F.col("Minimum").cast("int").alias("g_st"), F.col("Maximum").cast("int").alias("g_en"), F.explode(strands).alias("g_fwd"), F.monotonically_increasing_id().alias("ord"))


def scan_gff(spark: SparkSession, paths: Paths, types: tuple[str, ...] = ("exon",), parent: str = "Parent") -> DataFrame:
    """Rows of the chosen types of GFF3 or GTF: chrom, type, g_st, g_en, g_fwd, transcript and the attributes as a map."""
    names = "chrom string, origin string, type string, g_st int, g_en int, score string, strand string, phase string, attributes string"
    rows = spark.read.csv(paths, sep="\t", comment="#", quote="", schema=names).filter(F.col("type").isin(*types))
    at = parse_attributes(F.col("attributes"))
    rows = rows.withColumn("attributes", at)
    owner = F.coalesce(*[F.try_element_at("attributes", F.lit(k)) for k in (parent, "transcript_id", "ID", "Name")])
    return rows.select("chrom", "type", "g_st", "g_en", (F.col("strand") != "-").alias("g_fwd"), owner.alias("transcript"), "attributes")


def scan_read_list(spark: SparkSession, paths: Paths) -> DataFrame:
    """Read ids of plain lists (pool: the file's name) or of read tables (pool: chrom;ORF:end), gzipped or not."""
    f = F.split("value", "\t")
    lines = spark.read.text(paths).select("value", file_source().alias("pool")).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    group = F.when(F.size(f) >= 4, F.concat(f[1], F.lit(";"), f[2], F.lit(":"), f[3])).otherwise(F.col("pool"))
    return lines.select(f[0].alias("read_id"), group.alias("pool")).distinct()


def scan_result_table(spark: SparkSession, paths: Paths, where: dict[str, str] | None = None) -> DataFrame:
    """A result table with header; # lines are skipped; equalities are pushed to the reader."""
    rows = spark.read.csv(paths, sep="\t", comment="#", header=True)
    for c, v in (where or {}).items():
        rows = rows.filter(F.col(c) == v)
    return rows


def scan_transcripts(spark: SparkSession, paths: Paths, error: str = "errorRatio", total: str = "countTotal") -> DataFrame:
    """Transcripts by total, largest first; a missing error ratio is -0.01."""
    rows = scan_result_table(spark, paths).withColumn(total, F.col(total).cast("long"))
    if error in rows.columns:
        x = F.col(error).try_cast("double")
        rows = rows.withColumn(error, F.when(x.isNull() | F.isnan(x), -0.01).otherwise(x))
    return rows.orderBy(F.desc(total), *[c for c in rows.columns if c != total][:1])


def scan_annot_counts(spark: SparkSession, paths: Paths) -> DataFrame:
    """Gene, kind (Spliced, Unspliced), source number and n, from a column for each."""
    rows = spark.read.csv(paths, sep="\t", header=True)
    wide = [c for c in rows.columns if c.startswith(("Spliced_", "Unspliced_"))]
    long = rows.select("Gene", *[F.col(c).cast("long").alias(c) for c in wide]).unpivot("Gene", wide, "name", "n")
    return long.select("Gene", F.substring_index("name", "_", 1).alias("kind"), F.regexp_extract("name", "([0-9]+)$", 1).cast("int").alias("source"), "n")


def scan_host_virus_counts(spark: SparkSession, paths: Paths, names: int = 3) -> DataFrame:
    """sample (the first columns joined), kind and n; repeated samples are summed."""
    rows = spark.read.csv(paths, header=True)
    kinds = rows.columns[names:]
    summed = rows.groupBy(F.concat_ws("_", *[F.col(f"`{c}`") for c in rows.columns[:names]]).alias("sample")).agg(*[F.sum(F.col(f"`{c}`").cast("long")).alias(c) for c in kinds])
    return summed.unpivot("sample", [F.col(f"`{c}`") for c in kinds], "kind", "n")


def scan_motif_hits(spark: SparkSession, paths: Paths) -> DataFrame:
    """One row: the distinct matched sequences joined with |."""
    rows = spark.read.csv(paths, sep="\t", comment="#", header=True)
    return rows.filter("matched_sequence IS NOT NULL").agg(F.concat_ws("|", F.array_sort(F.collect_set("matched_sequence"))).alias("motif"))


def scan_peptides(spark: SparkSession, path: str) -> DataFrame:
    """type, st, en mapped by (x - 1) * step + offset from the # line; the first of equal starts stays."""
    lines = spark.read.text(path)
    mapping = lines.filter("value LIKE '#%'").select(F.split(F.substring("value", 2, 100), ",").alias("m")).limit(1)
    f = F.split("value", ",")
    rows = lines.filter("value NOT LIKE '#%' AND value <> ''").select(f[0].alias("type"), F.try_element_at(f, F.lit(2)).try_cast("int").alias("a"), F.try_element_at(f, F.lit(3)).try_cast("int").alias("b")).filter("a IS NOT NULL")

    def at(c: str) -> Column:
        return ((F.col(c) - 1) * F.col("m")[1].cast("int") + F.col("m")[0].cast("int")).cast("int")

    mapped = rows.join(F.broadcast(mapping)).select("type", at("a").alias("st"), at("b").alias("en"))  # the mapping is one row
    return mapped.withColumn("_r", F.row_number().over(W.partitionBy("st").orderBy("en", "type"))).filter("_r = 1").drop("_r")


def scan_feature_counts(spark: SparkSession, paths: Paths) -> DataFrame:
    """Geneid, the sample's column and n of feature counts; the cell type is the folder above the file."""
    rows = spark.read.csv(paths, sep="\t", comment="#", header=True)
    samples = rows.columns[6:]
    tagged = rows.select("Geneid", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("cell"), *[F.col(f"`{c}`").cast("long").alias(c) for c in samples])
    return tagged.unpivot(["Geneid", "cell"], [F.col(f"`{c}`") for c in samples], "sample", "n")


def scan_fastq_headers(spark: SparkSession, paths: Paths, n: int = 13) -> DataFrame:
    """The space-divided fields of the record names, c0 to c12; rows with an empty second field are dropped."""
    f = F.split(F.concat_ws(" ", "name", "description"), " ")
    rows = scan_fastq(spark, paths).select(*[F.get(f, i).alias(f"c{i}") for i in range(n)])
    return rows.filter("c1 IS NOT NULL AND c1 <> ''")


def scan_tagged_csvs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of all files with the name of theirs."""
    return spark.read.csv(paths, header=True).select("*", file_source().alias("tag"))


def scan_sample_decode(spark: SparkSession, paths: Paths) -> DataFrame:
    """sample and alias from lines of two tab-divided fields; of a repeated sample the first alias by name. Other lines are dropped."""
    f = F.split("value", "\t")
    rows = spark.read.text(paths).filter(F.size(f) == 2).select(F.trim(f[0]).alias("sample"), F.trim(f[1]).alias("alias")).filter("sample <> '' AND alias <> ''")
    return rows.groupBy("sample").agg(F.min("alias").alias("alias"))


def scan_counts_store(spark: SparkSession, path: str, samples: list[str], ids: list[str] | None = None, runs: list[str] | None = None) -> DataFrame:
    """id and a column for each sample, summed over runs, 0 where there is no row.

    The store is partitioned by run; runs prune its folders, samples and ids go down to the reader, so columns of other runs
    that don't know a sample cost nothing.
    """
    rows = spark.read.parquet(path)
    if runs is not None:
        rows = rows.filter(F.col("run").isin(*runs))
    rows = rows.filter(F.col("sample").isin(*samples))
    if ids is not None:
        rows = rows.filter(F.col("id").isin(*ids))
    return rows.groupBy("id").pivot("sample", samples).agg(F.sum("n")).fillna(0, samples)


def scan_depth_store(spark: SparkSession, path: str, key: str, keys: list[str], samples: list[str] | None = None, groups: dict[str, str] | None = None, total: bool = False, runs: list[str] | None = None) -> DataFrame:
    """Depth and errors of chosen keys by group of samples and position, over all runs or the chosen ones: key, grp, pos, depth, errors.

    The store is partitioned by run; runs prune its folders, keys and samples go down to the reader. See `depth_groups`.
    """
    rows = spark.read.parquet(path)
    if runs is not None:
        rows = rows.filter(F.col("run").isin(*runs))
    return depth_groups(rows.filter(F.col(key).isin(*keys)), key, samples, groups, total)


def depth_groups(rows: DataFrame, key: str, samples: list[str] | None = None, groups: dict[str, str] | None = None, total: bool = False) -> DataFrame:
    """Depth and errors (key, source, pos, depth, errors) of the chosen samples, added by group of samples (grp; a sample without
    a group is its own) and, with ``total``, over all of them (grp ``all``), in one pass."""
    if samples is not None:
        rows = rows.filter(F.col("source").isin(*samples))
    grp = F.col("source")
    if groups:
        grp = F.coalesce(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[grp], grp)
    own = rows.withColumn("grp", grp)
    sums = [F.sum("depth").alias("depth"), F.sum("errors").alias("errors")]
    if not total:
        return own.groupBy(key, "grp", "pos").agg(*sums)
    sets = own.groupingSets([[F.col(key), F.col("grp"), F.col("pos")], [F.col(key), F.col("pos")]], F.col(key), F.col("grp"), F.col("pos"))
    return sets.agg(*sums, F.grouping("grp").alias("_all")).select(key, F.when(F.col("_all") == 1, "all").otherwise(F.col("grp")).alias("grp"), "pos", "depth", "errors")


def scan_breakpoints(spark: SparkSession, path: str, shift: int = 0) -> DataFrame:
    """left, right, n from a matrix with positions of columns in the header and of rows in the first column; zeros are left out."""
    rows = spark.read.csv(path, header=True)
    first, *cols = rows.columns
    long = rows.select(F.col(first).cast("int").alias("left"), *[F.col(f"`{c}`").cast("long").alias(c) for c in cols]).unpivot("left", [F.col(f"`{c}`") for c in cols], "_c", "n")
    return long.filter("n > 0").select((F.col("left") + shift).alias("left"), (F.col("_c").cast("int") + shift).alias("right"), "n")

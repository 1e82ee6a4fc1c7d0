"""Readers and writers over small files, and sequence operators against plain Python."""

import gzip
import itertools
import random

from pyspark.sql import functions as F

from readweave.operators import sequences as sq
from readweave.operators.genome import tiles
from readweave.sinks import files as out
from readweave.sources import files as src


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_alignments(spark, tmp_path):
    p = put(tmp_path / "one.x.sam", "@HD\tVN:1\nr1\t16\tc\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    got = src.scan_alignments(spark, [p])
    assert rows(got.select("read_id", "flag", "pos", "cigar", "seq", F.size("tags"), "source"), "read_id") == [("r1", 16, 5, "4M", "ACGT", 1, "one"), ("r2", 4, 0, "*", "AC", 0, "one")]


def test_fasta_and_fastq(spark, tmp_path):
    fa = put(tmp_path / "g.fa", ">a first one\nACG\nT\n>b\nGG\n")
    assert rows(src.scan_fasta(spark, fa)) == [("a", "first one", "ACGT"), ("b", "", "GG")]
    fq = put(tmp_path / "q.fastq", "@r1 x y\nACGT\n+\n@III\n@r2\nAC\n+r2\n+I\n")
    assert rows(src.scan_fastq(spark, fq)) == [("r1", "x y", "ACGT", "@III", "q"), ("r2", "", "AC", "+I", "q")]
    assert rows(src.scan_fastq_headers(spark, fq, 3)) == [("r1", "x", "y")]


def test_annotations(spark, tmp_path):
    c = put(tmp_path / "c.csv", "Name,Type,Minimum,Maximum,Length,Direction,gene\nx,g,1,75,75,forward,lead\ny,g,80,90,11,both,S\n")
    assert rows(src.scan_coordinates(spark, c).drop("ord")) == [("S", 80, 90, True), ("lead", 1, 75, True)]
    assert len(rows(src.scan_coordinates(spark, c, enforce_strand=True).drop("ord"))) == 3
    g = put(tmp_path / "a.gff", '#x\nc1\to\texon\t5\t9\t.\t-\t.\tID=e1;Parent=t1\nc1\to\tgene\t1\t9\t.\t+\t.\tID=g\nc1\to\texon\t1\t3\t.\t+\t.\ttranscript_id "t2"; gene "g 2";\n')
    got = src.scan_gff(spark, g)
    assert rows(got.select("g_st", "g_en", "g_fwd", "transcript", F.try_element_at("attributes", F.lit("gene")))) == [(1, 3, True, "t2", "g 2"), (5, 9, False, "t1", None)]


def test_tables(spark, tmp_path):
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write("#a\tb\nID\tcountTotal\terrorRatio\nx\t3\tNaN\ny\t9\t0.5\n")
    p = str(tmp_path / "t.tsv.gz")
    assert rows(src.scan_result_table(spark, p, {"ID": "x"})) == [("x", "3", "NaN")]
    assert [tuple(r) for r in src.scan_transcripts(spark, p).collect()] == [("y", 9, 0.5), ("x", 3, -0.01)]
    a = put(tmp_path / "an.tsv", "Gene\tStart\tEnd\tSpliced_5_0\tUnspliced_5_0\nS\t1\t2\t7\t8\n")
    assert rows(src.scan_annot_counts(spark, a)) == [("S", "Spliced", 0, 7), ("S", "Unspliced", 0, 8)]
    h = put(tmp_path / "h.csv", "m,c,t,Host,Map.to.x\nR,v,1,3,4\nR,v,1,5,6\n")
    assert rows(src.scan_host_virus_counts(spark, h)) == [("R_v_1", "Host", 8), ("R_v_1", "Map.to.x", 10)]
    m = put(tmp_path / "m.tsv", "motif_id\tmatched_sequence\na\tCC\na\tAC\na\tCC\n# end\n")
    assert rows(src.scan_motif_hits(spark, m)) == [("AC|CC",)]
    e = put(tmp_path / "p.csv", "#293,3\ntype,start,end\nRegion,37,109\nOther,37,120\n")
    assert rows(src.scan_peptides(spark, e)) == [("Region", 401, 617)]
    b = put(tmp_path / "b.csv", "pos,10,20\n1,0,5\n2,6,0\n")
    assert rows(src.scan_breakpoints(spark, b, 1)) == [(2, 21, 5), (3, 11, 6)]
    r = put(tmp_path / "list.txt", "r1\nr2\nr1\n")
    assert rows(src.scan_read_list(spark, r)) == [("r1", "list"), ("r2", "list")]


ISO = "id string, gene string, chrom string, fwd boolean, sts array<int>, ens array<int>, source string, n long"


def test_writers(spark, tmp_path):
    iso = spark.createDataFrame([("g.t0", "g", "c", True, [1, 11], [4, 12], "s0", 3), ("g.t1", "g", "c", True, [2], [5], "s1", 0)], ISO)
    out.sink_bed12(iso, str(tmp_path / "bed"))
    assert rows(spark.read.text(str(tmp_path / "bed"))) == [("c\t0\t12\tg.t0\t3\t+\t0\t12\t0\t2\t4,2\t0,10", "s0")]
    out.sink_gff3(iso, str(tmp_path / "gff"))
    back = src.scan_gff(spark, str(tmp_path / "gff"))
    assert rows(back.select("g_st", "g_en", "transcript")) == [(1, 4, "g.t0"), (2, 5, "g.t1"), (11, 12, "g.t0")]
    genome = tiles(spark.createDataFrame([("c", "ACGTACGTACGT")], "name string, seq string"))
    out.sink_transcript_fasta(iso, genome, str(tmp_path / "fa"))
    assert rows(src.scan_fasta(spark, str(tmp_path / "fa"))) == [("g.t0", "", "ACGTGT"), ("g.t1", "", "CGTA")]
    out.sink_transcripts(iso, str(tmp_path / "tr"), ["id"], ["s0", "s1"])
    assert rows(src.scan_result_table(spark, str(tmp_path / "tr"))) == [("g.t0", "3", "0", "3"), ("g.t1", "0", "0", "0")]
    assert rows(out.feature_counts(iso).filter("Geneid = 'g.t0'")) == [("g.t0", "c;c", "1;11", "4;12", "+;+", 4)]


def test_fastq_writer_and_stores(spark, tmp_path):
    reads = spark.createDataFrame([("r1", 16, "c", "AACG", "ABCD", "s"), ("r2", 2048, "d", "A", "I", "s")], "read_id string, flag int, chrom string, seq string, qual string, source string")
    out.sink_fastq_subset(reads, str(tmp_path / "fq"), ["c"])
    assert rows(src.scan_fastq(spark, str(tmp_path / "fq/chrom=c/aln_class=primary/source=s")).select("name", "seq", "qual")) == [("r1", "CGTT", "DCBA")]
    depth = spark.createDataFrame([("k", 1, 5, 1), ("k", 2, 1, 0), ("l", 1, 2, 0)], "key string, pos int, depth long, errors long")
    for run in ("a", "b"):
        out.sink_depth_store(depth, str(tmp_path / "d"), run, ["key"], 2)
    assert rows(out.read_depth_store(spark, str(tmp_path / "d"), ["key"])) == [("k", 1, 10, 2), ("k", 2, 2, 0)]


def test_alignment_cost(spark):
    def plain(a, b):
        t = {(0, 0): 0}
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            if i or j:
                ways = [(i - 1, j, 2), (i, j - 1, 2), (i - 1, j - 1, i and j and a[i - 1] != b[j - 1])]
                t[i, j] = min(t[p, q] + cost for p, q, cost in ways if (p, q) in t)
        return t[len(a), len(b)]

    rnd = random.Random(3)
    pairs = [tuple("".join(rnd.choices("ACGT", k=rnd.randrange(12))) for _ in "ab") for _ in range(60)] + [("", ""), (None, "A")]
    got = sq.nw_cost(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert len(got) == len(pairs)
    assert all(r["cost"] == (None if r["a"] is None else plain(r["a"], r["b"])) for r in got)


def test_reading_frames(spark):
    table = {"".join(c): sq.CODE[i] for i, c in enumerate(itertools.product(sq.BASES, repeat=3))}

    def plain(s):
        for i in range(len(s) - 2):
            if s[i : i + 3] == "ATG":
                p = "".join(table[s[k : k + 3]] for k in range(i, len(s) - 2, 3))
                yield i + 1, p.split("*")[0], len(p.split("*")[0]), "*" in p

    rnd = random.Random(4)
    seqs = ["".join(rnd.choices("ACGT", k=200)) for _ in range(30)] + ["ATG", "ATGTAA", "", "AT"]
    got = rows(sq.find_orfs(spark.createDataFrame(list(enumerate(seqs)), "id int, seq string"), "id"))
    assert got == sorted((i, *x) for i, s in enumerate(seqs) for x in plain(s))


def test_names(spark):
    df = spark.createDataFrame([("1.x", 0.01234), ("chr2", 12.0), ("NC_1.2", 1234.0)], "name string, x double")
    assert [r[0] for r in df.select(sq.normalise_chrom(F.col("name"))).collect()] == ["chr1", "chr2", "NC_1"]
    assert [r[0] for r in df.select(sq.phred(F.lit("!I")).alias("q")).limit(1).collect()] == [[0, 40]]
    assert sq.kmer_offset_sets(2) == [[0], [0, 1], [-1, 0]]


def test_more_readers_and_writers(spark, tmp_path):
    (tmp_path / "cellA").mkdir()
    f = put(tmp_path / "cellA/f.tsv", "# made by x\nGeneid\tChr\tStart\tEnd\tStrand\tLength\ta.bam\ng\tc\t1\t9\t+\t9\t4\n")
    assert rows(src.scan_feature_counts(spark, f)) == [("g", "cellA", "a.bam", 4)]
    tagged = [put(tmp_path / f"{n}.csv", f"x\n{n}1\n") for n in ("p", "q")]
    assert rows(src.scan_tagged_csvs(spark, tagged)) == [("p1", "p"), ("q1", "q")]
    cells = spark.createDataFrame([(1, 5, 2), (1, 6, 3)], "left int, right int, n long")
    out.sink_breakpoints(cells, str(tmp_path / "bp"))
    assert rows(spark.read.parquet(str(tmp_path / "bp")).filter("level = 1").select("left", "n")) == [(1, 5)]
    members = spark.createDataFrame([("k", "r2", "C"), ("k", "r1", "A"), ("l", "r3", "G")], "cluster string, read_id string, seq string")
    out.sink_cluster_sequences(members, str(tmp_path / "cs"), 1)
    assert rows(src.scan_fasta(spark, str(tmp_path / "cs"))) == [("r1", "", "A"), ("r3", "", "G")]
    iso = spark.createDataFrame([("k", "k.t0", 9), ("k", "k.t1", 1), ("l", "l.t0", 2)], "key string, id string, n long")
    out.sink_isoform_store(iso, str(tmp_path / "iso"), "a", ["key"], 5)
    assert rows(spark.read.parquet(str(tmp_path / "iso")).select("id")) == [("k.t0",), ("k.t1",)]
    two = spark.createDataFrame([("k", "i", "a", 9), ("k", "j", "a", 3), ("k", "j", "b", 3), ("k", "m", "a", 1)], "key string, iso_key string, source string, n long")
    for run, more, want in (("t", {"total": 6}, {"i", "j"}), ("e", {"each": 4}, {"i"}), ("n", {}, {"i", "j", "m"})):
        out.sink_isoform_store(two, str(tmp_path / "iso2"), run, ["key"], 5, **more)
        assert {r["iso_key"] for r in spark.read.parquet(str(tmp_path / "iso2")).filter(F.col("run") == run).collect()} == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_depth_store_is_pruned_and_pushed_down(spark, tmp_path):
    depth = "cluster string, source string, pos int, depth long, errors long"
    path = str(tmp_path / "depth")
    first = [("k1", "a", 1, 5, 1), ("k1", "b", 1, 7, 0), ("k1", "c", 2, 1, 1), ("k2", "a", 1, 9, 9)]
    out.sink_depth_store(spark.createDataFrame(first, depth), path, "r1", ["cluster"], 0)
    out.sink_depth_store(spark.createDataFrame([("k1", "a", 1, 10, 2)], depth), path, "r2", ["cluster"], 0)
    found = src.scan_depth_store(spark, path, "cluster", ["k1"], ["a", "b"], {"a": "ab", "b": "ab"}, total=True, runs=["r1"])
    assert rows(found.select("cluster", "grp", "pos", "depth", "errors")) == [("k1", "ab", 1, 12, 1), ("k1", "all", 1, 12, 1)]
    plan = plan_of(found)
    assert "PartitionFilters: [isnotnull(run" in plan and "r1" in plan.split("PartitionFilters")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "k1" in pushed and "EqualTo(cluster" in pushed.replace("In(cluster", "EqualTo(cluster") and "source" in pushed
    both = src.scan_depth_store(spark, path, "cluster", ["k1"])
    assert rows(both.select("grp", "pos", "depth", "errors")) == [("a", 1, 15, 3), ("b", 1, 7, 0), ("c", 2, 1, 1)]


def test_counts_store(spark, tmp_path):
    path = str(tmp_path / "counts")
    spark.createDataFrame([("i", "a", 2, "r1"), ("i", "a", 3, "r2"), ("j", "b", 1, "r1"), ("j", "z", 9, "r2")], "id string, sample string, n long, run string").write.partitionBy("run").parquet(path)
    assert rows(src.scan_counts_store(spark, path, ["a", "b", "none"])) == [("i", 5, 0, 0), ("j", 0, 1, 0)]
    one = src.scan_counts_store(spark, path, ["a", "b"], ["i"], ["r2"])
    assert rows(one) == [("i", 3, 0)]
    plan = plan_of(one)
    assert "r2" in plan.split("PartitionFilters")[1].split("]")[0] and "id,i" in plan.split("PushedFilters: [")[1].split("]\n")[0].replace(" ", "")


def test_sample_aliases_and_places(spark, tmp_path):
    p = put(tmp_path / "decode.txt", "virion\tRNA_virion_0hpi\nx\ty\nx\tb\nbroken line\n\t\n")
    assert rows(src.scan_sample_decode(spark, p)) == [("virion", "RNA_virion_0hpi"), ("x", "b")]
    c = put(tmp_path / "c.csv", "Name,Type,Minimum,Maximum,Length,Direction,gene\nb,b,50,60,10,forward,b\na,a,1,20,20,reverse,a\n")
    assert [r["gene"] for r in src.scan_coordinates(spark, c).orderBy("ord").collect()] == ["b", "a"]


def test_counts_and_leftover_writers(spark, tmp_path):
    out.sink_leftover(spark.createDataFrame([("r", "ACG", "III", "s0")], "read_id string, seq string, qual string, source string"), str(tmp_path / "left"))
    assert rows(spark.read.text(str(tmp_path / "left"))) == [("+", "s0"), ("@r", "s0"), ("ACG", "s0"), ("III", "s0")]


def test_significant_digits(spark):
    from pyspark.sql import functions as F

    from readweave.operators.sequences import format_sig3

    values = [0.000123456, 12.3456, 1234567.0, 0.5, 0.0, 100.0]
    got = [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(format_sig3(F.col("v")).alias("x")).collect()]
    assert got == ["0.000123", "12.3", "1.23e+06", "0.500", "0.00", "100"]  # trailing zeros stay

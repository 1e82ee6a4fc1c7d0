"""Streams of reads against the same reads as one batch; read ends against plain Python."""

import os
import random

from pyspark.sql import functions as F

from readweave.operators import leftovers as lo
from readweave.streaming import clusters as sc

SCHEMA = "chrom string, cluster_key string, source string"


def test_streams_of_two_folders(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.choice("kl"), rnd.choice("st")) for _ in range(200)]
    for i in range(4):
        spark.createDataFrame(rows[i * 50 : i * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i % 2}"))
    both = sc.stream_merge_sources([sc.stream_reads(spark, str(tmp_path / f"in{i}"), SCHEMA, 1) for i in range(2)])
    sc.start_clusters(both, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    want = {(*k, rows.count(k)) for k in set(rows)}
    assert {tuple(r) for r in sc.latest(spark, str(tmp_path / "out")).collect()} == want


def test_read_ends(spark):
    reads = [("r1", "5S10M2S", "AACCGGTTAACCGGTTA", [30] * 17, 50, 60), ("r2", "10M6S", "A" * 10 + "CCCCCC", [2] * 16, 5, 90), ("r3", "10M", "A" * 10, [30] * 10, 50, 60)]
    df = spark.createDataFrame(reads, "read_id string, cigar string, seq string, q array<int>, st int, en int")
    assert [tuple(r)[:3] for r in lo.leftover_ends(df, 4, 20).collect()] == [("r1", "left", "AACCG")]
    assert [tuple(r) for r in lo.rescue_candidates(df, 2, 5, 20, 100).collect()] == [("r1", True, True)]


def best_by_hand(seq, base):
    """Every stretch, by its score; ends first, begins last."""
    found = [(sum(10 if c == base else -8 for c in seq[i:j]), -j, i) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)]
    score, j, i = max(found, default=(0, 0, 0))
    return (i, -j, seq[i:-j].count(base)) if score > 0 else None


def test_poly_a(spark):
    rnd = random.Random(2)
    seqs = ["".join(rnd.choices("AAACG", k=rnd.randrange(50))) for _ in range(80)] + [None, "", "CCC", "A"]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")
    got = [r["x"] for r in df.select("id", lo.best_run(F.col("seq"), "A").alias("x")).orderBy("id").collect()]
    assert [x and tuple(x) for x in got] == [best_by_hand(s, "A") if s else None for s in seqs]


def test_split_reads(spark):
    body = "CGTGCTGC" * 10
    run, near = "A" * 20, "A" * 9 + "C" + "A" * 10
    reads = [
        ("left", "GCTGCTGCTGCTGCT" + run + "CC" + body, "37S80M"),  # behind 15 bases, inside the clip
        ("begin", run + "CC" + body, "22S80M"),  # at the read's start
        ("aligned", body + run + body, "180M"),  # no clip
        ("near", "GCTGCTGCTGCTGCT" + near + body, "35S80M"),
        ("right", body + "CG" + "A" * 12 + "GCTGCTGCTGCTG", "80M27S"),
        ("end", body + "CG" + "A" * 12, "80M14S"),
        ("other", "GCTGCTGCTGCTGCT" + "T" * 20 + "CC" + body, "37S80M"),
    ]
    df = spark.createDataFrame([(*r, [30] * len(r[1])) for r in reads], "id string, seq string, cigar string, q array<int>")
    got = {r["read_id"]: r["seq"] for r in lo.split_internal_polya(df, "id").collect()}
    assert set(got) == {"left.L", "left.R", "begin", "aligned", "near.L", "near.R", "right.L", "right.R", "end", "other"}
    for name, seq, _ in reads:
        assert got.get(name) == seq or got[f"{name}.L"] + got[f"{name}.R"] == seq
    assert got["left.L"].endswith(run) and got["right.L"].endswith("A" * 12) and got["near.L"].endswith(near)
    assert "other.L" in {r["read_id"] for r in lo.split_internal_polya(df, "id", bases=("A", "T")).collect()}
    assert {r["read_id"] for r in lo.split_internal_polya(df, "id", least=31.0).collect()} == {r[0] for r in reads}


READS = "chrom string, cluster_key string, source string, st int, en int"


def sorted_reads(n=600):
    rnd = random.Random(3)
    rows = []
    for c in ("c2", "c1"):  # the order of the header, not of names
        starts = sorted(rnd.randrange(0, 2_000_000) for _ in range(n // 2))
        rows += [(c, f"k{st // 50_000}", rnd.choice(["s", "t", None]), st, st + rnd.randrange(1, 3000)) for st in starts]
    return rows


def by_key(rows):
    out = {}
    for c, k, s, st, en in rows:
        n, a, b = out.get((c, k, s), (0, st, en))
        out[c, k, s] = (n + 1, min(a, st), max(b, en))
    return out


def test_clusters_close(spark, tmp_path):
    """Clusters leave the state as the stream passes them, with the counts of the same reads in one batch."""
    rows = sorted_reads()
    end = [("end", "end", None, 0, 0)]
    parts = [rows[i : i + 50] for i in range(0, len(rows), 50)] + [end]
    seen = set()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, READS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("part-*")) - seen:  # file streams read by time of change
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
            seen.add(f)
    reads = sc.stream_reads(spark, str(tmp_path / "in"), READS, 1)
    query = sc.start_closing(sc.in_order(reads, ["c2", "c1", "end"]), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(300)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert {(c, k, s): (n, st, en) for c, k, s, n, st, en in got} == by_key(rows)
    assert len(got) == len(by_key(rows))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
    assert dropped == 0
    assert max(held) < len(by_key(rows)) and held[-1] < max(held)


def test_merged_streams_wait_for_the_slower(spark, tmp_path):
    rows = sorted_reads(200)
    for i, part in enumerate((rows[::2], rows[1::2])):
        spark.createDataFrame([*part, ("end", "end", None, 0, 0)], READS).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    both = sc.stream_merge_sources([sc.in_order(sc.stream_reads(spark, str(tmp_path / f"in{i}"), READS, 1), ["c2", "c1", "end"]) for i in range(2)])
    sc.start_closing(both, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(300)
    got = {(r["chrom"], r["cluster_key"], r["source"]): (r["n"], r["st"], r["en"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == by_key(rows)

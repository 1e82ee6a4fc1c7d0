"""Read structure of literal alignments."""

import random

import pytest
from pyspark.sql import functions as F

from readweave.operators import intervals as iv
from readweave.operators import structure as st

#: pos, CIGAR and expected breaks where gaps of up to 1000 (distance of the ends) are bridged.
CASES = [
    (5, "100M", "5,104"),
    (14, "10S50M27000N100M5D40M3I20M7H", "14,63,27064,27228"),
    (1, "50M1000N50M", "1,50,1051,1100"),
    (1, "50M999N50M", "1,1099"),
    (1, "50M600N10D600N50M", "1,50,1261,1310"),
]


@pytest.fixture(scope="module")
def breaks(spark):
    reads = spark.createDataFrame([(i, pos, cigar) for i, (pos, cigar, _) in enumerate(CASES)], "read_id long, pos int, cigar string")
    blocks = st.matched_blocks(st.cigar_ops(reads))
    exons = st.exons(blocks, 1000, carried=())
    got = st.read_breaks(exons, carried=()).select("read_id", st.joined(F.col("breaks")).alias("breaks"))
    return dict(map(tuple, got.collect()))


@pytest.mark.parametrize("i", range(len(CASES)))
def test_breaks(breaks, i):
    assert breaks[i] == CASES[i][2]


def test_supplementary_blocks_join_one_by_one(spark):
    """Of extra blocks only those on the read's strand, and only those free of all that was accepted before them."""
    names = "read_id long, fwd boolean, st int, en int, q1 int, q2 int"
    primary = spark.createDataFrame([(1, True, 100, 200, 1, 100)], names)
    extra = spark.createDataFrame([(1, True, 300, 400, 101, 200), (1, True, 390, 500, 201, 300), (1, False, 600, 700, 301, 400), (1, True, 800, 900, 90, 120), (2, True, 1, 5, 1, 5)], names)
    got = st.merge_supplementary(primary, extra).collect()
    assert [(r["read_id"], r["breaks"]) for r in got] == [(1, [100, 200, 300, 400])]


@pytest.mark.parametrize("strand", [False, True])
def test_annotations_of_any_size_meet_alike(spark, monkeypatch, strand):
    """As-of and containing joins against a plain search: broadcast or shuffled, dense or sparse genes, far positions, no genes."""
    rng = random.Random(7)
    starts = sorted(rng.sample(range(1, 900), 40)) + [10_000, 5_000_000]
    rows = [(i, f"g{i}", f"c{i % 3}", s, s + rng.randrange(0, 300), i % 2 == 0) for i, s in enumerate(starts)]
    names = "ord int, gene string, g_chrom string, g_st int, g_en int, g_fwd boolean"
    at = [(i, rng.choice(["c0", "c1", "c2", "other"]), rng.choice([True, False]), rng.choice([None, rng.randrange(0, 1300), 9_990, 4_000_000, 6_000_000])) for i in range(400)]
    points = spark.createDataFrame(at, "id int, chrom string, fwd boolean, pos int")
    for genes in (rows, []):
        annotation = spark.createDataFrame(genes, names)
        for small in (iv.SMALL, 0):
            monkeypatch.setattr(iv, "SMALL", small)
            up = iv.asof_upstream(points, "pos", annotation, "up", 5, strand=strand)
            got = {r["id"]: (r["up"], r["down"]) for r in iv.asof_downstream(up, "pos", annotation, "down", 5, strand=strand).collect()}
            near = {r["id"]: r["gene"] for r in iv.nearest_containing(points, ["id"], "pos", annotation, 10, "g_en", strand=strand).collect()}
            assert len(got) == len(at)
            for i, chrom, fwd, pos in at:
                own = [g for g in genes if g[2] == chrom and (not strand or g[5] == fwd)]
                before = [g for g in own if pos is not None and g[3] <= pos + 5]
                behind = [g for g in own if pos is not None and g[3] >= pos - 5]
                want = (max(before, key=lambda g: g[3])[1] if before else f"st.{chrom}", min(behind, key=lambda g: g[3])[1] if behind else f"end.{chrom}")
                assert got[i] == ((None, None) if pos is None else want)
                held = [g for g in own if pos is not None and g[3] - 10 <= pos <= g[4] + 10]
                assert near.get(i) == (min(held, key=lambda g: (abs(g[4] - pos), g[0]))[1] if held else None)

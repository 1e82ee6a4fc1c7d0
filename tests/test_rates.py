"""Intervals, exact tests and order statistics against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from readweave.operators import breakpoints as bp
from readweave.operators import clusters as cl
from readweave.operators import depth as dp
from readweave.operators import rates as rt


def test_chi_square_tail():
    # from tables of the distribution
    for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (9.487729, 4, 0.05), (11.0705, 5, 0.05), (15.08627, 5, 0.01), (23.20925, 10, 0.01), (0.0, 3, 1.0)):
        assert abs(rt.upper_tail(x, df) - p) < 1e-6


def test_fisher():
    assert abs(rt.fisher_p(3, 1, 1, 3) - 0.4857142857) < 1e-9
    assert abs(rt.fisher_p(1, 9, 11, 3) - 0.0027594562) < 1e-9
    rng = random.Random(1)
    for _ in range(200):
        a, b, c, d = (rng.randrange(0, 12) for _ in range(4))
        row, col, n = a + b, a + c, a + b + c + d
        p = {k: math.comb(row, k) * math.comb(n - row, col - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
        want = sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)) / math.comb(n, col)
        assert abs(rt.fisher_p(a, b, c, d) - want) < 1e-9


def table_p(rows):
    n, cols = sum(map(sum, rows)), [sum(c) for c in zip(*rows)]
    stat = 0.0
    for r in rows:
        for o, c in zip(r, cols):
            e = sum(r) * c / n
            stat += (abs(o - e) - (min(0.5, abs(o - e)) if len(cols) == 2 else 0)) ** 2 / e
    return stat


@pytest.mark.parametrize("samples", [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]])
def test_across_samples(spark, samples):
    rng = random.Random(len(samples))
    rows = [(s, p, rng.randrange(1, 300), rng.randrange(0, 40)) for p in range(60) for s in "abcde" if rng.random() < 0.9]
    rows += [(s, 99, 50, 0) for s in samples]
    df = spark.createDataFrame(rows, "source string, pos int, depth long, errors long")
    got = {r["pos"]: (r["statistic"], r["p_value"]) for r in rt.error_rate_test(df, samples, 20).collect()}
    at = {(s, p): (d, e) for s, p, d, e in rows}
    want = {p for p in range(100) if all((s, p) in at and at[s, p][0] > 20 for s in samples)}
    assert set(got) == want and got[99] == (None, None)
    for p in want - {99}:
        ds, es = [at[s, p][0] for s in samples], [at[s, p][1] for s in samples]
        if sum(es):
            assert abs(got[p][0] - table_p([ds, es])) < 1e-6
            assert abs(got[p][1] - rt.upper_tail(got[p][0], len(samples) - 1)) < 1e-12


def test_intervals(spark):
    rows = [(0, 10), (10, 10), (3, 10), (5, 10), (1, 1000), (999, 1000), (0, 0), (None, 5)]
    df = spark.createDataFrame(rows, "x int, n int")
    for method in ("wilson", "corrected", "logit"):
        p, lo, hi = rt.interval(F.col("x"), F.col("n"), method)
        for r in df.select("x", "n", p.alias("p"), lo.alias("lo"), hi.alias("hi")).collect():
            if not r["n"] or r["x"] is None:
                assert r["lo"] is None and r["hi"] is None
                continue
            assert 0 <= r["lo"] <= r["p"] <= r["hi"] <= 1
    got = {}
    for method in ("wilson", "corrected", "logit"):
        _, lo, hi = rt.interval(F.lit(3), F.lit(10), method)
        got[method] = tuple(round(v, 4) for v in spark.range(1).select(lo, hi).first())
    # published values: the score interval, the same corrected, and the logit interval of 3 of 10
    assert got == {"wilson": (0.1078, 0.6032), "corrected": (0.0809, 0.6463), "logit": (0.0998, 0.6237)}


def test_trimmed_clusters(spark, monkeypatch):
    monkeypatch.setattr(cl, "STEP", 16)
    rng = random.Random(4)
    rows = []
    for i in range(400):
        st = rng.choice([rng.randrange(0, 200), 100])
        breaks = [st, *sorted(rng.randrange(st, 900) for _ in range(rng.choice([0, 2, 4]))), rng.choice([950, rng.randrange(900, 1000)])]
        rows.append((rng.choice("kkkkkl"), i, breaks))
    rows += [("one", 900, [1, 2]), ("two", 901, [5, 90]), ("two", 902, [5, 90])]
    df = spark.createDataFrame(rows, "key string, read_id int, breaks array<int>")
    got = {tuple(r) for r in cl.trim_cluster(df, ["key"], 1).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        n = len(own)
        to_st, to_en = sorted(b[0] for *_, b in own)[n // 2], sorted(b[-1] for *_, b in own)[min(n - n // 2, n - 1)]
        ls, rs = ([b[k] if len(b) > 2 else 0 for *_, b in own] for k in (1, -2))
        mean = [sum(x) / n for x in (ls, rs)]
        sd = [math.sqrt(sum((v - m) ** 2 for v in x) / n) for x, m in zip((ls, rs), mean)]
        kept = [(key, i, max(b[0], to_st), min(b[-1], to_en), max(0, to_st - b[0]), max(0, b[-1] - to_en)) for (_, i, b), l, r in zip(own, ls, rs) if b[0] < to_st + 10 and b[-1] > to_en - 10 and abs(l - mean[0]) <= max(2 * sd[0], 20) and abs(r - mean[1]) <= max(2 * sd[1], 20)]
        kept = [k for k in kept if k[2] <= k[3]]
        want |= set(kept) if len(kept) > 1 else set()
    assert got == want and len(want) > 50


def test_depth_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(dp, "TILE", 32)
    rng = random.Random(5)
    blocks = [(rng.choice("ab"), (s := rng.randrange(-50, 300)), s + rng.randrange(-1, 120)) for _ in range(60)]
    wrong = [(rng.choice("ab"), rng.randrange(-60, 400)) for _ in range(200)]
    depth, errors = Counter(), Counter(wrong)
    for k, a, b in blocks:
        depth.update((k, p) for p in range(a, b + 1))
    b, w = spark.createDataFrame(blocks, "k string, st int, en int"), spark.createDataFrame(wrong, "k string, pos int")
    found = dp.depth_by_position(b, ["k"], mismatches=w)
    assert {(r["k"], r["pos"]): (r["depth"], r["errors"]) for r in found.collect()} == {x: (n, errors[x]) for x, n in depth.items()}
    running = defaultdict(int)
    want = {}
    for k, p in sorted(depth):
        running[k] += depth[k, p]
        want[k, p] = running[k]
    assert {(r["k"], r["pos"]): r["running"] for r in dp.cumulative_share(found, ["k"]).collect()} == want
    sparse = found.filter("pos % 37 > 3")
    places = {k: sorted(p for q, p in depth if q == k and math.fmod(p, 37) > 3) for k in "ab"}
    zero = {(k, p) for k, own in places.items() for i, p in enumerate(own) if (i and p - own[i - 1] > 1) or (i + 1 < len(own) and own[i + 1] - p > 1)}
    assert {(r["k"], r["pos"]) for r in dp.zero_gaps(sparse, ["k"], 1).filter("depth = 0").collect()} == zero


def test_every_left_with_every_right(spark):
    cells = spark.createDataFrame([("s", "c", 0, 1, 2, 1), ("s", "c", 0, 3, 4, 1), ("s", "d", 0, 5, 6, 1)], "source string, chrom string, level int, left int, right int, n long")
    assert {tuple(r) for r in bp.breakpoint_cross(cells, observed=False).collect()} == {("c", 0, 1, 2), ("c", 0, 1, 4), ("c", 0, 3, 2), ("c", 0, 3, 4), ("d", 0, 5, 6)}


def test_breaks_between_chromosomes(spark):
    rows = [("r", "s", "a", True, 10, 20, 1, 11), ("r", "s", "b", False, 30, 45, 12, 27), ("r", "s", "b", True, 60, 70, 28, 38), ("q", "s", "a", True, 10, 20, 1, 11), ("q", "s", "b", False, 30, 45, 12, 27)]
    df = spark.createDataFrame(rows, "read_id string, source string, chrom string, fwd boolean, st int, en int, q1 int, q2 int")
    assert [tuple(r) for r in bp.fusion_breakpoints(df).collect()] == [("s", "a", "b", 20, 45, 2)]

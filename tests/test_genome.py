"""Tiles, ends and alignments against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from readweave.operators import rescue as rs
from readweave.operators import segments as sg
from readweave.operators.genome import padded, tiles, tiles_of_bases, with_bases


def genome(seed=1, n=700):
    rng = random.Random(seed)
    return {c: "".join(rng.choice("ACGT") for _ in range(n + k)) for k, c in enumerate(("c0", "c1"))}


def tiled(spark, seqs, size):
    return tiles(spark.createDataFrame(list(seqs.items()), "name string, seq string"), size)


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_ranges_over_tiles(spark, size):
    seqs, rng = genome(), random.Random(2)
    rows = [(c, rng.randrange(-5, 720), rng.randrange(0, 90)) for c in ("c0", "c1", "none") for _ in range(30)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, chrom string, st int, n int")
    got = with_bases(df, tiled(spark, seqs, size), ["id"], {"x": (F.col("st"), F.col("st") + F.col("n") - 1), "y": (F.lit(3), F.lit(4))}, size)
    got = got.withColumn("p", padded(F.col("x"), F.col("st"), 90)).collect()
    assert len(got) == len(rows)
    for r in got:
        _, st, n = rows[r["id"]]
        own = seqs.get(r["chrom"], "")
        assert r["x"] == own[max(0, st - 1) : max(0, st - 1 + n)], r
        assert r["y"] == own[2:4]
        if n == 90 and own:
            assert r["p"] == "".join(own[p - 1] if 1 <= p <= len(own) else "-" for p in range(st, st + 90))
    bases = spark.createDataFrame([(c, i + 1, b) for c, s in seqs.items() for i, b in enumerate(s)], "chrom string, pos int, base string")
    assert sorted(tiles_of_bases(bases, size).collect()) == sorted(tiled(spark, seqs, size).collect())


def test_places_over_borders(spark):
    seqs = genome(3)
    for size in (5, 64):
        got = {(r["chrom"], r["pos"]) for r in sg.codon_places(tiled(spark, seqs, size), ("ATG", "TAA")).collect()}
        assert got == {(c, i + 1) for c, s in seqs.items() for i in range(len(s) - 2) if s[i : i + 3] in ("ATG", "TAA")}


def cost(a, b):
    row = [2 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [2 * i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 2, new[-1] + 2, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_break_similarity(spark):
    seqs, rng = genome(4), random.Random(5)
    pairs = sorted({(c, rng.randrange(1, 700), rng.randrange(1, 700)) for c in seqs for _ in range(25)} | {("c0", 2, 698), ("c1", 701, 1)})
    got = sg.break_similarity(spark.createDataFrame(pairs, "chrom string, left int, right int"), tiled(spark, seqs, 4096)).collect()
    at = {"up": (-9, 0), "on": (1, 10), "mid": (-4, 5)}
    names = {"55": ("up", "up"), "33": ("on", "on"), "53": ("up", "on"), "35": ("on", "up"), "mid": ("mid", "mid")}

    def bases(c, p, k):
        return "".join(seqs[c][q - 1] if 1 <= q <= len(seqs[c]) else "-" for q in range(p + at[k][0], p + at[k][1] + 1))

    want = {(c, a, b, w): cost(bases(c, a, x), bases(c, b, y)) for c, a, b in pairs for w, (x, y) in names.items()}
    assert {(r["chrom"], r["left"], r["right"], r["window"]): r["cost"] for r in got} == want
    assert all(abs(r["similarity"] - 100 / math.exp(r["cost"])) < 1e-9 for r in got)


def by_hand(a, b, s=rs.Scores()):
    """Gotoh's tables cell by cell, with the ties of local_alignments."""
    n, m, no = len(a), len(b), -(10**9)
    h, down, right = ([[0 if t == 0 else no] * (m + 1) for _ in range(n + 1)] for t in range(3))
    best = (0, 0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            down[i][j] = max(h[i - 1][j] - s.first, down[i - 1][j] - s.further)
            right[i][j] = max(h[i][j - 1] - s.first, right[i][j - 1] - s.further)
            h[i][j] = max(0, h[i - 1][j - 1] + (s.match if a[i - 1] == b[j - 1] else s.mismatch), down[i][j], right[i][j])
            if h[i][j] > best[0]:
                best = (h[i][j], i, j)
    score, i, j = best
    end_i, end_j, columns, same, state = i, j, 0, 0, "h"
    while score:
        if state == "h":
            if h[i][j] <= 0:
                break
            if h[i][j] == h[i - 1][j - 1] + (s.match if a[i - 1] == b[j - 1] else s.mismatch):
                i, j, columns, same = i - 1, j - 1, columns + 1, same + (a[i - 1] == b[j - 1])
                continue
            state = "down" if h[i][j] == down[i][j] else "right"
        if state == "down":
            state, i = ("down" if down[i - 1][j] - s.further > h[i - 1][j] - s.first else "h"), i - 1
        else:
            state, j = ("right" if right[i][j - 1] - s.further > h[i][j - 1] - s.first else "h"), j - 1
        columns += 1
    return [score, i, j, end_i - i, end_j - j, columns, same]


def test_local_alignments():
    rng = random.Random(6)
    a, b = [], []
    for _ in range(150):
        b.append("".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 60))))
        near = "".join(x if rng.random() < 0.85 else rng.choice(["", "A", "CG"]) for x in b[-1][rng.randrange(len(b[-1])) :]) + "T"
        a.append(near if rng.random() < 0.7 else "".join(rng.choice("AC") for _ in range(rng.randrange(1, 50))))
    assert rs.local_alignments(a, b).tolist() == [by_hand(x, y) for x, y in zip(a, b)]
    assert rs.local_alignments(["AAAA"], ["CCCC"]).tolist() == [[0] * 7]


def test_rescued_ends(spark, monkeypatch):
    monkeypatch.setattr(rs, "CELLS", 20_000)  # batches of a few pairs
    rng = random.Random(7)
    seqs = {c: s + "A" * 15 for c, s in genome(8, 1500).items()}
    reads = []
    for i in range(40):
        c = rng.choice(sorted(seqs))
        body = seqs[c][600:700]
        l, r = rng.choice([0, 15, 30, 60]), rng.choice([0, 15, 30, 60])
        at5, at3 = rng.randrange(0, 440), len(seqs[c]) - 500 + rng.randrange(0, 440)
        five, three = seqs[c][at5 : at5 + l], seqs[c][at3 : at3 + r]
        noise = 0.04 if i % 2 else 0.5
        five, three = ("".join(x if rng.random() > noise else rng.choice("ACGT") for x in t) for t in (five, three))
        st = rng.choice([50, 601])
        reads.append((f"r{i}", c, (f"{l}S" if l else "") + "100M" + (f"{r}S" if r else ""), five + body + three, st, st + 99, [st, st + 99]))
    reads.append(("x", "elsewhere", "30S10M", "A" * 40, 500, 509, [500, 509]))
    reads.append(("null", "c0", None, None, None, None, None))
    df = spark.createDataFrame(reads, "read_id string, chrom string, cigar string, seq string, st int, en int, breaks array<int>")
    ends = rs.chromosome_ends(tiled(spark, seqs, 64), 500)
    got = {r["read_id"]: r for r in rs.rescue_ends(df, ends).collect()}
    assert {(r["chrom"], r["size"], r["body"], r["five"], r["three"]) for r in ends.collect()} == {(c, len(s), len(s.rstrip("A")), s[:500], s[-500:]) for c, s in seqs.items()}
    rescued = 0
    for name, c, cigar, seq, st, en, breaks in reads:
        r = got[name]
        if c not in seqs or seq is None:
            assert (r["st"], r["en"], r["breaks"], r["five"], r["three"]) == (st, en, breaks, False, False)
            continue
        l, n = int(cigar.split("S")[0]) if cigar[:3].rstrip("S").isdigit() and "S" in cigar.split("M")[0] else 0, len(seqs[c])
        tail = cigar.split("M")[1]
        k = int(tail[:-1]) if tail else 0
        want, five, three = list(breaks), False, False
        if 20 < l < 1000 and st > 100:
            _, _, b, _, used, columns, same = by_hand(seq[:l], seqs[c][:500])
            if same > 0.85 * max(l, columns) and b + 1 + used < st:
                want, five = [b + 1, b + 1 + used, *want], True
        if 20 < k < 1000 and en < len(seqs[c].rstrip("A")) - 100:
            _, _, b, _, used, columns, same = by_hand(seq[-k:], seqs[c][-500:])
            if same > 0.85 * max(k, columns) and n - 500 + b + 1 + used > en:
                want, three = [*want, n - 500 + b + 1, n - 500 + b + 1 + used], True
        assert (r["breaks"], r["five"], r["three"], r["st"], r["en"]) == (want, five, three, want[0], want[-1]), name
        rescued += five + three
    assert rescued >= 10

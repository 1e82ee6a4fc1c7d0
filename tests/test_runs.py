"""Runs of a base in clips against plain Python, letter by letter."""

import random

from pyspark.sql import functions as F

from readweave.operators import leftovers as lo


def by_hand(seq, base):
    total = first = best = 0
    found = None
    for i, c in enumerate(seq, 1):
        total += lo.OWN if c == base else -lo.OTHER
        if total > best:
            best, found = total, (first, i, seq[first:i].count(base))
        if total <= 0:
            total, first = 0, i
    return found


def test_best_runs(spark, monkeypatch):
    monkeypatch.setattr(lo, "TEXT", 50)  # looked through in parts, some of one sequence
    rng = random.Random(13)
    seqs = ["".join(rng.choices(rng.choice(["ACGT", "AAAC", "CG", "AéC", "AAAA漢𝒳T"]), k=rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(400)] + [None, "", "C" * 9, "A" * 300, "AC" * 70, "CAAC" * 9]
    rng.shuffle(seqs)
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string")
    for base in "AT":
        got = {r["id"]: r["r"] for r in df.select("id", lo.best_run(F.col("s"), base).alias("r")).collect()}
        assert [r and (r["first"], r["last"], r["n"]) for _, r in sorted(got.items())] == [by_hand(s or "", base) for s in seqs]
    assert spark.createDataFrame([], "s string").select(lo.best_run(F.col("s"), "A")).collect() == []


def test_a_clip_is_looked_through_once(spark):
    """Not once for each use of its run, and not base by base in an expression."""
    reads = spark.createDataFrame([(1, "C" * 20 + "A" * 20 + "C" * 60, "50S20M30S")], "id int, seq string, cigar string")
    found = lo.split_internal_polya(reads, "id")
    assert sorted(map(tuple, found.collect())) == [("1.L", "C" * 20 + "A" * 20), ("1.R", "C" * 60)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("runs(") == 2

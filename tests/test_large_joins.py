"""Joins whose work must grow with their input only."""

import random

from pyspark.sql import functions as F

from readweave.operators import segments as sg
from readweave.operators.genome import tiles, with_bases


def genome(spark, n=30_000):
    rng = random.Random(1)
    return tiles(spark.createDataFrame([("c0", "".join(rng.choice("ACGT") for _ in range(n)))], "name string, seq string"))


def test_a_point_is_compared_with_few_stretches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sg, "side", lambda df: seen.append(df) or df)
    places = sg.codon_places(genome(spark), sg.STOPS)
    points = spark.createDataFrame([("c0", p) for p in range(1, 29_000, 97)], "chrom string, p int")
    got = sg.next_place(points, F.col("p"), places, "stop", True).collect()
    known = sorted(r["pos"] for r in places.collect())
    assert all(r["stop"] == next(k for k in known if k >= r["p"] and (k - r["p"]) % 3 == 0) for r in got)
    assert seen[0].groupBy("chrom", "_frame", "_bucket").count().agg(F.max("count")).first()[0] < 90


def test_rows_are_read_once(spark):
    rows = spark.createDataFrame([("c0", 1, 5000, "x"), ("c0", 4090, 4100, "y")], "chrom string, st int, en int, name string")
    found = with_bases(rows, genome(spark), ["st"], {"bases": (F.col("st"), F.col("en"))})
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    assert sorted((r["name"], len(r["bases"])) for r in found.collect()) == [("x", 5000), ("y", 11)]

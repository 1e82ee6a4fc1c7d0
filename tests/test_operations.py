"""CIGAR operations are taken apart where they are read."""

import random
import re

from readweave.operators import structure as st


def test_operations_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(st, "TEXT", 50)
    rng = random.Random(1)
    rows = [(f"r{i}", i, "".join(f"{rng.randrange(1, 10 ** rng.randrange(1, 7))}{rng.choice('MIDNSHPX=')}" for _ in range(rng.randrange(20)))) for i in range(200)]
    rows += [("null", 1, None), ("star", 1, "*"), ("odd", 1, "M10Z5M7"), ("no place", None, "5M3D")]
    found = st.cigar_ops(spark.createDataFrame(rows, "read_id string, pos int, cigar string"))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for name, pos, cigar in rows:
        ref, read = pos, 1
        for i, (n, op) in enumerate(re.findall("([0-9]+)([MIDNSHPX=])", cigar or "")):
            want.append((name, i, op, int(n), ref, read))
            ref = None if ref is None else ref + int(n) * (op in st.ON_REFERENCE)
            read += int(n) * (op in st.ON_READ)
    key = lambda r: r[:2]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)

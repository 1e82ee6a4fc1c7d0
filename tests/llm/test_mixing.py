"""The mix's parts: permutations, draws, and documents that keep their own characters."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from readweave.llm import components, mixing


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_is_one_and_spreads(spark, n):
    key = F.lit(5), F.lit(1)
    got = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), *key).alias("p"), mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit(2)).alias("q")).orderBy("id").collect()
    p = [r["p"] for r in got]
    assert sorted(p) == list(range(n))
    if n >= 1000:
        steps = Counter((b - a) % n for a, b in zip(p, p[1:]))
        assert max(steps.values()) < 10  # no arithmetic progressions
        # neighbours end anywhere: their mean distance is that of random places, n / 3
        assert abs(sum(abs(b - a) for a, b in zip(p, p[1:])) / n - n / 3) < n / 20
        assert sum(r["p"] == r["q"] for r in got) < 10


def test_draw_fills_shards_and_quotas(spark):
    quotas = {0: 3000, 1: 40, 2: 961}
    df = spark.createDataFrame(list(quotas.items()), "source_index long, quota long")
    got = mixing.draw(df, sum(quotas.values()), 100, 9).collect()
    by_shard, by_source = Counter(), Counter()
    for r in got:
        by_shard[r["shard"]] += r["n"]
        by_source[r["source_index"]] += r["n"]
    assert by_source == quotas
    assert by_shard == {s: 100 if s < 40 else 1 for s in range(41)}
    large = [r["n"] for r in got if r["source_index"] == 0 and r["shard"] < 40]
    # the spread of a multinomial draw: 100 of shares 0.75 has a variance of 18.75
    mean = sum(large) / 40
    assert 8 < sum((x - mean) ** 2 for x in large) / 40 < 40


def test_texts_keep_their_characters(spark):
    code = "\n def f(x):\n\treturn  x\r\nprint(1) "
    docs = spark.createDataFrame([(1, code, "a", 9, 3), (2, "one", "a", 8, 3), (2, "one", "b", 7, 3), (2, "one", "b", 7, 3), (None, "x y", None, 1, 1)], "doc_id long, text string, source string, _copy int, _words int")
    got = mixing.mixed_documents(docs, share=2.0).collect()
    assert Counter((r["text"], r["source"], r["_copy"]) for r in got) == {(code, "a", 9): 2, ("one", "a", 8): 2, ("one", "b", 7): 4, ("x y", None, 1): 2}


def test_copies_are_told_apart_alike_in_every_run(spark):
    """Copies whose other columns differ: the same rows whatever order they come in, by the mix and by the keeper of one."""
    rows = [(1, "one two three", "a", i, None if i % 2 else i) for i in range(7)] + [(2, "x " * 200, "b", 1, 1)]
    mixed, one = set(), set()
    for parts in (1, 3, 8):
        docs = spark.createDataFrame(rows[::-1] if parts == 3 else rows, "doc_id long, text string, source string, tag int, row int").repartition(parts)
        mixed.add(tuple(sorted(map(str, mixing.mixed_documents(docs, share=0.6, block_words=2).collect()))))
        found = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key")).alias("least"))
        one.add(tuple(sorted(map(str, components.kept(docs, found).collect()))))
    assert len(mixed) == 1 and len(one) == 1 and len(next(iter(one))) == 2


def test_runs_of_neighbouring_blocks(spark):
    words = [f"w{i}" for i in range(1000)]
    docs = spark.createDataFrame([(1, " ".join(words), "a"), (2, "x " * 3000, "b")], "doc_id string, text string, source string")
    got = [r["text"].split() for r in mixing.mixed_documents(docs, weights=(1, 5), share=0.6, block_words=8).collect() if r["doc_id"] == "1"]
    assert 1 < len(got) < 125 / 2 and all(ws == words[int(ws[0][1:]) :][: len(ws)] for ws in got)
    assert max(Counter(w for ws in got for w in ws).values()) == 1


def test_a_document_in_two_sources(spark):
    """The passes of a source stay with its own rows."""
    docs = spark.createDataFrame([(1, " ".join(["w"] * 400), "a"), (1, " ".join(["w"] * 400), "b")], "doc_id long, text string, source string")
    rows, spans, drawn = mixing.plan(docs)
    want = Counter()
    for r in mixing.taken(rows, spans, drawn).collect():
        want[r["source"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += len(r["text"].split())
    assert got == want

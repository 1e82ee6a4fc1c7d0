"""The pipeline's stages over edge cases."""

from collections import Counter

import corpus_pipeline
import pytest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    """Rows that every stage was given, and those that it returned."""
    top, docs, out = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{top}/{name}")
        made = spark.read.parquet(f"{top}/{name}")
        out[name] = docs, made
        docs = made
    return out


def test_columns_stay(steps):
    for name, (given, made) in steps.items():
        if name != "sharding":
            assert made.columns == given.columns


def test_filters_return_rows_that_they_were_given(steps):
    for name in ("toxicity", "simhash", "decontamination"):
        given, made = (Counter((r["doc_id"], r["text"]) for r in df.collect()) for df in steps[name])
        assert made and not made - given


def test_simhash_keeps_one_of_a_group(steps):
    given, made = ([r["doc_id"] for r in df.collect() if r["doc_id"] is not None] for df in steps["simhash"])
    assert len(made) == len(set(made))
    if {1009, 1010} <= set(given):
        assert 1010 not in made


def test_leaks_go_and_the_rest_stays(steps):
    given, made = ({r["doc_id"] for r in df.collect()} for df in steps["decontamination"])
    assert given - made <= {1013, 1014} and not made & {1013, 1014}


def test_all_mixed_rows_have_a_shard(steps):
    given, made = steps["sharding"]
    got = made.collect()
    assert len(got) == given.count()
    assert all(0 <= r["shard"] < 8 for r in got)
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)


def test_stages_of_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_whole_pipeline_agrees_with_its_stages(spark, small, steps):
    ours = Counter(map(str, corpus_pipeline.run(spark, small).select("doc_id", "text").collect()))
    assert ours == Counter(map(str, steps["sharding"][1].select("doc_id", "text").collect()))

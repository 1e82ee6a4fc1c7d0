"""Reads with breaks and keys from one pass."""

from readweave.operators import intervals as iv
from readweave.operators import structure as st
from readweave.plans.clusters import keyed
from readweave.plans.inputs import GAP, blocks, genes

SF = "/root/testdata/sf0.001"


def test_blocks_are_read_once(spark):
    got = keyed(spark, SF)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 1
    exons = st.exons(blocks(spark, SF), GAP)
    want = st.read_breaks(exons).join(iv.cluster_key_viral(exons, genes(spark, SF)), "read_id")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))

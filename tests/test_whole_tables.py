"""Queries that must see every row of their table."""

import os

from readweave import plans
from readweave.registry import QUERIES

plans.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_read_has_offsets(spark):
    got = QUERIES["running_offsets"](spark, SF)
    assert got.count() == got.select("read_id").distinct().count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()

"""Sharding by longest processing time: groups of equal texts, largest first, go to the least loaded shard.

A group is all rows with the same text. Groups that weigh more than 1/``grain`` of all bytes are scheduled one by one
(there can be at most ``grain`` of them); the rest are dealt by their hash to ``grain`` bundles, which are scheduled as
wholes. So the heap on the driver never holds more than 2 x ``grain`` items, however many documents there are, and
shards end within about one bundle of each other unless a single group is larger than a shard's share.

Slots number the rows of a shard from 0 without gaps: rows are dealt to buckets inside the shard by their ids, buckets
are numbered by running counts, rows inside their bucket.

Defined results: a null text weighs 1 and null texts are one group; identical rows are in one shard with slots of
their own; an empty table gives an empty table; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import cut

SHARDS = 8
GRAIN = 8192
#: Rows of a slot bucket, on average.
BUCKET_ROWS = 20_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def schedule(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each (item, load): largest loads first, each to the least loaded shard (lowest number on ties)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for item, load in sorted(items, key=lambda x: (-x[1], x[0])):
        least, s = heapq.heappop(heap)
        placed[item] = s
        heapq.heappush(heap, (least + load, s))
    return placed


def plan(sized: DataFrame, shards: int, grain: int) -> tuple[DataFrame, DataFrame]:
    """Tables of heavy groups (group, shard) and bundles (bundle, shard), from columns group (binary) and size."""
    spark = sized.sparkSession
    by_group = cut(sized.groupBy("group").agg(F.sum("size").alias("load")))
    total = by_group.agg(F.sum("load")).first()[0] or 0
    heavy = F.col("load") > total / grain
    # at most `grain` rows each, by the definition of heavy and of bundle
    alone = [(bytes(r["group"]), r["load"]) for r in by_group.filter(heavy).collect()]
    bundled = by_group.filter(~heavy).groupBy(bundle_of(F.col("group"), grain).alias("bundle")).agg(F.sum("load").alias("load"))
    bundles = [(r["bundle"], r["load"]) for r in bundled.collect()]
    alone.sort(key=lambda x: x[0])
    items = [(-1 - i, load) for i, (_, load) in enumerate(alone)] + bundles
    placed = schedule(items, shards)
    heavies = spark.createDataFrame([(bytearray(g), placed[-1 - i]) for i, (g, _) in enumerate(alone)], "group binary, own_shard int")
    return heavies, spark.createDataFrame([(b, placed[b]) for b, _ in bundles], "bundle int, bundle_shard int")


def bundle_of(group: Column, grain: int) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(grain)).cast("int")


def shard(docs: DataFrame, *, shards: int = SHARDS, grain: int = GRAIN, carry: list[Column] | None = None) -> DataFrame:
    """All rows of ``docs``, their columns in a struct `row`, with size, shard and slot.

    carry: what `row` holds instead, if not all columns; texts that aren't carried aren't shuffled.
    """
    text = docs["text"]
    rows = docs.select(
        F.struct(*(carry or [docs[f"`{c}`"] for c in docs.columns])).alias("row"),
        size_of(text).alias("size"),
        F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("")), 256)).alias("group"),
        F.xxhash64(docs["doc_id"], text).alias("row_key"),
    )
    heavies, bundles = plan(rows.select("group", "size"), shards, grain)
    # both tables have at most `grain` rows
    rows = rows.withColumn("bundle", bundle_of(F.col("group"), grain)).join(F.broadcast(bundles), "bundle", "left").join(F.broadcast(heavies), "group", "left")
    rows = rows.withColumn("shard", F.coalesce("own_shard", "bundle_shard"))
    return with_slots(rows).select("row", "size", "shard", "slot")


def with_slots(rows: DataFrame) -> DataFrame:
    """Column slot: 0, 1, ... inside each shard, from columns row, shard and row_key."""
    n = rows.select(F.count("*")).first()[0]
    buckets = max(1, n // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row_key"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # a row for each bucket of a shard
    before = counts.withColumn("first", F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("shard", "bucket", F.coalesce("first", F.lit(0)).alias("first"))
    own = W.partitionBy("shard", "bucket").orderBy("row_key")
    placed = rows.withColumn("own", F.row_number().over(own) - 1).join(before, ["shard", "bucket"])
    return placed.withColumn("slot", F.col("first") + F.col("own"))

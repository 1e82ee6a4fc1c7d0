"""Clusters of reads that arrive as streams.

`start_clusters` needs no order of reads: late reads of a cluster update its counts, so the state holds a row for each cluster
and source. `start_closing` reads sorted input and closes clusters that no read can reach any more, so its state holds the
open ones only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.clusters import stream_clusters


def stream_reads(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_merge_sources(streams: list[DataFrame]) -> DataFrame:
    """All rows of all streams as one."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def start_clusters(reads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the clusters that each batch changed, with their counts so far, as Parquet folders by batch.

    A batch that is repeated after a failure replaces its own folder.
    """

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream_clusters(reads).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(put).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every cluster; counts never fall."""
    return spark.read.parquet(path).groupBy("chrom", "cluster_key", "source").agg(F.max("n").alias("n"))


#: Milliseconds of pseudo-time that each chromosome takes; a base is a millisecond.
SPAN = 1 << 32
CLOSED = "chrom string, cluster_key string, source string, n long, st int, en int"


class Closing(StatefulProcessor):
    """A cluster's counts by source, start and end; a timer ``behind`` bases after its end hands them on and drops them.

    New reads move the timer. A cluster that comes again after it closed starts anew: rows of the same key add up.
    """

    def __init__(self, behind: int):
        self.behind = behind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "source string", "n bigint, st int, en int")
        self.until = handle.getValueState("until", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = -1
        for part in rows:
            for source, own in part.groupby("source", dropna=False):
                name = ("" if pd.isna(source) else "=" + source,)
                n, st, en = len(own), int(own["st"].min()), int(own["en"].max())
                if self.counts.containsKey(name):
                    was = self.counts.getValue(name)
                    n, st, en = n + was[0], min(st, was[1]), max(en, was[2])
                self.counts.updateValue(name, (n, st, en))
            last = max(last, int((part["base"] + part["en"]).max()))
        at = last + self.behind
        if self.until.exists():
            before = self.until.get()[0]
            at = max(at, before)
            if at != before:
                self.handle.deleteTimer(before)
        self.until.update((at,))
        self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(*key, source[0][1:] if source[0] else None, *found) for source, found in self.counts.iterator()]
        self.counts.clear()
        self.until.clear()
        yield pd.DataFrame(rows, columns=["chrom", "cluster_key", "source", "n", "st", "en"])

    def close(self) -> None:
        pass


def in_order(reads: DataFrame, chroms: list[str], disorder: int = 1000) -> DataFrame:
    """A stream of reads (chrom, cluster_key, source, st, en) with its place along the genome as event time.

    chroms: the order of chromosomes in the sorted input, from its header; reads of others are left out. Within ``disorder``
    bases starts need no order. Streams that are merged get their places before: the one that lags behind sets the pace.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in chroms]), F.col("chrom")) - 1
    placed = reads.filter(F.col("chrom").isin(*chroms)).withColumn("base", (rank * SPAN).cast("long"))
    return placed.withColumn("place", F.timestamp_millis(F.col("base") + F.col("st"))).withWatermark("place", f"{disorder} milliseconds")


def closing_clusters(placed: DataFrame, behind: int = 100_000) -> DataFrame:
    """Clusters (chrom, cluster_key, source, n, st, en) as they close: when every input has come ``behind`` bases past their end.

    placed: see `in_order`. State holds the clusters that are still open, however long the stream; it needs the RocksDB
    provider (see `start_closing`). Reads more than ``disorder`` behind are late; Spark drops and counts them.
    """
    own = placed.select("chrom", "cluster_key", "source", F.col("st").cast("int").alias("st"), F.col("en").cast("int").alias("en"), "base", "place")
    return own.groupBy("chrom", "cluster_key").transformWithStateInPandas(Closing(behind), CLOSED, "Append", "EventTime")


def start_closing(placed: DataFrame, path: str, checkpoint: str, behind: int = 100_000) -> StreamingQuery:
    """Write clusters as they close, as Parquet."""
    placed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writer = closing_clusters(placed, behind).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path)
    return writer.trigger(availableNow=True).start()

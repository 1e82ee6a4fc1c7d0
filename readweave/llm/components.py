"""Distributed connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .text import row_hash


def connected(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, root) for every node of ``links``; root is the smallest id reachable.

    Rounds of two steps on (u, v) with u > v, until nothing changes: every neighbour of u above u is hung on u's
    smallest neighbour, then every node's lower neighbours are hung on the smallest of them. Minima are aggregated
    map-side, so a hub with very many links costs a row for each task; joins on hubs are split by adaptive execution.
    Each round is a table in the shared folder, so lineage stays short and a lost executor repeats one round at most.
    """
    down = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    down = cut(down)
    before = None
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        # upper neighbours of each u hang on the least of u and its neighbours
        large = both.join(lowest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = cut(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # the lower neighbours of each u, and u, hang on the least of them
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        down = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
        state = down.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
    roots = down.groupBy("u").agg(F.min("v").alias("root"))
    # a root is no one's upper node
    tops = roots.select(F.col("root").alias("id"), "root").distinct()
    return roots.select(F.col("u").alias("id"), "root").unionByName(tops)


def named(rows: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``rows`` (doc_id, text_key, key) with ``least``, the first of the component's rows as (none, id, text_key): by
    doc_id, null last, then by the text's hash. ``roots``: key and root for every key.

    Rows are summed by key before they meet their root, and roots by key after, so neither many copies of a text nor a
    component of very many texts is one task's.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("text_key"))).alias("least")
    by_key = cut(rows.groupBy(key).agg(first).join(roots, key))
    by_root = by_key.groupBy("root").agg(F.min("least").alias("least"))
    # only roots of two keys and more change anything: a small table, that a key without one needn't meet
    several = by_key.filter(F.col("root") != F.col(key)).select("root").distinct()
    tops = by_root.join(several, "root", "left_semi").select("root", F.col("least").alias("_least"))
    of_key = by_key.join(tops, "root", "left").select(key, F.coalesce("_least", "least").alias("least"))
    return rows.join(of_key, key)


def kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, once each; columns as they came.

    Of rows with one id and text whose other columns differ, the one with the smallest hash of those columns stays.
    """
    first = found.select(F.col("least.id").alias("id"), F.col("least.text_key").alias("text_key")).distinct()
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("text_key"), row_hash(docs).alias("row_hash"))
    stays = own.alias("o").join(first.alias("f"), F.col("o.id").eqNullSafe(F.col("f.id")) & (F.col("o.text_key") == F.col("f.text_key")), "left_semi")
    once = stays.groupBy("id", "text_key").agg(F.min_by("row", "row_hash").alias("row"))
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])

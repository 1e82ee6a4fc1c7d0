"""Hard negatives: rows of another label that score close below a positive of an anchor.

Scores are integer inner products. An anchor's positives are its best rows of the same label; for each positive, negatives
are the best rows of other labels within a window of scores set by the positive's. Both searches go through the tree of
`gnat.py`: the first with an open window, the second with a window for each positive, which is an annulus about the anchor.

Defined results: rows with a null label, a null vector, null or non-finite components take no part, nor do rows whose squared
length reaches 2^62 (their scores may not fit 64 bits); vectors meet those of their own length only; rows are told apart by
row, not by vec_id, so a repeated row is another row; at equal scores the smaller vec_id comes first, null last; a row without
vec_id is never an anchor; a positive with a negative score has no negatives; an empty table gives an empty table; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gnat import Index
from .store import cut

#: Scores of negatives as percent of the positive's.
LEAST, MOST = 30, 90
#: Bounds of an open window: no score reaches them.
OPEN = 1 << 62


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """rid, vec_id, label, v of the rows that take part: components times ``scale``, rounded down."""
    x = F.transform("embedding", lambda c: F.floor(scale * c.cast("double")))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    length = F.aggregate("embedding", F.lit(0.0), lambda a, c: a + F.floor(scale * c.cast("double")).cast("double") * F.floor(scale * c.cast("double")).cast("double"))
    kept = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite).filter(length < float(OPEN))
    return cut(kept.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.col("label").cast("long").alias("label"), x.cast("array<int>").alias("v")))


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label. anchors: which rows are anchors, by vec_id.
    """
    index = Index(usable(vectors, scale))
    own = index.leaves.filter(anchors)
    ids = own.select("rid", F.col("vec_id").alias("anchor_id"))
    everywhere = F.array(F.struct(F.lit(0).alias("w"), F.lit(-OPEN).alias("lo"), F.lit(OPEN).alias("hi")))
    base = own.select("rid", "label", "v", "cell", "chunk")
    good = cut(index.search(base.withColumn("windows", everywhere), positives, True).select("rid", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(19, 0)")
    lo, hi = F.ceil(score * LEAST / 100).cast("long"), F.floor(score * MOST / 100).cast("long")
    asked = good.filter("positive_score >= 0").groupBy("rid").agg(F.collect_list(F.struct("w", lo.alias("lo"), hi.alias("hi"))).alias("windows"))
    found = index.search(base.join(asked, "rid"), negatives, False)
    return cut(
        found.join(good, ["rid", "w"]).join(ids, "rid").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )

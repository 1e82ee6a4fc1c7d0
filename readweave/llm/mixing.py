"""Mixing sources to target weights.

Targets: every source gets a share of the mix in proportion to its weight, but not more than ``cap`` times its own
size; what is over goes to the others by weight, until none is above its cap.

Packing: the words of a source's documents, one after another, are packed in blocks of ``block_words`` words; a
document covers parts of one or more blocks. A source is packed in chunks of about ``chunk_words`` words or
``chunk_rows`` rows, so no task gets a whole source; the last block of a chunk can be short.

Drawing: the mix has a slot of one block for each block of the sources' targets (quotas); output shards have
``shard_slots`` slots each. How many slots of each shard go to each source is a multinomial draw given that the quotas are
used up exactly, so sources stay at their targets however small they are: all slots, source after source, pass through a
keyed permutation and are dealt to the shards in its order, and their counts by shard and source are the draw. The
sources' slots are then numbered shard after shard; slot k of a source with n blocks takes block permutation(k mod n) in
pass k div n, by a permutation of its source and pass. Slots and blocks meet in a join on (source, block).

Permutations are Feistel networks over two digits of about the root of n values, walked until they end below n.

Defined results: null texts have no words and are never taken; a null source is a source, the last one; identical
rows (id, source and text) are copies, packed like others; ties of names don't occur, as a source is its name; texts of
any length are covered by their blocks; an empty table gives an empty mix; doc_id may be of any type and columns may have
any names; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import cut
from .text import SPACED, SPACES, count_spaced, row_hash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 64
CHUNK_WORDS, CHUNK_ROWS = 1 << 20, 1 << 18
SHARD_SLOTS = 4096
SEED = 17
#: Above so many sources their table is joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000
ROUNDS = 6
#: Shards whose sums are added before the rest, so no task runs along all shards of a source.
RUN = 4096


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with a gapless index in the order of one column, without gathering rows in one task.

    Rows are dealt by ranges of the order, counted for each range, and numbered inside their range.
    """
    ranged = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.withColumn("_first", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_own", inside).join(F.broadcast(before.drop("_n")), "_part").withColumn(name, F.col("_first") + F.col("_own")).drop("_part", "_own", "_first")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_index, source_size and target, from one row (source, source_size) for each source.

    Weights repeat over the sources by code point, null last.
    """
    known = numbered(sizes, F.col("source").asc_nulls_last(), "source_index")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_index") % len(weights) + 1).cast("int"))
    known = cut(known.withColumn("weight", w).withColumn("most", cap * F.col("source_size")))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, None
    while True:  # each round fills more sources up to their cap; only two sums come back
        above = F.lit(False) if level is None else F.col("weight") * level > F.col("most")
        r = known.agg(F.sum(F.when(above, F.col("most")).otherwise(0.0)).alias("capped"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(above).alias("full")).first()
        if r["full"] == full or not r["open"]:
            break
        full, level = r["full"], (share * total - r["capped"]) / r["open"]
    return known.withColumn("target", F.least("most", F.col("weight") * F.lit(level or 0.0))).drop("weight", "most")


def _uniform(bound: Column, *key: Column | int) -> Column:
    """Pseudorandom long in [0, bound)."""
    return F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, int) else k for k in key]), F.greatest(bound, F.lit(1)))


def permuted(i: Column, n: Column, *key: Column | int) -> Column:
    """A keyed permutation of 0 .. n - 1.

    i = r a + l with l below a, r below b, a b the least such product that reaches n: rounds add a hash of one digit to
    the other. Fewer than a of the a b values are n or more; from there the network is walked on until it is below n.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.ceil(n / a).cast("long")

    def network(x: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            left = (acc["l"] + _uniform(a, *key, k, acc["r"])) % a
            right = (acc["r"] + _uniform(b, *key, k, acc["l"])) % b
            even = k % 2 == 0
            return F.struct(F.when(even, left).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(right).alias("r"))

        start = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["r"] * a + acc["l"])

    # fewer than a values are outside: 64 steps leave none for n up to 4,096 and one in (root of n)^64 above
    return F.aggregate(F.array_repeat(F.lit(0), 64), network(i), lambda acc, _: F.when(acc < n, acc).otherwise(network(acc)))


def plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, chunk_words: int = CHUNK_WORDS, chunk_rows: int = CHUNK_ROWS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, source, text) as three tables.

    rows: a row for each document: row_id (struct), doc_id, text_key, copy (from 1), size, source, source_index,
    source_size, target. spans: a row for each run of words that a block holds: row_id, source_index, block, start,
    n_words. slots: a row for each slot of the mix: shard, source_index, block, pass.
    """
    each = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), count_spaced(F.col("text")).alias("size"))
    sized = cut(each.groupBy("source", "doc_id", "text_key", "size").agg(F.count("*").alias("copies")))
    sizes = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("source_rows"))
    known = cut(targets(sizes, weights, share, cap))
    few = known.count() <= MAX_BROADCAST_SOURCES
    side = (F.broadcast(known) if few else known).withColumnRenamed("source", "_source")
    rows = sized.join(side, sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    # chunks of a source by hash; inside a chunk a running sum of sizes
    chunks = F.greatest(F.ceil(F.col("source_size") / chunk_words), F.ceil(F.col("source_rows") / chunk_rows)).cast("long")
    rows = rows.withColumn("chunk", _uniform(chunks, F.col("doc_id"), F.col("text_key"), F.col("copy"), seed)).drop("source_rows")
    inside = W.partitionBy("source_index", "chunk").orderBy("doc_id", "text_key", "size", "copy")
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("end", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = cut(rows.withColumn("row_id", F.struct("source_index", "chunk", "nth")))
    # blocks of a source are numbered chunk after chunk
    held = rows.groupBy("source_index", "chunk").agg(F.ceil(F.sum("size") / block_words).cast("long").alias("n_blocks"))
    held = cut(running(held, "chunk", "n_blocks", "first_block"))
    begin, end = F.col("end") - F.col("size"), F.col("end")
    covered = F.sequence(F.floor(begin / block_words), F.floor((end - 1) / block_words))
    spans = rows.filter("size > 0").join(held.drop("n_blocks"), ["source_index", "chunk"]).select("row_id", "source_index", "first_block", begin.alias("begin"), end.alias("end"), F.explode(covered).alias("b"))
    lo, hi = F.greatest(F.col("begin"), F.col("b") * block_words), F.least(F.col("end"), (F.col("b") + 1) * block_words)
    spans = spans.select("row_id", "source_index", (F.col("first_block") + F.col("b")).alias("block"), (lo - F.col("begin")).alias("start"), (hi - lo).alias("n_words"))
    return rows, spans, slots(known, held, cap, shard_slots, seed)


def running(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Column ``name``: the sum of ``value`` over a source's rows before this one in the order of a whole number.

    Runs of the order are added first, so no task goes along all rows of a source.
    """
    ranged = df.withColumn("_run", F.floor(F.col(order) / RUN))
    runs = ranged.groupBy("source_index", "_run").agg(F.sum(value).alias("_n"))
    earlier = W.partitionBy("source_index").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = W.partitionBy("source_index", "_run").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(runs, ["source_index", "_run"]).withColumn(name, F.col("_first") + F.col("_own")).drop("_run", "_first", "_own")


def unrolled(df: DataFrame, first: Column, n: Column, total: int, *keys: str) -> DataFrame:
    """A row for each k from ``first`` on, ``n`` of them; large ones are unrolled in ranges, so no task unrolls a whole source."""
    step = 1 << 16
    ends = F.sequence(first, first + n - 1, F.lit(step).cast("long"))
    ranges = df.withColumn("_end", first + n).withColumn("_lo", F.explode(ends)).repartition(min(10_000, 1 + total // step), *keys, "_lo")
    return ranges.withColumn("k", F.explode(F.sequence(F.col("_lo"), F.least(F.col("_lo") + step, F.col("_end")) - 1))).drop("_lo", "_end")


def draw(quotas: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, source_index and n: how many slots of each shard go to each source; every shard but the last has ``shard_slots``."""
    # the sources are one line, so they stand where `running` looks for its key
    line = running(quotas.select(F.lit(0).alias("source_index"), F.col("source_index").alias("nth"), "quota"), "nth", "quota", "first")
    dealt = unrolled(line.select(F.col("nth").alias("source_index"), "first", "quota"), F.col("first"), F.col("quota"), total, "source_index")
    shard = F.floor(permuted(F.col("k"), F.lit(total).cast("long"), seed, 3) / shard_slots)
    return dealt.groupBy(shard.alias("shard"), "source_index").agg(F.count("*").alias("n"))


def slots(known: DataFrame, held: DataFrame, cap: float, shard_slots: int, seed: int) -> DataFrame:
    """The drawn slots: shard, source_index, block and pass."""
    quotas = known.join(held.groupBy("source_index").agg(F.sum("n_blocks").alias("n_blocks")), "source_index").filter("n_blocks > 0")
    quota = F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")), F.floor(cap * F.col("n_blocks"))).cast("long")
    quotas = cut(quotas.select("source_index", "n_blocks", quota.alias("quota")).filter("quota > 0"))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    drawn = cut(draw(quotas, total, shard_slots, seed))
    numbered_slots = unrolled(running(drawn, "shard", "n", "first"), F.col("first"), F.col("n"), total, "source_index")
    each = numbered_slots.join(F.broadcast(quotas) if quotas.count() <= MAX_BROADCAST_SOURCES else quotas, "source_index")
    each = each.withColumn("pass", F.floor(F.col("k") / F.col("n_blocks")))
    block = permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), F.col("source_index"), F.col("pass"), seed)
    # a written table has its real size: what it was unrolled from is so small that a join would broadcast it
    return cut(each.select("shard", "source_index", block.alias("block"), "pass"))


def taken(rows: DataFrame, spans: DataFrame, drawn: DataFrame) -> DataFrame:
    """``rows`` with the number of words that the mix takes from each document, repeats counted."""
    met = spans.join(drawn, ["source_index", "block"]).groupBy("row_id").agg(F.sum("n_words").alias("taken"))
    return rows.join(met, "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, **options: int) -> DataFrame:
    """The mix as documents: a row for each run of neighbouring blocks that a pass takes of a document, with that part of its
    text as it stands there, white space and all.

    Columns as in ``docs``; n_chars, where it is a column, is counted anew. Copies of a document (id, source and text) whose
    other columns differ are told apart by a hash of those.
    """
    rows, spans, drawn = plan(docs.select("doc_id", "source", "text"), **options)
    met = spans.join(drawn, ["source_index", "block"]).select("row_id", "pass", "start", "n_words")
    along = W.partitionBy("row_id", "pass").orderBy("start")
    new = F.coalesce(F.lag(F.col("start") + F.col("n_words")).over(along) != F.col("start"), F.lit(True))
    marked = met.withColumn("new", new.cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = marked.groupBy("row_id", "pass", "run").agg(F.min("start").alias("start"), F.sum("n_words").alias("n_words"))
    per_row = runs.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pass", "start", "n_words"))).alias("runs"))
    # which copy a row is matters to no one but its own runs
    key = ["id", "source", "text_key", "copy"]
    named = rows.join(per_row, "row_id").select(F.col("doc_id").alias("id"), "source", "text_key", "copy", "runs")
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), docs["source"].alias("source"), F.xxhash64(docs["text"]).alias("text_key"), row_hash(docs).alias("row_hash"))
    own = own.withColumn("copy", F.row_number().over(W.partitionBy("id", "source", "text_key").orderBy("row_hash")).cast("long"))
    joined = own.alias("o").join(named.alias("n"), [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]).select("row", "runs")
    # a word with the white space behind it; what stands before the first word goes with it
    words = F.regexp_extract_all(F.col("row.text"), F.lit(f"({SPACED}{SPACES}*)"), F.lit(1))
    before = F.regexp_extract(F.col("row.text"), f"^{SPACES}+", 0)
    split = joined.withColumn("words", words).withColumn("run", F.explode("runs"))
    part = F.array_join(F.slice("words", (F.col("run.start") + 1).cast("int"), F.col("run.n_words").cast("int")), "")
    split = split.withColumn("part", F.concat(F.when(F.col("run.start") == 0, before).otherwise(""), part))
    replaced = {"text": F.col("part"), "n_chars": F.length("part").cast("long")}
    return split.select(*[replaced.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

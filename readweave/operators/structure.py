"""Read structure: from alignment operations and blocks to exon breaks and cluster keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

BLOCK_ORDER = ("st", "en", "blk", "pk")
#: Operations that use up reference bases, and read bases.
ON_REFERENCE, ON_READ = ("M", "=", "X", "D", "N"), ("M", "=", "X", "I", "S")


#: Bytes of CIGAR text that are taken apart together.
TEXT = 1 << 22


def _operations(cigars: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all operations ([0-9]+[MIDNSHPX=]) of the texts: text, index in it, letter, length, reference and read bases before it."""
    text = np.frombuffer(b" ".join(cigars) + b" ", np.uint8)
    ends = np.cumsum([len(c) + 1 for c in cigars])
    digit = (text >= 48) & (text <= 57)
    at = np.flatnonzero(np.isin(text[1:], np.frombuffer(b"MIDNSHPX=", np.uint8)) & digit[:-1]) + 1
    length, here, place, tens = np.zeros(len(at), np.int64), np.ones(len(at), bool), at - 1, 1
    while here.any():
        if tens > 10**9:
            raise ValueError("an operation is longer than a whole number of 32 bits")
        length += np.where(here, tens * (text[place].astype(np.int64) - 48), 0)
        here &= (place > 0) & digit[place - 1]
        place, tens = np.maximum(place - 1, 0), tens * 10
    row, letter = np.searchsorted(ends, at, "right"), text[at]
    first = np.searchsorted(row, row)

    def used(kinds: tuple[str, ...]) -> np.ndarray:
        own = np.where(np.isin(letter, np.frombuffer("".join(kinds).encode(), np.uint8)), length, 0)
        before = np.cumsum(own) - own
        return before - before[first]

    return row, np.arange(len(at)) - first, letter, length, used(ON_REFERENCE), used(ON_READ)


def cigar_ops(reads: DataFrame) -> DataFrame:
    """(read_id, pos, cigar) to one row per operation: i, op, length, ref_at, read_at (both of its first base).

    What an operation needs stands in its own CIGAR, so each is taken apart where it is read.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = pa.array([chr(c) for c in range(128)])
        for batch in batches:
            held = batch.filter(pc.is_valid(batch.column(2)))
            size = np.cumsum(pc.binary_length(held.column(2)).to_numpy(zero_copy_only=False)) // TEXT
            for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(size)) + 1):
                if not len(part):
                    continue
                own = held.slice(part[0], len(part))
                row, i, letter, length, reference, read = _operations(own.column(2).cast(pa.binary()).to_pylist())
                row = pa.array(row)
                ref_at = pc.add(own.column(1).cast(pa.int64()).take(row), pa.array(reference))
                columns = [own.column(0).take(row), pa.array(i).cast(pa.int32()), letters.take(pa.array(letter)), pa.array(length).cast(pa.int32()), ref_at.cast(pa.int32()), pa.array(read + 1).cast(pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["read_id", "i", "op", "length", "ref_at", "read_at"])

    own = reads.select("read_id", "pos", "cigar")
    kinds = StructType([own.schema["read_id"], *StructType.fromDDL("i int, op string, length int, ref_at int, read_at int").fields])
    return own.mapInArrow(split, kinds)


def matched_blocks(ops: DataFrame) -> DataFrame:
    """Blocks st, en (1-based, inclusive) of the matching operations."""
    return ops.filter(F.col("op").isin("M", "=", "X")).select("read_id", F.col("i").alias("blk"), F.lit(0).alias("pk"), F.col("ref_at").alias("st"), (F.col("ref_at") + F.col("length") - 1).alias("en"))


def gap_islands(blocks: DataFrame, gap: int, keys: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """Column exon: a new one opens when a block starts more than ``gap`` after all ends before it."""
    order = W.partitionBy(*keys).orderBy(*BLOCK_ORDER)
    before = F.max("en").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("st") - before <= gap, 0).otherwise(1)
    return blocks.withColumn("_new", new).withColumn("exon", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")).drop("_new")


def exons(blocks: DataFrame, gap: int, carried: tuple[str, ...] = ("source", "chrom", "fwd")) -> DataFrame:
    """read_id, exon, st, en and the carried columns, which are the same for all blocks of a read."""
    return gap_islands(blocks, gap).groupBy("read_id", "exon").agg(*[F.first(c).alias(c) for c in carried], F.min("st").alias("st"), F.max("en").alias("en"))


def read_breaks(exon_rows: DataFrame, carried: tuple[str, ...] = ("source", "chrom", "fwd")) -> DataFrame:
    """One row per read: start, end, number of exons and the breaks st, en, st, en, ... as an array."""
    parts = F.array_sort(F.collect_list(F.struct("exon", "st", "en")))
    found = exon_rows.groupBy("read_id").agg(*[F.first(c).alias(c) for c in carried], F.min("st").alias("st"), F.max("en").alias("en"), F.count("*").alias("n_exons"), parts.alias("_x"))
    return found.withColumn("breaks", F.flatten(F.transform("_x", lambda x: F.array(x["st"], x["en"])))).drop("_x")


def bin_breaks(breaks: Column, size: int, *, forward: Column | None = None, drop_end: bool = False) -> Column:
    """floor(b / size) of each break; drop_end leaves out the first (forward) or last (reverse) one."""
    binned = F.transform(breaks, lambda b: F.floor(b / size).cast("int"))
    if not drop_end:
        return binned
    n = F.size(breaks)
    return F.when(forward, F.slice(binned, 2, n)).otherwise(F.slice(binned, 1, n - 1))


def trim_short_terminal_exons(exon_rows: DataFrame, least: int) -> DataFrame:
    """Drop a first or last exon of under ``least`` bases, unless no other is left."""
    own = W.partitionBy("read_id")
    size, n = F.col("en") - F.col("st") + 1, F.count("*").over(own)
    last = F.max("exon").over(own)
    marked = exon_rows.withColumn("_short", (F.col("exon").isin(1) | (F.col("exon") == last)) & (size < least))
    return marked.withColumn("_left", n - F.sum(F.col("_short").cast("int")).over(own)).filter(~F.col("_short") | (F.col("_left") == 0) & (F.col("exon") == 1)).drop("_short", "_left")


def end_type(start: Column, end: Column, near_start: int, near_end: int) -> Column:
    """5_3, 5_no3, no5_3 or no5_no3: whether a read begins and ends near the ends of the sequence."""
    return F.concat(F.when(start <= near_start, "5").otherwise("no5"), F.lit("_"), F.when(end >= near_end, "3").otherwise("no3"))


def leader_flag(breaks: Column, second_gene_start: Column | int, tol: int, gap: int | None = None) -> Column:
    """Whether the first exon ends left of the second gene's start, or (with ``gap``) the first gap is longer than that."""
    early = F.element_at(breaks, 2) < F.lit(second_gene_start) - tol
    return early if gap is None else early | F.coalesce(F.get(breaks, F.lit(2)) - F.get(breaks, F.lit(1)) > gap, F.lit(False))


def cluster_key_unannotated(fwd: Column, start: Column, end: Column, size: int) -> Column:
    """Binned last position, or first on the reverse strand."""
    return F.floor(F.when(fwd, end).otherwise(start) / size).cast("string")


def strand_suffix(key: Column, fwd: Column) -> Column:
    return F.concat(key, F.when(fwd, "+").otherwise("-"))


def merge_supplementary(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Breaks of a read's primary blocks and of those extra blocks on its strand that are free, on the reference and on the
    read, of the primary blocks and of all extra ones accepted before them (by st, en, q1).

    A read's blocks are few, so each read is decided by one aggregate over its own array.
    """
    block = F.struct("st", "en", "q1", "q2")
    own = primary.groupBy("read_id").agg(F.first("fwd").alias("fwd"), F.collect_list(block).alias("held"))
    more = extra.groupBy("read_id", "fwd").agg(F.array_sort(F.collect_list(block)).alias("more"))
    both = own.join(more, ["read_id", "fwd"], "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<st:int,en:int,q1:int,q2:int>>")))

    def take(held: Column, x: Column) -> Column:
        meets = F.exists(held, lambda h: ((h["st"] <= x["en"]) & (x["st"] <= h["en"])) | ((h["q1"] <= x["q2"]) & (x["q1"] <= h["q2"])))
        return F.when(meets, held).otherwise(F.concat(held, F.array(x)))

    kept = F.array_sort(F.aggregate("more", F.col("held"), take))
    return both.select("read_id", F.flatten(F.transform(kept, lambda s: F.array(s["st"], s["en"]))).alias("breaks"))


def joined(a: Column, sep: str = ",") -> Column:
    """An array as text."""
    return F.array_join(F.transform(a, lambda x: x.cast("string")), sep)


def breaks_to_string(breaks: Column, offset: int = 0, scale: int = 1) -> Column:
    return joined(F.transform(breaks, lambda b: b * scale + offset))


def clip_class(left: Column, right: Column, threshold: int) -> Column:
    """Where unaligned ends over a threshold are."""
    return F.when((left > threshold) & (right > threshold), "both").when(left > threshold, "5").when(right > threshold, "3").otherwise("none")

"""Unaligned read ends, mismatches against the reference, and reads that are two."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import median_of


def clips(cigar: Column) -> tuple[Column, Column]:
    """Soft-clipped bases at the left and at the right."""
    left = F.coalesce(F.regexp_extract(cigar, "^(?:[0-9]+H)?([0-9]+)S", 1).try_cast("int"), F.lit(0))
    return left, F.coalesce(F.regexp_extract(cigar, "([0-9]+)S(?:[0-9]+H)?$", 1).try_cast("int"), F.lit(0))


def leftover_ends(reads: DataFrame, longer_than: int, least: float) -> DataFrame:
    """The longer clipped end of each read (left if equal) if it is long enough and its median quality reaches ``least``.

    reads: read_id, cigar, seq, q (array). Gives read_id, side, seq, q.
    """
    left, right = clips(F.col("cigar"))
    sized = reads.withColumn("_l", left).withColumn("_r", right)
    n = F.greatest("_l", "_r")
    first = F.when(F.col("_l") >= F.col("_r"), F.lit(1)).otherwise(F.length("seq") - n + 1)
    ends = sized.filter(n > longer_than).select("read_id", F.when(F.col("_l") >= F.col("_r"), "left").otherwise("right").alias("side"), F.substring(F.col("seq"), first, n).alias("seq"), F.slice("q", first, n).alias("q"))
    return ends.filter(median_of(F.col("q")) >= least)


def rescue_candidates(reads: DataFrame, least: int, most: int, away: int, reference_length: int) -> DataFrame:
    """read_id, five, three: clips of a length between bounds beside an alignment that stops ``away`` bases from that end of the reference."""
    left, right = clips(F.col("cigar"))
    five = left.between(least, most) & (F.col("st") > away)
    three = right.between(least, most) & (F.col("en") < reference_length - away)
    return reads.select("read_id", five.alias("five"), three.alias("three")).filter("five OR three")


#: Scores of a run's own base and of another one: the best stretch is the local alignment to an endless run of the base.
OWN, OTHER = 10, 8


#: Bytes of sequences that are looked through together.
TEXT = 1 << 18


def _best_runs(seqs: list[bytes], base: int) -> np.ndarray:
    """first, last and n (see best_run) of each of some sequences, with zeros where the base isn't there."""
    found, size = np.zeros((3, len(seqs)), np.int64), np.array([len(s) for s in seqs])
    text = np.frombuffer(b"".join(seqs), np.uint8)
    if len(text) and text.max() > 127:  # a letter of several bytes is one
        begins_letter = (text & 0xC0) != 0x80
        size = np.diff(np.concatenate([[0], np.cumsum(begins_letter)])[np.concatenate([[0], np.cumsum(size)])])
        text = text[begins_letter]
    full = np.flatnonzero(size)
    if not len(full):
        return found
    size = size[full]
    begin = np.cumsum(size) - size
    score = np.where(text == base, OWN, -OTHER)
    # each sequence begins below all sums of those before it, so the lowest sum so far is its own
    total = np.cumsum(score) - np.repeat(np.arange(len(full)) * ((OWN + OTHER) * len(text)), size)
    gain = total - np.minimum.accumulate(total - score)
    best = np.maximum.reduceat(gain, begin)
    at = np.flatnonzero(gain == np.repeat(best, size))
    at = at[np.searchsorted(at, begin)]
    fresh = np.concatenate([[-1], np.flatnonzero(gain <= 0)])
    first = np.maximum(fresh[np.searchsorted(fresh, at) - 1] + 1 - begin, 0)
    last = at + 1 - begin
    found[:, full] = np.where(best > 0, [first, last, (best + OTHER * (last - first)) // (OWN + OTHER)], 0)
    return found


def best_run(seq: Column, base: str) -> Column:
    """The stretch of a sequence with the highest score as a run of ``base``: struct of first (from 0), last (excluded) and n, its
    bases of that kind; of equal ones the one that ends first, and that begins last. Null if the base isn't there. One pass, over
    the letters of many sequences at once."""

    @F.arrow_udf("struct<first:int,last:int,n:int>")
    def runs(seqs: pa.Array) -> pa.Array:
        size = np.cumsum(pc.fill_null(pc.binary_length(seqs), 0).to_numpy(zero_copy_only=False)) // TEXT
        parts = [seqs.slice(p[0], len(p)) for p in np.split(np.arange(len(size)), np.flatnonzero(np.diff(size)) + 1) if len(p)]
        found = np.concatenate([np.zeros((3, 0), np.int64), *[_best_runs(pc.fill_null(p.cast(pa.binary()), b"").to_pylist(), ord(base)) for p in parts]], axis=1)
        return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in found], ["first", "last", "n"], mask=pa.array(found[1] == 0))

    return runs(seq)


def split_internal_polya(reads: DataFrame, key: str, left: int = 15, right: int = 10, share: float = 0.9, inside: int = 10, longer_than: int = 0, least: float | None = None, bases: tuple[str, ...] = ("A",)) -> DataFrame:
    """Reads (key, seq, cigar; q, an array of qualities, if ``least`` is given) with a run of A in a clip become two, named .L
    (up to the run's end) and .R (from there on), and go themselves; the others stay as they are.

    A clip is searched if it has more than ``longer_than`` bases and a median quality of ``least``. The best run of the left
    clip counts if it is longer than ``left`` with a larger share than ``share`` of its base and begins more than ``inside``
    bases behind the read's start; else that of the right clip if longer than ``right`` and more than ``inside`` bases before
    the read's end. ``bases``: looked for in turn; with T the tails of reads of the other strand.
    """
    l, r = clips(F.col("cigar"))
    n = F.length("seq")
    own = reads.select(F.col(key).cast("string").alias("read_id"), "seq", l.alias("_l"), r.alias("_r"), *([F.col("q")] if least is not None else []))
    good = [F.col("_l") > longer_than, F.col("_r") > longer_than]
    if least is not None:
        parts = F.slice("q", 1, F.col("_l")), F.slice("q", F.greatest(F.lit(1), F.size("q") - F.col("_r") + 1), F.col("_r"))
        good = [F.when(g, median_of(q) >= least) for g, q in zip(good, parts)]
    runs, cuts = {}, []
    for side, (clip, off, shortest) in enumerate(((F.substring(F.col("seq"), F.lit(1), F.col("_l")), F.lit(0), left), (F.substring(F.col("seq"), n - F.col("_r") + 1, F.col("_r")), n - F.col("_r"), right))):
        for base in bases:
            name = f"_run{side}{base}"
            runs[name], run = best_run(F.when(good[side], clip), base), F.col(name)
            # the quotient is rounded once, so a run of exactly this share has no larger one
            long = (run["last"] - run["first"] > shortest) & (run["n"] / (run["last"] - run["first"]) > share)
            place = run["first"] > inside if side == 0 else off + run["last"] < n - inside
            cuts.append(F.when(long & place, off + run["last"]))
    found = own.select("read_id", "seq", "_r", *[r.alias(name) for name, r in runs.items()]).select("read_id", "seq", F.coalesce(*cuts).alias("_at"))
    whole = F.array(F.struct(F.col("read_id").alias("id"), F.col("seq").alias("s")))
    two = F.array(
        F.struct(F.concat("read_id", F.lit(".L")).alias("id"), F.substring(F.col("seq"), F.lit(1), F.col("_at")).alias("s")),
        F.struct(F.concat("read_id", F.lit(".R")).alias("id"), F.substring(F.col("seq"), F.col("_at") + 1, F.length("seq")).alias("s")),
    )
    part = found.select(F.explode(F.when(F.col("_at").isNull(), whole).otherwise(two)).alias("p"))
    return part.select(F.col("p.id").alias("read_id"), F.col("p.s").alias("seq"))


def base_matches(pairs: DataFrame, key: str, st: Column) -> DataFrame:
    """key, pos, base, ref, error for every base of a block, from the bases of the read (a) and of the reference (b)."""
    zipped = F.arrays_zip(F.split("a", "").alias("a"), F.split("b", "").alias("b"))
    each = pairs.select(key, st.alias("_st"), F.posexplode(zipped).alias("i", "x")).filter("x.a <> '' AND x.b <> ''")
    return each.select(key, (F.col("_st") + F.col("i")).alias("pos"), F.col("x.a").alias("base"), F.col("x.b").alias("ref"), (F.col("x.a") != F.col("x.b")).cast("int").alias("error"))


def kmer_error_table(depth: DataFrame) -> DataFrame:
    """By k-mer: shares of all errors, of all depth and of all positions, and the ratio of the first two; from kmer, depth, errors."""
    by = depth.groupBy("kmer").agg(F.sum("errors").alias("e"), F.sum("depth").alias("d"), F.count("*").alias("k"))
    total = by.agg(F.sum("e").alias("te"), F.sum("d").alias("td"), F.sum("k").alias("tk"))  # one row
    shares = [F.try_divide(F.col(a).cast("double"), F.col(b)) for a, b in (("e", "te"), ("d", "td"), ("k", "tk"))]
    return by.join(F.broadcast(total)).select("kmer", shares[0].alias("error_share"), shares[1].alias("depth_share"), shares[2].alias("position_share"), F.try_divide(shares[0], shares[1]).alias("ratio"))

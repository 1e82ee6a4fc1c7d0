"""Phrase collocations by dynamic itemset counting.

The documents are dealt to a few shards, which are scanned in a cycle. Words are counted from the first scan on; a longer
phrase is activated after the scan in which the second of its two subphrases (the phrase without its last and without its
first word) reached the threshold, and is counted for one full cycle from there, so lengths are interleaved and every
active phrase sees each shard once. The scans end when every active phrase has completed its cycle: three cycles for
phrases of three words at most.

The counters of this are slots of a table of fixed size, by the phrase's hash, that stop at the threshold; so are the scans
after which slots reached it. The table of scans is at most 64 MB (2^26 slots of a byte) and travels to all workers. Phrases
that share a slot are activated early at most, and for a full cycle all the same. One scan more counts the phrases whose slots
reached the threshold by their words: these counts are returned, so slots that are shared cost time, never a count. On a
corpus so large that most slots are reached the scans prune less, and the last one counts more phrases.

Defined results: a null text counts as empty, a null language as `und`; a phrase never crosses a document, a piece or a
language; equal documents count as often as they are there; an empty table gives an empty table; extra columns are ignored,
whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, drop

#: Characters that end a piece, and those that divide its words.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Languages are called so where none is given.
UNKNOWN = "und"
#: Slots in bits, at least and at most; between them there is a slot for eight bytes of text. The value of a slot not reached.
SLOTS, NEVER = (16, 26), 255
#: Slots that are summed together.
PART = 1 << 15
#: Bytes of text that are counted together before counts are handed on.
CHUNK = 12 << 20

#: No byte of UTF-8: it stands for a break.
MARK = b"\xff"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + BREAKS + BLANKS, b"abcdefghijklmnopqrstuvwxyz" + MARK * len(BREAKS) + b" " * len(BLANKS))


class Places:
    """The words of a text whose breaks are marked, and of the phrase that starts at each place: its hash and when its slot was reached."""

    def __init__(self, lang: str, text: bytes, reached: np.ndarray):
        listed = pa.array(text.split(), pa.binary()).dictionary_encode()
        self.codes, self.known, self.reached = listed.indices.to_numpy().astype(np.int64), listed.dictionary, reached
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.known.to_pylist()], np.uint64)
        self.mask = np.uint64(len(reached) - 1)
        self.is_word = self.codes != self.known.index(pa.scalar(MARK, pa.binary())).as_py()
        self.code = self.hashes[self.codes]
        self.got = np.where(self.is_word, reached[self.code & self.mask], NEVER)

    def longer(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Go on to phrases of so many words: their places and the first scan that counts each. Both subphrases are reached."""
        both = (self.got[:-1] < NEVER) & (self.got[1:] < NEVER)
        at = np.flatnonzero(both)
        since = np.maximum(self.got[:-1], self.got[1:])[at].astype(np.int64) + 1
        old = self.code[at]
        own = (old ^ (old >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.codes[at + words - 1]]
        self.code, self.got = np.zeros(len(both), np.uint64), np.full(len(both), NEVER, np.uint8)
        seen = self.reached[own & self.mask]
        # a slot can be reached before by others: this phrase is reached after its own first scan at the earliest
        self.code[at], self.got[at] = own, np.where(seen < NEVER, np.maximum(seen, since), NEVER)
        return at, since

    def phrases(self, at: np.ndarray, words: int) -> pa.Array:
        parts = [self.known.take(pa.array(self.codes[at + i])) for i in range(words)]
        return (pc.binary_join_element_wise(*parts, b" ") if words > 1 else parts[0]).cast(pa.string())


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language together, lower-cased and with breaks marked, from batches of (lang, text)."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[tuple[str, bytes]]:
        for lang, texts in held.items():
            yield lang, MARK.join([MARK, *texts]).translate(FOLD).replace(MARK, b" \xff ")
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= CHUNK:
                yield from flush()
                size = 0
    yield from flush()


def scan(shard: DataFrame, known: Broadcast, step: int, cycle: int, longest: int, least: int) -> DataFrame:
    """Counts by slot of the phrases that are active in this scan, in parts of the table: part, slots (two bytes each; null: all
    of the part) and counts, that stop at ``least``."""
    kind = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(known.value), kind)

        def count(codes: np.ndarray, n: np.ndarray | None = None) -> None:
            slots, at, times = np.unique(codes & np.uint64(len(counts) - 1), return_inverse=True, return_counts=True)
            if n is not None:
                times = np.bincount(at, n, len(slots)).astype(np.int64)
            counts[slots] = np.minimum(least, counts[slots] + times)

        for lang, text in chunks(batches):
            p = Places(lang, text, known.value)
            if step < cycle:
                n = np.bincount(p.codes[p.is_word], minlength=len(p.known))
                count(p.hashes[n > 0], n[n > 0])
            for words in range(2, longest + 1):
                at, since = p.longer(words)
                count(p.code[at[(since <= step) & (step < since + cycle)]])
        used = np.flatnonzero(counts)
        for part, own in zip(np.unique(used // PART).tolist(), np.split(used, np.flatnonzero(np.diff(used // PART)) + 1)):
            whole = 3 * len(own) > PART
            slots = None if whole else (own % PART).astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([slots], pa.binary()), pa.array([(counts[part * PART : (part + 1) * PART] if whole else counts[own]).tobytes()], pa.binary())], ["part", "slots", "counts"])

    return shard.select("lang", "text").mapInArrow(run, "part int, slots binary, counts binary")


def summed(parts: DataFrame, least: int) -> DataFrame:
    """Counts of each part of the table (part, slots null, counts) and the slots that have reached ``least``, as bits."""
    kind = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # the table's parts are dealt out: no task has more than its share of them
        for b in batches:
            for part, slots, counts in zip(*[b.column(i).to_pylist() for i in range(3)]):
                total = held.setdefault(part, np.zeros(PART, kind))
                at = slice(None) if slots is None else np.frombuffer(slots, np.uint16)
                total[at] = np.minimum(least, total[at].astype(np.int64) + np.frombuffer(counts, kind))
        for part, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([None], pa.binary()), pa.array([total.tobytes()]), pa.array([np.packbits(total >= least).tobytes()])], ["part", "slots", "counts", "bits"])

    return parts.repartition("part").mapInArrow(run, "part int, slots binary, counts binary, bits binary")


def exact(docs: DataFrame, known: Broadcast, longest: int) -> DataFrame:
    """Counts, in parts to be summed, of the phrases whose slots and whose subphrases' slots are reached (lang, words, phrase, n);
    words 0: all word occurrences of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in chunks(batches):
            p = Places(lang, text, known.value)
            number = p.codes
            at = np.flatnonzero(p.is_word)
            out = [(0, pa.array([""]), np.array([len(at)]))]
            for words in range(1, longest + 1):
                if words > 1:
                    at, _ = p.longer(words)
                    key = number[at] * len(p.known) + p.codes[at + words - 1]
                else:
                    key = number[at]
                on = p.got[at] < NEVER
                at = at[on]
                _, first, same, n = np.unique(key[on], return_index=True, return_inverse=True, return_counts=True)
                number = np.full(len(p.got), -1)  # longer phrases start only where this one is reached
                number[at] = same
                out.append((words, p.phrases(at[first], words), n))
            for words, phrases, n in out:
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), pa.array(np.full(len(n), words, np.int32)), phrases, pa.array(n.astype(np.int64))], ["lang", "words", "phrase", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, words int, phrase string, n long")


def frequent(docs: DataFrame, longest: int = 3, least: int = 10, shards: int = 3) -> tuple[DataFrame, DataFrame]:
    """All phrases of at most ``longest`` words that occur ``least`` times or more in a language (lang, words, phrase, f), and
    the number of word occurrences of each language (lang, n). docs: text, lang."""
    if shards * longest >= NEVER:
        raise ValueError("a slot holds the number of a scan in one byte")
    # rows are dealt in turn, so copies of one text don't crowd a shard; what is in which shard changes no count
    own = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs["text"].alias("text"), (F.monotonically_increasing_id() % shards).cast("int").alias("shard"))
    dealt = cut(own.filter(F.length("text") > 0), "shard")
    size = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    reached = np.full(1 << min(SLOTS[1], max(SLOTS[0], (size // 8).bit_length())), NEVER, np.uint8)
    context, table, step, last = docs.sparkSession.sparkContext, None, 0, -shards
    # a slot reached by others can hold a phrase up by a scan for each further word
    while step < longest * shards and step <= max(shards - 1, last + shards + longest - 2):
        known = context.broadcast(reached)
        parts = scan(dealt.filter(F.col("shard") == step % shards), known, step, shards, longest, least)
        before = table
        table = cut(summed(parts if before is None else before.drop("bits").unionByName(parts), least))
        known.destroy()  # its copies lie on the disks of all machines
        if before is not None:
            drop(before)
        new = np.zeros(len(reached), bool)
        for part, bits in table.select("part", "bits").collect():  # at most 2^11 rows of 4 KB
            new[part * PART : (part + 1) * PART] = np.unpackbits(np.frombuffer(bits, np.uint8))
        new &= reached == NEVER
        if new.any():
            last = step
            reached = np.where(new, np.uint8(step), reached)
        step += 1
    known = context.broadcast(reached)
    counts = cut(exact(dealt, known, longest).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0)))
    known.destroy()
    drop(dealt, table)
    return counts.filter("words > 0").withColumnRenamed("n", "f"), counts.filter("words = 0").select("lang", "n")


def mine(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, covered: int = 50, shards: int = 3) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Of the cuts of a phrase in two the one with the lowest score a * a / (l * r) in millionths counts, at ties the first. A
    phrase goes if a longer candidate holds it and occurs in at least ``covered`` percent of its places.
    """
    often, totals = frequent(docs, longest, least, shards)
    f = often.select("lang", "phrase", "f")
    listed = often.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    joined = lambda first, n: F.array_join(F.slice("ws", first, n), " ")
    sides = listed.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)))
    sides = sides.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("ws") - F.col("k")).alias("right"))
    sides = sides.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    sides = sides.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # decimals of 38 digits: whole products, division that drops the fraction
    big = "cast({} as decimal(15, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {big.format('a')} * {big.format('a')}) div ({big.format('l')} * {big.format('r')})")
    best = sides.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    size = F.size("ws")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: joined(i, n))))
    inside = listed.filter(size > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = best.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("least.score"), F.desc("a"), "phrase")
    first = stays.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return cut(first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "least.l", "least.r", "n", "least.score"))

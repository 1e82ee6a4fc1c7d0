"""Katz backoff language model over words: Good-Turing discounted counts with exactly normalised backoff weights.

Tokens are the words of a text (A-Z lower-cased, divided by ASCII white space) and one end. For n = 2 .. ``order``

    P(w | h) = d(c) c(h, w) / c(h) for an n-gram that was seen, alpha(h) P(w | shorter h) for others,

and P(w) = d(c) c(w) / N with what the discounts leave for words never seen, which are one type. alpha(h) makes the
probabilities after h, over all types and the unseen one, sum to 1: (1 - the seen n-grams' probabilities) / (1 - the same
words' probabilities after the shorter h). A text begins after order - 1 starts.

How it runs. Documents are read once, in batches of about ``batch_tokens`` tokens, cut in segments, so neither a long text
nor many short ones are held whole. Words get numbers by falling count (a ranged sort), so a word's count follows from
its number and a table of at most sqrt(2 N) steps. Counts live in parts: ranges of a hash of the word or of the history.
For each level a batch asks every part in which it has n-grams, by one row of their histories, next words and training
counts here; the part adds the counts of all batches and answers each row by a row of totals. A batch's rows for a level
are never more than its own distinct words or histories, however many parts there are, so all rows together grow with the
tokens and not faster. A history of more than ``split`` tokens is divided by its next words over as many groups as that
needs, and the groups' sums are added by a grouping of their own, so no part holds a frequent history. Each token is then
evaluated in its batch by recursion over the levels.

Words are told apart by XXH64, histories of two words and more by a 64-bit mix of their numbers; two of n collide with a
probability of about n^2 / 2^65 (under 1 in 3,000 for 100 million).

Defined results: a null text is empty and has one token, the end; identical rows score the same; a null doc_id is not in
training; doc_id may be of any type; with nothing to learn from, every token is unseen; a text of any length is read
whole, segment after segment; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import runs, sorted_cells
from .mixing import numbered
from .store import cut, drop

ORDER = 2
BATCH_TOKENS = 600_000
#: Tokens of a segment: what a row holds at most.
SEGMENT = 2048
#: Words of a row of a batch's word list.
LISTED = 8192
#: Tokens for each part of the counts.
PART_TOKENS = 1 << 20
#: Tokens of a history that one group of rows takes.
SPLIT = 1 << 20
#: Good-Turing discounts apply to counts up to this one.
DISCOUNTED = 5
#: Number of the start, and of all words that aren't in training.
START, UNSEEN = -1, 0
#: A text is lower-cased and divided in pieces of so many bytes.
PIECE = 1 << 22


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Number of the range of all 64-bit keys that each is in."""
    return (((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def in_training(doc_id: Column) -> Column:
    """Documents to learn from: crc32 of the id as text, modulo 7, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 != 2, F.lit(False))


def _words(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased words of a text and its end (no word is empty), some at a time."""
    whole = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at + PIECE < len(whole):
        # a piece ends where white space begins
        stop = re.compile(rb"[\x20\x09-\x0D]").search(whole, at + PIECE)
        if stop is None:
            break
        yield whole[at : stop.start()].lower().split()
        at = stop.start()
    yield [*whole[at:].lower().split(), b""]


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values).cast(kind))


def _flat(t: pa.Table, c: str) -> np.ndarray:
    return t[c].combine_chunks().flatten().to_numpy()


def _groups(it: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by it."""
    for t in sorted_cells(it, (key,), 1):
        bounds = runs([t[key].to_numpy()])
        for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
            yield t.slice(lo, hi - lo).combine_chunks()


def segments(docs: DataFrame, order: int, batch_tokens: int) -> DataFrame:
    """Two kinds of rows. Segments: batch, seg, doc_batch and doc_i (the document), doc_id, learn, lead, tokens (numbers in
    the batch's word list; the first ``lead`` are what stands before the segment). Parts of the word list, which is sorted
    by hash: batch, seg, hashes, n (in training)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"batch long, seg int, doc_batch long, doc_i int, doc_id {id_type}, learn boolean, lead int, tokens array<int>, hashes array<long>, n array<int>"
    names = ["batch", "seg", "doc_batch", "doc_i", "doc_id", "learn", "lead", "tokens", "hashes", "n"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        batch = TaskContext.get().partitionId() << 32
        index: dict[bytes, int] = {}
        rows: list[tuple] = []  # doc_batch, doc_i, learn, lead, tokens
        ids: list[pa.Array] = []
        held = n_docs = 0

        def flush() -> Iterator[pa.RecordBatch]:
            v = len(index)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), np.uint64, v)
            by = np.argsort(hashes)
            number = np.empty(v, np.int32)
            number[by] = np.arange(v, dtype=np.int32)
            n, sizes = len(rows), np.array([len(r[4]) for r in rows])
            flat = number[np.concatenate([r[4] for r in rows])]
            learnt = np.concatenate([np.repeat([False, r[2]], [r[3], len(r[4]) - r[3]]) for r in rows])
            counts = np.bincount(flat[learnt], minlength=v)
            tokens = _lists(flat, sizes, pa.int32())
            own = [np.full(n, batch), np.arange(n, dtype=np.int32), np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int32)]
            none = [pa.nulls(n, pa.list_(x)) for x in (pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.concat_arrays(ids), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.int32()), tokens, *none], names)
            k = np.diff(np.append(np.arange(0, v, LISTED), v))
            none = [pa.nulls(len(k), x) for x in (pa.int64(), pa.int32(), ids[0].type, pa.bool_(), pa.int32(), tokens.type)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), batch)), pa.array(np.arange(len(k), dtype=np.int32)), *none, _lists(hashes[by].view(np.int64), k, pa.int64()), _lists(counts, k, pa.int32())], names)

        for b in it:
            for i in range(b.num_rows):
                doc_id, learn = b.column(0).slice(i, 1), b.column(1)[i].as_py()
                doc, before, lead = (batch, n_docs), [], 0
                n_docs += 1
                for ws in _words(b.column(2)[i].as_py()):
                    for k in range(0, len(ws), SEGMENT):
                        part = ws[k : k + SEGMENT]
                        place = index.setdefault
                        rows.append((*doc, learn, lead, np.array([place(w, len(index)) for w in (*before, *part)], np.int32)))
                        ids.append(doc_id)
                        before = [*before, *part][-(order - 1) :] if order > 1 else []
                        lead = len(before)
                        held += len(part)
                        if held >= batch_tokens:
                            yield from flush()
                            index.clear(), rows.clear(), ids.clear()
                            batch, held, n_docs = batch + 1, 0, 0
        if rows:
            yield from flush()

    return docs.select("doc_id", in_training(F.col("doc_id")).alias("learn"), "text").mapInArrow(run, schema)


class Words:
    """Counts by number, P(w), and the base's terms. ``counts``: distinct counts, falling; ``ends``: the last number of each."""

    def __init__(self, counts: np.ndarray, types: np.ndarray, texts: int) -> None:
        self.counts, self.ends, self.texts = counts, np.cumsum(types), texts
        self.total, self.types = int((counts * types).sum()), int(types.sum())
        stat = np.array([types[counts == r].sum() for r in range(1, DISCOUNTED + 2)], float)
        self.d = discounts(stat)
        small = stat[:DISCOUNTED] * np.arange(1, DISCOUNTED + 1)
        # what the discounts take is the unseen type's; with nothing to learn it has everything
        self.unseen = float((small * (1 - self.d[1:-1])).sum() / self.total) if self.total else 1.0
        if self.total and not self.unseen:  # no count is small enough for a discount: half a count is the unseen type's
            self.unseen = 0.5 / (self.total + 0.5)
            self.d = self.d * self.total / (self.total + 0.5)

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training counts; of the start, the number of texts."""
        out = np.where(ids == START, self.texts, 0)
        seen = ids > 0
        out[seen] = self.counts[np.searchsorted(self.ends, ids[seen])]
        return out

    def p(self, ids: np.ndarray) -> np.ndarray:
        c = self.count(ids)
        return np.where(ids > 0, self.d[np.minimum(c, DISCOUNTED + 1)] * c / max(self.total, 1), self.unseen)


def discounts(stat: np.ndarray) -> np.ndarray:
    """d(c) for c = 0 .. DISCOUNTED + 1 (the last for all larger counts), Katz's form of Good-Turing, from the numbers of
    types with counts 1 .. DISCOUNTED + 1.

    A discount outside 0 to 1 is taken from numbers smoothed along a line in log-log scale; where that gives none either,
    half a count is taken off.
    """
    k, r = DISCOUNTED, np.arange(1, DISCOUNTED + 1)

    def katz(n: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            left = (k + 1) * n[k] / n[0]
            d = ((r + 1) * n[1:] / n[:-1] / r - left) / (1 - left)
        return np.where((d > 0) & (d < 1), d, np.nan)

    d = katz(stat)
    known = stat > 0
    if np.isnan(d).any() and known.sum() > 1:
        line = np.polyfit(np.log(np.arange(1, k + 2)[known]), np.log(stat[known]), 1)
        d = np.where(np.isnan(d), katz(np.exp(np.polyval(line, np.log(np.arange(1, k + 2))))), d)
    d = np.where(np.isnan(d), 1 - 0.5 / r, d)
    return np.array([1.0, *d, 1.0])


def word_asks(rows: DataFrame, parts: int) -> DataFrame:
    """The batches' word lists cut where parts begin: part, batch, seg, hashes, n."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            t = pa.Table.from_batches([b])
            sizes = t["hashes"].combine_chunks().value_lengths().to_numpy()
            hashes, row = _flat(t, "hashes"), np.repeat(np.arange(len(sizes)), sizes)
            part = part_of(hashes, parts)
            bounds = runs([row, part])
            at = row[bounds[:-1]]
            k = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]]), *(pa.array(t[c].to_numpy()[at]) for c in ("batch", "seg")), _lists(hashes, k, pa.int64()), _lists(_flat(t, "n"), k, pa.int32())], ["part", "batch", "seg", "hashes", "n"])

    own = rows.filter("hashes IS NOT NULL").select("batch", "seg", "hashes", "n")
    return own.mapInArrow(run, "part int, batch long, seg int, hashes array<long>, n array<int>")


def word_counts(asked: DataFrame) -> DataFrame:
    """(part, hash, c) of all words of training."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it, "part"):
            hashes, at = np.unique(_flat(t, "hashes"), return_inverse=True)
            c = np.bincount(at, _flat(t, "n"), len(hashes)).astype(np.int64)
            seen = c > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(seen.sum()), t["part"][0].as_py(), np.int32)), pa.array(hashes[seen]), pa.array(c[seen])], ["part", "hash", "c"])

    return asked.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, hash long, c long")


def numbered_words(asked: DataFrame, texts: int) -> tuple[DataFrame, Words]:
    """(part, hash, id) of all words of training, numbered from 1 by falling count, and their counts."""
    vocab = cut(numbered(cut(word_counts(asked)), F.struct(-F.col("c"), F.col("hash")), "rank").select("part", "hash", "c", (F.col("rank") + 1).alias("id")))
    steps = sorted(((r["c"], r["n"]) for r in vocab.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)  # at most sqrt(2 N) rows
    return vocab, Words(np.array([c for c, _ in steps], np.int64), np.array([n for _, n in steps], np.int64), texts)


def word_answers(asked: DataFrame, vocab: DataFrame, whole: str) -> DataFrame:
    """batch, seg, part and the numbers of the words of each row that asked."""
    kind = pa.int32() if whole == "int" else pa.int64()
    both = asked.drop("n").unionByName(vocab.select("part", "hash", "id"), allowMissingColumns=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it, "part"):
            n = t["batch"].null_count  # the part's words come first, sorted
            hashes, ids = t["hash"].slice(0, n).to_numpy(), t["id"].slice(0, n).to_numpy()
            rows = t.slice(n).combine_chunks()
            if not rows.num_rows:
                continue
            own = _flat(rows, "hashes")
            found = np.full(len(own), UNSEEN, np.int64)
            if n:
                at = np.minimum(np.searchsorted(hashes, own), n - 1)
                found = np.where(hashes[at] == own, ids[at], UNSEEN)
            sizes = rows["hashes"].combine_chunks().value_lengths().to_numpy()
            yield pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in ("batch", "seg", "part")), _lists(found, sizes, kind)], ["batch", "seg", "part", "ids"])

    ordered = both.repartition("part").sortWithinPartitions("part", F.col("batch").asc_nulls_first(), "hash")
    return ordered.mapInArrow(run, f"batch long, seg int, part int, ids array<{whole}>")


def with_ids(rows: DataFrame, answers: DataFrame, whole: str) -> DataFrame:
    """Segments with the words' numbers for tokens."""
    kind = pa.int32() if whole == "int" else pa.int64()
    parts = rows.filter("hashes IS NULL").drop("hashes", "n")
    both = parts.unionByName(answers, allowMissingColumns=True)
    names = parts.columns
    schema = ", ".join(f"{c} {f'array<{whole}>' if c == 'tokens' else parts.schema[c].dataType.simpleString()}" for c in names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it, "batch"):
            n = t["part"].null_count  # segments come first, then the word list in its order
            ids, segs = _flat(t.slice(n), "ids"), t.slice(0, n).combine_chunks()
            sizes = segs["tokens"].combine_chunks().value_lengths().to_numpy()
            listed = _lists(ids[_flat(segs, "tokens")], sizes, kind)
            yield pa.RecordBatch.from_arrays([listed if c == "tokens" else segs[c].combine_chunks() for c in names], names)

    return both.repartition("batch").sortWithinPartitions("batch", F.col("part").asc_nulls_first(), "seg").mapInArrow(run, schema)


class Batch:
    """The tokens of a batch's segments, and for each level their distinct n-grams in the order of the rows that ask."""

    def __init__(self, t: pa.Table, words: Words, order: int, split: int, parts: int) -> None:
        flat, sizes = _flat(t, "tokens").astype(np.int64), t["tokens"].combine_chunks().value_lengths().to_numpy()
        lead = t["lead"].to_numpy()
        # every segment gets order - 1 tokens before it: its lead, and starts for what that lacks
        room = order - 1
        width = sizes - lead + room
        ends = np.cumsum(width)
        full = np.full(int(ends[-1]), START, np.int64)
        first = np.cumsum(sizes) - sizes
        inside = np.arange(len(flat)) - np.repeat(first, sizes)
        full[np.repeat(ends - width + room - lead, sizes) + inside] = flat
        own = np.arange(len(full)) - np.repeat(ends - width, width) >= room
        self.full, self.at = full, np.flatnonzero(own)
        self.owner = np.repeat(np.arange(len(sizes)), sizes - lead)
        self.learnt = np.repeat(t["learn"].to_numpy(zero_copy_only=False).astype(bool), sizes - lead)
        self.tokens, self.words, self.split, self.parts = full[self.at], words, split, parts

    def level(self, n: int) -> None:
        """The n-grams of ``n`` tokens. Heads are the distinct histories. ``gram``: place of each token's n-gram among the
        distinct ones, which are sorted by part, head, salt (the group of a divided history) and word."""
        before = [self.full[self.at - k] for k in range(1, n)]
        key, least = before[0], self.words.count(before[0])
        for ids in before[1:]:
            key = _mixed(key) + ids
            least = np.minimum(least, self.words.count(ids))
        known = np.logical_and.reduce([ids != UNSEEN for ids in before])
        self.known = known  # tokens whose history has no unseen word
        heads, h = np.unique(key[known], return_inverse=True)
        ws, w = np.unique(self.tokens[known], return_inverse=True)
        codes, first, at = np.unique(h * max(1, len(ws)) + w, return_index=True, return_inverse=True)
        head = codes // max(1, len(ws))
        word = ws[codes - head * max(1, len(ws))] if len(ws) else codes
        counts = np.bincount(at[self.learnt[known]], minlength=len(codes)) if len(codes) else codes
        salts = np.ones(len(heads), np.int64)
        salts[h] = np.maximum(1, -(-least[known] // self.split))
        salt = np.where(salts[head] > 1, (_mixed(word) & 0x7FFFFFFFFFFFFFFF) % salts[head], 0)
        part = part_of(_mixed(heads[head] + _mixed(salt)), self.parts)
        # codes are sorted by head and word already
        order = np.lexsort((salt, head, part)) if (salts > 1).any() else np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.heads, self.salts = heads, salts
        self.head, self.word, self.count, self.salt, self.part = head[order], word[order], counts[order], salt[order], part[order]
        self.gram, self.first = place[at], np.flatnonzero(known)[first[order]]

    def asked(self) -> np.ndarray:
        """Unseen words aren't asked for: their totals are 0."""
        return self.word != UNSEEN

    def groups(self) -> np.ndarray:
        """Bounds of the runs of one head and salt."""
        return runs([self.part, self.head, self.salt])


def _by_batch(known: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """Segments and replies of each batch together; segments have a level of 0."""
    none = {"part": "int", "hkey": "long", "totals": "array<int>", "small": "array<int>", "lower": "array<double>"}
    both = known.withColumn("level", F.lit(0))
    for r in replies:
        both = both.unionByName(r, allowMissingColumns=True)
    if not replies:
        both = both.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    return both.repartition("batch").sortWithinPartitions("batch", "level", F.col("part").asc_nulls_first(), "seg", "hkey")


def _evaluated(t: pa.Table, words: Words, order: int, upto: int, split: int, parts: int, d: list[np.ndarray]) -> tuple[Batch, np.ndarray]:
    """A batch and the probability of each of its tokens by the levels up to ``upto``, from the replies it has got."""
    level = t["level"].to_numpy()
    b = Batch(t.slice(0, int((level == 0).sum())).combine_chunks(), words, order, split, parts)
    p = words.p(b.tokens)
    for n in range(2, upto + 1):
        b.level(n)
        lo, hi = np.searchsorted(level, [n, n + 1])
        own = t.slice(lo, hi - lo).combine_chunks()
        # sums of divided histories have rows of their own, without a part; they come first
        k = own["part"].null_count
        rows = own.slice(k).combine_chunks()
        total = np.zeros(len(b.word))
        total[b.asked()] = _flat(rows, "totals")
        sums = np.zeros((len(b.heads), DISCOUNTED + 2))
        of = b.head[b.groups()[:-1]]
        whole = of[b.salts[of] == 1]
        sums[whole, :-1], sums[whole, -1] = _flat(rows, "small").reshape(-1, DISCOUNTED + 1), _flat(rows, "lower")
        if k:
            at = np.searchsorted(b.heads, own["hkey"].slice(0, k).to_numpy())
            sums[at, :-1], sums[at, -1] = _flat(own.slice(0, k), "small").reshape(-1, DISCOUNTED + 1), _flat(own.slice(0, k), "lower")
        r = np.arange(1, DISCOUNTED + 1)
        c = (sums[:, :DISCOUNTED] * r).sum(axis=1) + sums[:, DISCOUNTED]
        safe = np.maximum(c, 1)
        left = 1 - ((sums[:, :DISCOUNTED] * r * d[n][1:-1]).sum(axis=1) + sums[:, DISCOUNTED]) / safe
        # a history without any small count leaves half a count
        full = (left < 1e-9) & (c > 0)
        scale = np.where(full, safe / (safe + 0.5), 1.0)
        left = np.where(full, 0.5 / (safe + 0.5), left)
        alpha = np.where(c > 0, left / np.maximum(1 - sums[:, -1], 1e-12), 1.0)
        h, of = b.head[b.gram], total[b.gram]
        seen = scale[h] * d[n][np.minimum(of, DISCOUNTED + 1).astype(np.int64)] * of / safe[h]
        p[b.known] = np.where(of > 0, seen, alpha[h] * p[b.known])
    return b, p


def asks(known: DataFrame, replies: list[DataFrame], n: int, words: Words, order: int, split: int, parts: int, d: list[np.ndarray], whole: str) -> DataFrame:
    """For each batch and part a row: its histories there (with salt, number of groups and of next words), next words,
    their counts here and, above level 2, lower probabilities."""
    kind = pa.int32() if whole == "int" else pa.int64()
    names = ["batch", "part", "heads", "salt", "salts", "sizes", "words", "counts", "lower"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it, "batch"):
            b, p = _evaluated(t, words, order, n - 1, split, parts, d)
            b.level(n)
            if not len(b.heads):
                continue
            start, ok = b.groups()[:-1], b.asked()
            sizes = np.add.reduceat(ok.astype(np.int64), start)
            rows = runs([b.part[start]])
            per_row, elements = np.diff(rows), np.add.reduceat(sizes, rows[:-1])
            of = b.head[start]
            cols = [
                pa.array(np.full(len(per_row), t["batch"][0].as_py())),
                pa.array(b.part[start][rows[:-1]]),
                _lists(b.heads[of], per_row, pa.int64()),
                _lists(b.salt[start], per_row, pa.int32()),
                _lists(b.salts[of], per_row, pa.int32()),
                _lists(sizes, per_row, pa.int32()),
                _lists(b.word[ok], elements, kind),
                _lists(b.count[ok], elements, pa.int32()),
                pa.nulls(len(per_row), pa.list_(pa.float64())) if n == 2 else _lists(p[b.first][ok], elements, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"batch long, part int, heads array<long>, salt array<int>, salts array<int>, sizes array<int>, words array<{whole}>, counts array<int>, lower array<double>"
    return _by_batch(known, replies).mapInArrow(run, schema)


def totals(asked: DataFrame, n: int, words: Words, whole: str) -> DataFrame:
    """For each row that asked a row of totals, with the sums of histories that aren't divided (those that are: ``heads``);
    for each part a row of statistics (batch null) with the sums of its groups of divided histories."""
    kind = pa.int32() if whole == "int" else pa.int64()
    names = ["level", "batch", "part", "heads", "totals", "small", "lower", "stat"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it, "part"):
            per_row, sizes = t["heads"].combine_chunks().value_lengths().to_numpy(), _flat(t, "sizes")
            heads, salt, salts = (_flat(t, c) for c in ("heads", "salt", "salts"))
            by = np.lexsort((salt, heads))
            new = np.ones(len(by), bool)
            new[1:] = (heads[by][1:] != heads[by][:-1]) | (salt[by][1:] != salt[by][:-1])
            group = np.empty(len(by), np.int64)
            group[by] = np.cumsum(new) - 1
            k, one = int(new.sum()), by[new]
            w, c, of = _flat(t, "words").astype(np.int64), _flat(t, "counts"), np.repeat(group, sizes)
            by = np.lexsort((w, of))
            new = np.ones(len(by), bool)
            new[1:] = (of[by][1:] != of[by][:-1]) | (w[by][1:] != w[by][:-1])
            gram = np.empty(len(by), np.int64)
            gram[by] = np.cumsum(new) - 1
            first = by[new]
            total = np.bincount(gram, c, len(first))
            # sums over each group's seen n-grams: how many of each small count, the larger counts' sum, lower probabilities
            seen = total > 0
            head, own = of[first][seen], total[seen]
            chance = words.p(w[first][seen]) if n == 2 else _flat(t, "lower")[first][seen]
            small = np.stack([np.bincount(head[own == r], minlength=k) for r in range(1, DISCOUNTED + 1)] + [np.bincount(head, own * (own > DISCOUNTED), k)], axis=1)
            lower = np.bincount(head, chance, k)
            stat = np.bincount(np.minimum(own, DISCOUNTED + 2).astype(np.int64), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
            alone = salts == 1
            row = np.repeat(np.arange(len(per_row)), per_row)
            n_alone = np.bincount(row[alone], minlength=len(per_row))
            elements = np.bincount(row, sizes, len(per_row)).astype(np.int64)
            m = len(per_row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(m, n, np.int32)),
                    *(t[x].combine_chunks() for x in ("batch", "part")),
                    _lists(heads[~alone], per_row - n_alone, pa.int64()),
                    _lists(total[gram], elements, kind),
                    _lists(small[group[alone]].ravel(), n_alone * (DISCOUNTED + 1), kind),
                    _lists(lower[group[alone]], n_alone, pa.float64()),
                    pa.nulls(m, pa.list_(pa.int64())),
                ],
                names,
            )
            divided = one[salts[one] > 1]
            at = group[divided]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.nulls(1, pa.int64()), t["part"].combine_chunks().slice(0, 1), _lists(heads[divided], np.array([len(at)]), pa.int64()), pa.nulls(1, pa.list_(kind)), _lists(small[at].ravel(), np.array([len(at) * (DISCOUNTED + 1)]), kind), _lists(lower[at], np.array([len(at)]), pa.float64()), _lists(stat, np.array([len(stat)]), pa.int64())],
                names,
            )

    ordered = asked.repartition("part").sortWithinPartitions("part")
    return ordered.mapInArrow(run, f"level int, batch long, part int, heads array<long>, totals array<{whole}>, small array<{whole}>, lower array<double>, stat array<long>")


def answered(found: DataFrame, whole: str) -> DataFrame:
    """The replies for the batches: rows of totals, and for each divided history that a batch asked about its sums."""
    k = DISCOUNTED + 1
    own = found.filter("batch IS NOT NULL")
    each = found.filter("batch IS NULL").select("level", F.posexplode("heads").alias("i", "hkey"), "small", "lower")
    sums = [F.sum(F.get("small", F.col("i") * k + r)).cast(whole) for r in range(k)]
    divided = each.groupBy("level", "hkey").agg(F.array(*sums).alias("small"), F.array(F.sum(F.get("lower", F.col("i")))).alias("lower"))
    wanted = own.select("level", "batch", F.explode("heads").alias("hkey")).distinct()
    return own.select("level", "batch", "part", "totals", "small", "lower").unionByName(wanted.join(divided, ["level", "hkey"]), allowMissingColumns=True)


def evaluate(known: DataFrame, replies: list[DataFrame], words: Words, order: int, split: int, parts: int, d: list[np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document."""
    id_type = known.schema["doc_id"].dataType.simpleString()
    base_total = np.log10(words.total + words.types + 1)
    names = ["doc_batch", "doc_i", "doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(it, "batch"):
            b, p = _evaluated(t, words, order, order, split, parts, d)
            own = t.slice(0, int((t["level"].to_numpy() == 0).sum()))
            n, c = own.num_rows, words.count(b.tokens)
            found = [np.bincount(b.owner, x, n) for x in (np.ones(len(c)), c > 0, np.log10(c + 1) - base_total, np.log10(p))]
            cols = [own[k].combine_chunks() for k in names[:3]] + [pa.array(x.astype(np.int64)) for x in found[:2]] + [pa.array(x) for x in found[2:]]
            yield pa.RecordBatch.from_arrays(cols, names)

    made = _by_batch(known, replies).mapInArrow(run, f"doc_batch long, doc_i int, doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
    # a long document's segments may be in several batches
    return made.groupBy("doc_batch", "doc_i").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in names[3:]]).select(*names[2:])


def score(docs: DataFrame, *, order: int = ORDER, batch_tokens: int = BATCH_TOKENS, split: int = SPLIT, part_tokens: int = PART_TOKENS) -> tuple[DataFrame, int]:
    """doc_id, n_tokens, n_known, base_score and score of every row, and the number of training tokens."""
    read = cut(segments(docs, order, batch_tokens))
    size = read.filter("hashes IS NULL").agg(F.sum(F.size("tokens") - F.col("lead")).alias("n"), F.count_if(F.expr("learn AND lead = 0")).alias("texts")).first()
    parts = max(4, (size["n"] or 0) // part_tokens)
    # numbers and counts need more than 32 bits only where there are so many tokens
    whole = "int" if (size["n"] or 0) < 1 << 31 else "long"
    asked = cut(word_asks(read, parts))
    vocab, words = numbered_words(asked, size["texts"])
    known = cut(with_ids(read, word_answers(asked, vocab, whole), whole))
    drop(read, asked, vocab)
    d: list[np.ndarray] = [np.ones(0)] * 2
    replies: list[DataFrame] = []
    for n in range(2, order + 1):
        found = cut(totals(asks(known, replies, n, words, order, split, parts, d, whole), n, words, whole))
        stat = found.filter("batch IS NULL").agg(*[F.sum(F.get("stat", F.lit(i))) for i in range(DISCOUNTED + 1)]).first()
        d.append(discounts(np.array([x or 0 for x in stat], float)))
        replies.append(answered(found, whole))
    scored = cut(evaluate(known, replies, words, order, split, parts, d))
    drop(known)
    return scored, words.total

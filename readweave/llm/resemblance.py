"""Near copies by the similarity of their word shingles: long SimHash fingerprints, blocks, exact Jaccard, components.

A text is the set of its shingles of ``SHINGLE`` words; two texts are near copies if the Jaccard similarity of their sets
is ``LEAST`` or more. Candidates share one of 64 blocks of 16 bits of a SimHash of 1024 bits and differ in at most
``CHECKED`` of 128 further bits; each is then verified on the sets themselves, so no link is wrong. Of pairs at exactly
0.8 the blocks are expected to find 99 in 100 (0.8485 ** 16 for a block), of pairs at 0.85 more than 999 in 1000.

Equal sets are one class and are compared once. A cell with more candidates than members first gives those of its least
member only; what this leaves unlinked is compared in later rounds, over all blocks and in full. There the sets of the
members come to the cell, pairs not linked yet are verified in it, and links that connect the members leave it, never the
pairs: a large group costs rows in proportion to its size, and no link between components is lost.

Defined results: null and empty texts and texts of white space are one class; a text of fewer words than a shingle is one
shingle; `deduplicate` keeps one row of each component, that of the smallest doc_id (null last) and, where several texts
have that id, of the smallest hash of the text, with all its columns; doc_id may be of any type; a text of any length is
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components
from .blocks import CELL, PAIRS, STACKED, runs, sorted_cells
from .store import cut

SHINGLE = 5
#: Near copies have five times the shared shingles at least four times all shingles: a similarity of 0.8.
SHARED, ALL = 5, 4
BLOCKS, CHECKED = 64, 34
#: Before sets are compared in a dense cell, all 1024 bits are: 3.6 deviations above 155, the mean at 0.8, as CHECKED is of 128.
CHECKED_ALL = 196
#: Words of 64 bits: 16 for the blocks and two to check candidates by.
WORDS = BLOCKS // 4 + 2
#: A cell with more candidates than so many for each member is dense, and left to the last round.
DENSE = 1
#: The last round takes the blocks in so many parts, one after the other, as sets travel once for each dense block.
PARTS = 4
#: Blocks of the first round.
FIRST = 3


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, and ASCII white space
    if not ws:
        return np.zeros(0, np.uint64)
    joined, one = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= SHINGLE:
        return np.array([one(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in ws]).tolist()
    view = memoryview(joined)
    return np.unique(np.array([one(view[a : b - 1], 42) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])], np.uint64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits: a bit is set if it is set in more than half of the shingles; in a tie the least shingle has it."""
    if not len(found):
        return np.zeros(WORDS, np.uint64)
    total = np.zeros(WORDS * 64, np.int64)
    steps = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(found), 255):  # sums of so many bits fit a byte
        x = found[k : k + 255, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
        if not k:
            least = bits[0]
    return np.packbits(2 * total + least > len(found), bitorder="little").view(np.uint64)


def prints(docs: DataFrame) -> DataFrame:
    """For every row doc_id, text_key (a hash of the text), key (a hash of its whole set), its blocks and the bits to check by."""
    import xxhash

    base = np.arange(BLOCKS, dtype=np.int32) << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, words = np.zeros(b.num_rows, np.uint64), np.zeros((b.num_rows, WORDS), np.uint64)
            for i, t in enumerate(b.column(2)):
                found = shingles(t.as_py())
                keys[i], words[i] = xxhash.xxh64_intdigest(found.tobytes(), 7), fingerprint(found)
            own = base + np.ascontiguousarray(words[:, : BLOCKS // 4]).view(np.uint16)
            at = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, BLOCKS, dtype=np.int32)), pa.array(own.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys.view(np.int64)), at, *[pa.array(words[:, k].view(np.int64)) for k in (-2, -1)]], ["doc_id", "text_key", "key", "blocks", "c1", "c2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, key long, blocks array<int>, c1 long, c2 long")


def _cells(keyed: DataFrame) -> DataFrame:
    """Rows of blocks dealt to cells (block, a, b). Blocks are found large by the sixteenth of ids that a hash picks; only the cut into cells depends on it."""
    large = keyed.filter("pmod(xxhash64(id, 16), 16) = 0").groupBy("block").agg((F.count("*") * 16).alias("n")).filter(F.col("n") > CELL // 2)
    sized = keyed.join(F.broadcast(large), "block", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") / CELL), F.lit(1)).cast("int")).drop("n")
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    spread = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return spread.withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other")).drop("other")


def _sorted(cells: DataFrame) -> DataFrame:
    return cells.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b", "id")


def candidates(keyed: DataFrame) -> DataFrame:
    """Pairs (src > dst) of a block whose checked bits and labels allow a link, block null.

    A dense cell gives those of its least member only and a row with src null and its block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_cells(batches, ("block", "a", "b")):
            keys = [t[k].to_numpy() for k in ("block", "a", "b")]
            bounds, ids, chunk, label = runs(keys), t["id"].to_numpy(), t["chunk"].to_numpy(), t["label"].to_numpy()
            c1, c2 = (t[c].to_numpy().view(np.uint64) for c in ("c1", "c2"))

            def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                bits = np.bitwise_count(c1[i] ^ c1[j]).astype(np.int16) + np.bitwise_count(c2[i] ^ c2[j])
                return (bits <= CHECKED) & (label[i] != label[j])

            def pairs(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
                x, y = ids[i], ids[j]
                return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.nulls(len(x), pa.int64())], ["src", "dst", "block"])

            sizes, left_out = np.diff(bounds), []
            for size in np.unique(sizes[(sizes > 1) & (sizes <= STACKED)]).tolist():
                at = bounds[:-1][sizes == size]
                x, y = np.triu_indices(size, 1)
                step = max(1, PAIRS // len(x))
                for k in range(0, len(at), step):
                    i, j = (at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel()
                    ok = near(i, j) & ((keys[1][i] == keys[2][i]) | (chunk[i] != chunk[j]))
                    dense = ok.reshape(-1, len(x)).sum(axis=1) > DENSE * size
                    if dense.any():
                        # rows are sorted by id: pairs of the first member are those of the least
                        ok &= ~np.repeat(dense, len(x)) | np.tile(x == 0, len(dense))
                        left_out += keys[0][at[k : k + step][dense]].tolist()
                    yield pairs(i[ok], j[ok])
            for k in np.flatnonzero(sizes > STACKED).tolist():
                own = np.arange(bounds[k], bounds[k + 1])
                if (label[own] == label[own[0]]).all():
                    continue
                a, b = keys[1][own[0]], keys[2][own[0]]
                left, right = (own, own) if a == b else (own[chunk[own] == a], own[chunk[own] == b])
                seen, parts, step = 0, [], max(1, PAIRS // max(1, len(right)))
                for r in range(0, len(left), step):
                    i, j = np.nonzero(near(left[r : r + step, None], right[None, :]))
                    i, j = left[r : r + step][i], right[j]
                    ok = (i < j) if a == b else np.ones(len(i), bool)
                    parts.append((i[ok], j[ok]))
                    seen += int(ok.sum())
                if seen <= DENSE * len(own):
                    yield from (pairs(i, j) for i, j in parts)
                    continue
                # rows are sorted by id: the least member is the first
                ends = right[1:] if a == b else right[:1]
                ok = near(np.full(len(ends), left[0]), ends)
                yield pairs(np.full(int(ok.sum()), left[0]), ends[ok])
                left_out.append(int(keys[0][own[0]]))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(left_out), pa.int64()), pa.nulls(len(left_out), pa.int64()), pa.array(left_out, pa.int64())], ["src", "dst", "block"])

    return _sorted(_cells(keyed)).mapInArrow(run, "src long, dst long, block long")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SHARED * both >= ALL * (len(a) + len(b) - both)


def linked_within(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (src, dst) that connect what is similar enough in each cell of ``keyed`` (with ``blocks``) and not linked by its label yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_cells(batches, ("block", "a", "b"), 1 << 11):
            keys = [t[k].to_numpy() for k in ("block", "a", "b")]
            ids, chunk, label = (t[k].to_numpy() for k in ("id", "chunk", "label"))
            c1, c2 = (t[c].to_numpy().view(np.uint64) for c in ("c1", "c2"))
            # the low half of a block's key
            words = t["blocks"].combine_chunks().flatten().to_numpy().astype(np.uint16).reshape(t.num_rows, BLOCKS).view(np.uint64)
            lists = t["found"].combine_chunks()
            offsets, hashes = lists.offsets.to_numpy(), lists.values.to_numpy()
            src, dst, bounds = [], [], runs(keys)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own, parent = np.arange(lo, hi), {}

                def find(x: int, parent: dict[int, int] = parent) -> int:
                    while (up := parent.get(x, x)) != x:
                        parent[x] = parent.get(up, up)
                        x = up
                    return x

                same = keys[1][lo] == keys[2][lo]
                left, right = (own, own) if same else (own[chunk[own] == keys[1][lo]], own[chunk[own] == keys[2][lo]])
                step = max(1, (PAIRS >> 4) // max(1, len(right)))
                for r in range(0, len(left), step):
                    x, y = left[r : r + step, None], right[None, :]
                    bits = np.bitwise_count(c1[x] ^ c1[y]).astype(np.int16) + np.bitwise_count(c2[x] ^ c2[y])
                    i, j = np.nonzero((bits <= CHECKED) & (label[x] != label[y]) & ((x < y) | (not same)))
                    i, j = left[r : r + step][i], right[j]
                    ok = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int32) <= CHECKED_ALL
                    for u, v in zip(i[ok].tolist(), j[ok].tolist()):
                        p, q = find(int(label[u])), find(int(label[v]))
                        if p != q and _similar(hashes[offsets[u] : offsets[u + 1]], hashes[offsets[v] : offsets[v + 1]]):
                            parent[max(p, q)] = min(p, q)
                            src.append(int(ids[u]))
                            dst.append(int(ids[v]))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    met = _cells(keyed).join(sets, "id").select("block", "a", "b", "chunk", "id", "label", "c1", "c2", "blocks", "found")
    return _sorted(met).mapInArrow(run, "src long, dst long")


def sets_of(ids: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    """id and found, the set of shingles, for the keys in ``ids``; more than once where a hash stands for several texts."""
    keys = ids.join(named.select(F.col("key").alias("id"), "text_key"), "id").select("text_key")
    # of many copies of a text one is read
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").join(keys, "text_key", "left_semi").dropDuplicates(["text_key"]).select("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in found], pa.uint64()).view(pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["id", "found"])

    return texts.mapInArrow(read, "id long, found array<long>")


#: Pairs of one row that are compared together.
TOGETHER = 256


def verified(pairs: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs of keys whose sets are similar enough.

    Pairs are gathered by ``dst``, which comes with its set once for each TOGETHER of its pairs, not once for each pair; a
    row with very many pairs is dealt over as many groups as it needs.
    """
    sizes = pairs.groupBy("dst").agg(F.ceil(F.count("*") / TOGETHER).alias("groups"))
    dealt = cut(pairs.join(sizes, "dst").select("src", "dst", F.pmod(F.xxhash64("src"), F.col("groups")).cast("int").alias("part")))
    ends = dealt.select("dst", "part", F.col("src").alias("id")).unionByName(dealt.select("dst", "part", F.col("dst").alias("id")).distinct())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_cells(batches, ("dst", "part"), 1 << 12):
            dst, part, own = (t[k].to_numpy() for k in ("dst", "part", "id"))
            bounds, lists = runs([dst, part]), t["found"].combine_chunks()
            offsets, hashes = lists.offsets.to_numpy(), lists.values.to_numpy()
            kept = []
            for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                # an id that stands in two rows of docs may be there twice
                x = at + int(np.argmax(own[at:end] == dst[at]))
                a = hashes[offsets[x] : offsets[x + 1]]
                kept += [y for y in range(at, end) if own[y] != dst[at] and _similar(a, hashes[offsets[y] : offsets[y + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array(own[kept]), pa.array(dst[kept])], ["src", "dst"])

    met = ends.join(sets_of(ends.select("id").distinct(), named, docs), "id").repartition("dst", "part").sortWithinPartitions("dst", "part")
    return met.select("dst", "part", "id", "found").mapInArrow(compare, "src long, dst long")


def roots_of_keys(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """key and root (a key of the component) for every distinct set of shingles.

    The first round looks at FIRST blocks only, so a large group's pairs are made a few times, not once for each block; the
    second looks at all blocks, the last inside the blocks that the second left out, both for pairs not linked yet.
    """
    named = cut(rows.groupBy("key").agg(F.min("text_key").alias("text_key"), F.first(F.struct("blocks", "c1", "c2")).alias("x")).select("key", "text_key", "x.*"))

    def labelled(roots: DataFrame | None) -> DataFrame:
        found = named.withColumn("label", F.col("key")) if roots is None else named.join(roots, named["key"] == roots["id"], "left").withColumn("label", F.coalesce("root", "key")).drop("id", "root")
        return found.select(F.explode(F.col("blocks").cast("array<long>")).alias("block"), F.col("key").alias("id"), "c1", "c2", "label", "blocks")

    few = labelled(None).drop("blocks").filter(F.shiftright("block", 16) < FIRST)
    pairs = cut(candidates(few).filter("block IS NULL").select("src", "dst").distinct())
    links = cut(verified(pairs, named, docs))
    roots = components.connected(links)
    again = cut(candidates(labelled(roots).drop("blocks")))
    more = cut(again.filter("block IS NULL").select("src", "dst").distinct().join(pairs, ["src", "dst"], "left_anti"))
    links = links.unionByName(cut(verified(more, named, docs)))
    roots = components.connected(links)
    left_out = again.filter("block IS NOT NULL").select("block").distinct()
    if not left_out.isEmpty():
        dense = cut(labelled(roots).join(left_out, "block", "left_semi"))
        sets = cut(sets_of(dense.select("id").distinct(), named, docs).dropDuplicates(["id"]))
        for k in range(PARTS):
            links = links.unionByName(cut(linked_within(dense.filter(F.shiftright("block", 16) % PARTS == k), sets)))
        roots = components.connected(links)
    return named.join(roots, named["key"] == roots["id"], "left").select("key", F.coalesce("root", "key").alias("root"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component stays."""
    rows = cut(prints(docs))
    return components.kept(docs, components.named(rows.select("doc_id", "text_key", "key"), roots_of_keys(rows, docs), "key"))

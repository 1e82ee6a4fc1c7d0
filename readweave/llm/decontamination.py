"""Benchmark decontamination: token windows of documents against the windows of benchmark items.

The windows of all items form a hash table that is broadcast while it is below ``max_broadcast_windows`` rows
(checked by counting); a larger one is joined by shuffle, to which places and hashes travel without their texts. Words are hashed once; every window of every document is looked
up by a hash of its words' hashes, and each hit is verified by comparing the words themselves.

Defined results: a null text has no words and no hits; an item without words has no window; an item with fewer words
than a window is one window; identical rows get identical results; items with a null id still mark words, but are in
no list of ids; doc_id may be of any type; windows that overlap or repeat count each word once; a text of any length is read
whole; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NOT_WORD_ANY_CASE, WORD_ANY_CASE, ascii_lower, count_words, windows, words

WINDOW = 10
MAX_BROADCAST_WINDOWS = 500_000


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: gram, width and the sorted ids of the items that hold it."""
    ws = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(ascii_lower(F.col("text"))).alias("ws"))
    n = F.size("ws")
    full = windows(F.col("ws"), window)
    short = F.array(F.struct(F.lit(0).alias("pos"), F.array_join("ws", " ").alias("gram")))
    grams = ws.filter(n > 0).select("item_id", F.least(n, F.lit(window)).alias("width"), F.explode(F.when(n < window, short).otherwise(full)).alias("w"))
    return grams.groupBy(F.col("w.gram").alias("gram"), "width").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _covered(spans: Column) -> Column:
    """Number of words inside a sorted array of (pos, width)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["pos"] + s["width"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["pos"]))).alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"]).cast("long")


def _met(seen: DataFrame, table: DataFrame, ws: DataFrame) -> DataFrame:
    """Hits where the windows' table is shuffled: only places and hashes travel to it; what is found goes back to the texts, once
    for each, and is verified on their words."""
    found = seen.join(table, "gram_hash").filter(F.col("width") == F.col("item_width"))
    listed = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("pos", "width", "item_gram", "items")).alias("found"))
    texts = ws.select("doc_id", "text_key", "ws").join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    right = F.filter("found", lambda h: F.array_join(F.slice("ws", h["pos"] + 1, h["width"]), " ") == h["item_gram"])
    once = texts.select("doc_id", "text_key", right.alias("found")).filter(F.size("found") > 0).dropDuplicates(["doc_id", "text_key"])
    spans = F.array_sort(F.array_distinct(F.transform("found", lambda h: F.struct(h["pos"].alias("pos"), h["width"].alias("width")))))
    return once.select("doc_id", "text_key", spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda h: h["items"])))).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row for each distinct (doc_id, text) with hits: doc_id, text_key, sorted word spans and sorted item ids."""
    table = benchmark_windows(benchmark, window)
    sizes = {r["width"]: r["n"] for r in table.groupBy("width").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    hashed = lambda ws: F.transform(ws, lambda w: F.xxhash64(w))
    table = table.select(F.xxhash64(hashed(F.split("gram", " "))).alias("gram_hash"), F.col("gram").alias("item_gram"), F.col("width").alias("item_width"), "items")
    small = sum(sizes.values()) <= max_broadcast_windows
    ws = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(ascii_lower(F.col("text"))).alias("ws")).withColumn("hashes", hashed(F.col("ws")))

    # places are rows before they are hashed, so hashes are compiled code over one array and make no arrays of their own
    places = F.when(F.size("ws") > 0, F.sequence(F.lit(0), F.size("ws") - 1)).otherwise(F.array().cast("array<int>"))
    at = ws.select("doc_id", "text_key", "ws", "hashes", F.explode(places).alias("pos"))
    each = [F.struct(F.lit(w).alias("width"), F.xxhash64(*[F.get("hashes", F.col("pos") + k) for k in range(w)]).alias("gram_hash")) for w in sorted(sizes) or [window]]
    seen = at.select("doc_id", "text_key", "ws", "pos", F.explode(F.array(*each)).alias("w")) if len(each) > 1 else at.withColumn("w", each[0])
    seen = seen.select("doc_id", "text_key", "ws", "pos", "w.*").filter(F.col("pos") + F.col("width") <= F.size("ws"))
    if not small:
        return _met(seen.select("doc_id", "text_key", "pos", "width", "gram_hash"), table, ws)
    # the hash finds, the words themselves decide; as an equality they would be a join key, made for every window
    gram = F.array_join(F.slice("ws", F.col("pos") + 1, F.col("width")), " ")
    same = (F.col("width") == F.col("item_width")) & (gram <= F.col("item_gram")) & (gram >= F.col("item_gram"))
    found = seen.join(F.broadcast(table), "gram_hash").filter(same).select("doc_id", "text_key", F.struct("pos", "width").alias("span"), "items")
    per_doc = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("items"))
    return per_doc.withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, carry: list[Column] | None = None, **options: int) -> DataFrame:
    """Every row of ``docs``: its columns (or those of ``carry``) in a struct ``row``, and a struct ``leak`` of n_words, n_hit, items and spans of words (pos, width)."""
    kept = docs.select(F.struct(*(carry or [docs[f"`{c}`"] for c in docs.columns])).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), count_words(F.col("text")).alias("_n"))
    found = hits(docs, benchmark, **options)
    joined = kept.join(found, kept["_id"].eqNullSafe(found["doc_id"]) & (kept["_key"] == found["text_key"]), "left")
    leak = F.struct(
        F.col("_n").alias("n_words"),
        F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<pos:int,width:int>>")).alias("spans"),
    )
    return joined.select("row", leak.alias("leak"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The rows without any hit, columns as they came."""
    return decontaminate(docs, benchmark, **options).filter("leak.n_hit = 0").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """All rows; the words of hit spans are cut out of their texts, each with what divides it from the next."""
    marked = decontaminate(docs, benchmark, **options)
    text = F.col("row.text")
    before = F.regexp_extract(text, f"^{NOT_WORD_ANY_CASE}+", 0)
    pieces = F.regexp_extract_all(text, F.lit(f"({WORD_ANY_CASE}{NOT_WORD_ANY_CASE}*)"), F.lit(1))
    kept = F.filter(pieces, lambda _, i: ~F.exists("leak.spans", lambda s: (s["pos"] <= i) & (i < s["pos"] + s["width"])))
    cleaned = F.when(F.col("leak.n_hit") > 0, F.concat(before, F.array_join(kept, ""))).otherwise(text)
    return marked.select(*[cleaned.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])

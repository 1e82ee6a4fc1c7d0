"""License scans by diagonal voting.

Every run of ``k`` words of every document is looked up, by its hash and then by the words themselves, among the runs of
the license templates. A hit at word p of the document and word t of the template votes for the diagonal p - t; votes of
a template are counted by diagonal, neighbouring diagonals (a word more or less in between) are merged, and a merged
band is verified word by word: at least ``coverage`` of the template's words must stand in it, and at least as large a
share of the words between its ends must be the template's. Of spans that overlap, the one with the larger share stays
(the longer, then the first by name, where shares tie). Fixed phrases are counted beside them, at every place.

The templates are a parameter; their table is broadcast while it is below ``max_broadcast_grams`` rows (checked).

Defined results: null and empty texts have no words, phrases or spans; identical rows get identical results; templates
of fewer than k words have no runs and never vote; doc_id may be of any type; a text of any length is read whole; extra
columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import NOT_WORD, ascii_lower, count_words, windows, words

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The statements by which licenses are usually named, and their labels.
TEMPLATES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "This work is released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

K = 3
SLACK = 2
COVERAGE = 0.6
MAX_BROADCAST_GRAMS = 500_000


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """template (number), label, n_words, t (index) and gram of every run of k words."""
    df = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    ws = df.select("template", "label", words(ascii_lower(F.col("text"))).alias("ws"))
    each = ws.select("template", "label", F.size("ws").alias("n_words"), F.explode(windows(F.col("ws"), k)).alias("w"))
    return each.select("template", "label", "n_words", F.col("w.pos").alias("t"), F.col("w.gram").alias("own_gram"), F.xxhash64(F.transform(F.split("w.gram", " "), lambda w: F.xxhash64(w))).alias("gram_hash"))


def spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, *, k: int = K, slack: int = SLACK, coverage: float = COVERAGE, max_broadcast_grams: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """doc_id, text_key, label, start, end (words, end exclusive) and share of the template's words, for each distinct (doc_id, text)."""
    grams = template_grams(docs.sparkSession, templates, k)
    if grams.count() <= max_broadcast_grams:
        grams = F.broadcast(grams)
    # places are rows before they are hashed, so hashes are compiled code over one array
    ws = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(ascii_lower(F.col("text"))).alias("ws"))
    ws = ws.withColumn("hashes", F.transform("ws", lambda w: F.xxhash64(w)))
    places = F.when(F.size("ws") >= k, F.sequence(F.lit(0), F.size("ws") - k)).otherwise(F.array().cast("array<int>"))
    seen = ws.select("doc_id", "text_key", "ws", "hashes", F.explode(places).alias("p"))
    seen = seen.select("doc_id", "text_key", "ws", "p", F.xxhash64(*[F.get("hashes", F.col("p") + i) for i in range(k)]).alias("gram_hash"))
    # as an equality the words would be a join key, made for every place
    gram = F.array_join(F.slice("ws", F.col("p") + 1, k), " ")
    votes = seen.join(grams, "gram_hash").filter((gram <= F.col("own_gram")) & (gram >= F.col("own_gram")))
    place = ["doc_id", "text_key", "template", "label", "n_words"]
    diagonals = votes.groupBy(*place, (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"), F.collect_set("p").alias("ps"))
    along = W.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    banded = diagonals.withColumn("band", F.sum(F.when(gap <= slack, 0).otherwise(1)).over(along))
    merged = banded.groupBy(*place, "band").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("ts", "ps")])
    # the words of a run are equal, so the runs' words are what document and template share
    own = {c: F.array_distinct(F.flatten(F.transform(c, lambda x: F.sequence(x, x + k - 1)))) for c in ("ts", "ps")}
    start, end = F.array_min("ps"), F.array_max("ps") + k
    measured = merged.select("doc_id", "text_key", "template", "band", "label", "n_words", start.alias("start"), end.alias("end"), F.size(own["ts"]).alias("held"), F.size(own["ps"]).alias("dense"))
    share = F.col("held") / F.col("n_words")
    good = measured.withColumn("share", share).filter((F.col("share") >= coverage) & (F.col("dense") >= coverage * (F.col("end") - F.col("start"))))
    # a span is beaten where a word of it belongs to a better one; only spans that meet another are looked at word by word
    along = W.partitionBy("doc_id", "text_key").orderBy("start", "end", "template", "band")
    reached = F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1))
    meets = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(F.lead("start").over(along) < F.col("end"), F.lit(False))
    each = good.withColumn("meets", meets).withColumn("rank", F.struct("share", "n_words", (-F.col("template")).alias("nth")))
    at_words = each.withColumn("word", F.explode(F.when(F.col("meets"), F.sequence("start", F.col("end") - 1)).otherwise(F.array("start"))))
    best = at_words.withColumn("best", F.max("rank").over(W.partitionBy("doc_id", "text_key", "word")))
    span = ["doc_id", "text_key", "template", "band", "label", "start", "end", "share"]
    stays = best.groupBy(*span).agg(F.bool_and(F.col("rank") == F.col("best")).alias("stays"))
    return stays.filter("stays").select("doc_id", "text_key", "label", "start", "end", "share")


def phrase_places(ws: Column, phrase: str) -> Column:
    """Indices of the first words of all places of a phrase in an array column of words."""
    own = phrase.split()
    starts = F.when(F.size(ws) >= len(own), F.sequence(F.lit(0), F.size(ws) - len(own))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(ws, i + 1, len(own)) == F.array(*[F.lit(w) for w in own]))


def _with_phrase(text: Column, phrases: dict[str, str]) -> Column:
    """Words of the texts that hold any of the phrases, none for others; a search for letters passes most texts over."""
    lowered = ascii_lower(text)
    joined = F.concat(F.lit(" "), F.regexp_replace(lowered, NOT_WORD, " "), F.lit(" "))
    held = F.regexp_like(joined, F.lit(" (?:" + "|".join(phrases) + ") "))
    return F.when(held, words(lowered)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, carry: list[Column] | None = None, **options: float) -> DataFrame:
    """Every row of ``docs``: its columns (or those of ``carry``; texts that aren't carried aren't shuffled) in a struct
    ``row``, and a struct ``license`` of n_words, places, spans, labels and score."""
    kept = docs.select(
        F.struct(*(carry or [docs[f"`{c}`"] for c in docs.columns])).alias("row"),
        docs["doc_id"].alias("_id"),
        F.xxhash64(docs["text"]).alias("_key"),
        count_words(docs["text"]).alias("_n"),
        _with_phrase(docs["text"], phrases).alias("_ws"),
    )
    places = F.struct(*[phrase_places(F.col("_ws"), p).alias(f"p{i}") for i, p in enumerate(phrases)])
    kept = kept.select("row", "_id", "_key", F.struct(F.col("_n").alias("n_words"), places.alias("at")).alias("base"))
    found = spans(docs, templates, **options).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "share"))).alias("spans"))
    joined = kept.join(found, kept["_id"].eqNullSafe(found["doc_id"]) & (kept["_key"] == found["text_key"]), "left")
    at = [F.col(f"base.at.p{i}") for i in range(len(phrases))]
    own = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string,share:double>>"))
    base_labels = F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(at, phrases.values())]), lambda x: x.isNotNull())
    license_ = F.struct(
        F.col("base.n_words").alias("n_words"),
        F.array_sort(F.concat(*at)).alias("places"),
        F.array_sort(F.array_distinct(base_labels)).alias("base_labels"),
        own.alias("spans"),
        F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(own, lambda s: s["label"])))).alias("labels"),
        F.greatest(F.when(F.size(base_labels) > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform(own, lambda s: s["share"])), F.lit(0.0))).alias("score"),
    )
    return joined.select("row", license_.alias("license"))

"""Collocations against counting by hand."""

import random
import re
from collections import Counter

import pytest

from readweave.llm import collocations
from readweave.llm.queries import QUERIES

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counts(rows, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    return f, n


def by_hand(rows, longest=3, least=10, top=2000, covered=50):
    f, n = counts(rows, longest)
    f = {p: c for p, c in f.items() if c >= least}
    out = []
    for lang in {x[0] for x in f}:
        own = {p: c for (of, p), c in f.items() if of == lang}
        kept = []
        for p, a in own.items():
            if len(p) < 2:
                continue
            longer = [c for q, c in own.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * c >= covered * a for c in longer):
                continue
            score, cut = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:cut]], own[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


def made(seed=1, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Äöü", "ÉTÉ", "a\x1cb", "日本"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            parts.append(rng.choice(words) if rng.random() < 0.7 else "New York City")
            parts.append(rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "!", "\r\n"]))
        rows.append(("".join(parts), ("en", "de", None, "und")[i % 4]))
    return rows + [(None, "en"), ("", None), (" \t\n", "fr"), ("same words here " * 3000, "en"), *[("copy of a text", "en")] * 200]


@pytest.mark.parametrize("longest,least,shards", [(3, 10, 3), (3, 10, 1), (4, 7, 2), (2, 25, 4), (1, 10, 2)])
def test_against_counting(spark, longest, least, shards):
    rows = made()
    docs = spark.createDataFrame([(t, lang, 1) for t, lang in rows], "text string, lang string, words int").repartition(5)
    got = Counter(tuple(r) for r in collocations.mine(docs, longest, least, 2000, 50, shards).collect())
    assert got == by_hand(rows, longest, least)


def test_shared_slots_change_nothing(spark, monkeypatch):
    rows = made(2, 120)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(collocations, "PART", 8)
    monkeypatch.setattr(collocations, "SLOTS", (5, 5))
    assert Counter(tuple(r) for r in collocations.mine(docs).collect()) == by_hand(rows)


def test_the_cut_off_of_a_language(spark):
    rows = made(3, 200)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert Counter(tuple(r) for r in collocations.mine(docs, top=5).collect()) == by_hand(rows, top=5)


def test_phrases_are_activated_after_their_subphrases(spark):
    """Of a rare pair's and a frequent pair's slots only the latter is counted, from the scan after its words."""
    import numpy as np

    text = b" \xff " + b"aa bb \xff " * 12 + b"aa cc \xff "
    reached = np.full(1 << 16, collocations.NEVER, np.uint8)
    p = collocations.Places("en", text, reached)
    at, _ = p.longer(2)
    assert len(at) == 0
    for w in ("aa", "bb"):
        known = p.known.to_pylist().index(w.encode())
        reached[p.hashes[known] & p.mask] = 0 if w == "aa" else 1
    p = collocations.Places("en", text, reached)
    at, since = p.longer(2)
    assert len(at) == 12 and set(since.tolist()) == {2}


def test_query(spark, small, rows):
    got = Counter(tuple(r) for r in QUERIES["op12_collocations"](spark, small).collect())
    assert got == by_hand([(r[1], r[2]) for r in rows])

"""The pipeline's near copies against the similarity of all pairs of texts."""

import random

import corpus_pipeline
import numpy as np
import pytest

from readweave.llm import resemblance, simhash

WORDS = [f"w{i}" for i in range(3000)]


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = rng.choice(WORDS)
    return out


@pytest.fixture(scope="module")
def texts():
    """Near copies with a few edited words, some too far, and a group of more copies than a small cell holds."""
    rng = random.Random(5)
    made = []
    for _ in range(60):
        base = rng.choices(WORDS, k=rng.randrange(60, 300))
        made += [base, edited(rng, base, max(1, len(base) // 80)), edited(rng, base, len(base) // 15)]
    base = rng.choices(WORDS, k=400)
    made += [edited(rng, base, rng.randrange(1, 16)) for _ in range(120)]
    return [" ".join(ws) for ws in made] + [None, "", " ", "one two", "ONE two", "one two three"]


def sets(text):
    ws = (text or "").lower().split()
    return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


@pytest.fixture(scope="module")
def near(texts):
    """Pairs at a similarity of 0.8 or more."""
    of = [sets(t) for t in texts]
    return [(a, b) for a in range(len(of)) for b in range(a) if 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b])]


def test_stage_keeps_one_of_near_copies(spark, texts, near):
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in near:
        top[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id")], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    got = sorted((r["doc_id"] for r in stage(spark, docs, "").collect()), key=lambda i: -1 if i is None else i)
    assert got == [None] + [i for i in range(len(texts)) if find(i) == i]


def test_fingerprints_of_near_copies_share_blocks(texts, near):
    """Of the pairs at 0.8 or more, the share that blocks and checked bits find."""
    words = [resemblance.fingerprint(resemblance.shingles(t)) for t in texts]
    found = 0
    for a, b in near:
        differ = words[a] ^ words[b]
        found += bool((differ[:-2].view(np.uint16) == 0).any()) and np.bitwise_count(differ[-2:]).sum() <= resemblance.CHECKED
    assert len(near) > 1000 and found >= 0.99 * len(near)


def test_rows_not_ids_are_kept(spark):
    """One id with two texts; a component that a null id is in; ids that aren't numbers."""
    a, b, c = (" ".join(WORDS[i : i + 40]) for i in (0, 100, 200))
    rows = [("5", a, 1), ("5", b, 2), ("7", c, 3), (None, c, 4), (None, "only here", 5), (None, "only here", 5), ("9", a, 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, root int")
    got = sorted(r["root"] for r in resemblance.deduplicate(docs).collect())
    assert got == [1, 2, 3, 5]
    assert sorted(r["root"] for r in simhash.deduplicate(docs).collect()) == [1, 2, 3, 5]


@pytest.mark.parametrize("cell", [16, 2048])
def test_dense_blocks_are_linked_within_cells(spark, texts, near, monkeypatch, cell):
    """One block of all texts, cut in several cells or not: links are near, fewer than members of each cell, and connect what pairs connect."""
    monkeypatch.setattr(resemblance, "CELL", cell)
    of = {}
    for i, t in enumerate(texts):
        of.setdefault(frozenset(sets(t)), i)
    ids = sorted(of.values())
    found = {i: resemblance.shingles(texts[i]) for i in ids}
    words = {i: resemblance.fingerprint(found[i]) for i in ids}
    blocks = {i: [k << 16 | int(b) for k, b in enumerate(words[i][:-2].view(np.uint16))] for i in ids}
    c = {i: words[i][-2:].view(np.int64).tolist() for i in ids}
    keyed = spark.createDataFrame([(7, i, *c[i], i, blocks[i]) for i in ids], "block long, id long, c1 long, c2 long, label long, blocks array<int>")
    own = spark.createDataFrame([(i, found[i].view(np.int64).tolist()) for i in ids], "id long, found array<long>")
    links = [(r["src"], r["dst"]) for r in resemblance.linked_within(keyed, own).collect()]
    pairs = {(a, b) for a, b in near if a in found and b in found}
    assert all((a, b) in pairs or (b, a) in pairs for a, b in links)
    assert len(links) < len(ids) if cell > len(ids) else len(links) < len(pairs)

    def roots(edges):
        top = {i: i for i in ids}

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in edges:
            top[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in ids]

    assert roots(links) == roots(pairs)

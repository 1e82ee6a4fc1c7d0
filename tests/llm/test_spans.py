"""Licenses by brute force, personal data by kind, spans cut out, and longest processing time."""

import heapq
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from readweave.llm import decontamination, licenses, personal_data, sharding

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PROSE = "the green house stands near a quiet river where people walk and talk about the weather in spring".split()


def license_spans(text, templates=licenses.TEMPLATES):
    """Diagonal voting over all pairs of places."""
    ws, k, found = WORD.findall((text or "").lower()), licenses.K, []
    for number, (label, template) in enumerate(templates):
        own = WORD.findall(template.lower())
        votes = defaultdict(set)
        for p in range(len(ws) - k + 1):
            for t in range(len(own) - k + 1):
                if ws[p : p + k] == own[t : t + k]:
                    votes[p - t].add((p, t))
        bands, last = [], None
        for d in sorted(votes):
            if last is None or d - last > licenses.SLACK:
                bands.append(set())
            bands[-1] |= votes[d]
            last = d
        for band in bands:
            ps, ts = ({x + i for x in {pair[j] for pair in band} for i in range(k)} for j in (0, 1))
            start, end = min(ps), max(ps) + 1
            if len(ts) >= licenses.COVERAGE * len(own) and len(ps) >= licenses.COVERAGE * (end - start):
                found.append((start, end, len(ts) / len(own), len(own), -number, label))
    better = lambda s, o: o[0] < s[1] and s[0] < o[1] and o[2:5] > s[2:5]
    return [s for s in found if not any(better(s, o) for o in found)]


def test_licenses(spark):
    rng = random.Random(1)
    texts = [None, "", " ".join(PROSE)]
    for label, template in licenses.TEMPLATES:
        ws = template.split()
        for drop in (0, 1, 2, len(ws) // 2):
            kept = [w for i, w in enumerate(ws) if i not in set(rng.sample(range(len(ws)), drop))]
            texts.append(" ".join([*PROSE[: rng.randrange(12)], *kept, "and", *rng.choice(licenses.TEMPLATES)[1].split(), *PROSE]))
    docs = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts)], "doc_id string, text string, license int")
    got = {r["row"]["license"]: r["license"] for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        want = license_spans(t)
        assert sorted((s["start"], s["end"], s["label"]) for s in got[i]["spans"]) == sorted((s[0], s[1], s[5]) for s in want), t
        labels = {s[5] for s in want} | {label for p, label in licenses.PHRASES.items() if f" {p} " in f" {' '.join(WORD.findall((t or '').lower()))} "}
        assert got[i]["labels"] == sorted(labels)
        assert abs(got[i]["score"] - max([s[2] for s in want] + [1.0] * bool(got[i]["base_labels"]), default=0.0)) < 1e-12


def test_licenses_that_overlap_in_any_number(spark):
    """More spans on one place than any fixed number of neighbours, chains of spans, and one better than all."""
    rng = random.Random(4)
    ws = [f"w{i}" for i in range(60)]
    templates = [(f"l{i:02}", " ".join(ws[:20] + [f"x{i}y{j}" for j in range(rng.randrange(1, 12))])) for i in range(30)]
    templates += [("zz", " ".join(ws[:20]))] + [(f"c{i:02}", " ".join(ws[i : i + rng.randrange(6, 20)])) for i in range(18, 50, 3)]
    texts = [" ".join(ws), " ".join(ws[:20]), " ".join(ws[:18] + PROSE + ws[5:40]), "", None, " ".join(ws[25:]), " ".join(ws[:19] * 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["row"]["doc_id"]: r["license"]["spans"] for r in licenses.scan(docs, templates=tuple(templates)).collect()}
    for i, t in enumerate(texts):
        want = license_spans(t, templates)
        assert sorted((s["start"], s["end"], s["label"]) for s in got[i]) == sorted((s[0], s[1], s[5]) for s in want), i
    assert ["zz"] == [s["label"] for s in got[1]]


def test_places_of_many_matches(spark):
    """Places of all matches as a plain search finds them, and whether a span meets any of a line of them."""
    rng = random.Random(12)
    texts = ["", "a", "1", "11a", *("".join(rng.choice("ab1 é𝄞") for _ in range(n)) for n in (5, 17, 64, 65, 3000)), "1 " * 40_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", personal_data.located(F.col("text"), "1+").alias("found"))
    for r in df.collect():
        assert [(s["start"], s["end"], s["found"]) for s in r["found"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("1+", texts[r["id"]])]
    span = lambda s, n: F.struct(F.lit(s).alias("start"), F.lit(s + n).alias("end"))
    for line in ([], [(3, 2)], [(0, 1), (1, 4), (9, 1), (20, 7)]):
        spans = F.array(*[span(*x) for x in line]) if line else F.array().cast("array<struct<start:int,end:int>>")
        asked = [(s, n) for s in range(30) for n in (1, 3)]
        got = spark.range(1).select(F.array(*[personal_data.meets(spans, F.struct(F.lit(s).alias("start"), F.lit(s + n).alias("end"))) for s, n in asked])).first()[0]
        assert got == [any(a < s + n and s < a + m for a, m in line) for s, n in asked]


def hexes(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def test_personal_data_by_kind(spark):
    """Planted spans of every kind are found where they stand; prose has none."""
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = {
        "email": lambda: f"{rng.choice(PROSE)}.{rng.choice(PROSE)}{digits(2)}@mail{digits(1)}.example.com",
        "ip": lambda: ".".join(str(rng.randrange(1, 224)) for _ in range(4)),
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        "email_masked": lambda: f"{rng.choice(personal_data.NAMES)} [at] {rng.choice(PROSE)}host [dot] com",
        "phone_local": lambda: f"(2{digits(2)}) {digits(3)}-{digits(4)}",
        "account": lambda: f"9{digits(15)}",
        "secret": lambda: f"a1{hexes(rng, 38)}",
        "name": lambda: f"Dr. {rng.choice(personal_data.NAMES).title()} Winters",
    }
    announce = {"email": "mail", "ip": "host", "phone": "call", "email_masked": "write", "phone_local": "phone", "account": "account", "secret": "token =", "name": "contact"}
    rows, where = [], {}
    for i in range(480):
        kind = list(made)[i % 10] if i % 10 < 8 else None
        before = rng.choices(PROSE, k=rng.randrange(3, 30)) + ([announce[kind]] if kind and rng.random() < 0.6 else [])
        if kind:
            span = made[kind]()
            at = len(" ".join(before)) + 1
            where[i] = kind, at, at + len(span)
            before.append(span)
        rows.append((i, " ".join([*before, *rng.choices(PROSE, k=10)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["row"]["doc_id"]: {(s["start"], s["end"]): s["kind"] for s in r["spans"]} for r in personal_data.find(docs).collect()}
    recall = defaultdict(list)
    for i, (kind, start, end) in where.items():
        recall[kind].append((start, end) in got[i])
    print({k: sum(v) / len(v) for k, v in recall.items()})
    assert all(sum(v) >= 0.9 * len(v) for v in recall.values())
    assert not any(got[i] for i, _ in rows if i not in where)


def test_spans_are_cut_out(spark):
    item = "One two, three four five six seven eight nine ten"
    docs = spark.createDataFrame([("a", f" Before:  {item.upper()}!! after \n end", 1), ("b", "nothing here", 2), ("c", None, 3)], "doc_id string, text string, pos int")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    got = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, bench).collect()}
    assert got == {"a": " Before:  after \n end", "b": "nothing here", "c": None}
    assert [r["doc_id"] for r in decontamination.remove_documents(docs, bench).orderBy("doc_id").collect()] == ["b", "c"]


def test_longest_processing_time(spark):
    """Groups that each weigh enough are scheduled one by one, as by the plain rule."""
    rng = random.Random(8)
    texts = ["x" * rng.randrange(0, 4000) + str(i) for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(rng.choice([1, 1, 1, 7]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, shards=8, grain=1 << 20).groupBy("shard").agg(F.sum("size").alias("load")).collect()
    load = Counter()
    for _, t in rows:
        load[t] += len(t) + 1
    heap = [(0, s) for s in range(8)]
    for n in sorted(load.values(), reverse=True):
        least, s = heapq.heappop(heap)
        heapq.heappush(heap, (least + n, s))
    assert sorted(r["load"] for r in got) == sorted(n for n, _ in heap)


def test_shuffled_windows_give_the_same(spark):
    """The path of large benchmarks: equal results, and texts don't travel to the windows."""
    rng = random.Random(9)
    vocabulary = "the of house walks under green rivers".split()
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 7, 10, 14, 30, 0)]
    docs = [(i, " ".join(rng.choice([rng.choice(vocabulary)] * 6 + [rng.choice(items)]) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    docs += [(None, items[4]), (None, items[4]), (3, docs[3][1]), (99, None), (98, items[3].upper() + "!")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    b = spark.createDataFrame([(i if i else None, t) for i, t in enumerate([*items, None])], "item_id int, text string")
    got = [sorted(map(str, decontamination.decontaminate(d, b, max_broadcast_windows=n).collect())) for n in (500_000, 0)]
    assert got[0] == got[1] and sum("n_hit=0" not in x for x in got[0]) > 10
    plan = decontamination.hits(d, b, max_broadcast_windows=0)._jdf.queryExecution().optimizedPlan().toString()
    # below the join on hashes each side has ids, places and hashes only
    side = next(line for line in plan.splitlines() if "Project [doc_id" in line and "gram_hash" in line)
    assert "ws#" not in side.split("xxhash64")[0]

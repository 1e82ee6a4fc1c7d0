import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SOURCES = ["web", "Code", "books", None]
#: Names that the operators use for columns of their own.
CLASHING = ("size", "shard", "slot", "row", "group", "leak", "license", "fp", "score", "spans", "n_words", "component_id", "target", "taken", "source_size")
BENCHMARK = [
    (1, "which river flows through the capital of the northern province before it meets the sea at last"),
    (2, "name three metals"),
    (3, None),
    (4, ""),
    (5, "name three metals"),
]


def documents() -> list[tuple]:
    """(doc_id, text, lang, source): edge cases, copies, planted passages and made-up prose with a hot source."""
    rng = random.Random(3)
    vocabulary = {"en": "the of house walks under green rivers while they speak and wait there".split(), "de": "der und Häuser gehen über grüne Flüsse während sie dort sprechen".split()}

    def prose(lang: str, n: int) -> str:
        return " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))

    rows = []
    for i in range(150):
        lang = "en" if i % 3 else "de"
        rows.append((i, prose(lang, rng.randrange(1, 120)), lang, SOURCES[0] if i % 3 else rng.choice(SOURCES)))
    near = prose("en", 400)
    edge = [
        None, "", " \t\n\x0b\f\r ", "one", "One TWO  three\tfour", " nbsp wide", "ÄÖ ß İ Σ", "x" * 5000, prose("en", 30_000),
        near, near, near + " tail", near.upper(),
        "See: " + BENCHMARK[0][1].upper() + "; and more words", "Please name  three... METALS now", "name three",
        "CC BY and the General Public License. All rights reserved, cc by",
        "Write to ann.lee@mail.example.org or +49 (30) 1234-5678; host 10.0.0.255, not 300.1.1.1; card 4111 1111 1111 1111, not 4111 1111 1111 1112",
    ]
    rows += [(1000 + i, text, None if i % 2 else "en", SOURCES[i % 4]) for i, text in enumerate(edge)]
    rows += [(1001, "", "en", "web"), (5, rows[5][1], "en", "web"), (None, "no id here", None, None), (None, None, None, None)]
    return rows


def write(path, rows: list[tuple]) -> str:
    path.mkdir(parents=True, exist_ok=True)
    ids, texts, langs, sources = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
    extra = {name: pa.array([7] * len(rows), pa.int32()) for name in CLASHING}
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), **extra}), path / "documents.parquet")
    bench = BENCHMARK if rows else []
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in bench], pa.int64()), "text": pa.array([b[1] for b in bench], pa.string())}), path / "benchmark.parquet")
    labels = [(i, 1, i % 5 == 0) for i in ids if i is not None and i < 120] + ([(None, None, None), (3, 0, None)] if rows else [])
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([None if x[2] is None else int(x[2]) for x in labels], pa.int32())}), path / "labels.parquet")
    return str(path)


@pytest.fixture(scope="session")
def benchmark_items():
    return BENCHMARK


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def small(tmp_path_factory, rows):
    return write(tmp_path_factory.mktemp("small") / "t", rows)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    path = tmp_path_factory.mktemp("empty") / "t"
    write(path, [])
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "label": pa.array([], pa.int32())}), path / "embeddings.parquet")
    return str(path)

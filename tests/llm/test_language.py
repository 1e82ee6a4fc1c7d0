"""The recurrent network: gradients by differences, context across words, windows, and held-out accuracy on the shared tables."""

import zlib

import numpy as np

from readweave.llm import language


def small_net(rng, labels=3, h=4):
    return language.Network([f"l{i}" for i in range(labels)], [rng.normal(0, 0.5, (3 * h, 256)).astype(np.float32) for _ in range(2)], [rng.normal(0, 0.5, (3 * h, h)).astype(np.float32) for _ in range(2)], rng.normal(0, 0.5, (labels, 2 * h + 1)).astype(np.float32))


def test_neighbouring_words_change_a_label():
    net = small_net(np.random.default_rng(0))
    p = [language.probabilities(net, language.coded([t], 11), np.ones((11, 1), np.float32))[4:7, :, 0] for t in (b"abc def ghi", b"xyz def ghi", b"abc def xyz")]
    assert np.abs(p[0] - p[1]).max() > 1e-4 and np.abs(p[0] - p[2]).max() > 1e-4


def test_every_position_is_labelled_once_and_windows_agree_with_the_whole():
    net, rng = small_net(np.random.default_rng(1)), np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 1500, dtype=np.uint8))
    assert sum(hi - lo for _, lo, hi in language.windows(text)) == len(text)
    whole = np.log(language.probabilities(net, language.coded([text], len(text)), np.ones((len(text), 1), np.float32))[:, :, 0]).sum(axis=0)
    whole = np.exp(whole / len(text))
    got = language.document_probabilities(net, iter([text, b""]), 2)
    assert np.abs(got[0] - whole / whole.sum()).max() < 1e-3
    assert np.allclose(got[1], 1 / 3)


def test_two_scripts_without_blanks():
    rng = np.random.default_rng(3)
    made = {"a": "あいうえおかきく", "b": "アイウエオカキク"}
    texts = [("".join(rng.choice(list(made[k]), 60)), k) for k in "ab" for _ in range(60)]
    ws = [t.encode()[: language.STEPS] for t, _ in texts]
    net = language.learn(language.coded(ws, language.STEPS), np.ones((language.STEPS, len(ws)), bool), np.array([int(k == "b") for _, k in texts]), ["a", "b"], rounds=60)
    new = [("".join(rng.choice(list(made[k]), 300)), k) for k in "ab" for _ in range(20)]
    found = language.document_probabilities(net, (t.encode() for t, _ in new), len(new)).argmax(axis=1)
    assert [net.labels[i] for i in found] == [k for _, k in new]


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    own = [r["lang_pred"] == r["lang"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    print(f"right {sum(own)} of {len(own)}")
    assert sum(own) > 0.98 * len(own)


def test_gradients_by_differences():
    """Backpropagation through time against small changes of every array, over masked windows of several lengths."""
    rng = np.random.default_rng(4)
    h, labels, steps, n = 3, 4, 7, 5
    p = [rng.normal(0, 0.5, (3 * h, 256)) for _ in range(2)] + [rng.normal(0, 0.5, (3 * h, h)) for _ in range(2)] + [rng.normal(0, 0.5, (labels, 2 * h + 1))]
    c = rng.integers(97, 103, (steps, n)).astype(np.uint8)
    mask = (np.arange(steps)[:, None] < np.array([7, 4, 1, 6, 7])).astype(float)
    y = rng.integers(0, labels, n)
    _, g = language.gradients(p, c, mask, y)
    for i, x in enumerate(p):
        tried = [(a, b) for a in range(x.shape[0]) for b in (range(97, 103) if x.shape[1] == 256 else range(x.shape[1]))]
        for a, b in tried:
            was, ends = x[a, b], []
            for d in (1e-5, -1e-5):
                x[a, b] = was + d
                ends.append(language.gradients(p, c, mask, y)[0])
            x[a, b] = was
            assert abs((ends[0] - ends[1]) / 2e-5 - g[i][a, b]) < 1e-6, (i, a, b)


def test_training_rows_are_bounded(spark, monkeypatch):
    """One id thirty thousand times: no more than max_rows documents are learnt from."""
    docs = spark.range(30_100).selectExpr("CASE WHEN id < 30000 THEN 5 ELSE id END AS doc_id", "concat('some text ', id % 7) AS text", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS lang")
    seen = []
    monkeypatch.setattr(language, "learn", lambda codes, mask, y, labels: seen.append((codes.shape[1], labels)))
    language.train(docs, max_rows=100)
    assert 0 < seen[0][0] <= 100 * language.WINDOWS and seen[0][1] == ["a", "b"]
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    language.train(docs, max_rows=100)
    assert len(seen[1][1]) == 1

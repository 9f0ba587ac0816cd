"""The classifier's held-out accuracy and edges."""

import zlib

import duckdb
import numpy as np

from lexibond.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy():
    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)").fetchall()
    words = toxicity.Words()
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    model = toxicity.train([words.codes(r[1].encode()) for r in learn], np.array([r[2] for r in learn]))
    tables = model.tables()
    score = np.array([model.score(words.codes(r[1].encode()), tables) for r in test])
    truth = np.array([r[2] for r in test])
    assert ((score >= 0.5) == truth).mean() >= 0.95
    assert score[truth == 1].mean() > 0.7 and score[truth == 0].mean() < 0.1


def test_gradient():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 6, 9).astype(np.int64) for _ in range(20)]
    model = toxicity.train(texts, np.array([0, 1] * 10))
    model.embed = rng.normal(0, 1, model.embed.shape)
    model.filters = [f.astype(float) for f in model.filters]
    model.bias, model.out = model.bias.astype(float) + 0.5, model.out.astype(float)
    rows = model.rows(texts[0])
    params = [model.embed, *model.filters, model.bias, model.out]
    grads = [np.zeros(p.shape) for p in params]
    toxicity._backward(model, model.tables(), rows, 1, grads, 1)

    def loss():
        z = model.pooled(rows, model.tables()).astype(float) @ model.out[:-1] + model.out[-1]
        return np.log1p(np.exp(-z))

    for p, g in zip(params, grads, strict=True):
        k = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        before = p[k]
        p[k] = before + 1e-3
        up = loss()
        p[k] = before - 1e-3
        down = loss()
        p[k] = before
        assert abs((up - down) / 2e-3 - g[k]) < 0.02 * max(1, abs(g[k]))


def test_long_texts_are_read_whole():
    codes = np.zeros(3 * toxicity.CHUNK + 17, np.int64)
    model = toxicity.train([np.arange(5), np.arange(5, 10)] * 10, np.array([0, 1] * 10))
    tables = [[np.zeros((3, toxicity.FILTERS), np.float32) for _ in range(w)] for w in toxicity.WIDTHS]
    for k, w in enumerate(toxicity.WIDTHS):
        tables[k][w - 1][2] = 5
    for at in (0, toxicity.CHUNK - 1, toxicity.CHUNK, len(codes) - 1):
        rows = codes.copy()
        rows[at] = 2
        pooled = model.pooled(rows, tables).reshape(len(toxicity.WIDTHS), -1)
        assert (pooled[0] > model.pooled(codes, tables).reshape(len(toxicity.WIDTHS), -1)[0]).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "x"), (2, None, None, "x"), (2, "", "en", "x"), (None, "idiot", "en", "x"), (3, "z " * 50_000, "en", "x")], "doc_id bigint, text string, lang string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 0), (None, 1)], "doc_id bigint, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.toxicity(docs, known).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    held = {r["doc_id"]: r["held_out"] for r in got}
    assert held[1] == (zlib.crc32(b"1") % 5 == 0) and held[None] is False
    assert toxicity.clean(docs, toxicity.fit(docs, labels)).columns == docs.columns


def test_sample_has_one_text_a_key(spark, monkeypatch):
    """A labelled key that most rows share sends the driver one text."""
    sent = []
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: sent.append(len(texts)) or real(texts, labels))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "a"), (3, "b"), (None, "c")], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3)], "doc_id bigint, toxic int")
    toxicity.fit(docs, labels)
    assert sent == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2, 3))]

import zlib

import numpy as np

from graphloom.llm import langid

DATA = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    m = langid.ByteGru(["a", "b"], hidden=3)
    for w in m.ways:
        w.table, w.gates, w.own = (x.astype(float) for x in (w.table, w.gates, w.own))
    m.out, m.bias = m.out.astype(float), m.bias.astype(float)
    rng = np.random.default_rng(0)
    x, valid, truth = rng.integers(0, 256, (7, 5)), np.ones((7, 5), bool), np.array([0, 1, 0, 1, 1])
    valid[5:, 2] = False
    for w, g in zip(m.weights(), m.gradients(x, valid, truth)[1], strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[i]
        w[i] = old + 1e-4
        up = m.gradients(x, valid, truth)[0]
        w[i] = old - 1e-4
        down = m.gradients(x, valid, truth)[0]
        w[i] = old
        assert abs(g[i] - (up - down) / 2e-4) < 1e-5


def test_reading_is_training_without_the_way_back():
    m = langid.ByteGru(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (4, 9))
    forth, back = m.ways[0].forward(x.T)[0], m.ways[1].forward(x.T[::-1])[0][::-1]
    s = np.concatenate([forth, back], axis=2) @ m.out + m.bias
    p = np.exp(s) / np.exp(s).sum(axis=2, keepdims=True)
    assert np.allclose(m.position_probabilities(x), p.transpose(1, 0, 2), atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text", "lang")).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth)
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out == (d in set(held)) for d in truth)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", "z"), (2, None, "en", "z"), (3, "", None, "z"), (4, "123 !!", "fr", "z"), (5, "le chat et le chien", "fr", None), (5, "le chat et le chien", "fr", None), (None, "the the", "en", "z"), (7, "a" * 100_000, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(df)
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {2, 3, 4}
    assert langid.identified(df, least=0.0).count() == 5
    empty = df.limit(0)
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}


def test_many_languages_and_clashing_names(spark):
    rows = [(i, f"wort{i % 40} " * 8, f"l{i % 40:02d}", i) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, share int")
    labels, grid, lengths, truth = langid.training_rows(df, per_language=2, per_document=1)
    assert len(labels) <= 40 and len(grid) == len(truth) and lengths.max() <= langid.STRETCH
    assert langid.predict(df.select("doc_id", "text", "share"), None).columns == ["doc_id", "share", "lang_pred", "score"]

"""The byte networks: gradients, held-out accuracy, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from spanguard.llm import quality
from spanguard.llm.bytecnn import ByteConv, Shape, log_softmax, spread_windows, windows_of
from spanguard.llm.language_id import language_of_documents, predict_language, sampled, train_language
from spanguard.llm.quality import quality_of_documents

SCHEMA = "doc_id long, text string, lang string, score string, label int"


def test_windows_cover_every_byte():
    shape = Shape(window=16, widths=(2, 5), filters=3)
    texts = [b"", b"x", bytes(range(16)), bytes(range(17)), bytes(range(256)) * 3]
    windows, counts, lengths = windows_of(texts, shape)
    assert counts.tolist() == [1, 1, 1, 2, 64] and len(windows) == len(lengths) == 69
    at = 0
    for text, n in zip(texts, counts):
        grams = {tuple(w[i : i + 5]) for w in windows[at : at + n].tolist() for i in range(12)}
        assert {tuple(text[i : i + 5]) for i in range(len(text) - 4)} <= grams
        at += n
    assert spread_windows(b"abc", 3, shape) == [b"abc"]
    assert len(spread_windows(bytes(1000), 3, shape)) == 3


def test_gradients():
    net = ByteConv(3, Shape(window=12, widths=(2, 3), filters=2), seed=4)
    for w in net.weights:
        w[...] = w.astype(np.float32)
    net.tables = net.tables.astype(np.float64)
    net.bias, net.dense, net.offset = (x.astype(np.float64) for x in (net.bias + 0.1, net.dense, net.offset))
    r = np.random.default_rng(1)
    windows, target = r.integers(0, 5, (4, 12)).astype(np.uint16), np.array([0, 1, 2, 1])

    def loss():
        return -log_softmax(net.logits(windows))[np.arange(4), target].mean()

    found = net.gradients(windows, target, np.ones(4))
    for weights, gradient in zip(net.weights, found):
        flat, step = weights.reshape(-1), 1e-6
        for i in r.integers(0, min(flat.size, 60), 10):
            old = flat[i]
            flat[i] = old + step
            high = loss()
            flat[i] = old - step
            low = loss()
            flat[i] = old
            assert abs((high - low) / (2 * step) - gradient.reshape(-1)[i]) < 1e-4


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = language_of_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 200 and right / n > 0.97
    scored = quality_of_documents(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = (scored.score[scored.quality == q].to_numpy() for q in (1, 0))
    above = (good[:, None] > bad[None, :]).mean()
    assert len(bad) > 5 and above > 0.85
    assert ((scored.score >= 0) & (scored.score <= 1)).all()
    assert (scored.predicted == (scored.score >= 0.3)).all()


def test_edges(spark):
    rows = [(i, t, lang, "s", 3) for i, (t, lang) in enumerate([("aa bb " * 30, "x"), ("öö üü " * 30, "y")] * 12)]
    rows += [(None, None, None, "", 0), (50, "", "x", "", 0), (51, "123 !?", None, "", 0), (52, "öö üü " * 9000, None, "", 0)]
    rows += [(53, "aa bb", None, "", 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    model = train_language(docs)
    got = predict_language(docs, model).select("doc_id", "lang_pred", "score").collect()
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert (by_id[None], by_id[50], by_id[51], by_id[52], by_id[53], by_id[0]) == ("und", "und", "und", "y", "x", "x")
    assert predict_language(docs.limit(0), model).count() == 0
    nothing = train_language(docs.limit(0))
    assert {r.lang_pred for r in predict_language(docs, nothing).collect()} == {"und"}
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    scores = quality_of_documents(docs, labels).collect()
    assert len(scores) == len(rows) and {r.score for r in scores} == {1.0}
    assert quality_of_documents(docs.limit(0), labels).count() == 0


def test_quality_is_fitted_on_whole_texts(spark, monkeypatch):
    from spanguard.llm import quality

    rows = [(i, ("good words here " if i % 2 else "bad 00 !! ") * (10 + 40 * (i % 7)), i % 2) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    seen, fit = [], quality.logistic
    monkeypatch.setattr(quality, "logistic", lambda x, y, share: seen.append((x, y)) or fit(x, y, share))
    model = quality.train_quality(docs.select("doc_id", "text"), docs.select("doc_id", "quality"), epochs=1)
    ((x, y),) = seen
    held = sorted((t.encode(), q) for i, t, q in rows if quality.hash_bit(i))
    want = quality.features(model.net, [t for t, _ in held])
    assert sorted(map(tuple, x.round(6))) == sorted(map(tuple, want.round(6)))
    assert sorted(zip(x[:, 3].round(6), y)) == sorted(zip(want[:, 3].round(6), [q for _, q in held]))
    assert x[:, 3].max() > np.log1p(quality.CHUNKS * quality.SHAPE.window) / 10


def test_every_language_is_learned(spark, monkeypatch):
    from spanguard.llm import language_id

    rows = [(i, f"{chr(0x4E00 + i % 70) * 9} {i}", f"l{i % 70:02}", "", 0) for i in range(70 * 40)] + [(9999, "rare " * 20, "rare", "", 0)]
    seen, collect = [], language_id.collect_windows
    monkeypatch.setattr(language_id, "TOTAL", 71 * 20)
    monkeypatch.setattr(language_id, "collect_windows", lambda *a: seen.append(collect(*a)) or seen[-1])
    model = train_language(spark.createDataFrame(rows, SCHEMA), epochs=1)
    assert model.languages == sorted({r[2] for r in rows}) and len(model.languages) == 71
    ((_, labels),) = seen
    assert set(labels) == set(model.languages) and len(labels) < 1.3 * 71 * 20


def test_split_and_sample_of_ids(spark):
    names = [f"doc-{i:05d}" for i in range(2000)]
    assert 400 < sum(map(quality.hash_bit, names)) < 600
    ids = spark.range(2_000_000)
    drawn = {s: ids.filter(sampled(F.col("id"), F.lit(s))).count() for s in (1.0, 0.25, 1e-9)}
    assert drawn[1.0] == 2_000_000 and 495_000 < drawn[0.25] < 505_000 and drawn[1e-9] == 0

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from versespan.llm import langid, quality_cnn
from versespan.llm import queries
from versespan.llm.common import as_bytes, held_out, text_blocks

ODD = [None, "", " ", "123 !?", "é", "日本", "a", "z" * 300_000]


def test_blocks_cover_all_texts():
    column = pa.array(["ab", None, "", "é" * 10, "x"])
    blocks = list(text_blocks(column, limit=8))
    assert [t for b in blocks for t in b.to_pylist()] == ["ab", "", "", "é" * 10, "x"]
    data, starts = as_bytes(blocks[-1])
    assert data.tobytes()[starts[-2]:] == b"x"


def test_held_out_rule(spark):
    import zlib

    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_language_on_held_out_documents(spark, sf_dir):
    found = queries.QUERIES["op10_language"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    both = found.join(docs, "doc_id").filter("held_out")
    assert both.filter("lang = lang_pred").count() >= 0.97 * both.count()
    assert found.count() == docs.count()
    assert found.filter("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_language_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 60)
    model = langid.train(["the cat and the dog", "der hund und die katze"] * 20, ["en", "de"] * 20)
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, text string")
    rows = {r["i"]: r["f"] for r in df.select("i", langid.language(
        model, F.col("text")).alias("f")).collect()}
    assert [rows[i]["lang_pred"] == "und" for i in range(8)] == [True] * 4 + [False] * 4
    assert all(rows[i]["score"] == 0 and rows[i]["rejected"] for i in range(4))
    names, _ = langid.identify(model, ["the dog and the cat", "die katze und der hund"])
    assert names == ["en", "de"]
    # a text gets the same result alone and among others, in one chunk and in several
    texts = ["the dog", "x" * 50, "und die katze " * 30]
    whole = langid.identify(model, texts)[1]
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert np.allclose([langid.identify(model, [t])[1][0] for t in texts], whole)
    nothing = langid.train([], [])
    assert langid.identify(nothing, ["text"])[0] == ["und"]


def test_language_fit_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(empty).languages == ()


def test_quality_on_held_out_documents(spark):
    found = queries.QUERIES["op4_quality_cnn"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = found.join(labels, "doc_id").filter("held_out").toPandas()
    assert ((both.predicted == both.quality).mean()) >= 0.93
    assert both[both.quality == 1].predicted.mean() >= 0.95
    assert found.filter("score is null or score < 0 or score > 1").count() == 0


def test_quality_pooling_equals_brute_force():
    rng = np.random.default_rng(0)
    model = quality_cnn.untrained()._replace(
        filters=rng.normal(size=(quality_cnn.WIDTH, 256, quality_cnn.FILTERS)),
        hidden=rng.normal(size=(quality_cnn.FILTERS, quality_cnn.HIDDEN)),
        out=rng.normal(size=2 * quality_cnn.HIDDEN))
    texts = ["", "a", "b" * 128, "c" * 129, "word " * 200]
    block = next(text_blocks(pa.array(texts)))
    got = quality_cnn.raw_logits(model, *as_bytes(block))
    s, w = quality_cnn.SEGMENT, quality_cnn.WIDTH
    for text, logit in zip(texts, got, strict=True):
        data = text.encode()
        n = max(-(-len(data) // s), 1)
        data = np.frombuffer(data.ljust(n * s + w, b"\0"), np.uint8)
        pooled = [np.max([sum(model.filters[j][data[p + j]] for j in range(w))
                          for p in range(k * s, k * s + s, quality_cnn.STRIDE)], axis=0)
                  for k in range(n)]
        chunks = [np.maximum(a, b) for a, b in zip(pooled, pooled[1:])] or pooled
        hidden = np.maximum(np.maximum(chunks, 0) @ model.hidden, 0)
        assert np.isclose(logit, np.concatenate([hidden.max(0), hidden.mean(0)]) @ model.out)


def test_quality_gradients_equal_differences():
    rng = np.random.default_rng(1)
    params = [rng.normal(0, .3, (quality_cnn.WIDTH, 256, quality_cnn.FILTERS)),
              rng.normal(0, .1, quality_cnn.FILTERS),
              rng.normal(0, .3, (quality_cnn.FILTERS, quality_cnn.HIDDEN)),
              rng.normal(0, .1, quality_cnn.HIDDEN), rng.normal(0, .3, 2 * quality_cnn.HIDDEN),
              np.asarray(0.1)]
    data, starts = quality_cnn._block([b"some words here " * 20, b"x"])
    truth = np.array([1.0, 0.0])

    def loss(values):
        logit = quality_cnn.raw_logits(quality_cnn.QualityModel(*values, 1.0, 0.0), data, starts)
        p = 1 / (1 + np.exp(-logit))
        return -np.log(np.where(truth == 1, p, 1 - p)).mean()

    grads = quality_cnn._gradients(quality_cnn.QualityModel(*params, 1.0, 0.0), data, starts,
                                   truth, np.ones(2))
    for which, place in ((0, (0, ord("s"), 3)), (1, (2,)), (2, (1, 4)), (3, (5,)), (4, (20,))):
        moved = [p.copy() for p in params]
        moved[which][place] += 1e-5
        assert np.isclose((loss(moved) - loss(params)) / 1e-5, grads[which][place], atol=1e-4)


def test_quality_of_odd_texts_and_no_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 7)], "doc_id long, quality int")
    model = quality_cnn.fit(docs, labels)
    scores = [r[0] for r in docs.select(quality_cnn.quality(model, F.col("text"))).collect()]
    assert scores == [0.5] * len(ODD)
    assert quality_cnn.keep_good(docs.limit(0), model).count() == 0

import numpy as np
import pytest
from pyspark.sql import functions as F

from exemplar.functions.embedders import BatchedEmbedder, HashedEmbedder, embed_window, truncated
from exemplar.plans import standins

TEXTS = [None, "", "one", "b a c", "Ünïcode wörd " * 40, "x " * 700, "same", "same", "the quick brown fox"]


def _df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(2)


def test_vectors_do_not_depend_on_the_batch(spark):
    got = {}
    for batch, window in ((1, 1024), (8, 3), (32, 1024)):
        emb = BatchedEmbedder(standins.load_md5_model(16), 16, "m", max_tokens=30, batch=batch, window=window)
        got[batch] = {r.i: list(r.e) for r in emb.transform(_df(spark), "t", "e").collect()}
    assert got[1] == got[8] == got[32]
    # cut at 30 tokens, in the order of the rows; the built-in embedder agrees on the cut text
    cut = spark.createDataFrame([(i, truncated(t, 30)[0]) for i, t in enumerate(TEXTS)], "i int, t string")
    want = {r.i: list(r.e) for r in HashedEmbedder(16, hash_fn="md5").transform(cut, "t", "e").collect()}
    assert got[8] == want
    assert got[8][0] == [0.0] * 16


def test_model_is_loaded_once_and_sees_texts_of_one_length(spark):
    seen = []

    def model(texts):
        seen.append([len(t.split()) for t in texts])
        return np.ones((len(texts), 2))

    texts = [" ".join(["w"] * (1 + i % 4)) for i in range(40)]
    embed_window(model, texts, 2, 100, 10)
    assert [set(s) for s in seen] == [{1}, {2}, {3}, {4}]
    with pytest.raises(ValueError):
        embed_window(lambda ts: np.ones((len(ts), 3)), texts, 2, 100, 10)
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda ts: np.ones((len(ts), 2))

    emb = BatchedEmbedder(load, 2, "counted", batch=4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        assert emb.transform(spark.range(200).repartition(8).select(F.col("id").cast("string").alias("t")), "t").count() == 200
        out = emb.transform(spark.range(200).repartition(8).select(F.col("id").cast("string").alias("t")), "t").agg(F.sum(F.size("embedding"))).first()[0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert out == 400 and 0 < loads.value <= 8  # not once a batch


def test_truncation():
    assert truncated("a b c d", 2) == ("a b", 2) and truncated("a b", 5) == ("a b", 2) and truncated(None, 3) == ("", 0)
    with pytest.raises(ValueError):
        BatchedEmbedder(lambda: None, 2, "x", batch=0)


def test_hashed_vectors_are_unit(spark):
    rows = HashedEmbedder(8).transform(_df(spark), "t", "e").collect()
    for r in rows:
        n = float(np.linalg.norm(np.array(r.e, np.float64)))
        assert len(r.e) == 8 and (n == 0.0 if not r.t else abs(n - 1) < 1e-6)

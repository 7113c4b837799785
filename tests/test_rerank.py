import pytest
from pyspark.sql import functions as F

from exemplar.functions.similarity import ratio
from exemplar.operators.rerank import normalize_weights, rerank


def test_weights_normalised():
    w = normalize_weights({"embedding": 3, "method_name": 1, "signature": 1})
    assert w == pytest.approx({"embedding": 0.6, "method_name": 0.2, "signature": 0.2})
    assert sum(normalize_weights(None).values()) == pytest.approx(1.0)
    with pytest.raises(KeyError):
        normalize_weights({"embedding": 1.0})


def test_rerank_brute_force(spark):
    pool = [
        (1, 1, 10, 0.9, "get_user", 2),
        (1, 2, 11, 0.8, "getuser", 1),
        (1, 3, 12, 0.7, "set_user", 2),
        (1, 4, 13, 0.2, None, None),
        (2, 1, 10, 0.5, "get_user", 2),
    ]
    qf = [(1, "get_user", 2), (2, "x", 0)]
    p = spark.createDataFrame(pool, "query_id long, rank int, example_id long, score double, method_name string, param_count int")
    q = spark.createDataFrame(qf, "query_id long, q_method_name string, q_param_count int")
    got = rerank(p, q, k=3, threshold=0.3).orderBy("query_id", "rank").collect()

    def psim(a, b):
        if a is None or b is None:
            return 0.0
        return 1.0 if a == b else max(0.0, 1 - 0.2 * abs(a - b))

    want = []
    for qid, qn, qp in qf:
        rows = [r for r in pool if r[0] == qid]
        sc = [(0.6 * r[3] + 0.2 * ratio(qn, r[4]) + 0.2 * psim(qp, r[5]), r[1], r[2]) for r in rows]
        sc.sort(key=lambda t: (-t[0], t[1]))
        ranked = [(qid, i, ex, s) for i, (s, _, ex) in enumerate(sc, 1)]
        want += [x for x in ranked if x[3] >= 0.3][:3]
    assert [(r.query_id, r.rank, r.example_id) for r in got] == [w[:3] for w in want]
    assert [r.score for r in got] == pytest.approx([w[3] for w in want])
    assert {r.retrieval_method for r in got} == {"unknown_reranked"}


def test_top_k_zero_means_default(spark):
    from exemplar.operators.rerank import retrieve

    idx = spark.createDataFrame([(i, [1.0, float(i)], "f", 1) for i in range(8)], "example_id long, embedding array<float>, method_name string, param_count int")
    q = spark.createDataFrame([(1, [1.0, 0.0], "f", 1)], "query_id long, embedding array<float>, method_name string, param_count int")
    assert retrieve(q, idx, k=0, threshold=0.0).count() == 5


def test_index_parses_only_texts_of_its_vectors_and_once(spark, tmp_path, monkeypatch):
    """All texts of `part` were parsed, and again for every reader of the index; repeated and null keys stay."""
    from exemplar.plans import catalog

    vectors = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [0.5, 1.0], 0), (None, [1.0, 1.0], 0), (50, [1.0, 2.0], 0)]
    parts = [(i, f"part {i}", "Brand#11", "STANDARD TIN", i % 7, 1.0) for i in [1, 2, *range(3, 40), 2]]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(
        parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ).write.parquet(f"{tmp_path}/part.parquet")
    plain = catalog.table(spark, str(tmp_path), "embeddings").join(
        catalog._features(spark, str(tmp_path)), F.col("vec_id") == F.col("p_partkey"), "left"
    ).select("vec_id", "embedding", "method_name", "param_count")
    want = sorted(map(str, plain.collect()))
    parsed, parse = [], catalog.C.with_code_features
    monkeypatch.setattr(catalog.C, "with_code_features", lambda df, *a: parsed.append(df) or parse(df, *a))
    index = catalog._index(spark, str(tmp_path))
    assert sorted(map(str, index.collect())) == want and len(want) == 7
    assert sorted(r.p_partkey for r in parsed[0].collect()) == [1, 2, 2]
    assert "part.parquet" not in str(index.inputFiles()) and "embeddings.parquet" not in str(index.inputFiles())


@pytest.mark.parametrize("weight, carried", [(0.0, ["param_count"]), (0.2, ["method_name", "param_count"])])
def test_pool_carries_only_features_with_a_weight(spark, monkeypatch, weight, carried):
    from exemplar.operators import rerank as RR

    seen, search = [], RR.dense_topk
    monkeypatch.setattr(RR, "dense_topk", lambda *a, **kw: seen.append(list(kw["carry"])) or search(*a, **kw))
    rows = [(1, [1.0, 0.0], "a", 1), (2, [0.6, 0.8], "b", 2), (3, [0.0, 1.0], "a", None)]
    q = spark.createDataFrame(rows, "query_id long, embedding array<float>, method_name string, param_count int")
    got = RR.retrieve(q, q.withColumnRenamed("query_id", "example_id"), 2, weights={"embedding": 0.6, "method_name": weight, "signature": 0.2})
    first = {r.query_id: r.example_id for r in got.where("rank = 1").collect()}
    assert first == {1: 1, 2: 2, 3: 3} and seen == [carried]

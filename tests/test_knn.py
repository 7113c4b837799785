import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from exemplar.operators.knn import dense_topk


def brute(qs, cs, k, metric):
    out = []
    for qid, q in qs:
        scored = []
        for cid, c in cs:
            if c is None or len(c) != len(q):
                continue
            q_, c_ = np.asarray(q, float), np.asarray(c, float)
            if metric == "cosine":
                s = float(np.dot(q_ / (np.linalg.norm(q_) + 1e-8), c_ / (np.linalg.norm(c_) + 1e-8)))
            else:
                s = -float(np.linalg.norm(c_ - q_))
            scored.append((s, cid))
        scored.sort(key=lambda t: (-(math.inf if math.isnan(t[0]) else t[0]), t[1]))
        for r, (s, cid) in enumerate(scored[:k], 1):
            out.append((qid, r, cid, round(s, 9)))
    return sorted(out)


def _data(seed=0, n_q=7, n_c=60, d=8):
    rng = np.random.default_rng(seed)
    cs = [(i, [float(x) for x in rng.normal(size=d).astype(np.float32)]) for i in range(n_c)]
    cs[5] = (5, cs[3][1])  # exact duplicate vector: tie broken by id
    cs[7] = (7, [0.0] * d)  # zero vector
    qs = [(f"q{i}", cs[i * 3][1]) for i in range(n_q)]
    return qs, cs


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_matches_brute_force(spark, metric, strategy):
    qs, cs = _data()
    q = spark.createDataFrame(qs, "query_id string, embedding array<float>")
    c = spark.createDataFrame(cs, "example_id long, embedding array<float>").repartition(3)
    got = dense_topk(q, c, 4, metric, strategy=strategy, block_bytes=400).collect()
    got = sorted((r.query_id, r.rank, r.example_id, round(r.score, 9)) for r in got)
    want = brute([(a, [float(np.float32(x)) for x in v]) for a, v in qs], cs, 4, metric)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-7 for g, w in zip(got, want))


def test_identical_vector_first_and_ranks_contiguous(spark):
    qs, cs = _data(seed=1)
    q = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(qs)], "query_id long, embedding array<float>")
    c = spark.createDataFrame(cs, "example_id long, embedding array<float>")
    rows = dense_topk(q, c, 5).collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r.query_id, []).append(r)
    for qid, rs in by_q.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, len(rs) + 1))
        assert rs[0].score == pytest.approx(1.0, abs=1e-6)


def test_k_larger_than_corpus_and_wrong_dims(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None)], "example_id long, embedding array<float>")
    rows = dense_topk(q, c, 10).orderBy("rank").collect()
    assert [r.example_id for r in rows] == [1, 2]


def test_carry_payload(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(1, [1.0, 0.1], "a", 3), (2, [0.0, 1.0], "b", None)], "example_id long, embedding array<float>, name string, n int")
    for strategy in ("broadcast", "blocked"):
        rows = dense_topk(q, c, 2, carry=("name", "n"), strategy=strategy).orderBy("rank").collect()
        assert [(r.example_id, r.name, r.n) for r in rows] == [(1, "a", 3), (2, "b", None)]


def test_unknown_metric(spark):
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    with pytest.raises(ValueError):
        dense_topk(q, q.withColumnRenamed("query_id", "example_id"), 1, "manhattan")


def test_no_cross_join_in_plan(spark):
    qs, cs = _data()
    q = spark.createDataFrame(qs, "query_id string, embedding array<float>")
    c = spark.createDataFrame(cs, "example_id long, embedding array<float>")
    plan = dense_topk(q, c, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan or "Window" in plan


def test_far_queries_on_both_sides_choose_exactly(spark):
    """The mean of the queries is far from all vectors, so the expanded formula alone tells nothing."""
    big = 1e8
    cs = [(i, [big + x]) for i, x in enumerate([0.5, 0.25, 0.1, 2.0])]
    qs = [("low", [-big]), ("high", [big]), ("near", [big + 1.9])]
    q = spark.createDataFrame(qs, "query_id string, embedding array<double>")
    c = spark.createDataFrame(cs, "example_id long, embedding array<double>")
    for strategy in ("broadcast", "blocked"):
        got = {(r.query_id, r.rank): (r.example_id, r.score) for r in dense_topk(q, c, 2, "euclidean", strategy=strategy).collect()}
        assert got[("high", 1)][0] == 2 and abs(got[("high", 1)][1] + 0.1) < 1e-6 and got[("high", 2)][0] == 1
        assert got[("near", 1)][0] == 3 and got[("low", 1)][0] == 2


def test_few_distances_are_subtracted():
    from exemplar.operators import knn

    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(20, 16)), rng.normal(size=(3000, 16))
    sq = lambda m: np.einsum("ij,ij->i", m, m)
    tile = knn._distance_tile(q, q, sq(q), c, c, sq(c), 5, np.full(20, np.inf))
    exact = -np.linalg.norm(q[:, None] - c[None], axis=2)
    for i in range(20):
        best = np.argsort(-exact[i])[:5]
        assert np.allclose(tile[i, best], exact[i, best], rtol=0, atol=1e-12)
    assert np.isfinite(tile).sum() <= 20 * 6


def _held(q, c, ids, metric, k, batch=700):
    from exemplar.operators.knn import _RunningTopK

    acc = _RunningTopK(q, metric, k)
    pos = np.arange(len(c))
    for lo in range(0, len(c), batch):
        acc.add(c[lo : lo + batch], ids[lo : lo + batch], pos[lo : lo + batch])
    out = [[] for _ in q]
    for r, i, s, p in zip(*acc.rows()):
        assert ids[p] == i
        out[r].append((int(i), float(s)))
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("case", ["plain", "copies", "nan", "infinite", "tiny", "huge", "zero"])
def test_kernel_is_exact_on_odd_rows(metric, case):
    rng = np.random.default_rng(7)
    q, c, k = rng.normal(size=(60, 9)), rng.normal(size=(3000, 9)), 6
    ids = rng.permutation(9000)[:3000].astype(np.int64)
    if case == "copies":
        c = c[rng.integers(0, 15, 3000)]
        q = c[rng.integers(0, 3000, 60)]
    if case == "nan":
        c[::7, 2], q[::11] = np.nan, np.nan
    if case == "infinite":
        c[::7, 3], c[::5, 2], q[::11, 3] = np.inf, -np.inf, np.inf
    if case == "tiny":
        q, c = q * 1e-25, c * 1e-25
    if case == "huge":
        q, c = q * 1e160, c * 1e160
    if case == "zero":
        c[::2], q[::3] = 0.0, 0.0
    got = _held(q, c, ids, metric, k)
    with np.errstate(all="ignore"):
        unit = lambda m: m / (np.sqrt(np.einsum("ij,ij->i", m, m)) + 1e-8)[:, None]
        a, b = (unit(q), unit(c)) if metric == "cosine" else (q, c)
        for i, found in enumerate(got):
            s = np.einsum("ij,ij->i", np.repeat(a[i : i + 1], len(b), 0), b) if metric == "cosine" else 0.0 - np.sqrt(np.einsum("ij,ij->i", a[i] - b, a[i] - b))
            best = np.lexsort((ids, -np.where(np.isnan(s), np.inf, s)))[:k]
            assert [x for x, _ in found] == ids[best].tolist()
            assert np.allclose([x for _, x in found], s[best], rtol=1e-12, atol=1e-15, equal_nan=True)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_few_pairs_are_scored_exactly(metric, monkeypatch):
    """The single-precision product rules nearly all pairs out, also with a large k."""
    from exemplar.operators import knn

    scored, scores = [], knn._RunningTopK._scores
    monkeypatch.setattr(knn._RunningTopK, "_scores", lambda self, r, c, p: scored.append(len(r)) or scores(self, r, c, p))
    rng = np.random.default_rng(8)
    q, c = rng.normal(size=(40, 32)), rng.normal(size=(60_000, 32))
    _held(q, c, np.arange(60_000), metric, 50, 10_000)
    assert sum(scored) < 0.03 * 40 * 60_000


def test_blocks_use_all_cores_and_bound_a_task():
    """One GB of embeddings (120,000 rows) was scored for all queries in every task, six GB in 36 blocks."""
    from exemplar.operators import knn

    for n, k in ((20_000, 5), (120_000, 51), (720_000, 5), (720_000, 50), (5_000_000, 50)):
        qb, cb = knn._grid(n, n, 64, k, knn.DEFAULT_BLOCK_BYTES, 12)
        assert qb * cb >= 48 and n / qb * n / cb <= knn._TASK_PAIRS
        assert n / qb * (64 * 8 + 16 + 48 * k) <= knn.DEFAULT_BLOCK_BYTES
    assert knn._grid(1, 1, 3, 5, 400, 12) == (1, 1)


def test_blocks_are_scored_one_to_a_task(spark, monkeypatch):
    """Blocks are neither hashed onto each other's partitions nor put together afterwards; repeated ids and nulls stay."""
    from exemplar.operators import knn

    rng = np.random.default_rng(9)
    monkeypatch.setattr(knn, "_TASK_PAIRS", 500)
    rows = [(i // 2, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(120)] + [(None, [1.0, 0.0, 0.0, 0.0]), (7, None), (8, [1.0])]
    df = spark.createDataFrame(rows, "query_id long, embedding array<float>")
    parts = knn._blocked_scores(df, df, 3, "cosine", "query_id", "embedding", "query_id", "embedding", 4, df.schema["query_id"].dataType, 123, 123, 1 << 20, ())
    qb, cb = knn._grid(123, 123, 4, 3, 1 << 20, spark.sparkContext.defaultParallelism)
    assert parts.rdd.getNumPartitions() == qb * cb >= 31
    c = df.where("query_id is not null").withColumnRenamed("query_id", "example_id")
    got = {s: sorted(map(str, dense_topk(df, c, 3, strategy=s).collect())) for s in ("broadcast", "blocked")}
    assert got["broadcast"] == got["blocked"] and len(got["blocked"]) == 61 * 3


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_first_rows_are_bounded_too(metric, monkeypatch):
    """The k-th bound of the first tile rules pairs out before k rows are held: 414 pairs a query were scored here, 99 are."""
    from exemplar.operators import knn

    scored, scores = [], knn._RunningTopK._scores
    monkeypatch.setattr(knn._RunningTopK, "_scores", lambda self, r, c, p: scored.append(len(r)) or scores(self, r, c, p))
    rng = np.random.default_rng(8)
    q, c = rng.normal(size=(40, 32)), rng.normal(size=(4096, 32))
    got = _held(q, c, np.arange(4096), metric, 50, 4096)
    assert sum(scored) < 40 * 150
    unit = lambda m: m / (np.linalg.norm(m, axis=1) + 1e-8)[:, None]
    for i, found in enumerate(got):
        s = unit(c) @ unit(q)[i] if metric == "cosine" else -np.linalg.norm(c - q[i], axis=1)
        assert [x for x, _ in found] == np.argsort(-s)[:50].tolist()


def test_long_lists_are_found_in_few_blocks():
    """Each block of rows gives a list of k for every query; with k = 50 these cost more than copies of the rows."""
    from exemplar.operators import knn

    assert knn._grid(102_560, 102_560, 64, 50, knn.DEFAULT_BLOCK_BYTES, 12)[1] == 1  # was 3
    assert knn._grid(720_000, 720_000, 64, 50, knn.DEFAULT_BLOCK_BYTES, 12)[1] == 2  # was 5

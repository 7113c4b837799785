import math
import random

from exemplar.llm import queries, topk
from exemplar.llm.queries_sql import SQL
from pyspark.sql import functions as F

from .common import SF, oracle, same

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def brute(rows, every, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in ok:
        if qi % every:
            continue
        best = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in ok if ci != qi and len(c) == len(q))[:k]
        out += [(qi, n + 1, ci, -s) for n, (s, ci) in enumerate(best)]
    return sorted(out)


def run(spark, rows, every, **options):
    df = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **options)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_query_matches_sql(spark):
    same(queries.QUERIES["op10_exact_topk"](spark, SF), oracle(SQL["op10_exact_topk"]))


def test_awkward_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [float(round(rng.gauss(0, 1), 3)) for _ in range(7)], 0, 0) for i in range(300)]
    rows += [(300 + i, [0.5] * 7, 0, 0) for i in range(200)]  # ties
    rows += [(900, None, 0, 0), (910, [], 0, 0), (920, [None] * 7, 0, 0), (930, [float("nan")] * 7, 0, 0), (940, [float("inf")] + [0.0] * 6, 0, 0)]
    rows += [(950, [1.0, 2.0], 0, 0), (951, [1.0, -2.0], 0, 0), (960, [100.0] * 7, 0, 0), (970, [-100.0] * 7, 0, 0)]
    import numpy as np

    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], a, b) for i, v, a, b in rows]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_many_slots_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLOT_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(5)], 0, 0) for i in range(400)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0], 0, 0), (1, [0.0, 1.0], 0, 0)]
    assert run(spark, rows, 1) == brute(rows, 1)
    assert run(spark, [], 1) == []


def test_null_ids_beside_ids_above_2_to_53(spark):
    import pyarrow as pa

    big = 50 * (2**53 // 50 + 1)  # a query; its neighbours differ from it in the last bits only
    rows = [(big + i, [1.0, 0.25 * (i % 3)], 0, 0) for i in range(9)]
    rows += [(None, [9.0, 9.0], 0, 0), (None, [1.0, 0.0], 0, 0), (None, None, 0, 0), (50, [1.0, 1.0], 0, 0)]
    expected = brute([r for r in rows if r[0] is not None], 50)
    assert {q for q, *_ in expected} == {50, big} and len(expected) == 10
    assert run(spark, rows, 50) == expected
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    told = oracle(SQL["op10_exact_topk"], embeddings=table)
    assert sorted(told[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == expected


def test_few_rows_are_left_for_the_exact_products():
    import numpy as np
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    rows = [(i, v) for i, v in zip(t["vec_id"], t["embedding"]) if v is not None and len(v) == 64]
    x = np.floor(256 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    queries_ = x[[i % 50 == 0 for i, _ in rows]]
    maybe = topk.BitSliced(x, topk.X_BITS).boundary(queries_, topk._pack(np.ones((len(queries_), len(x)), bool)), 5)
    exact = queries_ @ x.T
    kth = np.sort(exact, axis=1)[:, -5]
    assert maybe[exact >= kth[:, None]].all()  # none of the best is lost
    assert 5 / len(x) <= maybe.mean() <= 0.1


def test_large_components(spark):
    """Products that leave 63 bits on the way, and components that do not fit at all."""
    big = float(2**22)
    rows = [(0, [big] * 64, 0, 0), (50, [big, -big] * 32, 0, 0), (1, [1.0] * 64, 0, 0), (2, [-big] * 64, 0, 0), (3, [0.5, big] * 32, 0, 0), (4, [3e38] * 64, 0, 0)]
    expected = brute(rows[:-1], 50)
    got = run(spark, rows, 50)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    for g, e in zip(got, expected):
        assert g[3] == max(-(2**63 - 1), min(2**63 - 1, e[3]))

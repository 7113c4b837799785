import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from exemplar.operators import bm25
from exemplar.operators.bm25 import bm25_topk

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "A quick brown dog outpaces a quick fox"),
    (3, "Lorem ipsum dolor sit amet"),
    (4, "The quick brown fox jumps over the lazy dog"),  # exact copy of 1
    (5, "Über Straße naïve café fox fox fox"),
    (6, ""),
]
QUERIES = [("a", "quick fox"), ("b", "lazy dog dog"), ("c", "café straße"), ("d", "nothing matches zzz")]


def tok(s):
    return re.findall(r"[^\W]+", s.lower())


def brute(k):
    toks = {d: tok(t) for d, t in DOCS}
    n = len(DOCS)
    avgdl = sum(len(t) for t in toks.values()) / n
    df = Counter(t for ts in toks.values() for t in set(ts))
    out = []
    for qid, qt in QUERIES:
        scores = []
        for d, ts in toks.items():
            tf = Counter(ts)
            s = 0.0
            hit = False
            for term in tok(qt):
                if tf[term]:
                    hit = True
                    idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                    s += idf * tf[term] * 2.2 / (tf[term] + 1.2 * (0.25 + 0.75 * len(ts) / avgdl))
            if hit:
                scores.append((round(s, 9), d, s))
        scores.sort(key=lambda t: (-t[0], t[1]))
        out += [(qid, r, d, s) for r, (_, d, s) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("limit,block_docs", [(64 << 20, None), (1, None), (64 << 20, 1), (1, 2)])
def test_bm25_matches_brute_force(spark, limit, block_docs):
    q = spark.createDataFrame(QUERIES, "query_id string, text string")
    d = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    got = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in bm25_topk(q, d, 3, query_limit_bytes=limit, block_docs=block_docs).collect())
    want = brute(3)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want))


def test_stored_index_is_sorted_and_searched(spark, tmp_dir):
    q = spark.createDataFrame(QUERIES + [("e", "")], "query_id string, text string")
    d = spark.createDataFrame(DOCS + [(None, "quick quick fox")], "doc_id long, text string")
    bm25.build(d, tmp_dir + "/index", block_docs=2)
    index = bm25.load(spark, tmp_dir + "/index")
    assert index.where("term = 'fox'").select(F.sum("n")).first()[0] == 5
    got = bm25.search_index(q, index, 3).collect()
    # the document without an id counts in N, df and the lengths, and is no hit
    again = bm25_topk(q, d, 3).collect()
    key = lambda rows: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in rows)
    assert key(got) == key(again) and {r.doc_id for r in got} <= {1, 2, 3, 4, 5}
    with pytest.raises(Exception):
        bm25.build(d, tmp_dir + "/index")  # never over an index that is there


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame(QUERIES, "query_id string, text string")
    assert bm25_topk(q, none, 3).collect() == []
    assert bm25_topk(q.limit(0), spark.createDataFrame(DOCS, "doc_id long, text string"), 3).collect() == []


def test_max_score_scores_few_documents():
    """Rows that are scored, against all; and the same k best."""
    rng = np.random.default_rng(3)
    rare, common = [f"r{i}" for i in range(800)], [f"c{i}" for i in range(30)]
    texts = [" ".join([*rng.choice(common, rng.integers(5, 60)), *rng.choice(rare, rng.integers(0, 8))]) for _ in range(3000)]
    tokens = [bm25.arrow_tokens(pa.array(texts))]
    rows = bm25._block_rows(0, [pa.array(range(3000), pa.int64())], tokens, None)
    lengths = np.array([len(t.split()) for t in texts])
    full = bm25.Block(pa.Table.from_batches([rows]), float(lengths.mean()))
    df = dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist()))
    pruned = 0
    for i in range(20):
        words = set(rng.choice(common, 6)) | set(rng.choice(rare, 6))
        weights = {w: float(np.log(1 + (3000 - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5))) for w in words}
        ids, scores = full.search(weights, 0.0, 10)
        exact = {}
        for d, t in enumerate(texts):
            tf = Counter(t.split())
            s = sum(w * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * lengths[d] / lengths.mean())) for x, w in weights.items() if tf[x])
            if s:
                exact[d] = s
        best = sorted(exact, key=lambda d: (-round(exact[d], 9), d))[:10]
        assert ids.tolist() == best and np.allclose(scores, [exact[d] for d in best])
        full.scored = 0
        again, _ = full.search(weights, float(scores[-1]), 10)  # with the final threshold
        assert again.tolist() == best
        pruned += full.scored
    assert pruned < 0.2 * 20 * 3000

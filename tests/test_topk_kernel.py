"""Property tests of the numpy top-k kernel used by the partition-local scorers."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from exemplar.operators.topk import NO_ID, topk_merge


@settings(max_examples=200, deadline=None)
@given(
    st.integers(1, 4),
    st.integers(1, 12),
    st.integers(1, 6),
    st.lists(st.sampled_from([0.0, 0.5, 1.0, -1.0, 0.25, float("nan")]), min_size=48, max_size=48),
)
def test_topk_merge_matches_sort(n, m, k, pool):
    scores = np.array(pool[: n * m], dtype=float).reshape(n, m) if n * m <= 48 else np.zeros((n, m))
    ids = np.tile(np.arange(m, dtype=np.int64)[::-1], (n, 1))  # ids not in column order
    top_s, top_i, top_c = topk_merge(scores, ids, k)
    for r in range(n):
        key = [(-(math.inf if math.isnan(s) else s), int(i)) for s, i in zip(scores[r], ids[r])]
        want = sorted(key)[:k]
        got = [(-(math.inf if math.isnan(s) else s), int(i)) for s, i in zip(top_s[r], top_i[r]) if i != NO_ID]
        assert got == want
        assert all(ids[r, c] == i for c, i in zip(top_c[r], top_i[r]) if c >= 0)


def test_scores_in_unit_interval_for_nonnegative_vectors():
    rng = np.random.default_rng(3)
    from exemplar.operators.knn import _RunningTopK

    q = np.abs(rng.normal(size=(5, 8)))
    c = np.abs(rng.normal(size=(40, 8)))
    acc = _RunningTopK(q, "cosine", 7)
    acc.add(c, np.arange(40, dtype=np.int64))
    _, _, sc, _ = acc.rows()
    assert np.all(sc >= 0) and np.all(sc <= 1 + 1e-12)

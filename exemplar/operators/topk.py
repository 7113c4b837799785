"""Top-k per group (W1, W2, W3) and the numpy kernel shared by the
partition-local scorers.

``top_k_per_group`` is the Spark-side merge: ``row_number`` over a window with
a filter ``<= k``.  Catalyst turns that into a partial WindowGroupLimit before
the shuffle and a final one after it, so a partition never ships more than k
rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column],
    k: int,
    rank_col: str = "rank",
) -> DataFrame:
    if k < 1:
        raise ValueError("k must be >= 1")
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


# Sentinel for "no candidate" slots in the running top-k buffers.
NO_ID = np.iinfo(np.int64).max


def topk_merge(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row-wise exact top-k of a score matrix under the order
    (score desc with NaN first, id asc).

    scores, ids: (n, m) arrays.  Returns (top_scores, top_ids, top_cols), each
    (n, k); missing slots carry -inf / NO_ID / -1.
    """
    n, m = scores.shape
    out_s = np.full((n, k), -np.inf)
    out_i = np.full((n, k), NO_ID, dtype=np.int64)
    out_c = np.full((n, k), -1, dtype=np.int64)
    if n == 0 or m == 0:
        return out_s, out_i, out_c
    key = np.where(np.isnan(scores), np.inf, scores)
    if m > k:
        # k-th largest key per row; every entry >= it is a candidate (ties kept).
        kth = np.partition(key, m - k, axis=1)[:, m - k]
        rows, cols = np.nonzero(key >= kth[:, None])
    else:
        rows, cols = np.nonzero(np.ones_like(key, dtype=bool))
    order = np.lexsort((ids[rows, cols], -key[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(n))
    pos = np.arange(rows.size) - starts[rows]
    keep = pos < k
    rows, cols, pos = rows[keep], cols[keep], pos[keep]
    out_s[rows, pos] = scores[rows, cols]
    out_i[rows, pos] = ids[rows, cols]
    out_c[rows, pos] = cols
    return out_s, out_i, out_c

"""Two-stage retrieval: pool -> rerank -> threshold -> top-k.

The pool comes out of ``dense_topk`` already partitioned by query id, with the
candidate features carried through the scan, so reranking is a join with the
(small) query features plus a window by query id, without a join back to the
corpus; the name-ratio UDF in between costs one more exchange of the pool.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code import param_similarity
from ..functions.similarity import name_similarity
from .knn import dense_topk
from .topk import top_k_per_group

# Default rerank weights, pool size and method label suffix.
DEFAULT_WEIGHTS = {"embedding": 0.6, "method_name": 0.2, "signature": 0.2}
DEFAULT_POOL = 50
DEFAULT_TOP_K = 5
RERANK_SUFFIX = "_reranked"
BASE_METHOD = "unknown"


def normalize_weights(weights: Mapping[str, float] | None) -> dict[str, float]:
    """Weights divided by their sum; all three keys are required."""
    w = dict(weights or DEFAULT_WEIGHTS)
    missing = [k for k in DEFAULT_WEIGHTS if k not in w]
    if missing:
        raise KeyError(f"rerank weights missing {missing}")
    total = sum(w.values())
    if total == 0:
        raise ValueError("rerank weights sum to zero")
    return {k: v / total for k, v in w.items()}


def rerank(
    pool: DataFrame,
    query_features: DataFrame,
    k: int = 5,
    threshold: float = 0.0,
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """C8 over a candidate pool.

    pool: query_id, rank, example_id, score, method_name, param_count
    query_features: query_id, q_method_name, q_param_count
    Returns query_id, rank, example_id, score (combined), the three component
    scores, first_stage_rank and retrieval_method.
    """
    w = normalize_weights(weights)
    j = pool.join(query_features, "query_id")
    name_sim = (
        name_similarity(F.col("q_method_name"), F.col("method_name"))
        if w["method_name"] != 0
        else F.lit(0.0)
    )
    scored = j.select(
        "query_id",
        "example_id",
        F.col("rank").alias("first_stage_rank"),
        F.col("score").alias("embedding_score"),
        name_sim.alias("name_score"),
        param_similarity("q_param_count", "param_count").alias("signature_score"),
    ).withColumn(
        "score",
        F.lit(w["embedding"]) * F.col("embedding_score")
        + F.lit(w["method_name"]) * F.col("name_score")
        + F.lit(w["signature"]) * F.col("signature_score"),
    )
    # W2 then W3: the threshold is monotone in the new rank, so the filter and
    # the limit commute; NaN scores are removed before (vector checks).
    ranked = top_k_per_group(
        scored, ["query_id"], [F.col("score").desc(), F.col("first_stage_rank").asc()], k
    ).where(F.col("score") >= F.lit(float(threshold)))
    return ranked.select(
        "query_id",
        F.col("rank").cast("int"),
        "example_id",
        "score",
        "embedding_score",
        "name_score",
        "signature_score",
        F.col("first_stage_rank").cast("int"),
        F.lit(BASE_METHOD + RERANK_SUFFIX).alias("retrieval_method"),
    )


def threshold_top_k(pool: DataFrame, k: int, threshold: float) -> DataFrame:
    """R2 without reranking: keep score >= threshold, first k by first-stage rank."""
    return pool.where((F.col("score") >= F.lit(float(threshold))) & (F.col("rank") <= k)).withColumn(
        "retrieval_method", F.lit(BASE_METHOD)
    )


def retrieve(
    queries: DataFrame,
    index: DataFrame,
    k: int = 5,
    threshold: float = 0.0,
    *,
    enable_reranking: bool = True,
    pool_size: int = DEFAULT_POOL,
    weights: Mapping[str, float] | None = None,
    metric: str = "cosine",
    **search_options,
) -> DataFrame:
    """R2 for a whole table of queries.

    queries: query_id, embedding, method_name, param_count
    index:   example_id, embedding, method_name, param_count
    ``k`` of 0 or None means the default top-k (5), as in the original.
    """
    k = k or DEFAULT_TOP_K
    if enable_reranking:
        pool = dense_topk(
            queries.select("query_id", "embedding"),
            index,
            pool_size,
            metric,
            carry=("method_name", "param_count") if normalize_weights(weights)["method_name"] != 0 else ("param_count",),
            **search_options,
        )
        qf = queries.select(
            "query_id",
            F.col("method_name").alias("q_method_name"),
            F.col("param_count").alias("q_param_count"),
        )
        return rerank(pool, qf, k, threshold, weights)
    pool = dense_topk(queries.select("query_id", "embedding"), index, k, metric, **search_options)
    return threshold_top_k(pool, k, threshold)

"""Quality statistics and run bookkeeping.

All of these are grouped aggregations (map-side partial aggregation, one
shuffle on the group key) or anti joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_quality(
    results: DataFrame,
    threshold: float = 0.5,
    min_avg: float = 0.0,
    query_id: str = "query_id",
    score: str = "score",
) -> DataFrame:
    """Per query the documented go/no-go statistics of a retrieved pool.

    total_retrieved, filtered_count (score >= threshold), avg/std/max of the
    scores, and passed = at least one above the threshold, average >= min_avg
    and not every score zero.
    """
    s = F.col(score)
    agg = results.groupBy(query_id).agg(
        F.count(s).alias("total_retrieved"),
        F.count_if(s >= F.lit(threshold)).alias("filtered_count"),
        F.avg(s).alias("avg_similarity"),
        F.stddev_samp(s).alias("std_similarity"),
        F.max(s).alias("max_similarity"),
        F.count_if(s != F.lit(0.0)).alias("_nonzero"),
    )
    passed = (
        (F.col("filtered_count") >= 1)
        & (F.col("avg_similarity") >= F.lit(min_avg))
        & (F.col("_nonzero") > 0)
    )
    return agg.select(
        query_id,
        "total_retrieved",
        "filtered_count",
        "avg_similarity",
        "std_similarity",
        "max_similarity",
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.lit(float(threshold)).alias("similarity_threshold"),
    )


def relaxed_retrieval(
    results: DataFrame,
    thresholds: Sequence[float],
    min_avg: float = 0.0,
    query_id: str = "query_id",
    score: str = "score",
) -> DataFrame:
    """A9 self-correction: for each query the first threshold (in the given,
    decreasing order) at which it passes, evaluated for all thresholds in one
    pass (an array of per-threshold counts) instead of re-running retrieval.
    Queries that never pass keep the last threshold with passed = false."""
    s = F.col(score)
    ts = [float(t) for t in thresholds]
    agg = results.groupBy(query_id).agg(
        F.count(s).alias("total_retrieved"),
        F.avg(s).alias("avg_similarity"),
        F.count_if(s != F.lit(0.0)).alias("_nonzero"),
        F.array(*[F.count_if(s >= F.lit(t)) for t in ts]).alias("_counts"),
    )
    ok_base = (F.col("avg_similarity") >= F.lit(min_avg)) & (F.col("_nonzero") > 0)
    pairs = F.arrays_zip(F.array(*[F.lit(t) for t in ts]).alias("t"), F.col("_counts").alias("c"))
    first_ok = F.filter(pairs, lambda p: p["c"] >= 1)
    chosen = F.when(ok_base & (F.size(first_ok) > 0), first_ok[0]).otherwise(pairs[len(ts) - 1])
    return agg.select(
        query_id,
        "total_retrieved",
        chosen["t"].alias("similarity_threshold"),
        chosen["c"].alias("filtered_count"),
        "avg_similarity",
        F.coalesce(ok_base & (F.size(first_ok) > 0), F.lit(False)).alias("passed"),
    )


def run_summary(log: DataFrame, model: str = "model") -> DataFrame:
    """A10: per model the number of runs, successes and minutes spent."""
    return log.groupBy(model).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        (F.sum("elapsed_time") / F.lit(60.0)).alias("elapsed_time_min"),
    )


def run_totals(log: DataFrame) -> DataFrame:
    """A10 totals line: total, successful, failed, total minutes."""
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        (F.sum("elapsed_time") / F.lit(60.0)).alias("total_minutes"),
    )


def step_counts(manifest: DataFrame, step: str = "step", status: str = "status") -> DataFrame:
    """Processed / skipped / failed / total per pipeline step."""
    st = F.col(status)
    return manifest.groupBy(step).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(st == "processed").alias("processed"),
        F.count_if(st == "skipped").alias("skipped"),
        F.count_if(st == "failed").alias("failed"),
    )


def cost_estimate(
    tasks: DataFrame,
    group_cols: Sequence[str],
    tokens_in: str = "tokens_in",
    tokens_out: str = "tokens_out",
    price_in_per_m: float = 2.50,
    price_out_per_m: float = 10.00,
) -> DataFrame:
    """Token totals and cost per group, prices in dollars per million tokens."""
    return tasks.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum(tokens_in).alias("tokens_in"),
        F.sum(tokens_out).alias("tokens_out"),
        (
            (F.sum(tokens_in) * F.lit(price_in_per_m) + F.sum(tokens_out) * F.lit(price_out_per_m))
            / F.lit(1e6)
        ).alias("cost_usd"),
    )


def counts_by(df: DataFrame, col: str) -> DataFrame:
    """Rows per group."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def pending(inputs: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Inputs with no output yet (left anti join on the key)."""
    return inputs.join(done, on=key, how="left_anti")

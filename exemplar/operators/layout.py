"""Partition layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SPREAD_LIMIT_BYTES = 256 << 20


_UNKNOWN = (1 << 63) - 1


def estimated_bytes(df: DataFrame) -> int | None:
    """The bytes that ``df`` reads: the sum over the leaves of its plan (file
    sizes for scans), without running it; None when one is unknown.  Not the
    estimate of the whole plan, which after a join is a product."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:
        return None
    return None if size >= _UNKNOWN else size


SCORING_TASK_BYTES = 1 << 30


def scoring_layout(df: DataFrame, task_bytes: int = SCORING_TASK_BYTES) -> DataFrame:
    """Layout for the partition-local top-k scorers: small inputs are spread
    over all cores; large inputs are coalesced (no shuffle) so each task scans
    about ``task_bytes``.  Every task emits up to ``n_queries * k`` partial
    rows, so fewer, larger tasks bound the merge shuffle by the bytes scanned
    instead of by the number of file splits."""
    size = estimated_bytes(df)
    if size is None:
        return df
    if size <= SPREAD_LIMIT_BYTES:
        return spread(df)
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes))
    return df.coalesce(int(min(n, 1 << 20)))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition of a *small* input (estimated at most
    ``SPREAD_LIMIT_BYTES``) over all cores, so CPU-heavy stages are not run by
    the one task that reads a single-row-group file.  Larger inputs are left
    as they are: they already come in many splits, and reshuffling them would
    cost more than it saves.
    """
    size = estimated_bytes(df)
    if size is not None and size <= SPREAD_LIMIT_BYTES:
        return df.repartition(min_partitions or df.sparkSession.sparkContext.defaultParallelism)
    return df


def ordinal(df: DataFrame, order_by: list[str], within: list[str] | None = None, name: str = "ordinal") -> DataFrame:
    """0-based position of each row in ``order_by`` order, restarting for each
    ``within`` group (W6: task_id); null group keys form a group.

    Rows are range-partitioned and sorted on (within, order_by) and numbered per
    group inside each task, so a large group is spread over many tasks; what
    lies before a task follows from one count per (partition, group).  The
    numbered rows are written to the shared folder first: both the counts and
    the result read the same numbering, whatever ties ``order_by`` leaves.
    """
    import pyarrow as pa
    from pyspark.sql import Window
    from pyspark.sql import types as T

    from ..session import written

    within = list(within or [])
    keys = within + list(order_by)
    s = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType(s.schema.fields + [T.StructField("_pid", T.IntegerType()), T.StructField("_local", T.LongType())])

    def number(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        group, n = None, 0
        for b in batches:
            gk = list(zip(*[b.column(c).to_pylist() for c in within])) if within else [()] * b.num_rows
            local = []
            for g in gk:  # sorted, so a group's rows follow each other
                n = n + 1 if g == group else 0
                group = g
                local.append(n)
            yield pa.RecordBatch.from_arrays(
                list(b.columns) + [pa.array([pid] * b.num_rows, pa.int32()), pa.array(local, pa.int64())],
                names=list(b.schema.names) + ["_pid", "_local"],
            )

    local = written(s.mapInArrow(number, schema), "ordinal")
    counts = local.groupBy("_pid", *within).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_pid").alias("_opid"),
        *[F.col(c).alias(f"_o_{c}") for c in within],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
    )
    on = F.col("_pid") == F.col("_opid")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    j = local.join(offsets, on, "left")
    return j.withColumn(name, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off", "_opid", *[f"_o_{c}" for c in within])

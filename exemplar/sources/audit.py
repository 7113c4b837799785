"""Output audit (S12): per (model, language) the number of lines and the size
of the produced files, with missing ones reported as such.

The files are read by Spark (``read.text`` with ``_metadata``), the counts are
one aggregation, and the expected grid is left-joined so absent outputs show
up with ``found = false``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import decoded_path, is_missing


def audit_outputs(
    spark: SparkSession,
    root: str,
    models: Sequence[str] | DataFrame,
    langs: Sequence[str] = ("rust", "go", "julia"),
    file_name: str | None = "data_with_fewshot.jsonl",
) -> DataFrame:
    """Layout ``<root>/<model>/<lang>/<file_name>`` (the original's), or with
    ``file_name=None`` the partitioned layout of ``write_context``:
    ``<root>/embedder=<model>/lang=<lang>/part-*``."""
    if isinstance(models, DataFrame):  # the expected outputs themselves: (model, lang)
        grid = models.select("model", "lang").distinct()
    else:
        grid = spark.createDataFrame([(m, l) for m in models for l in langs], "model string, lang string")
    pattern = f"{root.rstrip('/')}/*/*/{file_name}" if file_name else f"{root.rstrip('/')}/embedder=*/lang=*/part-*"
    try:
        lines = spark.read.text(pattern).select(
            decoded_path().alias("path"), F.col("_metadata.file_size").alias("size")
        )
    except AnalysisException as e:
        if not is_missing(e):
            raise
        # nothing written at all
        return grid.select("model", "lang", F.lit(0).cast("long").alias("lines"), F.lit(0.0).alias("size_mb"), F.lit(False).alias("found"))
    parts = F.split("path", "/")
    strip = lambda c: F.regexp_replace(c, r"^(embedder|lang)=", "")
    per_file = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.max("size").alias("size")).select(
        strip(F.element_at(parts, -3)).alias("model"),
        strip(F.element_at(parts, -2)).alias("lang"),
        "lines",
        "size",
    )
    # several part files per (model, language) in the partitioned layout
    per_file = per_file.groupBy("model", "lang").agg(
        F.sum("lines").alias("lines"), (F.sum("size") / F.lit(1024.0 * 1024.0)).alias("size_mb")
    )
    j = grid.join(per_file, ["model", "lang"], "left")
    return j.select(
        "model",
        "lang",
        F.coalesce("lines", F.lit(0)).cast("long").alias("lines"),
        F.coalesce("size_mb", F.lit(0.0)).alias("size_mb"),
        F.col("size_mb").isNotNull().alias("found"),
    )

"""Evaluation run summaries (S9, P5, P6) and the CSV sink.

Layout on disk: ``<base>/<Language>/<Mode>/<Model>/summary.json``.  One glob
read with an explicit schema; Language/Mode/Model come from the file path of
each row (``_metadata.file_path``), so no driver-side directory walk is needed
and the listing is done by Spark's file index in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.compare import METRICS, MODES, TOTAL, metric_slug
from .tables import decoded_path

# Summary.json keys and the report headers they map to.
SUMMARY_KEYS = (
    ("total_samples", TOTAL),
    ("compiled_rate", "Compiled Rate (%)"),
    ("branch_coverage", "Branch Coverage (%)"),
    ("line_coverage", "Line Coverage (%)"),
    ("test_pass_rate", "Test Pass Rate (%)"),
    ("invocation_rate", "Invocation Rate (%)"),
)

SUMMARY_SCHEMA = T.StructType(
    [T.StructField("total_samples", T.LongType())]
    + [T.StructField(k, T.DoubleType()) for k, _ in SUMMARY_KEYS[1:]]
    + [T.StructField("_corrupt_record", T.StringType())]
)


def read_summaries(spark: SparkSession, base_dir: str, keep_corrupt: bool = False, file: str = "summary.json") -> DataFrame:
    """One row per readable summary.json with Language, Mode, Model.

    ``file`` may be a pattern, and folders may be named ``Language=...`` and so on, as a partitioned write has them.

    Modes other than standard/fewshot are ignored (P6); missing keys become 0
    (P5); malformed files are skipped unless ``keep_corrupt``.
    """
    reader = spark.read.option("multiLine", True)
    if keep_corrupt:
        reader = reader.schema(SUMMARY_SCHEMA).option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", "_corrupt_record"
        )
    else:
        # malformed files are skipped, as the original skips unreadable ones
        reader = reader.schema(T.StructType(SUMMARY_SCHEMA.fields[:-1])).option("mode", "DROPMALFORMED")
    from pyspark.errors import AnalysisException

    try:
        raw = reader.json(f"{base_dir.rstrip('/')}/*/*/*/{file}").withColumn("_path", decoded_path())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        schema = SUMMARY_SCHEMA if keep_corrupt else T.StructType(SUMMARY_SCHEMA.fields[:-1])
        raw = spark.createDataFrame([], schema).withColumn("_path", F.lit(None).cast("string"))
    parts = F.split(F.col("_path"), "/")
    df = raw.select(
        *[F.regexp_replace(F.element_at(parts, i), f"^{name}=", "").alias(name) for i, name in ((-4, "Language"), (-3, "Mode"), (-2, "Model"))],
        *[
            F.coalesce(F.col(k), F.lit(0 if k == "total_samples" else 0.0)).alias(name)
            for k, name in SUMMARY_KEYS
        ],
        *([F.col("_corrupt_record")] if keep_corrupt else []),
    ).where(F.col("Mode").isin(*MODES))
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV with a header (the reports are small: single file)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


_VIEW_COLUMNS = {"detailed": ("Language", "Model"), "by_language": ("Language",), "by_model": ("Model",)}


def write_reports(results: DataFrame, out_dir: str) -> list[str]:
    """All reports of the comparison job: detailed / by language / by model per
    metric, plus the consolidated summary, in the order of the reports.  The runs are read once: the
    reports are parts of one written table."""
    from ..operators import compare
    from ..session import written as stored

    table = stored(compare.report_table(results), "report")
    paths = []

    def save(rows: DataFrame, columns: list, name: str) -> None:
        path = f"{out_dir.rstrip('/')}/{name}.csv"
        write_csv(rows.orderBy("position").select(*columns), path)
        paths.append(path)

    for metric in METRICS:
        for view, keys in _VIEW_COLUMNS.items():
            avg = "" if view == "detailed" else "Avg "
            named = [
                F.col("standard").alias(f"{avg}Standard {metric}"),
                F.col("fewshot").alias(f"{avg}Few-Shot {metric}"),
                F.col("absolute_diff").alias("Absolute Diff"),
                F.col("relative_improvement").alias("Relative Improvement (%)"),
            ]
            rows = table.where((F.col("view") == view) & (F.col("metric") == metric))
            save(rows, [*keys, *named], f"comparison_{metric_slug(metric)}_{view}")
    whole = [
        F.col("metric").alias("Metric"),
        F.col("standard").alias("Avg Standard"),
        F.col("fewshot").alias("Avg Few-Shot"),
        F.col("absolute_diff").alias("Absolute Diff"),
        F.col("relative_improvement").alias("Improvement (%)"),
    ]
    save(table.where(F.col("view") == "consolidated"), whole, "comparison_consolidated_summary")
    return paths

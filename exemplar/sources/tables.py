"""Access to the parquet tables used as inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def decoded_path() -> Column:
    """The file path of a row as it is on disk; ``_metadata.file_path`` is URL-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def file_position() -> list[Column]:
    """Columns that order rows as the files hold them: path, place of the split in the file, row of the split."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]


def with_row_numbers(rows: DataFrame, name: str) -> DataFrame:
    """Rows read from files, numbered from 0 in the order of path, place in the file and row.

    One count per split and their running sum give what lies before a split; within it a row's place is the
    difference of its row id to the split's first.  So there is no sort and no shuffle of rows, whatever
    the sizes of the files; ``rows`` must come straight from a file source."""
    placed = rows.select("*", *file_position())
    splits = placed.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = splits.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return placed.join(starts, ["_file", "_block"]).withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_block", "_row", "_start")


def is_missing(error: Exception) -> bool:
    """Whether an analysis error says that a path is not there (and nothing else)."""
    condition = getattr(error, "getCondition", lambda: None)()
    return condition == "PATH_NOT_FOUND"

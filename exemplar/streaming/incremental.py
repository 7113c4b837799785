"""Incremental processing of newly arriving answer files.

Batch form: list the raw files (``binaryFile`` source with the content column
pruned, so only the file listing is read), drop the ones that already have an
output (left anti join), process the rest.

Streaming form: a file-source stream with ``trigger(availableNow=True)`` and a
checkpoint in the shared folder: every run processes exactly the files that
arrived since the previous run, and a lost executor only re-runs its tasks.
The evaluator's own outputs (``processed_*``, ``detailed_results*``) are
excluded by name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.responses import clean_responses
from ..operators.stats import pending
from ..sources.tables import decoded_path, is_missing

RAW_GLOB = "*.{jsonl,json}"
EXCLUDE = r"(^|/)(processed_[^/]*|detailed_results[^/]*)$"

RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("task_id", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("response", T.ArrayType(T.StringType())),
        T.StructField("generated", T.ArrayType(T.StringType())),
        T.StructField("id", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
    ]
)


def list_files(spark: SparkSession, root: str, glob: str = RAW_GLOB) -> DataFrame:
    """(path, name, size, modified) of files under ``root`` matching ``glob``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ).where(~F.col("path").rlike(EXCLUDE))


def pending_files(spark: SparkSession, raw_root: str, done: DataFrame, key: str = "name") -> DataFrame:
    """Raw files whose output is not there yet (``done`` has a ``key`` column)."""
    return pending(list_files(spark, raw_root), done.select(key), key)


def pending_evaluations(spark: SparkSession, root: str, input_glob: str = "processed_*.jsonl") -> DataFrame:
    """S14 second pass: directories holding a processed input but no
    ``summary.json`` yet (left anti join of the two listings on directory)."""
    def dirs(glob: str) -> DataFrame:
        listing = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true")
            .load(root)
            .select("path")
        )
        return listing.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")).distinct()

    try:
        inputs = dirs(input_glob)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return spark.createDataFrame([], "dir string")  # nothing processed yet
    return inputs.join(dirs("summary.json"), "dir", "left_anti")


def clean_new_files(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    checkpoint: str,
    lang: str,
    schema: T.StructType = RESPONSE_SCHEMA,
    run: int | None = None,
    max_files: int = 1000,
):
    """Clean every raw answer file that arrived since the last run.
    Returns the finished StreamingQuery.

    Answers are in ``response`` or ``generated``; ``schema`` names further
    fields to pass on; ``run`` marks the rows of this run.  Files come in
    micro-batches of at most ``max_files``, so a first run over a large folder is no
    single job, and a run that breaks off goes on behind its last finished batch."""
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", RAW_GLOB)
        .option("maxFilesPerTrigger", max_files)
        .json(raw_dir)
        .withColumn("source_file", decoded_path())
        .where(~F.col("source_file").rlike(EXCLUDE))
    )
    if {"response", "generated"} <= set(stream.columns):
        stream = stream.withColumn("response", F.coalesce("response", "generated")).drop("generated")
    cleaned = clean_responses(stream, lang)
    if run is not None:
        cleaned = cleaned.withColumn("run", F.lit(run))
    q = (
        cleaned.writeStream.format("json")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q

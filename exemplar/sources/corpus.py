"""Example corpus readers.

JSONL with one (focal_method, unit_test, metadata) object per line.  Lines are
read as text and parsed with ``from_json``: invalid JSON, blank lines and JSON
arrays parse to null and are skipped, and ``metadata`` is kept as the raw JSON
text of the object (default ``{}``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import is_missing, with_row_numbers

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("focal_method", T.StringType()),
        T.StructField("unit_test", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)


def valid_pair(focal="focal_method", test="unit_test"):
    """Both strings present and non-empty (whitespace counts as content)."""
    return F.col(focal).isNotNull() & (F.length(focal) > 0) & F.col(test).isNotNull() & (F.length(test) > 0)


def parse_corpus_lines(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    p = lines.select(F.from_json(F.col(value), CORPUS_SCHEMA).alias("r"), *keep).select("r.*", *keep)
    return p.where(valid_pair()).select(
        "focal_method", "unit_test", F.coalesce("metadata", F.lit("{}")).alias("metadata"), *keep
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of text files with their number over all files, from 0; skipped and corrupt ones count."""
    return with_row_numbers(spark.read.text(path), "line")


def read_corpus(spark: SparkSession, path: str, max_examples: int = 0) -> DataFrame:
    """Valid pairs of a JSONL corpus.  ``max_examples`` > 0 limits the
    number of *input lines* read (skipped lines count), in file order."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        # missing file: an empty corpus, as in the original
        return spark.createDataFrame([], CORPUS_SCHEMA)
    if max_examples and max_examples > 0:
        lines = numbered_lines(spark, path).where(F.col("line") < max_examples)
    return parse_corpus_lines(lines)


def with_example_ids(corpus: DataFrame) -> DataFrame:
    """Unique LONG ids (stable for a given input split; persist the index after)."""
    return corpus.withColumn("example_id", F.monotonically_increasing_id())


def add_examples(index_rows: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Union by name; rows without a vector carry a null embedding until rebuilt."""
    return index_rows.unionByName(new_rows, allowMissingColumns=True)


def pairs_from_turns(conversations: DataFrame) -> DataFrame:
    """Example pairs from chat turns: a user turn is the focal text and the
    assistant turn right after it is the paired answer (equi-join on
    (conv_id, turn + 1))."""
    u = conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("focal_method")
    )
    a = conversations.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("text").alias("unit_test")
    )
    j = u.join(a, (F.col("a_conv") == F.col("conv_id")) & (F.col("a_turn") == F.col("turn") + 1))
    return j.where(valid_pair()).select("conv_id", "turn", "focal_method", "unit_test")

"""Cleaning of generated answers.

Input rows (FIXTURES F6): ``prompt`` and ``response ARRAY<STRING>`` plus any
other fields, which pass through.  Output: ``raw_response`` (each answer
prefixed with the prompt's last line), ``response`` (the extracted tests, at
most 10) and no ``prompt``.  The API generator's ``generated`` field is
accepted as the answers when ``response`` is absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import raw_responses, sanitize_responses
from .layout import spread


def clean_responses(samples: DataFrame, lang: str | None = None, lang_col: str = "lang") -> DataFrame:
    """``lang`` fixes the language for all rows (go, rust, julia; any case);
    otherwise the ``lang_col`` column is used."""
    df = samples if samples.isStreaming else spread(samples)
    if "response" not in df.columns and "generated" in df.columns:
        df = df.withColumnRenamed("generated", "response")
    lang_c = F.lit(lang.lower()) if lang else F.lower(F.col(lang_col))
    raw = raw_responses(F.col("prompt"), F.col("response"))
    return (
        df.withColumn("raw_response", raw)
        .withColumn("response", sanitize_responses(lang_c, F.col("raw_response")))
        .drop("prompt")
    )


def clean_file(spark: SparkSession, input_path: str, output_path: str, lang: str) -> None:
    """JSONL in, JSONL out (one part file per input split)."""
    clean_responses(spark.read.json(input_path), lang).write.mode("overwrite").json(output_path)

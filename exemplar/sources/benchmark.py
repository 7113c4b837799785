"""Benchmark and retrieved-context readers.

S2: the language splits become one table with a ``lang`` column
(``unionByName`` of the splits; the hub download itself is not built).
S7: a retrieved-context JSONL file is read with the D9 schema in FAILFAST
mode, so a malformed or blank line is an error as in the original.
S13: a ``context`` column for RAG prompts, produced from retrieval results
(BM25 or dense) and joined by id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import with_row_numbers

# The language splits of the benchmark.
SPLITS = ("rust", "go", "julia")

RESULT = T.StructType(
    [
        T.StructField("example", T.StructType([
            T.StructField("focal_method", T.StringType()),
            T.StructField("unit_test", T.StringType()),
            T.StructField("metadata", T.StringType()),
        ])),
        T.StructField("similarity_score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("retrieval_method", T.StringType()),
    ]
)
CONTEXT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField(
            "retrieved_context",
            T.StructType([
                T.StructField("focal_method", T.StringType()),
                T.StructField("status", T.StringType()),
                T.StructField("error", T.StringType()),
                T.StructField("results", T.ArrayType(RESULT)),
            ]),
        ),
    ]
)


def read_benchmark(spark: SparkSession, paths: Mapping[str, str], fmt: str = "json") -> DataFrame:
    """{split: path} -> one DataFrame with ``lang`` and the input position
    ``pos`` (file order within the split, used for default ids)."""
    frames = []
    for lang, path in paths.items():
        df = with_row_numbers(spark.read.format(fmt).load(path), "pos").withColumn("lang", F.lit(lang))
        frames.append(df)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Retrieved-context JSONL (D9), malformed lines fail the read."""
    return spark.read.schema(CONTEXT_SCHEMA).option("mode", "FAILFAST").json(path)


def rag_context(hits: DataFrame, texts: DataFrame, k: int = 5, sep: str = "\n\n") -> DataFrame:
    """(id, context) where context joins the top-k hit texts in rank order.

    hits: (id, rank, doc_id); texts: (doc_id, text).  At most k rows per id
    are collected, so the group is bounded."""
    j = hits.where(F.col("rank") <= k).join(texts, "doc_id")
    g = j.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("r"))
    return g.select("id", F.array_join(F.transform("r", lambda x: x["text"]), sep).alias("context"))


def positional_merge(bench: DataFrame, contexts: DataFrame, order_col: str = "pos") -> DataFrame:
    """J2 opt-in: the original's merge by position (row i of the benchmark
    gets row i of the context file), by explicit ordinals on both sides; the
    default everywhere else is the join by id."""
    from ..operators.layout import ordinal

    b = ordinal(bench, [order_col], None, name="_row")
    c = ordinal(contexts.withColumn("_cpos", F.monotonically_increasing_id()), ["_cpos"], None, name="_row")
    return b.join(c.select("_row", "retrieved_context"), "_row", "left").drop("_row")

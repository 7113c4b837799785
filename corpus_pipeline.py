"""Corpus pipeline: five stages over ``documents``, each one of the operators in exemplar/llm.

1. toxicity: documents scored toxic (0.3 or more) go; labels of held-out rows are never learnt from.
2. near duplicates: of documents linked by a Jaccard similarity of 0.8 over five-word shingles,
   directly or through others, the one with the smallest doc_id stays.
3. decontamination: documents that contain 0.8 of a benchmark item's five-word shingles go.
4. secrets: every span found is replaced by a mark; all documents stay.
5. BPE: every document is encoded and decoded; the result has its ids and the decoded text.

Stages 1 to 4 return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exemplar.llm import bpe, decontaminate, jaccard, secrets, toxicity
from exemplar.llm.queries import tokenizer_content
from exemplar.session import written
from exemplar.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs, n=5, num=4, den=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizer = tokenizer_content()
    others = [c for c in docs.columns if c not in ("text", "ids", "n_tokens")]  # the last two are made here
    decoded = bpe.decode(bpe.encode(docs, tokenizer, carry=tuple(others)), tokenizer)
    return decoded.select(*[f"`{c}`" for c in others], "text", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("bpe", encode_and_decode),
]

#: No SQL: a learnt score, components of a similarity join and BPE are checked against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Registered queries of the ten operators (opN_<name>), each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table
from . import bpe, chat, decontaminate, htmltext, impacts, infill, jaccard, licenses, mixture, records, secrets, topk, toxicity
from .queries_sql import SQL  # noqa: F401

#: Two rows added to the conversations: texts that hold other templates' markers.
EXTRA = "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(EXTRA))
    return chat.digest(chat.read_chat(chat.format_chat(rows)))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(c)["label"] for c in cols])))), ",")
    scores = F.concat(F.col("base")["score"], F.col("detections")["score"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base")["first_word"]).alias("first_word"),
        F.array_max(F.col("base")["first_word"]).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "detections").alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def tokenizer_content(path: str | None = None) -> str:
    """The tokenizer file's text; by default the public byte-level BPE file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokenizer_content()
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-records")
    records.write(table(spark, sf_dir, "documents"), path, tokenizer_content(), end_id=0)
    return records.read(spark, path).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.digest(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_toxicity": op3_toxicity,
    "op4_html_extraction": op4_html_extraction,
    "op5_chat_format": op5_chat_format,
    "op6_token_records": op6_token_records,
    "op7_decontaminate": op7_decontaminate,
    "op8_secret_scan": op8_secret_scan,
    "op9_license_scan": op9_license_scan,
    "op10_exact_topk": op10_exact_topk,
    "op11_source_mix": op11_source_mix,
    "op12_lexical_search": op12_lexical_search,
    "op13_infill": op13_infill,
}

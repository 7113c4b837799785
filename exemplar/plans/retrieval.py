"""End-to-end retrieval of few-shot context.

benchmark -> skip empty cases, default ids (P2) -> embed + features (R4) ->
two-stage retrieval (R2) -> example text joined back by id -> one nested
``retrieved_context`` row per case (D9) -> JSON partitioned by embedder and
language (S3).

The join back to the index text is the only join against the corpus; its
probe side is bounded by (number of queries x k), so it is broadcast when
that bound is under the limit and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code import with_code_features
from ..functions.vectors import vector_status
from ..operators.layout import ordinal
from ..operators.rerank import DEFAULT_POOL, retrieve
from ..session import checkpoint_dir

BROADCAST_RESULTS_LIMIT = 64 << 20


def _qkey() -> "F.Column":
    """Case key: ids repeat across language splits, so the key includes the language."""
    return F.concat_ws("\u0001", F.coalesce(F.col("lang"), F.lit("")), F.col("id").cast("string"))


def prepare_cases(bench: DataFrame, position_col: str = "pos") -> DataFrame:
    """Drop cases without focal code.  When the input has no ``id``
    field, ids are ``case_{i}`` with i the 1-based position of the case within
    its language (``position_col`` gives the input order)."""
    df = bench
    if "id" not in df.columns:
        if position_col not in df.columns:
            raise ValueError(f"no id column and no {position_col!r} column to number the cases")
        df = ordinal(df, [position_col], ["lang"], name="_i")
        df = df.withColumn("id", F.concat(F.lit("case_"), (F.col("_i") + 1).cast("string"))).drop("_i")
    return df.where(F.col("focal_code").isNotNull() & (F.length("focal_code") > 0))


def process_queries(cases: DataFrame, embedder) -> DataFrame:
    """R4 for a table of cases: vector, its shape and status, and features."""
    q = embedder.transform(cases, "focal_code", "embedding")
    q = q.select(
        "*",
        F.size("embedding").alias("embedding_dim"),
        vector_status("embedding", embedder.embedding_dim).alias("embedding_status"),
    )
    return with_code_features(q, "focal_code", prefix="q_").withColumnRenamed("q_lang", "q_lang_detected")


def embedded_cases(bench: DataFrame, embedder) -> DataFrame:
    """Prepared and embedded cases, checkpointed to the shared checkpoint
    folder: the query side is read by several jobs (size check, broadcast,
    join back), and the checkpoint also cuts its lineage so a lost executor
    does not re-embed it."""
    checkpoint_dir(bench.sparkSession)
    return process_queries(prepare_cases(bench), embedder).checkpoint(eager=True)


def retrieve_context(
    bench: DataFrame,
    index: DataFrame,
    embedder,
    k: int = 3,
    threshold: float = 0.0,
    *,
    enable_reranking: bool = True,
    pool_size: int = DEFAULT_POOL,
    weights=None,
    metric: str = "cosine",
    cases: DataFrame | None = None,
) -> DataFrame:
    """Flat results: one row per (case, rank) with the example text.
    ``cases`` = ``embedded_cases(bench, embedder)`` when already computed."""
    if cases is None:
        cases = embedded_cases(bench, embedder)
    cases = cases.where(F.col("embedding_status") == "ok")
    queries = cases.select(
        _qkey().alias("query_id"),
        "embedding",
        F.col("q_method_name").alias("method_name"),
        F.col("q_param_count").alias("param_count"),
    )
    corpus = index.where(vector_status("embedding") == "ok").select(
        "example_id", "embedding", "method_name", "param_count"
    )
    hits = retrieve(
        queries, corpus, k, threshold,
        enable_reranking=enable_reranking, pool_size=pool_size, weights=weights, metric=metric,
    )
    text = index.select("example_id", "focal_method", "unit_test", "metadata", F.col("method_name").alias("example_method_name"), F.col("param_count").alias("example_param_count"))
    n_q = queries.count()
    if n_q * k * 32 <= BROADCAST_RESULTS_LIMIT:
        hits = F.broadcast(hits)
    out = hits.join(text, "example_id")
    meta = cases.select(_qkey().alias("query_id"), F.col("id"), "lang", F.col("focal_code").alias("query_focal_method"))
    return out.join(meta, "query_id")


def nest_context(flat: DataFrame, cases: DataFrame, embedder_name: str) -> DataFrame:
    """``{id, retrieved_context: {focal_method, status, error, results}}``
    per case (``cases`` = ``prepare_cases(bench)``; a case without hits gets an
    empty list); results ordered by rank (at most k per case, so the
    collect_list is bounded)."""
    has_rerank = "embedding_score" in flat.columns
    result = F.struct(
        F.col("rank").alias("rank"),
        F.struct("focal_method", "unit_test", "metadata").alias("example"),
        F.col("score").cast("double").alias("similarity_score"),
        F.col("retrieval_method"),
        (
            F.struct(
                F.col("embedding_score").alias("embedding"),
                F.col("name_score").alias("method_name"),
                F.col("signature_score").alias("signature"),
                F.col("score").alias("combined"),
            )
            if has_rerank
            else F.lit(None).cast("struct<embedding:double,method_name:double,signature:double,combined:double>")
        ).alias("rerank_scores"),
        F.struct(
            F.col("example_method_name").alias("method_name"), F.col("example_param_count").alias("param_count")
        ).alias("extracted_features"),
    )
    g = flat.groupBy("query_id").agg(F.sort_array(F.collect_list(result)).alias("results"))
    # a case whose vector is unusable is reported, the others go on
    status = F.col("embedding_status") if "embedding_status" in cases.columns else F.lit("ok")
    meta = cases.select(
        _qkey().alias("query_id"), "id", "lang", F.col("focal_code").alias("query_focal_method"), status.alias("_status")
    )
    g = meta.join(g, "query_id", "left").withColumn(
        "results", F.coalesce(F.col("results"), F.array().cast(g.schema["results"].dataType))
    )
    return g.select(
        "id",
        "lang",
        F.lit(embedder_name).alias("embedder"),
        F.struct(
            F.col("query_focal_method").alias("focal_method"),
            F.when(F.col("_status") == "ok", "success").otherwise("error").alias("status"),
            F.when(F.col("_status") != "ok", F.concat(F.lit("embedding: "), F.col("_status"))).alias("error"),
            "results",
        ).alias("retrieved_context"),
    )


def retrieval_job(bench: DataFrame, index: DataFrame, embedder, k: int = 3, threshold: float = 0.0, **options) -> DataFrame:
    """Nested retrieved context for every case of the benchmark."""
    cases = embedded_cases(bench, embedder)
    flat = retrieve_context(bench, index, embedder, k, threshold, cases=cases, **options)
    return nest_context(flat, cases, embedder.name)


def write_context(nested: DataFrame, out_dir: str) -> None:
    """S3: ``<out>/embedder=<e>/lang=<l>/part-*.json``."""
    nested.write.mode("overwrite").partitionBy("embedder", "lang").json(out_dir)


def create_full_pipeline(spark, embedder=None, top_k: int = 5, threshold: float = 0.5, index=None):
    """One call returning a configured retrieval function and the index
    object (the device argument of the original has no meaning here)."""
    from ..functions.embedders import HashedEmbedder
    from ..sources.index_store import ExampleIndex

    emb = embedder or HashedEmbedder()
    idx = index or ExampleIndex(spark, emb)

    def run(bench: DataFrame, **options) -> DataFrame:
        return retrieval_job(bench, idx.rows, emb, k=options.pop("k", top_k), threshold=options.pop("threshold", threshold), **options)

    return run, idx

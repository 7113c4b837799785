"""Registered queries (Spark) and their DuckDB oracle SQL.

Each ``Q_*`` builder takes (spark, sf_dir) and returns a DataFrame over whole
tables.  ``SQL`` holds the matching oracle text.  Scores and sums of doubles
are exposed rounded to 6 decimals so the two engines' summation order does not
matter; ranking always happens on the unrounded value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import compare, stats
from ..operators.knn import dense_topk
from ..operators.layout import spread
from ..session import scratch_path, written
from ..sources.tables import table
from . import standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------- vectors --

_VEC_SQL = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _dense(spark: SparkSession, sf: str, metric: str, k: int) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    c = emb.select(F.col("vec_id").alias("example_id"), "embedding")
    return dense_topk(q, c, k, metric)


@register(
    "dense_topk_cosine",
    _VEC_SQL
    + """,
    n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS nrm FROM v),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS example_id,
                 list_dot_product(q.e, c.e) / ((q.nrm + 1e-8) * (c.nrm + 1e-8)) AS score
          FROM n q, n c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, example_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def q_dense_topk_cosine(spark, sf):
    return _dense(spark, sf, "cosine", 5).withColumn("score", F.round("score", 6))


@register(
    "dense_topk_euclidean",
    _VEC_SQL
    + """,
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS example_id,
                 0.0 - sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
          FROM v q, v c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, example_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def q_dense_topk_euclidean(spark, sf):
    return _dense(spark, sf, "euclidean", 5).withColumn("score", F.round("score", 6))


@register(
    "retrieval_quality",
    _VEC_SQL
    + """,
    n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS nrm FROM v),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS example_id,
                 list_dot_product(q.e, c.e) / ((q.nrm + 1e-8) * (c.nrm + 1e-8)) AS score
          FROM n q, n c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank FROM s),
    p AS (SELECT * FROM r WHERE rank <= 50)
    SELECT query_id, count(score) AS total_retrieved, count(*) FILTER (WHERE score >= 0.3) AS filtered_count,
           round(avg(score), 6) AS avg_similarity, round(stddev_samp(score), 6) AS std_similarity,
           round(max(score), 6) AS max_similarity,
           coalesce(count(*) FILTER (WHERE score >= 0.3) >= 1 AND avg(score) >= 0.0
                    AND count(*) FILTER (WHERE score <> 0.0) > 0, false) AS passed,
           CAST(0.3 AS DOUBLE) AS similarity_threshold
    FROM p GROUP BY query_id""",
)
def q_retrieval_quality(spark, sf):
    pool = _dense(spark, sf, "cosine", 50)
    out = stats.retrieval_quality(pool, threshold=0.3, min_avg=0.0)
    return out.select(
        "query_id",
        "total_retrieved",
        "filtered_count",
        *[F.round(c, 6).alias(c) for c in ("avg_similarity", "std_similarity", "max_similarity")],
        "passed",
        "similarity_threshold",
    )


_RELAX = (0.5, 0.4, 0.3, 0.2)


@register(
    "retrieval_relaxed",
    _VEC_SQL
    + """,
    n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS nrm FROM v),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS example_id,
                 list_dot_product(q.e, c.e) / ((q.nrm + 1e-8) * (c.nrm + 1e-8)) AS score
          FROM n q, n c WHERE c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank FROM s),
    a AS (SELECT query_id, count(score) AS total_retrieved, avg(score) AS avg_similarity,
                 count(*) FILTER (WHERE score <> 0.0) AS nonzero, """
    + ", ".join(f"count(*) FILTER (WHERE score >= {t}) AS c{i}" for i, t in enumerate(_RELAX))
    + """
          FROM r WHERE rank <= 50 GROUP BY query_id),
    b AS (SELECT *, avg_similarity >= 0.0 AND nonzero > 0 AS ok_base FROM a)
    SELECT query_id, total_retrieved,
           CAST(CASE """
    + " ".join(f"WHEN ok_base AND c{i} >= 1 THEN {t}" for i, t in enumerate(_RELAX))
    + f" ELSE {_RELAX[-1]} END AS DOUBLE) AS similarity_threshold, CASE "
    + " ".join(f"WHEN ok_base AND c{i} >= 1 THEN c{i}" for i in range(len(_RELAX)))
    + f" ELSE c{len(_RELAX) - 1} END AS filtered_count,"
    + """
           round(avg_similarity, 6) AS avg_similarity,
           coalesce(ok_base AND ("""
    + " OR ".join(f"c{i} >= 1" for i in range(len(_RELAX)))
    + """), false) AS passed
    FROM b""",
)
def q_retrieval_relaxed(spark, sf):
    """A9 self-correction: the first of the decreasing thresholds at which
    each vector's top-50 cosine neighbours (itself left out) pass.  The own
    vector has the highest cosine, so it is always within the top 51: the
    top 51 minus itself are exactly the top 50 of the others."""
    pool = _dense(spark, sf, "cosine", 51).where(F.col("example_id") != F.col("query_id"))
    out = stats.relaxed_retrieval(pool, _RELAX, min_avg=0.0)
    return out.select(
        "query_id",
        "total_retrieved",
        "similarity_threshold",
        F.col("filtered_count").cast("long").alias("filtered_count"),
        F.round("avg_similarity", 6).alias("avg_similarity"),
        "passed",
    )


@register(
    "vector_checks",
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim,
       CASE WHEN embedding IS NULL THEN 'null'
            WHEN len(embedding) <> 64 THEN 'wrong_dim'
            WHEN len(list_filter(embedding, lambda x: isnan(x) OR abs(x) = 'inf'::DOUBLE)) > 0 THEN 'non_finite'
            ELSE 'ok' END AS status,
       round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm
    FROM embeddings""",
)
def q_vector_checks(spark, sf):
    emb = table(spark, sf, "embeddings")
    return emb.select(
        "vec_id",
        F.size("embedding").alias("dim"),
        V.vector_status("embedding", 64).alias("status"),
        F.round(V.norm("embedding"), 6).alias("norm"),
    )


@register(
    "vector_blend",
    _VEC_SQL
    + """,
    x AS (SELECT e.label, u.i, u.x FROM embeddings e, unnest(CAST(e.embedding AS DOUBLE[])) WITH ORDINALITY AS u(x, i)),
    c AS (SELECT label, list(avg_x ORDER BY i) AS centroid
          FROM (SELECT label, i, avg(x) AS avg_x FROM x GROUP BY label, i) GROUP BY label)
    SELECT e.vec_id,
           list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), c.centroid),
                          lambda p: round((1.0 - 0.3) * p[1] + 0.3 * p[2], 6)) AS blended
    FROM embeddings e JOIN c ON e.label = c.label""",
)
def q_vector_blend(spark, sf):
    """V7 with the class centroid as the second vector: whole vectors are added up within the tasks."""
    emb = table(spark, sf, "embeddings")
    cent = V.mean_vectors(emb, "label", "embedding")
    j = emb.join(cent, "label")
    return j.select(
        "vec_id", F.transform(V.blend("embedding", "centroid", 0.3), lambda x: F.round(x, 6)).alias("blended")
    )


# ------------------------------------------------------------ comparisons --

_RES = f"WITH res AS ({standins.RUN_RESULTS_SQL})"


def _snake_detailed(df: DataFrame, keys: list[str], metric: str, avg: bool) -> DataFrame:
    p = "Avg " if avg else ""
    return df.select(
        *[F.col(k).alias(k.lower()) for k in keys],
        F.col(f"`{p}Standard {metric}`").alias("standard"),
        F.col(f"`{p}Few-Shot {metric}`").alias("fewshot"),
        F.col("`Absolute Diff`").alias("absolute_diff"),
        F.col("`Relative Improvement (%)`").alias("relative_improvement"),
    )


def _cmp_sql(keys: str, value: str) -> str:
    return (
        _RES
        + f""",
    piv AS (SELECT {keys},
                   {value.format(mode='standard')} AS standard,
                   {value.format(mode='fewshot')} AS fewshot
            FROM res GROUP BY {keys})
    SELECT {', '.join(k.strip() + ' AS ' + k.strip().strip('"').lower() for k in keys.split(','))},
           standard, fewshot, round_even(fewshot - standard, 4) AS absolute_diff,
           coalesce(round_even((fewshot - standard) / nullif(standard, 0) * 100, 2), 0.0) AS relative_improvement
    FROM piv WHERE standard IS NOT NULL OR fewshot IS NOT NULL"""
    )


@register(
    "comparison_detailed",
    _cmp_sql('"Language", "Model"', 'max("Test Pass Rate (%)") FILTER (WHERE "Mode" = \'{mode}\')'),
)
def q_comparison_detailed(spark, sf):
    res = standins.run_results(spark, sf)
    return _snake_detailed(compare.detailed_comparison(res), ["Language", "Model"], compare.DEFAULT_METRIC, False)


@register(
    "comparison_by_language",
    _cmp_sql('"Language"', 'avg("Compiled Rate (%)") FILTER (WHERE "Mode" = \'{mode}\')'),
)
def q_comparison_by_language(spark, sf):
    res = standins.run_results(spark, sf)
    m = "Compiled Rate (%)"
    return _snake_detailed(compare.summary_by_language(res, m), ["Language"], m, True)


@register(
    "comparison_by_model",
    _cmp_sql('"Model"', 'avg("Branch Coverage (%)") FILTER (WHERE "Mode" = \'{mode}\')'),
)
def q_comparison_by_model(spark, sf):
    res = standins.run_results(spark, sf)
    m = "Branch Coverage (%)"
    return _snake_detailed(compare.summary_by_model(res, m), ["Model"], m, True)


@register(
    "comparison_report",
    _RES
    + """,
    long AS (UNPIVOT res ON "Compiled Rate (%)", "Branch Coverage (%)", "Line Coverage (%)", "Test Pass Rate (%)", "Invocation Rate (%)"
             INTO NAME metric VALUE value),
    v AS (SELECT 'detailed' AS view, metric, "Language" AS language, "Model" AS model,
                 max(value) FILTER (WHERE "Mode" = 'standard') AS s, max(value) FILTER (WHERE "Mode" = 'fewshot') AS f FROM long GROUP BY 2, 3, 4
          UNION ALL
          SELECT 'by_language', metric, "Language", NULL, avg(value) FILTER (WHERE "Mode" = 'standard'), avg(value) FILTER (WHERE "Mode" = 'fewshot')
          FROM long GROUP BY 2, 3
          UNION ALL
          SELECT 'by_model', metric, NULL, "Model", avg(value) FILTER (WHERE "Mode" = 'standard'), avg(value) FILTER (WHERE "Mode" = 'fewshot')
          FROM long GROUP BY 2, 4),
    p AS (SELECT view, metric, language, model, s AS standard, f AS fewshot, round_even(f - s, 4) AS absolute_diff,
                 coalesce(round_even((f - s) / nullif(s, 0) * 100, 2), 0.0) AS relative_improvement FROM v WHERE s IS NOT NULL OR f IS NOT NULL),
    a AS (SELECT metric, avg(value) FILTER (WHERE "Mode" = 'standard') AS s, avg(value) FILTER (WHERE "Mode" = 'fewshot') AS f FROM long GROUP BY metric)
    SELECT view, metric, CAST(row_number() OVER (PARTITION BY view, metric ORDER BY CASE WHEN view = 'by_model' THEN -relative_improvement END, language, model) AS INTEGER) AS position,
           language, model, standard, fewshot, absolute_diff, relative_improvement FROM p
    UNION ALL
    SELECT 'consolidated', metric, CAST(list_position(['Compiled Rate (%)', 'Branch Coverage (%)', 'Line Coverage (%)', 'Test Pass Rate (%)', 'Invocation Rate (%)'], metric) AS INTEGER),
           NULL, NULL, round_even(s, 4), round_even(f, 4), round_even(f - s, 4), round_even(CASE WHEN s > 0 THEN (f - s) / s * 100 ELSE 0.0 END, 2) FROM a""",
)
def q_comparison_report(spark, sf):
    """The runs written as a tree of summaries, read by path, and all reports of all metrics in their order."""
    from ..sources.summaries import SUMMARY_KEYS, read_summaries

    res = standins.run_results(spark, sf)
    path = scratch_path(spark, "summaries")
    keys = [F.col(f"`{name}`").alias(key) for key, name in SUMMARY_KEYS]
    tree = res.select("Language", "Mode", "Model", *keys).repartition("Language", "Mode", "Model")
    tree.write.partitionBy("Language", "Mode", "Model").json(path)
    out = compare.report_table(read_summaries(spark, path, file="part-*"))
    named = [F.col("Language").alias("language"), F.col("Model").alias("model")]
    return out.select("view", "metric", "position", *named, "standard", "fewshot", "absolute_diff", "relative_improvement")


_METRIC_NAMES = ", ".join(f"('{m}', {i})" for i, m in enumerate(compare.METRICS))


@register(
    "comparison_consolidated",
    _RES
    + """,
    long AS (UNPIVOT res ON "Compiled Rate (%)", "Branch Coverage (%)", "Line Coverage (%)", "Test Pass Rate (%)", "Invocation Rate (%)"
             INTO NAME metric VALUE value),
    a AS (SELECT metric, avg(value) FILTER (WHERE "Mode" = 'standard') AS s,
                 avg(value) FILTER (WHERE "Mode" = 'fewshot') AS f FROM long GROUP BY metric)
    SELECT metric, round_even(s, 4) AS avg_standard, round_even(f, 4) AS avg_fewshot,
           round_even(f - s, 4) AS absolute_diff,
           round_even(CASE WHEN s > 0 THEN (f - s) / s * 100 ELSE 0.0 END, 2) AS improvement_pct
    FROM a""",
)
def q_comparison_consolidated(spark, sf):
    res = standins.run_results(spark, sf)
    out = compare.consolidated_summary(res)
    return out.select(
        F.col("Metric").alias("metric"),
        F.col("`Avg Standard`").alias("avg_standard"),
        F.col("`Avg Few-Shot`").alias("avg_fewshot"),
        F.col("`Absolute Diff`").alias("absolute_diff"),
        F.col("`Improvement (%)`").alias("improvement_pct"),
    )


@register(
    "comparison_wins",
    _RES
    + """,
    piv AS (SELECT "Language", "Model",
                   max("Line Coverage (%)") FILTER (WHERE "Mode" = 'standard') AS s,
                   max("Line Coverage (%)") FILTER (WHERE "Mode" = 'fewshot') AS f
            FROM res GROUP BY 1, 2)
    SELECT 'Line Coverage (%)' AS metric, CAST(count(*) FILTER (WHERE f > s) AS BIGINT) AS wins,
           count(*) AS total, round(count(*) FILTER (WHERE f > s) * 100.0 / count(*), 6) AS win_pct
    FROM piv WHERE s IS NOT NULL OR f IS NOT NULL""",
)
def q_comparison_wins(spark, sf):
    res = standins.run_results(spark, sf)
    m = "Line Coverage (%)"
    det = compare.detailed_comparison(res, m)
    w = compare.wins(det, m)
    return w.select("metric", "wins", "total", F.round("win_pct", 6).alias("win_pct"))


@register(
    "comparison_overall",
    _RES
    + """
    SELECT 'Test Pass Rate (%)' AS metric,
           round(avg("Test Pass Rate (%)") FILTER (WHERE "Mode" = 'standard'), 6) AS avg_standard,
           round(avg("Test Pass Rate (%)") FILTER (WHERE "Mode" = 'fewshot'), 6) AS avg_fewshot,
           round(coalesce(CASE WHEN avg("Test Pass Rate (%)") FILTER (WHERE "Mode" = 'standard') > 0
                 THEN (avg("Test Pass Rate (%)") FILTER (WHERE "Mode" = 'fewshot')
                       - avg("Test Pass Rate (%)") FILTER (WHERE "Mode" = 'standard'))
                      / avg("Test Pass Rate (%)") FILTER (WHERE "Mode" = 'standard') * 100 ELSE 0.0 END, 0.0), 6)
             AS improvement_pct
    FROM res""",
)
def q_comparison_overall(spark, sf):
    res = standins.run_results(spark, sf)
    o = compare.overall_statistics(res)
    return o.select("metric", *[F.round(c, 6).alias(c) for c in ("avg_standard", "avg_fewshot", "improvement_pct")])


# -------------------------------------------------------------- run stats --


@register(
    "run_summary",
    f"""WITH log AS ({standins.RUN_LOG_SQL})
    SELECT model, count(*) AS runs, count(*) FILTER (WHERE success) AS successful,
           count(*) FILTER (WHERE NOT success) AS failed, round(sum(elapsed_time) / 60.0, 6) AS elapsed_time_min
    FROM log GROUP BY model""",
)
def q_run_summary(spark, sf):
    s = stats.run_summary(standins.run_log(spark, sf))
    return s.withColumn("elapsed_time_min", F.round("elapsed_time_min", 6))


@register(
    "run_totals",
    f"""WITH log AS ({standins.RUN_LOG_SQL})
    SELECT count(*) AS total, count(*) FILTER (WHERE success) AS successful,
           count(*) FILTER (WHERE NOT success) AS failed, round(sum(elapsed_time) / 60.0, 6) AS total_minutes
    FROM log""",
)
def q_run_totals(spark, sf):
    return stats.run_totals(standins.run_log(spark, sf)).withColumn("total_minutes", F.round("total_minutes", 6))


@register(
    "step_counts",
    f"""WITH m AS ({standins.MANIFEST_SQL})
    SELECT step, count(*) AS total, count(*) FILTER (WHERE status = 'processed') AS processed,
           count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed
    FROM m GROUP BY step""",
)
def q_step_counts(spark, sf):
    return stats.step_counts(standins.manifest(spark, sf))


@register(
    "cost_estimate",
    """SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'standard' ELSE 'fewshot' END AS mode, count(*) AS n_tasks,
              sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) AS tokens_in, sum(5 * 1024) AS tokens_out,
              round((sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) * 2.5 + sum(5 * 1024) * 10.0) / 1e6, 6) AS cost_usd
       FROM documents GROUP BY 1, 2""",
)
def q_cost_estimate(spark, sf):
    d = table(spark, sf, "documents")
    tasks = d.select(
        "lang",
        F.when(F.col("doc_id") % 2 == 0, "standard").otherwise("fewshot").alias("mode"),
        F.ceil(F.col("n_chars") / F.lit(4.0)).cast("long").alias("tokens_in"),
        F.lit(5 * 1024).alias("tokens_out"),
    )
    out = stats.cost_estimate(tasks, ["lang", "mode"])
    return out.withColumn("tokens_out", F.col("tokens_out").cast("long")).withColumn(
        "cost_usd", F.round("cost_usd", 6)
    )


@register(
    "pending_files",
    """SELECT doc_id, lang, source FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def q_pending_files(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    done = table(spark, sf, "labels").select("doc_id")
    return stats.pending(d, done, "doc_id")


@register(
    "documents_by_lang",
    "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
)
def q_documents_by_lang(spark, sf):
    return stats.counts_by(table(spark, sf, "documents"), "lang")


# ---------------------------------------------------------- code features --

from ..functions import code as C  # noqa: E402
from ..functions.lexer import lexed  # noqa: E402
from ..functions.similarity import name_similarity  # noqa: E402
from ..operators import rerank as RR  # noqa: E402
from ..operators.bm25 import bm25_topk  # noqa: E402
from . import oracle_sql as O  # noqa: E402

_FEAT_SQL = f"""code AS (SELECT p_partkey, {standins.CODE_SQL} AS code FROM part),
    lc AS (SELECT p_partkey, code, {O.detect_language('code')} AS lang FROM code),
    feat AS (SELECT p_partkey, lang, {O.method_name('code', 'lang')} AS method_name,
                    {O.param_count('code', 'lang')} AS param_count FROM lc)"""


def _features(spark, sf) -> DataFrame:
    return C.with_code_features(spread(standins.code_snippets(spark, sf)), "code").select(
        "p_partkey", "lang", "method_name", "param_count"
    )


@register("code_features", f"WITH {_FEAT_SQL} SELECT p_partkey, lang, method_name, param_count FROM feat")
def q_code_features(spark, sf):
    return _features(spark, sf)


@register("lexed_segments", O.lexed_segments(f"SELECT p_partkey, {standins.LEX_LANG_SQL} AS lang, {standins.LEX_SQL} AS code FROM part"))
def q_lexed_segments(spark, sf):
    """The lexer under X1, X2, X5 and X6: every comment and literal of every text, in order."""
    found = lexed("code", F.col("lang"))
    said = F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string")))
    return standins.lexer_texts(spark, sf).select("p_partkey", "lang", F.array_join(said, ",").alias("segments"))


@register(
    "param_similarity",
    f"""WITH {_FEAT_SQL}
    SELECT a.p_partkey, b.p_partkey AS next_partkey, a.param_count AS a_params, b.param_count AS b_params,
           {O.param_similarity('a.param_count', 'b.param_count')} AS signature_score
    FROM feat a JOIN feat b ON b.p_partkey = a.p_partkey + 1""",
)
def q_param_similarity(spark, sf):
    f = _features(spark, sf)
    a = f.select("p_partkey", F.col("param_count").alias("a_params"))
    b = f.select(F.col("p_partkey").alias("next_partkey"), F.col("param_count").alias("b_params"))
    j = a.join(b, F.col("next_partkey") == F.col("p_partkey") + 1)
    return j.select(
        "p_partkey", "next_partkey", "a_params", "b_params", C.param_similarity("a_params", "b_params").alias("signature_score")
    )


@register(
    "name_similarity",
    f"""WITH RECURSIVE {_FEAT_SQL},
    np AS (SELECT a.p_partkey AS pid, b.p_partkey AS next_partkey, a.method_name AS a_name, b.method_name AS b_name,
                  lower(a.method_name) AS a, lower(b.method_name) AS b
           FROM feat a JOIN feat b ON b.p_partkey = a.p_partkey + 1),
    {O.name_ratio_ctes('np')}
    SELECT np.pid AS p_partkey, np.next_partkey, np.a_name, np.b_name, round(r.name_score, 12) AS name_score
    FROM np JOIN ratio_out r ON r.pid = np.pid""",
)
def q_name_similarity(spark, sf):
    """C4 between each part's method name and the next part's."""
    f = _features(spark, sf)
    a = f.select("p_partkey", F.col("method_name").alias("a_name"))
    b = f.select(F.col("p_partkey").alias("next_partkey"), F.col("method_name").alias("b_name"))
    j = a.join(b, F.col("next_partkey") == F.col("p_partkey") + 1)
    return j.select(
        "p_partkey", "next_partkey", "a_name", "b_name", F.round(name_similarity("a_name", "b_name"), 12).alias("name_score")
    )


def _index(spark, sf) -> DataFrame:
    """Vectors of `embeddings` with the code features of the part of the same key.

    An index is built once: only texts of a vector are parsed, and the rows are written, for the search reads them
    several times."""
    emb = table(spark, sf, "embeddings")
    texts = standins.code_snippets(spark, sf).join(emb, F.col("p_partkey") == emb.vec_id, "left_semi")
    features = C.with_code_features(spread(texts), "code").select("p_partkey", "method_name", "param_count")
    rows = emb.join(features, emb.vec_id == F.col("p_partkey"), "left")
    return written(rows.select("vec_id", "embedding", "method_name", "param_count"), "index")


_NO_NAME = {"embedding": 0.6, "method_name": 0.0, "signature": 0.2}


def _rerank_query(spark, sf, weights):
    idx = _index(spark, sf)
    queries = idx.select(F.col("vec_id").alias("query_id"), "embedding", "method_name", "param_count")
    corpus = idx.select(F.col("vec_id").alias("example_id"), "embedding", "method_name", "param_count")
    return RR.retrieve(queries, corpus, k=5, threshold=0.3, pool_size=50, weights=weights)


_W = RR.normalize_weights(_NO_NAME)


@register(
    "rerank_no_name",
    f"""WITH {_FEAT_SQL},
    v AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS e, f.param_count
          FROM embeddings e LEFT JOIN feat f ON f.p_partkey = e.vec_id),
    n AS (SELECT *, sqrt(list_dot_product(e, e)) AS nrm FROM v),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS example_id,
                 list_dot_product(q.e, c.e) / ((q.nrm + 1e-8) * (c.nrm + 1e-8)) AS es,
                 q.param_count AS qp, c.param_count AS cp FROM n q, n c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY es DESC, example_id) AS r1 FROM s),
    p AS (SELECT query_id, example_id, r1, es, {O.param_similarity('qp', 'cp')} AS ss FROM r WHERE r1 <= 50),
    c AS (SELECT *, CAST({_W['embedding']!r} AS DOUBLE) * es + CAST({_W['method_name']!r} AS DOUBLE) * 0.0::DOUBLE
                    + CAST({_W['signature']!r} AS DOUBLE) * ss AS score FROM p),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1) AS rank FROM c)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, example_id, round(score, 6) AS score,
           round(es, 6) AS embedding_score, ss AS signature_score, CAST(r1 AS INTEGER) AS first_stage_rank
    FROM r2 WHERE rank <= 5 AND score >= 0.3""",
)
def q_rerank_no_name(spark, sf):
    r = _rerank_query(spark, sf, _NO_NAME)
    return r.select(
        "query_id",
        "rank",
        "example_id",
        F.round("score", 6).alias("score"),
        F.round("embedding_score", 6).alias("embedding_score"),
        "signature_score",
        "first_stage_rank",
    )


_WF = RR.normalize_weights(None)


@register(
    "rerank_full",
    f"""WITH RECURSIVE {_FEAT_SQL},
    v AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS e, f.method_name, f.param_count
          FROM embeddings e LEFT JOIN feat f ON f.p_partkey = e.vec_id),
    n AS (SELECT *, sqrt(list_dot_product(e, e)) AS nrm FROM v),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS example_id,
                 list_dot_product(q.e, c.e) / ((q.nrm + 1e-8) * (c.nrm + 1e-8)) AS es,
                 q.param_count AS qp, c.param_count AS cp, q.method_name AS qn, c.method_name AS cn FROM n q, n c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY es DESC, example_id) AS r1 FROM s),
    p AS (SELECT query_id, example_id, r1, es, {O.param_similarity('qp', 'cp')} AS ss, qn, cn,
                 row_number() OVER (ORDER BY query_id, r1) AS pid FROM r WHERE r1 <= 50),
    pp AS (SELECT pid, lower(coalesce(qn, '')) AS a, lower(coalesce(cn, '')) AS b FROM p),
    {O.name_ratio_ctes('pp')},
    c AS (SELECT p.*, ro.name_score AS ns,
                 CAST({_WF['embedding']!r} AS DOUBLE) * es + CAST({_WF['method_name']!r} AS DOUBLE) * ro.name_score
                 + CAST({_WF['signature']!r} AS DOUBLE) * ss AS score
          FROM p JOIN ratio_out ro ON ro.pid = p.pid),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1) AS rank FROM c)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, example_id, round(score, 6) AS score, round(es, 6) AS embedding_score,
           round(ns, 12) AS name_score, ss AS signature_score, CAST(r1 AS INTEGER) AS first_stage_rank,
           'unknown_reranked' AS retrieval_method
    FROM r2 WHERE rank <= 5 AND score >= 0.3""",
)
def q_rerank_full(spark, sf):
    """C8 with the default weights (name similarity via difflib)."""
    r = _rerank_query(spark, sf, None)
    return r.select(
        "query_id",
        "rank",
        "example_id",
        F.round("score", 6).alias("score"),
        F.round("embedding_score", 6).alias("embedding_score"),
        F.round("name_score", 12).alias("name_score"),
        "signature_score",
        "first_stage_rank",
        "retrieval_method",
    )


# ------------------------------------------------------------------- BM25 --

BM25_SQL = r"""WITH dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS toks FROM documents),
    st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt),
    qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
    qtf AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY 1, 2),
    vocab AS (SELECT DISTINCT term FROM qtf),
    dterms AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM dt),
    tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM dterms WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT q.query_id, q.term,
                 q.qtf * ln(1.0::DOUBLE + (CAST((SELECT n FROM st) AS DOUBLE) - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) AS weight
          FROM qtf q JOIN df ON q.term = df.term),
    s AS (SELECT w.query_id, tf.doc_id,
                 sum(w.weight * (tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.dl / (SELECT avgdl FROM st))))) AS score
          FROM w JOIN tf ON w.term = tf.term GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 5"""


@register("bm25_topk", BM25_SQL)
def q_bm25_topk(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = table(spark, sf, "documents").select("doc_id", "text")
    return bm25_topk(q, d, 5).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------- example pairs --


@register(
    "example_pairs",
    """SELECT u.conv_id, u.turn, u.text AS focal_method, a.text AS unit_test
       FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.text) > 0 AND length(a.text) > 0""",
)
def q_example_pairs(spark, sf):
    from ..sources.corpus import pairs_from_turns

    return pairs_from_turns(table(spark, sf, "conversations"))


# ---------------------------------------------------------------- prompts --

from ..functions import templates as TPL  # noqa: E402
from ..operators import prompts as PR  # noqa: E402
from ..operators.responses import clean_responses  # noqa: E402


def _sql_lit(s: str) -> str:
    out = []
    for i, part in enumerate(s.split("\n")):
        if i:
            out.append("chr(10)")
        out.append("'" + part.replace("'", "''") + "'")
    return " || ".join(x for x in out if x != "''") or "''"


def _render_sql(template: str, fields: dict[str, str]) -> str:
    import re as _re

    parts, pos = [], 0
    for m in _re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(_sql_lit(template[pos : m.start()]))
        parts.append(f"coalesce({fields[m.group(1)]}, '')")
        pos = m.end()
    if pos < len(template):
        parts.append(_sql_lit(template[pos:]))
    return " || ".join(parts)


def _lang_case(per: dict[str, str]) -> str:
    return "(CASE lang " + " ".join(f"WHEN '{l}' THEN {v}" for l, v in per.items()) + " END)"


def _template_sql(code: str) -> str:
    f = {"function_code": code, "function_name": "function_name", "file_path": "file_path"}
    return _lang_case({l: _render_sql(t["instruct"], f) for l, t in TPL.PROMPTS.items()})


_SUFFIX_SQL = _lang_case({l: _render_sql(s, {"function_name": "function_name"}) for l, s in TPL.SUFFIXES.items()})


@register(
    "standard_prompt",
    f"""WITH b AS ({standins.BENCH_SQL}),
    c AS (SELECT *, CASE WHEN class_signature IS NOT NULL AND length(class_signature) > 0
                    THEN class_signature || ' {{' || chr(10) || regexp_replace(focal_code, '(?m)^([^\\S\\n]*\\S)', '    \\1', 'g') || chr(10) || '}}'
                    ELSE focal_code END AS code FROM b)
    SELECT id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY ordinal_in) - 1 AS BIGINT) AS task_id,
           {_template_sql('code')} || {_SUFFIX_SQL} AS question
    FROM c""",
)
def q_standard_prompt(spark, sf):
    out = PR.build_prompts(standins.bench_cases(spark, sf), instruct=True)
    return out.select("id", "lang", "task_id", "question")


def bm25_sql(docs_cte: str, queries_cte: str, k: int, raw_score: bool = False) -> str:
    """Oracle BM25 over CTEs docs(doc_id, text) and queries(query_id, text)."""
    body = BM25_SQL.split("WITH ", 1)[1]
    if raw_score:
        body = body.replace("round(score, 6) AS score", "score")
    body = body.replace("FROM documents)", "FROM docs)").replace("FROM benchmark)", "FROM queries)")
    body = body.replace("SELECT item_id AS query_id,", "SELECT query_id,")
    body = body.replace("WHERE rank <= 5", f"WHERE rank <= {k}")
    return f"WITH docs AS ({docs_cte}), queries AS ({queries_cte}), {body}"


_FEW_HITS = bm25_sql(
    f"SELECT pair_id AS doc_id, focal_method AS text FROM ({standins.PAIRS_SQL})",
    f"SELECT id AS query_id, focal_code AS text FROM ({standins.BENCH_SQL})",
    5,
)


@register(
    "fewshot_prompt",
    f"""WITH hits AS ({_FEW_HITS}),
    pr AS ({standins.PAIRS_SQL}),
    ex AS (SELECT h.query_id,
                  string_agg('Example ' || CAST(h.rank AS VARCHAR) || ':' || chr(10) || pr.focal_method || chr(10) || chr(10) || pr.unit_test,
                             chr(10) || chr(10) ORDER BY h.rank) AS examples
           FROM hits h JOIN pr ON pr.pair_id = h.doc_id GROUP BY h.query_id),
    b AS ({standins.BENCH_SQL})
    SELECT b.id, b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY b.ordinal_in) - 1 AS BIGINT) AS task_id,
           coalesce({_sql_lit(TPL.FEWSHOT_HEADER)} || ex.examples || chr(10) || chr(10), '')
           || {_template_sql('b.focal_code')} || {_SUFFIX_SQL} AS question
    FROM b LEFT JOIN ex ON ex.query_id = b.id""",
)
def q_fewshot_prompt(spark, sf):
    bench = standins.bench_cases(spark, sf)
    out = PR.build_prompts(bench, _bench_contexts(spark, sf, bench), instruct=True, use_fewshot=True)
    return out.select("id", "lang", "task_id", "question")


def _bench_contexts(spark, sf, bench) -> DataFrame:
    """(id, retrieved_context) for every benchmark case: BM25 top 5 over the
    example pairs (an empty list when nothing matches)."""
    pr = standins.pairs(spark, sf)
    hits = bm25_topk(
        bench.select(F.col("id").alias("query_id"), F.col("focal_code").alias("text")),
        pr.select(F.col("pair_id").alias("doc_id"), F.col("focal_method").alias("text")),
        5,
    )
    ex = hits.join(pr, hits.doc_id == pr.pair_id).select(
        "query_id",
        F.struct(
            "rank",
            F.struct("focal_method", "unit_test").alias("example"),
            F.col("score").alias("similarity_score"),
        ).alias("r"),
    )
    grouped = ex.groupBy("query_id").agg(F.sort_array(F.collect_list("r")).alias("results"))
    return bench.select(F.col("id"), F.col("focal_code")).join(grouped, F.col("id") == F.col("query_id"), "left").select(
        "id",
        F.struct(
            F.col("focal_code").alias("focal_method"),
            F.coalesce("results", F.array().cast(grouped.schema["results"].dataType)).alias("results"),
        ).alias("retrieved_context"),
    )


_RAW_HITS = bm25_sql(
    f"SELECT pair_id AS doc_id, focal_method AS text FROM ({standins.PAIRS_SQL})",
    f"SELECT id AS query_id, focal_code AS text FROM ({standins.BENCH_SQL})",
    5,
    raw_score=True,
)
_T11_THRESHOLD = 20.0


@register(
    "threshold_prompt",
    f"""WITH hits AS ({_RAW_HITS}),
    pr AS ({standins.PAIRS_SQL}),
    ex AS (SELECT h.query_id,
                  string_agg('Example ' || CAST(h.rank AS VARCHAR) || ':' || chr(10) || 'Focal Method:' || chr(10) || pr.focal_method
                             || chr(10) || 'Unit Test:' || chr(10) || pr.unit_test || chr(10) || chr(10), '' ORDER BY h.rank) AS blocks
           FROM hits h JOIN pr ON pr.pair_id = h.doc_id WHERE h.score >= {_T11_THRESHOLD} GROUP BY h.query_id),
    b AS ({standins.BENCH_SQL})
    SELECT b.id, CASE WHEN ex.blocks IS NULL THEN 'Generate unit test for:' || chr(10) || b.focal_code
                      ELSE 'Generate a unit test for the following code.' || chr(10) || 'Here are some similar examples:' || chr(10) || chr(10)
                           || ex.blocks || 'Now generate a test for:' || chr(10) || b.focal_code END AS prompt
    FROM b LEFT JOIN ex ON ex.query_id = b.id""",
)
def q_threshold_prompt(spark, sf):
    """T11 over the BM25 context of every benchmark case."""
    bench = standins.bench_cases(spark, sf)
    ctx = _bench_contexts(spark, sf, bench)
    return ctx.select(
        "id",
        PR.threshold_prompt(F.col("retrieved_context.focal_method"), F.col("retrieved_context.results"), _T11_THRESHOLD).alias("prompt"),
    )


_FENCE = "```"


@register(
    "documented_prompt",
    f"""WITH hits AS ({_RAW_HITS}),
    pr AS ({standins.PAIRS_SQL}),
    ex AS (SELECT h.query_id,
                  string_agg('## Example ' || CAST(h.rank AS VARCHAR) || ' (Similarity: ' || printf('%.2f', h.score) || ')' || chr(10) || chr(10)
                             || '### Focal Method:' || chr(10) || '{_FENCE}' || chr(10) || pr.focal_method || chr(10) || '{_FENCE}' || chr(10) || chr(10)
                             || '### Unit Test:' || chr(10) || '{_FENCE}' || chr(10) || pr.unit_test || chr(10) || '{_FENCE}' || chr(10) || chr(10),
                             '' ORDER BY h.rank) AS blocks
           FROM hits h JOIN pr ON pr.pair_id = h.doc_id GROUP BY h.query_id),
    b AS ({standins.BENCH_SQL})
    SELECT b.id, '# Task: Unit Test Generation' || chr(10) || chr(10) || {_sql_lit(PR.DOC_INSTRUCTION)} || chr(10) || chr(10)
                 || '# Examples:' || chr(10) || chr(10) || coalesce(ex.blocks, '')
                 || '# Your Task:' || chr(10) || chr(10) || '### Focal Method:' || chr(10) || '{_FENCE}' || chr(10) || b.focal_code
                 || chr(10) || '{_FENCE}' || chr(10) || chr(10) || '### Unit Test:' || chr(10) || '{_FENCE}' || chr(10)
                 || '# Generate unit test here' || chr(10) || '{_FENCE}' AS prompt
    FROM b LEFT JOIN ex ON ex.query_id = b.id""",
)
def q_documented_prompt(spark, sf):
    """T12 over the BM25 context of every benchmark case."""
    bench = standins.bench_cases(spark, sf)
    ctx = _bench_contexts(spark, sf, bench)
    return ctx.select(
        "id", PR.documented_prompt(F.col("retrieved_context.focal_method"), F.col("retrieved_context.results")).alias("prompt")
    )


_SIG_SQL = (
    "CASE WHEN class_signature IS NOT NULL AND length(class_signature) > 0 THEN class_signature || ' {' || chr(10) || "
    "regexp_replace(focal_code, '(?m)^([^\\S\\n]*\\S)', '    \\1', 'g') || chr(10) || '}' ELSE focal_code END"
)
_DEFS_SQL = (
    "regexp_replace(array_to_string(flatten(list_transform(function_component.argument_definitions, lambda a: a.definitions)), chr(10)),"
    " '^\\s+|\\s+$', '', 'g')"
)


@register(
    "context_prompt",
    f"""WITH f AS ({standins.BENCH_FILES_SQL}),
    t AS (SELECT *, {_template_sql('(' + _SIG_SQL + ')')} AS std0 FROM f),
    u AS (SELECT *, CASE WHEN context IS NOT NULL
                         THEN {_sql_lit(TPL.RAG_OPEN)} || context || {_sql_lit(TPL.RAG_CLOSE)} || std0
                         ELSE {_sql_lit(TPL.FILE_OPEN)} || coalesce(file_path, '') || chr(10)
                              || coalesce(CASE WHEN lang = 'Rust' THEN {O.strip_rust_tests('file_content')} ELSE file_content END, '')
                              || {_sql_lit(TPL.FILE_CLOSE)} || std0 END AS std1 FROM t),
    v AS (SELECT *, CASE WHEN coalesce(len(function_component.argument_definitions) > 0, false)
                         THEN {O.imports("coalesce(file_content, '')", 'lower(lang)')} || chr(10)
                              || (CASE WHEN struct_class IS NOT NULL AND length(struct_class) > 0 THEN chr(10) || chr(10) || struct_class
                                       ELSE {_DEFS_SQL} END)
                              || chr(10) || chr(10) || chr(10) || std1
                         ELSE std1 END AS prompt FROM u)
    SELECT id, prompt || {_SUFFIX_SQL} AS question FROM v""",
)
def q_context_prompt(spark, sf):
    """T3-T5 with X5/X6: instruct prompts with RAG context where a case has
    one, else the file context (Rust files without their tests), and the
    import + argument-definition block."""
    out = PR.build_prompts(
        standins.bench_files(spark, sf), instruct=True, is_rag=True, file_context=True, arg_context=True
    )
    return out.select("id", "question")


_RAG_HITS = bm25_sql(
    f"SELECT pair_id AS doc_id, focal_method AS text FROM ({standins.PAIRS_SQL})",
    f"SELECT id AS query_id, focal_code AS text FROM ({standins.BENCH_SQL})",
    3,
)


@register(
    "rag_prompt",
    f"""WITH hits AS ({_RAG_HITS}), pr AS ({standins.PAIRS_SQL}),
    c AS (SELECT h.query_id AS id, string_agg(pr.unit_test, chr(10) || chr(10) ORDER BY h.rank) AS context
          FROM hits h JOIN pr ON pr.pair_id = h.doc_id GROUP BY h.query_id),
    f AS (SELECT b.*, c.context FROM ({standins.BENCH_SQL}) b LEFT JOIN c ON c.id = b.id),
    t AS (SELECT *, {_template_sql('(' + _SIG_SQL + ')')} AS std0 FROM f)
    SELECT id, (CASE WHEN context IS NOT NULL THEN {_sql_lit(TPL.RAG_OPEN)} || context || {_sql_lit(TPL.RAG_CLOSE)} || std0 ELSE std0 END)
               || {_SUFFIX_SQL} AS question FROM t""",
)
def q_rag_prompt(spark, sf):
    """Prompts whose context is retrieved: the answers of each case's three best pairs, in their order."""
    from ..sources.benchmark import rag_context

    bench, pr = standins.bench_cases(spark, sf), standins.pairs(spark, sf)
    hits = bm25_topk(bench, pr, 3, query_id="id", query_text="focal_code", doc_id="pair_id", doc_text="focal_method")
    texts = pr.select(F.col("pair_id").alias("doc_id"), F.col("unit_test").alias("text"))
    context = rag_context(hits.select("id", "rank", F.col("pair_id").alias("doc_id")), texts, k=3)
    out = PR.build_prompts(bench.join(context, "id", "left"), instruct=True, is_rag=True)
    return out.select("id", "question")


# -------------------------------------------------------------- responses --


@register(
    "clean_responses_julia",
    f"""WITH s AS ({standins.RESPONSES_SQL['julia']}),
    r AS (SELECT conv_id, turn, list_transform(response, lambda x: string_split(prompt, chr(10))[-1] || x) AS raw_response FROM s)
    SELECT conv_id, turn, raw_response,
           list_transform(raw_response, lambda x: '@testset' || CASE WHEN instr(x, '@testset') > 0
                                                  THEN substring(x, instr(x, '@testset') + 8) ELSE x END)[1:10] AS response
    FROM r""",
)
def q_clean_responses_julia(spark, sf):
    return clean_responses(standins.responses(spark, sf, "julia"), "julia")


@register("clean_responses_rust", O.clean_responses("rust", standins.RESPONSES_SQL["rust"]))
def q_clean_responses_rust(spark, sf):
    """X1 on every assistant turn."""
    return clean_responses(standins.responses(spark, sf, "rust"), "rust")


@register("clean_responses_go", O.clean_responses("go", standins.RESPONSES_SQL["go"]))
def q_clean_responses_go(spark, sf):
    """X2 on every assistant turn."""
    return clean_responses(standins.responses(spark, sf, "go"), "go")


@register(
    "clean_stream",
    f"""SELECT conv_id, turn, raw_response, response, CAST(conv_id % 2 + 1 AS INTEGER) AS run
        FROM ({O.clean_responses("rust", standins.RESPONSES_SQL["rust"])})""",
)
def q_clean_stream(spark, sf):
    """The answers arrive in two lots of files; a file stream with a checkpoint cleans the first,
    stops, starts anew and cleans what came since.  Each row tells the run that cleaned it."""
    from ..streaming.incremental import clean_new_files

    samples = standins.responses(spark, sf, "rust")
    root = scratch_path(spark, "clean-stream")
    raw, out, checkpoint = (f"{root}/{name}" for name in ("raw", "out", "checkpoint"))
    for run in (1, 2):
        samples.where(F.col("conv_id") % 2 + 1 == run).write.mode("append").json(raw)
        clean_new_files(spark, raw, out, checkpoint, "rust", schema=samples.schema, run=run)
    done = "conv_id long, turn long, raw_response array<string>, response array<string>, run int"
    return spark.read.schema(done).json(out)


_SRC = """
  SELECT t.doc_id, coalesce(uses, '') || chr(10) || 'mod tests {' || chr(10) || '    use super::*;' || chr(10) || '}'
    || chr(10) || 'fn body() {' || chr(10) || '    // ' || text || chr(10) || '}' AS src
  FROM documents t LEFT JOIN (
    SELECT doc_id, string_agg('use crate::' || w || ';', chr(10) ORDER BY p) AS uses FROM (
      SELECT doc_id, w, min(p) AS p FROM (
        SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
        FROM (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS ws FROM documents)
      ) WHERE w <> '' GROUP BY ALL
    ) GROUP BY doc_id
  ) u ON u.doc_id = t.doc_id
"""


@register("import_context", f"SELECT doc_id, {O.rust_imports('src')} AS imports FROM ({_SRC})")
def q_import_context(spark, sf):
    """X5 over Rust files synthesised from every document: each distinct word
    of the text becomes a ``use`` line, the text itself is the body."""
    from ..functions.text import import_context

    d = spread(table(spark, sf, "documents"))
    uses = F.array_join(
        F.transform(
            F.filter(
                F.array_distinct(F.split(F.lower("text"), r"[^a-z]+")),
                lambda w: w != "",
            ),
            lambda w: F.concat(F.lit("use crate::"), w, F.lit(";")),
        ),
        "\n",
    )
    src = F.concat(uses, F.lit("\nmod tests {\n    use super::*;\n}\nfn body() {\n    // "), F.col("text"), F.lit("\n}"))
    return d.select("doc_id", import_context(F.lit("rust"), src).alias("imports"))


# ------------------------------------------------------ retrieval + prompts --


@register("retrieval_context")
def q_retrieval_context(spark, sf):
    """R3 end to end: example pairs indexed with the hashed embedder, every
    benchmark case retrieved (pool 50, rerank, top 3) and nested per case."""
    from ..functions.embedders import HashedEmbedder
    from ..sources.index_store import build_index
    from .retrieval import retrieval_job

    emb = HashedEmbedder(64)
    corpus = standins.pairs(spark, sf).select(
        F.col("pair_id").alias("example_id"), "focal_method", "unit_test", F.lit("{}").alias("metadata")
    )
    index = written(build_index(corpus, emb), "example-index")
    bench = standins.bench_cases(spark, sf)
    return retrieval_job(bench, index, emb, k=3, threshold=0.0)


def _feat_cols(col: str) -> str:
    lang = O.detect_language(col)
    return f"{lang} AS lang_d, {col} AS txt"


_EMB = O.hashed_embedding_md5


@register(
    "retrieval_flat",
    f"""WITH RECURSIVE pr AS ({standins.PAIRS_SQL}),
    b AS ({standins.BENCH_SQL}),
    c0 AS (SELECT pair_id AS example_id, {_feat_cols('focal_method')}, {_EMB('focal_method', 64)} AS e FROM pr),
    c1 AS (SELECT example_id, e, {O.method_name('txt', 'lang_d')} AS cn, {O.param_count('txt', 'lang_d')} AS cp FROM c0),
    q0 AS (SELECT id, {_feat_cols('focal_code')}, {_EMB('focal_code', 64)} AS e FROM b WHERE focal_code IS NOT NULL AND length(focal_code) > 0),
    q1 AS (SELECT id, e, {O.method_name('txt', 'lang_d')} AS qn, {O.param_count('txt', 'lang_d')} AS qp FROM q0),
    cv AS (SELECT *, CAST(e AS DOUBLE[]) AS d, sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))) AS nrm FROM c1),
    qv AS (SELECT *, CAST(e AS DOUBLE[]) AS d, sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))) AS nrm FROM q1),
    s AS (SELECT q.id, c.example_id, list_dot_product(q.d, c.d) / ((q.nrm + 1e-8) * (c.nrm + 1e-8)) AS es,
                 q.qn, c.cn, q.qp, c.cp FROM qv q, cv c),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY es DESC, example_id) AS r1 FROM s),
    p AS (SELECT id, example_id, r1, es, {O.param_similarity('qp', 'cp')} AS ss, qn, cn,
                 row_number() OVER (ORDER BY id, r1) AS pid FROM r WHERE r1 <= 50),
    pp AS (SELECT pid, lower(coalesce(qn, '')) AS a, lower(coalesce(cn, '')) AS b FROM p),
    {O.name_ratio_ctes('pp')},
    c AS (SELECT p.*, ro.name_score AS ns,
                 CAST({_WF['embedding']!r} AS DOUBLE) * es + CAST({_WF['method_name']!r} AS DOUBLE) * ro.name_score
                 + CAST({_WF['signature']!r} AS DOUBLE) * ss AS score
          FROM p JOIN ratio_out ro ON ro.pid = p.pid),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, r1) AS rank FROM c)
    SELECT id, CAST(rank AS INTEGER) AS rank, example_id, round(score, 6) AS score, round(es, 6) AS embedding_score,
           round(ns, 12) AS name_score, ss AS signature_score, CAST(r1 AS INTEGER) AS first_stage_rank
    FROM r2 WHERE rank <= 3 AND score >= 0.0""",
)
def q_retrieval_flat(spark, sf):
    """R3 as flat rows: example pairs indexed with the md5 hashed embedder,
    every benchmark case embedded, pool 50, rerank with the default weights,
    top 3 with the example text joined back."""
    from ..functions.embedders import HashedEmbedder
    from ..sources.index_store import build_index
    from .retrieval import retrieve_context

    emb = HashedEmbedder(64, hash_fn="md5")
    corpus = standins.pairs(spark, sf).select(
        F.col("pair_id").alias("example_id"), "focal_method", "unit_test", F.lit("{}").alias("metadata")
    )
    flat = retrieve_context(standins.bench_cases(spark, sf), written(build_index(corpus, emb), "example-index"), emb, k=3, threshold=0.0)
    return flat.select(
        "id",
        "rank",
        "example_id",
        F.round("score", 6).alias("score"),
        F.round("embedding_score", 6).alias("embedding_score"),
        F.round("name_score", 12).alias("name_score"),
        "signature_score",
        "first_stage_rank",
    )


_FIRST_TOKENS = "list_slice(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), 1, 20)"


_LINES_SQL = f"""SELECT pair_id % 3 AS part, pair_id, u.k AS k, focal_method, unit_test FROM ({standins.PAIRS_SQL}) p,
    (VALUES (0), (1), (2)) u(k) WHERE u.k = 0 OR (u.k = 1 AND pair_id % 5 = 0) OR (u.k = 2 AND pair_id % 7 = 0)"""


@register(
    "corpus_lines",
    f"""WITH l AS ({_LINES_SQL}),
    n AS (SELECT *, row_number() OVER (ORDER BY part, pair_id, k) - 1 AS line FROM l),
    m AS (SELECT count(*) FILTER (part = 0) + count(*) FILTER (part = 1) // 2 AS most FROM l)
    SELECT line, md5(focal_method) AS focal_md5, md5(unit_test) AS test_md5 FROM n, m WHERE k = 0 AND line < most""",
)
def q_corpus_lines(spark, sf):
    """Pairs as JSON lines in files of unequal size, with corrupt (k = 1) and blank lines (k = 2), read by line
    number up to the middle of the second file; skipped lines count."""
    from ..sources.corpus import numbered_lines, parse_corpus_lines

    p = standins.pairs(spark, sf).withColumn("part", F.col("pair_id") % 3)
    kinds = F.array(F.lit(0), F.when(F.col("pair_id") % 5 == 0, 1), F.when(F.col("pair_id") % 7 == 0, 2))
    lines = p.withColumn("k", F.explode(F.array_compact(kinds)))
    good = F.to_json(F.struct("focal_method", "unit_test"))
    lines = lines.select("part", "pair_id", "k", F.when(F.col("k") == 0, good).when(F.col("k") == 1, "{broken").otherwise("").alias("value"))
    path = scratch_path(spark, "corpus")
    lines.repartition("part").sortWithinPartitions("part", "pair_id", "k").drop("pair_id", "k").write.partitionBy("part").text(path)
    counts = {r["part"]: r["count"] for r in lines.groupBy("part").count().collect()}  # three rows
    read = numbered_lines(spark, f"{path}/*/*").where(F.col("line") < counts.get(0, 0) + counts.get(1, 0) // 2)
    return parse_corpus_lines(read, keep=("line",)).select("line", F.md5("focal_method").alias("focal_md5"), F.md5("unit_test").alias("test_md5"))


@register(
    "output_audit",
    """WITH g AS (SELECT DISTINCT source AS model, l.lang FROM documents, (SELECT DISTINCT lang FROM documents UNION ALL SELECT 'absent') l),
    c AS (SELECT source AS model, lang, count(*) AS lines FROM documents GROUP BY 1, 2)
    SELECT g.model, g.lang, coalesce(c.lines, 0) AS lines, c.lines IS NOT NULL AS found FROM g LEFT JOIN c ON c.model = g.model AND c.lang = g.lang""",
)
def q_output_audit(spark, sf):
    """A line per document written by (source, language), audited against the grid of all sources and languages and one that is not there."""
    from ..sources.audit import audit_outputs

    d = table(spark, sf, "documents")
    path = scratch_path(spark, "outputs")
    out = d.select(F.col("source").alias("embedder"), "lang", F.to_json(F.struct("doc_id")).alias("value"))
    out.repartition("embedder", "lang").write.partitionBy("embedder", "lang").text(path)
    langs = d.select("lang").distinct().unionAll(spark.createDataFrame([("absent",)], "lang string"))
    grid = d.select(F.col("source").alias("model")).distinct().crossJoin(F.broadcast(langs))
    return audit_outputs(spark, path, grid, file_name=None).select("model", "lang", "lines", "found")


@register(
    "embed_batches",
    f"""WITH t AS (SELECT doc_id, array_to_string({_FIRST_TOKENS}, ' ') AS cut FROM documents),
    e AS (SELECT doc_id, {_EMB('cut', 64)} AS e FROM t)
    SELECT doc_id, CAST(len(e) AS INTEGER) AS dim,
           md5(array_to_string(list_transform(e, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT)), ',')) AS vector_md5 FROM e""",
)
def q_embed_batches(spark, sf):
    """Every document cut at 20 tokens and embedded in batches of 8 by a model that each worker loads once."""
    from ..functions.embedders import BatchedEmbedder

    emb = BatchedEmbedder(standins.load_md5_model(64), 64, "md5-model", max_tokens=20, batch=8)
    made = emb.transform(spread(table(spark, sf, "documents").select("doc_id", "text")), "text", "e")
    said = F.transform("e", lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string"))
    return made.select("doc_id", F.size("e").alias("dim"), F.md5(F.array_join(said, ",")).alias("vector_md5"))


@register(
    "context_round_trip",
    f"""WITH flat AS (SELECT * FROM ({SQL['retrieval_flat']})),
    b AS ({standins.BENCH_SQL}), pr AS ({standins.PAIRS_SQL}),
    g AS (SELECT f.id, count(*) AS n, string_agg(f.rank || ':' || CAST(round(f.score * 1000000) AS BIGINT) || ':' || md5(pr.focal_method) || ':'
                 || md5(pr.unit_test), ',' ORDER BY f.rank) AS said FROM flat f JOIN pr ON pr.pair_id = f.example_id GROUP BY f.id)
    SELECT b.id, b.lang, CASE WHEN length(focal_code) % 7 = 0 THEN 'error' ELSE 'success' END AS status,
           CASE WHEN length(focal_code) % 7 = 0 THEN 'embedding: null' END AS error,
           CASE WHEN length(focal_code) % 7 = 0 THEN 0 ELSE coalesce(g.n, 0) END AS n_results, md5(focal_code) AS focal_md5,
           md5(CASE WHEN length(focal_code) % 7 = 0 THEN '' ELSE coalesce(g.said, '') END) AS results_md5
    FROM b LEFT JOIN g ON g.id = b.id""",
)
def q_context_round_trip(spark, sf):
    """Nested contexts of every case, written partitioned, read back strictly and digested;
    cases without a vector are reported and the others go on."""
    from ..functions.embedders import HashedEmbedder
    from ..sources.benchmark import read_contexts
    from ..sources.index_store import build_index
    from .retrieval import retrieval_job, write_context

    corpus = standins.pairs(spark, sf).select(
        F.col("pair_id").alias("example_id"), "focal_method", "unit_test", F.lit("{}").alias("metadata")
    )
    index = written(build_index(corpus, HashedEmbedder(64, hash_fn="md5")), "example-index")
    path = scratch_path(spark, "contexts")
    write_context(retrieval_job(standins.bench_cases(spark, sf), index, standins.GappedEmbedder(64), k=3, threshold=0.0), path)
    c = F.col("retrieved_context")
    said = F.transform(
        F.array_sort(F.transform(c["results"], lambda r: F.struct(r["rank"].alias("rank"), r.alias("r")))),
        lambda x: F.concat_ws(
            ":",
            x["rank"].cast("string"),
            F.round(F.round(x["r"]["similarity_score"], 6) * 1000000).cast("long").cast("string"),
            F.md5(x["r"]["example"]["focal_method"]),
            F.md5(x["r"]["example"]["unit_test"]),
        ),
    )
    return read_contexts(spark, path).select(
        "id",
        "lang",
        c["status"].alias("status"),
        c["error"].alias("error"),
        F.size(c["results"]).cast("long").alias("n_results"),
        F.md5(c["focal_method"]).alias("focal_md5"),
        F.md5(F.array_join(said, ",")).alias("results_md5"),
    )


_LAST = "string_split(rtrim(question, chr(10)), chr(10))[-1]"


@register(
    "index_versions",
    f"""WITH p AS ({standins.PAIRS_SQL}),
    d AS (SELECT DISTINCT focal_method, unit_test, min(pair_id % 2) OVER (PARTITION BY focal_method, unit_test) AS odd FROM p),
    f AS (SELECT *, {O.detect_language('focal_method')} AS lang FROM d)
    SELECT v.version, md5(focal_method || chr(0) || unit_test) AS example, CAST(64 AS INTEGER) AS dim, lang,
           {O.method_name('focal_method', 'lang')} AS method_name, {O.param_count('focal_method', 'lang')} AS param_count
    FROM f, (VALUES (1), (2)) v(version) WHERE v.version = 2 OR odd = 0""",
)
def q_index_versions(spark, sf):
    """An index of the even pairs, all pairs appended (those it holds are not embedded again), both versions read back."""
    from ..functions.embedders import HashedEmbedder
    from ..sources import index_store

    pairs = standins.pairs(spark, sf)
    emb = HashedEmbedder(64)
    path = scratch_path(spark, "index")
    corpus = pairs.select("pair_id", "focal_method", "unit_test", F.lit("{}").alias("metadata"))
    index_store.append(corpus.where("pair_id % 2 = 0").drop("pair_id"), path, emb)
    index_store.append(corpus.drop("pair_id"), path, emb)
    example = F.md5(F.concat("focal_method", F.lit("\u0000"), "unit_test")).alias("example")
    parts = [
        index_store.load_index(spark, path, emb.name, 64, version).select(F.lit(version).alias("version"), example, "dim", "lang", "method_name", "param_count")
        for version in (1, 2)
    ]
    return parts[0].unionByName(parts[1])


@register(
    "generate_answers",
    f"""WITH p AS ({SQL['standard_prompt']}),
    b AS ({standins.BENCH_SQL})
    SELECT p.task_id, p.question AS prompt,
           [{_LAST} || chr(10) || '    assert!(true); // answer 0' || chr(10) || '}}' || chr(10),
            {_LAST} || chr(10) || '    assert!(true); // answer 1' || chr(10) || '}}' || chr(10)] AS generated,
           b.function_name, b.file_path
    FROM p JOIN b ON b.id = p.id""",
)
def q_generate_answers(spark, sf):
    """G1/G2 with the deterministic stand-in generator over every prompt."""
    from ..operators.inference import generate_all, template_generator

    prompts = PR.build_prompts(standins.bench_cases(spark, sf), instruct=True)
    return generate_all(prompts, template_generator, n=2)

"""Standard vs few-shot comparison of evaluation runs.

Input: one row per run with ``Language``, ``Mode``, ``Model`` and the metric
columns of ``METRICS`` (see ``sources.summaries``).  Everything is grouped
aggregation + pivot on the two known modes, so the work is two small shuffles
whatever the number of runs; the pivot values are given explicitly so Spark
does not run a job to discover them.

Rounding is half-to-even (``bround``), as pandas rounds.  Division by a zero
or missing standard value gives 0, as the original replaces inf/NaN by 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The mode names and the metric columns with their headers.
MODES = ("standard", "fewshot")
METRICS = (
    "Compiled Rate (%)",
    "Branch Coverage (%)",
    "Line Coverage (%)",
    "Test Pass Rate (%)",
    "Invocation Rate (%)",
)
TOTAL = "Total Samples"
DEFAULT_METRIC = "Test Pass Rate (%)"


def metric_slug(metric: str) -> str:
    """P10: file-name form of a metric header ('Test Pass Rate (%)' -> 'Test_Pass_Rate_')."""
    return metric.replace(" ", "_").replace("(%)", "").replace("(", "").replace(")", "")


def _diffs(std: Column, few: Column) -> list[Column]:
    diff = few - std
    rel = F.coalesce(F.bround(F.try_divide(diff, std) * F.lit(100.0), 2), F.lit(0.0))
    return [F.bround(diff, 4).alias("Absolute Diff"), rel.alias("Relative Improvement (%)")]


def _side_by_side(results: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Pivot ``value`` on Mode for the given keys.

    A mode that appears in no row becomes a 0.0 column; a single missing cell
    stays null; keys with no value in either mode are dropped.
    """
    modes = results.where(F.col("Mode").isin(*MODES))
    piv = modes.groupBy(*keys).pivot("Mode", list(MODES)).agg(value.alias("v"), F.count(F.lit(1)).alias("n"))
    # which of the two modes occur at all: one row over the same aggregate
    seen = piv.agg(*[(F.sum(f"{m}_n") > 0).alias(f"has_{m}") for m in MODES])
    piv = piv.where(F.col("standard_v").isNotNull() | F.col("fewshot_v").isNotNull()).crossJoin(F.broadcast(seen))
    side = lambda m: F.when(F.col(f"has_{m}"), F.col(f"{m}_v").cast("double")).otherwise(F.lit(0.0)).alias(m)
    return piv.select(*keys, *[side(m) for m in MODES])


def detailed_comparison(results: DataFrame, metric: str = DEFAULT_METRIC) -> DataFrame:
    """A1: per (Language, Model) the metric in both modes, diff and relative %."""
    p = _side_by_side(results, ["Language", "Model"], F.first(F.col(f"`{metric}`"), ignorenulls=True))
    return p.select(
        "Language",
        "Model",
        F.col("standard").alias(f"Standard {metric}"),
        F.col("fewshot").alias(f"Few-Shot {metric}"),
        *_diffs(F.col("standard"), F.col("fewshot")),
    ).orderBy("Language", "Model")


def summary_by_language(results: DataFrame, metric: str = DEFAULT_METRIC) -> DataFrame:
    """A2: mean per (Language, Mode), side by side."""
    p = _side_by_side(results, ["Language"], F.avg(F.col(f"`{metric}`")))
    return p.select(
        "Language",
        F.col("standard").alias(f"Avg Standard {metric}"),
        F.col("fewshot").alias(f"Avg Few-Shot {metric}"),
        *_diffs(F.col("standard"), F.col("fewshot")),
    ).orderBy("Language")


def summary_by_model(results: DataFrame, metric: str = DEFAULT_METRIC) -> DataFrame:
    """A3: mean per (Model, Mode), sorted by relative improvement (Model breaks ties)."""
    p = _side_by_side(results, ["Model"], F.avg(F.col(f"`{metric}`")))
    return p.select(
        "Model",
        F.col("standard").alias(f"Avg Standard {metric}"),
        F.col("fewshot").alias(f"Avg Few-Shot {metric}"),
        *_diffs(F.col("standard"), F.col("fewshot")),
    ).orderBy(F.col("Relative Improvement (%)").desc(), F.col("Model"))


def _overall(std: Column, few: Column) -> Column:
    """A4 improvement: relative % when the standard mean is > 0, else 0."""
    return F.when(std > 0, (few - std) / std * F.lit(100.0)).otherwise(F.lit(0.0))


def overall_statistics(results: DataFrame, metric: str = DEFAULT_METRIC) -> DataFrame:
    """A4: overall mean per mode and the improvement, unrounded."""
    m = F.col(f"`{metric}`")
    agg = results.agg(
        F.avg(F.when(F.col("Mode") == "standard", m)).alias("avg_standard"),
        F.avg(F.when(F.col("Mode") == "fewshot", m)).alias("avg_fewshot"),
    )
    return agg.select(
        F.lit(metric).alias("metric"),
        "avg_standard",
        "avg_fewshot",
        F.coalesce(_overall(F.col("avg_standard"), F.col("avg_fewshot")), F.lit(0.0)).alias("improvement_pct"),
    )


def wins(detailed: DataFrame, metric: str = DEFAULT_METRIC) -> DataFrame:
    """A5: how many (Language, Model) rows have few-shot > standard (null compares false)."""
    few, std = F.col(f"`Few-Shot {metric}`"), F.col(f"`Standard {metric}`")
    won = F.coalesce(few > std, F.lit(False))
    return detailed.agg(
        F.sum(won.cast("long")).alias("wins"),
        F.count(F.lit(1)).alias("total"),
    ).select(
        F.lit(metric).alias("metric"),
        F.coalesce(F.col("wins"), F.lit(0)).alias("wins"),
        "total",
        F.try_divide(F.col("wins") * F.lit(100.0), F.col("total")).alias("win_pct"),
    )


def consolidated_summary(results: DataFrame, metrics=METRICS) -> DataFrame:
    """One row per metric across all runs (unpivot + one aggregation)."""
    long = results.unpivot(
        ["Mode"], [f"`{m}`" for m in metrics], "Metric", "value"
    )
    agg = long.groupBy("Metric").agg(
        F.avg(F.when(F.col("Mode") == "standard", F.col("value"))).alias("s"),
        F.avg(F.when(F.col("Mode") == "fewshot", F.col("value"))).alias("f"),
    )
    order = F.create_map(*[x for i, m in enumerate(metrics) for x in (F.lit(m), F.lit(i))])
    return agg.select(
        "Metric",
        F.bround("s", 4).alias("Avg Standard"),
        F.bround("f", 4).alias("Avg Few-Shot"),
        F.bround(F.col("f") - F.col("s"), 4).alias("Absolute Diff"),
        F.bround(F.coalesce(_overall(F.col("s"), F.col("f")), F.lit(0.0)), 2).alias("Improvement (%)"),
        order[F.col("Metric")].alias("_order"),
    ).orderBy("_order").drop("_order")


VIEWS = ("detailed", "by_language", "by_model", "consolidated")


def report_table(results: DataFrame, metrics=METRICS) -> DataFrame:
    """A1-A3 and A6 of all metrics at once: one unpivot and one aggregate over grouping sets.

    Columns: view, metric, position (the row's place in its report), Language, Model, standard, fewshot,
    absolute_diff, relative_improvement."""
    long = results.where(F.col("Mode").isin(*MODES)).unpivot(["Language", "Model", "Mode"], [f"`{m}`" for m in metrics], "metric", "value")
    keys = [F.col("metric"), F.col("Language"), F.col("Model")]
    mode = lambda m, f: f(F.when(F.col("Mode") == m, F.col("value")))
    sets = long.groupingSets([keys, keys[:2], [keys[0], keys[2]], keys[:1]], *keys).agg(
        F.grouping("Language").alias("_all_languages"),
        F.grouping("Model").alias("_all_models"),
        *[mode(m, F.avg).alias(f"{m}_avg") for m in MODES],
        *[mode(m, lambda c: F.first(c, ignorenulls=True)).alias(f"{m}_first") for m in MODES],
        *[F.count_if(F.col("Mode") == m).alias(f"{m}_n") for m in MODES],
    )
    number = F.col("_all_languages") * 2 + F.col("_all_models")  # 0 detailed, 1 by language, 2 by model, 3 all
    sets = sets.withColumn("view", F.array(*[F.lit(v) for v in VIEWS])[number.cast("int")])
    # a mode without a row anywhere counts as 0: the row over everything tells
    seen = sets.where(F.col("view") == "consolidated").select(F.col("metric").alias("_m"), *[(F.col(f"{m}_n") > 0).alias(f"has_{m}") for m in MODES])
    sets = sets.join(F.broadcast(seen), F.col("metric") == F.col("_m"))
    value = lambda m: F.when(F.col("view") == "detailed", F.col(f"{m}_first")).otherwise(F.col(f"{m}_avg"))
    for m in MODES:
        whole = F.col("view") == "consolidated"
        sets = sets.withColumn(m, F.when(F.col(f"has_{m}") | whole, value(m)).otherwise(F.lit(0.0)))
    std, few = F.col("standard"), F.col("fewshot")
    sets = sets.where((F.col("view") == "consolidated") | std.isNotNull() | few.isNotNull())
    whole = F.col("view") == "consolidated"
    diff, relative = (c for c in _diffs(std, few))
    relative = F.when(whole, F.bround(F.coalesce(_overall(std, few), F.lit(0.0)), 2)).otherwise(relative)
    shown = lambda c: F.when(whole, F.bround(c, 4)).otherwise(c)
    out = sets.select("view", "metric", "Language", "Model", shown(std).alias("standard"), shown(few).alias("fewshot"), diff.alias("absolute_diff"), relative.alias("relative_improvement"))
    place = Window.partitionBy("view", "metric").orderBy(
        F.when(F.col("view") == "by_model", F.col("relative_improvement")).desc(), F.col("Language"), F.col("Model")
    )
    order = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric")).cast("int")
    position = F.when(F.col("view") == "consolidated", order).otherwise(F.row_number().over(place))
    return out.withColumn("position", position)

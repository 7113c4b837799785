"""Batch inference through a caller-supplied generator.

``generate(prompt, n) -> list[str]`` is any Python callable (an API client, a
local model); it runs inside ``mapInPandas`` tasks, so the number of
partitions is the number of concurrent callers.  Each prompt gets up to
``attempts`` tries ``retry_delay`` seconds apart; after the last failure it
gets ``n`` empty strings, as in the original.  Output rows follow D10:
task_id, prompt, generated, function_name, file_path.

A failed task (lost executor) is re-run by Spark, so the callable must be
safe to call again for the same prompt; results are written once per task
attempt by the sink (S11), never appended from the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the original client: attempts, delay between them, pacing.
ATTEMPTS = 3
RETRY_DELAY = 2.0
OUT_SCHEMA = "task_id long, prompt string, generated array<string>, function_name string, file_path string"


def generate_one(generate: Callable[[str, int], list[str]], prompt: str, n: int, attempts: int, delay: float) -> list[str]:
    """G1."""
    for attempt in range(attempts):
        try:
            out = list(generate(prompt, n))
            return [str(x) for x in out]
        except Exception:  # the original retries on any error
            if attempt + 1 < attempts:
                time.sleep(delay)
    return [""] * n


def generate_all(
    prompts: DataFrame,
    generate: Callable[[str, int], list[str]],
    n: int = 1,
    *,
    concurrency: int | None = None,
    attempts: int = ATTEMPTS,
    retry_delay: float = RETRY_DELAY,
    pacing: float = 0.0,
    prompt_col: str = "question",
) -> DataFrame:
    """G2 over a table of prompts (task_id, question, function_name, file_path)."""
    from ..session import ship_package

    ship_package(prompts.sparkSession)
    df = prompts.select(
        F.col("task_id").cast("long"),
        F.col(prompt_col).alias("prompt"),
        F.col("function_name") if "function_name" in prompts.columns else F.lit(None).cast("string").alias("function_name"),
        F.col("file_path") if "file_path" in prompts.columns else F.lit(None).cast("string").alias("file_path"),
    )
    if concurrency:
        df = df.repartition(concurrency)

    def run(batches):
        for pdf in batches:
            gen = []
            for p in pdf["prompt"]:
                gen.append(generate_one(generate, "" if p is None else p, n, attempts, retry_delay))
                if pacing:
                    time.sleep(pacing)
            yield pd.DataFrame(
                {
                    "task_id": pdf["task_id"],
                    "prompt": pdf["prompt"],
                    "generated": gen,
                    "function_name": pdf["function_name"],
                    "file_path": pdf["file_path"],
                }
            )

    return df.mapInPandas(run, OUT_SCHEMA)


def save_generations(gens: DataFrame, path: str) -> None:
    """JSON lines, one part file per task."""
    gens.write.mode("overwrite").json(path)


def template_generator(prompt: str, n: int) -> list[str]:
    """Deterministic stand-in model for tests and the registered job: answers
    with a test skeleton built from the prompt's last line."""
    last = prompt.rstrip("\n").split("\n")[-1] if prompt else ""
    return [f"{last}\n    assert!(true); // answer {i}\n}}\n" for i in range(n)]

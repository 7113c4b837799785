"""Prompt assembly.

Input: a benchmark DataFrame (FIXTURES F2: id, lang, focal_code,
function_name, file_path, class_signature, file_content, context,
struct_class, function_component) and optionally the retrieved context
(F4: id, retrieved_context).  Everything is Column expressions over each row;
the only shuffles are the join of the retrieved context by id and the task
ordinal.

Differences from the original, on purpose: the retrieved context is joined by
``id`` (the original merged by position, which shifts after skipped cases);
the model-specific chat rendering is not done — ``messages`` carries the
(system, user) turns and ``question`` the plain prompt plus suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import templates as TP
from ..functions.text import import_context, strip_rust_tests
from .layout import ordinal

MAX_EXAMPLES = 5
_WS = r"^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (F.length(c) > 0)


def code_with_signature(focal_code="focal_code", class_signature="class_signature") -> Column:
    """``sig {\\n<code indented by 4, blank lines untouched>\\n}`` when a
    class signature is present, else the code."""
    code, sig = _c(focal_code), _c(class_signature)
    indented = F.regexp_replace(code, r"(?m)^([^\S\n]*\S)", "    $1")
    return F.when(_nonempty(sig), F.concat(sig, F.lit(" {\n"), indented, F.lit("\n}"))).otherwise(code)


def fewshot_block(results="retrieved_context.results", limit: int = MAX_EXAMPLES) -> Column:
    """T2 head: 'Given the following related examples:' and up to ``limit``
    (W5) numbered (focal, test) pairs; '' when there are none."""
    r = F.slice(F.coalesce(_c(results), F.array()), 1, limit)
    pairs = F.transform(
        r,
        lambda x, i: F.concat(
            F.lit("Example "),
            (i + 1).cast("string"),
            F.lit(":\n"),
            F.coalesce(x["example"]["focal_method"], F.lit("")),
            F.lit("\n\n"),
            F.coalesce(x["example"]["unit_test"], F.lit("")),
        ),
    )
    return F.when(F.size(r) > 0, F.concat(F.lit(TP.FEWSHOT_HEADER), F.array_join(pairs, "\n\n"), F.lit("\n\n"))).otherwise(
        F.lit("")
    )


def _definitions(function_component="function_component") -> Column:
    defs = F.flatten(F.transform(_c(function_component)["argument_definitions"], lambda a: a["definitions"]))
    return F.regexp_replace(F.array_join(defs, "\n"), _WS, "")


def _has_definitions(function_component="function_component") -> Column:
    return F.coalesce(F.size(_c(function_component)["argument_definitions"]) > 0, F.lit(False))


def build_prompts(
    bench: DataFrame,
    contexts: DataFrame | None = None,
    *,
    instruct: bool = True,
    use_fewshot: bool = False,
    is_rag: bool = False,
    file_context: bool = False,
    arg_context: bool = False,
    finetune: bool = False,
    add_suffix: bool = True,
    system_prompt: str | None = TP.SYSTEM_PROMPT,
) -> DataFrame:
    """One row per benchmark case with ``prompt``, ``question``
    (prompt + suffix), ``messages`` and ``task_id`` (0-based position within
    its language, in ``ordinal_in`` order when that column exists, else by id).

    ``contexts`` (lang, id, retrieved_context) is left-joined by language and
    id; without a ``lang`` column by id alone (J2)."""
    # task ordinal on the benchmark alone: cheap lineage, computed before joins
    order = "ordinal_in" if "ordinal_in" in bench.columns else "id"
    df = ordinal(bench, [order], ["lang"], name="task_id")
    for c in ("class_signature", "file_content", "context", "struct_class", "file_path"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    if "function_component" not in df.columns:
        df = df.withColumn(
            "function_component",
            F.lit(None).cast("struct<argument_definitions:array<struct<definitions:array<string>>>>"),
        )
    if contexts is not None and "lang" in contexts.columns:
        # default ids repeat across languages, so the language is part of the key (in any case)
        ctx = contexts.select(F.lower("lang").alias("_lang"), F.col("id").alias("_id"), "retrieved_context")
        df = df.join(ctx, (F.lower(df["lang"]) == F.col("_lang")) & (df["id"] == F.col("_id")), "left").drop("_lang", "_id")
    elif contexts is not None:
        df = df.join(contexts.select("id", "retrieved_context"), "id", "left")
    elif "retrieved_context" not in df.columns:
        df = df.withColumn(
            "retrieved_context",
            F.lit(None).cast(
                "struct<focal_method:string,results:array<struct<example:struct<focal_method:string,"
                "unit_test:string>,similarity_score:double,rank:int>>>"
            ),
        )
    lang = F.col("lang")
    mode = "finetune" if finetune else ("instruct" if instruct else "base")
    fields = {"function_name": F.col("function_name"), "file_path": F.col("file_path")}

    # few-shot branch (T2): focal text comes from the retrieved context
    few = F.concat(
        fewshot_block(),
        TP.template_for(lang, mode, {**fields, "function_code": F.col("retrieved_context.focal_method")}),
    )
    # standard branch (T1 + P9 + contexts)
    std = TP.template_for(lang, mode, {**fields, "function_code": code_with_signature()})
    if instruct:
        rag = F.concat(F.lit(TP.RAG_OPEN), F.col("context"), F.lit(TP.RAG_CLOSE), std)
        content = F.when(F.lower(lang) == "rust", strip_rust_tests(F.col("file_content"))).otherwise(F.col("file_content"))
        filed = F.concat(
            F.lit(TP.FILE_OPEN), F.coalesce(F.col("file_path"), F.lit("")), F.lit("\n"),
            F.coalesce(content, F.lit("")), F.lit(TP.FILE_CLOSE), std,
        )
        if is_rag:
            std = F.when(F.col("context").isNotNull(), rag).otherwise(filed if file_context else std)
        elif file_context:
            std = filed
        if arg_context:
            pre = F.when(_nonempty(F.col("struct_class")), F.concat(F.lit("\n\n"), F.col("struct_class"))).otherwise(
                _definitions()
            )
            imports = import_context(F.lower(lang), F.coalesce(F.col("file_content"), F.lit("")))
            std = F.when(
                _has_definitions(), F.concat(imports, F.lit("\n"), pre, F.lit("\n"), F.lit("\n\n"), std)
            ).otherwise(std)
    elif arg_context:
        std = F.when(_has_definitions(), F.concat(_definitions(), F.lit("\n\n"), std)).otherwise(std)

    use_few = F.col("retrieved_context").isNotNull() if use_fewshot else F.lit(False)
    prompt = F.when(use_few, few).otherwise(std)
    question = F.concat(prompt, TP.suffix_for(lang, F.col("function_name"))) if add_suffix else prompt
    user = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    if system_prompt:
        messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")), user)
    else:
        messages = F.array(user)
    out = df.withColumn("prompt", prompt).withColumn("question", question).withColumn(
        "messages", messages if instruct else F.lit(None).cast("array<struct<role:string,content:string>>")
    )
    return out


def threshold_prompt(focal: Column, results: Column, threshold: float) -> Column:
    """Examples at or above the threshold, or the bare request when none."""
    kept = F.filter(results, lambda r: r["similarity_score"] >= F.lit(float(threshold)))
    blocks = F.transform(
        kept,
        lambda r: F.concat(
            F.lit("Example "), r["rank"].cast("string"), F.lit(":\n"),
            F.lit("Focal Method:\n"), F.coalesce(r["example"]["focal_method"], F.lit("")), F.lit("\n"),
            F.lit("Unit Test:\n"), F.coalesce(r["example"]["unit_test"], F.lit("")), F.lit("\n\n"),
        ),
    )
    full = F.concat(
        F.lit("Generate a unit test for the following code.\n"),
        F.lit("Here are some similar examples:\n\n"),
        F.array_join(blocks, ""),
        F.lit("Now generate a test for:\n"),
        focal,
    )
    return F.when(F.size(kept) > 0, full).otherwise(F.concat(F.lit("Generate unit test for:\n"), focal))


DOC_INSTRUCTION = "Generate a unit test for the focal method below, following the style of the examples."


def documented_prompt(focal: Column, results: Column, instruction: str = DOC_INSTRUCTION) -> Column:
    """The documented Markdown layout with similarity to two decimals."""
    fence = "```"
    blocks = F.transform(
        results,
        lambda r, i: F.concat(
            F.lit("## Example "), (i + 1).cast("string"), F.lit(" (Similarity: "),
            F.format_string("%.2f", r["similarity_score"]), F.lit(")\n\n"),
            F.lit(f"### Focal Method:\n{fence}\n"), F.coalesce(r["example"]["focal_method"], F.lit("")),
            F.lit(f"\n{fence}\n\n### Unit Test:\n{fence}\n"), F.coalesce(r["example"]["unit_test"], F.lit("")),
            F.lit(f"\n{fence}\n\n"),
        ),
    )
    return F.concat(
        F.lit(f"# Task: Unit Test Generation\n\n{instruction}\n\n# Examples:\n\n"),
        F.array_join(blocks, ""),
        F.lit(f"# Your Task:\n\n### Focal Method:\n{fence}\n"),
        focal,
        F.lit(f"\n{fence}\n\n### Unit Test:\n{fence}\n# Generate unit test here\n{fence}"),
    )

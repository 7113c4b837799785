import textwrap

from pyspark.sql import functions as F

from exemplar.operators.layout import ordinal
from exemplar.operators.prompts import build_prompts, code_with_signature, documented_prompt, threshold_prompt

CTX = "struct<focal_method:string,results:array<struct<example:struct<focal_method:string,unit_test:string>,similarity_score:double,rank:int>>>"


def _bench(spark, rows):
    return spark.createDataFrame(
        rows, "id string, lang string, focal_code string, function_name string, file_path string, class_signature string, ordinal_in long"
    )


def test_signature_wrap_equals_textwrap(spark):
    code = "fn a() {\n\n  x\n   \n}"
    got = spark.createDataFrame([(code, "impl S")], "c string, s string").select(code_with_signature("c", "s")).first()[0]
    assert got == "impl S {\n" + textwrap.indent(code, "    ") + "\n}"


def test_standard_and_suffix(spark):
    b = _bench(spark, [("case_1", "Rust", "fn f() {}", "f", "src/a.rs", None, 0), ("case_2", "Go", "func g() {}", "g", "a.go", None, 1)])
    rows = {r.id: r for r in build_prompts(b, instruct=True).collect()}
    assert rows["case_1"].question == "fn f() {}\nGenerate Rust unittest for `f` function in module `src/a.rs`:\n    #[test]\n    fn test_f() {"
    assert rows["case_2"].question.endswith("func Testg(")
    assert rows["case_1"].messages[0].role == "system" and rows["case_1"].messages[1].content == rows["case_1"].prompt
    assert rows["case_1"].task_id == 0 and rows["case_2"].task_id == 0
    base = {r.id: r for r in build_prompts(b, instruct=False).collect()}
    assert base["case_1"].prompt == "fn f() {}\n// Check the correcness for f function in Rust\n"


def test_fewshot_joined_by_id(spark):
    b = _bench(spark, [("x", "Julia", "function f() end", "f", "f.jl", None, 0), ("y", "Julia", "function g() end", "g", "g.jl", None, 1)])
    ctx = spark.createDataFrame(
        [("y", ("function g() end", [(("q1", "t1"), 0.9, 1), (("q2", "t2"), 0.8, 2)]))], f"id string, retrieved_context {CTX}"
    )
    rows = {r.id: r for r in build_prompts(b, ctx, use_fewshot=True).collect()}
    assert rows["y"].prompt.startswith("Given the following related examples:\n\nExample 1:\nq1\n\nt1\n\nExample 2:\nq2\n\nt2\n\nfunction g() end\n")
    assert rows["x"].prompt.startswith("function f() end\nGenerate Julia")  # no context: standard prompt


def test_rag_file_and_arg_context(spark):
    b = spark.createDataFrame(
        [("1", "Rust", "fn f(a: A) {}", "f", "src/x.rs", "use std::io;\nfn f(a: A) {}\n#[test]\nfn t() { assert!(true); }", None,
          {"argument_definitions": [{"definitions": ["struct A {}", " "]}]}, 0)],
        "id string, lang string, focal_code string, function_name string, file_path string, file_content string, context string,"
        " function_component struct<argument_definitions:array<struct<definitions:array<string>>>>, ordinal_in long",
    )
    p = build_prompts(b, instruct=True, file_context=True, arg_context=True, add_suffix=False).first().prompt
    assert p.startswith("use std::io;\nstruct A {}\n\n\n\n#CURRENT FILE: src/x.rs\nuse std::io;\nfn f(a: A) {}\n")
    assert "assert" not in p.split("#ENDFILE")[0]
    rag = b.withColumn("context", F.lit("CTX"))
    p2 = build_prompts(rag, instruct=True, is_rag=True, add_suffix=False).first().prompt
    assert p2.startswith("#RELEVANT CONTEXT\nCTX\n#END_OF_CONTEXT\n\nfn f(a: A) {}")


def test_threshold_and_documented_prompts(spark):
    df = spark.createDataFrame([("q", [(("f1", "t1"), 0.9, 1), (("f2", "t2"), 0.1, 2)])], f"focal string, results {CTX.split('results:')[1][:-1]}")
    t = df.select(threshold_prompt(F.col("focal"), F.col("results"), 0.5)).first()[0]
    assert t == "Generate a unit test for the following code.\nHere are some similar examples:\n\nExample 1:\nFocal Method:\nf1\nUnit Test:\nt1\n\nNow generate a test for:\nq"
    none = df.select(threshold_prompt(F.col("focal"), F.col("results"), 0.95)).first()[0]
    assert none == "Generate unit test for:\nq"
    d = df.select(documented_prompt(F.col("focal"), F.col("results"))).first()[0]
    assert "## Example 1 (Similarity: 0.90)" in d and d.endswith("# Generate unit test here\n```")


def test_ordinal_distributed(spark):
    rows = [(g, i) for g in ("a", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(7)
    got = ordinal(df, ["i"], ["g"]).collect()
    assert all(r.ordinal == r.i for r in got) and len(got) == 100


def test_ordinal_small_input_window_path(spark, tmp_dir):
    import os

    path = os.path.join(tmp_dir, "o.parquet")
    spark.createDataFrame([(g, i) for g in ("a", "b") for i in range(30)], "g string, i long").write.parquet(path)
    got = ordinal(spark.read.parquet(path), ["i"], ["g"]).collect()
    assert all(r.ordinal == r.i for r in got) and len(got) == 60

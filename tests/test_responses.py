from pyspark.sql import functions as F

from exemplar.functions.text import go_tests, import_context, julia_tests, rust_tests, strip_rust_tests
from exemplar.operators.responses import clean_responses


def one(spark, col_fn, text):
    return spark.createDataFrame([(text,)], "t string").select(col_fn(F.col("t")).alias("x")).first()["x"]


def test_rust_attribute_name_and_helper(spark):
    src = "fn helper() {}\n#[test]\nfn checks() {\n    assert!(helper_ok());\n}\nfn test_x() { assert!(true); }\n"
    got = one(spark, rust_tests, src)
    assert got == ["    #[test]\n    fn checks() {\n    assert!(helper_ok());\n}", "    #[test]\n    fn test_x() { assert!(true); }"]


def test_rust_mod_tests_and_nesting_order(spark):
    src = "mod tests {\n    #[test]\n    fn inner() {\n        fn test_nested() {}\n    }\n}\nfn my_test() {}\n"
    got = one(spark, rust_tests, src)
    # depth 0 first (my_test), then the function inside the mod; nested fn stays inside its parent
    assert got[0].endswith("fn my_test() {}")
    assert got[1].startswith("    #[test]\n    fn inner() {") and "test_nested" in got[1]
    assert len(got) == 2


def test_rust_dangling_attribute_and_unbalanced(spark):
    assert one(spark, rust_tests, "fn a() {}\n#[test]\n") == []
    assert one(spark, rust_tests, "#[test]\nfn open() {\n    let x = 1;\n") == []
    assert one(spark, rust_tests, "#[test]\n#[should_panic]\nfn boom() {}\n") == []


def test_rust_braces_in_strings(spark):
    src = '#[test]\nfn s() {\n    let a = "}{";\n    let c = \'{\';\n}\n'
    assert len(one(spark, rust_tests, src)) == 1


def test_go_marker_rules(spark):
    src = "some prose\nfunc TestAdd(t *testing.T) {\n  x()\n}\nfunc helper() {}\nfunc (s *S) TestM() {}\n"
    assert one(spark, go_tests, src) == ["func TestAdd(t *testing.T) {\n  x()\n}"]
    # without the marker the text is re-prefixed and its first letter upper-cased
    assert one(spark, go_tests, "add(t *testing.T) {\n}\n") == ["func TestAdd(t *testing.T) {\n}"]
    assert one(spark, go_tests, "") == []


def test_julia_testsets(spark):
    src = 'using Test\n@testset "a" begin\n  @test 1 == 1\nend\n@testset "b" begin\nend'
    assert one(spark, julia_tests, src) == ['@testset "a" begin\n  @test 1 == 1\nend\n@testset "b" begin\nend']
    assert one(spark, julia_tests, "x") == ["@testsetx"]


def test_clean_caps_at_ten_and_reshapes(spark):
    body = "\n".join(f"fn test_{i}() {{}}" for i in range(12))
    df = spark.createDataFrame([("line1\nfn test_0() {", [body[len("fn test_0() {"):], ""], 7)], "prompt string, response array<string>, task_id int")
    row = clean_responses(df, "Rust").first()
    assert "prompt" not in row.asDict()
    assert row["raw_response"][0].startswith("fn test_0() {")
    assert row["raw_response"][1] == "fn test_0() {"
    assert len(row["response"]) == 10 and row["task_id"] == 7


def test_generated_field_accepted(spark):
    df = spark.createDataFrame([("p\n@testset", ["x"])], "prompt string, generated array<string>")
    assert clean_responses(df, "julia").first()["response"] == ["@testsetx"]


def test_import_context(spark):
    rust = "use a::b;\n// use c::d;\nuse e::{\n  f,\n  g,\n};\nmod tests {\n    use super::*;\n}\nfn x() {}\n"
    df = spark.createDataFrame([(rust,)], "t string")
    assert df.select(import_context(F.lit("rust"), F.col("t"))).first()[0] == "use a::b;\nuse e::{\n  f,\n  g,\n};"
    go = 'package p\nimport "fmt"\nimport (\n  "os"\n)\nfunc f() {\n  import_x := 1\n}\n'
    df = spark.createDataFrame([(go,)], "t string")
    assert df.select(import_context(F.lit("go"), F.col("t"))).first()[0] == 'import "fmt"\nimport (\n  "os"\n)'
    jl = "using Test\n# import X\nimport A: b,\n  c\nx = 1\n"
    df = spark.createDataFrame([(jl,)], "t string")
    assert df.select(import_context(F.lit("julia"), F.col("t"))).first()[0] == "using Test\nimport A: b,\n  c"


def test_strip_rust_tests(spark):
    src = (
        "use a;\n// helper for tests\nfn keep() -> i32 { 1 }\nfn check() {\n    assert!(keep() == 1);\n}\n"
        "#[cfg(test)]\nmod tests {\n    #[test]\n    fn t() {}\n}\nmod tests_decl;\nfn also_keep() {}\n"
    )
    out = one(spark, strip_rust_tests, src)
    assert out == "use a;\nfn keep() -> i32 { 1 }\nfn also_keep() {}\n"

import pytest
from pyspark.sql import functions as F

from exemplar.functions.code import code_features, param_similarity
from exemplar.functions.similarity import name_similarity, ratio

SNIPPETS = [
    ("rust", "pub fn calculate_sum(a: i32, b: i32) -> i32 {\n    a + b\n}", "calculate_sum", 2),
    ("go", "func calculateSum(a int, b int, c int) int {\n    return a + b + c\n}", "calculateSum", 3),
    ("julia", "function calculate_sum(a::Int, b::Int)\n    return a + b\nend", "calculate_sum", 2),
    ("java", "public int add(int x, int y, int z) {\n    return x + y + z;\n}", "add", 3),
    ("rust", "impl S {\n    pub fn get(&self, k: &str) -> Option<&V> { None }\n}", "get", 1),
    ("rust", "fn f<T: Clone>(xs: Vec<T>, m: HashMap<K, (i32, i32)>, g: impl Fn(i32) -> i32) {}", "f", 3),
    ("rust", "fn empty() {}", "empty", 0),
    ("go", "func (s *Server) Handle(w http.ResponseWriter, r *http.Request) {}", "Handle", 2),
    ("go", "func sum(a, b int) int { return a + b }", "sum", 1),
    ("go", "func vals(xs ...int) {}", "vals", 0),
    ("julia", "function f(a, b::Int, c=1; kw=2)\nend", "f", 2),
    ("java", "private static String join(List<String> xs, String sep, String... more) {\n}", "join", 2),
]


@pytest.mark.parametrize("lang,code,name,n", SNIPPETS)
def test_features(spark, lang, code, name, n):
    row = spark.createDataFrame([(code,)], "code string").select(*code_features("code")).first()
    assert (row["lang"], row["method_name"], row["param_count"]) == (lang, name, n)


def test_no_function(spark):
    row = spark.createDataFrame([("just some prose",)], "code string").select(*code_features("code")).first()
    assert row["lang"] is None and row["method_name"] == "" and row["param_count"] is None


@pytest.mark.parametrize("a,b,expected", [(2, 2, 1.0), (2, 3, 0.8), (2, 4, 0.6), (0, 0, 1.0), (3, 0, 0.4), (None, 2, 0.0), (9, 1, 0.0)])
def test_param_similarity(spark, a, b, expected):
    v = spark.createDataFrame([(a, b)], "a int, b int").select(param_similarity("a", "b").alias("s")).first()["s"]
    assert v == pytest.approx(expected)


GOLDEN = [
    ("calculate_sum", "calculatesum", 0.96),
    ("add", "addall", 0.666667),
    ("tide", "diet", 0.25),
    ("diet", "tide", 0.5),
    ("getuser", "setuser", 0.857143),
    ("", "x", 0.0),
    (None, "x", 0.0),
]


@pytest.mark.parametrize("a,b,expected", GOLDEN)
def test_name_similarity_golden(spark, a, b, expected):
    assert ratio(a, b) == pytest.approx(expected, abs=1e-6)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(name_similarity("a", "b").alias("s")).first()["s"] == pytest.approx(expected, abs=1e-6)


def test_features_once_per_row_plan(spark):
    # the three columns come from one Arrow function, evaluated once a row
    df = spark.createDataFrame([("fn a(x: i32) {}",)], "code string").select(*code_features("code"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("_features_batch(") == 1 and "BatchEvalPython" not in plan


def test_go_receiver_compat(spark):
    from exemplar.functions.code import with_code_features

    df = spark.createDataFrame(
        [("func (s *Server) Handle(w http.ResponseWriter, r *http.Request) {}",), ("func add(a int, b int) int { return a + b }",)],
        "code string",
    )
    assert [r.param_count for r in with_code_features(df, "code").collect()] == [2, 2]
    assert [r.param_count for r in with_code_features(df, "code", go_receiver_compat=True).collect()] == [1, 2]


# hand-written: language, name and parameter count of forms that need more than a header pattern
FORMS = [
    ("fn f(a: A<u8, B<C<D<E<F>>>>>, b: i32)", "rust", "f", 2),
    ("fn f<F: Fn(i32) -> i32>(a: F, b: i32) -> u8 {", "rust", "f", 2),
    ("fn m(&self, x: i32, f: impl Fn(a, b) -> c)", "rust", "m", 2),
    ("area(w, h) = w * h", "julia", "area", 2),
    ("f(x::Int, y=2; z=3) = x + y", "julia", "f", 1),
    ("int add(int a, Map<String, List<int>> b) {\n return 1;\n}", "java", "add", 2),
    ("func G[T any](x T, ys ...T) {", "go", "G", 1),
    ("if (x) {\n y();\n}", None, "", None),
]


def test_forms_with_expected_features(spark):
    from exemplar.functions import code as C

    df = spark.createDataFrame([(i, f[0]) for i, f in enumerate(FORMS)], "i int, t string")
    got = {r.i: (r.lang, r.method_name, r.param_count) for r in df.select("i", *C.code_features("t")).collect()}
    assert [got[i] for i in range(len(FORMS))] == [f[1:] for f in FORMS]

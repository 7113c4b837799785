"""Stand-in inputs derived from the driver's test tables.

The original works on (focal method, unit test) corpora and evaluation run
summaries that the test tables do not contain, so each job is fed a table that
Spark derives from the given ones (whole tables, no sampling).  The same
derivations are written as SQL in ``plans.catalog`` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def run_results(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation runs: Language = documents.lang, Model = documents.source,
    Mode = standard for even doc ids and fewshot for odd ones; metrics are
    label averages in percent (one row per (Language, Mode, Model))."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    l = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = d.join(l, "doc_id")
    mode = F.when(F.col("doc_id") % 2 == 0, "standard").otherwise("fewshot")
    return j.groupBy(F.col("lang").alias("Language"), mode.alias("Mode"), F.col("source").alias("Model")).agg(
        F.count(F.lit(1)).alias("Total Samples"),
        (F.avg(1 - F.col("toxic")) * 100).alias("Compiled Rate (%)"),
        (F.avg(F.col("quality") * (1 - F.col("toxic"))) * 100).alias("Branch Coverage (%)"),
        (F.avg("n_chars") / 100).alias("Line Coverage (%)"),
        (F.avg("quality") * 100).alias("Test Pass Rate (%)"),
        (F.avg(F.when(F.col("n_chars") > 1000, 1).otherwise(0)) * 100).alias("Invocation Rate (%)"),
    )


RUN_RESULTS_SQL = """
SELECT d.lang AS "Language",
       CASE WHEN d.doc_id % 2 = 0 THEN 'standard' ELSE 'fewshot' END AS "Mode",
       d.source AS "Model",
       count(*) AS "Total Samples",
       avg(1 - l.toxic) * 100 AS "Compiled Rate (%)",
       avg(l.quality * (1 - l.toxic)) * 100 AS "Branch Coverage (%)",
       avg(d.n_chars) / 100 AS "Line Coverage (%)",
       avg(l.quality) * 100 AS "Test Pass Rate (%)",
       avg(CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END) * 100 AS "Invocation Rate (%)"
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
GROUP BY 1, 2, 3
"""


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding-model sweep log: one run per event; model from the user,
    success unless the event is an error, elapsed seconds = value."""
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("model_"), F.col("user_id").cast("string")).alias("model"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("elapsed_time"),
        F.col("ts").alias("timestamp"),
    )


RUN_LOG_SQL = """
SELECT 'model_' || CAST(user_id AS VARCHAR) AS model, event_type <> 'error' AS success,
       value AS elapsed_time, ts AS timestamp
FROM events
"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Pipeline manifest: step = event type, status from the value."""
    e = table(spark, sf, "events")
    status = (
        F.when(F.col("value") < 5, "failed").when(F.col("value") < 20, "skipped").otherwise("processed")
    )
    return e.select(F.col("event_type").alias("step"), status.alias("status"))


MANIFEST_SQL = """
SELECT event_type AS step,
       CASE WHEN value < 5 THEN 'failed' WHEN value < 20 THEN 'skipped' ELSE 'processed' END AS status
FROM events
"""


# Code snippets generated from `part`: the language cycles with the key, the
# name is the part name, the parameter list depends on p_size.  Written once
# as SQL that both Spark and DuckDB accept (chr(10) for newlines).
_NL = "chr(10)"
_RUST_PARAMS = [
    "",
    "a: i32",
    "&self, a: Vec<u8>, b: HashMap<String, (i32, i32)>",
    "a: i32, b: &str, c: Option<Box<dyn Fn(i32) -> i32>>",
    "&mut self, a: i32, b: i32, c: [u8; 4], d: (i32, i32)",
]
_GO_PARAMS = ["", "a int", "a int, b map[string]int", "a int, b []string, c func(int) int", "a, b int, c string, d ...int"]
_JULIA_PARAMS = ["", "a::Int", "a::Int, b", "a::Vector{Int}, b::Dict{String,Int}, c; verbose=false", "a, b::Int, c::Int, d::Int=1"]
_JAVA_PARAMS = ["", "int x", "int x, List<String> ys", "int x, Map<String, Integer> m, String s", "int a, int b, int c, String... rest"]


def _case(values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE p_size % 5 {arms} END)"


CODE_SQL = f"""(CASE p_partkey % 4
  WHEN 0 THEN 'pub fn ' || replace(p_name, ' ', '_') || '(' || {_case(_RUST_PARAMS)} || ') -> i32 {{' || {_NL}
              || '    let v = helper(1, 2);' || {_NL} || '    v' || {_NL} || '}}'
  WHEN 1 THEN 'func ' || (CASE WHEN p_size % 2 = 0 THEN '(s *Server) ' ELSE '' END) || replace(p_name, ' ', '_')
              || '(' || {_case(_GO_PARAMS)} || ') int {{' || {_NL} || '	return len(x)' || {_NL} || '}}'
  WHEN 2 THEN 'function ' || replace(p_name, ' ', '_') || '(' || {_case(_JULIA_PARAMS)} || ')' || {_NL}
              || '    return f(a)' || {_NL} || 'end'
  ELSE 'public static int ' || replace(p_name, ' ', '_') || '(' || {_case(_JAVA_PARAMS)} || ') {{' || {_NL}
              || '    return compute(x);' || {_NL} || '}}'
END)"""


def code_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """(p_partkey, code) for every part."""
    return table(spark, sf, "part").select("p_partkey", F.expr(CODE_SQL).alias("code"))


# Texts full of comments and literals, some left open, from `part`; the language cycles with the key.
_BS, _Q = "chr(92)", "chr(39)"
LEX_LANG_SQL = "(CASE p_partkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'go' WHEN 2 THEN 'julia' ELSE 'java' END)"
LEX_SQL = f"""(CASE p_partkey % 4
  WHEN 0 THEN 'fn f<' || {_Q} || 'a>(x: &' || {_Q} || 'a str) {{ let s = "' || p_name || {_BS} || '"}}{{"; /* ' || p_type || ' /* " */ {{ */ let r = r#"'
    || p_brand || '"}}' || {_BS} || '"#; g(' || {_Q} || '{{' || {_Q} || ', ' || {_Q} || {_BS} || {_Q} || {_Q} || '); // "' || p_name || {_NL}
    || (CASE WHEN p_size % 5 = 0 THEN '/* /* */ open' WHEN p_size % 5 = 1 THEN 'r#"open"' WHEN p_size % 5 = 2 THEN '"open' ELSE '}}' END)
  WHEN 1 THEN 'func f() {{ s := `' || p_name || {_BS} || '` + "' || p_type || {_BS} || '"}}" /* {{ /* */ + string(' || {_Q} || '}}' || {_Q} || ') // `' || p_brand || {_NL}
    || (CASE WHEN p_size % 3 = 0 THEN '`open' WHEN p_size % 3 = 1 THEN 'x := "open' ELSE '}}' END) || {_NL} || '}}'
  WHEN 2 THEN 'x = a' || {_Q} || ' * "' || p_name || {_BS} || '"" #= ' || p_type || ' #= " =# =# + `' || p_brand || {_BS} || '`` + ' || {_Q} || '#' || {_Q} || ' # "' || p_size || {_NL}
    || (CASE WHEN p_size % 2 = 0 THEN '#= open =' ELSE 'end' END)
  ELSE 'int f() {{ String s = \"\"\"' || {_NL} || p_name || ' "}}" ' || {_BS} || '\"\"\" ' || p_brand || '\"\"\"; char c = ' || {_Q} || '"' || {_Q} || '; /* ' || p_type || ' /* */ s = "'
    || p_name || '"; // /* ' || {_NL} || (CASE WHEN p_size % 2 = 0 THEN 'String t = "open' ELSE '}}' END) || {_NL} || '}}'
END)"""


def lexer_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(p_partkey, lang, code) for every part."""
    return table(spark, sf, "part").select("p_partkey", F.expr(LEX_LANG_SQL).alias("lang"), F.expr(LEX_SQL).alias("code"))


# Benchmark cases (F2) from `benchmark`: language cycles with the key.
def bench_cases(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    lang = F.when(F.col("item_id") % 3 == 0, "Rust").when(F.col("item_id") % 3 == 1, "Go").otherwise("Julia")
    return b.select(
        F.concat(F.lit("case_"), (F.col("item_id") + 1).cast("string")).alias("id"),
        lang.alias("lang"),
        F.col("text").alias("focal_code"),
        F.lower(F.split_part(F.col("text"), F.lit(" "), F.lit(1))).alias("function_name"),
        F.concat(F.lit("src/item_"), F.col("item_id").cast("string"), F.lit(".txt")).alias("file_path"),
        F.when(F.col("item_id") % 4 == 0, F.lit("impl Widget")).alias("class_signature"),
        F.col("item_id").alias("ordinal_in"),
    )


BENCH_SQL = """SELECT 'case_' || CAST(item_id + 1 AS VARCHAR) AS id,
       CASE item_id % 3 WHEN 0 THEN 'Rust' WHEN 1 THEN 'Go' ELSE 'Julia' END AS lang,
       text AS focal_code, lower(split_part(text, ' ', 1)) AS function_name,
       'src/item_' || CAST(item_id AS VARCHAR) || '.txt' AS file_path,
       CASE WHEN item_id % 4 = 0 THEN 'impl Widget' END AS class_signature, item_id AS ordinal_in
FROM benchmark"""

# Example pairs keyed by one LONG (turn numbers are small).
PAIRS_SQL = """SELECT u.conv_id * 1000000 + u.turn AS pair_id, u.text AS focal_method, a.text AS unit_test
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant' AND length(u.text) > 0 AND length(a.text) > 0"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.corpus import pairs_from_turns

    p = pairs_from_turns(table(spark, sf, "conversations"))
    return p.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("pair_id"), "focal_method", "unit_test")


# Generated answers wrapped around chat turns, one sample per assistant turn.
def _comment(prefix: str) -> str:
    return f"replace(text, chr(10), chr(10) || '{prefix}')"


RESPONSES_SQL = {
    "rust": f"""SELECT conv_id, turn,
       'pub fn solve() {{}}' || chr(10) || '    #[test]' || chr(10) || '    fn test_case_' || CAST(turn AS STRING) || '() {{' AS prompt,
       [chr(10) || '        // ' || {_comment('        // ')} || chr(10) || '        assert!(solve_ok());' || chr(10) || '    }}'
          || chr(10) || '    fn helper() {{}}' || chr(10) || '    fn check_test() {{' || chr(10) || '        assert!(true);' || chr(10) || '    }}',
        text] AS response
    FROM conversations WHERE role = 'assistant'""",
    "go": f"""SELECT conv_id, turn,
       'package main' || chr(10) || 'func TestCase' || CAST(turn AS STRING) || '(' AS prompt,
       ['t *testing.T) {{' || chr(10) || '    // ' || {_comment('    // ')} || chr(10) || '}}' || chr(10)
          || 'func helper() int {{ return 1 }}' || chr(10) || 'func TestOther(t *testing.T) {{ t.Log("x") }}',
        text] AS response
    FROM conversations WHERE role = 'assistant'""",
    "julia": f"""SELECT conv_id, turn,
       'function solve() end' || chr(10) || '@testset "case ' || CAST(turn AS STRING) || '" begin' AS prompt,
       [chr(10) || '    # ' || {_comment('    # ')} || chr(10) || 'end', text] AS response
    FROM conversations WHERE role = 'assistant'""",
}


def responses(spark: SparkSession, sf: str, lang: str) -> DataFrame:
    """Samples (conv_id, turn, prompt, response[]) built by the same SQL text."""
    table(spark, sf, "conversations").createOrReplaceTempView("conversations")
    sql = RESPONSES_SQL[lang].replace("[", "array(").replace("] AS response", ") AS response")
    return spark.sql(sql)


# File contexts per case: a small source file in the case's language around
# its text, RAG context on every third case, a struct class on every fifth,
# argument definitions on even cases.
def _file_sql(nl: str = "chr(10)") -> str:
    rust = " || ".join([
        "'use std::io;'", nl, "'use crate::' || function_name || '::{'", nl, "'    a,'", nl, "'};'", nl,
        "'// helper for tests'", nl, "'fn helper() -> i32 { 1 }'", nl, "'fn check() {'", nl, "'    assert!(helper() == 1);'", nl,
        "'}'", nl, "'#[cfg(test)]'", nl, "'mod tests {'", nl, "'    use super::*;'", nl, "'    #[test]'", nl, "'    fn t() {}'", nl,
        "'}'", nl, "focal_code",
    ])
    go = " || ".join([
        "'package main'", nl, "'import \"fmt\"'", nl, "'import ('", nl, "'    \"os\"'", nl, "')'", nl,
        "'func helper() {'", nl, "'    fmt.Println(\"(\")'", nl, "'}'", nl, "focal_code",
    ])
    julia = " || ".join(["'using Test'", nl, "'import Base: show,'", nl, "'    print'", nl, "'x = 1'", nl, "focal_code"])
    return f"(CASE lang WHEN 'Rust' THEN {rust} WHEN 'Go' THEN {go} ELSE {julia} END)"


FILE_SQL = _file_sql()


def bench_files(spark: SparkSession, sf: str) -> DataFrame:
    b = bench_cases(spark, sf)
    item = F.col("ordinal_in")
    defs = F.array(F.concat(F.lit("struct Arg"), item.cast("string"), F.lit(" {}")), F.lit("  "))
    return b.select(
        "*",
        F.expr(FILE_SQL).alias("file_content"),
        F.when(item % 3 == 0, F.concat(F.lit("ctx "), F.col("function_name"))).alias("context"),
        F.when(item % 5 == 0, F.lit("struct Holder {}")).alias("struct_class"),
        F.when(item % 2 == 0, F.struct(F.array(F.struct(defs.alias("definitions"))).alias("argument_definitions"))).alias(
            "function_component"
        ),
    )


BENCH_FILES_SQL = f"""SELECT *, {FILE_SQL} AS file_content,
       CASE WHEN ordinal_in % 3 = 0 THEN 'ctx ' || function_name END AS context,
       CASE WHEN ordinal_in % 5 = 0 THEN 'struct Holder {{}}' END AS struct_class,
       CASE WHEN ordinal_in % 2 = 0 THEN {{'argument_definitions': [{{'definitions': ['struct Arg' || CAST(ordinal_in AS VARCHAR) || ' {{}}', '  ']}}]}} END
         AS function_component
FROM ({BENCH_SQL})"""


class GappedEmbedder:
    """The md5 embedder, without a vector for texts of a length that 7 divides: bad cases for the retrieval."""

    def __init__(self, dim: int = 64) -> None:
        from ..functions.embedders import HashedEmbedder

        self.inner = HashedEmbedder(dim, hash_fn="md5")
        self.name, self.embedding_dim = f"gapped-{dim}", dim

    def transform(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        made = self.inner.transform(df, text_col, out_col)
        return made.withColumn(out_col, F.when(F.length(text_col) % 7 != 0, F.col(out_col)))


def load_md5_model(dim: int):
    """A model for ``BatchedEmbedder``: token counts by md5 buckets, as matrices of a batch."""

    def load():
        import hashlib
        import re

        import numpy as np

        from ..functions.embedders import unit_rows

        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                for token in re.findall(r"\w+", text.lower()):
                    out[i, int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
            return unit_rows(out)

        return model

    return load

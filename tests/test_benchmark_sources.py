import json
import os

from pyspark.sql import functions as F

from exemplar.functions.embedders import HashedEmbedder
from exemplar.plans.retrieval import create_full_pipeline
from exemplar.sources.benchmark import positional_merge, rag_context, read_benchmark, read_contexts
from exemplar.sources.index_store import ExampleIndex


def _jsonl(path, rows):
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")


def test_read_benchmark_and_pipeline(spark, tmp_dir):
    _jsonl(os.path.join(tmp_dir, "rust.jsonl"), [{"focal_code": "fn add(a: i32, b: i32) -> i32 { a + b }", "function_name": "add"}, {"focal_code": ""}])
    _jsonl(os.path.join(tmp_dir, "go.jsonl"), [{"id": "g1", "focal_code": "func Sum(a int, b int) int { return a + b }", "function_name": "Sum"}])
    bench = read_benchmark(spark, {"rust": os.path.join(tmp_dir, "rust.jsonl"), "go": os.path.join(tmp_dir, "go.jsonl")})
    assert sorted(bench.select("lang").distinct().toPandas()["lang"]) == ["go", "rust"]
    corpus = spark.createDataFrame(
        [(1, "fn add(x: i32, y: i32) -> i32 { x + y }", "#[test] fn t() {}", "{}"), (2, "func Mul(a int) int { return a }", "func TestMul() {}", "{}")],
        "example_id long, focal_method string, unit_test string, metadata string",
    )
    idx = ExampleIndex(spark, HashedEmbedder(32)).add_examples(corpus).build()
    assert idx.size == 2
    run, _ = create_full_pipeline(spark, HashedEmbedder(32), top_k=1, threshold=0.0, index=idx)
    out = {(r.lang, r.id): r for r in run(bench.drop("id")).collect()}
    # without an id field, ids are case_{i} per split; the empty case is skipped
    assert set(out) == {("rust", "case_1"), ("go", "case_1")}
    assert all(len(r.retrieved_context.results) == 1 for r in out.values())
    assert out[("rust", "case_1")].retrieved_context.results[0].example.focal_method.startswith("fn add")


def test_contexts_rag_and_positional(spark, tmp_dir):
    p = os.path.join(tmp_dir, "ctx.jsonl")
    _jsonl(p, [{"id": "a", "retrieved_context": {"focal_method": "f", "status": "success", "results": []}}])
    assert read_contexts(spark, p).first().retrieved_context.status == "success"
    hits = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 1, 10)], "id string, rank int, doc_id long")
    texts = spark.createDataFrame([(10, "ten"), (20, "twenty")], "doc_id long, text string")
    ctx = {r.id: r.context for r in rag_context(hits, texts).collect()}
    assert ctx == {"a": "ten\n\ntwenty", "b": "ten"}
    bench = spark.createDataFrame([("x", 0), ("y", 1)], "id string, pos long")
    c = read_contexts(spark, p)
    merged = {r.id: r.retrieved_context for r in positional_merge(bench, c).collect()}
    assert merged["x"] is not None and merged["y"] is None

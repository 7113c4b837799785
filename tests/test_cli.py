import json
import os

from exemplar import cli


def _jsonl(path, rows):
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")


def test_retrieve_prompts_clean_compare(spark, tmp_dir):
    corpus = os.path.join(tmp_dir, "corpus.jsonl")
    _jsonl(corpus, [
        {"focal_method": "fn add(a: i32, b: i32) -> i32 { a + b }", "unit_test": "#[test]\nfn test_add() { assert_eq!(add(1, 2), 3); }"},
        {"focal_method": "fn mul(a: i32, b: i32) -> i32 { a * b }", "unit_test": "#[test]\nfn test_mul() {}"},
    ])
    rust = os.path.join(tmp_dir, "rust.jsonl")
    _jsonl(rust, [{"id": "r1", "focal_code": "fn add2(a: i32, b: i32) -> i32 { a + b }", "function_name": "add2", "file_path": "src/lib.rs"}])
    out = os.path.join(tmp_dir, "ctx")
    cli.main(["retrieve", "--corpus", corpus, "--benchmark", f"rust={rust}", "--index-dir", os.path.join(tmp_dir, "idx"),
              "--out", out, "--top-k", "1", "--dim", "32"])
    ctx = spark.read.json(out).collect()
    assert len(ctx) == 1 and ctx[0].id == "r1" and len(ctx[0].retrieved_context.results) == 1

    prompts = os.path.join(tmp_dir, "prompts")
    cli.main(["prompts", "--benchmark", f"Rust={rust}", "--out", prompts, "--instruct"])
    q = spark.read.json(prompts).first()
    assert q.question.endswith("fn test_add2() {") and q.task_id == 0

    answers = os.path.join(tmp_dir, "answers.jsonl")
    _jsonl(answers, [{"prompt": "x\n    fn test_add2() {", "response": ["\n        assert!(true);\n    }\n"]}])
    cleaned = os.path.join(tmp_dir, "cleaned")
    cli.main(["clean", "--input", answers, "--out", cleaned, "--lang", "rust"])
    assert spark.read.json(cleaned).first().response[0].startswith("    #[test]\n    fn test_add2() {")

    ev = os.path.join(tmp_dir, "eval", "Rust", "standard", "m1")
    os.makedirs(ev)
    with open(os.path.join(ev, "summary.json"), "w") as f:
        json.dump({"test_pass_rate": 10.0}, f)
    cli.main(["compare", "--eval-dir", os.path.join(tmp_dir, "eval"), "--out", os.path.join(tmp_dir, "reports")])
    assert os.path.isdir(os.path.join(tmp_dir, "reports", "comparison_consolidated_summary.csv"))

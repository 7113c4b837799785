import json
import os

from exemplar.operators.inference import generate_all, generate_one
from exemplar.streaming.incremental import clean_new_files, list_files


def _write(path, rows):
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_incremental_only_new_files(spark, tmp_dir):
    raw, out, ck = (os.path.join(tmp_dir, x) for x in ("raw", "out", "ck"))
    os.makedirs(raw)
    _write(os.path.join(raw, "a.jsonl"), [{"task_id": 1, "prompt": "p\n@testset", "response": ["x"]}])
    _write(os.path.join(raw, "processed_a.jsonl"), [{"task_id": 9, "prompt": "p", "response": ["zz"]}])
    clean_new_files(spark, raw, out, ck, "julia")
    first = spark.read.json(out).collect()
    assert [r.task_id for r in first] == [1] and first[0].response == ["@testsetx"]
    _write(os.path.join(raw, "b.jsonl"), [{"task_id": 2, "prompt": "p\n@testset", "response": ["y"]}])
    clean_new_files(spark, raw, out, ck, "julia")
    assert sorted(r.task_id for r in spark.read.json(out).collect()) == [1, 2]
    names = sorted(r.name for r in list_files(spark, raw).collect())
    assert names == ["a.jsonl", "b.jsonl"]


def test_retry_contract():
    calls = {"n": 0}

    def flaky(prompt, n):
        calls["n"] += 1
        if calls["n"] < 3:
            raise RuntimeError("busy")
        return ["ok"] * n

    assert generate_one(flaky, "p", 2, attempts=3, delay=0) == ["ok", "ok"]

    def broken(prompt, n):
        raise RuntimeError("down")

    assert generate_one(broken, "p", 3, attempts=3, delay=0) == ["", "", ""]


def test_generate_all(spark):
    df = spark.createDataFrame([(0, "a\nb", "f", "x.rs"), (1, None, "g", None)], "task_id long, question string, function_name string, file_path string")
    rows = sorted(generate_all(df, lambda p, n: [p.upper()] * n, n=2, concurrency=2).collect(), key=lambda r: r.task_id)
    assert rows[0].generated == ["A\nB", "A\nB"] and rows[1].generated == ["", ""]


def test_pending_evaluations(spark, tmp_dir):
    from exemplar.streaming.incremental import pending_evaluations

    for d, with_summary in (("Rust/fewshot/m1", True), ("Go/fewshot/m1", False)):
        os.makedirs(os.path.join(tmp_dir, d))
        _write(os.path.join(tmp_dir, d, "processed_input.jsonl"), [{"task_id": 1}])
        if with_summary:
            _write(os.path.join(tmp_dir, d, "summary.json"), [{"total_samples": 1}])
    got = [r.dir for r in pending_evaluations(spark, tmp_dir).collect()]
    assert len(got) == 1 and got[0].endswith("Go/fewshot/m1")


def test_a_restarted_stream_reads_new_files_only(spark, tmp_dir):
    raw, out, ck = (os.path.join(tmp_dir, x) for x in ("raw", "out", "ck"))
    os.makedirs(raw)
    for run, n in ((1, 5), (2, 3), (3, 0)):
        for i in range(n):
            _write(os.path.join(raw, f"r{run}_{i}.jsonl"), [{"task_id": 10 * run + i, "prompt": "p\nfn test_", "response": ["a() {}", None]}] * 2)
        q = clean_new_files(spark, raw, out, ck, "rust", run=run, max_files=2)
        read = [p["numInputRows"] for p in q.recentProgress]
        assert sum(read) == 2 * n and all(x <= 4 for x in read)
    rows = spark.read.json(out).collect()
    assert sorted((r.run, r.task_id) for r in rows) == sorted([(1, 10 + i) for i in range(5)] * 2 + [(2, 20 + i) for i in range(3)] * 2)
    assert all(r.response == ["    #[test]\n    fn test_a() {}"] for r in rows)


def test_nothing_to_evaluate_yet(spark, tmp_dir):
    from exemplar.streaming.incremental import pending_evaluations

    assert pending_evaluations(spark, os.path.join(tmp_dir, "nowhere")).collect() == []
    assert pending_evaluations(spark, tmp_dir).collect() == []

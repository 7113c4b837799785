import json
import os

import pytest
from pyspark.sql import functions as F

from exemplar.functions.embedders import CallableEmbedder, HashedEmbedder
from exemplar.sources.audit import audit_outputs
from exemplar.sources.corpus import numbered_lines, read_corpus
from exemplar.sources.index_store import ExampleIndex, Store, append, build_or_load, load_index


def _corpus(path):
    lines = [
        json.dumps({"focal_method": "fn a() {}", "unit_test": "t1", "metadata": {"x": {"y": 1}}}),
        "{not json",
        "",
        json.dumps({"focal_method": "", "unit_test": "t"}),
        json.dumps({"focal_method": "   ", "unit_test": "t2"}),
        json.dumps({"focal_method": "fn b(x: i32) {}", "unit_test": "t3"}),
        json.dumps([1, 2]),
    ]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_corpus_rules(spark, tmp_dir):
    p = os.path.join(tmp_dir, "c.jsonl")
    _corpus(p)
    rows = read_corpus(spark, p).collect()
    assert [r.focal_method for r in rows] == ["fn a() {}", "   ", "fn b(x: i32) {}"]
    assert json.loads(rows[0].metadata) == {"x": {"y": 1}} and rows[1].metadata == "{}"
    # the limit counts input lines, skipped ones included
    assert [r.unit_test for r in read_corpus(spark, p, max_examples=5).collect()] == ["t1", "t2"]


def test_index_build_or_load(spark, tmp_dir):
    p = os.path.join(tmp_dir, "c.jsonl")
    _corpus(p)
    idx_path = os.path.join(tmp_dir, "index")
    emb = HashedEmbedder(16)
    idx = build_or_load(spark, idx_path, p, emb)
    rows = idx.orderBy("focal_method").collect()
    assert len(rows) == 3 and {r.dim for r in rows} == {16} and {r.embedder for r in rows} == {"hashed-16"}
    assert [r.param_count for r in rows if r.focal_method.startswith("fn b")] == [1]
    again = build_or_load(spark, idx_path, os.path.join(tmp_dir, "missing.jsonl"), emb)  # reused
    assert again.count() == 3
    try:
        load_index(spark, idx_path, "hashed-16", expected_dim=8)
        raise AssertionError("dimension mismatch not detected")
    except ValueError:
        pass


def test_callable_embedder(spark):
    emb = CallableEmbedder(lambda s: [[float(len(t)), 1.0] for t in s], 2, "len")
    df = spark.createDataFrame([("abc",), ("",)], "t string")
    assert [r.e for r in emb.transform(df, "t", "e").collect()] == [[3.0, 1.0], [0.0, 1.0]]


def test_audit(spark, tmp_dir):
    d = os.path.join(tmp_dir, "m1", "rust")
    os.makedirs(d)
    with open(os.path.join(d, "data_with_fewshot.jsonl"), "w") as f:
        f.write('{"id": 1}\n{"id": 2}\n')
    rows = {(r.model, r.lang): r for r in audit_outputs(spark, tmp_dir, ["m1", "m2"]).collect()}
    assert rows[("m1", "rust")].lines == 2 and rows[("m1", "rust")].found
    assert not rows[("m2", "go")].found and rows[("m2", "go")].lines == 0


def test_missing_corpus_is_empty(spark, tmp_dir):
    import os

    assert read_corpus(spark, os.path.join(tmp_dir, "nope.jsonl")).count() == 0


def test_audit_partitioned_layout(spark, tmp_dir):
    import os

    df = spark.createDataFrame([("a", "rust", "hashed-64"), ("b", "rust", "hashed-64"), ("c", "go", "hashed-64")], "id string, lang string, embedder string")
    out = os.path.join(tmp_dir, "ctx")
    df.write.partitionBy("embedder", "lang").json(out)
    rows = {(r.model, r.lang): r for r in audit_outputs(spark, out, ["hashed-64"], file_name=None).collect()}
    assert rows[("hashed-64", "rust")].lines == 2 and rows[("hashed-64", "go")].lines == 1
    assert not rows[("hashed-64", "julia")].found


class _Counting:
    """An embedder that fails on texts it must not see."""

    name, embedding_dim = "count", 2

    def __init__(self, seen=()):
        self.seen = set(seen)

    def transform(self, df, text_col, out_col="embedding"):
        again = F.col(text_col).isin(*self.seen) if self.seen else F.lit(False)
        return df.withColumn(out_col, F.when(again, F.raise_error(F.lit("embedded twice")).cast("array<float>")).otherwise(F.array(F.lit(1.0), F.length(text_col)).cast("array<float>")))


def test_index_versions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "index")
    rows = lambda *xs: spark.createDataFrame([(x, "t " + x, None) for x in xs], "focal_method string, unit_test string, metadata string")
    assert append(rows("fn a() {}", "fn b() {}", "fn b() {}"), path, _Counting()) == 1
    # only what is new is embedded; ids go on
    assert append(rows("fn b() {}", "fn c(x: u8) {}"), path, _Counting({"fn a() {}", "fn b() {}"})) == 2
    assert append(rows("fn c(x: u8) {}"), path, _Counting({"fn c(x: u8) {}"})) is None
    read = lambda v=None: sorted(r.focal_method for r in load_index(spark, path, "count", 2, v).collect())
    assert read(1) == ["fn a() {}", "fn b() {}"] and read() == read(2) == ["fn a() {}", "fn b() {}", "fn c(x: u8) {}"]
    ids = [r.example_id for r in load_index(spark, path, "count").collect()]
    assert len(set(ids)) == 3
    # a failed write leaves the versions that are there
    broken = rows("fn d() {}").withColumn("unit_test", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        append(broken, path, _Counting())
    assert Store(spark, path, "count").versions() == [1, 2] and len(read()) == 3
    # another dimension is an error, also for build-or-load, and nothing is rebuilt over the index
    other = _Counting()
    other.embedding_dim = 3
    with pytest.raises(ValueError):
        append(rows("fn e() {}"), path, other)
    with pytest.raises(ValueError):
        build_or_load(spark, path, os.path.join(tmp_dir, "none.jsonl"), other)
    with pytest.raises(ValueError):
        load_index(spark, path, "count", 2, version=7)
    with pytest.raises(FileNotFoundError):
        load_index(spark, path, "nobody")
    # a version that someone else has published is not replaced
    store = Store(spark, path, "count")
    with pytest.raises(RuntimeError):
        store.publish(store.manifest()["tables"], 2, 1)
    assert len(read()) == 3


def test_rows_with_vectors_are_not_embedded_again(spark):
    rows = lambda *xs: spark.createDataFrame([(x, "t", "{}") for x in xs], "focal_method string, unit_test string, metadata string")
    index = ExampleIndex(spark, _Counting()).add_examples(rows("fn a() {}")).build()
    index.embedder = _Counting({"fn a() {}"})
    got = index.add_examples(rows("fn b() {}")).build().rows.collect()
    assert sorted((r.focal_method, r.dim) for r in got) == [("fn a() {}", 2), ("fn b() {}", 2)] and len({r.example_id for r in got}) == 2


def test_only_a_missing_path_reads_as_empty(spark, tmp_dir):
    with pytest.raises(Exception):
        read_corpus(spark, "nosuchscheme://x/y").count()


def test_lines_are_numbered_over_files_of_unequal_size(spark, tmp_dir):
    """Splits of a few bytes, blank and corrupt lines, a limit inside the second file."""
    sizes, lines = (7, 400, 0, 1, 60), []
    for i, n in enumerate(sizes):
        mine = ["" if j % 9 == 4 else "{no" if j % 9 == 7 else json.dumps({"focal_method": f"f{i}_{j}", "unit_test": "t" * (j % 13 + 1)}) for j in range(n)]
        with open(os.path.join(tmp_dir, f"{i}.jsonl"), "w") as f:
            f.writelines(x + "\n" for x in mine)
        lines += mine
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        read = numbered_lines(spark, tmp_dir + "/*.jsonl")
        assert "Sort" not in read._jdf.queryExecution().optimizedPlan().toString().replace("SortMerge", "").replace("Sort [_file", "")
        assert [(r.line, r.value) for r in sorted(read.collect(), key=lambda r: r.line)] == list(enumerate(lines))
        for limit in (1, 7, 8, 100, 407, 10_000):
            want = [json.loads(x)["focal_method"] for x in lines[:limit] if x.startswith("{\"")]
            assert sorted(r.focal_method for r in read_corpus(spark, tmp_dir + "/*.jsonl", limit).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)

import corpus_pipeline

from exemplar.llm import bpe, decontaminate, jaccard, queries, secrets, toxicity
from exemplar.session import written

from .common import SF, docs
from .test_decontaminate import brute as leaks
from .test_jaccard import brute as near
from .test_secrets import base_spans


def test_stages_against_brute_force(spark):
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES:
        before = kept.collect()
        kept = written(stage(spark, kept, SF), "test-stage")
        after = {r.doc_id: r for r in kept.collect()}
        texts = {r.doc_id: r.text for r in before}
        assert set(after) <= set(texts) and len(after) == kept.count()
        if name != "bpe":
            assert kept.columns == columns
        if name == "toxicity":
            predicted = queries.QUERIES["op3_toxicity"](spark, SF).collect()
            assert set(after) == {r.doc_id for r in predicted if not r.predicted}
            assert all(after[i].text == texts[i] for i in after)
        elif name == "ngram_jaccard":
            rows = sorted(texts.items())
            assert set(after) == {i for i, size, c in near(rows, 5, 4, 5) if not size or c == i}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            rows = sorted(texts.items())
            dirty = {rows[d][0] for d, *_ in leaks([t for _, t in rows], items)}
            assert set(after) == set(texts) - dirty
        elif name == "secret_scan":
            assert set(after) == set(texts)
            assert all(not base_spans(r.text) and r.n_chars == len(r.text) for r in after.values())
            assert all(after[i].text == t for i, t in texts.items() if not base_spans(t) and "[SECRET]" not in after[i].text)
        else:
            assert name == "bpe" and {i: r.text for i, r in after.items()} == texts


def test_every_stage_takes_an_empty_table_and_clashing_columns(spark):
    empty = docs(spark, []).withColumnRenamed("spans", "ids")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.collect() == [] and set(empty.columns) <= set(out.columns)
    rows = docs(spark, [None, "", "password=abcdefgh here", "password=abcdefgh here"], [1, 2, 3, 3])
    for name, stage in corpus_pipeline.STAGES:
        rows = written(stage(spark, rows, SF), "test-stage")
        assert set(docs(spark, []).columns) <= set(rows.columns)
    assert sorted(((r.doc_id, r.text) for r in rows.collect()), key=repr) == [(1, ""), (2, ""), (3, "[SECRET] here")]


def test_stage_operators_are_the_five_asked_for():
    assert [f.__code__.co_names[0] for _, f in corpus_pipeline.STAGES][1:4] == ["jaccard", "decontaminate", "secrets"]
    assert {bpe, decontaminate, jaccard, secrets, toxicity} <= {v for v in vars(corpus_pipeline).values() if hasattr(v, "__file__")}

import json
import os

import numpy as np
import pandas as pd
import pytest

from exemplar.operators import compare as C
from exemplar.sources.summaries import read_summaries, write_reports

M = "Test Pass Rate (%)"


def _write(root, lang, mode, model, payload):
    d = os.path.join(root, lang, mode, model)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "summary.json"), "w") as f:
        f.write(payload if isinstance(payload, str) else json.dumps(payload))


def _tree(root):
    _write(root, "Rust", "standard", "m1", {"total_samples": 10, "test_pass_rate": 20.0, "compiled_rate": 50.0})
    _write(root, "Rust", "fewshot", "m1", {"total_samples": 10, "test_pass_rate": 30.0})
    _write(root, "Rust", "standard", "m2", {"test_pass_rate": 0.0})
    _write(root, "Rust", "fewshot", "m2", {"test_pass_rate": 5.0})
    _write(root, "Go", "fewshot", "m1", {"test_pass_rate": 12.5})  # one mode only
    _write(root, "Go", "standard", "m3", "{not json")  # malformed: skipped
    _write(root, "Go", "other", "m1", {"test_pass_rate": 99.0})  # other mode: ignored
    _write(root, "Julia", "standard", "m1", {"test_pass_rate": 40.0})
    _write(root, "Julia", "fewshot", "m1", {"test_pass_rate": 40.0})  # tie


def _pandas_detailed(results, metric):
    # independent pandas formulation of the documented semantics
    df = pd.DataFrame(results)
    p = df.pivot_table(index=["Language", "Model"], columns="Mode", values=metric, aggfunc="first").reset_index()
    for m in ("standard", "fewshot"):
        if m not in p.columns:
            p[m] = 0.0
    p["diff"] = (p["fewshot"] - p["standard"]).round(4)
    p["rel"] = ((p["fewshot"] - p["standard"]) / p["standard"] * 100).round(2).replace([np.inf, -np.inf], 0).fillna(0)
    return p.sort_values(["Language", "Model"])


def test_read_and_detailed(spark, tmp_dir):
    _tree(tmp_dir)
    res = read_summaries(spark, tmp_dir)
    rows = res.collect()
    assert len(rows) == 7
    m1 = [r for r in rows if r.Language == "Rust" and r.Model == "m1" and r.Mode == "fewshot"][0]
    assert m1["Compiled Rate (%)"] == 0.0 and m1["Total Samples"] == 10
    det = C.detailed_comparison(res, M).collect()
    want = _pandas_detailed([r.asDict() for r in rows], M)
    got = [(r.Language, r.Model, r["Standard " + M], r["Few-Shot " + M], r["Absolute Diff"], r["Relative Improvement (%)"]) for r in det]
    exp = [
        (a, b, None if pd.isna(s) else s, None if pd.isna(f) else f, None if pd.isna(d) else d, r)
        for a, b, s, f, d, r in want[["Language", "Model", "standard", "fewshot", "diff", "rel"]].itertuples(index=False)
    ]
    assert got == exp
    w = C.wins(C.detailed_comparison(res, M), M).first()
    assert (w.wins, w.total) == (2, 4)


def test_missing_mode_column_is_zero(spark, tmp_dir):
    _write(tmp_dir, "Rust", "fewshot", "m1", {"test_pass_rate": 10.0})
    det = C.detailed_comparison(read_summaries(spark, tmp_dir), M).first()
    assert det["Standard " + M] == 0.0 and det["Relative Improvement (%)"] == 0.0


def test_summaries_and_consolidated(spark, tmp_dir):
    _tree(tmp_dir)
    res = read_summaries(spark, tmp_dir)
    by_lang = {r.Language: r for r in C.summary_by_language(res, M).collect()}
    assert by_lang["Rust"]["Avg Standard " + M] == pytest.approx(10.0)
    assert by_lang["Rust"]["Relative Improvement (%)"] == pytest.approx(75.0)
    by_model = C.summary_by_model(res, M).collect()
    assert [r.Model for r in by_model] == sorted([r.Model for r in by_model], key=lambda m: -[x for x in by_model if x.Model == m][0]["Relative Improvement (%)"])
    cons = {r.Metric: r for r in C.consolidated_summary(res).collect()}
    assert cons[M]["Avg Standard"] == pytest.approx(20.0)
    assert cons[M]["Avg Few-Shot"] == pytest.approx(round((30 + 5 + 12.5 + 40) / 4, 4))
    assert cons["Compiled Rate (%)"]["Improvement (%)"] == pytest.approx(-100.0)


def test_half_even_rounding(spark):
    df = spark.createDataFrame([("L", "standard", "m", 1.0), ("L", "fewshot", "m", 1.00125)], "Language string, Mode string, Model string, `Test Pass Rate (%)` double")
    r = C.detailed_comparison(df, M).first()
    assert r["Absolute Diff"] == 0.0012


def test_reports_written(spark, tmp_dir):
    _tree(os.path.join(tmp_dir, "in"))
    out = write_reports(read_summaries(spark, os.path.join(tmp_dir, "in")), os.path.join(tmp_dir, "out"))
    assert len(out) == 16 and any("comparison_Test_Pass_Rate__detailed.csv" in p for p in out)
    assert C.metric_slug("Test Pass Rate (%)") == "Test_Pass_Rate_"


def test_report_table_is_the_reports(spark, tmp_dir):
    """One scan and the rows, values and order of every single report."""
    _tree(tmp_dir)
    res = read_summaries(spark, tmp_dir)
    table = C.report_table(res)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") >= 1 and plan.count("Pivot") == 0
    rows = sorted((r.asDict() for r in table.collect()), key=lambda r: (r["view"], r["metric"], r["position"]))
    pick = lambda view, metric: [r for r in rows if r["view"] == view and r["metric"] == metric]
    for metric in C.METRICS:
        for view, fn, keys, avg in (
            ("detailed", C.detailed_comparison, ["Language", "Model"], ""),
            ("by_language", C.summary_by_language, ["Language"], "Avg "),
            ("by_model", C.summary_by_model, ["Model"], "Avg "),
        ):
            names = [*keys, f"{avg}Standard {metric}", f"{avg}Few-Shot {metric}", "Absolute Diff", "Relative Improvement (%)"]
            want = [tuple(r[n] for n in names) for r in fn(res, metric).collect()]
            got = [tuple(r[n] for n in (*keys, "standard", "fewshot", "absolute_diff", "relative_improvement")) for r in pick(view, metric)]
            assert got == want, (view, metric)
    whole = [tuple(r[n] for n in ("metric", "standard", "fewshot", "absolute_diff", "relative_improvement")) for r in sorted((r for r in rows if r["view"] == "consolidated"), key=lambda r: r["position"])]
    assert whole == [tuple(r) for r in C.consolidated_summary(res).collect()]
    one_mode = res.where("Mode = 'standard'")
    got = {(r.view, r.Language, r.Model): r.fewshot for r in C.report_table(one_mode).collect() if r.view == "detailed"}
    assert got and set(got.values()) == {0.0}
    assert {r[f"Few-Shot {M}"] for r in C.detailed_comparison(one_mode, M).collect()} == {0.0}


def test_mean_vectors(spark):
    from exemplar.functions.vectors import mean_vectors

    rows = [(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0]), (None, [1.0, 1.0]), (1, None), (1, [None, 1.0]), (2, [9.0])]
    df = spark.createDataFrame(rows, "label long, v array<double>").repartition(3)
    got = sorted(((r.label, list(r.centroid)) for r in mean_vectors(df, "label", "v").collect()), key=repr)
    assert got == sorted([(1, [2.0, 3.0]), (2, [5.0, 6.0]), (2, [9.0]), (None, [1.0, 1.0])], key=repr)
    assert mean_vectors(df.limit(0), "label", "v").collect() == []

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from exemplar.llm import queries, toxicity
from pyspark.sql import functions as F

from .common import LONG, SF, docs


def brute_segments(values):
    """All maximal scoring segments by recursion: the best segment (shortest, leftmost), then either side of it."""
    best = None
    for i in range(len(values)):
        for j in range(i + 1, len(values) + 1):
            s = sum(values[i:j])
            if s > 0 and (best is None or s > best[0] or (s == best[0] and j - i < best[2] - best[1])):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return brute_segments(values[:i]) + [(s, i, j)] + [(t, a + j, b + j) for t, a, b in brute_segments(values[j:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(1, 997)), max_size=14))
def test_segments_are_the_maximal_scoring_ones(words):
    # distinct scores, so that there are no ties; a word that is no hit costs 300
    values = [float(w) + i / 97 if w else -300.0 for i, w in enumerate(words)]
    got = toxicity.segments(np.array(values))  # what the scorer runs
    assert [(round(s, 6), a, b) for s, a, b in got] == [(round(s, 6), a, b) for s, a, b in brute_segments(values)]


def _made(spark, n=600):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                t.insert(rng.randrange(len(t)), rng.choice(["zyxword", "Vile!", "qqqstem" + rng.choice(words)]))
        texts.append(" ".join(t))
        toxic.append(int(bad))
    table = docs(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    return table, labels, toxic


def test_held_out_labels(spark):
    table, labels, toxic = _made(spark)
    model = toxicity.fit(table, labels.where(~toxicity.held_out(F.col("doc_id"))))
    rows = toxicity.score(table, model).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    out = [(r.score >= 0.3) == bool(toxic[r.doc_id]) for r in rows if r.out]
    assert len(out) > 100 and sum(out) >= 0.97 * len(out)
    for r in rows:
        for p in r.passages:
            assert 0 <= p.first_word < p.end_word and p.e_value <= toxicity.SIGNIFICANT


def test_awkward_rows(spark):
    table, labels, _ = _made(spark)
    model = toxicity.fit(table, labels)
    texts = [None, "", "...", LONG, "zyxword vile zyxword", "zyxword vile zyxword"]
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts), model).collect()}
    assert got[0] == got[1] == got[2] < 0.3 and got[3] < 0.3 and got[4] == got[5] > 0.9
    kept = toxicity.clean(docs(spark, texts), model)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]
    assert toxicity.score(docs(spark, []), model).collect() == []


def test_without_labels(spark):
    table, labels, _ = _made(spark, 20)
    none = toxicity.fit(table, labels.where("toxic = 2"))
    assert {r.score for r in toxicity.score(table, none).collect()} == {0.0}
    one = toxicity.fit(table, labels.where("toxic = 1"))
    assert {r.score for r in toxicity.score(table, one).collect()} == {1.0}
    nulls = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(table, toxicity.fit(table, nulls)).collect()} == {0.0}


def test_query_over_the_table(spark):
    rows = queries.QUERIES["op3_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_mild_and_rare_tokens_count(spark):
    """No token is toxic in five training texts: each toxic text has words of its own few, and mild ones."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(900):
        t = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if i % 6 == 0:
            at = rng.randrange(len(t))
            t[at:at] = [f"{rng.choice('xyz')}{rng.randrange(14)}{rng.choice('uvw')}" for _ in range(8)]
        texts.append(" ".join(t))
        toxic.append(int(i % 6 == 0))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int").where("doc_id < 240 OR toxic = 0 AND doc_id < 600")
    table = docs(spark, texts)
    model = toxicity.fit(table, labels)
    assert (model.odds < 0).any() and (model.odds > 0).any()
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    held = range(600, 900)
    found = [got[i] >= 0.3 for i in held if toxic[i]]
    false = [got[i] >= 0.3 for i in held if not toxic[i]]
    assert sum(found) >= 0.9 * len(found) and sum(false) <= 0.03 * len(false)


def test_choice_is_made_by_the_training_rows_alone(spark, monkeypatch):
    """Prior and shift are those of the least log-loss, and rows that are held out change nothing."""
    table, labels, _ = _made(spark, 300)
    losses = []
    calibrate = toxicity._calibrate

    def noted(model, rows):
        out = calibrate(model, rows)
        losses.append(out[1])
        return out

    monkeypatch.setattr(toxicity, "_calibrate", noted)
    model = toxicity.fit(table, labels)
    assert len(losses) == len(toxicity.PRIORS) * len(toxicity.SHIFTS)
    at = int(np.argmin(losses))
    chosen = (toxicity.PRIORS[at // len(toxicity.SHIFTS)], toxicity.SHIFTS[at % len(toxicity.SHIFTS)])
    monkeypatch.setattr(toxicity, "PRIORS", chosen[:1])
    monkeypatch.setattr(toxicity, "SHIFTS", chosen[1:])
    assert abs(toxicity.fit(table, labels).shift - model.shift) < 1e-6

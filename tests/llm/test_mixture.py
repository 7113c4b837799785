import random
import re
from collections import Counter
from fractions import Fraction

from exemplar.llm import mixture, queries
from exemplar.llm.queries_sql import SQL
from pyspark.sql import functions as F

from .common import LONG, SF, oracle, same

SCHEMA = "doc_id long, text string, source string, size long, target double, row string, weight int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 0.5, "r", 9) for i, t, s in rows], SCHEMA)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights, share=Fraction(3, 2), epochs=2):
    """Targets by the rounds as stated, in fractions."""
    out, free = {}, dict(weights)
    while True:
        rest = share * sum(sizes.values()) - sum(out.values())
        total = sum(free.values())
        over = [s for s in free if total and free[s] * rest > epochs * sizes[s] * total]
        if not over:
            return out | {s: Fraction(w) * rest / total for s, w in free.items()} if total else out
        for s in over:
            out[s] = Fraction(epochs * sizes[s])
            del free[s]


def corpus(n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "ü", "漢", "c", None, "tiny"] if i % 50 else ["tiny2"])
        rows.append((i, " ".join("w" * rng.randint(1, 9) for _ in range(min(400, int(rng.paretovariate(0.8))))), source))
    return rows


def run(spark, rows):
    return [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixture.digest(table(spark, rows)).collect()]


def test_query_matches_sql(spark):
    same(queries.QUERIES["op11_source_mix"](spark, SF), oracle(SQL["op11_source_mix"]))


def test_targets_and_words_taken(spark):
    rows = corpus()
    got = run(spark, rows)
    by_id = {i: (words(t), s) for i, t, s in rows}
    sizes = Counter()
    for n, s in by_id.values():
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    taken = Counter()
    assert sorted(r[0] for r in got) == sorted(by_id)
    for doc_id, size, source_size, target, t in got:
        n, s = by_id[doc_id]
        assert (size, source_size) == (n, sizes[s]) and abs(target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= t <= 2 * n
        assert t % max(n, 1) == 0
        taken[s] += t
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(3, 0.002 * target), s
    assert sorted(run(spark, rows)) == sorted(got)


def test_every_size_gives_its_share(spark):
    rows = [(i, "w " * (1 + 40 * (i % 2)), "only") for i in range(4000)] + [(9000 + i, "v " * 41, "other") for i in range(400)]
    got = run(spark, rows)
    for parity in (0, 1):
        mine = [r for r in got if r[0] < 9000 and r[0] % 2 == parity]
        assert abs(sum(r[4] for r in mine) / sum(r[1] for r in mine) - mine[0][3] / mine[0][2]) < 0.05  # the short ones make up for one long one


def test_awkward_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, LONG, "b"), (5, "one", "b"), (None, "x y", "b"), (None, None, None), (7, "same", "c"), (7, "same", "c")]
    got = run(spark, rows)
    assert sorted(r[1] for r in got) == sorted(words(t) for _, t, _ in rows)
    assert all(0 <= r[4] <= 2 * r[1] for r in got)
    same7 = [r for r in got if r[0] == 7]
    assert len(same7) == 2 and same7[0] == same7[1]
    assert run(spark, []) == []
    assert [r[3:] for r in run(spark, [(1, None, "a"), (2, " ", None)])] == [(0.0, 0), (0.0, 0)]


def test_target_edges(spark):
    def targets(rows, share, epochs):
        sizes = spark.createDataFrame(rows, "source string, source_size long, weight double")
        return {r.source: r.target for r in mixture.targets(sizes, share, epochs).collect()}

    assert targets([("a", 10, 1.0), ("b", 1000, 1.0)], 0.5, 2) == {"a": 20.0, "b": 485.0}
    assert targets([("a", 10, 1.0), ("b", 10, 1.0)], 5.0, 2) == {"a": 20.0, "b": 20.0}  # more than there is
    assert targets([("a", 10, 0.0), ("b", 10, None), ("c", 10, -1.0), ("d", 10, float("nan"))], 1.0, 2) == dict.fromkeys("abcd", 0.0)
    assert targets([("a", 10, 1.0), ("b", 10, 0.0)], 1.0, 4) == {"a": 20.0, "b": 0.0}
    assert targets([("a", 0, 1.0), ("b", 10, 1.0)], 1.0, 2) == {"a": 0.0, "b": 10.0}
    # one clamp after the other: each round another source
    chain = [(str(i), 4**i, 1.0) for i in range(8)]
    want = fill({s: n for s, n, _ in chain}, {s: 1 for s, _, _ in chain})
    assert all(abs(v - want[s]) < 1e-9 * max(1, v) for s, v in targets(chain, 1.5, 2).items())


def test_mix_repeats_whole_rows(spark):
    rows = corpus(120)
    docs = table(spark, rows)
    weights = spark.createDataFrame([("a", 1.0), ("b", 5.0), (None, 1.0)], "source string, weight double")
    plan = mixture.plan(mixture.measured(docs), weights, share=1.0, epochs=3.0)
    want = {r.row.doc_id: r.repeats for r in plan.collect() if r.repeats}
    out = mixture.mix(docs, weights, share=1.0, epochs=3.0)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter(want) and max(got.values()) <= 3
    assert {r.source for r in out.select("source").distinct().collect()} <= {"a", "b", None}


def test_cuts_make_up_for_longer_documents():
    import pyarrow as pa

    hist = [(4, p, 10) for p in (5, 9, 700)] + [(1, p, 1) for p in range(0, 40, 2)]
    t = pa.table({
        "source": ["s"] * len(hist), "class": pa.array([h[0] for h in hist], pa.int32()), "place": pa.array([h[1] for h in hist], pa.int32()),
        "words": [h[2] for h in hist], "source_size": [50] * len(hist), "target": [75.0] * len(hist),
    })
    got = {r["class"]: r for r in mixture._cut_source(t).to_pylist()}
    # half of 30 is 15: 10 and 20 are as near, the smaller is taken; 15 of the 20 short ones make up
    assert (got[4]["whole"], got[4]["cut"], got[1]["cut"]) == (1, 6, 29)


def test_count_of_words_is_the_expression(spark):
    texts = [None, "", " ", "a", " a", "a ", "\x0b a\x0c\x0db c  ", "漢 字", "\x1f\x00 x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixture.n_words(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [words(t) for t in texts]

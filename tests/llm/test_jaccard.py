import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from exemplar.llm import jaccard, queries
from exemplar.llm.components import components
from exemplar.llm.queries_sql import SQL

from .common import LONG, SF, docs, oracle, same


def shingles(text, n):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    part = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            old, new = part[i], part[j]
            part = [new if p == old else p for p in part]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(ids, default=None)))
    return out


def run(spark, rows, n=4, num=85, den=100):
    table = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(table, n, num, den).collect()], key=repr)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def family(rng, copies, length, most):
    base = [f"b{rng.randrange(5000)}" for _ in range(length)]
    return [edited(rng, base, rng.randrange(most)) for _ in range(copies)]


def test_query_matches_sql(spark):
    same(queries.QUERIES["op1_ngram_jaccard"](spark, SF), oracle(SQL["op1_ngram_jaccard"]))


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 4, 5)])
def test_families_of_near_copies(spark, n, num, den):
    rng = random.Random(n)
    texts = family(rng, 60, 120, 8) + family(rng, 40, 400, 20) + family(rng, 30, 30, 2) + family(rng, 3, 900, 30)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + edited(rng, [f"q{rng.randrange(10**5)}" for _ in range(80)], 0) for _ in range(30)]
    texts += [passage] * 5 + [None, "", " \n", "One Two", "one\ttwo", "one two three", LONG, LONG + " end"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert run(spark, rows, n, num, den) == sorted(brute(rows, n, num, den), key=repr)


def test_cut_tiles_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(jaccard, "FREQUENT", 30)
    monkeypatch.setattr(jaccard, "FEW", 3)
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 80, 60, 4) + family(rng, 25, 61, 6)))
    assert run(spark, rows) == sorted(brute(rows, 4, 85, 100), key=repr)


def test_links_told_grow_with_the_family(spark, monkeypatch):
    """Twice the near copies tell at most about twice the links, in the bitmap step and in the exact one."""
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 32)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 32 * 300)
    told = []
    write = jaccard.written

    def counted(df, name):
        out = write(df, name)
        if name == "tile-links":
            told.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    sums = []
    for m in (300, 600):
        rng = random.Random(2)
        base = [f"b{rng.randrange(5000)}" for _ in range(300)]
        rows = list(enumerate(edited(rng, base, 1 + rng.randrange(2)) for _ in range(m)))
        told.clear()
        got = run(spark, rows)
        assert {c for *_, c in got} == {0}
        assert len(told) == 4  # two rounds of each step
        sums.append((sum(told[:2]), sum(told[2:])))
    (near, exact), (near2, exact2) = sums
    assert near2 <= 2.3 * near and exact2 <= 2.3 * exact, sums


def test_rows_of_small_labels_meet_in_the_second_round(spark, monkeypatch):
    """Many pairs under one common shingle: whichever blocks they fall into, each pair links."""
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 6)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 200)
    rng = random.Random(11)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for i in range(40):
        own = [f"d{i}x{j}" for j in range(60 + i)]
        rows += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common + own + ["end"]))]
    rng.shuffle(rows)
    assert run(spark, rows) == sorted(brute(rows, 4, 85, 100), key=repr)


def test_repeated_rows_and_null_ids(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "x y"), (3, "A B C D E"), (7, "other words here"), (9, None), (None, "")]
    assert run(spark, rows) == sorted(brute(rows, 4, 85, 100), key=repr)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert jaccard.representatives(docs(spark, [])).collect() == []


def test_representatives(spark):
    rng = random.Random(5)
    rows = list(enumerate(family(rng, 12, 80, 3) + ["solo text of five words", None, "", ""]))
    rows += [(2, rows[2][1]), (3, "another text with id three")]  # a repeated row, and an id that has two texts
    table = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = jaccard.representatives(table)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    seen, expected = set(), []
    for (i, t), (_, size, component) in zip(rows, brute(rows, 5, 4, 5)):
        if not size or (component == i and (i, t) not in seen):
            expected.append((i, t))
            seen.add((i, t))
    assert got == sorted(expected, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=14), st.integers(0, 2**32))
def test_tile_forest_has_the_links_components(sets, seed):
    rng = np.random.default_rng(seed)
    code = rng.integers(0, 2**64, 41, dtype=np.uint64)
    values = [np.sort(code[sorted(s)]) for s in sets]
    size = np.array([len(s) for s in sets])
    exact = lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    links = jaccard.tile_links(size, np.zeros(len(sets), int), [jaccard.bitmap(v) for v in values], 85, 100, exact)
    assert len(links) < len(sets) and all(exact(i, j) for i, j in links)

    def parts(pairs):
        p = list(range(len(sets)))
        for i, j in pairs:
            old, new = p[i], p[j]
            p = [new if x == old else x for x in p]
        return {frozenset(i for i in range(len(sets)) if p[i] == x) for x in p}

    assert parts(links) == parts([(i, j) for i, j in combinations(range(len(sets)), 2) if exact(i, j)])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 200), (5, 5), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from exemplar.llm import impacts, queries
from exemplar.llm.queries_sql import SQL
from pyspark.sql import functions as F

from .common import LONG, SF, docs, oracle, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(documents, items, k=50):
    """As the contract states it, one item and document after the other."""
    tfs = [Counter(terms(t)) for _, t in documents]
    N, L = sum(1 for c in tfs if c), sum(sum(c.values()) for c in tfs)
    df = Counter(x for c in tfs for x in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(documents, tfs):
            m = 50 + (50 * sum(c.values()) * N) // L if L else 0
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(terms(text)) if c[x])
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def run(spark, documents, items, k=50):
    it = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, terms string, score int")
    rows = impacts.search(docs(spark, [t for _, t in documents], [i for i, _ in documents]), it, k)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows.collect()), key=repr)


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda m: " ".join(rng.choice(vocabulary[: rng.choice((10, 60, 300))]) for _ in range(m))
    documents = [(i, text(int(rng.paretovariate(0.9)) % 400)) for i in range(n)]
    documents += [(1000 + i, documents[7][1]) for i in range(90)]  # ties beyond k
    items = [(i, text(rng.randint(1, 40))) for i in range(25)] + [(77, documents[7][1])]
    return documents, items


def test_query_matches_sql(spark):
    same(queries.QUERIES["op12_lexical_search"](spark, SF), oracle(SQL["op12_lexical_search"]))


def test_small_buckets_chunks_and_blocks(spark, monkeypatch):
    documents, items = corpus()
    expected = brute(documents, items)
    assert run(spark, documents, items) == expected
    monkeypatch.setattr(impacts, "BLOCK_BYTES", 400)
    assert run(spark, documents, items) == expected


def test_awkward_rows(spark):
    documents, items = corpus(60)
    documents += [(None, "w1 w2 w3"), (None, documents[5][1]), (5, documents[5][1]), (5, None), (6, ""), (2000, " - ! "), (2**53 + 1, "w1 W1 É漢w1"), (2001, LONG + " w1")]
    items += [(None, "w1 w2"), (3, None), (3, ""), (77, items[-1][1]), (4, "w1 w1 W1"), (500, "unseen"), (501, "É漢W1"), (502, LONG)]
    assert run(spark, documents, items) == brute(documents, items)
    assert run(spark, documents, items, k=3) == brute(documents, items, k=3)
    assert run(spark, [], items) == [] and run(spark, documents, []) == [] and run(spark, [(1, None)], items) == []


def _postings(vocabulary, rows):
    table = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    return list(impacts._postings(vocabulary)(iter([table])))


def test_buckets_and_bounds_prune(monkeypatch):
    """Against all rows: the same answers from few scored rows."""
    monkeypatch.setattr(impacts, "BUCKET_ROWS", 64)
    rng = random.Random(9)
    rare, common = [f"r{i}" for i in range(2000)], [f"c{i}" for i in range(40)]
    documents = [(i, " ".join(rng.choices(common, k=rng.randint(3, 80)) + rng.choices(rare, k=rng.randint(0, 12)))) for i in range(4000)]
    items = [(i, " ".join(rng.choices(rare, k=6) + rng.choices(common, k=8))) for i in range(30)]
    block = pa.table({"item_id": [i for i, _ in items], "terms": [sorted(set(terms(t))) for _, t in items], "copies": [1] * len(items)})
    block = block.set_column(1, "terms", block["terms"].cast(pa.list_(pa.string())))
    q = impacts.Queries(block)
    batches = _postings(q.vocabulary, documents)
    (counted,) = impacts._counts(len(q.vocabulary))(iter(batches))
    term, count = (counted.column(c).to_numpy() for c in ("term", "count"))
    df = np.zeros(len(q.vocabulary), np.int64)
    df[term[term >= 0]] = count[term >= 0]
    n_docs, n_words = int(count[term == -1][0]), int(count[term == -2][0])
    q.weigh(n_docs, df)
    chunk = impacts.Chunk(next(impacts._chunks(iter(batches))), n_docs, n_words)
    assert (np.diff(chunk.square) <= 0).all()
    first = impacts.Best(q, 10, np.ones(len(items), np.int64))
    first.search(chunk, 256)
    best = impacts.Best(q, 10, first.least)  # the second round
    best.search(chunk, len(chunk))
    rows = best.rows()
    got = sorted(zip(*(rows.column(c).to_pylist() for c in ("item", "doc_id", "score"))))
    assert got == sorted((i, d, s) for i, _, d, s in brute(documents, items, 10))
    assert best.met == 30 * len(chunk) and best.scored < 0.1 * best.met

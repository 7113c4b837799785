import random
import re

from exemplar.llm import decontaminate, queries
from exemplar.llm.queries_sql import SQL

from .common import LONG, SF, docs, oracle, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def grams(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts, items, n=5, threshold=0.8):
    out = []
    for d, text in enumerate(texts):
        for i, item in items:
            w = words(item)
            if w:
                k = min(n, len(w))
                q = grams(w, k)
                both = len(q & grams(words(text), k))
                if both >= threshold * len(q) - 1e-9:
                    out.append((d, i, len(q), both))
    return sorted(out)


def run(spark, texts, items):
    table = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    found = decontaminate.search(docs(spark, texts), table).collect()
    return sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in found)


def _case():
    rng = random.Random(8)
    fresh = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
    items = [(i, fresh(rng.randint(8, 70))) for i in range(40)] + [(50, "Short item"), (51, "one"), (52, None), (53, " . "), (54, "Short item")]
    texts = [None, "", "...", LONG, "a short item here", "shortitem", "one"]
    for i in range(60):
        item = words(items[i % 40][1])
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            item[rng.randrange(len(item))] = "changed"
        if i % 5 == 4:
            item = item[: len(item) * 7 // 10]
        texts.append(f"{fresh(rng.choice([0, 30, 5000]))} {', '.join(item).upper()} {fresh(rng.choice([0, 30]))}")
    texts.append(f"{items[0][1]} {fresh(50)} {items[1][1]}")
    half = words(items[2][1])
    texts.append(" ".join(half[: len(half) // 2 + 4]) + " " + fresh(2000) + " " + " ".join(half[len(half) // 2 :]))
    return texts, items


def test_query_matches_sql(spark):
    same(queries.QUERIES["op7_decontaminate"](spark, SF), oracle(SQL["op7_decontaminate"]))


def test_against_brute_force(spark):
    texts, items = _case()
    expected = brute(texts, items)
    assert len(expected) > 30 and run(spark, texts, items) == expected


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    texts, items = _case()
    assert run(spark, texts, items) == brute(texts, items)
    table = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.without_items(docs(spark, texts), table)
    dirty = {d for d, *_ in brute(texts, items)}
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d in range(len(texts)) if d not in dirty]


def test_repeated_rows_and_empty_tables(spark):
    texts = ["alpha beta gamma delta epsilon zeta"] * 3
    items = [(1, texts[0]), (1, texts[0]), (2, texts[0])]
    assert run(spark, texts, items) == sorted((d, i, 2, 2) for d in range(3) for i in (1, 1, 2))
    assert run(spark, [], items) == [] and run(spark, texts, []) == []


def test_repeated_items_do_not_fill_a_block(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    text = " ".join(f"w{i}" for i in range(30))
    items = [(1, text)] * 400 + [(i, text + f" x{i} y{i}") for i in range(2, 40)]
    table = spark.createDataFrame(items, "item_id long, text string")
    size = [sum(len(part.sets) for part in block) for block in decontaminate._blocks(table, 5, 0.8)]
    assert sum(size) == 39 and max(size) < 39
    assert run(spark, [text, "other"], items) == brute([text, "other"], items)

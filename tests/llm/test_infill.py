import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from exemplar.llm import infill, queries
from exemplar.llm.queries_sql import SQL
from pyspark.sql import functions as F

from .common import LONG, SF, docs, oracle, same


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(tokens)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    elif h[3] % 100 < 20:
        form, out, sizes = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    else:
        form, out, sizes = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *sizes, sha(out), sha(text))


AWKWARD = [
    None, "", " ", "a", "word", "two words", "Ünïcödé 漢字かな 🙂🙂 é", "\x00\t\n\r ", "x<P>y", "<S>", "a<M>", "< P >", "<p>", "<<<", "a<",
    "1234567890", "ab1cd2", LONG, "漢" * 5000 + "a" * 5000, "a" * 70_000, "same text", "same text",
]


def test_query_matches_sql(spark):
    same(queries.QUERIES["op13_infill"](spark, SF), oracle(SQL["op13_infill"]))


def test_awkward_texts(spark):
    texts = AWKWARD * 9  # every text under several ids, so in every form
    ids = list(range(len(texts) - 2)) + [None, 7]
    got = infill.digest(docs(spark, texts, ids)).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got), key=key) == sorted((brute(i, t) for i, t in zip(ids, texts)), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_columns_stay_and_names_may_clash(spark):
    rows = docs(spark, ["some text here", None], [1, 2]).withColumn("row", F.lit("r")).withColumn("infill", F.lit("old")).withColumn("body", F.lit(3))
    out = infill.transform(rows)
    assert sorted(out.columns) == sorted(rows.columns)
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].row, got[1].body, got[1].text, got[2].text) == ("r", 3, "some text here", None)
    assert got[1].infill.n == 5 and got[2].infill.form == "plain"


def test_empty_table(spark):
    assert infill.digest(docs(spark, [])).collect() == []


def test_ranks_are_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 4, n).astype(np.uint8)
        matrix, at = infill.WaveletMatrix(symbols, 2), np.arange(n + 1)
        for c in range(4):
            assert (matrix.rank(c, at) == np.concatenate([[0], np.cumsum(symbols == c)])).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab <P>Sé漢🙂1\n", max_size=40), min_size=1, max_size=8))
def test_cuts_are_token_borders(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    cuts = infill.Cuts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    tokens = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S) for t in texts]
    assert cuts.tokens.tolist() == [len(t) for t in tokens]
    for share in (0, 1, 2, 5, 10**6):
        take = np.minimum(cuts.tokens, share)
        at = cuts.after(take)
        want = ["".join(t[:k]) for t, k in zip(tokens, take.tolist())]
        assert [r[: int(a - o)].decode() for r, a, o in zip(raw, at, offsets)] == want
        assert cuts.chars(at).tolist() == [len(w) for w in want]

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from exemplar.llm import bpe, queries
from exemplar.llm import bytebpe as bb
from exemplar.llm import bytewords as bw
from pyspark.sql import functions as F

from .common import LONG, SF, docs, thue_morse

AWKWARD = [
    None,
    "",
    " ",
    "\n\n  \t x",
    "it's we'll I'd 'em 'S '' ''s o'clock' 'rest 've",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa bbbb aaab",
    "<|endoftext|> before<|endoftext|>after <|endoftext|>",
    "漢字 ٣٤ ²③ é😀    é ​",
    "x" * 5000 + " " * 300 + "\n" * 50 + "y",
    LONG,
]


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer_content()


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_str(tokenizer)


def test_query_against_the_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op2_bpe_round_trip"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_awkward_texts(spark, tokenizer, library):
    table = docs(spark, AWKWARD + AWKWARD[4:6], [*range(len(AWKWARD)), 4, 5])
    got = bpe.decode(bpe.encode(table, tokenizer, carry=("doc_id", "score")), tokenizer).collect()
    assert len(got) == len(AWKWARD) + 2
    for r in got:
        text = AWKWARD[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.text == text and r.score == 0.5


def test_empty_table(spark, tokenizer):
    assert bpe.decode(bpe.encode(docs(spark, []), tokenizer), tokenizer).collect() == []


def test_ids_that_are_no_text(spark, tokenizer, library):
    ids = [255, 200, 188, 64]
    table = spark.createDataFrame([(1, bytearray(np.array(ids, "<u4").tobytes()))], "doc_id long, ids binary")
    assert bpe.decode(table, tokenizer).first().text == library.decode(ids, skip_special_tokens=False)


def test_words_without_a_lexicon_entry(tokenizer, library):
    merger = bpe.Merger(bb.load_vocabulary(tokenizer))
    few = bpe.Lexicon.compile([b" the"], *merger.encode(np.frombuffer(b" the", np.uint8), np.array([0]), np.array([4])))
    for text in ["the the thethe anticonstitutionnellement", "aaaa aaaaa aaaaaa"]:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = bpe.encode_slice(data, np.array([0, len(data)]), merger, few)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), min_size=1, max_size=60), st.lists(st.binary(min_size=1, max_size=7), min_size=1, max_size=20))
def test_automaton_numbers_its_words(tmp_path_factory, words, others):
    words = sorted(words)
    sizes = np.ones(len(words), np.int64)
    lexicon = bpe.Lexicon.compile(words, np.arange(len(words)), sizes)
    path = str(tmp_path_factory.mktemp("lex") / "l.bin")
    lexicon.save(path)
    mapped = bpe.Lexicon.mapped(path)
    ask = words + others
    ends = np.cumsum([len(w) for w in ask])
    starts = ends - np.array([len(w) for w in ask])
    got = mapped.numbers(np.frombuffer(b"".join(ask), np.uint8), starts, ends)
    assert got.tolist() == [words.index(w) if w in words else -1 for w in ask]


def test_automaton_is_minimal():
    words = sorted(a + b for a in (b"a", b"b", b"cd") for b in (b"xyz", b"xz", b"q"))
    arcs, _, first = bpe.minimal_automaton(words)
    seen, todo = set(), [first]
    while todo:
        s = todo.pop()
        if s not in seen:
            seen.add(s)
            todo += arcs[s].values()
    assert len(seen) == 6  # start, after c, after a/b/cd, after x, before z, end


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab's 'tr'e\n\t é漢 1²!?'\U0001f600_-  ", max_size=14), min_size=1, max_size=4))
def test_pretokens_are_those_of_the_pattern(texts):
    import regex
    import public_tokenizers

    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    s, e = bb.pretokens(data, offsets)
    assert [data[a:z].tobytes().decode() for a, z in zip(s, e)] == [w for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)]
    # equal words have equal hashes wherever they stand
    h = bw.span_hashes(bw.prefix_sums(bw.BYTE_CODES[data]), s, e)
    by = {}
    for a, z, x in zip(s, e, h.tolist()):
        assert by.setdefault(data[a:z].tobytes(), x) == x


def test_lexicon_counts_words_spread_thinly(spark, tokenizer):
    from pyspark import SparkFiles

    texts = [f"thin {w} {w} {w}" for w in ("alpha", "beta", "gamma", "delta", "epsilon")]  # " thin" never twice in a slice
    table = docs(spark, [t.split()[1][::-1] + " thin" + t[4:] for t in texts]).repartition(5, "doc_id").sortWithinPartitions("doc_id")
    assert table.rdd.getNumPartitions() == 5
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a slice per text
        lexicon = bpe.Lexicon.mapped(SparkFiles.get(bpe.build_lexicon(table, tokenizer, size=1)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    data = np.frombuffer(b" thin alpha", np.uint8)
    assert lexicon.numbers(data, np.array([0, 5]), np.array([5, 11])).tolist() == [0, -1]


def test_words_of_equal_hash_keep_their_ids(spark, tokenizer, library):
    texts = [w for k in (10, 11, 12) for w in thue_morse(k)]
    texts += [" ".join(thue_morse(10)), " ".join(thue_morse(11)[::-1])]
    out = bpe.decode(bpe.encode(docs(spark, texts), tokenizer), tokenizer).collect()
    assert len({bytes(r.ids) for r in out}) == len(texts)
    for r in out:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.text == texts[r.doc_id]


def test_lexicon_takes_whole_steps(spark, tokenizer, monkeypatch):
    """Never more words than its size, and the most frequent ones first."""
    rows = docs(spark, [" ".join(["aa"] * 50 + ["bb"] * 40 + ["cc"] * 30 + [f"w{i}" for i in range(20)])])
    taken = []
    compiled = bpe.Lexicon.compile
    monkeypatch.setattr(bpe.Lexicon, "compile", staticmethod(lambda words, ids, sizes: (taken.append(words), compiled(words, ids, sizes))[1]))
    for size in (0, 2, 3, 20, 100):
        bpe.build_lexicon(rows, tokenizer, size)
    assert [len(t) for t in taken[:3]] == [0, 2, 3] and len(taken[3]) <= 20 and len(taken[4]) > 20
    assert {b" bb", b" aa"} == set(taken[1])
    counts = [bpe._step(F.lit(n)) for n in (1, 2, 1023, 1024, 1025, 2048, 10**9, 10**12)]
    steps = list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first())
    assert steps == sorted(steps) and steps[2] < steps[3]

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from exemplar.llm import queries, records

from .common import LONG, SF, docs, thue_morse

AWKWARD = [None, "", "it's <|endoftext|> é😀", LONG, "same", "same", "b"]
IDS = [5, None, -3, 7, 1, 1, 1]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(queries.tokenizer_content())


def test_query_against_the_library(spark, library):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in queries.QUERIES["op6_token_records"](spark, SF).collect()}
    at = 0
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def _write(spark, tmp_dir, table):
    path = f"{tmp_dir}/records"
    return path, records.write(table, path, queries.tokenizer_content())


def test_awkward_rows(spark, tmp_dir, library):
    path, _ = _write(spark, tmp_dir, docs(spark, AWKWARD, IDS))
    got = records.read(spark, path).collect()
    expected, at = [], 0
    for i, text in sorted(zip(IDS, AWKWARD), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((i, at, ids))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got), key=lambda r: r[1]) == expected


def test_index_reads_single_records(spark, tmp_dir):
    path, manifest = _write(spark, tmp_dir, docs(spark, [f"text number {i}" for i in range(50)]))
    whole = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in records.read(spark, path).collect()}
    for f in manifest.collect():
        for k in random.Random(1).sample(range(f.records), f.records):
            doc_id, ids = records.read_record(path, f.data, f.offsets, k)
            assert whole.pop(doc_id) == ids.tolist()
    assert not whole


def test_damage_is_found(spark, tmp_dir):
    path, manifest = _write(spark, tmp_dir, docs(spark, ["some text"]))
    f = manifest.first()
    with open(f"{path}/{f.data}", "r+b") as file:
        file.seek(25)
        byte = file.read(1)
        file.seek(25)
        file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="checksum"):
        records.read(spark, path).collect()
    with pytest.raises(ValueError, match="checksum"):
        records.read_record(path, f.data, f.offsets, 0)


def test_files_of_failed_attempts_are_not_read(spark, tmp_dir):
    path, manifest = _write(spark, tmp_dir, docs(spark, ["a", "b"]))
    with open(f"{path}/part-00000-lost.rec", "wb") as file:
        file.write(b"half a rec")
    assert records.read(spark, path).count() == 2
    assert pq.read_table(f"{path}/manifest").num_rows == manifest.count()


def test_empty_table(spark, tmp_dir):
    path, manifest = _write(spark, tmp_dir, docs(spark, []))
    assert manifest.collect() == [] and records.read(spark, path).collect() == []


def test_memo_survives_overflow(library, monkeypatch):
    monkeypatch.setattr(records, "_MEMO_IDS", 40)
    encoder = records.LibraryEncoder(queries.tokenizer_content())
    rng = random.Random(1)
    for _ in range(20):
        text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 20)))
        data = np.frombuffer(text.encode(), np.uint8)
        ids, ends = encoder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(ids)]


def test_words_of_equal_hash_keep_their_ids(library):
    """In one slice, and from the memo of slices before."""
    encoder = records.LibraryEncoder(queries.tokenizer_content())
    pairs = [thue_morse(k) for k in (10, 11, 12)]
    for texts in ([pairs[0][0]], [pairs[0][1]], pairs[0], pairs[1] + pairs[2], pairs[2][::-1], ["a b", pairs[1][1], "a b"]):
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
        for _ in range(2):
            ids, ends = encoder.encode(data, offsets)
            got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
            assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]

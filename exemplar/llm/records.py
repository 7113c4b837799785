"""Token ids in length-delimited binary record files.

File ``part-NNNNN-*.rec``: records one after the other, each

    uint64 length | uint32 masked CRC of the length | payload | uint32 masked CRC of the payload

little-endian.  The CRC is CRC-32 (zlib), masked as ((c >> 15 | c << 17) + 0xa282ead8) mod
2^32, so that a checksum over bytes that hold checksums stays useful.  Payload: 1 byte id
width (2 or 4), 1 byte whether doc_id is null, int64 doc_id, ids.
File ``part-NNNNN-*.idx``: per record uint64 offset, uint64 tokens, for shuffled reads.

``write`` range-partitions the documents by doc_id, so files and the records in them are in
ascending order, encodes with the tokenizers library (each distinct pre-token once per
worker as long as a bounded memo holds it) and appends the end id.  Each task attempt
writes files of its own names; the returned manifest, a small table stored beside them,
lists those of successful attempts only, so a lost executor leaves no wrong file behind.

Defined results: null text counts as empty (its record holds the end id only); null
doc_ids come first; equal doc_ids follow in order of their text; an empty table gives an
empty manifest; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytebpe as bb
from . import bytewords as bw
from .workers import ready

_HEAD, _CRC, _PAYLOAD, _INDEX = "<QI", "<I", "<BBq", "<QQ"
_HEAD_BYTES, _CRC_BYTES, _PAYLOAD_BYTES, _INDEX_BYTES = map(struct.calcsize, (_HEAD, _CRC, _PAYLOAD, _INDEX))
_CHUNK = 8 << 20
_MEMO_BITS = 20
_MEMO_IDS = 1 << 23

MANIFEST = "part int, records long, tokens long, data string, offsets string"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


class LibraryEncoder:
    """The tokenizers library over whole slices: each distinct pre-token goes through it once while the memo holds it.

    Pre-tokens are what the library merges on its own, so a text's ids are its pre-tokens'
    ids in order.  The memo is a direct-mapped table of 2^20 places and at most 2^23 ids.
    """

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab = bb.load_vocabulary(content)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << _MEMO_BITS, np.uint64)
        self.start = np.zeros(1 << _MEMO_BITS, np.int64)
        self.size = np.zeros(1 << _MEMO_BITS, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        # the words themselves: a hash only finds a place
        self.word_start = np.zeros(1 << _MEMO_BITS, np.int64)
        self.word_size = np.zeros(1 << _MEMO_BITS, np.int64)
        self.letters = np.zeros(1 << 16, np.uint8)
        self.used_letters = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets per text)."""
        data, pieces, owner, after = bb.split_specials(data, offsets, self.vocab.special)
        s, e = bb.pretokens(data, pieces)
        if not len(s):
            return bb.by_text(np.zeros(0, np.int64), np.zeros(0, np.int64), s, owner, after, len(offsets) - 1)
        h = bw.span_hashes(bw.prefix_sums(bw.BYTE_CODES[data]), s, e)
        h = np.where(h == 0, np.uint64(1), h)
        place = (h >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        hit = self._same(place, self.keys[place] == h, data, s, e)
        start, size = self.start[place], self.size[place].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            which = bw.spans_array(data, s[miss], e[miss]).dictionary_encode().indices.to_numpy()
            _, first = np.unique(which, return_index=True)
            new = miss[first]
            raw = data.tobytes()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[new].tolist(), e[new].tolist())]
            got = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            sizes = np.array([len(g) for g in got], np.int64)
            flat = np.fromiter((i for g in got for i in g), np.int32, int(sizes.sum()))
            begin = np.cumsum(sizes) - sizes
            # this slice's ids: the memo's, then the new ones
            values = np.concatenate([self.ids[: self.used], flat])
            start[miss], size[miss] = self.used + begin[which], sizes[which]
            letters = bb.gather(data, s[new], e[new] - s[new])
            self._remember(h[new], place[new], begin, sizes, flat, e[new] - s[new], letters)
        else:
            values = self.ids
        piece = np.searchsorted(pieces, s, side="right") - 1
        return bb.by_text(bb.gather(values, start, size), size, piece, owner, after, len(offsets) - 1)

    def _same(self, place: np.ndarray, hit: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The hits whose bytes are those of the memo's word."""
        hit = hit & (self.word_size[place] == e - s)
        at = np.flatnonzero(hit)
        size = e[at] - s[at]
        differs = bb.gather(data, s[at], size) != bb.gather(self.letters, self.word_start[place[at]], size)
        if differs.any():
            hit[at[np.searchsorted(np.cumsum(size), np.flatnonzero(differs), side="right")]] = False
        return hit

    def _remember(
        self, h: np.ndarray, place: np.ndarray, begin: np.ndarray, sizes: np.ndarray, flat: np.ndarray, word_size: np.ndarray, letters: np.ndarray
    ) -> None:
        if self.used + len(flat) > _MEMO_IDS or self.used_letters + len(letters) > 4 * _MEMO_IDS:
            self._clear()
        if len(flat) > _MEMO_IDS or len(letters) > 4 * _MEMO_IDS:
            return
        if self.used_letters + len(letters) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros(max(len(self.letters), len(letters)), np.uint8)])
        self.letters[self.used_letters : self.used_letters + len(letters)] = letters
        self.word_start[place], self.word_size[place] = self.used_letters + np.cumsum(word_size) - word_size, word_size
        self.used_letters += len(letters)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.keys[place], self.start[place], self.size[place] = h, self.used + begin, sizes
        self.used += len(flat)


@lru_cache(maxsize=1)
def _encoder(content: str) -> LibraryEncoder:
    return LibraryEncoder(content)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files of all ``docs`` under ``path`` (a new folder that all executors share); the manifest."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        width = 2 if max(len(encoder.vocab.tokens) - 1, end_id) < 1 << 16 else 4
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        records = tokens = offset = 0
        data_file = index_file = None
        for b in batches:
            if b.num_rows and data_file is None:
                data_file = system.open_output_stream(f"{folder}/{name}.rec")
                index_file = system.open_output_stream(f"{folder}/{name}.idx")
            for first, data, offsets in bw.slices(b.column("text")):
                ids, ends = encoder.encode(data, offsets)
                ids = ids.astype(f"<u{width}")
                last = np.array([end_id], f"<u{width}").tobytes()
                out, index = [], []
                for i, doc_id in enumerate(b.column("doc_id").slice(first, len(offsets) - 1).to_pylist()):
                    payload = struct.pack(_PAYLOAD, width, doc_id is None, doc_id or 0) + ids[ends[i] : ends[i + 1]].tobytes() + last
                    size = struct.pack("<Q", len(payload))
                    record = size + struct.pack(_CRC, masked_crc(size)) + payload + struct.pack(_CRC, masked_crc(payload))
                    n = int(ends[i + 1] - ends[i]) + 1
                    index.append(struct.pack(_INDEX, offset, n))
                    out.append(record)
                    offset += len(record)
                    tokens += n
                    records += 1
                data_file.write(b"".join(out))
                index_file.write(b"".join(index))
        if data_file is not None:
            data_file.close()
            index_file.close()
            row = [[part], [records], [tokens], [f"{name}.rec"], [f"{name}.idx"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                names=["part", "records", "tokens", "data", "offsets"],
            )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file in ascending order of doc_id, with ``before``: the ids in all files before it."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return rows.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))


def _read_file(system: fs.FileSystem, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the records of a file, checksums verified."""
    with system.open_input_stream(path) as f:
        buffer, at = b"", 0

        def need(n: int) -> bool:
            nonlocal buffer, at
            if len(buffer) - at < n:
                parts = [buffer[at:]]
                have = len(parts[0])
                while have < n:
                    more = f.read(max(_CHUNK, n - have))
                    if not more:
                        break
                    parts.append(more)
                    have += len(more)
                buffer, at = b"".join(parts), 0
            return len(buffer) - at >= n

        while need(1):
            if not need(_HEAD_BYTES):
                raise ValueError(f"{path}: cut off")
            size, crc = struct.unpack_from(_HEAD, buffer, at)
            if masked_crc(buffer[at : at + 8]) != crc:
                raise ValueError(f"{path}: a length's checksum is wrong")
            at += _HEAD_BYTES
            if not need(size + _CRC_BYTES):
                raise ValueError(f"{path}: cut off")
            payload = buffer[at : at + size]
            if masked_crc(payload) != struct.unpack_from(_CRC, buffer, at + size)[0]:
                raise ValueError(f"{path}: a record's checksum is wrong")
            at += size + _CRC_BYTES
            width, null, doc_id = struct.unpack_from(_PAYLOAD, payload)
            yield None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_PAYLOAD_BYTES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all records before it) and ids (little-endian unsigned 32-bit) of all records."""
    ready(spark)
    files = manifest(spark, path).select("data", "before")
    schema = "doc_id long, start long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        for b in batches:
            for name, before in zip(b.column("data").to_pylist(), b.column("before").to_pylist()):
                rows, held, at = ([], [], []), 0, before
                for doc_id, ids in _read_file(system, f"{folder}/{name}"):
                    for c, v in zip(rows, (doc_id, at, ids.astype("<u4").tobytes())):
                        c.append(v)
                    at += len(ids)
                    held += len(ids)
                    if held > 1 << 20:
                        yield _batch(rows)
                        rows, held = ([], [], []), 0
                yield _batch(rows)

    def _batch(rows: tuple[list, list, list]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["doc_id", "start", "ids"])

    # one file per task: files are as large as the partitions that wrote them
    spread = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "data")
    return spread.mapInArrow(run, schema)


def read_record(path: str, data: str, offsets: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, through the offset index (what a shuffled reader does)."""
    system, folder = _open(path)
    with system.open_input_file(f"{folder}/{offsets}") as f:
        offset, _ = struct.unpack(_INDEX, f.read_at(_INDEX_BYTES, number * _INDEX_BYTES))
    with system.open_input_file(f"{folder}/{data}") as f:
        size, crc = struct.unpack(_HEAD, f.read_at(_HEAD_BYTES, offset))
        payload = f.read_at(size, offset + _HEAD_BYTES)
        if masked_crc(struct.pack("<Q", size)) != crc or masked_crc(payload) != struct.unpack(_CRC, f.read_at(_CRC_BYTES, offset + _HEAD_BYTES + size))[0]:
            raise ValueError(f"{data}: a checksum is wrong")
    width, null, doc_id = struct.unpack_from(_PAYLOAD, payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_PAYLOAD_BYTES)

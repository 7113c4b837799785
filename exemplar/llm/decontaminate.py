"""Benchmark decontamination: size-partitioned MinHash containment search.

Texts are lower-cased (A-Z) words of letters and digits (``bytewords.ALNUM``), shingles
``n`` words long; an item of fewer words is one shingle of its own length, looked for
among the documents' shingles of that length.  Items fall into partitions by the number
of their shingles, [2^i, 2^(i+1)); for a partition whose largest item has u shingles, a
document is read in windows of 2u shingles, u apart, so a copied item lies whole in one
of them however long the document is.  An item and a window are a candidate pair if any
of ``PERMUTATIONS`` minimum hashes agrees.  A candidate counts if the whole document's
shingles contain at least ``threshold`` of the item's distinct ones (exact).

A window can only agree where it holds an item's minimal shingle, so windows without one
are never hashed: the first pass over a document is one table look-up per shingle.

Items are processed in blocks of about ``BLOCK_BYTES`` of text, each broadcast on its own
and scanned against all documents, so the broadcast does not grow with the item set.
Repeated item rows are one row with its count, so they don't fill a block.

Defined results: null or empty documents and items without words match nothing; repeated
items and repeated documents are reported each; other columns are ignored unless carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .workers import ready

PERMUTATIONS = 64
BLOCK_BYTES = 16 << 20
_TABLE_BITS = 22


class Items:
    """A block of items of one shingle length: their shingle sets and MinHash index."""

    def __init__(self, length: int, ids: list[int], sets: list[np.ndarray], copies: list[int], threshold: float) -> None:
        self.length, self.ids, self.sets, self.copies = length, ids, sets, copies
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
        self.seeds = bw.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64))
        part = [int(len(s)).bit_length() - 1 for s in sets]
        upper: dict[int, int] = {}
        for p, s in zip(part, sets):
            upper[p] = max(upper.get(p, 1), len(s))
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for i, s in enumerate(sets):
            at = bw.mix(s[:, None] ^ self.seeds[None, :]).argmin(axis=0)
            for j in range(PERMUTATIONS):
                entries.setdefault(int(s[at[j]]), []).append((upper[part[i]], j, i))
        self.elements = np.array(sorted(entries), dtype=np.uint64)
        self.entries = [entries[int(e)] for e in self.elements]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._low(self.elements)] = True

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)

    def hits(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``sh``, element numbers) of shingles that are some item's minimum."""
        at = np.flatnonzero(self.table[self._low(sh)])
        if not len(at):
            return at, at
        e = np.minimum(np.searchsorted(self.elements, sh[at]), len(self.elements) - 1)
        ok = self.elements[e] == sh[at]
        return at[ok], e[ok]

    def contained(self, sh: np.ndarray, at: np.ndarray, element: np.ndarray) -> list[tuple[int, int]]:
        """(item number, shared shingles) of one document's shingles in order; ``at`` and ``element`` are its hits."""
        minima: dict[tuple[int, int, int], int] = {}
        candidates: set[int] = set()
        for p, e in zip(at.tolist(), element.tolist()):
            value = self.elements[e]
            for upper, j, item in self.entries[e]:
                if item in candidates:
                    continue
                for w in {max(0, p // upper - 1), p // upper}:
                    key = (upper, w, j)
                    if key not in minima:
                        window = sh[w * upper : w * upper + 2 * upper]
                        minima[key] = int(bw.mix(window ^ self.seeds[j]).min())
                    if minima[key] == int(bw.mix(np.array([value]) ^ self.seeds[j])[0]):
                        candidates.add(item)
                        break
        if not candidates:
            return []
        whole = np.unique(sh)
        out = []
        for item in sorted(candidates):
            s = self.sets[item]
            k = np.minimum(np.searchsorted(whole, s), len(whole) - 1)
            shared = int((whole[k] == s).sum())
            if shared >= self.need[item]:
                out.append((item, shared))
        return out


def _blocks(items: DataFrame, n: int, threshold: float) -> Iterator[list[Items]]:
    """The item set in blocks of bounded text, each as one ``Items`` per shingle length."""
    rows = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        got = rows.where(F.col("block") == b).select("item_id", "text", "copies").orderBy("item_id", "text").collect()  # bounded by BLOCK_BYTES
        by_length: dict[int, tuple[list, list, list]] = {}
        for r in got:
            data = np.frombuffer(r.text.encode(), dtype=np.uint8)
            h, doc = bw.word_hashes(data, np.array([0, len(data)]), bw.ALNUM)
            if len(h):
                length = min(n, len(h))
                sh, _ = bw.shingle_hashes(h, doc, 1, length, short=False)
                ids, sets, copies = by_length.setdefault(length, ([], [], []))
                ids.append(r.item_id)
                sets.append(np.unique(sh))
                copies.append(r.copies)
        yield [Items(length, ids, sets, copies, threshold) for length, (ids, sets, copies) in sorted(by_length.items())]


def _matches(column: pa.Array, block: list[Items]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(row, [(item id, item shingles, shared shingles)]) of the texts that hold an item."""
    for first, data, offsets in bw.slices(column):
        h, doc = bw.word_hashes(data, offsets, bw.ALNUM)
        n_docs = len(offsets) - 1
        found: dict[int, list[tuple[int, int, int]]] = {}
        for items in block:
            sh, sd = bw.shingle_hashes(h, doc, n_docs, items.length, short=False)
            at, element = items.hits(sh)
            if not len(at):
                continue
            owner = sd[at]
            cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
            for a, z in zip(cut[:-1], cut[1:]):
                d = int(owner[a])
                lo, hi = np.searchsorted(sd, d), np.searchsorted(sd, d, side="right")
                for item, shared in items.contained(sh[lo:hi], at[a:z] - lo, element[a:z]):
                    found.setdefault(d, []).extend([(items.ids[item], len(items.sets[item]), shared)] * items.copies[item])
        for d, m in sorted(found.items()):
            yield first + d, m


def search(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per (document, contained item): doc_id, item_id, n_shingles, n_shared, containment."""
    spark = docs.sparkSession
    ready(spark)
    kept = docs.select("doc_id", "text")
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, item_id long, n_shingles long, n_shared long, containment double"
    out = None
    for block in _blocks(items, n, threshold):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, told = [], []
                for row, matches in _matches(b.column("text"), shared.value):
                    rows += [row] * len(matches)
                    told += matches
                ids, sizes, both = ([t[i] for t in told] for i in range(3))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(ids, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(both, pa.int64()),
                        pa.array([k / s for k, s in zip(both, sizes)], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"],
                )

        part = kept.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold an item; one scan per block of items, no shuffle."""
    spark = docs.sparkSession
    ready(spark)
    for block in _blocks(items, n, threshold):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[row for row, _ in _matches(b.column("text"), shared.value)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

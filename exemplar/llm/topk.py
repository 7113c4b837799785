"""Exact top-k by integer inner product with a bit-sliced index.

Candidates and queries are dealt into bounded groups: candidates by row number into
slots of about ``SLOT_ROWS``, queries into blocks of about ``BLOCK_QUERIES``; every
(slot, block) pair is one co-group, so a stated query set meets all rows in blocks.

Inside a group the candidates' top bits become bit slices (one bitmap per dimension
and bit).  For all queries of the block at once, the slices are added with bitmap
arithmetic (3:2 carry-save adders), weighted by the top bits of the query's
components; a negative weight adds the complement.  The k-th largest coarse sum is
found from the most significant sum slice downward, and a comparison with that sum
less the error bound leaves the boundary rows, whose exact integer products decide.
The bound is rigorous (Cauchy-Schwarz on both quantisation residuals), so the result
is exact; a coarse sum that tells little only means more boundary rows.

Defined results: vectors that are null, empty or hold null or non-finite components
take no part; nor do rows without an id, which no comparison tells from the query's own
(the SQL's ``<>`` drops them too); a query meets the vectors of its own length only; rows
with the query's own id are no candidates; equal scores go to the smaller id, then repeated rows follow
each other; a repeated query row is answered once per row; an empty table gives an
empty result.  scores beyond 63 bits count as the
nearest 63-bit value; components beyond 2^61 after scaling do not fit and are as if not finite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from .workers import ready


SLOT_ROWS = 8192
BLOCK_QUERIES = 1024
#: Bits of the candidates' slices and of the query weights: few enough rows are left for the exact products
#: (2.3 % of sf0.1's and 0.9 % of check_s' candidates; with 4 and 3 bits nearly all were).
X_BITS = 7
Q_BITS = 6

_MOST = (1 << 63) - 1

SCHEMA = "query_row long, query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= float(1 << 61)))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, ints)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best candidates.

    ``vectors`` has vec_id and embedding; ``is_query`` marks the query rows.
    """
    ready(vectors.sparkSession)
    rows = vectors.select("vec_id", quantised(F.col("embedding"), scale).alias("x"), is_query.alias("q")).where("x IS NOT NULL AND vec_id IS NOT NULL")
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("x"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("m")).first()
    slots = max(1, -(-sizes.n // SLOT_ROWS))
    blocks = max(1, -(-sizes.m // BLOCK_QUERIES))
    number = F.xxhash64("row")
    left = rows.withColumn("slot", F.pmod(number, F.lit(slots))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (
        rows.where("q")
        .withColumn("block", F.pmod(number, F.lit(blocks)).cast("int"))
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    )
    keys = ["slot", "block", "dim"]

    def group(cand: Iterator[pa.RecordBatch] | pa.Table, quer: pa.Table) -> pa.Table:
        return _search_group(cand, quer, k)

    found = (
        left.select(*keys, "vec_id", "x")
        .groupBy(*keys)
        .cogroup(right.select(*keys, "row", "vec_id", "x").groupBy(*keys))
        .applyInArrow(group, SCHEMA)
    )
    best = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Booleans (..., n) as bitmaps (..., ceil(n / 64)) of 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    if pad:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], pad), np.uint8)], axis=-1)
    return np.ascontiguousarray(packed).view(np.uint64)


def _search_group(cand: pa.Table, quer: pa.Table, k: int) -> pa.Table:
    empty = pa.table({n: pa.array([], pa.int64()) for n in ("query_row", "query_id", "vec_id", "score")})
    if cand.num_rows == 0 or quer.num_rows == 0:
        return empty
    x, q = _matrix(cand["x"]), _matrix(quer["x"])
    # products that may leave 63 bits on the way are added up in Python's integers
    large = float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= 2.0**62
    ids, qids = cand["vec_id"].to_numpy(), quer["vec_id"].to_numpy()
    rows = quer["row"].to_numpy()
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    out: list[tuple[np.ndarray, ...]] = []
    index = BitSliced(x, X_BITS)
    step = max(16, (1 << 17) // index.words)
    for a in range(0, len(q), step):
        qs = q[a : a + step]
        alive = np.ones((len(qs), len(ids)), bool)
        first, last = np.searchsorted(ids, qids[a : a + step]), np.searchsorted(ids, qids[a : a + step], side="right")
        for i in np.flatnonzero(last > first):
            alive[i, first[i] : last[i]] = False
        maybe = index.boundary(qs, _pack(alive), k)
        for i in range(len(qs)):
            near = np.flatnonzero(maybe[i])
            score = _products(x[near], qs[i]) if large else x[near] @ qs[i]
            best = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(best), rows[a + i]), np.full(len(best), qids[a + i]), ids[near[best]], score[best]))
    return pa.table({n: pa.array(np.concatenate([o[j] for o in out]), pa.int64()) for j, n in enumerate(empty.column_names)})


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond 63 bits become the nearest 63-bit value."""
    exact = (x.astype(object) * q.astype(object)).sum(axis=1)
    return np.array([max(-_MOST, min(_MOST, int(s))) for s in exact], np.int64)


class BitSliced:
    """Bit slices of the top ``bits`` bits of integer vectors (rows of ``x``)."""

    def __init__(self, x: np.ndarray, bits: int) -> None:
        self.n = len(x)
        lo, hi = int(x.min()), int(x.max())
        self.shift = max(0, (hi - lo).bit_length() - bits)
        self.lo, self.bits = lo, bits
        cells = (x - lo) >> self.shift
        # what a cell stands for: its middle
        self.step = 1 << self.shift
        self.zero = lo + (self.step - 1) / 2
        rest = x - (cells * self.step + self.zero)
        self.rest_norm = float(np.sqrt((rest.astype(np.float64) ** 2).sum(axis=1).max()))
        self.norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max()))
        self.slices = np.stack([_pack(((cells >> b) & 1).astype(bool).T) for b in range(bits)], axis=1)  # (dims, bits, words)
        self.words = self.slices.shape[2]

    def boundary(self, q: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
        """Booleans (queries, rows): a superset of each query's ``k`` best rows among ``alive``."""
        top = np.abs(q).max(axis=1)
        unit = np.maximum(top / ((1 << Q_BITS) - 1), 1e-9)  # one query step
        weight = np.rint(np.abs(q) / unit[:, None]).astype(np.int64)
        sums = self._sums(weight, q < 0)
        kth = _kth(sums, alive, k)
        coarse = np.sign(q) * weight * unit[:, None]
        error = np.linalg.norm(coarse, axis=1) * self.rest_norm + np.linalg.norm(q - coarse, axis=1) * self.norm
        # a sum of s stands for the product s * unit * step + constant, so 2 errors are so many sums
        margin = np.ceil(2 * error / (unit * self.step) * (1 + 1e-9) + 1e-6)
        least = np.maximum(kth - margin, 0).astype(np.int64)
        found = _at_least(sums, least) & alive
        bits = np.unpackbits(found.view(np.uint8), axis=-1, bitorder="little")
        return bits[:, : self.n].astype(bool)

    def _sums(self, weight: np.ndarray, negative: np.ndarray) -> list[np.ndarray]:
        """Slices (queries, words), least significant first, of sum of weight * (cell, or its complement)."""
        queue: list[list[np.ndarray]] = [[] for _ in range(Q_BITS + self.bits + 40)]
        done: list[np.ndarray] = []
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        flip = np.where(negative, full, np.uint64(0))

        def add(p: int, bitmap: np.ndarray) -> None:
            queue[p].append(bitmap)
            while len(queue[p]) == 3:
                a, b, c = queue[p]
                ab = a ^ b
                queue[p] = [ab ^ c]
                carry = (a & b) | (ab & c)
                p += 1
                queue[p].append(carry)

        for d in range(weight.shape[1]):
            for b in range(self.bits):
                bitmap = self.slices[d, b][None, :] ^ flip[:, d, None]
                for j in range(Q_BITS):
                    on = (weight[:, d] >> j) & 1
                    if on.any():
                        add(b + j, bitmap & (np.uint64(0) - on.astype(np.uint64))[:, None])
        zero = np.zeros((len(weight), self.words), np.uint64)
        for p in range(len(queue)):
            while len(queue[p]) > 1:
                a, b = queue[p].pop(), queue[p].pop()
                queue[p].append(a ^ b)
                queue[p + 1].append(a & b)
                while len(queue[p + 1]) >= 3:
                    a, b, c = queue[p + 1].pop(), queue[p + 1].pop(), queue[p + 1].pop()
                    ab = a ^ b
                    queue[p + 1].append(ab ^ c)
                    queue[p + 2].append((a & b) | (ab & c))
            done.append(queue[p][0] if queue[p] else zero)
        while len(done) > 1 and not done[-1].any():
            done.pop()
        return done


def _count(bitmap: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)


def _kth(sums: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest sum among ``alive`` per query, from the top slice down (0 if there are fewer)."""
    above, equal = np.zeros_like(alive), alive.copy()
    value = np.zeros(len(alive), np.int64)
    for p in range(len(sums) - 1, -1, -1):
        ones = equal & sums[p]
        enough = _count(above | ones) >= k
        value += np.where(enough, 1 << p, 0)
        keep = enough[:, None]
        above = np.where(keep, above, above | ones)
        equal = np.where(keep, ones, equal & ~sums[p])
    return value


def _at_least(sums: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    greater = np.zeros_like(sums[0])
    equal = np.full_like(sums[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for p in range(len(sums) - 1, -1, -1):
        one = ((least >> p) & 1).astype(bool)[:, None]
        greater |= np.where(one, np.uint64(0), equal & sums[p])
        equal &= np.where(one, sums[p], ~sums[p])
    return np.where((least >> len(sums) > 0)[:, None], np.uint64(0), greater | equal)

"""Exact dense top-k search (J1 + V3/V4 + W1 = R1).

Every query is scored against every corpus vector, as in the original, but the
score matrix never becomes rows:

* **broadcast strategy** (query block of checked size): the query matrix is
  broadcast once, the corpus is scanned where it lies with ``mapInArrow``; each
  task multiplies its Arrow batches against the query block and keeps a running
  top-k per query, so a partition emits at most ``n_queries * k`` rows.  The only
  shuffle is the merge of those partial lists on query id.
* **blocked strategy** (query set above the broadcast bound): queries and corpus
  are hashed into blocks; every (query block, corpus block) pair is one
  partition, in which the corpus rows are streamed past the queries.  A task's
  products are bounded by ``_TASK_PAIRS`` and its memory by ``block_bytes`` of
  queries and lists; it emits only a local top-k.  Nothing goes through the driver.

A product in single precision only rules pairs out (see ``_RunningTopK``); what is
left is scored in double precision.

Ties are broken by example id (ascending); NaN scores rank first, as a
descending sort does in Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import NORM_EPS
from ..session import ship_package
from .layout import scoring_layout, spread
from .topk import NO_ID, top_k_per_group, topk_merge

# Per-task budget for one dense score tile (float64 elements).
_TILE_ELEMS = 8_000_000
DEFAULT_BROADCAST_LIMIT = 4 << 20
DEFAULT_BLOCK_BYTES = 64 << 20
METRICS = ("cosine", "euclidean")
# Kinds of rows: bounded by the single-precision product, beyond its range, without a number.
_TAME, _WILD, _NAN = 0, 1, 2
_TAME_SQUARE = 1e30
# A tile of the product that stays in the cache, and the pairs that are scored exactly at once.
_TILE_QUERIES, _TILE_ROWS, _PAIRS = 512, 2048, 1 << 17
# New entries, as a share of n_queries * k, at which a task cuts its lists.
_SLACK = 0.5
# Products of one task of the blocked strategy, and the rows that a task gives at once.
_TASK_PAIRS = 4_000_000_000
# What an entry of a list costs (to find, sort and merge) in bytes of copied vectors that take as long.
_LIST_BYTES = 300
_OUT_ROWS = 1 << 16


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"Unknown similarity metric: {metric}")


def _list_matrix(arr: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrow list column -> (float64 matrix of the valid rows, valid-row mask)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, dim)), np.zeros(0, dtype=bool)
    lengths = arr.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    valid = lengths == dim
    if valid.all():
        flat = arr.flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float64, copy=False).reshape(n, dim), valid
    rows = [np.asarray(v, dtype=np.float64) for v, ok in zip(arr.to_pylist(), valid) if ok]
    mat = np.vstack(rows) if rows else np.zeros((0, dim))
    return mat, valid


def _prepare(mat: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    sq = np.einsum("ij,ij->i", mat, mat)
    if metric == "cosine":
        return mat / (np.sqrt(sq) + NORM_EPS)[:, None], sq
    return mat, sq


def _distance_tile(q_raw: np.ndarray, q: np.ndarray, q_sq: np.ndarray, c_raw: np.ndarray, c: np.ndarray, c_sq: np.ndarray, k: int, worst: np.ndarray) -> np.ndarray:
    """Negative Euclidean distances of a tile, exact wherever they can matter; -inf elsewhere.

    The expanded formula only bounds a squared distance, by the rounding of its terms; pairs whose lower bound is
    above the k-th upper bound (of the tile, or ``worst``, of what is held) are out, the others are subtracted."""
    with np.errstate(invalid="ignore", over="ignore"):
        square = q_sq[:, None] + c_sq[None, :] - 2.0 * (q @ c.T)
        error = (q_sq[:, None] + c_sq[None, :]) * (np.finfo(np.float64).eps * 2 * (q.shape[1] + 4))
        upper = square + error
        kth = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(q), np.inf)
        limit = np.fmin(kth, worst)
        # what is not a number can't be bounded
        near = (square - error <= limit[:, None]) | np.isnan(square) | ~np.isfinite(limit)[:, None]
    out = np.full(square.shape, -np.inf)
    rows, cols = np.nonzero(near)
    step = max(1, _TILE_ELEMS // max(1, q.shape[1]))
    for lo in range(0, len(rows), step):
        r, p = rows[lo : lo + step], cols[lo : lo + step]
        diff = q_raw[r] - c_raw[p]
        out[r, p] = 0.0 - np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


class _RunningTopK:
    """Per-task running top-k of a fixed query block against streamed corpus rows.

    A single-precision product of a tile gives an upper bound of every score (rounding included); only pairs whose
    bound reaches the k-th best score held for their query are scored exactly, pair by pair in double precision.  So
    a score does not depend on where a pair lies in a tile, and equal vectors tie exactly."""

    def __init__(self, q_raw: np.ndarray, metric: str, k: int):
        self.metric = metric
        self.k = k
        self.q_raw = q_raw
        n, dim = q_raw.shape
        self.error = np.float64(np.finfo(np.float32).eps) * 2 * (dim + 8)
        self.shift, self.scale = 0.0, 1.0
        with np.errstate(invalid="ignore", over="ignore"):
            if metric == "euclidean":  # distances do not change when all vectors move; near the origin the bound is close
                shift = q_raw[np.isfinite(q_raw).all(axis=1)].mean(axis=0) if np.isfinite(q_raw).all(axis=1).any() else np.zeros(dim)
                self.shift = np.where(np.isfinite(shift), shift, 0.0)
                size = np.median(np.abs(q_raw - self.shift)) * math.sqrt(dim) if n else 0.0
                self.scale = float(size) if np.isfinite(size) and size > 0 else 1.0
            self.q, q_sq, kind = self._prepared(q_raw)
        self.order = np.flatnonzero(kind == _TAME)  # queries that the product bounds
        self.wild = np.flatnonzero(kind == _WILD)  # those that it does not
        self.none = np.flatnonzero(kind == _NAN)  # those without a number for a score
        self.bound = self._bounds(self.q[self.order], q_sq[self.order], True)
        self.q_sq = q_sq
        self.kth = np.full(n, -np.inf)  # the k-th best key held
        self.kth_id = np.full(n, NO_ID, dtype=np.int64)  # its largest id, once ties have been cut
        self.limit = np.full(len(self.order), -np.inf, dtype=np.float32)
        self.held = [_no_entries()]
        self.pending = 0
        self.seen = 0
        self.first = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # k smallest ids of all rows, for queries without a number
        self.nans = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # k smallest ids of rows without a number

    def _prepared(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What pairs are scored from, squared norms for the bounds, and the kind of each row."""
        if self.metric == "cosine":
            unit, _ = _prepare(raw, "cosine")
            return unit, np.ones(len(raw)), np.where(np.isnan(unit).any(axis=1), _NAN, _TAME)
        moved = (raw - self.shift) / self.scale
        sq = np.einsum("ij,ij->i", moved, moved)
        return raw, sq, np.where(np.isnan(raw).any(axis=1), _NAN, np.where(sq < _TAME_SQUARE, _TAME, _WILD))

    def _bounds(self, rows: np.ndarray, sq: np.ndarray, of_queries: bool) -> np.ndarray:
        """Rows whose product bounds the cosine, or half the squared distance's negative without the query's own share."""
        if self.metric == "cosine":
            return rows.astype(np.float32)
        last = np.ones(len(rows)) if of_queries else sq * (self.error - 0.5)
        return np.concatenate([(rows - self.shift) / self.scale, last[:, None]], axis=1).astype(np.float32)

    def _limits(self) -> None:
        kth, sq = self.kth[self.order], self.q_sq[self.order]
        if self.metric == "cosine":
            least = kth - self.error
        else:
            far = np.square(kth / self.scale) * (1 + 1e-12)
            least = sq * (0.5 - self.error) - 0.5 * far - 1e-30  # less than that is lost in single precision
        # the step to single precision rounds down; nothing bounds what is not full yet
        self.limit = np.where(np.isfinite(kth), np.nextafter(np.clip(least, -1e38, 1e38).astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf))

    def _first_limits(self, rows: slice, upper: np.ndarray, c_sq: np.ndarray) -> np.ndarray:
        """Limits of queries that do not hold k rows yet: k rows of the tile score at least its k-th bound without the
        rounding on both sides, so what stays below that is out."""
        if upper.shape[1] < self.k or not 1e-100 < self.scale < 1e100:  # squares of distances may overflow or vanish
            return self.limit[rows]
        kth = np.partition(upper, upper.shape[1] - self.k, axis=1)[:, upper.shape[1] - self.k].astype(np.float64)
        size = 1.0 if self.metric == "cosine" else self.q_sq[self.order[rows]] + c_sq.max()
        least = np.clip(kth - 2.5 * self.error * size - 2e-30, -1e38, 1e38).astype(np.float32)
        return np.fmax(self.limit[rows], np.nextafter(least, np.float32(-np.inf)))

    def _scores(self, r: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", over="ignore"):
            if self.metric == "cosine":
                return np.einsum("ij,ij->i", self.q[r], c[p])
            diff = self.q[r] - c[p]
            return 0.0 - np.sqrt(np.einsum("ij,ij->i", diff, diff))

    def add(self, c_raw: np.ndarray, c_ids: np.ndarray, c_pos: np.ndarray | None = None) -> None:
        """Score corpus rows; ``c_pos`` are their row positions in the task's
        payload (defaults to 0..n-1)."""
        if self.q.shape[0] == 0 or c_raw.shape[0] == 0:
            return
        if c_pos is None:
            c_pos = np.arange(c_raw.shape[0], dtype=np.int64)
        step = max(4 * self.k, _TILE_ROWS)
        for lo in range(0, len(c_raw), step):
            hi = lo + step
            self._add(c_raw[lo:hi], c_ids[lo:hi], c_pos[lo:hi])
            self.seen += len(c_raw[lo:hi])

    def _add(self, c_raw: np.ndarray, c_ids: np.ndarray, c_pos: np.ndarray) -> None:
        with np.errstate(invalid="ignore", over="ignore"):
            c, c_sq, kind = self._prepared(c_raw)
        numbers = kind != _NAN
        if not numbers.all():
            self.nans = self._smallest(self.nans, c_ids[~numbers], c_pos[~numbers])
        if len(self.none):
            self.first = self._smallest(self.first, c_ids, c_pos)
        tame, wild = np.flatnonzero(kind == _TAME), np.flatnonzero(kind == _WILD)
        bound = np.ascontiguousarray(self._bounds(c[tame], c_sq[tame], False).T)
        for at in range(0, len(self.order) if len(tame) else 0, _TILE_QUERIES):
            rows = slice(at, at + _TILE_QUERIES)
            upper = self.bound[rows] @ bound
            limit = self._first_limits(rows, upper, c_sq[tame]) if np.isneginf(self.limit[rows]).any() else self.limit[rows]
            i, j = _places(upper >= limit[:, None])
            self._enter(self.order[at + i], c, tame[j], c_ids, c_pos)
        for some, columns in ((self.wild, np.flatnonzero(numbers)), (self.order, wild)):
            step = max(1, _PAIRS // max(1, len(columns)))
            for at in range(0, len(some) if len(columns) else 0, step):
                part = some[at : at + step]
                self._enter(np.repeat(part, len(columns)), c, np.tile(columns, len(part)), c_ids, c_pos)
        if self.pending > _SLACK * self.kth.size * self.k:
            self._merge()

    def _enter(self, r: np.ndarray, c: np.ndarray, p: np.ndarray, c_ids: np.ndarray, c_pos: np.ndarray) -> None:
        for lo in range(0, len(r), _PAIRS):
            rr, pp = r[lo : lo + _PAIRS], p[lo : lo + _PAIRS]
            s = self._scores(rr, c, pp)
            key = np.where(np.isnan(s), np.inf, s)
            ids, kth = c_ids[pp], self.kth[rr]
            keep = (key > kth) | ((key == kth) & (ids < self.kth_id[rr]))
            self.held.append((rr[keep], s[keep], ids[keep], c_pos[pp[keep]]))
            self.pending += int(keep.sum())
            if self.pending > 2 * self.kth.size * self.k + _PAIRS:
                self._merge()

    def _smallest(self, have: tuple, ids: np.ndarray, pos: np.ndarray) -> tuple:
        ids, pos = np.concatenate([have[0], ids]), np.concatenate([have[1], pos])
        first = np.argsort(ids, kind="stable")[: self.k]
        return ids[first], pos[first]

    def _merge(self, last: bool = False) -> None:
        """Drops what is no longer among the k best of its query; ties with the k-th stay while they are few."""
        r, s, ids, pos = (np.concatenate(x) for x in zip(*self.held))
        n, k = self.kth.size, self.k
        key = np.where(np.isnan(s), np.inf, s)
        counts = np.bincount(r, minlength=n)
        width = int(counts.max(initial=0))
        cut = last
        if not last and width > k:
            cut = n * width > 4 * len(r) + 8 * _PAIRS
            if not cut:
                order = np.argsort(r.astype(np.uint16) if n <= 1 << 16 else r, kind="stable")
                table = np.full((n, width), -np.inf)
                table[r[order], np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)] = key[order]
                kth = np.partition(table, width - k, axis=1)[:, width - k]
                kth[counts < k] = -np.inf
                keep = key >= kth[r]
                cut = int(keep.sum()) > 2 * n * k
                self.kth_id[kth > self.kth] = NO_ID
                self.kth = np.maximum(self.kth, kth)
                r, s, ids, pos, key = r[keep], s[keep], ids[keep], pos[keep], key[keep]
        if cut:
            order = np.lexsort((ids, -key, r))
            r, s, ids, pos, key = r[order], s[order], ids[order], pos[order], key[order]
            counts = np.bincount(r, minlength=n)
            place = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = place == k - 1
            self.kth[r[at]], self.kth_id[r[at]] = key[at], ids[at]
            keep = place < k
            r, s, ids, pos = r[keep], s[keep], ids[keep], pos[keep]
        self.held, self.pending = [(r, s, ids, pos)], 0
        self._limits()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query row, example id, score, payload position) of every kept entry."""
        numbered = np.setdiff1d(np.arange(self.kth.size), self.none)
        for some, (ids, pos) in ((numbered, self.nans), (self.none, self.first)):
            if len(some) and len(ids):
                self.held.append((np.repeat(some, len(ids)), np.full(len(some) * len(ids), np.nan), np.tile(ids, len(some)), np.tile(pos, len(some))))
        self._merge(last=True)
        r, s, ids, pos = self.held[0]
        return r, ids, s, pos


def _no_entries() -> tuple:
    return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true places of a matrix: eight columns are looked at at once."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    found = (eights[:, None] * 8 + np.arange(8)).ravel()
    found = found[flat[found]]
    found = np.concatenate([found, whole + np.flatnonzero(flat[whole:])])
    return found // max(1, mask.shape[1]), found % max(1, mask.shape[1])


def _out_schema(q_type, corpus: DataFrame, carry) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", q_type),
            T.StructField("example_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
        + [T.StructField(c, corpus.schema[c].dataType) for c in carry]
    )


def _emit(q_ids: pa.Array, acc: "_RunningTopK", payload: list[pa.Array], carry):
    r, ex, sc, pos = acc.rows()
    names = ["query_id", "example_id", "score"] + list(carry)
    for lo in range(0, r.size, _OUT_ROWS):
        some = slice(lo, lo + _OUT_ROWS)
        cols = [q_ids.take(pa.array(r[some], pa.int64())), pa.array(ex[some], pa.int64()), pa.array(sc[some], pa.float64())]
        cols += [arr.take(pa.array(pos[some], pa.int64())) for arr in payload]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def _broadcast_scores(queries, corpus, k, metric, qid, qvec, eid, cvec, dim, q_type, carry):
    spark = queries.sparkSession
    qt = queries.select(qid, qvec).where(F.size(qvec) == dim).toArrow()
    q_ids = qt.column(0).combine_chunks()
    q_mat, _ = _list_matrix(qt.column(1), dim)
    bc = spark.sparkContext.broadcast((q_ids, q_mat))
    carry = list(carry)

    def score_partition(batches):
        ids_arr, qm = bc.value
        acc = _RunningTopK(qm, metric, k)
        payload: list[list[pa.Array]] = [[] for _ in carry]
        offset = 0
        for batch in batches:
            c_mat, valid = _list_matrix(batch.column(1), dim)
            c_ids = batch.column(0).to_numpy(zero_copy_only=False)[valid].astype(np.int64)
            pos = offset + np.nonzero(valid)[0]
            acc.add(c_mat, c_ids, pos)
            for j in range(len(carry)):
                payload[j].append(batch.column(2 + j))
            offset += batch.num_rows
        merged = [pa.concat_arrays(p) if p else pa.array([]) for p in payload]
        yield from _emit(ids_arr, acc, merged, carry)

    return scoring_layout(corpus.select(F.col(eid).cast("long"), cvec, *carry)).mapInArrow(
        score_partition, _out_schema(q_type, corpus, carry)
    )


def _grid(n_q: int, n_c: int, dim: int, k: int, block_bytes: int, parallelism: int) -> tuple[int, int]:
    """Query blocks and corpus blocks: enough pairs of blocks for all cores and none with more than ``_TASK_PAIRS``
    products, query blocks within ``block_bytes``, and within that the least work for copies of rows and for lists."""
    vector, lists = max(dim, 1) * 8 + 16, 48 * k
    tasks = max(4 * parallelism, math.ceil(n_q * n_c / _TASK_PAIRS))
    least = math.ceil(n_q * (vector + lists) / block_bytes)
    most = max(1, min(n_c, tasks))
    cbs = range(min(most, math.ceil(tasks / max(1, n_q))), most + 1)
    grids = ((max(1, min(n_q, max(least, math.ceil(tasks / cb)))), cb) for cb in cbs)
    return min(grids, key=lambda g: n_c * vector * g[0] + n_q * (vector + _LIST_BYTES * k) * g[1])


def _blocked_scores(queries, corpus, k, metric, qid, qvec, eid, cvec, dim, q_type, n_q, n_c, block_bytes, carry):
    qb, cb = _grid(n_q, n_c, dim, k, block_bytes, queries.sparkSession.sparkContext.defaultParallelism)
    carry = list(carry)
    same = queries.schema[qvec].dataType == corpus.schema[cvec].dataType
    vector = (lambda c: F.col(c)) if same else (lambda c: F.col(c).cast("array<double>"))
    block = lambda key, v, n: F.pmod(F.xxhash64(key, v), F.lit(n)).cast("int")

    def copies(n, part):
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), part))

    of_query, of_row = block(qid, qvec, qb), block(eid, cvec, cb)
    queries, corpus = spread(queries.select(qid, qvec)), spread(corpus.select(*dict.fromkeys([eid, cvec, *carry])))
    q_rep = queries.where(F.size(qvec) == dim).withColumn("_part", copies(cb, lambda j: of_query * cb + j)).select(
        "_part",
        F.lit(False).alias("_row"),
        F.col(qid).alias("query_id"),
        F.lit(None).cast("long").alias("example_id"),
        vector(qvec).alias("v"),
        *[F.lit(None).cast(corpus.schema[c].dataType).alias(f"_carry_{i}") for i, c in enumerate(carry)],
    )
    c_rep = corpus.where(F.size(cvec) == dim).withColumn("_part", copies(qb, lambda i: i * cb + of_row)).select(
        "_part",
        F.lit(True).alias("_row"),
        F.lit(None).cast(q_type).alias("query_id"),
        F.col(eid).cast("long").alias("example_id"),
        vector(cvec).alias("v"),
        *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)],
    )

    def score_block(batches):
        q_ids, q_mats, acc = [], [], None
        payload: list[list[pa.Array]] = [[] for _ in carry]
        offset = 0
        for batch in batches:  # the queries of the block come first
            n = batch.num_rows - (batch.column(0).true_count or 0)
            if n:
                q_ids.append(batch.column(1).slice(0, n))
                q_mats.append(_list_matrix(batch.column(3).slice(0, n), dim)[0])
            rows = batch.slice(n)
            if not rows.num_rows or not q_ids:
                continue
            if acc is None:
                acc = _RunningTopK(np.vstack(q_mats), metric, k)
                q_mats.clear()
            ids = rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            acc.add(_list_matrix(rows.column(3), dim)[0], ids, offset + np.arange(rows.num_rows))
            for j in range(len(carry)):
                payload[j].append(rows.column(4 + j))
            offset += rows.num_rows
        if acc is not None:
            yield from _emit(pa.concat_arrays(q_ids), acc, [pa.concat_arrays(p) for p in payload], carry)

    return (
        q_rep.unionByName(c_rep)
        .repartitionById(qb * cb, F.col("_part"))
        .sortWithinPartitions("_row")
        .drop("_part")
        .mapInArrow(score_block, _out_schema(q_type, corpus, carry))
    )


def dense_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    *,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    example_id: str = "example_id",
    corpus_vector: str = "embedding",
    strategy: str = "auto",
    broadcast_limit_bytes: int = DEFAULT_BROADCAST_LIMIT,
    block_bytes: int = DEFAULT_BLOCK_BYTES,
    carry: tuple[str, ...] | list[str] = (),
    dim: int | None = None,
) -> DataFrame:
    """Top-k corpus rows per query: (query_id, rank, example_id, score).

    ``rank`` starts at 1; a query gets min(k, corpus size) rows.  Vectors whose
    length is not ``dim`` (by default that of the corpus) are not scored (see V6).
    ``carry`` names small corpus columns (features) passed through the scan
    next to each hit, so no join back to the corpus is needed for them.
    """
    _check_metric(metric)
    if k < 1:
        raise ValueError("k must be >= 1")
    ship_package(queries.sparkSession)
    q_type = queries.schema[query_id].dataType
    n_q = queries.count()
    if dim is None:
        first = corpus.select(F.size(corpus_vector).alias("d")).where("d > 0").first()
        dim = int(first["d"]) if first else 0
    if n_q == 0 or dim <= 0:
        return _empty_result(queries, q_type, query_id, corpus, carry)
    q_bytes = n_q * (dim * 8 + 16)
    if strategy == "auto":
        strategy = "broadcast" if q_bytes <= broadcast_limit_bytes else "blocked"
    if strategy == "broadcast":
        if q_bytes > broadcast_limit_bytes:
            raise ValueError(f"query block of {q_bytes} bytes exceeds the broadcast limit")
        partial = _broadcast_scores(queries, corpus, k, metric, query_id, query_vector, example_id, corpus_vector, dim, q_type, carry)
    elif strategy == "blocked":
        n_c = corpus.count()
        partial = _blocked_scores(
            queries, corpus, k, metric, query_id, query_vector, example_id, corpus_vector, dim, q_type, n_q, n_c, block_bytes, carry
        )
    else:
        raise ValueError(f"unknown strategy {strategy}")
    ranked = top_k_per_group(partial, ["query_id"], [F.col("score").desc(), F.col("example_id").asc()], k)
    out = ranked.select(
        F.col("query_id").alias(query_id) if query_id != "query_id" else F.col("query_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("example_id"),
        F.col("score"),
        *carry,
    )
    return out


def _empty_result(queries: DataFrame, q_type, query_id: str, corpus: DataFrame, carry) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField(query_id, q_type),
            T.StructField("rank", T.IntegerType()),
            T.StructField("example_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
            *[T.StructField(c, corpus.schema[c].dataType) for c in carry],
        ]
    )
    return queries.sparkSession.createDataFrame([], schema)

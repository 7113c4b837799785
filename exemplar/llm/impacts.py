"""Ranked lexical search over impact vectors in norm buckets, with exact integer scores.

A document is a vector of impacts, one for each term that some item holds:
(10^9 tf) div (1000 tf + 20 m), with m = 50 + ((50 n N) div L).  An item weighs its terms
with w = floor(1000 ln((2N + 2) / (2 df + 1))); a score is the inner product, in 64-bit integers.

1. Items are read in blocks of about ``BLOCK_BYTES`` of terms (repeated rows once, with
   their count).  The terms of a block go to all tasks; documents become postings
   (n, terms of the block with tf), written to the shared folder, so texts are cut once a block.
2. N, L and the df of the block's terms are sums over the postings: per task one row per term.
3. Within a chunk of postings the vectors are ordered by length and cut into buckets.
   By Cauchy-Schwarz a bucket whose longest vector times the item's length stays below the
   item's threshold ends the search of the chunk.  In other buckets the item's heaviest
   terms are its focus: as many as it takes for the rest to stay below ``FOCUS`` of the
   threshold, so a document without a focus term is out.  The rest is bounded twice: by lengths, and by
   coordinates (the highest impact of each term in the bucket).  For the others the products of
   the focus terms and the smaller bound of their rest decide; survivors are scored exactly
   from all their terms.
4. A first round searches the longest vectors of every chunk only; the k-th best score
   over all chunks is a lower bound of the final one and the threshold of the second round, which
   searches everything.  Tasks then return documents that reach it, at most k per item.

Bounds are in doubles and widened by more than their rounding; pruning drops only what stays
strictly below a score that k documents reach, so results are exact.

Defined results: null texts hold no term; items and documents without terms are in no result
(the latter not in N either); a null doc_id ranks after all others of its score; repeated
items are answered once per row and repeated documents rank each; other columns are ignored;
an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import bytewords as bw
from .workers import ready

#: Terms of a block of items, in bytes, and postings of a chunk and vectors of a bucket.
BLOCK_BYTES = 4 << 20
CHUNK_POSTINGS = 1 << 21
BUCKET_ROWS = 2048
#: The focus of an item leaves less than this share of its threshold to the other terms.
FOCUS = 1 / 8
#: The first round reads this share of a chunk's vectors, and one bucket at least.
FIRST_ROUND = 1 / 16

POSTINGS = "doc_id long, n long, terms binary, tfs binary"


# ------------------------------------------------------------------ terms --


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of a slice of texts as one Arrow array, and their text numbers."""
    start, end, doc = bw.words(data, offsets, bw.ALNUM)
    bounds = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=bounds[1:])
    letters = bw.LOWER[data[bw.ALNUM[data]]]  # words are exactly these bytes, one after the other
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]), doc


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in bw.slices(batch.column("text")):
            words, doc = words_of(data, offsets)
            code = words.dictionary_encode()
            T = max(1, len(code.dictionary))
            pairs = np.unique(doc * T + code.indices.to_numpy())
            lists = np.searchsorted(pairs // T, np.arange(len(offsets))).astype(np.int32)
            terms = code.dictionary.take(pa.array(pairs % T)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").slice(first, len(offsets) - 1), pa.ListArray.from_arrays(pa.array(lists), terms)], names=["item_id", "terms"]
            )


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct, sorted) and copies of every item with a term."""
    found = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_distinct_terms, "item_id long, terms array<string>")
    return found.where(F.size("terms") > 0).groupBy("item_id", F.array_sort("terms").alias("terms")).agg(F.count("*").alias("copies"))


class Queries:
    """A block of items: their vocabulary, and per item its terms by number."""

    def __init__(self, block: pa.Table) -> None:
        self.ids = block["item_id"].combine_chunks()
        self.copies = block["copies"].combine_chunks()
        terms = block["terms"].combine_chunks()
        code = terms.flatten().dictionary_encode()
        self.vocabulary = code.dictionary.cast(pa.binary())
        self.bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())]).astype(np.int64)
        self.terms = code.indices.to_numpy().astype(np.int64)

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        """Weights per term; per item its terms heaviest first and the lengths of what follows each of them."""
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        self.items: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(self.bounds[:-1], self.bounds[1:]):
            t = self.terms[a:b]
            t = t[np.argsort(-self.weights[t], kind="stable")]
            w = self.weights[t]
            squares = w.astype(np.float64) ** 2
            rest = np.sqrt(np.concatenate([np.cumsum(squares[::-1])[::-1], [0.0]]))
            self.items.append((t, w, rest))


# --------------------------------------------------------------- postings --


def _postings(vocabulary: pa.Array):
    n_terms = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in bw.slices(batch.column("text")):
                words, doc = words_of(data, offsets)
                count = len(offsets) - 1
                number = pc.index_in(words, value_set=vocabulary)
                known = number.is_valid().to_numpy(zero_copy_only=False)
                key = doc[known] * n_terms + number.drop_null().to_numpy()
                pairs, tf = np.unique(key, return_counts=True)
                bounds = np.searchsorted(pairs, np.arange(count + 1) * n_terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, count),
                        pa.array(np.bincount(doc, minlength=count), pa.int64()),
                        bw.binary_rows((pairs % n_terms).astype(np.int32), bounds),
                        bw.binary_rows(tf.astype(np.int32), bounds),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return run


def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The int32 values of a column of binaries, one after the other, and each row's bounds."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, column.offset + len(column) + 1)[column.offset :]
    if bounds[0] == bounds[-1]:
        return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
    return np.frombuffer(data, np.int32)[bounds[0] // 4 : bounds[-1] // 4], (bounds - bounds[0]) // 4


def _counts(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, words = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            docs, words = docs + int(np.count_nonzero(n)), words + int(n.sum())
            df += np.bincount(_integers(batch.column("terms"))[0], minlength=n_terms)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], seen]), pa.int64()), pa.array(np.concatenate([[words, docs], df[seen]]), pa.int64())], names=["term", "count"]
        )

    return run


# ----------------------------------------------------------------- search --


class Chunk:
    """Impact vectors ordered by length, longest first."""

    def __init__(self, batches: list[pa.RecordBatch], n_docs: int, n_words: int) -> None:
        table = pa.Table.from_batches(batches)
        terms, bounds = _integers(table["terms"].combine_chunks())
        tfs, _ = _integers(table["tfs"].combine_chunks())
        size = np.diff(bounds)
        n = table["n"].to_numpy()
        if 50 * int(n.max()) * n_docs >= 1 << 63:
            m = np.array([50 + 50 * x * n_docs // n_words for x in n.tolist()], np.int64)
        else:
            m = 50 + 50 * n * n_docs // n_words
        tf = tfs.astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, size))
        square = np.concatenate([[0.0], np.cumsum(impact.astype(np.float64) ** 2)])
        row_square = square[bounds[1:]] - square[bounds[:-1]]
        order = np.argsort(-row_square, kind="stable")
        take = _ranges(bounds[:-1][order], size[order])
        self.terms, self.impact = terms[take], impact[take]
        self.bounds = np.concatenate([[0], np.cumsum(size[order])])
        self.square = row_square[order]
        # sums of squares are differences of running sums: widen them by what these may have lost
        self.slack = float(square[-1]) * 1e-12
        ids = table["doc_id"].combine_chunks()
        self.unknown = ids.is_null().to_numpy(zero_copy_only=False)[order]
        self.ids = ids.fill_null(0).to_numpy()[order]

    def __len__(self) -> int:
        return len(self.ids)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Best:
    """The k best documents of every item so far and the scores to reach."""

    def __init__(self, queries: Queries, k: int, least: np.ndarray) -> None:
        self.queries, self.k, self.least = queries, k, least.copy()
        self.found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(least)
        self.scored = self.met = 0
        self._weights = np.zeros(len(queries.vocabulary), np.int64)

    def search(self, chunk: Chunk, rows: int) -> None:
        """Searches the ``rows`` longest vectors."""
        active = list(range(len(self.least)))
        self.met += len(active) * rows
        for first in range(0, rows, BUCKET_ROWS):
            last = min(first + BUCKET_ROWS, rows)
            longest = math.sqrt(chunk.square[first] + chunk.slack) * (1 + 1e-9)
            active = [q for q in active if self.queries.items[q][2][0] * longest >= self.least[q]]
            if not active:
                return
            bucket = Bucket(chunk, first, last)
            for q in active:
                self._search_bucket(bucket, q, longest)

    def _search_bucket(self, bucket: Bucket, q: int, longest: float) -> None:
        terms, weights, rest = self.queries.items[q]
        least = self.least[q]
        low, lens, highest = bucket.postings(terms)
        # what the terms from each one on can add: by lengths, and by the highest impact of each coordinate
        upper = np.concatenate([np.cumsum((weights * highest)[::-1])[::-1], [0]])
        rest_most = np.minimum(rest * longest, upper * (1 + 1e-9))
        if rest_most[0] < least:
            return
        focus = int(np.flatnonzero(rest_most < least * FOCUS)[0])
        at = _ranges(low[:focus], lens[:focus])
        impact = bucket.impact[at].astype(np.float64)
        rows = bucket.rows[at]
        size = bucket.last - bucket.first
        done = np.bincount(rows, np.repeat(weights[:focus], lens[:focus]) * impact, minlength=size)
        used = np.bincount(rows, impact * impact, minlength=size)
        left = np.sqrt(np.maximum(bucket.square - used, 0.0) + bucket.chunk.slack)
        most = done + np.minimum(rest[focus] * left, rest_most[focus])
        near = np.flatnonzero((used > 0) & (most * (1 + 1e-9) + 1 >= least))
        if len(near) == 0:
            return
        self.scored += len(near)
        self._score(bucket, q, near + bucket.first)

    def _score(self, bucket: Bucket, q: int, rows: np.ndarray) -> None:
        chunk, (terms, weights, _) = bucket.chunk, self.queries.items[q]
        size = chunk.bounds[rows + 1] - chunk.bounds[rows]
        at = _ranges(chunk.bounds[rows], size)
        self._weights[terms] = weights
        products = self._weights[chunk.terms[at]] * chunk.impact[at]
        self._weights[terms] = 0
        score = np.add.reduceat(products, np.cumsum(size) - size)
        good = score >= self.least[q]
        if not good.any():
            return
        rows = rows[good]
        old = self.found[q]
        score, unknown, ids = (np.concatenate(x) for x in zip(old, (score[good], chunk.unknown[rows], chunk.ids[rows])))
        order = np.lexsort((ids, unknown, -score))[: self.k]
        self.found[q] = score[order], unknown[order], ids[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], score[order[-1]])

    def rows(self) -> pa.RecordBatch:
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        number = np.repeat(np.arange(len(self.found)), np.array([len(f[0]) for f in self.found], np.int64))
        score, unknown, ids = (np.concatenate(x) for x in zip(none, *self.found))
        columns = [pa.array(number, pa.int64()), pa.array(ids, pa.int64(), mask=unknown), pa.array(score, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])


class Bucket:
    """Vectors of nearly one length, their postings ordered by term."""

    def __init__(self, chunk: Chunk, first: int, last: int) -> None:
        self.chunk, self.first, self.last = chunk, first, last
        a, b = chunk.bounds[first], chunk.bounds[last]
        order = np.argsort(chunk.terms[a:b], kind="stable")
        self.terms = chunk.terms[a:b][order]
        self.impact = chunk.impact[a:b][order]
        self.rows = np.repeat(np.arange(last - first), np.diff(chunk.bounds[first : last + 1]))[order]
        self.square = chunk.square[first:last]
        begins = np.flatnonzero(np.diff(self.terms, prepend=-1))
        self.distinct = self.terms[begins]
        self.highest = np.maximum.reduceat(self.impact, begins)
        self.begins = np.append(begins, len(self.terms))

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the postings of these terms begin, how many each has, and its highest impact."""
        at = np.searchsorted(self.distinct, terms)
        here = self.distinct[np.minimum(at, len(self.distinct) - 1)] == terms
        at = np.where(here, at, 0)
        return self.begins[at], np.where(here, self.begins[at + 1] - self.begins[at], 0), np.where(here, self.highest[at], 0)


def _search(shared, k: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least, n_docs, n_words = shared.value
        best = Best(queries, k, least)
        for part in _chunks(batches):
            chunk = Chunk(part, n_docs, n_words)
            best.search(chunk, min(len(chunk), max(BUCKET_ROWS, math.ceil(share * len(chunk)))))
        yield best.rows()

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows with postings, in runs of about ``CHUNK_POSTINGS``."""
    part, size = [], 0
    for batch in batches:
        bytes_ = pc.binary_length(batch.column("terms"))
        batch = batch.filter(pc.greater(bytes_, 0))
        if batch.num_rows:
            part.append(batch)
            size += (pc.sum(bytes_).as_py() or 0) // 4
        if size >= CHUNK_POSTINGS:
            yield part
            part, size = [], 0
    if part:
        yield part


FOUND = "item long, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    ready(spark)
    terms = written(item_terms(items), "impact-items")
    size = terms.agg(F.sum(F.length(F.concat_ws(" ", "terms")) + 16).alias("size")).first()["size"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = [_block(texts, terms.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b), k) for b in range(blocks)]
    paths = [path for part in parts for path in part.inputFiles()]
    found = spark.read.schema(parts[0].schema).parquet(*paths) if paths else parts[0]
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copies.select("item_id", "rank", "doc_id", "score")


def _block(texts: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The answers of one block of items, written to the shared folder."""
    spark = texts.sparkSession
    queries = Queries(items.toArrow())
    vocabulary = queries.vocabulary
    postings = written(texts.mapInArrow(_postings(vocabulary), POSTINGS), "impact-postings")
    counts = postings.select("n", "terms").mapInArrow(_counts(len(vocabulary)), "term long, count long").groupBy("term").agg(F.sum("count").alias("count")).toArrow()
    term, count = counts["term"].to_numpy(), counts["count"].to_numpy()
    df = np.zeros(len(vocabulary), np.int64)
    df[term[term >= 0]] = count[term >= 0]
    n_docs, n_words = int(count[term == -1].sum()), int(count[term == -2].sum())
    queries.weigh(n_docs, df)
    least = np.ones(len(queries.ids), np.int64)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = Window.partitionBy("item").orderBy(*order)

    def found(share: float, least: np.ndarray):
        shared = spark.sparkContext.broadcast((queries, least, n_docs, n_words))
        rows = postings.mapInArrow(_search(shared, k, share), FOUND)
        return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), shared

    first, shared = found(FIRST_ROUND, least)
    reached = first.where(F.col("rank") == k).select("item", "score").toArrow()
    shared.destroy()
    least[reached["item"].to_numpy()] = np.maximum(reached["score"].to_numpy(), 1)
    rows, shared = found(1.0, least)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(queries.ids)), pa.int64()), "item_id": queries.ids, "copies": queries.copies}))
    out = written(rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score", "copies"), "impact-found")
    shared.destroy()
    return out

"""Okapi BM25 retrieval (B1), exact top-k per query, over a stored inverted index.

Index (``build``): documents are cut into blocks of up to ``BLOCK_DOCS`` documents or
``BLOCK_TOKENS`` tokens where they lie; a task tokenizes its blocks (Arrow RE2) and emits one
row per (term, block) with the postings and two block maxima, the largest tf and the
shortest length, and one row per block with its documents.  The rows are range-partitioned
and sorted by (term, block), so a term's postings lie together and a term of every document is
spread over as many partitions as it needs.  Nothing in the index depends on corpus
statistics, so blocks can be added without touching the old ones.

Search: the query terms' rows give N, the total length and the document frequencies, and for
every (query, block) an upper bound of the score of its documents (weights times the BM25 part of the
block maxima).  The best block of each query is searched first; its k-th score is a lower bound of the
final one.  Then only blocks whose bound reaches it are read, grouped by block, and searched
with max-score pruning: terms in the order of what they can add are essential until the others
together stay below the threshold; a document without an essential term is never scored, and one
whose essential parts and the bound of the others stay below it is dropped.

Queries are handled in blocks of ``query_limit_bytes`` of (query, term) pairs, so what is broadcast is bounded.

Scores use k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a
document is a hit only if it shares at least one term with the query.  Ranking
treats scores equal to 1e-9 as ties, broken by document id, so copies of a
document rank the same way in every engine.  Documents without an id count in the
statistics and are no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, written
from .layout import scoring_layout
from .topk import top_k_per_group

# BM25 parameters and the token pattern.
K1 = 1.2
B = 0.75
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
RANK_DECIMALS = 9
#: Scores this far below a threshold may still tie with it after rounding.
_EPS = 1e-8
BLOCK_DOCS = 4096
BLOCK_TOKENS = 4 << 20
QUERY_LIMIT_BYTES = 64 << 20

INDEX = "term string, block long, n long, tokens long, max_tf int, min_len int, docs binary, tfs binary"


def tokenize(text) -> Column:
    """Lower-cased word tokens (letters, digits, underscore; any script)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


_ALL = "\u0000"  # the term of a block's own row: its documents and their lengths
_SPLIT = r"[^\p{L}\p{N}_]+"


def arrow_tokens(texts: pa.Array) -> pa.ListArray:
    """Vectorised tokenizer (Arrow's RE2): lower-case, split on non-word runs,
    drop empty pieces.  Same tokens as ``tokenize``."""
    parts = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), pattern=_SPLIT)
    flat = parts.flatten()
    keep = pc.not_equal(flat, "")
    row = np.repeat(np.arange(len(parts)), parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    kept_rows = row[keep.to_numpy(zero_copy_only=False)]
    counts = np.bincount(kept_rows, minlength=len(parts))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat.filter(keep))


def _query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) with the Arrow tokenizer."""

    def fn(batches):
        for batch in batches:
            toks = arrow_tokens(batch.column(1))
            lengths = toks.value_lengths().to_numpy(zero_copy_only=False)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(lengths)), lengths), pa.int64()))
            t = pa.table({"query_id": ids, "term": toks.flatten()})
            g = t.group_by(["query_id", "term"]).aggregate([("term", "count")])
            yield from g.rename_columns(["query_id", "term", "qtf"]).to_batches()

    q_type = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInArrow(fn, f"query_id {q_type}, term string, qtf long")


# ------------------------------------------------------------------- index --


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Row i holds the bytes of values[bounds[i]:bounds[i + 1]]."""
    offsets = (bounds * values.itemsize).astype(np.int64)
    wide = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return wide.cast(pa.binary())


def _block_rows(block: int, ids: list[pa.Array], tokens: list[pa.ListArray], vocabulary: pa.Array | None) -> pa.RecordBatch:
    """The index rows of one block of documents."""
    doc_ids = pa.concat_arrays(ids)
    lengths = np.concatenate([t.value_lengths().to_numpy(zero_copy_only=False) for t in tokens]).astype(np.int32)
    flat = pa.concat_arrays([t.flatten() for t in tokens])
    row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    if vocabulary is not None:
        known = pc.is_in(flat, value_set=vocabulary)
        flat, row = flat.filter(known), row[known.to_numpy(zero_copy_only=False)]
    code = flat.dictionary_encode()
    n_terms = len(code.dictionary)
    pairs, tf = np.unique(code.indices.to_numpy().astype(np.int64) * len(lengths) + row, return_counts=True)
    bounds = np.searchsorted(pairs, np.arange(n_terms + 1, dtype=np.int64) * max(1, len(lengths)))
    docs, tf = (pairs % max(1, len(lengths))).astype(np.int32), tf.astype(np.int32)
    first = bounds[:-1]
    max_tf = np.maximum.reduceat(tf, first) if n_terms else np.zeros(0, np.int32)
    min_len = np.minimum.reduceat(lengths[docs], first) if n_terms else np.zeros(0, np.int32)
    # the block's own row last: ids (-1 and a length below 0 where there is none) and lengths
    unknown = doc_ids.is_null().to_numpy(zero_copy_only=False)
    own_ids = doc_ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    own_len = np.where(unknown, -1 - lengths, lengths).astype(np.int32)
    both = lambda a, b: pa.concat_arrays([a, b])
    one = np.array([0, len(lengths)])
    return pa.RecordBatch.from_arrays(
        [
            both(code.dictionary.cast(pa.string()), pa.array([_ALL])),
            pa.array([block] * (n_terms + 1), pa.int64()),
            pa.array(np.append(np.diff(bounds), len(lengths)), pa.int64()),
            pa.array(np.append(np.add.reduceat(tf, first) if n_terms else [], lengths.sum(dtype=np.int64)).astype(np.int64), pa.int64()),
            pa.array(np.append(max_tf, 0), pa.int32()),
            pa.array(np.append(min_len, 0), pa.int32()),
            both(_binary(docs, bounds), _binary(own_ids, one)),
            both(_binary(tf, bounds), _binary(own_len, one)),
        ],
        names=["term", "block", "n", "tokens", "max_tf", "min_len", "docs", "tfs"],
    )


def _builder(vocabulary, block_docs: int):
    def fn(batches):
        from pyspark import TaskContext

        words = vocabulary.value if vocabulary is not None else None
        block = TaskContext.get().partitionId() << 32
        ids, tokens, docs, size = [], [], 0, 0
        for batch in batches:
            for first in range(0, batch.num_rows, block_docs):
                part = batch.slice(first, block_docs)
                cut = arrow_tokens(part.column(1))
                ids.append(part.column(0))
                tokens.append(cut)
                docs, size = docs + part.num_rows, size + len(cut.flatten())
                if docs >= block_docs or size >= BLOCK_TOKENS:
                    yield _block_rows(block, ids, tokens, words)
                    block, ids, tokens, docs, size = block + 1, [], [], 0, 0
        if docs:
            yield _block_rows(block, ids, tokens, words)

    return fn


def index_rows(docs: DataFrame, vocabulary=None, block_docs: int | None = None) -> DataFrame:
    """Index rows of (doc_id, text): all terms, or those of a broadcast vocabulary."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_builder(vocabulary, block_docs or BLOCK_DOCS), INDEX)


def build(docs: DataFrame, path: str, block_docs: int | None = None) -> None:
    """Stores the index of (doc_id, text), sorted by term and block."""
    rows = index_rows(docs, None, block_docs).repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    rows.write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


# ------------------------------------------------------------------ search --


class Block:
    """The postings of some terms in one block, with their BM25 parts."""

    def __init__(self, rows: pa.Table, avg_len: float) -> None:
        terms = rows["term"].combine_chunks()
        own = pc.equal(terms, _ALL)
        (at,) = np.flatnonzero(own.to_numpy(zero_copy_only=False))
        lengths = np.frombuffer(rows["tfs"][at].as_py(), np.int32)
        self.ids = np.frombuffer(rows["docs"][at].as_py(), np.int64)
        self.known = lengths >= 0
        norm = K1 * (1.0 - B + B * np.where(self.known, lengths, -1 - lengths) / avg_len)
        rest = rows.filter(pc.invert(own))
        self.terms = {t: i for i, t in enumerate(rest["term"].to_pylist())}
        self.docs = np.frombuffer(b"".join(rest["docs"].to_pylist()), np.int32)
        tf = np.frombuffer(b"".join(rest["tfs"].to_pylist()), np.int32).astype(np.float64)
        self.bounds = np.concatenate([[0], np.cumsum(rest["n"].to_numpy())]).astype(np.int64)
        self.parts = tf * (K1 + 1.0) / (tf + norm[self.docs])
        self.highest = np.maximum.reduceat(self.parts, self.bounds[:-1]) if len(self.terms) else np.zeros(0)
        self.scored = 0

    def search(self, weights: dict[str, float], least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents that reach ``least``."""
        here = [(self.terms[t], w) for t, w in weights.items() if t in self.terms]
        here.sort(key=lambda x: -x[1] * self.highest[x[0]])
        most = np.cumsum([0.0] + [w * self.highest[i] for i, w in reversed(here)])[::-1]  # what the terms from each one on can add
        none = np.zeros(0, np.int64), np.zeros(0)
        if not here or most[0] < least - _EPS:
            return none
        essential = int(np.flatnonzero(most < max(least - _EPS, _EPS))[0])
        spans = [slice(self.bounds[i], self.bounds[i + 1]) for i, _ in here]
        at = np.concatenate([self.docs[s] for s in spans[:essential]])
        parts = np.concatenate([w * self.parts[s] for s, (_, w) in zip(spans[:essential], here)])
        score = np.bincount(at, parts, minlength=len(self.ids))
        near = np.flatnonzero((score > 0) & (score + most[essential] >= least - _EPS) & self.known)
        score = score[near]
        self.scored += len(near)
        for n, (s, (_, w)) in enumerate(zip(spans[essential:], here[essential:]), essential):
            docs = self.docs[s]
            place = np.minimum(np.searchsorted(docs, near), len(docs) - 1)
            score = score + np.where(docs[place] == near, w * self.parts[s][place], 0.0)
            alive = score + most[n + 1] >= least - _EPS
            near, score = near[alive], score[alive]
        order = np.lexsort((self.ids[near], -np.round(score, RANK_DECIMALS)))[:k]
        return self.ids[near[order]], score[order]


def _search_blocks(postings: DataFrame, pairs: DataFrame, weights, k: int, avg_len: float) -> DataFrame:
    """(q, doc_id, score): the pairs (block, q, least) searched, one block a group."""

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if rows.num_rows and asked.num_rows:
            block = Block(rows, avg_len)
            for q, least in zip(asked["q"].to_pylist(), asked["least"].to_pylist()):
                out.append((q, *block.search(weights.value[q], least, k)))
        sizes = [len(ids) for _, ids, _ in out]
        flat = lambda xs, t: pa.array(np.concatenate(xs) if xs else [], t)
        return pa.table({
            "q": pa.array(np.repeat(np.array([q for q, *_ in out], np.int64), np.array(sizes, np.int64)), pa.int64()),
            "doc_id": flat([ids for _, ids, _ in out], pa.int64()),
            "score": flat([s for *_, s in out], pa.float64()),
        })

    wanted = postings.join(pairs.select("block").distinct(), "block", "left_semi")
    groups = wanted.select("block", "term", "n", "docs", "tfs").groupBy("block").cogroup(pairs.select("block", "q", "least").groupBy("block"))
    return groups.applyInArrow(search, "q long, doc_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    key = F.round(F.col("score"), RANK_DECIMALS)
    return top_k_per_group(found, ["q"], [key.desc(), F.col("doc_id").asc()], k)


def search_index(queries: DataFrame, index: DataFrame, k: int = 5, query_limit_bytes: int = QUERY_LIMIT_BYTES) -> DataFrame:
    """Top-k documents of an index per query (query_id, text): (query_id, rank, doc_id, score)."""
    return _search_all(_query_blocks(_query_terms(queries.select("query_id", "text")), query_limit_bytes), index, k)


def _query_blocks(qtf: DataFrame, query_limit_bytes: int) -> list[DataFrame]:
    """The queries' terms in blocks of bounded size; one block as it is."""
    size = qtf.agg(F.sum(F.octet_length("term") + 32).alias("bytes"), F.count_distinct("query_id").alias("n")).first()
    blocks = min(-(-(size.bytes or 0) // query_limit_bytes), 1 << 20, size.n)
    if blocks <= 1:
        return [qtf]
    qtf = written(qtf, "bm25-queries")
    return [qtf.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]


def _search_all(queries: list[DataFrame], index: DataFrame, k: int) -> DataFrame:
    if k < 1:
        raise ValueError("k must be >= 1")
    ship_package(index.sparkSession)
    if len(queries) == 1:
        return _search_block(queries[0].toArrow(), queries[0].schema, index, k)
    parts = [written(_search_block(q.toArrow(), q.schema, index, k), "bm25-found") for q in queries]
    paths = [p for part in parts for p in part.inputFiles()]
    return index.sparkSession.read.schema(parts[0].schema).parquet(*paths) if paths else parts[0]


def _search_block(asked: pa.Table, schema: T.StructType, index: DataFrame, k: int) -> DataFrame:
    """One block of (query_id, term, qtf); its terms and weights are bounded by the size of a block."""
    spark = index.sparkSession
    q_type = schema["query_id"].dataType.simpleString()
    out = f"query_id {q_type}, rank int, doc_id long, score double"
    vocabulary = pc.unique(asked["term"].combine_chunks())
    terms = spark.createDataFrame(pa.table({"term": pa.concat_arrays([vocabulary, pa.array([_ALL])])}))
    postings = index.join(F.broadcast(terms), "term", "left_semi")
    stats = postings.groupBy("term").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).toArrow()
    df = dict(zip(stats["term"].to_pylist(), stats["n"].to_pylist()))
    n_docs, total = df.pop(_ALL, 0), dict(zip(stats["term"].to_pylist(), stats["tokens"].to_pylist())).get(_ALL, 0)
    if not n_docs or not total:
        return spark.createDataFrame([], out)
    avg_len = float(total) / float(n_docs)
    ids = pc.unique(asked["query_id"].combine_chunks())
    number = pc.index_in(asked["query_id"].combine_chunks(), value_set=ids).to_numpy()
    weights: list[dict[str, float]] = [{} for _ in range(len(ids))]
    for q, term, qtf_ in zip(number.tolist(), asked["term"].to_pylist(), asked["qtf"].to_pylist()):
        if term in df:
            weights[q][term] = qtf_ * float(np.log(1.0 + (float(n_docs) - df[term] + 0.5) / (df[term] + 0.5)))
    shared = spark.sparkContext.broadcast(weights)
    flat = [(q, t, w) for q, ws in enumerate(weights) for t, w in ws.items()]
    table = pa.table({"q": pa.array([x[0] for x in flat], pa.int64()), "term": pa.array([x[1] for x in flat], pa.string()), "w": pa.array([x[2] for x in flat], pa.float64())})
    bounds = written(_bounds(postings, spark.createDataFrame(table), avg_len), "bm25-bounds")
    one = bounds.groupBy("q").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    first = _best(_search_blocks(postings, one.withColumn("least", F.lit(0.0)), shared, k, avg_len), k)
    reached = first.where(F.col("rank") == k).select("q", "score").toArrow()
    least = np.zeros(len(ids))
    least[reached["q"].to_numpy()] = reached["score"].to_numpy()
    names = spark.createDataFrame(pa.table({"q": pa.array(range(len(ids)), pa.int64()), "query_id": ids, "least": pa.array(least)}))
    pairs = bounds.join(F.broadcast(names.select("q", "least")), "q").where(F.col("bound") >= F.col("least") - _EPS)
    best = _best(_search_blocks(postings, pairs, shared, k, avg_len), k)
    return best.join(F.broadcast(names), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _bounds(postings: DataFrame, weights: DataFrame, avg_len: float) -> DataFrame:
    """(q, block, bound): what a document of the block can score at most; pairs without a shared term have no row."""
    tf = F.col("max_tf")
    part = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * F.col("min_len") / F.lit(avg_len)))
    rows = postings.select("term", "block", part.alias("part")).join(F.broadcast(weights), "term")
    return rows.groupBy("q", "block").agg(F.sum(F.col("w") * F.col("part")).alias("bound"))


def bm25_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    *,
    query_id: str = "query_id",
    query_text: str = "text",
    doc_id: str = "doc_id",
    doc_text: str = "text",
    query_limit_bytes: int = QUERY_LIMIT_BYTES,
    block_docs: int | None = None,
) -> DataFrame:
    """Top-k documents per query: (query_id, rank, doc_id, score), over an index built for this call.

    The index of one block of queries holds their terms only, that of several blocks all terms."""
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = queries.sparkSession
    ship_package(spark)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("text"))
    d = scoring_layout(docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")))
    blocks = _query_blocks(_query_terms(q), query_limit_bytes)
    if len(blocks) == 1:
        asked = blocks[0].toArrow()
        vocabulary = spark.sparkContext.broadcast(pc.unique(asked["term"].combine_chunks()))
        found = _search_block(asked, blocks[0].schema, written(index_rows(d, vocabulary, block_docs), "bm25-index"), k)
    else:
        found = _search_all(blocks, written(index_rows(d, None, block_docs), "bm25-index"), k)
    return found.withColumnsRenamed({"query_id": query_id, "doc_id": doc_id}).select(query_id, "rank", doc_id, "score")

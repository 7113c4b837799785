"""Embedders.

``HashedEmbedder`` is the default: token counts hashed (``xxhash64``) into
``dim`` buckets with built-in array functions and scaled to unit length.  It
needs no model files, runs in the JVM, and is deterministic across runs.

``BatchedEmbedder`` is for models: loaded once per worker process, texts cut at one token
limit for queries and corpus alike, and run in batches of texts of nearly one length (sorted
within a window of bounded size, order restored), so a batch is padded little.

``CallableEmbedder`` wraps any caller-supplied ``pd.Series[str] -> sequence of
vectors`` function as an Arrow-batched pandas UDF; the batch size is Spark's
``spark.sql.execution.arrow.maxRecordsPerBatch``.  The whole text is passed to
the callable; truncation, if any, is the model's business.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexer import shipped
from .vectors import NORM_EPS

_TOKEN = r"[\p{L}\p{N}_]+"


class HashedEmbedder:
    """``hash_fn``: ``xxhash64`` (default, fastest) or ``md5`` (first 8 hex
    digits; reproducible in other SQL engines)."""

    def __init__(self, dim: int = 64, name: str | None = None, hash_fn: str = "xxhash64"):
        if hash_fn not in ("xxhash64", "md5"):
            raise ValueError(f"unknown hash {hash_fn}")
        self.dim = int(dim)
        self.hash_fn = hash_fn
        self.name = name or (f"hashed-{self.dim}" if hash_fn == "xxhash64" else f"hashed-{hash_fn}-{self.dim}")

    @property
    def embedding_dim(self) -> int:  # V6 check reference
        return self.dim

    def transform(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        dim = self.dim
        tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(_TOKEN), F.lit(0))
        if self.hash_fn == "md5":
            h = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")
        else:
            h = F.xxhash64
        buckets = F.transform(tokens, lambda t: F.pmod(h(t), F.lit(dim)).cast("int"))
        return df.withColumn(out_col, unit_counts(buckets, dim))


def unit_counts(buckets, dim: int):
    """How often each of ``dim`` buckets stands in an array of bucket numbers, scaled to unit length."""
    shipped()

    def count(rows: pa.Array) -> pa.Array:
        lens = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        n = len(rows)
        at = np.repeat(np.arange(n, dtype=np.int64), lens) * dim + rows.flatten().to_numpy(zero_copy_only=False)
        return _vectors(unit_rows(np.bincount(at, minlength=n * dim).reshape(n, dim).astype(np.float64)))

    return F.arrow_udf(count, "array<float>")(buckets)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length, in single precision (V3)."""
    return (m / (np.sqrt((m * m).sum(axis=1)) + NORM_EPS)[:, None]).astype(np.float32)


def _vectors(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    n, dim = m.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m, np.float32).ravel()))


_MODELS: dict[str, Callable[[list[str]], Sequence[Sequence[float]]]] = {}
_TOKENS = re.compile(r"\w+")


def truncated(text: str | None, limit: int) -> tuple[str, int]:
    """The text up to the end of its ``limit``-th token, and how many tokens that is."""
    text = text or ""
    n, end = 0, len(text)
    for m in _TOKENS.finditer(text):
        n += 1
        if n == limit:
            end = m.end()
            break
    return text[:end], n


class BatchedEmbedder:
    """A model behind a loader.

    ``load`` is called once per worker process and returns a function from a list of texts to their vectors.
    ``max_tokens`` cuts every text, ``batch`` is how many texts the model gets at once, and texts are sorted by
    length within windows of ``window`` rows."""

    def __init__(self, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], dim: int, name: str, max_tokens: int = 512, batch: int = 8, window: int = 1024):
        if min(max_tokens, batch, window, dim) < 1:
            raise ValueError("dim, max_tokens, batch and window must be at least 1")
        self.load, self.dim, self.name = load, int(dim), name
        self.max_tokens, self.batch, self.window = max_tokens, batch, window

    @property
    def embedding_dim(self) -> int:
        return self.dim

    def transform(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        shipped()
        load, name, dim, limit, batch, window = self.load, self.name, self.dim, self.max_tokens, self.batch, self.window

        def embed(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
            if name not in _MODELS:
                _MODELS[name] = load()
            model = _MODELS[name]
            for texts in arrays:
                parts = [embed_window(model, texts[i : i + window].to_pylist(), dim, limit, batch) for i in range(0, len(texts), window)]
                yield _vectors(np.concatenate(parts) if parts else np.zeros((0, dim), np.float32))

        return df.withColumn(out_col, F.arrow_udf(embed, "array<float>")(F.col(text_col)))


def embed_window(model, texts: list[str | None], dim: int, limit: int, batch: int) -> np.ndarray:
    """Vectors of a window of texts: the model sees batches of texts of nearly one length."""
    cut = [truncated(t, limit) for t in texts]
    order = sorted(range(len(cut)), key=lambda i: cut[i][1])
    out = np.zeros((len(cut), dim), np.float32)
    for lo in range(0, len(order), batch):
        at = order[lo : lo + batch]
        made = np.asarray(model([cut[i][0] for i in at]), np.float32)
        if made.shape != (len(at), dim):
            raise ValueError(f"the model gave vectors of shape {made.shape} for {len(at)} texts of dimension {dim}")
        out[at] = made
    return out


class CallableEmbedder:
    """A user model.  ``fn`` maps a pandas Series of texts to one vector per text."""

    def __init__(self, fn: Callable[[pd.Series], Sequence[Sequence[float]]], dim: int, name: str):
        self.fn = fn
        self.dim = int(dim)
        self.name = name

    @property
    def embedding_dim(self) -> int:
        return self.dim

    def transform(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        from ..session import ship_package

        ship_package(df.sparkSession)
        fn = self.fn

        def embed(texts: pd.Series) -> pd.Series:
            if len(texts) == 0:
                return pd.Series([], dtype=object)
            vecs = fn(texts.fillna(""))
            return pd.Series(list(np.asarray(vecs, np.float32)))

        udf = F.pandas_udf(embed, "array<float>")
        return df.withColumn(out_col, udf(F.col(text_col)))

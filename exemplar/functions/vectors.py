"""Column expressions over ARRAY<FLOAT|DOUBLE> vectors (V3-V7).

All of these are built-in higher-order functions, so they stay inside the JVM
(interpreted, not generated code).  Arithmetic is done in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the epsilon added to vector norms before division (cosine).
NORM_EPS = 1e-8


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def bind(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and pass it to ``fn`` as a lambda variable.

    Inside higher-order function lambdas a captured expression is evaluated
    again for every element; binding it first keeps it to one evaluation."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


def scale_to_unit(v) -> Column:
    """v / (||v|| + eps) with the norm computed once."""
    vd = as_double(v)
    return bind(
        F.struct(vd.alias("d"), (norm(vd) + F.lit(NORM_EPS)).alias("n")),
        lambda x: F.transform(x["d"], lambda e: e / x["n"]),
    )


def unit_vector(v) -> Column:
    """v / (||v|| + eps); a zero vector stays zero."""
    return bind(as_double(v), scale_to_unit)


def cosine_similarity(a, b) -> Column:
    """V3: (a/(|a|+eps)) . (b/(|b|+eps))."""
    return dot(a, b) / ((norm(a) + F.lit(NORM_EPS)) * (norm(b) + F.lit(NORM_EPS)))


def euclidean_similarity(a, b) -> Column:
    """V4: minus the Euclidean distance."""
    sq = F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return -F.sqrt(sq)


def similarity(metric: str, a, b) -> Column:
    """V5: metric dispatch; unknown names raise like the original."""
    if metric == "cosine":
        return cosine_similarity(a, b)
    if metric == "euclidean":
        return euclidean_similarity(a, b)
    raise ValueError(f"Unknown similarity metric: {metric}")


def vector_status(v, dim: int | None = None) -> Column:
    """V6: 'ok', 'null', 'wrong_dim' or 'non_finite' for one vector column."""
    vc = _col(v)
    bad_value = F.exists(
        as_double(vc), lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    status = F.when(vc.isNull(), F.lit("null"))
    if dim is not None:
        status = status.when(F.size(vc) != F.lit(dim), F.lit("wrong_dim"))
    return status.when(bad_value, F.lit("non_finite")).otherwise(F.lit("ok"))


def blend(a, b, weight: float = 0.3) -> Column:
    """V7: (1-w)*a + w*b element-wise (dense vector blended with a second one)."""
    w = F.lit(float(weight))
    return F.zip_with(as_double(a), as_double(b), lambda x, y: (F.lit(1.0) - w) * x + w * y)


def mean_vectors(df, key: str, vector: str, out: str = "centroid"):
    """Mean vector of each key (a long or null): every task adds up whole vectors, one row per key and length, and the
    partial sums meet by key.  Null vectors and vectors with null components take no part; vectors of
    different lengths have means of their own."""
    import numpy as np
    import pyarrow as pa

    from .lexer import shipped

    shipped()
    schema = f"{key} long, sums array<double>, n long"

    def table(sums: dict) -> pa.RecordBatch:
        columns = [pa.array([k for k, _ in sums], pa.int64()), pa.array([s for s, _ in sums.values()], pa.list_(pa.float64())), pa.array([n for _, n in sums.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[key, "sums", "n"])

    def add(sums: dict, keys: list, vectors: pa.Array, counts: list | None = None) -> None:
        lens = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        for dim in np.unique(lens[lens >= 0]).tolist():
            rows = np.flatnonzero(lens == dim)
            flat = vectors.take(pa.array(rows)).flatten()
            m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
            whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), dim).any(axis=1) if flat.null_count else np.ones(len(rows), bool)
            mine = [keys[i] for i in rows[whole].tolist()]
            place = {k: i for i, k in enumerate(dict.fromkeys(mine))}
            at = np.array([place[k] for k in mine], np.int64)
            total, n = np.zeros((len(place), dim)), np.zeros(len(place), np.int64)
            np.add.at(total, at, m[whole])
            np.add.at(n, at, 1 if counts is None else np.array(counts, np.int64)[rows[whole]])
            for k, i in place.items():
                s, c = sums.get((k, dim), (0.0, 0))
                sums[k, dim] = (total[i] + s, int(n[i]) + c)

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            add(sums, batch.column(0).to_pylist(), batch.column(1))
        yield table(sums)

    def merge(rows: pa.Table) -> pa.Table:
        sums: dict = {}
        rows = rows.combine_chunks()
        for batch in rows.to_batches():
            add(sums, batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist())
        return pa.Table.from_batches([table(sums)])

    parts = df.select(F.col(key).cast("long").alias(key), as_double(F.col(vector)).alias(vector)).mapInArrow(partial, schema)
    whole = parts.groupBy(key, F.size("sums").alias("_dim")).applyInArrow(merge, schema)
    return whole.select(key, F.transform("sums", lambda x: x / F.col("n")).alias(out))

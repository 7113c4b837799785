"""Fixtures shared by the operator tests: small tables with every awkward case, and a DuckDB runner."""

from __future__ import annotations

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, token string"

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def thue_morse(k: int) -> list[str]:
    """Two words of 2^k letters whose polynomial hashes are equal modulo 2^64 (for k of 10 and more), whatever the multiplier."""
    bits = [bin(i).count("1") & 1 for i in range(1 << k)]
    return ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]


def docs(spark, texts: list, ids: list | None = None):
    """A documents table of these texts, with extra columns whose names the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, None, None if t is None else len(t), 0.5, "x", "y") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def oracle(sql: str, sf_dir: str = SF, **tables):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        if t in tables:
            con.register(t, tables[t])
        else:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def same(spark_df, expected) -> None:
    got = spark_df.toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    cols = sorted(expected.columns)
    a = got[cols].astype(object).where(got[cols].notna(), None).values.tolist()
    b = expected[cols].astype(object).where(expected[cols].notna(), None).values.tolist()
    plain = lambda rows: sorted([[x.item() if isinstance(x, np.generic) else x for x in r] for r in rows], key=repr)
    assert plain(a) == plain(b)

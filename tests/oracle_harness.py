"""Runs registered queries in Spark and their oracle SQL in DuckDB and
compares row count, column names and order-insensitive values."""

from __future__ import annotations

import math
import sys

import duckdb

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402
from exemplar.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, name: str, con=None) -> tuple[bool, str]:
    con = con or duck(sf_dir)
    df = E.queries()[name](spark, sf_dir)
    s_cols = sorted(df.columns)
    s_rows = sorted((tuple(_norm(r[c]) for c in s_cols) for r in df.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    o_cols_raw = rel.columns
    o_cols = sorted(o_cols_raw)
    idx = [o_cols_raw.index(c) for c in o_cols]
    o_rows = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    if s_cols != o_cols:
        return False, f"columns differ: spark={s_cols} oracle={o_cols}"
    if len(s_rows) != len(o_rows):
        return False, f"row count spark={len(s_rows)} oracle={len(o_rows)}"
    if s_rows != o_rows:
        bad = [(a, b) for a, b in zip(s_rows, o_rows) if a != b][:3]
        return False, f"values differ, e.g. {bad}"
    return True, f"{len(s_rows)} rows"


if __name__ == "__main__":
    from exemplar.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:] or sorted(E.oracle_sql())
    spark = local_session(8)
    con = duck(sf)
    ok_all = True
    for n in names:
        try:
            ok, msg = compare(spark, sf, n, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:300]}"
        ok_all &= ok
        print(f"{'OK  ' if ok else 'FAIL'} {n}: {msg}", flush=True)
    print("ALL OK" if ok_all else "SOME FAILED")

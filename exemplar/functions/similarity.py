"""Method-name similarity (C4): lower-cased Ratcliff-Obershelp ratio.

Spark has no built-in equivalent (``levenshtein`` is a different measure), so
this is an Arrow-batched pandas UDF around the standard library's difflib.  It
is only ever applied to the reranking pool (queries x pool size rows), never to
the corpus.  The ratio is not symmetric: the first argument is the query name.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    return _ratio(a.lower(), b.lower())


@lru_cache(maxsize=1 << 16)
def _ratio(a: str, b: str) -> float:
    # method names repeat across (query, candidate) pairs: memoised per worker
    return SequenceMatcher(None, a, b).ratio()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def name_similarity(query_name, candidate_name) -> Column:
    from pyspark.sql import SparkSession

    from ..session import ship_package

    ship_package(SparkSession.getActiveSession())
    q = F.col(query_name) if isinstance(query_name, str) else query_name
    c = F.col(candidate_name) if isinstance(candidate_name, str) else candidate_name
    return F.pandas_udf(_ratios, "double")(q, c)

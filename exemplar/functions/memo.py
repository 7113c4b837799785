"""Reuse of large Column expressions.

Building a big expression tree from Python costs one py4j round trip per
node (seconds for the code-feature and line-fold expressions).  Unresolved
Column trees do not depend on a DataFrame, so a builder called again with the
same arguments (compared by their expression text) returns the tree it built
before, within the same Spark application.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, SparkSession


def _key(x):
    if isinstance(x, Column):
        return ("col", str(x))
    if isinstance(x, (list, tuple)):
        return tuple(_key(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _key(v)) for k, v in x.items()))
    return x


def cached_column(fn):
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        spark = SparkSession.getActiveSession()
        app = spark.sparkContext.applicationId if spark is not None else None
        try:
            key = (app, _key(args), _key(kwargs))
            hash(key)
        except TypeError:
            return fn(*args, **kwargs)
        hit = cache.get(key)
        if hit is None:
            hit = fn(*args, **kwargs)
            if len(cache) > 512:
                cache.clear()
            cache[key] = hit
        return hit

    return wrapper

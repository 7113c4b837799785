"""Code features for reranking.

The first function of a text, breadth-first over the nesting tree of ``syntax``, gives
language, name and parameter count.  They come from one Arrow function per text (lexer,
brackets and headers in one pass), computed once per corpus row at index build rather than
once per (query, candidate) pair; the keyword fallback and the similarity are built-in
Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .memo import cached_column
from .syntax import first_features


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _by_keywords(c: Column) -> Column:
    """C1's fallback for texts without a function; null if no keyword fits."""
    has = lambda s: F.instr(c, s) > 0
    return (
        F.when(has("fn ") | has("impl ") | has("pub fn"), F.lit("rust"))
        .when(has("func ") | has("package "), F.lit("go"))
        .when(has("function ") & has("end"), F.lit("julia"))
        .when((has("public ") | has("private ")) & (has("class ") | has("void ") | has("int ")), F.lit("java"))
    )


@cached_column
def detect_language(code) -> Column:
    """The first of Rust, Go, Julia and Java in which the text holds a function, then the keyword fallback; null if none."""
    c = _col(code)
    return F.coalesce(first_features(c)["lang"], _by_keywords(c))


@cached_column
def method_name(code, lang: Column | None = None) -> Column:
    """Name of the first function, breadth-first; '' when there is none."""
    return F.coalesce(first_features(_col(code), lang)["name"], F.lit(""))


@cached_column
def param_count(code, lang: Column | None = None, go_receiver_compat: bool = False) -> Column:
    """Parameter count of the first function (INT), null when there is none.

    ``go_receiver_compat`` reproduces the original's Go quirk: for a method,
    the first parameter list is the receiver, so the receiver's declarations
    are counted instead of the parameters."""
    return _count(first_features(_col(code), lang), go_receiver_compat)


def _count(found: Column, go_receiver_compat: bool) -> Column:
    return F.coalesce(found["receiver"], found["params"]) if go_receiver_compat else found["params"]


def param_similarity(a, b) -> Column:
    """1.0 when equal, else max(0, 1 - 0.2*|a-b|); 0 when either is missing."""
    a, b = _col(a), _col(b)
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(
        F.when(a == b, F.lit(1.0)).otherwise(
            F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(a - b).cast("double") * F.lit(0.2))
        )
    )


def with_code_features(df, code: str, prefix: str = "", go_receiver_compat: bool = False):
    """Adds ``{prefix}lang``, ``{prefix}method_name``, ``{prefix}param_count``; each text is read once."""
    held = f"_{prefix}features"
    d = df.withColumn(held, first_features(F.col(f"`{code}`")))
    found = F.col(held)
    return (
        d.withColumn(f"{prefix}lang", F.coalesce(found["lang"], _by_keywords(F.col(f"`{code}`"))))
        .withColumn(f"{prefix}method_name", F.coalesce(found["name"], F.lit("")))
        .withColumn(f"{prefix}param_count", _count(found, go_receiver_compat))
        .drop(held)
    )


def code_features(code) -> list[Column]:
    """[lang, method_name, param_count] columns for one code column."""
    found = first_features(_col(code))
    return [
        F.coalesce(found["lang"], _by_keywords(_col(code))).alias("lang"),
        F.coalesce(found["name"], F.lit("")).alias("method_name"),
        found["params"].alias("param_count"),
    ]

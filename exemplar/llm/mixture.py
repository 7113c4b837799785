"""Mixing sources to target weights by capped water-filling, and a seeded sample that meets the targets.

Targets: the sources share ``share`` times all sizes by weight; a source whose part is more
than ``epochs`` times its size is clamped there, and what it leaves is shared by weight
among the others, until no part is above.  Each round is one aggregate over the table of
sources; clamped sources stay clamped, so the rounds end (in general after a few: a round
is a Newton step on a concave function).

Sample: a source with target t and size s takes t div s whole repetitions and a fraction f of one
more.  Its documents are dealt to ``DIGITS`` places by a hash of seed, id and text and
to classes by the binary length of their size.  From the class of the longest documents
down, the places below a cut are taken once more, the cut being where the words taken so far come
nearest to f of all words so far: every class gives about its share, and shorter documents make up
for what longer ones missed.  What remains is at most half the mass of one place: one short
document, or about 1/4096 of a class with many.  The histogram (source, class, place) is
pre-aggregated and a source has at most 64 * 4096 rows of it, however many documents it has.

Defined results: a null text has size 0; null is a source like others; a null, negative or NaN weight is 0;
sources of weight or size 0 get target 0; documents of size 0 take 0 words; a null id is hashed like the
empty string, and rows of equal id and text are taken equally often; if all sizes or weights are
0 all targets are; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .workers import ready

#: Places of a class: three hexadecimal digits of the hash.
HEX_DIGITS = 3
DIGITS = 16**HEX_DIGITS

_BLANKS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text, counted on a string of one letter per word (no list of words is built)."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_BLANKS}+", "")
    return F.length(F.regexp_replace(body, f"{_WORD}{_BLANKS}*", "w")).cast("long")


def place(seed: int, key: Column, text: Column) -> Column:
    """The place of a row in its class, from a hash of seed, id and text."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, HEX_DIGITS), 16, 10).cast("int")


def measured(docs: DataFrame, seed: int = 1, key: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: its kept columns as one struct, source, size, class and place."""
    t = F.col(f"`{text}`")
    rows = docs.select(
        F.struct(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in keep if c != key]).alias("row"),
        F.col(f"`{source}`").alias("source"),
        n_words(t).alias("size"),
        place(seed, F.col(f"`{key}`"), t).alias("place"),
    )
    return rows.withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0).cast("int"))


def cycled_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights repeated over the sources by code point, null last.

    The sources are range-partitioned and numbered within partitions; one count per
    partition gives what lies before, so no task sees all sources."""
    from ..operators.layout import ordinal

    names = sources.select("source", F.col("source").isNull().alias("last")).distinct()
    numbered = ordinal(names, ["last", "source"], name="number")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return numbered.select("source", F.get(cycle, (F.col("number") % len(weights)).cast("int")).alias("weight"))


def targets(sizes: DataFrame, share: float, epochs: float) -> DataFrame:
    """source, source_size, target of (source, source_size, weight) by capped water-filling."""
    weight = F.col("weight").cast("double")
    sizes = sizes.select("source", "source_size", F.when((weight > 0) & ~F.isnan(weight), weight).otherwise(0.0).alias("weight"))
    cap = F.col("source_size") * F.lit(float(epochs))
    total = sizes.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    goal, rest, weights = share * (total.size or 0), share * (total.size or 0), total.weight or 0.0
    clamped = 0
    while weights > 0:
        over = cap <= F.col("weight") * F.lit(float(rest)) / F.lit(float(weights))
        now = sizes.agg(
            F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if now.n == clamped:
            break
        clamped, rest, weights = now.n, goal - now.taken, now.weight
    if weights > 0:
        part = F.col("weight") * F.lit(float(rest)) / F.lit(float(weights))
        target = F.least(part, cap)
    elif clamped:
        target = F.when(F.col("weight") > 0, cap).otherwise(0.0)
    else:
        target = F.lit(0.0)
    return sizes.select("source", "source_size", target.cast("double").alias("target"))


_CUTS = "source string, class int, whole long, cut int"


def cuts(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source and class: whole repetitions, and the place below which a row is taken once more.

    ``histogram`` has source, class, place and the words there; ``goals`` what ``targets`` gives."""
    joined = histogram.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return joined.groupBy("source").applyInArrow(_cut_source, _CUTS)


def _cut_source(table: pa.Table) -> pa.Table:
    cls, at, mass = (table[c].to_numpy() for c in ("class", "place", "words"))
    size, target = table["source_size"][0].as_py(), table["target"][0].as_py()
    whole = math.floor(target / size) if size else 0
    fraction = (target - whole * size) / size if size else 0.0
    seen = taken = 0
    classes, ends = np.unique(cls)[::-1], []
    for c in classes:
        here = cls == c
        order = np.argsort(at[here])
        places, words = at[here][order], mass[here][order]
        seen += int(words.sum())
        sums = np.concatenate([[0], np.cumsum(words)])
        best = int(np.argmin(np.abs(fraction * seen - (taken + sums))))  # of equal ones the first
        taken += int(sums[best])
        ends.append(0 if best == 0 else int(places[best - 1]) + 1)
    n = len(classes)
    return pa.table({
        "source": pa.array([table["source"][0].as_py()] * n, pa.string()),
        "class": pa.array(classes, pa.int32()),
        "whole": pa.array([whole] * n, pa.int64()),
        "cut": pa.array(ends, pa.int32()),
    })


def plan(rows: DataFrame, weights: DataFrame | tuple[float, ...], share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """``rows`` of ``measured`` with source_size, target and repeats (how often the mix takes the row).

    ``weights``: a table (source, weight; a source it lacks weighs 0), or numbers repeated over the sources by code point.
    ``rows`` is read three times: write it first if it comes from texts."""
    ready(rows.sparkSession)
    histogram = written(rows.groupBy("source", "class", "place").agg(F.sum("size").alias("words")), "mix-histogram")
    sizes = histogram.groupBy("source").agg(F.sum("words").alias("source_size"))
    if not isinstance(weights, DataFrame):
        weights = cycled_weights(sizes, weights)
    weights = weights.groupBy(F.col("source").alias("of")).agg(F.max("weight").alias("weight"))
    sizes = written(sizes.join(weights, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mix-sources")
    goals = written(targets(sizes, share, epochs), "mix-targets")
    found = written(cuts(histogram, goals), "mix-cuts")
    by_class = found.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    by_class = written(by_class.withColumnsRenamed({"source": "of", "class": "of_class"}), "mix-plan")
    out = rows.join(by_class, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class")))
    repeats = F.col("whole") + (F.col("place") < F.col("cut")).cast("long")
    return out.select("row", "source", "size", "source_size", "target", repeats.alias("repeats"))


def mix(docs: DataFrame, weights: DataFrame | tuple[float, ...], share: float = 1.5, epochs: float = 2.0, seed: int = 1, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the plan takes it."""
    planned = plan(measured(docs, seed, source=source, key=key, keep=tuple(docs.columns)), weights, share, epochs)
    copies = planned.where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("copy"))
    return copies.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Per document: size, its source's size and target, and the words the mix takes of it."""
    rows = written(measured(docs), "mix-rows")
    p = plan(rows, weights)
    return p.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))

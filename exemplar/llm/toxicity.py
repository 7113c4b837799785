"""Toxic passages by maximum-scoring segments.

Learning (``fit``): a word stands for up to three tokens, itself and its 4- and 5-byte
beginnings.  Over labelled texts (one per exact copy), each token's log-odds between
toxic and other texts is shrunk by an informative Dirichlet prior: so many texts (one of ``PRIORS``) of the
classes' overall shares, so a token of few texts says little and no token is left out.
At most ``sample`` labelled rows (by a hash of doc_id) are used; the lexicon is every
token of theirs.

Scoring (``score``): each word scores the mean log-odds of its known tokens, negative ones
too (0 if none is known), less a shift of one of ``SHIFTS`` standard deviations above the mean of
the words of clean training texts, so the mean under clean text is below 0.  One linear
scan (Ruzzo-Tompa) yields every maximal scoring segment of the whole text.  Under
clean text the number of segments of score s in n words is n K exp(-lambda s); K and
lambda come from the clean training texts, and a segment is a passage if that E-value
is at most ``SIGNIFICANT``.  A text's evidence, the sum of -log p of its segments, with
their scores and the length, goes through a logistic calibration to a score of 0 to 1.
Whatever is learnt from the training texts' scores counts each without itself; prior and shift
are those of the least log-loss of these scores, so no text outside the training rows has a say.

Defined results: null and empty texts get the score of a text without evidence; without
labels of both classes the score is the share of label 1 (0 if none); labels that are null
count as missing, several labels of one doc_id as their largest; repeated rows are scored
each; other columns of the inputs are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import bytewords as bw
from .workers import ready

SAMPLE_ROWS = 20_000
#: What ``fit`` chooses among, by the log-loss of the training texts, each scored without itself.
PRIORS = (5.0, 20.0, 80.0)
SHIFTS = (2.0, 3.0, 4.0)
SIGNIFICANT = 0.05
THRESHOLD = 0.3
_BEGINNINGS = (4, 5)


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes
    odds: np.ndarray
    shift: float
    decay: float  # lambda
    rate: float  # K
    weights: np.ndarray  # logistic: intercept, evidence, sum of segment scores, log of length
    mean: np.ndarray
    scale: np.ndarray
    base: float


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes (words, 1 + beginnings), words' text numbers, words per text); 0 where a word has no such beginning."""
    s, e, doc = bw.words(data, offsets, bw.ALNUM)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    if len(s) == 0:
        return np.zeros((0, 1 + len(_BEGINNINGS)), np.uint64), doc, count
    sums = bw.prefix_sums(bw.BYTE_CODES[bw.LOWER[data]])
    cols = [bw.span_hashes(sums, s, e)]
    for n in _BEGINNINGS:
        h = bw.span_hashes(sums, s, np.minimum(s + n, e)) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1))
        cols.append(np.where(e - s > n, h, np.uint64(0)))
    return np.stack(cols, axis=1), doc, count


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for first, data, offsets in bw.slices(b.column("text")):
            h, doc, _ = _tokens(data, offsets)
            k = h.shape[1]
            flat, owner = h.ravel(), np.repeat(doc, k)
            flat, owner = flat[flat != 0], owner[flat != 0]
            order = np.lexsort((owner, flat))
            flat, owner = flat[order], owner[order]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])  # texts, not occurrences
            flat, owner = flat[new], owner[new]
            if len(flat) == 0:
                continue
            starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            label = toxic[first + owner]
            n1 = np.add.reduceat(label, starts)
            n0 = np.diff(np.append(starts, len(flat))) - n1
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[starts].view(np.int64)), pa.array(n0, pa.int64()), pa.array(n1, pa.int64())],
                names=["token", "n0", "n1"],
            )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    """``labels`` has doc_id and toxic; the caller has taken out rows that must not be learnt from."""
    spark = docs.sparkSession
    ready(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded: at most ``sample`` rows of two integers
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    train = written(rows.select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).dropDuplicates(), "toxic-train")
    total = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    base = n1 / max(1, n0 + n1)
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 1.0, 1.0, np.zeros(4), np.zeros(3), np.ones(3), base)
    if not n0 or not n1:
        return flat
    # every token of the bounded sample: 24 bytes each
    counts = train.mapInArrow(_count_tokens, "token long, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = counts.toArrow()
    tokens, k0, k1 = (got.column(c).to_numpy() for c in ("token", "n0", "n1"))
    tokens = tokens.view(np.uint64)
    order = np.argsort(tokens)
    flat.tokens, k0, k1 = tokens[order], k0[order], k1[order]
    # a token of one text is unknown to that text and seen by no other, so only the others go to the training passes
    several = k0 + k1 > 1
    best, least = flat, math.inf
    for prior in PRIORS:
        # what a text of class 0 or 1 sees without itself
        others = [_log_odds(k0[several] - (c == 0), k1[several] - (c == 1), base, prior) for c in (0, 1)]
        shared = spark.sparkContext.broadcast((flat.tokens[several], others))
        words = train.where("toxic = 0").mapInArrow(_word_sums(shared), "n long, s double, q double")
        n, s, q = words.agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
        spread = math.sqrt(max(0.0, q / n - (s / n) ** 2)) if n else 0.0
        shifts = [max((s / n if n else 0.0) + shift * spread, 1e-3) for shift in SHIFTS]
        # calibration, on the same bounded sample: at most ``sample`` rows of a few numbers
        rows = train.mapInArrow(_training_segments(shared, shifts), "toxic int, n long, segments array<array<double>>").collect()
        shared.destroy()
        for i, shift in enumerate(shifts):
            model = replace(flat, odds=_log_odds(k0, k1, base, prior), shift=shift)
            model, loss = _calibrate(model, [(r.toxic, r.n, r.segments[i]) for r in rows])
            if loss < least - 1e-9:
                best, least = model, loss
    return best


def _log_odds(n0: np.ndarray, n1: np.ndarray, base: float, prior: float) -> np.ndarray:
    """Shrunk log-odds of texts with a token being toxic, against those of all texts."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log((n1 + prior * base) / (n0 + prior * (1 - base))) - math.log(base / (1 - base))


def _calibrate(model: Model, rows: list) -> tuple[Model, float]:
    """The model with its segments' distribution and logistic weights, and its mean log-loss."""
    clean = [(n, segs) for toxic, n, segs in rows if not toxic]
    words = max(1, sum(n for n, _ in clean))
    seen = np.array([s for _, seg in clean for s in seg] or [model.shift], float)
    low = float(np.min(seen))
    model.decay = 1.0 / max(0.05, float(np.mean(seen)) - low)
    model.rate = max(1, len(seen)) / words * math.exp(model.decay * low)
    x = np.array([_features(model, n, np.array(segs, float)) for _, n, segs in rows])
    y = np.array([toxic for toxic, _, _ in rows], float)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    d = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    w = np.zeros(d.shape[1])
    w[0] = math.log(max(model.base, 1e-6) / max(1 - model.base, 1e-6))
    ridge = np.diag([1e-6, 1.0, 1.0, 1.0])
    for _ in range(50):  # Newton with a small ridge
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge, d.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return model, float(-np.mean(y * np.log(p) + (1 - y) * np.log1p(-p)))


def segments(value: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, end word) of one text: Ruzzo-Tompa over its runs of positive words.

    Linear in the words."""
    up = np.concatenate(([False], value > 0, [False]))
    rise, fall = np.flatnonzero(up[1:] & ~up[:-1]), np.flatnonzero(up[:-1] & ~up[1:])
    sums = np.concatenate(([0.0], np.cumsum(value)))
    return [(s, int(rise[f]), int(fall[e])) for s, f, e in _maximal(sums[rise].tolist(), sums[fall].tolist())]


def _maximal(before: list[float], after: list[float]) -> list[tuple[float, int, int]]:
    """Maximal scoring segments (score, first, last) of rises in a running sum, from its values before and after each."""
    stack: list[tuple] = []  # (sum before, sum after, first, last, index of the closest smaller start below)
    for i in range(len(before)):
        item = (before[i], after[i], i, i)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= item[0]:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= item[1]:
                stack.append((*item, j))
                break
            item = (stack[j][0], item[1], stack[j][2], item[3])
            del stack[j:]
    return [(s[1] - s[0], s[2], s[3]) for s in stack]


def _e_values(model: Model, n: int, s: np.ndarray) -> np.ndarray:
    return max(1, n) * model.rate * np.exp(-model.decay * s)


def _features(model: Model, n: int, s: np.ndarray) -> list[float]:
    """Evidence (sum of -log p), sum of segment scores and log of length."""
    if not len(s):
        return [0.0, 0.0, math.log1p(n)]
    p = -np.expm1(-_e_values(model, n, s))
    return [float(-np.log(np.maximum(p, 1e-300)).sum()), float(s.sum()), math.log1p(n)]


def _word_odds(tokens: np.ndarray, odds: list[np.ndarray], h: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """Mean log-odds of each word's known tokens, 0 if none is known; ``which`` of ``odds`` holds for each word."""
    _, at, word = np.unique(h[:, 0], return_index=True, return_inverse=True)  # a word's hash stands for all its tokens
    few = h[at]
    place = np.minimum(np.searchsorted(tokens, few), len(tokens) - 1)
    known = (tokens[place] == few) & (few != 0)
    out = [(np.where(known, o[place], 0.0).sum(axis=1) / np.maximum(1, known.sum(axis=1)))[word] for o in odds]
    return out[0] if which is None else np.where(which > 0, out[1], out[0])


def _word_sums(shared):
    """Number, sum and sum of squares of the words' log-odds in texts of class 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, others = shared.value
        for b in batches:
            for _, data, offsets in bw.slices(b.column("text")):
                h, _, _ = _tokens(data, offsets)
                if len(h):
                    v = _word_odds(tokens, others[:1], h) if len(tokens) else np.zeros(len(h))
                    yield pa.RecordBatch.from_arrays([pa.array([len(v)]), pa.array([float(v.sum())]), pa.array([float((v * v).sum())])], names=["n", "s", "q"])

    return run


def _training_segments(shared, shifts: list[float]):
    """Training texts' class, words and, for each shift, the scores of their segments; each text scored without itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, others = shared.value
        for b in batches:
            n_words = np.zeros(b.num_rows, np.int64)
            found: list[list[list[float]]] = [[[] for _ in shifts] for _ in range(b.num_rows)]
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            for first, data, offsets in bw.slices(b.column("text")):
                h, doc, count = _tokens(data, offsets)
                n_words[first : first + len(count)] = count
                if not len(tokens) or not len(h):
                    continue
                odds = _word_odds(tokens, others, h, toxic[first + doc])
                start = np.concatenate(([0], np.cumsum(count)))
                for k, shift in enumerate(shifts):
                    value = odds - shift
                    for o in np.unique(doc[value > 0]):
                        found[first + o][k] = [s for s, _, _ in segments(value[start[o] : start[o + 1]])]
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array(n_words), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["toxic", "n", "segments"]
            )

    return run


def _scorer(model: Model, carry: tuple[str, ...] = (), below: float | None = None):
    """Rows scored; ``below``: the batches' own rows with a lower score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = _features(model, 0, np.zeros(0))
        for b in batches:
            n_rows = b.num_rows
            n_words = np.zeros(n_rows, np.int64)
            found: list[list[tuple[float, int, int]]] = [[] for _ in range(n_rows)]
            for first, data, offsets in bw.slices(b.column("text")):
                h, doc, count = _tokens(data, offsets)
                n_words[first : first + len(count)] = count
                if not len(model.tokens) or not len(h):
                    continue
                value = _word_odds(model.tokens, [model.odds], h) - model.shift
                start = np.concatenate(([0], np.cumsum(count)))
                for o in np.unique(doc[value > 0]):
                    found[first + o] = segments(value[start[o] : start[o + 1]])
            x = np.tile(np.array(blank), (n_rows, 1))
            x[:, 2] = np.log1p(n_words)
            passages = []
            for i, f in enumerate(found):
                if f:
                    s = np.array([v for v, _, _ in f])
                    x[i] = _features(model, int(n_words[i]), s)
                    e = _e_values(model, int(n_words[i]), s)
                    f = [{"first_word": a, "end_word": z, "score": v, "e_value": float(ev)} for (v, a, z), ev in zip(f, e) if ev <= SIGNIFICANT]
                passages.append(f)
            if len(model.tokens):
                t = model.weights[0] + ((x - model.mean) / model.scale * model.weights[1:]).sum(axis=1)  # equal rows, equal scores
                p = 1 / (1 + np.exp(-np.clip(t, -30, 30)))
            else:
                p = np.full(n_rows, model.base)
            if below is not None:
                yield b.filter(pa.array(p < below))
                continue
            cols = [b.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(p), pa.array(passages, _PASSAGES)], names=[*carry, "score", "passages"]
            )

    return run


_PASSAGES = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, score and passages (first_word, end_word exclusive, score, e_value)."""
    ready(docs.sparkSession)
    names = list(dict.fromkeys([*carry, "text"]))
    kept = docs.select(*names)
    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in carry]
    schema = ", ".join([*fields, "score double", "passages array<struct<first_word:bigint,end_word:bigint,score:double,e_value:double>>"])
    return kept.mapInArrow(_scorer(model, carry=carry), schema)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    ready(docs.sparkSession)
    return docs.mapInArrow(_scorer(model, below=threshold), docs.schema)

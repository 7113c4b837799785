"""Byte-level BPE with a lexicon automaton.

``build_lexicon`` counts the pre-tokens of all documents (a slice of about 1 MB reports
each of its words once, with its count), takes the most frequent ones, up to ``LEXICON`` (whole
steps of a histogram of counts, so words equally frequent are in or out together), and compiles them into a minimal acyclic transducer: states with equal futures are
shared, and each arc outputs how many words pass before it, so the outputs along a
word add up to its number, under which its ids are stored.  The automaton is written to
one file, which ``addFile`` takes to every executor; tasks memory-map it.

``encode`` walks all pre-tokens of a slice through the automaton at once, one byte per
step.  Words it does not hold are merged exactly, all distinct ones of the slice at once:
each round applies every word's merge of lowest rank.  The lexicon only decides which way
a word goes, never its ids; words are told apart by their bytes.  ``decode`` joins token bytes; bytes that are no UTF-8 become
U+FFFD, as the tokenizers library has it.

Defined results: null text counts as empty (no ids; decoded empty); a text's special
strings get their ids, as the library does by default; repeated rows are encoded each;
an empty table gives an empty result; other columns are ignored unless carried.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import bytebpe as bb
from . import bytewords as bw
from .workers import ready

LEXICON = 65_536


class Merger:
    """Exact BPE of many words at once."""

    def __init__(self, vocab: bb.Vocabulary) -> None:
        self.vocab = vocab
        self.base = len(vocab.tokens)
        key = vocab.pair_left * self.base + vocab.pair_right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.none = len(key)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other; ids per word).  Words are not empty."""
        size = (end - start).astype(np.int64)
        n = len(size)
        symbols = self.vocab.byte_id[bb.gather(data, start, size)]
        word = np.repeat(np.arange(n), size)
        done_ids, done_word = [], []
        while len(symbols):
            rank = np.full(len(symbols), self.none)
            rank[:-1] = self._rank(symbols[:-1], symbols[1:])
            rank[:-1][word[:-1] != word[1:]] = self.none
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(symbols)))
            of_word = np.repeat(least, count)
            over = of_word == self.none
            if over.any():
                done_ids.append(symbols[over])
                done_word.append(word[over])
                keep = ~over
                symbols, word, rank, of_word = symbols[keep], word[keep], rank[keep], of_word[keep]
                if not len(symbols):
                    break
            hit = rank == of_word
            # of overlapping places (a a a) every second one, from the left
            at = np.flatnonzero(hit)
            head = np.concatenate(([True], np.diff(at) != 1))
            run_start = at[head][np.cumsum(head) - 1]
            at = at[(at - run_start) % 2 == 0]
            symbols[at] = self.vocab.pair_result[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=n)


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """(arcs, is final) of each state and the first state: the minimal acyclic automaton of sorted distinct words."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[int] = [0]
    free: list[int] = []
    before = b""

    def settle(depth: int) -> None:
        """Replace the states below ``depth`` on the path by equal ones already known."""
        while len(path) - 1 > depth:
            state = path.pop()
            key = (final[state], tuple(sorted(arcs[state].items())))
            known = register.setdefault(key, state)
            if known != state:
                arcs[path[-1]][before[len(path) - 1]] = known
                arcs[state], final[state] = {}, False
                free.append(state)

    for w in words:
        common = len(os.path.commonprefix([before, w]))
        settle(common)
        before = w
        for b in w[common:]:
            if free:
                state = free.pop()
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1]][b] = state
            path.append(state)
        final[path[-1]] = True
    settle(0)
    return arcs, final, 0


class Lexicon:
    """The automaton as arrays: arcs in an open-addressing table keyed by (state, byte)."""

    FIELDS = ("keys", "target", "output", "final", "id_start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.__dict__.update(arrays)
        self.mask = np.uint64(len(self.keys) - 1)

    @classmethod
    def compile(cls, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> Lexicon:
        """``words`` sorted and distinct; ``ids`` of all words one after the other, ``sizes`` per word."""
        arcs, final, _ = minimal_automaton(words)
        reach: list[int] = [-1] * len(arcs)  # words that can follow from a state
        stack = [0]
        while stack:
            s = stack[-1]
            todo = [t for t in arcs[s].values() if reach[t] < 0]
            if todo:
                stack += todo
                continue
            reach[s] = int(final[s]) + sum(reach[t] for t in arcs[s].values())
            stack.pop()
        used = [s for s in range(len(arcs)) if reach[s] >= 0]
        key, target, output = [], [], []
        for s in used:
            out = int(final[s])
            for b, t in sorted(arcs[s].items()):
                key.append(s * 256 + b)
                target.append(t)
                output.append(out)
                out += reach[t]
        size = 1 << max(4, (4 * len(key)).bit_length())
        keys = np.full(size, -1, np.int64)
        places = np.zeros(size, np.int64)
        slot = (bw.mix(np.array(key, np.int64).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)
        for i, p in enumerate(slot.tolist()):
            while keys[p] >= 0:
                p = (p + 1) & (size - 1)
            keys[p] = key[i]
            places[p] = i
        pick = lambda a: np.where(keys >= 0, np.array(a or [0], np.int32)[np.minimum(places, max(0, len(a) - 1))], 0).astype(np.int32)
        return cls(
            {
                "keys": keys,
                "target": pick(target),
                "output": pick(output),
                "final": np.array(final, np.int8),
                "id_start": np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
                "ids": np.append(ids, 0).astype(np.int32),
            }
        )

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            head = {n: (getattr(self, n).dtype.str, len(getattr(self, n))) for n in self.FIELDS}
            line = json.dumps(head).encode()
            f.write(line + b" " * (-(len(line) + 1) % 64) + b"\n")
            for n in self.FIELDS:
                raw = getattr(self, n).tobytes()
                f.write(raw + b"\0" * (-len(raw) % 64))

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            line = f.readline()
        at, arrays = len(line), {}
        for n, (kind, count) in json.loads(line).items():
            arrays[n] = np.memmap(path, dtype=kind, mode="r", offset=at, shape=(count,)) if count else np.zeros(0, kind)
            size = count * np.dtype(kind).itemsize
            at += size + -size % 64
        return cls(arrays)

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if the automaton does not hold it."""
        out = np.full(len(start), -1, np.int64)
        alive = np.arange(len(start))
        state = np.zeros(len(start), np.int64)
        total = np.zeros(len(start), np.int64)
        at = start.astype(np.int64)
        stop = end.astype(np.int64)
        while len(alive):
            key = state * 256 + data[at]
            slot = (bw.mix(key.view(np.uint64)) & self.mask).astype(np.int64)
            seen = self.keys[slot]
            other = np.flatnonzero((seen != key) & (seen >= 0))
            while len(other):
                slot[other] = (slot[other] + 1) & int(self.mask)
                seen[other] = self.keys[slot[other]]
                other = other[(seen[other] != key[other]) & (seen[other] >= 0)]
            on = seen == key
            slot, alive, at, stop = slot[on], alive[on], at[on] + 1, stop[on]
            state = self.target[slot].astype(np.int64)
            total = total[on] + self.output[slot]
            over = at == stop
            if over.any():
                good = over & (self.final[state] > 0)
                out[alive[good]] = total[good]
                more = ~over
                alive, at, stop, state, total = alive[more], at[more], stop[more], state[more], total[more]
        return out


def _count_words(batches: Iterator[pa.RecordBatch], vocab: bb.Vocabulary) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, data, offsets in bw.slices(b.column("text")):
            data, pieces, _, _ = bb.split_specials(data, offsets, vocab.special)
            s, e = bb.pretokens(data, pieces)
            if not len(s):
                continue
            found = bw.spans_array(data, s, e).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"])


def _step(n: Column) -> Column:
    """Steps of a histogram of counts: one for each count below 1024, then 64 to each doubling."""
    return F.when(n < 1024, n).otherwise((F.log2(n) * 64).cast("long") + (1024 - 640))


def build_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON) -> str:
    """Compiles the most frequent words of ``docs.text``; the name of the file that every executor gets."""
    spark = docs.sparkSession
    ready(spark)
    vocab = bb.load_vocabulary(tokenizer)
    shared = spark.sparkContext.broadcast(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_words(batches, _vocabulary(shared.value))

    words = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words.withColumn("step", _step(F.col("n"))), "bpe-words")
    # the words above a step of the histogram of counts: only these go to the driver
    steps = words.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    held, least = 0, None
    for r in steps:
        if held + r.words > size:
            break
        held, least = held + r.words, r.step
    kept = [] if least is None else words.where(F.col("step") >= least).select("word").toArrow()["word"].to_pylist()
    top = sorted(kept)  # at most ``size``
    data = np.frombuffer(b"".join(top), np.uint8)
    ends = np.cumsum([len(w) for w in top], dtype=np.int64)
    starts = ends - np.array([len(w) for w in top], dtype=np.int64)
    ids, sizes = Merger(vocab).encode(data, starts, ends)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="exemplar-lexicon-")), name)
    Lexicon.compile(top, ids, sizes).save(path)
    spark.sparkContext.addFile(path)
    return name


@lru_cache(maxsize=2)
def _vocabulary(content: str) -> bb.Vocabulary:
    return bb.load_vocabulary(content)


@lru_cache(maxsize=2)
def _merger(content: str) -> Merger:
    return Merger(_vocabulary(content))


def encode_slice(data: np.ndarray, offsets: np.ndarray, merger: Merger, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets per text)."""
    n_texts = len(offsets) - 1
    data, pieces, owner, after = bb.split_specials(data, offsets, merger.vocab.special)
    s, e = bb.pretokens(data, pieces)
    number = lexicon.numbers(data, s, e)
    known = number >= 0
    start, size = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    start[known] = lexicon.id_start[number[known]]
    size[known] = lexicon.id_start[number[known] + 1] - start[known]
    values = lexicon.ids
    new = np.flatnonzero(~known)
    if len(new):
        which = bw.spans_array(data, s[new], e[new]).dictionary_encode().indices.to_numpy()
        _, first = np.unique(which, return_index=True)
        ids, sizes = merger.encode(data, s[new[first]], e[new[first]])
        begin = len(values) + np.cumsum(sizes) - sizes
        start[new], size[new] = begin[which], sizes[which]
        values = np.concatenate([values, ids.astype(np.int32)])
    piece = np.searchsorted(pieces, s, side="right") - 1
    return bb.by_text(bb.gather(values, start, size), size, piece, owner, after, n_texts)


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``ids``: little-endian unsigned 32-bit integers.

    ``tokenizer`` is the content of a byte-level BPE file of the tokenizers library;
    ``lexicon`` names a file of ``build_lexicon`` (built from ``docs`` if not given).
    """
    spark = docs.sparkSession
    ready(spark)
    name = lexicon or build_lexicon(docs, tokenizer)
    shared = spark.sparkContext.broadcast(tokenizer)
    kept = docs.select(*dict.fromkeys([*carry, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(shared.value)
        automaton = Lexicon.mapped(SparkFiles.get(name))
        for b in batches:
            for first, data, offsets in bw.slices(b.column("text")):
                ids, ends = encode_slice(data, offsets, merger, automaton)
                part = b.slice(first, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in carry], bw.binary_rows(ids.astype("<u4"), ends)], names=[*carry, "ids"]
                )

    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in carry]
    return kept.mapInArrow(run, ", ".join([*fields, "ids binary"]))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``text`` decoded from its ``ids`` (an existing column of that name is replaced)."""
    ready(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)
    kept = encoded.drop("text")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _vocabulary(shared.value).tokens
        table = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.array([len(t) for t in tokens], np.int64)
        start = np.cumsum(size) - size
        for b in batches:
            for first, raw, offsets in bw.slices(b.column("ids")):
                ids = raw.view("<u4").astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(size[ids])))[offsets // 4]
                data = bb.gather(table, start[ids], size[ids])
                part = b.slice(first, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(data, ends)], names=[*names, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return kept.mapInArrow(run, ", ".join([*fields, "text string"]))


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    raw = bw.binary_rows(data, offsets)
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())

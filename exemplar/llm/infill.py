"""Fill-in-the-middle transformation: cuts located on a wavelet matrix over character classes.

A token is a run of ASCII letters or one other code point.  The UTF-8 bytes of a slice of
texts are classed as continuation byte, letter within a run, letter that opens a run, or
other code point, and the classes become a wavelet matrix (two bitmaps with a directory of
bit counts).  Ranks of the last two classes add up to the tokens opened before a byte,
ranks of the last three to its code points.  A cut after t tokens is the last byte with
at most t tokens opened before it; all cuts of a slice bisect for it together.  So nothing is
kept per token, and a long text costs a few bytes per byte of it.

``split`` gives (prefix, middle, suffix) and the text rearranged with sentinels; ``restored``
is the exact inverse in Column functions.  Choices come from sha256 of seed and id, so
reruns agree.

Defined results: a null text is an empty one; empty texts and texts that hold a sentinel
stay as they are (form ``plain``); a null id is the empty string in the hash; repeated rows
are cut alike; all columns of the input are kept, a column with the result's name is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords as bw
from .workers import ready

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many stay plain, and of 100 cut ones so many have the suffix first.
PLAIN_OF_100, SPM_OF_100 = 10, 20

CONTINUES, INSIDE, OPENS, OTHER = range(4)


def _class_tables() -> tuple[np.ndarray, np.ndarray]:
    letter = np.zeros(256, bool)
    letter[0x41:0x5B] = letter[0x61:0x7B] = True
    classes = np.full(256, OTHER, np.uint8)
    classes[letter] = OPENS
    classes[0x80:0xC0] = CONTINUES
    return letter, classes


_LETTER, _CLASS = _class_tables()


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte; runs end at text borders."""
    out = _CLASS[data]
    letter = _LETTER[data]
    inner = letter[1:] & letter[:-1]
    firsts = offsets[(offsets > 0) & (offsets < len(data))]
    inner[firsts - 1] = False
    out[1:][inner] = INSIDE
    return out


class Bitmap:
    """Bits with a directory of counts, one per 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Ranks of symbols below 2^bits: a bitmap per bit from the highest, zeros kept before ones."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.levels: list[tuple[Bitmap, int]] = []
        for b in range(bits - 1, -1, -1):
            one = (symbols >> b & 1).astype(bool)
            zeros = int(len(one) - np.count_nonzero(one))
            self.levels.append((Bitmap(one), zeros))
            if b:
                symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each position."""
        first, last = np.zeros_like(at), at
        for (bitmap, zeros), b in zip(self.levels, range(self.bits - 1, -1, -1)):
            ones = bitmap.rank(first), bitmap.rank(last)
            if symbol >> b & 1:
                first, last = zeros + ones[0], zeros + ones[1]
            else:
                first, last = first - ones[0], last - ones[1]
        return last - first


class Cuts:
    """Token counts of a slice of texts, and the bytes and code points where given token counts end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.start, self.end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        self.matrix = WaveletMatrix(classes(data, offsets), 2)
        self._opened = self.opened(self.start)
        self.tokens = self.opened(self.end) - self._opened

    def opened(self, at: np.ndarray) -> np.ndarray:
        """Tokens opened before each byte."""
        return self.matrix.rank(OPENS, at) + self.matrix.rank(OTHER, at)

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points of its text before each byte (one per text)."""
        points = lambda x: self.opened(x) + self.matrix.rank(INSIDE, x)
        return points(at) - points(self.start)

    def after(self, tokens: np.ndarray) -> np.ndarray:
        """Per text the byte where its first ``tokens`` tokens end."""
        low, high = self.start.copy(), self.end.copy()
        goal = self._opened + tokens
        while (low < high).any():
            mid = (low + high + 1) >> 1
            fits = self.opened(mid) <= goal
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        return low


def _hex_group(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


RESULT = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


def transform(
    docs: DataFrame, name: str = "infill", seed: int = 1, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """``docs`` (all its columns, or those in ``keep``) and one struct column: tokens, form, code points of prefix and middle, output text."""
    ready(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c != name]
    chosen = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"),
        chosen.alias("digest"),
    )
    holds = F.col("body") == ""
    for mark in SENTINELS:
        holds = holds | F.col("body").contains(mark)
    h = [_hex_group(F.col("digest"), i) for i in range(4)]
    form = F.when(holds | (h[2] % 100 >= 100 - PLAIN_OF_100), "plain").when(h[3] % 100 < SPM_OF_100, "spm").otherwise("psm")
    rows = rows.select("row", "body", h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))
    schema = T.StructType([rows.schema["row"], T.StructField("result", T._parse_datatype_string(RESULT))])
    out = rows.mapInArrow(_run, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("result").alias(name))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in bw.slices(batch.column("body")):
            part = batch.slice(first, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([part.column("row"), _cut(part, data, offsets)], names=["row", "result"])


def _cut(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    cuts = Cuts(data, offsets)
    h1, h2 = (part.column(c).to_numpy() % (cuts.tokens + 1) for c in ("h1", "h2"))
    one, two = cuts.after(np.minimum(h1, h2)), cuts.after(np.maximum(h1, h2))
    before, upto = cuts.chars(one), cuts.chars(two)
    raw = data.tobytes()
    forms = part.column("form").to_pylist()
    p, s, m = (x.encode() for x in SENTINELS)
    texts = []
    for form, a, i, j, z in zip(forms, offsets[:-1].tolist(), one.tolist(), two.tolist(), offsets[1:].tolist()):
        if form == "plain":
            texts.append(raw[a:z])
        elif form == "psm":
            texts.append(b"".join((p, raw[a:i], s, raw[j:z], m, raw[i:j])))
        else:
            texts.append(b"".join((s, raw[j:z], p, raw[a:i], m, raw[i:j])))
    stays = np.array([f == "plain" for f in forms], bool)
    columns = [
        pa.array(cuts.tokens, pa.int64()),
        pa.array(forms, pa.string()),
        pa.array(before, pa.int64(), mask=stays),
        pa.array(upto - before, pa.int64(), mask=stays),
        pa.array(texts, pa.binary()).cast(pa.string()),
    ]
    return pa.StructArray.from_arrays(columns, names=["n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form: no sentinel stands in a text that was cut, so they part it."""
    parts = F.split(output, "|".join(SENTINELS))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    )


def digest(docs: DataFrame) -> DataFrame:
    """Per document: its choices, and SHA-256 of the output and of the text rebuilt from it."""
    f = F.col("infill")
    rows = transform(docs, keep=("doc_id",))
    return rows.select(
        "doc_id",
        f["n"].alias("n"),
        f["form"].alias("form"),
        f["prefix_chars"].alias("prefix_chars"),
        f["middle_chars"].alias("middle_chars"),
        F.sha2(f["output"], 256).alias("output_sha256"),
        F.sha2(restored(f["output"], f["form"]), 256).alias("restored_sha256"),
    )

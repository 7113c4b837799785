"""Vectorised work on the UTF-8 bytes of whole Arrow batches of texts.

Shared by the operators that cut words: texts of a batch stay one byte buffer,
words are (start, end) positions, and a word's 64-bit hash is a difference of
prefix sums of a polynomial (multiplier odd, so its powers have inverses mod
2^64), finished with a mixer.  Nothing here loops over words in Python, and a
slice of texts holds about ``SLICE_BYTES`` bytes (or one text, if longer).

Null texts count as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def _byte_codes() -> np.ndarray:
    """One odd 64-bit code per byte value, by splitmix64."""
    out, x = [], 0x1234567
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & _M64
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, dtype=np.uint64)


BYTE_CODES = _byte_codes()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse mod 2^64."""
    if "p" not in _POWERS or len(_POWERS["p"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("p", _MULT), ("q", pow(_MULT, -1, 1 << 64))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing mixer (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of texts of about ``limit`` bytes.

    ``offsets`` has one more entry than the run has texts and starts at 0.
    """
    for first, arr in _chunks(column):
        if len(arr) == 0:
            continue
        offs, data = _buffers(arr)
        lo = 0
        while lo < len(arr):
            hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
            hi = min(max(hi, lo + 1), len(arr))
            yield first + lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def _chunks(column) -> Iterator[tuple[int, pa.Array]]:
    if isinstance(column, pa.ChunkedArray):
        first = 0
        for c in column.chunks:
            yield first, c
            first += len(c)
    else:
        yield 0, column


def _buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not (wide or pa.types.is_string(arr.type) or pa.types.is_binary(arr.type)):
        arr, wide = arr.cast(pa.large_binary()), True
    _, ob, db = arr.buffers()
    offs = np.frombuffer(ob, dtype=np.int64 if wide else np.int32, count=arr.offset + len(arr) + 1)[arr.offset :].astype(np.int64)
    data = np.frombuffer(db, dtype=np.uint8) if db is not None else np.zeros(0, np.uint8)
    return offs - 0, data


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


#: Byte tables: A-Z to lower case; True where a byte belongs to a word.
LOWER = lower_table()
#: ``[^\x20\x09-\x0D]``
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every maximal run of ``inside`` bytes; runs end at text borders."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    ok = inside[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = ok.copy()
    start[1:] &= ~ok[:-1] | border[1:n]
    end = ok.copy()
    end[:-1] &= ~ok[1:] | border[1:n]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, s, side="right") - 1
    return s, e, doc


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of code * multiplier^position, one longer than ``codes``."""
    p, _ = _powers(len(codes))
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * p[: len(codes)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal byte strings have equal hashes wherever they stand."""
    _, q = _powers(len(sums))
    h = (sums[end] - sums[start]) * q[start]
    return mix(h + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every lower-cased word, in order."""
    s, e, doc = words(data, offsets, inside)
    if len(s) == 0:
        return np.zeros(0, np.uint64), doc
    return span_hashes(prefix_sums(BYTE_CODES[LOWER[data]]), s, e), doc


def hash_words(ws: list[str]) -> np.ndarray:
    """Hashes of single lower-cased words, equal to those of ``word_hashes``."""
    raw = [w.encode() for w in ws]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    starts = ends - np.array([len(r) for r in raw], dtype=np.int64)
    return span_hashes(prefix_sums(BYTE_CODES[LOWER[data]]), starts, ends)


def spans_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of spans (in order, apart) as an Arrow array, so equal spans are told by their bytes and not by a hash."""
    size = end - start
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    if len(size) and bounds[-1] != end[-1] - start[0]:  # something stands between them
        at = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)
        data = data[at]
    elif len(size):
        data = np.ascontiguousarray(data[start[0] : end[-1]])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def shingle_hashes(h: np.ndarray, doc: np.ndarray, n_docs: int, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every n-word shingle, in order of texts.

    With ``short``, a text of 1 to n-1 words has its whole sequence as one shingle.
    """
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    m = len(h)
    if m >= n:
        out = np.zeros(m - n + 1, dtype=np.uint64)
        for i in range(n):
            out = mix(out + h[i : m - n + 1 + i]) * np.uint64(_MULT)
        same = doc[: m - n + 1] == doc[n - 1 :]
        sh, sd = mix(out[same] + np.uint64(n)), doc[: m - n + 1][same]
    else:
        sh, sd = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short:
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            extra = np.zeros(len(few), dtype=np.uint64)
            for i in range(n - 1):
                has = count[few] > i
                extra[has] = mix(extra[has] + h[first[few[has]] + i]) * np.uint64(_MULT)
            sh = np.concatenate([sh, mix(extra + count[few].astype(np.uint64))])
            sd = np.concatenate([sd, few])
            order = np.argsort(sd, kind="stable")
            sh, sd = sh[order], sd[order]
    return sh, sd


def distinct_sets(sh: np.ndarray, sd: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, one after the other, and offsets (n_docs + 1)."""
    bounds = np.searchsorted(sd, np.arange(n_docs + 1))
    parts, sizes = [], np.zeros(n_docs, np.int64)
    for i in np.flatnonzero(np.diff(bounds)):
        u = np.unique(sh[bounds[i] : bounds[i + 1]])
        parts.append(u)
        sizes[i] = len(u)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def binary_rows(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary array whose row i holds the bytes of flat[offsets[i]:offsets[i+1]]."""
    flat = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer((offsets * flat.itemsize).astype(np.int64)), pa.py_buffer(flat)],
    ).cast(pa.binary())

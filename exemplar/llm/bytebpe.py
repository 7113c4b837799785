"""Byte-level BPE over whole Arrow batches: pre-tokens and tokenizer files.

``pretokens`` cuts the texts of a byte buffer as the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

does, from runs of character classes, without a loop over texts or words.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@dataclass
class Vocabulary:
    """What a tokenizer file says: token bytes, merges by pair of ids, special strings."""

    tokens: list[bytes]
    byte_id: np.ndarray  # id of each single byte
    pair_left: np.ndarray = field(repr=False)  # merges in order of rank
    pair_right: np.ndarray = field(repr=False)
    pair_result: np.ndarray = field(repr=False)
    special: dict[str, int] = field(default_factory=dict)


def _printable() -> dict[str, int]:
    """The characters that byte-level tokenizer files write for bytes: printable ones as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load_vocabulary(content: str) -> Vocabulary:
    """From the text of a byte-level BPE file of the tokenizers library; other kinds are refused."""
    spec = json.loads(content)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec.get("normalizer"):
        raise ValueError("not a plain byte-level BPE tokenizer")
    to_byte = _printable()
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    size = max([*model["vocab"].values(), *added.values()]) + 1
    tokens = [b""] * size
    for text, i in model["vocab"].items():
        tokens[i] = bytes(to_byte[c] for c in text)
    for text, i in added.items():
        tokens[i] = text.encode()
    byte_id = np.zeros(256, np.int64)
    for c, b in to_byte.items():
        byte_id[b] = model["vocab"][c]
    merges = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
    ids = model["vocab"]
    left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
    result = np.array([ids[a + b] for a, b in merges], np.int64)
    return Vocabulary(tokens, byte_id, left, right, result, added)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, z = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : z + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def _byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of the character each byte belongs to, is the byte a character's first)."""
    table = _classes()
    lead = (data & 0xC0) != 0x80
    kinds = table[data]  # right for ASCII
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        b0 = data[wide].astype(np.int64)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        code = np.where(size == 2, b0 & 0x1F, np.where(size == 3, b0 & 0x0F, b0 & 0x07))
        for k in (1, 2, 3):
            more = size > k
            at = wide[more] + k
            code[more] = (code[more] << 6) | (data[at] & 0x3F)
        kind = table[code]
        kinds[wide] = kind
        for k in (1, 2, 3):
            more = size > k
            kinds[wide[more] + k] = kind[more]
    return kinds, lead


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens and their ends (as positions in ``data``); none crosses a text border."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    kind, lead = _byte_classes(data)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    run = np.ones(n, bool)  # first byte of a run of one class
    run[1:] = (kind[1:] != kind[:-1]) | border[1:n]
    run_at = np.flatnonzero(run)
    run_end = np.append(run_at[1:], n)
    run_kind = kind[run_at]
    start = run.copy()
    # a run of white space before other characters of its text: its last character goes on alone, or with them if it is a blank
    spaces = np.flatnonzero((run_kind == SPACE) & ~border[run_end])
    last = run_end[spaces] - 1
    for _ in range(3):
        back = ~lead[last]
        last = last - back
    start[last] = True
    blank = data[last] == 0x20
    start[run_end[spaces[blank]]] = False
    # 's 't 're 've 'm 'll 'd where a token starts at the apostrophe and no other character of its class follows
    quote = run_at[(data[run_at] == 0x27) & (run_end - run_at == 1) & start[run_at]]
    quote = quote[quote + 1 < n]
    quote = quote[~border[quote + 1]]
    if len(quote):
        c1 = data[quote + 1]
        after = np.minimum(quote + 2, n - 1)
        c2 = np.where((quote + 2 < n) & ~border[np.minimum(quote + 2, n)], data[after], 0)
        two = ((c1 == 0x72) & (c2 == 0x65)) | ((c1 == 0x76) & (c2 == 0x65)) | ((c1 == 0x6C) & (c2 == 0x6C))
        one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        quote, size = quote[one | two], np.where(one, 1, 2)[one | two]
        start[quote + 1] = False
        end = quote + 1 + size
        start[end[end < n]] = True
    s = np.flatnonzero(start)
    return s, np.append(s[1:], n)


def split_specials(data: np.ndarray, offsets: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut at special strings: (data without them, offsets of the pieces, text of each piece, id after each piece or -1)."""
    raw = data.tobytes()
    marks = sorted((s.encode() for s in special), key=len, reverse=True)
    if not any(m in raw for m in marks):
        return data, offsets, np.arange(len(offsets) - 1), np.full(len(offsets) - 1, -1)
    import re

    pattern = re.compile(b"|".join(map(re.escape, marks)))
    pieces, owner, after = [], [], []
    for i in range(len(offsets) - 1):
        text = raw[offsets[i] : offsets[i + 1]]
        at = 0
        for m in pattern.finditer(text):
            pieces.append(text[at : m.start()])
            owner.append(i)
            after.append(special[m.group().decode()])
            at = m.end()
        pieces.append(text[at:])
        owner.append(i)
        after.append(-1)
    out = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    return np.frombuffer(b"".join(pieces), np.uint8), out, np.array(owner), np.array(after)


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + size[i]] for all i, one after the other."""
    total = int(size.sum())
    if total == 0:
        return values[:0]
    first = np.cumsum(size) - size
    return values[np.arange(total) + np.repeat(start - first, size)]


def by_text(ids: np.ndarray, size: np.ndarray, piece_of_token: np.ndarray, owner: np.ndarray, after: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of tokens (``size`` of them each) with the special ids after pieces put in: (ids, offsets per text)."""
    per_piece = np.bincount(piece_of_token, weights=size, minlength=len(owner)).astype(np.int64)
    if (after >= 0).any():
        ends = np.cumsum(per_piece)
        put = np.flatnonzero(after >= 0)
        ids = np.insert(ids, ends[put], after[put])
        per_piece = per_piece + (after >= 0)
    per_text = np.bincount(owner, weights=per_piece, minlength=n_texts).astype(np.int64)
    return ids, np.concatenate(([0], np.cumsum(per_text)))
